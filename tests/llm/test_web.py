"""URL templates, WARC archives and licence scans."""

import base64
import hashlib
import io
import re
import struct

import pytest
import zstandard

from marginalia.llm import license_scan, url_filter, warc
from marginalia.llm.storage import fresh_path

LABELS = "doc_id long, quality int, toxic int"


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


def first_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7?x=/a#b", "http://example.com/en/5", "https://a.b.com#/en/", "http://com/en/", "http://xcom/en/1", "ftp://É.NET/de/1", "http://a.example.net/de/8", "http://a.example.net/de/9", "http://x.org/es/", "http://x.org/ES/", "http://x.org?/es/", "a://b://c/d", "http://u.com/en/\nq"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").union(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id + 1000", "url"))
    urls = {r.page_id: r.url for r in pages.collect()}
    out = url_filter.judge_urls(pages, spark.createDataFrame([], LABELS)).collect()
    assert {r.page_id for r in out} == set(urls) and len(out) == len(urls)
    for r in out:
        host, path = host_path(urls[r.page_id])
        rule = first_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text), urls[r.page_id]
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def test_templates_with_bad_labels_are_rejected(spark):
    rows, labels = [], []
    for i in range(60):
        rows += [(i, f"http://h.test/spam/{i}/x"), (100 + i, f"http://h.test/news/{i}/x"), (200 + i, f"http://other.test/page{i}")]
        if i < 40:
            labels += [(i, 0, 1), (100 + i, 1, 0), (200 + i, 1, 0)]
    out = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, LABELS)).collect()}
    assert all((r.verdict == "block") == (i < 100) for i, r in out.items())  # unlabelled pages of the template too
    assert out[50].template == "/spam/*/x" and out[150].template == "/news/*/x" and out[250].template == "/*"


def test_branches_that_behave_alike_are_merged(spark):
    rows = [(i, f"http://h.test/{'ab'[i % 2]}/{i}") for i in range(80)]
    labels = [(i, 1, int(i // 2 % 4 == 0)) for i in range(80)]  # a quarter of either branch is bad
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, LABELS)).collect()
    assert {r.template for r in out} == {"/*/*"} and {r.verdict for r in out} == {"allow"}


def test_url_odd_rows(spark):
    rows = [(1, "http://h.test/a/" + "b/" * 5000, "x"), (1, "http://h.test/a/" + "b/" * 5000, "x"), (None, "http://h.test/a", None), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 0, 1), (1, 0, 0)], LABELS)
    out = url_filter.judge_urls(pages, labels).collect()
    assert sorted(str(r.page_id) for r in out) == ["1", "1", "3", "None"]
    assert url_filter.judge_urls(pages.limit(0), labels).collect() == []


def test_url_plan_is_native(spark, capsys):
    url_filter.judge_urls(spark.createDataFrame([(1, "http://h.test/a")], "page_id long, url string"), spark.createDataFrame([], LABELS)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


DATE = "2024-01-01T00:00:00Z"
PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    rows = [(5, "http://a/", "same"), (3, "http://b/ c\r\nX: y", "same"), (9, None, "same"), (4, "http://d/", None), (8, "http://e/", ""), (7, "http://é/", "é" * 100_000), (None, "n", "same"), (11, "u", "\r\n\r\nWARC/1.1\r\n")]
    paths = warc.write_archives(spark.createDataFrame(rows, PAGES), fresh_path(spark, "warc"))
    out = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, paths).collect()), key=str)
    first, want = {}, []
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (html or "").encode()
        ref = first.get(data)
        first.setdefault(data, i)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if ref is None else "revisit", ref))
    want.append((None, 4, warc.sha1_base32(b"same"), "response", None))
    assert out == sorted(want, key=str)
    full = {r.page_id: r for r in warc.read_archives(spark, paths, with_payload=True).collect()}
    ids = {r.record_id: r for r in full.values()}
    assert len(ids) == len(full)
    assert all(ids[r.refers_to_record].page_id == r.refers_to for r in full.values() if r.record_type == "revisit")
    assert bytes(full[7].payload).decode() == "é" * 100_000 and full[5].payload is None and full[7].url == "http://é/"


def test_archives_are_bounded(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    paths = warc.write_archives(pages.coalesce(1), fresh_path(spark, "warc"), archive_bytes=1 << 17)
    sizes = [r.bytes for r in paths.collect()]
    assert len(sizes) > 2 and warc.read_archives(spark, paths).count() == pages.count()
    empty = warc.write_archives(pages.limit(0), fresh_path(spark, "warc"))
    assert warc.read_archives(spark, empty).collect() == []


def archive(records, dictionary=b"WARC/1.1\r\nWARC-Type: response\r\n"):
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + b"".join(pack.compress(r) for r in records)


def test_one_frame_for_each_record():
    records = [warc.response_record(i, f"http://h/{i}", b"x" * i, DATE) for i in range(20)]
    data = archive(records)
    for chunk in (1, 7, 1 << 20):
        assert [r for _, r in warc.frames(io.BytesIO(data), chunk) if r is not None] == records


@pytest.mark.parametrize("broken", [lambda a: a[:6], lambda a: a[:20], lambda a: a[:-3], lambda a: b"\x28" + a[1:], lambda a: a + b"junk"])
def test_broken_archives(broken):
    data = archive([warc.response_record(1, "u", b"html", DATE)])
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.frames(io.BytesIO(broken(data))))


def foreign(kind, block, *headers):
    return warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{kind}>"), ("WARC-Date", DATE), *headers], block)


def test_archives_of_other_writers(spark, tmp_path):
    """warcinfo, requests, WARC/1.0, repeated and folded headers, compressed or absent dictionaries, payloads of other forms."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nhtml\r\n0\r\n\r\n"
    records = [
        foreign("warcinfo", b"software: x\r\n", ("Content-Type", "application/warc-fields")),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", ("Content-Type", "application/http;msgtype=request")),
        foreign("response", http, ("Content-Type", "application/http;msgtype=response"), ("WARC-Target-URI", "http://a/"), ("WARC-Payload-Digest", "sha1:" + warc.sha1_base32(b"html")), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>")),
        foreign("response", b"1.2.3.4", ("Content-Type", "text/dns"), ("WARC-Target-URI", "dns:a"), ("X-Note", "one\r\n two")).replace(b"WARC/1.1", b"WARC/1.0", 1),
        foreign("revisit", b"", ("WARC-Profile", "p"), ("WARC-Refers-To", "<urn:uuid:response>")),
    ]
    dictionary = b"WARC/1.1\r\nWARC-Type: response\r\n"
    whole = archive(records, dictionary)
    small = zstandard.ZstdCompressor().compress(dictionary)
    files = {"plain": whole, "packed": struct.pack("<II", warc.SKIPPABLE, len(small)) + small + whole[8 + len(dictionary) :], "none": b"".join(map(zstandard.ZstdCompressor().compress, records))}
    for name, data in files.items():
        (tmp_path / f"{name}.warc.zst").write_bytes(data)
        paths = spark.createDataFrame([(f"file://{tmp_path}/{name}.warc.zst",)], "path string")
        out = [tuple(r) for r in warc.read_archives(spark, paths, with_payload=True).collect()]
        assert out == [
            (None, "http://a/", len(http) - http.index(b"4\r\n"), warc.sha1_base32(b"html"), "response", None, "<urn:uuid:response>", None, bytearray(b"4\r\nhtml\r\n0\r\n\r\n")),
            (None, "dns:a", 7, warc.sha1_base32(b"1.2.3.4"), "response", None, "<urn:uuid:response>", None, bytearray(b"1.2.3.4")),
            (None, None, None, None, "revisit", None, "<urn:uuid:revisit>", "<urn:uuid:response>", None),
        ]
        assert warc.read_archives(spark, paths, kinds=("warcinfo", "request")).count() == 2


def test_repeated_pages_and_clashing_columns(spark):
    rows = [(1, "u", "x", b"f"), (1, "u", "x", b"f"), (1, "v", "x", None), (2, "u", "x", None), (1, "u", "y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, frame binary").selectExpr("*", "1 as sha", "2 as first_id")
    out = warc.read_archives(spark, warc.write_archives(pages, fresh_path(spark, "warc"))).collect()
    assert sorted((r.page_id, r.url, r.payload_digest, r.record_type, r.refers_to) for r in out if r.record_type == "response") == sorted((1, u, warc.sha1_base32(h), "response", None) for u, h in [("u", b"x"), ("u", b"x"), ("v", b"x"), ("u", b"y")])
    (revisit,) = (r for r in out if r.record_type == "revisit")
    assert (revisit.page_id, revisit.refers_to) == (2, 1) and revisit.refers_to_record in {r.record_id for r in out if r.url == "u" and r.page_id == 1}
    short = warc.read_archives(spark, warc.write_archives(pages, fresh_path(spark, "warc"), least_revisit=2)).collect()
    assert {r.record_type for r in short} == {"response"}


def test_broken_records():
    good = warc.response_record(1, "u", b"html", DATE)
    warc.checked(good)
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good[:-1], good + b"x", good.replace(b"html\r\n", b"HTML\r\n"), good.replace(b"WARC-Type: response", b"WARC-Type response"), b"", good.replace(b"Content-Length: ", b"Content-Length: -")):
        with pytest.raises(warc.WarcError):
            warc.checked(bad)


def nearest(unit, threshold=0.8, templates=license_scan.TEMPLATES):
    """(dice, licence, shared) of the nearest template, None below the threshold."""
    own = license_scan.bigrams(unit)
    best = min(((-2 * len(own & of) / (len(own) + len(of)), name, len(own & of)) for name, of in ((n, license_scan.bigrams(t)) for n, t in templates)), default=None) if own else None
    return (-best[0], *best[1:]) if best and -best[0] >= threshold else None


def licences(text):
    """Licence to (best dice, number of distinct units), by all units; windows as runs of paragraphs tried one after the other."""
    low = (text or "").lower()
    paragraphs = [p for p in re.split(license_scan.PARAGRAPH, low) if license_scan.words(p)]
    known = set(license_scan.long_bigrams(license_scan.TEMPLATES))
    end = [len(license_scan.bigrams(p) & known) >= license_scan.ENDS for p in paragraphs]
    found = [(None, u, nearest(u)) for u in {*low.split("\n"), *re.split(license_scan.SENTENCE, low), *re.split(license_scan.PARAGRAPH, low), low}]
    for i, p in enumerate(paragraphs):
        window = p
        for j in range(i + 1, len(paragraphs)):
            window += "\n" + paragraphs[j]
            if len(license_scan.words(window)) > license_scan.window_words(license_scan.TEMPLATES, 0.8):
                break
            if end[i] and end[j]:
                found.append(((i, j), window, nearest(window)))
    found = [f for f in found if f[2]]
    inside = lambda a, b: a and b and a != b and b[0] <= a[0] and a[1] <= b[1]
    kept = [f for f in found if not any(inside(f[0], g[0]) and g[2][1] != f[2][1] and g[2][2] > f[2][2] for g in found)]
    out = {}
    for _, unit, (x, name, _) in kept:
        out.setdefault(name, {})[tuple(license_scan.words(unit))] = x
    return {name: (max(x.values()), len(x)) for name, x in out.items()}


def usual(text, mark=""):
    """A licence in lines of twelve words, its sentences in paragraphs of their own, behind a comment mark."""
    blocks = [s.split() for s in re.split(r"(?<=[.:]) (?=[A-Z0-9])", text)]
    return f"\n{mark.rstrip()}\n".join("\n".join(mark + " ".join(b[i : i + 12]) for i in range(0, len(b), 12)) for b in blocks)


@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "GPL-3.0-or-later", "Apache-2.0"])
def test_full_texts_inside_longer_ones(spark, name):
    """In paragraphs between prose, above code, in line comments and in a block comment, with a holder's name before."""
    text = max((t for n, t in license_scan.TEMPLATES if n == name), key=len)
    code = "\n\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(60))
    head = "Copyright (c) 2020, Someone\n\n"
    texts = [
        "A long story.\n\n" * 50 + usual(text) + "\n\nIt goes on.\n" * 50,
        head + usual(text) + "\n\n" + code,
        "#!/bin/sh\n#\n# Copyright 2020\n#\n" + usual(text, "# ") + "\n\n" + code,
        "/*\n * Copyright 2020 X\n *\n" + usual(text, " * ") + "\n */\n" + code,
        "// " + text + "\n" + code,
    ]
    out = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.license == name and r.dice > 0.9} == set(range(len(texts)))


def test_a_notice_inside_a_line(spark):
    out = license_scan.scan_licenses(spark.createDataFrame([(1, "Great tool for all of us here! Released under the MIT License. See the notes below for how to build it."), (2, "the software licensed here is no licence at all")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license, r.dice) for r in out] == [(1, "MIT", 1.0)]


def test_licences_match_all_units_and_templates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = [(10**6 + i, f"intro words\n\n{t.replace(' the ', ' this ', 1)}\n\nmore") for i, (_, t) in enumerate(license_scan.TEMPLATES)] + [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "license"), (10**7 + 3, "all rights reserved but these")]
    extra += [(10**8 + i, f"prose before\n\n{usual(t, mark)}\n\nint main() {{}}\n\nmore code of the software") for i, (t, mark) in enumerate((t, m) for _, t in license_scan.TEMPLATES for m in ("", "# "))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r.doc_id, r.license): (round(r.dice, 9), r.units) for r in license_scan.scan_licenses(both).collect()}
    want = {(r.doc_id, name): (round(x, 9), n) for r in both.collect() for name, (x, n) in licences(r.text).items()}
    assert got == want and len(got) > 40


def notices(name, version):
    """A notice as its licence gives it, with three ends, plain and in a block comment."""
    thing = "library" if name.startswith("L") else "program"
    text = f"This {thing} is free software; you can redistribute it and/or modify\nit under the terms of the GNU {name}General Public License as published by\nthe Free Software Foundation; either version {version} of the License, or\n(at your option) any later version.\n\n"
    text += f"This {thing} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n{name}General Public License for more details.\n\nYou should have received a copy of the GNU {name}General Public License\nalong with this {thing}"
    ends = ("; if not, write to the Free Software\nFoundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA\n", ".  If not, see <https://www.gnu.org/licenses/>.\n", "; if not, write to the Free Software\nFoundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA\n")
    marked = [(text + e).replace("\n", "\n * ") for e in ends]
    return [text + e for e in ends] + [f"/*\n * {t}\n */\nint x;\n\nint y;" for t in marked]


def test_gnu_notices_are_told_apart(spark):
    kinds = {"LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "LGPL-2.0": ("Library ", "2"), "GPL-1.0": ("", "1"), "GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "AGPL-3.0": ("Affero ", "3")}
    rows = [(i, f"{kind}-or-later", text) for i, (kind, text) in enumerate((k, t) for k, of in kinds.items() for t in notices(*of))]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, want string, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(i, name) for i, name, _ in rows} and min(r.dice for r in got) > 0.9


def test_a_licence_in_paragraphs_hides_the_one_inside(spark):
    text = usual(max((t for n, t in license_scan.TEMPLATES if n == "BSD-3-Clause"), key=len))
    both = usual(max((t for n, t in license_scan.TEMPLATES if n == "BSD-2-Clause"), key=len))
    got = license_scan.scan_licenses(spark.createDataFrame([(1, text), (2, both), (3, f"{text}\n\nother things\n\n{both}")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "BSD-3-Clause"), (2, "BSD-2-Clause"), (3, "BSD-2-Clause"), (3, "BSD-3-Clause")]


def test_templates_of_a_caller(spark):
    """Long ones without any usual stem, in a whole text, in a paragraph and with a tenth of the words gone."""
    own = " ".join(f"{w}{i}" for i in range(30) for w in ("alpha", "be", "c"))
    less = " ".join(w for i, w in enumerate(own.split()) if i % 20)
    docs = spark.createDataFrame([(1, own), (2, f"some prose\n\n{own}\n\nmore"), (3, less), (4, own[:100]), (5, "software license")], "doc_id long, text string")
    got = license_scan.scan_licenses(docs, templates=(("Own", own), ("Short", "do as you like")))
    assert sorted((r.doc_id, r.license) for r in got.collect()) == [(1, "Own"), (2, "Own"), (3, "Own")]


def test_licence_odd_rows(spark):
    df = spark.createDataFrame([(1, "All rights reserved.", "x"), (1, "All rights reserved.", "x"), (None, "Released under the MIT License.", None), (2, "word " * 500_000 + "\nReleased under the MIT License.", None)], "doc_id long, text string, license string")
    assert sorted((str(r.doc_id), r.license, r.units) for r in license_scan.scan_licenses(df).collect()) == [("1", "All-rights-reserved", 1), ("2", "MIT", 2), ("None", "MIT", 1)]
    assert license_scan.scan_licenses(df.limit(0)).collect() == []


def test_licence_plan_is_native(spark, capsys):
    license_scan.scan_licenses(spark.createDataFrame([(1, "x")], "doc_id long, text string")).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
