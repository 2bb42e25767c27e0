"""The whole URL query against a template tree built in plain Python."""

import math
import random
import re
from collections import defaultdict

from marginalia.llm import url_filter

FAN_OUT, REPEAT, Z, LEAST, PRIOR, REJECT = 16, 4.0, 1.96, 8, 2.0, 0.5


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def is_value(segment):
    return bool(re.search("[0-9]", segment))


def brute(pages, labels):
    known = defaultdict(list)
    for i, _, toxic in labels:
        if i is not None and toxic is not None:
            known[i].append(toxic)
    leaves = defaultdict(lambda: [0, 0, 0])
    rows = []
    for i, url in pages:
        host, path = split(url)
        rule = ruled(host, path)
        segments = tuple(s for s in path.split("/") if s)
        bad = int(max(known[i]) == 1) if i in known else None if rule is None else int(rule.verdict == "block")
        leaf = leaves[host, segments]
        leaf[0] += 1
        leaf[1] += bad is not None
        leaf[2] += bad or 0
        rows.append((i, host, segments, rule))
    template = dict.fromkeys(leaves, "")
    for level in range(max((len(k[1]) for k in leaves), default=0)):
        nodes = defaultdict(lambda: [0, 0, 0])
        seg = {k: k[1][level] for k in leaves if len(k[1]) > level}
        for k, s in seg.items():
            node = nodes[k[0], template[k], s]
            for j in range(3):
                node[j] += leaves[k][j]
        parents = defaultdict(list)
        for (host, above, s), counts in nodes.items():
            parents[host, above].append((counts, is_value(s)))
        name = {}
        for (host, above, s), (_, labelled, bad) in nodes.items():
            all_n, all_labelled, all_bad = (sum(c[j] for c, _ in parents[host, above]) for j in range(3))
            values = sum(v for _, v in parents[host, above])
            kids = len(parents[host, above]) - values + min(values, 1)
            rest_n, rest_bad = all_labelled - labelled, all_bad - bad
            apart = False
            if labelled and rest_n:
                pooled = all_bad / all_labelled
                apart = abs(bad / labelled - rest_bad / rest_n) > Z * math.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / rest_n))
            wild = is_value(s) or (kids > FAN_OUT and all_n < REPEAT * kids)
            alone = wild and apart and min(labelled, rest_n) >= LEAST
            name[host, above, s] = "*" if not alone and (wild or (all_labelled > 0 and not apart and kids > 1)) else s
        for k, s in seg.items():
            template[k] += "/" + name[k[0], template[k], s]
    by, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, (_, labelled, bad) in leaves.items():
        for group in (by[k[0], template[k]], hosts[k[0]]):
            group[0] += labelled
            group[1] += bad
    total = sum(h[0] for h in hosts.values())
    share = sum(h[1] for h in hosts.values()) / total if total else 0.0
    out = {}
    for i, host, segments, rule in rows:
        t = template[host, segments]
        host_share = (hosts[host][1] + PRIOR * share) / (hosts[host][0] + PRIOR)
        purity = (by[host, t][1] + PRIOR * host_share) / (by[host, t][0] + PRIOR)
        out[i] = (t, round(purity, 9), rule.verdict if rule else "block" if purity > REJECT else "allow")
    return out


def same(spark, pages, labels):
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.page_id: (r.template, round(r.purity, 9), r.verdict) for r in got} == brute(pages, labels)
    return got


def test_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    same(spark, pages, labels)


def test_random_trees(spark):
    rng = random.Random(6)
    names = [f"s{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    pages, labels = [], []
    for i in range(1500):
        depth = rng.randint(0, 8)
        parts = [rng.choice(names[: rng.choice([2, 4, 26])]) if rng.random() < 0.8 else str(rng.randrange(100)) for _ in range(depth)]
        pages.append((i, f"http://{rng.choice(['h.test', 'x.org', 'y.com'])}/" + "/".join(parts)))
        if rng.random() < 0.6:
            labels.append((i, 0, int(rng.random() < (0.9 if parts and parts[0] == "sa" else 0.1))))
    got = same(spark, pages, labels)
    assert {r.verdict for r in got} == {"allow", "block"}


def test_deep_branches_and_values_of_their_own(spark):
    """Branches that part below the sixth segment, and values (mp3, web2) whose labels differ, each get their own verdict."""
    rows, labels = [], []
    for i in range(120):
        deep = "/a/b/c/d/e/f/" + ("good" if i % 2 else "evil") + f"/{i}"
        value = f"/{'mp3' if i % 3 else 'web2'}/x{i}"
        rows += [(i, f"http://deep.test{deep}"), (1000 + i, f"http://value.test{value}")]
        if i < 100:
            labels += [(i, 0, int(i % 2 == 0)), (1000 + i, 0, int(i % 3 == 0))]
    got = {r.page_id: r for r in same(spark, rows, labels)}
    assert all((got[i].verdict == "block") == (i % 2 == 0) and (got[1000 + i].verdict == "block") == (i % 3 == 0) for i in range(120))
    assert got[1001].template.startswith("/mp3/") and got[1].template == "/a/b/c/d/e/f/good/*"


def test_shared_segments_take_one_round(spark, monkeypatch):
    """Paths that share hundreds of segments, some of which end on the way, take a round for each fork only."""
    rounds = []
    monkeypatch.setattr(url_filter, "written", lambda df, name, kept=url_filter.written: rounds.append(name) or kept(df, name))
    trap = [f"t{i}" if i % 3 else str(i) for i in range(300)]
    rows = [(i, "http://two.test/" + "/".join([*trap[:200], end])) for i, end in enumerate(("a", "b"))]
    rows += [(100 + i, "http://trap.test/" + "/".join(trap[:i])) for i in range(301)]
    rows += [(500 + i, "http://mixed.test/" + "/".join([*trap[: 20 + i % 3], *(["x"] if i % 2 else []), str(i)])) for i in range(60)]
    rows += [(900, "http://once.test/" + "/".join(trap)), (901, "http://root.test"), (902, None)]
    labels = [(i, 0, i % 2) for i in range(0, 903, 3)]
    got = {r.page_id: r.template for r in same(spark, rows, labels)}
    assert got[0].count("/") == 201 and got[400].count("/") == 300
    assert rounds.count("nodes") <= 6


def test_random_chains(spark):
    """Trees that are mostly chains, with values, ends on the way and a literal star."""
    rng = random.Random(11)
    stems = [[rng.choice(["a", "b", "*", "7", "c9"]) for _ in range(rng.randint(5, 30))] for _ in range(12)]
    pages = []
    for i in range(600):
        stem = rng.choice(stems)
        tail = [rng.choice(["x", "y", "1", "2"]) for _ in range(rng.randint(0, 2))]
        pages.append((i, f"http://{rng.choice(['h.test', 'y.com'])}/" + "/".join(stem[: rng.choice([len(stem), rng.randint(0, len(stem))])] + tail)))
    same(spark, pages, [(i, 0, int(rng.random() < 0.3)) for i in range(0, 600, 2)])
