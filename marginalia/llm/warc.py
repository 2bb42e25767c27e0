"""WARC archives compressed record by record with Zstandard and a shared dictionary.

An archive starts with a skippable frame (magic number 0x184D2A5D) that holds the dictionary; each record is a frame of
its own after it. Archives are bounded in size and written by tasks through pyarrow's file systems into a folder that
all executors share: first under a name of the attempt's own, then renamed, so an attempt that was lost leaves nothing
half-written under a final name. Readers stream an archive frame by frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm.storage import written

# Magic numbers and versions of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.1", b"WARC/1.0")
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bounds of the dictionary's training sample: pages, and bytes of each (longer pages are not drawn).
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 16, 1 << 15


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary, or the samples' own bytes where they are too few to train on."""
    raw = b"".join(samples)[:DICTIONARY_BYTES] or VERSION + b"\r\nWARC-Type: response\r\n"
    if len(samples) < 16:
        return raw
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return raw


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + END + block + END


#: Headers that a record can't do without, and of which it has one.
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block; raises WarcError unless version, headers and lengths are right.

    Values of a header that repeats are joined by line ends; lines that begin with a blank go on with the header before.
    """
    head, found, rest = raw.partition(END)
    if not found:
        raise WarcError("no end of headers")
    first, *lines = head.split(b"\r\n")
    if first not in VERSIONS:
        raise WarcError(f"unknown version {first[:20]!r}")
    headers: dict[str, list[str]] = {}
    values: list[str] = []
    for line in lines:
        text = line.decode("utf-8", "surrogateescape")
        if line[:1] in (b" ", b"\t") and values:
            values[-1] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        values = headers.setdefault(name.lower(), [])
        values.append(value.strip())
    for name in MANDATORY:
        if len(headers.get(name, ())) != 1:
            raise WarcError(f"no {name}, or several")
    length = headers["content-length"][0]
    if not (length.isascii() and length.isdigit()) or int(length) + len(END) != len(rest) or not rest.endswith(END):
        raise WarcError("the block's length is not Content-Length")
    return {name: "\n".join(v) for name, v in headers.items()}, rest[: -len(END)]


def frames(stream, chunk: int = 1 << 20):
    """(dictionary, None) first, then (None, record bytes) for each frame of an archive.

    The leading skippable frame holds the dictionary, as it is or as a Zstandard frame of its own. An archive may have none,
    in which case the dictionary is empty.
    """
    head = stream.read(8)
    magic = struct.unpack("<I", head[:4])[0] if len(head) == 8 else 0
    if magic == SKIPPABLE:
        size = struct.unpack("<I", head[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary is cut off")
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        data = stream.read(chunk)
    elif magic == FRAME:
        raw, data = b"", head + stream.read(chunk)
    else:
        raise WarcError("no leading skippable frame")
    yield raw, None
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    while data:
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            if not data:
                raise WarcError("the last frame is cut off")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else stream.read(chunk)
        yield None, b"".join(parts)
        data = data or stream.read(chunk)


def _file_system(uri: str):
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_revisit: int = 0, archive_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page and return the archives' table (path, records, bytes).

    The payload is the html in UTF-8, empty for a null. Of pages with equal payloads of least_revisit bytes or more, those
    with the smallest id have response records, the others revisit the first of them (by url); smaller payloads all have
    response records. Pages with a null id are never revisited and never revisit. Rows that repeat have a record each; of
    rows that are equal in all three columns these are equal, id included. Other columns are ignored. An empty table gives
    no archives.

    Pages are compressed as they are scanned: what is shuffled are frames, and of payloads that a task has met under a
    smaller id not even those.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("size", F.octet_length("html").cast("long"))
    # drawn by a hash before anything is sorted, so that tasks send about twice SAMPLE_PAGES pages in all, however many tasks there are
    chance = min(1.0, 2 * SAMPLE_PAGES / max(1, pages.count()))
    drawn = rows.withColumn("h", F.xxhash64("id", "url")).filter(F.pmod("h", F.lit(1 << 40)) < int(chance * (1 << 40)))
    sample = drawn.filter(F.col("size").between(1, SAMPLE_BYTES)).select("html", "h").orderBy("h").limit(SAMPLE_PAGES).collect()
    dictionary = train_dictionary([record([("WARC-Type", "response")], HTTP + r.html.encode("utf-8")) for r in sample])

    solid = rows.filter((F.col("size") >= least_revisit) & F.col("id").isNotNull()).withColumn("sha", F.sha1("html"))
    again = solid.groupBy("sha", "size").agg(F.min(F.struct("id", "url")).alias("first"), F.max("id").alias("last"))
    again = written(again.filter("first.id < last").select("sha", "size", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url")), "again")

    def packer() -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)

    def compressed(batches):
        pack, seen = packer(), {}
        for batch in batches:
            sha, size, out = [], [], []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode("utf-8")
                digest = hashlib.sha1(payload)
                key = digest.digest() if page is not None and len(payload) >= least_revisit else None
                known = key is not None and seen.get(key, page) < page
                if key is not None and not known:
                    seen[key] = page
                sha.append(digest.hexdigest())
                size.append(len(payload))
                out.append(None if known else pack.compress(response_record(page, url, payload, date)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha, pa.string()), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["id", "url", "sha", "size", "frame"])

    linked = rows.select("id", "url", "html").mapInArrow(compressed, "id long, url string, sha string, size long, frame binary").join(again, ["sha", "size"], "left")

    def work(batches):
        # the attempt is part of the names, so a lost or speculative one never writes over files that the manifest lists
        part, attempt, number, out = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, None
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        pack = packer()

        def close():
            out.close()
            system.move(temporary, final)
            done.append((f"{folder}/{final.rsplit('/', 1)[1]}", records, size))

        done, records, size, temporary, final = [], 0, 0, "", ""
        for batch in batches:
            for page, url, sha, length, frame, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    final = f"{base}/part-{part:05d}-{attempt}-{number:05d}.warc.zst"
                    temporary = f"{base}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary, compression=None)
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                    records, size, number = 0, 8 + len(dictionary), number + 1
                if first_id is not None and page is not None and page > first_id:
                    frame = pack.compress(revisit_record(page, url, base64.b32encode(bytes.fromhex(sha)).decode(), length, first_id, first_url, date))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    linked = linked.select("id", "url", "sha", "size", "frame", "first_id", "first_url")
    return written(linked.mapInArrow(work, "path string, records long, bytes long"), "archives")


def _target(url: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record_id(kind: str, page: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page} {digest} {url}')}>"


def _headers(kind: str, page: int | None, url: str | None, digest: str, size: int, block: bytes, date: str) -> list[tuple[str, str]]:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(kind, page, url, digest)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _target(url)))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("X-Payload-Length", str(size))]
    return headers if page is None else [*headers, ("X-Page-Id", str(page))]


def response_record(page: int | None, url: str | None, payload: bytes, date: str) -> bytes:
    return record(_headers("response", page, url, sha1_base32(payload), len(payload), HTTP + payload, date), HTTP + payload)


def revisit_record(page: int, url: str | None, digest: str, size: int, first: int, first_url: str | None, date: str) -> bytes:
    """A record without payload that names the response record of the page it repeats."""
    headers = _headers("revisit", page, url, digest, size, HTTP, date)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id("response", first, first_url, digest)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(first))]
    return record(headers if first_url is None else [*headers, ("WARC-Refers-To-Target-URI", _target(first_url))], HTTP)


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string"


def _digest_is(named: str | None, data: bytes) -> bool:
    """Whether data has the digest that a header names; one that is absent or of another kind than SHA-1 is not checked."""
    kind, _, value = (named or "").partition(":")
    return kind.lower() != "sha1" or value.upper() == sha1_base32(data) or value.lower() == hashlib.sha1(data).hexdigest()


def checked(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record whose format, lengths and digests are right; others raise WarcError.

    A block of HTTP ends its own headers before the payload; other blocks are payloads as they are. Of a payload in a
    transfer or content encoding the digest may mean either form and isn't checked.
    """
    headers, block = parse_record(raw)
    if not _digest_is(headers.get("warc-block-digest"), block):
        raise WarcError("the block has another digest")
    kind, payload, encoded = headers["warc-type"], block, False
    if headers.get("content-type", "").lower().startswith("application/http"):
        http, found, payload = block.partition(END)
        if not http.startswith(b"HTTP/") and kind in ("response", "revisit"):
            raise WarcError("no HTTP headers in the block")
        if not found and kind == "response":
            raise WarcError("no end of the HTTP headers in the block")
        encoded = b"\r\ntransfer-encoding:" in http.lower() or b"\r\ncontent-encoding:" in http.lower()
    if kind == "response" and not encoded and not _digest_is(headers.get("warc-payload-digest"), payload):
        raise WarcError("the payload has another digest")
    if kind == "response" and headers.get("x-payload-length", str(len(payload))) != str(len(payload)):
        raise WarcError("the payload has another length")
    if kind == "revisit" and ("warc-profile" not in headers or ("x-page-id" in headers and payload)):
        raise WarcError("a revisit without a profile, or with a payload")
    return headers, payload


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


def _row(headers: dict[str, str], payload: bytes) -> tuple:
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest")
    size = _number(headers.get("x-payload-length"))
    if kind != "revisit":
        size, digest = len(payload), digest or f"sha1:{sha1_base32(payload)}"
    page = headers.get("x-page-id")
    return (
        int(page) if page is not None else None, headers.get("warc-target-uri"), size, digest.removeprefix("sha1:") if digest else None, kind,
        int(headers["x-refers-to-page-id"]) if "x-refers-to-page-id" in headers else None, headers["warc-record-id"], headers.get("warc-refers-to"),
        payload if kind != "revisit" else None,
    )


def read_archives(spark: SparkSession, paths: DataFrame, *, with_payload: bool = False, kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """A row for each record of the given kinds in the archives named in column path; a broken one fails the job with its name.

    Archives of other writers are read too: their records have no page_id and no refers_to, and revisits may lack
    payload_bytes; record_id and refers_to_record stand for them. Records of other kinds (warcinfo, requests, metadata) are
    checked and passed over. payload_bytes and payload_digest are those of the full payload, for revisits too. with_payload
    adds the payload, which is null for revisits. Memory is bounded by the largest record.
    """

    def work(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _file_system(path)
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(at, compression=None) as stream:
                    try:
                        for _, raw in frames(stream):
                            if raw is None:
                                continue
                            headers, payload = checked(raw)
                            if headers["warc-type"] not in kinds:
                                continue
                            rows.append(_row(headers, payload))
                            held += len(payload)
                            if len(rows) == 4096 or held > 16 << 20:
                                yield _batch(rows, with_payload)
                                rows, held = [], 0
                    except (WarcError, zstandard.ZstdError) as e:
                        raise WarcError(f"{path}: {e}") from e
                if rows:
                    yield _batch(rows, with_payload)

    n = max(1, min(paths.count(), 4096))
    return paths.select("path").repartition(n, "path").mapInArrow(work, READ_SCHEMA + (", payload binary" if with_payload else ""))


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_payload]
    columns = [*zip(*rows, strict=True)]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", *["payload"] * with_payload]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
