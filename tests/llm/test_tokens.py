"""Token ids, packing and the token store against the tokenizers library itself."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from marginalia.llm import packing, token_store
from marginalia.llm.storage import fresh_path
from marginalia.llm.tokens import encoder

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["", " ", "\n", " a", "a ", "a\n\nb", "a \n b", "I'm, we'll 'tis", "x\u00a0y", "a\u2003b", "naïve\u0301 Ünï", "<|endoftext|> x", "<|startoftext|>", "3.14 1,000", "\t\tif x:\r\n", "e\u0301", "日本語 テキスト", "😀😀 ok", "\u3000wide", "a\x1cb", "ﬁ ﬂ", "K\u212a", "a<|b", "..., --- !!", "don't DON'T", "\x00\x01"]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.fixture(scope="module")
def library():
    out = {}
    for name in NAMES:
        out[name] = Tokenizer.from_file(path(name))
        out[name].encode_special_tokens = True
    return lambda name, text: out[name].encode(text or "", add_special_tokens=False).ids


def encoded(name, texts, end):
    out = []
    for _, places, ids in encoder(path(name), end).encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:], strict=True)]
    return out


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(library, name):
    assert encoded(name, [*ODD, None], 9) == [library(name, t) + [9] for t in [*ODD, None]]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from([" ", "  ", "\n", "\t", "ab", "Cd", "'s", "'", "9", "12", "é", "…", ".", "<|", "|>", "\u00a0", "ſ", "İ"]), max_size=14).map("".join)), max_size=6))
def test_any_text(library, name, texts):
    assert encoded(name, texts, 9) == [library(name, t) + [9] for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_a_long_text(library, name):
    text = "Some words, and more words; x = 3.5\n" * 60_000
    assert encoded(name, ["a", text, "b"], 9)[1] == library(name, text) + [9]


def test_documents_are_packed_whole(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(df, path(NAMES[0])).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids, at = library(NAMES[0], texts[doc]) + [2], 0
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        for p in parts:
            assert p.start == at and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids) and all(p.length == 1024 for p in parts[1:]) and parts[0].length <= 1024
    checked_bins(rows, 1024)


def checked_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert len(bins) <= least * 1.01 + 1
    return len(bins), least


def test_shards_are_merged(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, int(x)) for i, x in enumerate(rng.integers(1, 900, 5000))]
    out = packing.packed(spark.createDataFrame(rows, "id long, piece int, length long").coalesce(2), 1024, shard_items=1000, merge=2).collect()
    assert sorted((r.id, r.length) for r in out) == [(i, n) for i, _, n in rows]
    checked_bins(out, 1024)


def test_local_search_finds_what_best_fit_misses():
    # best fit makes 4+4, 3+3+3 and 3; a 4 exchanged for a 3 makes room for the last one
    sizes = np.array([4, 4, 3, 3, 3, 3])
    assert len(packing.Bins(sizes, 10).items) == 3
    bin_of, place = packing.pack(sizes, 10)
    assert len(set(bin_of)) == 2
    for b in set(bin_of):
        mine = sorted((place[i], sizes[i]) for i in np.flatnonzero(bin_of == b))
        assert mine[0][0] == 0 and sum(s for _, s in mine) <= 10


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_any_sizes_are_packed(sizes):
    sizes = np.array(sizes, np.int64)
    bin_of, place = packing.pack(sizes, 20)
    for b in set(bin_of.tolist()):
        at = 0
        for p, s in sorted((place[i], sizes[i]) for i in np.flatnonzero(bin_of == b)):
            assert p == at
            at += s
        assert at <= 20


def test_exchanges_raise_the_squared_fill(monkeypatch):
    sizes = np.random.default_rng(7).integers(100, 700, 200)
    bins, seen = packing.Bins(sizes, 1024), []
    step = packing.Bins._exchange

    def watched(self, a):
        done = step(self, a)
        seen.append(int((self.fill.astype(np.int64) ** 2).sum()))
        return done

    monkeypatch.setattr(packing.Bins, "_exchange", watched)
    before = int((bins.fill**2).sum())
    bins.search()
    assert seen == sorted(seen) and seen[-1] > before
    assert (bins.fill == [sum(sizes[i] for i in b) for b in bins.items]).all()


def test_packing_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a", None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = packing.pack_documents(df, path(NAMES[0])).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "3", "None"] and sum(r.length for r in out) == 5
    checked_bins(out, 1024)
    assert packing.pack_documents(df.limit(0), path(NAMES[0])).collect() == []


def test_store_round_trip(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    store = fresh_path(spark, "tokens")
    token_store.write_tokens(df.repartition(5), store, path(NAMES[1]))
    want, at = [], 0
    for r in sorted(df.collect(), key=lambda r: r.doc_id):
        ids = library(NAMES[1], r.text) + [1]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    got = token_store.digests(token_store.read_tokens(spark, store)).collect()
    assert sorted(map(tuple, got)) == want
    assert sorted(map(tuple, token_store.read_metadata(spark, store).collect())) == [w[:3] for w in want]
    some = token_store.read_tokens(spark, store, want[5][0], want[9][0]).collect()
    assert sorted((r.doc_id, r.start, len(r.ids)) for r in some) == [w[:3] for w in want[5:10]]


def test_store_layout(spark):
    import glob

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    store = fresh_path(spark, "tokens")
    token_store.write_tokens(df, store, path(NAMES[1]), files=2)
    files = sorted(glob.glob(f"{store.removeprefix('file://')}/data/*.parquet"))
    lasts = []
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["ids"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
        lasts.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max))
    assert len(files) == 2 and lasts[0][1] < lasts[1][0]


def test_store_of_odd_rows(spark):
    df = spark.createDataFrame([(2, None, 0), (2, "b", 1), (1, "", 2), (None, "n", 3)], "doc_id long, text string, part int")
    store = fresh_path(spark, "tokens")
    token_store.write_tokens(df, store, path(NAMES[1]))
    out = sorted(token_store.read_metadata(spark, store).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in out] == [(None, 2), (1, 1), (2, 1), (2, 2)] and [r.start for r in out] == [0, 2, 3, 4]
    store = fresh_path(spark, "tokens")
    token_store.write_tokens(df.limit(0), store, path(NAMES[1]))
    assert token_store.read_tokens(spark, store).collect() == []
