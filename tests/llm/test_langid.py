"""Language identification: held-out accuracy, prototypes against their definition, odd rows."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import langid
from marginalia.llm.queries import op2_hyperdimensional_langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in op2_hyperdimensional_langid(spark, SF).collect()}
    rows = docs.collect()
    assert len(out) == len(rows)
    right = total = 0
    for r in rows:
        o = out[r.doc_id]
        assert o.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= o.score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert o.lang_pred == "und"
        elif o.held_out and r.lang is not None:
            total, right = total + 1, right + (o.lang_pred == r.lang)
    assert total > 100 and right / total > 0.97


def test_held_out_labels_are_never_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lied = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    models = [langid.train(d.filter(~langid.held_out())) for d in (docs, lied)]
    assert models[0].languages == models[1].languages and np.array_equal(models[0].prototypes, models[1].prototypes)


def test_bundles_are_sums_of_bound_trigrams():
    alphabet = [ord(c) for c in "abcé"]
    own = langid.Profiler(alphabet, 64)
    vector = lambda c: langid._vector(ord(c) if c != " " else 0, 64).astype(np.int64)
    text = "Ab, cé"
    seq = " ab cé "
    want = np.zeros(64, np.int64)
    for i in range(len(seq) - 2):
        if seq[i + 1] != " ":
            want += np.roll(vector(seq[i]), 2) * np.roll(vector(seq[i + 1]), 1) * vector(seq[i + 2])
    got = own.bundle(["", text, "--", text])
    assert (got[1] == want).all() and (got[3] == want).all() and not got[0].any() and not got[2].any()


def test_odd_rows(spark):
    texts = [("en", "the cat and the dog and the bird"), ("en", "then they went there with them"), ("fr", "le chat et les oiseaux des forêts"), ("fr", "une pomme que je mange avec les doigts")]
    rows = [(i, t, l) for i, (l, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(10, None, "en"), (11, "", "fr"), (12, "123 !!", None), (12, "the dog", None), (None, "les chats", None)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("fr"))
    model = langid.train(docs)
    out = sorted(((str(r.doc_id), r.lang_pred, r.score > 0) for r in langid.identify(docs, model).collect()))
    assert out == sorted([("0", "en", True), ("1", "en", True), ("2", "fr", True), ("3", "fr", True), ("10", "und", False), ("11", "und", False), ("12", "und", False), ("12", "en", True), ("None", "fr", True)])
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog ", "en"), (2, "der schnelle braune fuchs springt über den faulen hund ", "de")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    long = docs.select("doc_id", F.repeat("text", 50_000).alias("text"))
    assert {r.doc_id: r.lang_pred for r in langid.identify(long, model).collect()} == {1: "en", 2: "de"}


def test_labels_in_several_scripts(spark):
    """Latin texts with over 62 letters of their own are the most; Cyrillic, Greek and Hangul ones tell two languages each."""
    rng = np.random.default_rng(5)
    latin = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0x101, 0x137, 2)]]
    scripts = {"l": latin, "ru": [chr(c) for c in range(0x430, 0x450)], "el": [chr(c) for c in range(0x3B1, 0x3C9)], "ko": [chr(c) for c in range(0xAC00, 0xAC00 + 600)]}
    rows = []
    for name, letters in scripts.items():
        for k in range(1 if name == "l" else 2):
            mine = [letters[i] for i in rng.permutation(len(letters))[: len(letters) * (1 if name == "l" else 3) // (1 if name == "l" else 4)]]
            words = ["".join(rng.choice(mine, rng.integers(2, 9))) for _ in range(150)]
            rows += [(" ".join(rng.choice(words, 30)), f"{name}{k}") for _ in range(400 if name == "l" else 30)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(docs.filter("doc_id % 3 > 0"))
    out = langid.identify(docs.filter("doc_id % 3 = 0"), model).collect()
    assert len(model.languages) == 7 and all(r.lang_pred == rows[r.doc_id][1] for r in out)


def by_definition(texts, dim=langid.DIM):
    """The vector of each text, trigram by trigram in plain Python."""
    known = {}

    def vector(c):
        if c not in known:
            known[c] = langid._vector(c, dim).astype(np.int64)
        return known[c]

    grams, out = {}, []
    for text in texts:
        seq = [0]
        for c in text or "":
            point = ord(c.lower()[0]) if c.isalpha() else 0
            if point or seq[-1]:
                seq.append(point)
        seq.append(0)
        total = np.zeros(dim, np.int64)
        for gram, n in Counter(zip(seq, seq[1:], seq[2:])).items():
            if gram[1]:
                if gram not in grams:
                    grams[gram] = np.roll(vector(gram[0]), 2) * np.roll(vector(gram[1]), 1) * vector(gram[2])
                total += n * grams[gram]
        out.append(total)
    return out


def test_predictions_match_the_definition(spark):
    """Prototypes, predictions and scores of a small table worked out text by text, with scripts, odd texts and clashing columns."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = [(10**6 + i, t, lang) for i, (t, lang) in enumerate([("привет как дела сегодня", "ru"), ("мы идём домой", "ru"), ("γειά σου κόσμε", "el"), ("καλημέρα σε όλους", "el"), ("", "ru"), (None, "ru"), ("123 --", None), ("πού είναι", None), ("где он", None), ("日本語の文", "ja"), ("文章です", None)])]
    both = docs.union(spark.createDataFrame(more, docs.schema)).withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    rows = both.collect()
    learned = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    assert max(Counter(r.lang for r in learned).values()) <= langid.PER_LANGUAGE  # so that all of them count
    vectors = dict(zip([id(r) for r in rows], by_definition([r.text for r in rows]), strict=True))
    languages = sorted({r.lang for r in learned})
    prototypes = [sum(vectors[id(r)] for r in learned if r.lang == lang).astype(np.float64) for lang in languages]
    want = {}
    for r in rows:
        v = vectors[id(r)].astype(np.float64)
        cos = [v @ p / np.linalg.norm(v) / np.linalg.norm(p) if v.any() else 0.0 for p in prototypes]
        want[r.doc_id] = (languages[int(np.argmax(cos))], max(0.0, max(cos))) if v.any() else ("und", 0.0)
    model = langid.train(both.filter(~langid.held_out()))
    assert model.languages == languages
    out = langid.identify(both, model).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {i: lang for i, (lang, _) in want.items()}
    assert all(abs(r.score - want[r.doc_id][1]) < 1e-5 for r in out)
    stay = langid.told(both, model)
    assert stay.columns == both.columns and sorted(r.doc_id for r in stay.collect()) == sorted(i for i, (lang, _) in want.items() if lang != "und")
