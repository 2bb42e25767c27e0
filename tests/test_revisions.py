"""Bodies of two versions: what is equal, moved, changed and renumbered."""

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import diff, revisions

A = "The first paragraph says what the paper is about and why."
B = "A second paragraph describes the method in a good many words."
C = "The third one lists experiments on three data sets and more."
D = "Nothing here resembles any of it: qux vlorp zint brak dnom wuf."


def bodies(spark, *pairs, renumbered=()):
    df = spark.createDataFrame([(i, "\n\n".join(a), "\n\n".join(b)) for i, (a, b) in enumerate(pairs)], "pair long, before string, after string")
    names = spark.createDataFrame(list(renumbered), "pair long, before_label string, after_label string")
    out = {i: [] for i in range(len(pairs))}
    for r in revisions.body_segments(df, names).orderBy("pair", "n").collect():
        out[r.pair].append((r.op, r.text.strip()))
    return out


def after_of(segments):
    return " ".join(t for op, t in segments if op != "delete").split()


def test_paragraphs(spark):
    short = "Too short to move"
    out = bodies(
        spark, ([A, B, C], [A, B, C]), ([A, B, C], [B, C, A]), ([A, B], [A, B.replace("good", "great")]), ([A, B], [A, D]),
        ([short, A, B, C], [A, B, C, short]), ([A, B, C], [B + " And a tail.", D, A.replace("why", "how"), C]), ([], [A]), ([A], []),
    )
    assert out[0] == [("equal", A), ("equal", B), ("equal", C)]
    assert sorted(out[1]) == sorted([("moved", A), ("equal", B), ("equal", C)]) and out[1][-1] == ("moved", A)
    assert out[2][0] == ("equal", A) and ("delete", "good") in out[2] and ("insert", "great") in out[2]
    assert out[3] == [("equal", A), ("delete", B), ("insert", D)]
    assert out[4] == [("delete", short), ("equal", A), ("equal", B), ("equal", C), ("insert", short)]
    assert ("insert", "And a tail.") in out[5] and ("insert", "how.") in out[5] and ("insert", D) in out[5]
    assert after_of(out[5]) == " ".join([B + " And a tail.", D, A.replace("why", "how"), C]).split()
    assert out[6] == [("insert", A)] and out[7] == [("delete", A)]


def test_a_phrase_that_a_first_pass_sets_free(spark):
    """A paragraph takes over the end of the next one: once its words are compared, that end is found to have moved."""
    tail = "the diffusion based generator makes all of its predictions in one pass"
    out = bodies(spark, ([A + " " + D, D + " " + B, tail, C], [C, A + " " + D + " " + tail, "Something quite other stands here: " + "zz " * 9]))
    assert ("moved", tail) in out[0] and ("delete", tail) not in out[0]


def test_media_inside_replaced_paragraphs():
    f = "(그림 1)"
    got = revisions.media_segments([A + " " + B], [A, f, B])
    assert [(s["op"], s["text"]) for s in got] == [("moved", A + "\n\n"), ("insert", f + "\n\n"), ("moved", B + "\n\n")]
    got = revisions.media_segments([A, f], [f, A.replace("first", "last")])
    assert [(s["op"], s["text"].strip()) for s in got] == [("insert", f), ("equal", "The"), ("delete", "first"), ("insert", "last"), ("equal", " ".join(A.split()[2:])), ("delete", f)]
    assert [s["op"] for s in revisions.media_segments([f], ["(표 2)"])] == ["delete", "insert"]


def test_media_move_and_change_numbers(spark):
    f = [f"(그림 {i})" for i in range(10)]
    out = bodies(
        spark, ([f[1], A, B, C], [A, B, C, f[1]]), ([A, f[5], B, f[6], C, f[7]], [A, f[5], B, f[6], C, f[7]]), ([A, f[4], B, f[5], C], [A, f[4], B, C]),
        renumbered=[(1, "Figure 5", "Figure 7"), (1, "Figure 6", "Figure 5"), (1, "Figure 7", "Figure 6"), (2, "Figure 5", "Figure 4")],
    )
    assert out[0] == [("equal", A), ("equal", B), ("equal", C), ("moved", f[1])]
    assert out[1] == [("equal", A), ("moved", f[5]), ("equal", B), ("moved", f[6]), ("equal", C), ("moved", f[7])]
    assert sorted(out[2]) == sorted([("equal", A), ("delete", f[4]), ("moved", f[4]), ("equal", B), ("equal", C)])


MEDIA = "pair long, label string, caption string, content string, signature array<int>, bytes int"


def test_matched_media(spark):
    before = [(1, "Figure 5", "failure cases of the method", None, [], 1), (1, "Figure 6", "comparison with the baselines", None, [], 1), (1, "Figure 8", "", None, [0, 0, 0, 9], 1), (1, "Table 1", "short", None, [200, 0], 1), (1, "Box aa", None, "prompt: answer the question now", [], 5), (1, "Box cc", None, "same", [], 5), (1, "Equation 1", None, None, [], 1), (1, "Equation 2", None, None, [], 1), (2, "Figure 1", "failure cases of the method", None, [], 1)]
    after = [(1, "Figure 5", "comparison with the baselines", None, [], 1), (1, "Figure 7", "failure cases of the method", None, [], 1), (1, "Figure 9", "", None, [0, 0, 0, 8], 1), (1, "Table 1", "other", None, [0, 200], 1), (1, "Box bb", None, "prompt: answer the question here", [], 9), (1, "Box cc", None, "same", [], 5), (1, "Equation 1", None, None, [], 1), (1, "Equation 3", None, None, [], 1)]
    a, b = (spark.createDataFrame(x, MEDIA) for x in (before, after))
    matched = revisions.matched_media(a, b)
    assert {(r.before_label, r.after_label) for r in matched.collect()} == {("Figure 5", "Figure 7"), ("Figure 6", "Figure 5"), ("Figure 8", "Figure 9"), ("Table 1", "Table 1"), ("Box aa", "Box bb"), ("Box cc", "Box cc"), ("Equation 1", "Equation 1")}
    shown = {(r.pair, r.label, r.after_label, r.in_before, r.in_after) for r in revisions.media_changes(a, b, matched).collect()}
    assert (1, "Equation 2", None, True, False) in shown and (1, "Equation 3", None, False, True) in shown and (1, "Table 1", None, True, True) in shown and (2, "Figure 1", None, True, False) in shown
    assert len(shown) == 10


def test_bodies_are_put_behind_their_files(spark):
    changes = [(1, 0, 0, "title", "text", "t", None, None), (1, 1, 0, "title", "text", "t", None, None), (1, 1, 1, "pdf", "file", "PDF", "u1", "u2"), (1, 1, 2, "code", "file", "c", "x", "y"), (1, 2, 0, "pdf", "file", "PDF", "u2", "u3"), (2, 0, 0, "pdf", "file", "PDF", None, "u1"), (2, 1, 0, "pdf", "file", "PDF", "u1", "u2")]
    c = spark.createDataFrame(changes, "paper_id long, revision int, change_no int, field string, kind string, label string, before_url string, after_url string")
    versions = spark.createDataFrame([("u1", f"{A}\n\n(그림 1)"), ("u2", f"(그림 2)\n\n{A}"), ("u3", None)], "url string, text string")
    media = spark.createDataFrame([("u1", "Figure 1", "an overview of it all"), ("u2", "Figure 2", "an overview of it all"), ("u2", "Figure 10", None)], "url string, label string, caption string")
    media = media.selectExpr("*", "CAST(NULL AS STRING) AS content", "CAST(array() AS array<int>) AS signature", "1 AS bytes")
    rows = revisions.body_changes(c, versions, media).orderBy("paper_id", "revision", "place").collect()
    got = [(r.paper_id, r.revision, r.field, r.label, r.after_label) for r in rows]
    mine = lambda p: [(p, 1, "body", "본문", None), (p, 1, "figure", "Figure 1", "Figure 2"), (p, 1, "figure", "Figure 10", None)]
    assert got == [(1, 0, "title", "t", None), (1, 0, "body", "본문", None), (1, 1, "title", "t", None), (1, 1, "pdf", "PDF", None), *mine(1), (1, 1, "code", "c", None), (1, 2, "pdf", "PDF", None), (2, 0, "pdf", "PDF", None), (2, 0, "body", "본문", None), (2, 1, "pdf", "PDF", None), *mine(2)]
    base, body = (next(r for r in rows if r.revision == n and r.field == "body") for n in (0, 1))
    assert [(s.op, s.text) for s in base.segments] == [("equal", A + "\n\n"), ("equal", "(그림 1)\n\n")]
    assert [(s.op, s.text) for s in body.segments] == [("moved", "(그림 2)\n\n"), ("equal", A + "\n\n")]


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    strings = lambda *x: F.array(*map(F.lit, x))
    assert one(T.stitched(strings("ends within our", "dataset from it.", "Next", "one more", "and more", "(그림 1)", "lower", "(표 2)", "x"))) == ["ends within our dataset from it.", "Next one more", "and more", "(그림 1)", "lower", "(표 2)", "x"]
    assert one(T.stitched(F.array().cast("array<string>"))) == []
    assert [one(T.label_placeholder(F.lit(x))) for x in ("Figure 2", "Box a1f", "Section 2", "Figure")] == ["(그림 2)", "(박스 a1f)", None, None]
    assert one(T.flatten_block(F.lit(" opera-\n tor of\n  it \n"))) == "operator of it"
    assert [one(T.actor_name(F.lit(x))) for x in ("a/Authors", "a/Reviewer_AHeX", "a/Area_Chair_1", "a/Program_Chairs", "a/Some_One", "", None)] == ["저자", "리뷰어 AHeX", "AC", "PC", "Some One", "익명", "익명"]
    assert one(T.with_particle(F.lit("수정 2회"), "이", "가")) == "수정 2회가" and one(T.with_particle(F.lit("응답 1건"), "이", "가")) == "응답 1건이"


def test_words_keep_breaks():
    assert diff.word_segments("a b\n\nc d", "a b\n\nc e", 9, True) == [{"op": "equal", "text": "a b\n\nc"}, {"op": "delete", "text": "d"}, {"op": "insert", "text": "e"}]


def test_segments_of_a_batch_are_not_all_dicts_at_once(monkeypatch):
    """a batch's segments become Arrow's piece by piece; before, those of all its rows were dicts."""
    import pyarrow as pa

    from marginalia.operators import diff

    held, most = [], []
    real = pa.array
    monkeypatch.setattr(diff.pa, "array", lambda rows, kind: (most.append(len(rows)), real(rows, kind))[1])
    words = [None, "", *(f"a {n} b" for n in range(998))]
    got = diff.in_pieces(lambda x, y: held.append(x) or diff.word_segments(x, y, 400), real(words), real(words[1:] + ["c"]), diff.segments_type())
    assert max(most) <= diff.PIECE and held == words
    assert got.to_pylist() == [diff.word_segments(x, y, 400) for x, y in zip(words, words[1:] + ["c"], strict=True)]
    assert diff.in_pieces(None, real([], pa.string()), real([], pa.string()), diff.segments_type()).to_pylist() == []


def test_only_texts_without_an_equal_one_are_compared_by_letters(spark, monkeypatch):
    """equal texts are matched by a grouping; before, each was compared by letters with all others of its pair, in a task or two."""
    import difflib
    import random

    rng = random.Random(14)
    parts, seen = [" ".join(rng.choices("model data loss graph proof bound layer token".split(), k=7)) for _ in range(6)], []
    parts += [p + " more" for p in parts[:3]]
    rows = [(pair, [n, 0], rng.choice(["delete", "insert"]), rng.choice(parts)) for pair in range(4) for n in range(14)]
    real = revisions.written
    monkeypatch.setattr(revisions, "written", lambda df, name: (seen.append((name, df.rdd.getNumPartitions(), df.count())), real(df, name))[1])
    fit = spark.createDataFrame(rows, "pair long, pos array<int>, op string, text string").withColumn("bare", F.col("text")).withColumn("fresh", F.lit(True))
    got = {(r.pair, *r.gone, *r.pos, r.old, r.new, r.kept) for r in revisions._matched_paragraphs(fit).collect()}
    want, left = set(), 0
    for pair in range(4):
        old, new = ([(pos, text) for p, pos, o, text in rows if p == pair and o == op] for op in ("delete", "insert"))
        near = sorted((-difflib.SequenceMatcher(None, a, b).ratio(), i, j, a, b) for i, a in old for j, b in new)
        gone, come = [], []
        for score, i, j, a, b in near:
            if -score >= revisions.MOVE_RATIO and i not in gone and j not in come:
                gone.append(i), come.append(j)
                want.add((pair, *i, *j, a, b, b))
        equal = sum(a == b for p, *_, a, b, _ in want if p == pair)
        left += (len(old) - equal) * (len(new) - equal)
    assert got == want and any(r[5] != r[6] for r in want) and any(r[5] == r[6] for r in want)
    tasks, compared = next(x[1:] for x in seen if x[0] == "scores")
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions")) and compared <= left


def test_all_segments_of_a_long_turn_are_there(spark, tmp_path):
    """a turn of which every second word changes has a segment for each; before, 400 at most."""
    from marginalia.queries import QUERIES

    before, after = ([f"{'same' if n % 2 == 0 else side}{n}" for n in range(800)] for side in ("old", "new"))
    turns = [(1, 0, "user", " ".join(before)), (1, 1, "assistant", " ".join(after)), (1, 2, "user", " ".join(after))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: (r.word_segments, r.kept_segments, r.paragraph_segments, r.ratio) for r in QUERIES["turn_diffs"](spark, str(tmp_path)).collect()}
    assert got == {0: (1200, 1200, 2, 0.5), 1: (1, 1, 1, 1.0)}  # as one paragraph the two are not alike, so it goes and comes whole
    assert len(diff.word_segments(" ".join(before), " ".join(after))) == 1200


def test_all_segments_of_a_long_body_are_there(spark):
    """a body has all its segments; before, 2000 at most, and 400 of paragraphs among which media stand."""
    before, after = ([f"{side if n % 2 else 'same'} {n}" for n in range(2000)] for side in ("old", "new"))
    words, other = ([side if n % 2 else f"{side}{n}" for n in range(1000)] for side in ("was", "now"))
    words, other = ([f"w{n}" if n % 2 else w for n, w in enumerate(x)] for x in (words, other))
    out = bodies(spark, (before, after), (["(그림 1)", " ".join(words)], [" ".join(other), "(표 2)"]))
    assert len(out[0]) == 3500 and after_of(out[0]) == " ".join(after).split()  # from 1000 on, old and new are alike by letters and share a number
    assert len(out[1]) == 1502 and after_of(out[1])[:1000] == other
    assert [t for op, t in out[1] if op == "equal"] == words[1::2]


def test_moved_paragraphs_go_on_until_none_is_left(spark):
    """each pass sets a phrase free that the next one finds elsewhere, eight times; before, five passes at most. Texts alike by letters alone end it."""
    block = [" ".join(chr(ord("a") + k) * n for n in range(3, 10)) for k in range(10)]
    before = [block[0], *(f"{block[k]} {block[k + 1]}" for k in (1, 3, 5, 7))]
    after = [f"{block[0]} {block[1]}", *(f"{block[k]} {block[k + 1]}" for k in (2, 4, 6))]
    near = [" ".join(f"{w}{end}" for w in "abcdefghij klmnopqrst uvwxyzabcd efghijklmn opqrstuvwx yzabcdefgh".split()) for end in "12"]
    out = bodies(spark, (before, after), ([A, near[0], "gone"], [near[1], "here", A]))
    assert [x for x in out[0] if x[0] != "equal"] == [("delete", block[8])]
    assert after_of(out[0]) == " ".join(after).split()
    assert sorted(x for x in out[1] if x[1] in near) == [("delete", near[0]), ("insert", near[1])] and after_of(out[1]) == " ".join([near[1], "here", A]).split()


def test_conversations_of_over_a_thousand_turns_are_whole_versions(spark, tmp_path):
    """the versions of body_versions hold all turns; before, the first 1002."""
    from marginalia.queries import textual

    spark.range(1100).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat('turn ', id) AS text").write.parquet(str(tmp_path / "conversations.parquet"))
    _, versions, _ = textual._versions(spark, str(tmp_path))
    assert all(r.text.count("turn ") == 1100 and "turn 1099" in r.text for r in versions.collect())
