"""Operators on small literal inputs."""

import gzip
import json
import random

from pyspark.sql import Row, functions as F

from marginalia.functions import rank as R, text as T
from marginalia.operators import diff, graph, layout, match, retrieval, sinks, stats, timeline
from marginalia.sources import harvest
from marginalia.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scores_and_decisions(spark):
    raw = {"8: Accept": 8.0, "5": 5.0, "2 fair": 2.0, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in raw], "s string").select("s", T.parse_score(F.col("s")).alias("x"))
    assert {r.s: r.x for r in df.collect()} == raw
    cases = {("ICLR 2024 poster", ""): "accept-poster", ("Submitted to ICLR 2024", ""): "reject", ("ICLR Withdrawn Submission", ""): "withdrawn", ("ICLR Desk Rejected Submission", ""): "desk-reject", ("", "Accept (Poster)"): "accept-poster", ("", ""): "unknown"}
    df = spark.createDataFrame(list(cases), "v string, d string").select("v", "d", T.normalize_decision(F.col("v"), F.col("d")).alias("x"))
    assert {(r.v, r.d): r.x for r in df.collect()} == cases


def test_control_characters(spark):
    assert one(spark, T.clean_text(F.lit("ab\0cd\te\nf\r"))) == "abcd\te\nf"


def test_points(spark):
    three = "- The first point is long enough.\n- The second point is long enough.\n- The third point is long enough."
    assert len(one(spark, T.split_points(F.lit(three)))) == 3
    assert len(one(spark, T.split_points(F.lit("Short. This sentence is surely long enough. Tiny.")))) == 1
    body = "Pros: nice idea and good writing overall here.\nCons: the experiments are weak and the baselines are missing in all tables.\nQuestions: why?"
    section = one(spark, T.weakness_section(F.lit(body)))
    assert section.startswith("the experiments") and "Questions" not in section
    assert one(spark, T.weakness_section(F.lit("Cons: short"))) is None
    assert one(spark, T.weakness_section(F.lit("What follows has no heading at all, whatever letter it begins with."))) is None
    points = one(spark, T.review_points(F.lit("No heading here but a long sentence about it. Another one that is long enough."), F.lit("Is there a question that is long enough?"), F.lit(True)))
    assert [p.sentiment for p in points] == ["unknown", "unknown", "question"]


def test_citations_and_particles(spark):
    assert one(spark, T.citation_labels(F.lit("a [E2, M1] b [E9] c [E1]"), F.array(F.lit("E1"), F.lit("E2"), F.lit("M1")))) == ["E2", "M1", "E1"]
    assert one(spark, T.has_final_consonant(F.lit("한"))) and not one(spark, T.has_final_consonant(F.lit("하")))


def test_exact_tests(spark):
    p = one(spark, R.binomial_tail(F.lit(16), F.lit(20), F.lit(0.225)))
    assert p < 1e-6
    assert one(spark, R.binomial_tail(F.lit(2), F.lit(0), F.lit(0.5))) == 1.0
    assert abs(one(spark, R.binomial_tail(F.lit(9), F.lit(4), F.lit(0.5))) - 1 / 16) < 1e-9
    assert abs(one(spark, R.binomial_tail(F.lit(3), F.lit(4), F.lit(0.5))) - 5 / 16) < 1e-9
    assert abs(one(spark, R.fisher_lower(F.lit(0), F.lit(10), F.lit(10), F.lit(0))) - 1 / 184756) < 1e-9
    assert one(spark, R.fisher_lower(F.lit(0), F.lit(0), F.lit(1), F.lit(2))) == 1.0


def test_lift(spark):
    rows = [(i, "baselines", "weakness") for i in range(17)] + [(i, "reproducibility", "weakness") for i in range(12)] + [(i, "other", "weakness") for i in range(20)]
    points = spark.createDataFrame(rows, "paper_id long, aspect string, sentiment string")
    base = spark.createDataFrame([("baselines", 0.788), ("reproducibility", 0.225)], "aspect string, base_rate double")
    decisions = spark.createDataFrame([(i, "reject" if i < 12 else "accept-poster") for i in range(20)], "paper_id long, decision string")
    got = stats.aspect_patterns(points, base, decisions).collect()
    assert [r.aspect for r in got] == ["reproducibility", "baselines"]
    assert round(got[1].lift, 2) == 1.08 and not got[1].is_distinctive and got[0].is_distinctive
    assert (got[0].with_acc, got[0].with_n, got[0].without_acc, got[0].without_n) == (0, 12, 8, 8) and got[0].contrast_p < 0.01


def _fold(spark, ranked, fields, k):
    rows = [(i, n + 1, *fields.get(i, (None, "v", None))) for n, i in enumerate(ranked)]
    df = spark.createDataFrame(rows, "id long, position int, norm_title string, venue string, n_reviews int")
    return [r.id for r in retrieval.fold_duplicates(df, k).orderBy("slot").collect()]


def test_folding(spark):
    assert _fold(spark, [1, 2, 3], {1: ("t", "v", 3), 2: ("t", "v", 7), 3: ("u", "v", 4)}, 5) == [2, 3]
    assert _fold(spark, [1, 2], {1: ("t", "v", 3), 2: ("t", "w", 7)}, 5) == [1, 2]
    assert _fold(spark, [1, 2], {}, 5) == [1, 2]
    assert len(_fold(spark, [1, 2, 3], {1: ("a", "v", 1), 2: ("a", "v", 1), 3: ("b", "v", 1)}, 2)) == 2
    # past the row that would open slot k + 1 nothing competes any more
    assert _fold(spark, [1, 2, 3, 4], {1: ("a", "v", 1), 2: ("b", "v", 1), 3: ("c", "v", 1), 4: ("a", "v", 9)}, 2) == [1, 2]


def test_rerank_prefers_recent(spark):
    score = lambda year, rank, pct: one(spark, R.final_score(R.rrf(F.lit(rank)), F.lit(year), F.lit(2025), F.lit(pct).cast("double"), R.preset("balanced")))
    assert score(2020, 1, 0.5) < score(2025, 100, 0.5)
    assert score(2025, 1, None) > score(2025, 1, 0.0)


def test_confidence(spark):
    of = lambda cos: retrieval.confidence(spark.createDataFrame([(c, n + 1) for n, c in enumerate(cos)], "cosine double, vector_rank int")).first()
    assert of([0.9517, 0.9460, 0.9450, 0.9440, 0.9378]).level == "strong"
    assert of([0.915] * 5).level == "moderate" and of([0.96] * 5 + [0.1] * 50).level == "strong"
    assert (of([]).level, of([]).mean_cosine) == ("weak", 0.0)


def test_title_ties_do_not_match(spark):
    title = "A sufficiently long title of a paper"
    papers = spark.createDataFrame([Row(id=1, title=title, year=2024, surnames=["kim", "lee"])])
    external = [("a", ["kim"]), ("b", ["kim", "lee"]), ("c", ["ito"])]
    df = lambda rows: spark.createDataFrame([(i, title.upper(), 2024, s) for i, s in rows], "ext_id string, title string, created_year int, surnames array<string>")
    assert [r.ext_id for r in match.title_matches(papers, df(external)).collect()] == ["b"]
    assert match.title_matches(papers, df([("a", ["kim"]), ("b", ["lee"])])).count() == 0
    assert match.title_matches(papers, df([("c", ["ito"])])).count() == 0
    assert match.title_matches(papers, df([("d", [])])).count() == 1


def test_chain_with_cycle(spark):
    links = spark.createDataFrame([(8346, 174), (174, 27997), (1, 2), (2, 1)], "earlier long, later long")
    members = graph.reach(spark.createDataFrame([(174,), (1,)], "id long"), links).join(spark.createDataFrame([(8346, 2022), (174, 2023), (27997, 2023), (1, 2021), (2, 2020)], "id long, year int"), "id")
    got = graph.chain_order(members.select("root", "id", "year"), links).orderBy("root", "stop").collect()
    assert [r.id for r in got if r.root == 174] == [8346, 174, 27997]
    assert [r.id for r in got if r.root == 1] == [2, 1]


def test_outcomes(spark):
    rows = [(1, 1, "reject"), (1, 2, "accept-poster"), (2, 1, "reject"), (2, 2, "withdrawn"), (3, 1, "accept"), (3, 2, "reject"), (4, 1, "reject")]
    got = graph.outcome(spark.createDataFrame(rows, "root int, stop int, decision string")).collect()
    assert {r.root: r.outcome for r in got} == {1: "improved", 2: "still_rejected", 3: "mixed", 4: "single"}


def test_first_appearance_is_no_change(spark):
    f = lambda present, value=None: Row(present=present, value=value)
    rows = [(1, 1, f(True, "a")), (1, 2, f(False)), (1, 3, f(True, "b")), (1, 4, f(True, None))]
    edits = spark.createDataFrame(rows, "p int, n int, pdf struct<present: boolean, value: string>")
    got = timeline.field_changes(timeline.fold_edits(edits, "p", ["n"], ["pdf"]), "p", ["n"], ["pdf"]).orderBy("n").collect()
    assert [(r.n, r.old, r.new) for r in got] == [(3, "a", "b"), (4, "b", None)]


def test_word_diff():
    assert [s["op"] for s in diff.word_segments("use 16 heads", "use 14 heads", 400)] == ["equal", "delete", "insert", "equal"]


def test_greedy_match(spark):
    rows = spark.createDataFrame([("d", 1, 1, 0.9), ("d", 1, 2, 0.95), ("d", 2, 2, 0.94), ("d", 2, 1, 0.3)], "g string, left int, right int, score double")
    assert {(r.left, r.right) for r in diff.greedy_match(rows, "g", 0.2).collect()} == {(1, 2), (2, 1)}


def test_greedy_match_is_the_greedy_loop(spark):
    """Random scores with many ties, several groups, repeated rows, labels and numbers."""
    rng = random.Random(9)
    rows = [(f"g{i % 4}", f"a{rng.randint(0, 12)}", rng.randint(0, 12), rng.randint(0, 8) / 8, i) for i in range(500)] + [("x", "a", 1, None, 1), ("y", "a", 1, 0.1, 2)]
    want, used = set(), set()
    for g, a, b, s, _ in sorted((r for r in rows if r[3] is not None and r[3] >= 0.2), key=lambda r: (-r[3], r[1], r[2])):
        if (g, "l", a) not in used and (g, "r", b) not in used:
            used |= {(g, "l", a), (g, "r", b)}
            want.add((g, a, b, s))
    best = {}
    for r in rows:
        if r[3] is not None:
            best[r[:3]] = max(best.get(r[:3], 0.0), r[3])
    once = [(*k, s, "extra") for k, s in best.items()]
    got = diff.greedy_match(spark.createDataFrame([*once, *once], "g string, left string, right int, score double, more string"), "g", 0.2)
    assert sorted((r.g, r.left, r.right, r.score) for r in got.collect()) == sorted(want) and got.columns == ["g", "left", "right", "score", "more"]
    assert diff.greedy_match(got.limit(0), ["g"], 0.2).count() == 0


def test_components_of_random_graphs_and_chains(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(1000 + (i * 7) % 120, 1000 + ((i + 1) * 7) % 120) for i in range(119)] + [(5, 5), (2000, 2001), (2001, 2000)]
    low = {}
    find = lambda x: x if low.setdefault(x, x) == x else find(low[x])
    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "earlier long, later long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "earlier long, later long")).count() == 0


def test_upsert_is_idempotent(spark):
    new = spark.createDataFrame([("p1", "title", None), (None, "no id", None)], "k string, title string, emb string")
    old = spark.createDataFrame([("p1", "old", "vec")], "k string, title string, emb string")
    once = sinks.upsert(old, new, "k", keep=("emb",))
    assert [tuple(r) for r in sinks.upsert(once, new, "k", keep=("emb",)).collect()] == [("p1", "title", "vec")]


def test_replace_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_layout(spark):
    rows = [("d", p, n, 0.0, 10.0 * n, 50.0, 10.0 * n + 8, t) for p in range(1, 5) for n, t in enumerate(["Head", f"Body {p}", f"Table {p}: caption"])]
    blocks = spark.createDataFrame(rows, "doc_id string, page int, block_id int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r.text for r in layout.repeated_blocks(blocks).collect()] == ["Head"]
    assert layout.captions(blocks).count() == 4
    assert layout.merged_close(layout.without_repeated(blocks)).count() == 4
    assert layout.overlapping(blocks).count() == 0


def test_sources_and_streams(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "x", "n": 1}) + "\n\n" + json.dumps({"id": "y", "n": 2}) + "\n")
    assert harvest.json_lines(spark, str(tmp_path / "a.jsonl.gz")).count() == 2
    xml = "<record><identifier>1</identifier><title> A  b\n c</title><categories>cs.LG stat.ML</categories><keynames>Kim</keynames></record>"
    rows = spark.createDataFrame([(xml,), ("<record><identifier>2</identifier><deleted>1</deleted><title>x</title></record>",), ("<record><identifier>3</identifier></record>",)], "xml string")
    got = harvest.parsed_records(rows).collect()
    assert [(r.title, r.categories) for r in got] == [("A b c", ["cs.LG", "stat.ML"])]
    (tmp_path / "in").mkdir()
    run = lambda: ingest.ingest_new(spark, str(tmp_path / "in"), "id string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in" / "1.json").write_text('{"id": "a"}\n')
    run()
    (tmp_path / "in" / "2.json").write_text('{"id": "b"}\n')
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def fetch_page(offset, limit):
    return [(str(i), "{}") for i in range(offset, min(offset + limit, 25))]


def test_paged_notes(spark):
    spark.dataSource.register(harvest.PagedNotes)
    df = spark.read.format("paged_notes").options(fetch=f"{__name__}:fetch_page", total="25", limit="10").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 25


def test_fisher_takes_time_in_proportion(spark):
    """Each term comes from the one before: a table of 120,000 in seconds, where terms of their own take 20,000 x 60,000 steps."""
    import math
    import time

    a, b, c, d = 19900, 20100, 40100, 39900
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    want = sum(math.exp(log_choose(a + b, i) + log_choose(c + d, a + c - i) - log_choose(a + b + c + d, a + c)) for i in range(a + 1))
    table = spark.createDataFrame([(a, b, c, d)], "a long, b long, c long, d long")
    since = time.monotonic()
    got = table.select(R.fisher_lower(*map(F.col, "abcd")).alias("p")).first().p
    assert abs(got / want - 1) < 1e-6 and time.monotonic() - since < 60


def _rows_joined(df):
    """The most rows that a join of the executed plan gives."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, most = [plan], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        metrics = node.metrics()
        if "Join" in node.nodeName() and metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_copies_of_a_title_do_not_multiply(spark):
    """A title with 2000 papers and 2000 records: no join gives their product; ties and years count as before."""
    title = "A sufficiently long title of a paper"
    papers = spark.createDataFrame([(i, title, 2020 + i % 2, [["kim"], ["kim", "lee"], ["ito"]][i % 3]) for i in range(2000)] + [(3000, title, None, ["kim"])], "id long, title string, year int, surnames array<string>")
    external = [(i, title, 2022, ["kim"]) for i in range(2000)] + [(5000, title, 2021, ["kim", "lee"]), (5001, title, None, ["ito"]), (5002, title, 2030, ["ito"])]
    out = match.title_matches(papers, spark.createDataFrame(external, "ext_id long, title string, created_year int, surnames array<string>"))
    assert _rows_joined(out) <= 4003
    got = {r.paper_id: (r.ext_id, r.overlap) for r in out.collect()}
    want = {i: (5001, 1) if i % 3 == 2 else (5000, 2) if i % 3 == 1 else (5000, 1) for i in range(2000) if i % 3 or i % 2 == 0}
    assert got == want


def test_pages_of_notes_share_a_task(spark, tmp_path):
    """pages that follow each other are one partition's, and a landed folder gives each of its pages alone."""
    spark.dataSource.register(harvest.PagedNotes)
    df = spark.read.format("paged_notes").options(fetch=f"{__name__}:fetch_page", total="25", limit="10", pages="2").load()
    assert df.rdd.getNumPartitions() == 2 and sorted(int(r.id) for r in df.collect()) == list(range(25))

    from marginalia.queries import landed

    rows = spark.range(2500).select(F.col("id").cast("string").alias("id"), F.lit("{}").alias("content"), F.col("id").alias("n"), F.lit(0).alias("block"))
    rows.coalesce(1).write.option("parquet.block.row.count.limit", str(landed.NOTES)).partitionBy("block").parquet(str(tmp_path / "notes"))
    pages = [landed.note_page(offset, 1000, str(tmp_path / "notes")) for offset in (0, 1000, 2000, 3000, 100000)]
    assert [len(p) for p in pages] == [1000, 1000, 500, 0, 0] and pages[1][0] == ("1000", "{}")


def test_aspects_scan_a_text_once(spark):
    """one scan finds the first keyword of any aspect; before, each aspect scanned the whole text. What the keywords say stays."""
    import re

    from marginalia.functions import text as T

    texts = [None, "", "nothing", "Unclear. No baseline", "xbaseline", "a\nb typo\nImageNet", "only a\nfew cifar", "only a few cifar", "\u00e9theory proof", "why does it matter", "(SOTA) is not novel", "UNCLEAR HOW TO", "theory " * 9000 + "toy example", "q " * 60000 + "prior work"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", T.classify_aspect(F.col("t")).alias("a"))
    want = [next((a for a, ps in T.ASPECT_KEYWORDS if any(re.search(p, (t or "").lower(), re.A) for p in ps)), "other") for t in texts]
    got = {r.n: r.a for r in rows.collect()}
    assert [got[n] for n in range(len(texts)) if n != 8] == [w for n, w in enumerate(want) if n != 8]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
