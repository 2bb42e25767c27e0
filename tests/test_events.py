"""Timelines, journeys, percentiles, links, page layout and landed sources on small inputs."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.operators import graph, layout, match, retrieval, stats, timeline
from marginalia.sources import harvest

NOTE = "paper_id long, note_id string, submission_id string, invitations array<string>, signature string, tcdate long, cdate long, tmdate long, title string, body string, verdict string, rating_raw string"


def test_forum_events(spark):
    at = 1700000000000
    note = lambda i, inv, who, tc=at, cdate=None, tm=None, **x: (1, i, "s", [f"V/-/{k}" for k in inv], f"V/{who}", tc, cdate, tm, x.get("title"), x.get("body"), x.get("verdict"), x.get("raw"))
    rows = [
        note("s", ["Post_Submission"], "Authors"), note("x", ["Submission"], "Authors"), note("y", ["Edit"], "Authors"),
        note("r1", ["Official_Review"], "Reviewer_AA", raw="6: weak"), note("r2", ["Official_Review", "Edit"], "Reviewer_BB", tc=None, cdate=at + 5, tm=at + 9, raw="3"), note("r3", ["Official_Review"], "Reviewer_CC", tm=at),
        note("a", ["Official_Comment"], "Authors", body="b" * 4000), note("c", ["Public_Comment"], "Some_One", title="T"), note("m", ["Meta_Review"], "Area_Chair_1", body="so"), note("d", ["Decision"], "Program_Chairs", verdict="Reject"), note("e", ["Decision"], "Program_Chairs", tc=0),
    ]
    reviews = spark.createDataFrame([("r2", 8.0, "8: accept")], "note_id string, rating double, rating_raw string")
    revisions = spark.createDataFrame([(1, "v0", at, "최초 제출", True, ["a"]), (1, "v1", at + 1, "수정본", False, list("abcde")), (1, "v2", at + 2, "수정본", False, [])], "paper_id long, revision_id string, at long, kind_label string, is_baseline boolean, labels array<string>")
    out = {r.event_id: r for r in timeline.forum_events(spark.createDataFrame(rows, NOTE), reviews, revisions).collect()}
    assert set(out) == {"r1", "r2", "r2:update", "r3", "a", "c", "m", "d", "e", "v0", "v1", "v2"}
    say = {i: r.headline for i, r in out.items()}
    assert say["r1"] == "리뷰어 AA — 6: weak" and say["r2"] == "리뷰어 BB — 8: accept" and say["r3"] == "리뷰어 CC — 점수 미기재"
    assert say["r2:update"] == "리뷰어 BB가 저자 응답 이후 리뷰를 수정했습니다 (최종 8: accept) — 수정 전 내용은 공개되지 않습니다" and out["r2:update"].at == at + 9
    assert (say["a"], out["a"].kind, out["a"].kind_label, out["a"].text) == ("저자의 코멘트", "rebuttal", "저자 응답", "b" * 3000 + " …")
    assert (say["c"], out["c"].kind) == ("Some One: T", "comment") and (say["m"], out["m"].actor) == ("AC 총평", "AC")
    assert (say["d"], say["e"], out["e"].at, out["r2"].at) == ("최종 결과: Reject", "최종 결과: 결과 공개", 0, at + 5)
    assert say["v0"].startswith("관측") and say["v1"] == "수정본 — a, b, c, d" and say["v2"].endswith("변화가 없습니다")
    assert out["r1"].date == "2023-11-15 07:13" and [out[i].kind_order for i in ("r1", "r2:update", "a", "c", "v0", "m", "d")] == list(range(7))


def brute_reach(root, links, stop_at):
    both = defaultdict(set)
    for a, b in links:
        both[a].add(b)
        both[b].add(a)
    seen = {root}
    while stop_at is None or len(seen) < stop_at:
        more = seen | set().union(*(both[i] for i in seen))
        if more == seen:
            break
        seen = more
    return seen


def test_closure_with_and_without_the_cap(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(25)]
    ids = sorted({i for link in links for i in link} | {999})
    df = spark.createDataFrame(links, "earlier long, later long")
    for stop_at in (4, None):
        got = defaultdict(set)
        for r in graph.reach(spark.createDataFrame([(i,) for i in ids], "id long"), df, stop_at=stop_at, hops=40).collect():
            got[r.root].add(r.id)
        assert got == {i: brute_reach(i, links, stop_at) for i in ids}


def test_journeys(spark):
    stops = spark.createDataFrame([(1, 1, 1, "A", "reject"), (1, 2, 2, "B", "accept-oral"), (3, 1, 3, "A", "withdrawn"), (3, 2, 4, "B", "reject"), (5, 1, 5, "A", "accept"), (6, 1, 6, "A", "unknown"), (6, 2, 7, "B", "accept")], "root long, stop int, id long, venue string, decision string")
    links = spark.createDataFrame([(1, 2, "arxiv_id")], "earlier long, later long, method string")
    ratings = spark.createDataFrame([(2, 6.126, 4), (3, 5.0, 1)], "id long, avg_rating double, rating_count long")
    venues = spark.createDataFrame([("B", 5.0)], "venue string, rating_mean double")
    out = {(r.root, r.stop): r for r in graph.journeys(stops, links, ratings, venues).collect()}
    assert [out[k].outcome for k in [(1, 1), (3, 1), (5, 1), (6, 1)]] == ["improved", "still_rejected", "single", "mixed"]
    assert out[1, 2].message == "A에서 reject 뒤 B에 다시 내서 accept-oral됐습니다." and out[3, 1].message == "2번 투고했지만 아직 통과 기록이 없습니다 (A → B)."
    assert out[6, 2].message == "2번의 투고 기록이 있습니다 (A unknown → B accept)." and out[5, 1].message is None
    assert (out[1, 2].avg_rating, out[1, 2].rating_vs_venue, out[1, 2].method, out[1, 2].rating_count) == (6.13, 1.13, "arxiv_id", 4)
    assert (out[3, 1].rating_vs_venue, out[3, 2].method, out[3, 2].rating_count, out[3, 1].is_query, out[3, 2].is_query) == (None, None, 0, True, False)


def test_percentiles_count_values_first(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([2020, 2021, None]), rng.choice([None, 0, 0, 1, 2, 3])) for i in range(300)]
    out = stats.citation_percentile(spark.createDataFrame(rows, "id long, year int, citation_count long")).collect()
    known = [(y, c) for _, y, c in rows if c is not None]
    want = {i: None if c is None else sum(y2 == y and c2 <= c for y2, c2 in known) / sum(y2 == y for y2, _ in known) for i, y, c in rows}
    assert len(out) == 300 and all(r.percentile == pytest.approx(want[r.id]) if want[r.id] is not None else r.percentile is None for r in out)


def _linked(pairs):
    """The smallest id that each linked id reaches."""
    low = {}
    find = lambda x: x if low.setdefault(x, x) == x else find(low[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(low)}


def test_links_are_never_lost_with_the_size_of_a_key(spark):
    """Each paper keeps a link, whatever its key's size; hot keys give as many links as papers and venues ask for."""
    from marginalia.plans.enrichment import version_links

    for n in (999, 1000, 1001, 5000):
        papers = spark.range(n).selectExpr("id", "'x' AS ext_id", "cast(null AS string) AS norm_title", "CASE WHEN id % 7 = 0 THEN 'B' ELSE 'A' END AS venue", "cast(2020 + id % 2 AS int) AS year")
        links = [(r.earlier, r.later) for r in version_links(papers, "A").collect()]
        assert {x for link in links for x in link} == set(range(n)) and n - 1 <= len(links) <= 3 * n
        assert set(_linked(links).values()) == {0}


def test_link_stars_join_what_all_pairs_join(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", "", None, f"k{i}"]), rng.choice(["A", "B"]), rng.choice([2020, 2021])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, key string, venue string, year int")
    brute = {(a, b) for a, k, v, y in rows for b, j, w, z in rows if a < b and k and k == j and (v, y) != (w, z)}
    every = [(r.a, r.b) for r in match.pairs_by_key(df, "key", "m", 1.0, every=True).collect()]
    few = {(r.a, r.b) for r in match.pairs_by_key(df, "key", "m", 1.0).collect()}
    assert len(every) == len(brute) and set(every) == brute and few <= brute and _linked(few) == _linked(brute)


def test_duplicates_fold_up_to_the_slots(spark):
    rows = [(1, 1, "a", "v", 0), (2, 2, "b", "v", 5), (3, 3, "a", "v", 7), (4, 4, None, "v", 1), (5, 5, "b", "v", 9), (6, 6, "c", "v", 1), (7, 7, "a", "v", 99)]
    df = spark.createDataFrame(rows, "id long, position int, norm_title string, venue string, n_reviews int")
    assert sorted((r.slot, r.id) for r in retrieval.fold_duplicates(df, 3).collect()) == [(1, 3), (2, 5), (3, 4)]
    assert sorted((r.slot, r.id) for r in retrieval.fold_duplicates(df, 9).collect()) == [(1, 7), (2, 5), (3, 4), (4, 6)]


def test_blocks_merge_until_none_overlap(spark):
    schema = "doc_id string, page int, block_id int, x0 double, y0 double, x1 double, y1 double, text string"
    rows = [("d", 1, 1, 0.0, 0.0, 10.0, 10.0, "a"), ("d", 1, 2, 1.0, 1.0, 11.0, 10.0, "b"), ("d", 1, 3, 9.0, 1.0, 11.0, 10.0, "c"), ("d", 1, 4, 50.0, 50.0, 60.0, 60.0, "d"), ("d", 2, 5, 0.0, 0.0, 10.0, 10.0, "e")]
    out = {r.block_id: r for r in layout.merged_overlaps(spark.createDataFrame(rows, schema)).collect()}
    assert set(out) == {1, 4, 5} and out[1].text == "a\nb\nc" and (out[1].x1, out[1].y1) == (11.0, 10.0)


def token_page(part, token):
    start = int(token or 0)
    end = {"a": 25, "b": 10}[part]
    return [f"{part}{i}" for i in range(start, min(start + 10, end))], str(start + 10) if start + 10 < end else ""


def test_landed_sources(spark):
    spark.dataSource.register(harvest.TokenPages)
    load = lambda **x: spark.read.format("token_pages").options(fetch=f"{__name__}:token_page", **x).load()
    first = load(parts='{"a": "", "b": ""}', pages="2")
    assert sorted((r.part, r.page) for r in first.select("part", "page").distinct().collect()) == [("a", 0), ("a", 1), ("b", 0)]
    points = {r.part: r.next_token for r in harvest.resume_points(first).collect()}
    assert points == {"a": "20", "b": None}
    rest = load(parts=json.dumps({p: t for p, t in points.items() if t}))
    assert sorted(r.content for r in rest.collect()) == [f"a{i}" for i in range(20, 25)]
    feeds = [("q", "<feed><entry><id>http://x/abs/2401.01234v2</id><title> A\n  b </title></entry><entry><id>z</id></entry></feed>"), ("old", "<feed><entry><id>http://x/abs/solv-int/9901001v1</id><title>t</title></entry></feed>"), ("none", "<feed></feed>")]
    assert {tuple(r) for r in harvest.first_entries(spark.createDataFrame(feeds, "asked string, xml string")).collect()} == {("q", "2401.01234", "A b"), ("old", "solv-int/9901001", "t")}
    edits = spark.createDataFrame([("n", "e2", 5, "y"), ("n", "e1", None, "x"), ("m", "e3", 1, "z")], "note_id string, edit_id string, tcdate long, content string")
    papers = spark.createDataFrame([("n", "ICLR"), ("m", "OldConf"), ("k", "ICML")], "note_id string, conference string")
    assert {r.note_id: [e.edit_id for e in r.edits] for r in harvest.note_edits(edits, papers).collect()} == {"n": ["e1", "e2"], "m": [], "k": []}
    notes = spark.createDataFrame([("f", 1), ("g", 2)], "forum string, n int")
    assert harvest.forum_replies(notes, notes.filter(F.col("n") == 1)).count() == 1


def test_closure_writes_each_pair_once(spark, monkeypatch):
    """What the hops write is the result, not all that was reached so far again after each hop."""
    sizes, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: sizes.append((out := plain(df, name)).count()) or out)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "earlier long, later long")
    assert graph.reach(spark.range(41), links).count() == sum(sizes)


def test_whole_journeys_are_those_of_the_steps(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40), m) for m in ("arxiv_id", "title_exact") for _ in range(25)}
    links = spark.createDataFrame(sorted(p for p in pairs if p[0] != p[1]), "earlier long, later long, method string")
    papers = spark.createDataFrame([(i, 2020 + rng.randrange(3), rng.choice("AB"), rng.choice(["reject", "accept", None])) for i in range(44)], "id long, year int, venue string, decision string")
    ratings = spark.createDataFrame([(i, rng.random() * 9, i) for i in range(0, 44, 3)], "id long, avg_rating double, rating_count long")
    venues = spark.createDataFrame([("B", 5.0)], "venue string, rating_mean double")
    members = graph.reach(papers.select("id"), links).cache()
    wide = members.join(papers, "id")
    order = graph.chain_order(wide.select("root", "id", "year"), links.select("earlier", "later").distinct())
    want = graph.journeys(order.join(wide, ["root", "id"]), links, ratings, venues)
    got = graph.whole_journeys(members, papers, links, ratings, venues)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_journeys_of_parts_are_those_of_the_whole_closure(spark):
    rng = random.Random(6)
    pairs = {(i, i + 1, "arxiv_id") for i in range(50, 80)} | {(rng.randrange(40), rng.randrange(40), m) for m in ("arxiv_id", "title_exact") for _ in range(25)}
    links = spark.createDataFrame(sorted(p for p in pairs if p[0] != p[1]), "earlier long, later long, method string")
    papers = spark.createDataFrame([(i, 2020 + rng.randrange(3), rng.choice("AB"), rng.choice(["reject", "accept", None])) for i in range(90)], "id long, year int, venue string, decision string")
    ratings = spark.createDataFrame([(i, rng.random() * 9, i) for i in range(0, 90, 3)], "id long, avg_rating double, rating_count long")
    venues = spark.createDataFrame([("B", 5.0)], "venue string, rating_mean double")
    want = graph.whole_journeys(graph.reach(papers.select("id"), links, stop_at=None, hops=90), papers, links, ratings, venues)
    part = graph.components(links).withColumnRenamed("root", "part")
    named = links.join(part.withColumnRenamed("id", "earlier"), "earlier")
    rated = papers.join(part, "id", "left").withColumn("part", F.coalesce("part", "id")).join(ratings, "id", "left")
    got = graph.part_journeys(rated, named, venues)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_submission_journeys_have_all_stops_of_a_long_chain(spark, tmp_path):
    """each of 30 orders of a customer has all 30 as its stops; before, the 12 nearest on either side at most. Orders of no customer are a chain as well."""
    from marginalia.queries import QUERIES

    orders = [(i, {0: 7, 1: None}.get(i // 30, i), "FOP"[i % 3], 10.0, "2-HIGH") for i in range(66)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").withColumn("o_orderdate", F.timestamp_seconds(F.col("o_orderkey") * 9000000)).write.parquet(str(tmp_path / "orders.parquet"))
    lines = spark.createDataFrame([(i, 1, float(i), "N", 1) for i in range(0, 66, 2)], "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_suppkey long")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = defaultdict(list)
    for r in sorted(QUERIES["submission_journeys"](spark, str(tmp_path)).collect(), key=lambda r: (r.root, r.stop)):
        out[r.root].append((r.stop, r.id, r.method, r.is_query, r.avg_rating, r.message))
    chain = lambda ids, root: [(n + 1, i, "arxiv_id" if n else None, i == root, float(i) if i % 2 == 0 else None) for n, i in enumerate(ids)]
    for root in range(66):
        ids = range(root // 30 * 30, root // 30 * 30 + 30) if root < 60 else [root]
        assert [x[:5] for x in out[root]] == chain(ids, root)
    assert out[3][0][5].startswith("30번의 투고 기록") and out[3][0][5].count("→") == 29 and len(out) == 66


def test_submission_journeys_shuffle_papers_not_stops_of_roots(spark):
    """one shuffle of papers by customer and one of venues are left behind the ratings; before, all stops of all roots were shuffled by id and by root."""
    from marginalia import tables as tb
    from marginalia.queries import QUERIES, matching

    sf = "/root/testdata/sf0.001"
    plan = QUERIES["submission_journeys"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan[: plan.rindex("Generate ")]
    ids = tb.papers(spark, sf).groupBy("author_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    made = ids.select(F.inline(matching._next_links(F.col("ids")))).select("earlier", "later", "method")
    assert sorted(made.collect()) == sorted(matching._chain_links(spark, sf).select("earlier", "later", "method").collect())


def test_pages_of_a_block_share_a_folder_and_a_task(spark, tmp_path):
    """1100 pages are three folders and three tasks, each page once and in its place, stopped in the midst of a block."""
    root = str(tmp_path / "pages")
    harvest.land_pages(spark.range(1100).select(F.lit("a").alias("s"), "id", F.concat(F.lit("<r>"), F.col("id").cast("string"), F.lit("</r>")).alias("x")), root, "s", "id", "x", 1)
    assert sorted(p.name for p in (tmp_path / "pages" / "part=a").iterdir()) == ["block=0", "block=1", "block=2"]
    options = {"root": root, "parts": '["a", "none"]', "pages": "3"}
    reader = harvest._HarvestReader(options)
    end = reader.latestOffset()
    assert end == {"a": ["3", 3], "none": ["0", 0]}
    reader.partitions(reader.initialOffset(), end)
    again = harvest._HarvestReader({**options, "pages": "0"})
    again.at = end
    last = again.latestOffset()
    tasks = again.partitions(end, last)
    assert last["a"] == ["", 1100] and len(tasks) == 3
    got = [row for t in tasks for row in again.read(t)]
    assert got == [("a", n, f"<page><r>{n}</r></page>") for n in range(3, 1100)]
