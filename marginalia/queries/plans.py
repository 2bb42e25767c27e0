"""Queries of whole analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia import tables as tb
from marginalia.operators import retrieval
from marginalia.plans import neighbours, story
from marginalia.queries.registry import query
from marginalia.session import written


@query("""WITH s AS (SELECT s_suppkey AS id, 't' || (s_suppkey % 997) AS title FROM supplier),
  h AS (SELECT l_suppkey AS sample_id, l_orderkey AS paper_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
  r AS (SELECT sample_id, paper_id, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, paper_id) AS rank FROM h),
  b AS (SELECT id AS sample_id, id AS paper_id FROM s UNION SELECT o_custkey, o_orderkey FROM orders UNION SELECT o_orderkey, o_custkey FROM orders
    UNION SELECT s.id, o_orderkey FROM s JOIN orders ON lower('T' || (o_orderkey % 997)) = lower(title))
  SELECT sample_id, paper_id, row_number() OVER (PARTITION BY sample_id ORDER BY rank) AS position FROM r ANTI JOIN b USING (sample_id, paper_id) WHERE rank <= 60 QUALIFY position <= 50""")
def neighbours_without_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 hits of a search with a margin, without the sample, its links and its titles."""
    samples = tb.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.concat(F.lit("t"), (F.col("s_suppkey") % 997).cast("string")).alias("title"))
    orders = tb.read(spark, sf, "orders")
    papers = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 997).cast("string")).alias("title"))
    hits = tb.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_orderkey").alias("paper_id")).agg(F.max("l_extendedprice").alias("score"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "paper_id")))
    hits = written(hits.filter(F.col("rank") <= 50 + neighbours.MARGIN), "hits")
    banned = neighbours.leaks(samples, orders.select(F.col("o_custkey").alias("earlier"), F.col("o_orderkey").alias("later")), papers, hits)
    return neighbours.clean_neighbours(hits, banned, 50)


@query("""WITH e AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M') AS stamp, event_type, value FROM events),
  r AS (SELECT user_id, '저자 응답 ' || count(*) || '건' AS n FROM e WHERE event_type = 'purchase' GROUP BY 1),
  v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY stamp, event_id) AS k, substr(stamp, 1, 10) || ' ' || event_type ||
    CASE event_id % 3 WHEN 0 THEN ' ' || round_even((1 - value / 1000) * 100, 0)::INT || '% 변경' WHEN 1 THEN ' 교체' ELSE ' 변경' END || ', pdf 변경' AS item FROM e WHERE event_type <> 'purchase' AND event_id % 10 <> 0),
  l AS (SELECT user_id, list(item ORDER BY k) AS items FROM v WHERE k <= 6 GROUP BY 1)
  SELECT user_id AS paper_id, array_to_string(list_concat(CASE WHEN n IS NULL THEN [] ELSE [n] END, coalesce(items, []))[1:6], '; ') AS items FROM r FULL JOIN l USING (user_id)""")
def changed_by_authors(spark: SparkSession, sf: str) -> DataFrame:
    """Rebuttals and revisions of each paper in words, six at most."""
    e, k = tb.read(spark, sf, "events"), F.col("event_id") % 3
    none = F.lit(None)
    change = lambda kind, label, after, similarity: F.struct(kind.alias("kind"), label.alias("label"), after.cast("string").alias("after"), similarity.cast("double").alias("similarity"))
    first = change(F.when(k == 1, "file").otherwise("text"), F.col("event_type"), F.lit("교체"), F.when(k == 0, F.col("value") / 1000))
    kind = F.when(F.col("event_type") == "purchase", "rebuttal").otherwise("author_revision")
    rows = e.select(F.col("user_id").alias("paper_id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 10 == 0).alias("is_baseline"), F.array(first, change(F.lit("text"), F.lit("pdf"), none, none)).alias("changes"))
    return story.changed_items(rows).select("paper_id", F.array_join("items", "; ").alias("items"))


_ASKED = """n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value > 300) AS r, count(*) FILTER (WHERE event_type = 'view' AND value > 450) AS v FROM events GROUP BY 1)"""


@query(f"""WITH {_ASKED}, d AS (SELECT *, array_to_string(list_filter(['저자 응답 ' || nullif(r, 0) || '건', '저자 수정 ' || nullif(v, 0) || '회'], lambda x: x IS NOT NULL), ' · ') AS did FROM n),
  s AS (SELECT *, did || CASE WHEN v > 0 THEN '가' ELSE '이' END AS done, CASE WHEN user_id % 3 > 0 THEN 'clarity' END AS topic FROM d)
  SELECT user_id AS paper_id, CASE WHEN topic IS NOT NULL AND did <> '' THEN 'clarity 등을 지적받았고, ' || done || ' 있었습니다.' WHEN topic IS NOT NULL THEN 'clarity 등을 지적받았고, 공개된 저자 대응 기록은 없습니다.' WHEN did <> '' THEN done || ' 기록돼 있습니다.' ELSE '공개된 리뷰 지적 항목이 없습니다.' END AS headline,
  CASE WHEN user_id % 2 = 0 THEN 'm' ELSE '이 투고의 결과는 reject입니다.' END AS note FROM s""")
def story_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """A paper's story in a sentence: what was criticised, how often its authors answered and revised, its outcome."""
    e = tb.read(spark, sf, "events")
    count = lambda kind, least: F.count_if((F.col("event_type") == kind) & (F.col("value") > least))
    n = e.groupBy("user_id").agg(count("purchase", 300).alias("r"), count("view", 450).alias("v"))
    topic = F.when(F.col("user_id") % 3 > 0, "clarity")
    note = story.outcome_note(F.lit("reject"), F.when(F.col("user_id") % 2 == 0, "m"))
    return n.select(F.col("user_id").alias("paper_id"), story.headline(topic, F.col("r"), F.col("v")).alias("headline"), note.alias("note"))


@query("""WITH q AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN 'recent' WHEN 1 THEN 'cited' WHEN 2 THEN 'other' END AS focus FROM customer), f AS (SELECT o_orderkey AS id, year(o_orderdate) AS year, (o_orderkey % 10) / 10.0::DOUBLE AS pct FROM orders),
  c AS (SELECT o_custkey AS query_id, o_orderkey AS id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS rrf FROM orders),
  w(focus, s, r, t, h) AS (VALUES ('balanced', 0.35::DOUBLE, 0.45::DOUBLE, 0.2::DOUBLE, 3.0::DOUBLE), ('recent', 0.3, 0.5, 0.2, 2.0), ('cited', 0.3, 0.45, 0.25, 4.0)),
  x AS (SELECT c.query_id, c.id, round(s * least(rrf / (2 / 61.0::DOUBLE), 1.0) + r * 0.5::DOUBLE ** (((SELECT max(year) FROM f) - year) / h) + t * pct, 9) AS score FROM c JOIN q USING (query_id) JOIN f USING (id) JOIN w ON w.focus = CASE WHEN q.focus IN ('recent', 'cited') THEN q.focus ELSE 'balanced' END),
  p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM x),
  l AS (SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY position) FILTER (WHERE position <= 3) AS candidates, string_agg('E' || position, ',' ORDER BY position) FILTER (WHERE position <= 2) AS citations FROM p GROUP BY 1)
  SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'weak' ELSE 'strong' END AS level, coalesce(candidates, '') AS candidates, coalesce(citations, '') AS citations FROM q LEFT JOIN l USING (query_id)""")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A report for each query, its candidates ranked by the query's own preference, with the citations of its summary."""
    c, o = tb.read(spark, sf, "customer"), tb.read(spark, sf, "orders")
    k = F.col("c_custkey")
    queries = c.select(k.alias("query_id"), F.col("c_name").alias("title"), F.lit("").alias("abstract"), F.when(k % 4 == 0, "recent").when(k % 4 == 1, "cited").when(k % 4 == 2, "other").alias("focus"))
    fields = o.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), ((F.col("o_orderkey") % 10) / 10.0).alias("percentile"))
    found = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), (1.0 / (60 + F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))).alias("rrf"))
    ranked = retrieval.rerank_preferred(found, fields, fields.agg(F.max("year").alias("max_year")), queries)
    candidates = ranked.filter("position <= 3").select("query_id", F.col("position").alias("rank"), F.col("id").alias("paper_id"), F.lit("both").alias("match_type"))
    selected = candidates.select("query_id", F.col("rank").alias("llm_rank"), "paper_id", F.lit("").alias("reason"))
    evidence = candidates.select("query_id", F.concat(F.lit("E"), F.col("rank").cast("string")).alias("label"), "paper_id", F.lit("text").alias("text"))
    confidence = queries.filter("query_id % 5 <> 0").select("query_id", F.lit("strong").alias("level"), F.lit(0.95).alias("mean_cosine"))
    summaries = queries.select("query_id", F.lit("It says so [E1, E2], and [E9] or [M1].").alias("summary"))
    out = story.reports(queries, confidence, candidates, selected, evidence, summaries)
    return out.select("query_id", "level", F.array_join(F.transform("candidates", lambda x: x["paper_id"].cast("string")), ",").alias("candidates"), F.array_join("citations", ",").alias("citations"))


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
  SELECT conv_id AS paper_id, count(*)::INT AS n, md5(string_agg(substr(text, 1, 1200), '|' ORDER BY k)) AS texts FROM r WHERE k <= 6 GROUP BY 1""")
def narrative_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of a paper that a writer is given, six of 1200 characters at most (the feature)."""
    c = tb.read(spark, sf, "conversations").select(F.col("conv_id").alias("paper_id"), "turn", "text")
    out = story.capped_texts(c, ["turn"])
    return out.select("paper_id", F.size("texts").alias("n"), F.md5(F.array_join("texts", "|")).alias("texts"))


@query(f"""WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1), s AS (SELECT conv_id, turns, conv_id % 4 AS v, conv_id % 10 AS k FROM c)
  SELECT conv_id AS paper_id, v < 3 AND k NOT IN (3, 7, 9) AS supported, CASE WHEN v < 3 AND k NOT IN (3, 7, 9) THEN CASE WHEN k = 1 THEN 0 ELSE turns END END::INT AS replies,
  CASE WHEN v = 3 THEN replace('{story.NO_HISTORY}', '{{}}', 'V3') WHEN k IN (3, 7, 9) THEN replace('{story.NOT_READ}', '{{}}', CASE k WHEN 3 THEN 'JSONDecodeError' WHEN 7 THEN 'NotFound' ELSE 'Timeout' END)
    ELSE '{story.FINAL_REVIEWS}' || '|' || CASE WHEN v = 0 THEN '{story.OLD_INTERFACE}' WHEN conv_id % 3 = 0 THEN '{story.BODY_UNSEEN}' ELSE '{story.NO_EDITS}' END || CASE WHEN k = 1 AND conv_id % 3 > 1 THEN '|{story.NO_EVENTS}' ELSE '' END END AS caveats FROM s""")
def story_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Every paper has its row, though some histories are broken, missing, timed out or of venues without any."""
    c, p = tb.read(spark, sf, "conversations"), F.col("paper_id")
    turns = c.groupBy(F.col("conv_id").alias("paper_id")).agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    papers = turns.select("paper_id", F.concat(F.lit("V"), (p % 4).cast("string")).alias("venue"))
    registry = spark.createDataFrame([("V0", "v1"), ("V1", "v2"), ("V2", "v2")], "venue string, version string")
    k = p % 10
    replies = F.when(k == 3, '[{"turn": ').when(k == 1, "[]").otherwise(F.to_json("turns"))
    edits = F.when(p % 3 == 0, '[{"is_baseline": true}, {"is_baseline": false}]').when(p % 3 == 1, '[{"is_baseline": true}]').otherwise("[]")
    landed = turns.filter(k != 7).select("paper_id", replies.alias("replies"), edits.alias("edits"), F.when(k == 9, "Timeout").alias("error"))
    out = story.histories(papers, registry, landed)
    return out.select("paper_id", "supported", F.json_array_length("replies").alias("replies"), F.array_join("caveats", "|").alias("caveats"))
