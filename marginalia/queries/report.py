"""Queries behind a report: normalised reviews, lookups, evidence, citations, examples, page blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia import tables as tb
from marginalia.functions import text as T
from marginalia.operators import layout, retrieval, stats
from marginalia.queries.registry import query


@query("""WITH f AS (SELECT conv_id, turn, regexp_replace(coalesce(nullif(trim(CASE WHEN turn % 3 = 0 THEN '  ' END), ''), nullif(trim(CASE WHEN turn % 3 = 1 THEN role END), ''), nullif(trim(text), ''), ''), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g') AS body FROM conversations)
  SELECT conv_id, count(*) FILTER (WHERE body <> '') AS n_reviews, md5(string_agg(body, '|' ORDER BY turn, body)) AS bodies, arg_max(length(body), turn * 1000000 + length(body)) AS meta_chars FROM f GROUP BY 1""")
def normalized_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Fields from the first source that isn't blank, reviews gathered by paper, the last one its meta review."""
    body = T.first_field(F.when(F.col("turn") % 3 == 0, F.lit("  ")), F.when(F.col("turn") % 3 == 1, F.col("role")), F.col("text"))
    rows = tb.read(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "body")))
    return rows.groupBy("conv_id").agg(
        F.count_if(F.col("body") != "").alias("n_reviews"), F.md5(F.array_join(F.transform(parts, lambda p: p["body"]), "|")).alias("bodies"),
        F.max_by(F.length("body"), F.col("turn") * 1000000 + F.length("body")).cast("bigint").alias("meta_chars"),
    )


@query("""SELECT event_id AS pos, user_id * 11 AS id, c_name AS name FROM events LEFT JOIN customer ON c_custkey = user_id * 11""")
def id_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each id in the order of the request, null where it is unknown."""
    found = tb.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    asked = tb.read(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 11).alias("id"))
    return asked.join(found, "id", "left").select("pos", "id", "name")


_TEXT_POINTS = f"{tb.POINTS}, texts AS (SELECT points.*, p_name AS text FROM points JOIN part ON p_partkey = point_id)"


def _text_points(spark: SparkSession, sf: str) -> DataFrame:
    names = tb.read(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_name").alias("text"))
    return tb.points(spark, sf).join(names, "point_id")


@query(f"""WITH {_TEXT_POINTS}, one AS (SELECT * FROM texts WHERE aspect <> 'other' AND text <> '' QUALIFY row_number() OVER (PARTITION BY aspect, paper_id ORDER BY from_unsplit, length(text) DESC, point_id) = 1)
  SELECT aspect, paper_id, point_id FROM one QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY from_unsplit, length(text) DESC, paper_id) <= 3""")
def aspect_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Three examples of each aspect, one a paper, parsed and longer ones first."""
    return stats.examples(_text_points(spark, sf)).select("aspect", "paper_id", "point_id")


@query(f"""WITH {_TEXT_POINTS}, chosen AS (SELECT o_orderkey AS paper_id, o_orderpriority AS meta, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS paper_rank FROM orders QUALIFY paper_rank <= 5),
  e AS (SELECT paper_rank, text, row_number() OVER (PARTITION BY paper_rank ORDER BY from_unsplit, aspect = 'other', point_id) AS n FROM texts JOIN chosen USING (paper_id) WHERE sentiment = 'weakness' QUALIFY n <= 2)
  SELECT 'E' || row_number() OVER (ORDER BY paper_rank, n) AS label, paper_rank::INT AS paper_rank, text, row_number() OVER (ORDER BY paper_rank, n)::INT AS number FROM e
  UNION ALL SELECT 'M' || paper_rank, paper_rank::INT, meta, paper_rank::INT FROM chosen WHERE paper_rank <= 3""")
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled evidence of five chosen papers (the choice is the feature), with the labels' numbers."""
    top = tb.read(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)
    chosen = top.select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("text"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("paper_rank"))
    points = _text_points(spark, sf).filter("sentiment = 'weakness'").join(F.broadcast(chosen.select("paper_id", "paper_rank")), "paper_id")  # five rows
    return retrieval.evidence_pool(points, chosen).withColumn("number", T.number_in(F.col("label")))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 IN (1, 2) THEN 'E' || (turn % 4) || ',M1' ELSE 'M1' END AS cited FROM conversations""")
def cited_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The known labels that a text cites, in order of first use."""
    text = F.concat(F.lit("as said [E"), (F.col("turn") % 4).cast("string"), F.lit(", M1] and again [M1] or [E9]"))
    labels = T.citation_labels(text, F.array(F.lit("E1"), F.lit("E2"), F.lit("M1")))
    return tb.read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(labels, ",").alias("cited"))


@query(f"""WITH {tb.POINTS}, p AS (SELECT paper_id, bool_or(NOT from_unsplit AND sentiment = 'weakness') AS found, bool_or(from_unsplit) AS raw FROM points GROUP BY 1)
  SELECT count(*) FILTER (WHERE found) AS recovered, count(*) FILTER (WHERE NOT found AND raw) AS unknown, count(*) FILTER (WHERE NOT found AND NOT raw) AS empty FROM p""")
def extraction_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """How many papers a re-extraction recovers, leaves unknown or leaves empty."""
    weak = ~F.col("from_unsplit") & (F.col("sentiment") == "weakness")
    p = tb.points(spark, sf).groupBy("paper_id").agg(F.bool_or(weak).alias("found"), F.bool_or("from_unsplit").alias("raw"))
    return p.agg(F.count_if("found").alias("recovered"), F.count_if(~F.col("found") & F.col("raw")).alias("unknown"), F.count_if(~F.col("found") & ~F.col("raw")).alias("empty"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20""")
def recent_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of jobs, newest first (a page is the feature)."""
    return tb.read(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).offset(20).limit(20).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""SELECT doc_id, source FROM documents WHERE n_chars < 1000 AND trim(text) <> '' AND lang IN ('en', 'fr') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)""")
def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of given kinds that hold something but that nothing refers to."""
    d = tb.read(spark, sf, "documents").filter((F.col("n_chars") < 1000) & (F.trim("text") != "") & F.col("lang").isin("en", "fr"))
    return d.join(tb.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT o_orderkey AS id FROM orders WHERE substr(md5(o_orderkey::VARCHAR), 1, 2) < '05'""")
def random_control(spark: SparkSession, sf: str) -> DataFrame:
    """A random control of about 2 % (a sampling operator), drawn by a checksum so that it can be repeated."""
    return tb.papers(spark, sf).filter(F.substring(F.md5(F.col("id").cast("string")), 1, 2) < "05").select("id")


@query(r"""WITH b AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Figure ' || turn || ': ' || role WHEN 1 THEN ' table 3. ' || role WHEN 2 THEN 'Algorithm 7 ' || role ELSE 'Figure out ' || role END AS t FROM conversations)
  SELECT conv_id AS doc_id, turn AS page, lower(regexp_extract(t, '(?i)^\s*(figure|table|algorithm)\s+(\d+)', 1)) AS kind, regexp_extract(t, '(?i)^\s*(figure|table|algorithm)\s+(\d+)', 2)::INT AS number FROM b
  WHERE regexp_matches(t, '(?i)^\s*((figure|table)\s+\d+\s*[:.]|algorithm\s+\d+)')""")
def media_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions of figures, tables and algorithms."""
    k, role = F.col("turn") % 4, F.col("role")
    text = F.when(k == 0, F.concat(F.lit("Figure "), F.col("turn").cast("string"), F.lit(": "), role)).when(k == 1, F.concat(F.lit(" table 3. "), role)).when(k == 2, F.concat(F.lit("Algorithm 7 "), role)).otherwise(F.concat(F.lit("Figure out "), role))
    return layout.captions(tb.read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), text.alias("text"))).select("doc_id", "page", "kind", "number")


@query("""WITH b AS (SELECT event_id AS block_id, user_id AS doc_id, event_id % 10 AS page, (event_id % 7)::DOUBLE AS x0, (event_id % 7 + 20)::DOUBLE AS x1, (event_id % 3)::DOUBLE AS y0, (event_id % 3 + 10)::DOUBLE AS y1 FROM events)
  SELECT a.doc_id, a.block_id AS a, b.block_id AS b FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.block_id < b.block_id
  WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.8::DOUBLE * 200""")
def block_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a page that overlap by 80 % of the smaller one."""
    e = F.col("event_id")
    blocks = tb.read(spark, sf, "events").select(e.alias("block_id"), F.col("user_id").alias("doc_id"), (e % 10).alias("page"), (e % 7).cast("double").alias("x0"), (e % 7 + 20).cast("double").alias("x1"), (e % 3).cast("double").alias("y0"), (e % 3 + 10).cast("double").alias("y1"))
    return layout.overlapping(blocks).select("doc_id", "a", "b")


@query("""SELECT p_partkey, 1990 + p_size % 30 AS year, CASE p_partkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'replaced' END AS verb, 'hyphenated ' || p_brand || ' line' AS flat,
  'data:image/png;base64,' || base64(encode(p_name)) AS uri, p_partkey % 2 = 0 AS particle FROM part""")
def field_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Years, verbs of file changes, joined lines, data URIs, the consonant that decides a particle."""
    k = F.col("p_partkey")
    old, new = F.when(k % 3 != 0, F.lit("a")), F.when(k % 3 != 1, F.lit("b"))
    block = F.concat(F.lit("hyphen-\nated\n"), F.col("p_brand"), F.lit(" \n line"))
    return tb.read(spark, sf, "part").select(
        "p_partkey", T.created_year(F.concat((1990 + F.col("p_size") % 30).cast("string"), F.lit("-05-01"))).alias("year"), T.file_verb(old, new).alias("verb"), T.flatten_block(block).alias("flat"),
        T.data_uri(F.col("p_name")).alias("uri"), T.has_final_consonant(F.when(k % 2 == 0, F.lit("논문은")).otherwise(F.lit("리뷰"))).alias("particle"),
    )
