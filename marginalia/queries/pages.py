"""Queries of page regions. Conversations stand for pages: four turns are a page, a turn is a block whose place its length gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia import tables as tb
from marginalia.functions import text as T
from marginalia.operators import layout, regions
from marginalia.queries.registry import query
from marginalia.session import checkpoint_dir

WIDTH, HEIGHT = 600.0, 450.0

_BLOCKS = r"""raw AS (SELECT conv_id AS doc_id, (turn // 4)::INT AS page, turn::BIGINT AS block_id, coalesce(length(text), 0)::INT AS n, text AS body, role, (100 * (turn % 4))::DOUBLE AS y0 FROM conversations),
  blocks AS (SELECT doc_id, page, block_id, n, y0, y0 + 60 + n % 50 AS y1, (40 + 10 * (n % 20))::DOUBLE AS x0, (140 + 10 * (n % 20) + n % 200)::DOUBLE AS x1, CASE WHEN n % 3 = 0 THEN 'Figure ' || (block_id + 1) || ': ' || role ELSE body END AS text FROM raw),
  shapes AS (SELECT doc_id, page, x0 + 5 AS x0, y0 - 30 AS y0, x1 + 20 AS x1, y0 - 10 AS y1 FROM blocks WHERE n % 5 = 0), bottoms AS (SELECT doc_id, page, y0 - 20 AS bottom FROM blocks WHERE n % 7 = 0)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    c, t = tb.read(spark, sf, "conversations"), F.col("turn")
    n = F.coalesce(F.length("text"), F.lit(0))
    y0 = (100 * (t % 4)).cast("double")
    text = F.when(n % 3 == 0, F.concat(F.lit("Figure "), (t + 1).cast("string"), F.lit(": "), "role")).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("doc_id"), F.floor(t / 4).cast("int").alias("page"), t.cast("long").alias("block_id"), n.alias("n"), y0.alias("y0"), (y0 + 60 + n % 50).alias("y1"), (40 + 10 * (n % 20)).cast("double").alias("x0"), (140 + 10 * (n % 20) + n % 200).cast("double").alias("x1"), text.alias("text"))


def _shapes(blocks: DataFrame) -> DataFrame:
    return blocks.filter("n % 5 = 0").selectExpr("doc_id", "page", "x0 + 5 AS x0", "y0 - 30 AS y0", "x1 + 20 AS x1", "y0 - 10 AS y1", "false AS image")


def _bottoms(blocks: DataFrame) -> DataFrame:
    return blocks.filter("n % 7 = 0").selectExpr("doc_id", "page", "y0 - 20 AS bottom")


_HERE = "{0}.doc_id = c.doc_id AND {0}.page = c.page"


@query(rf"""WITH {_BLOCKS}, f AS (SELECT *, trim(regexp_replace(regexp_replace(text, '-\n\s*', '', 'g'), '\s*\n\s*', ' ', 'g')) AS flat, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM blocks),
  told AS (SELECT *, len(list_filter(regexp_split_to_array(flat, '\s+'), lambda w: w <> '')) AS words, regexp_full_match(flat, '\d{{1,4}}(\s+\d{{1,4}})*') AS numbers, regexp_matches(flat, '(?i)^figure\s+\d+[:.]') AS cap FROM f),
  heights AS (SELECT doc_id, page, 1.5 * coalesce(median((y1 - y0) / lines) FILTER (WHERE lines >= 2), 12) AS near FROM told GROUP BY ALL),
  caps AS (SELECT *, lag(y1) OVER w AS above, lag(y0) OVER w AS p0, lag(block_id) OVER w AS pb FROM told WHERE cap WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, block_id)),
  prose AS (SELECT c.*, least(c.y1, (SELECT min(k.y0) FROM caps k WHERE {_HERE.format("k")} AND least(k.y1, c.y1) > greatest(k.y0, c.y0))) AS reach FROM told c WHERE words > 20 AND NOT numbers AND NOT cap),
  a AS (SELECT *, greatest(0, above, (SELECT max(bottom) FROM bottoms t WHERE {_HERE.format("t")} AND bottom <= c.y0)) AS floor FROM caps c),
  b AS (SELECT *, greatest(floor, (SELECT max(reach) FROM prose p WHERE {_HERE.format("p")} AND (p.y0, p.block_id) < (c.y0, c.block_id) AND (c.pb IS NULL OR (p.y0, p.block_id) > (c.p0, c.pb)))) AS t0 FROM a c),
  d AS (SELECT *, coalesce((SELECT min(s.y0) FROM shapes s WHERE {_HERE.format("s")} AND s.y1 > c.floor AND s.y0 < c.y0), t0) AS t1 FROM b c),
  e AS (SELECT *, coalesce((SELECT min(s.x0) FROM shapes s WHERE {_HERE.format("s")} AND s.y1 > c.t1 AND s.y0 < c.y1), 0) AS l0, coalesce((SELECT max(s.x1) FROM shapes s WHERE {_HERE.format("s")} AND s.y1 > c.t1 AND s.y0 < c.y1), {WIDTH}) AS r0 FROM d c JOIN heights USING (doc_id, page)),
  labels AS (SELECT * FROM told WHERE words BETWEEN 1 AND 10 AND NOT numbers),
  g AS (SELECT *, coalesce((SELECT min(h.y0) FROM labels h WHERE {_HERE.format("h")} AND h.y1 <= c.t1 AND c.t1 - h.y1 <= near AND h.y0 >= c.floor AND least(h.x1, r0) > greatest(h.x0, l0)), t1) AS top FROM e c),
  z AS (SELECT *, (SELECT min(h.x0) FROM labels h WHERE {_HERE.format("h")} AND h.x1 <= c.l0 AND c.l0 - h.x1 <= near AND least(h.y1, c.y1) > greatest(h.y0, c.top)) AS l1,
    (SELECT max(h.x1) FROM labels h WHERE {_HERE.format("h")} AND h.x0 >= c.r0 AND h.x0 - c.r0 <= near AND least(h.y1, c.y1) > greatest(h.y0, c.top)) AS r1 FROM g c)
  SELECT doc_id, page, top, y1 AS bottom, least(coalesce(l1, l0), x0)::DOUBLE AS x0, greatest(coalesce(r1, r0), x1)::DOUBLE AS x1, 'Figure ' || (block_id + 1) AS label FROM z""")
def figure_regions(spark: SparkSession, sf: str) -> DataFrame:
    """What belongs to each figure's caption: extent by prose, drawings, tables and labels around it."""
    b = _blocks(spark, sf)
    return regions.figure_regions(b, _shapes(b), _bottoms(b), WIDTH)


@query()
def ruled_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Tables and algorithms between the rules that are theirs; tests follow it by brute force."""
    return regions.ruled_regions(_ruled_blocks(spark, sf), _rules(spark, sf), WIDTH, HEIGHT)


def _ruled_blocks(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("n") % 3 == 0, F.concat(F.lit("Table "), (F.col("n") % 9).cast("string"), F.lit(": of them"))).when(F.col("n") % 3 == 1, F.concat(F.lit("Algorithm "), (F.col("n") % 7).cast("string"), F.lit(" does it"))).otherwise(F.col("text"))
    return _blocks(spark, sf).withColumn("text", kind)


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    """Two to six rules a page, at heights that blocks' lengths give."""
    b = _blocks(spark, sf)
    y = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") % 3), lambda i: (F.col("y0") + (F.col("n") % 37) + 55 * i).cast("double")))
    return b.select("doc_id", "page", y.alias("y"), F.col("x0"), (F.col("x0") + 250).alias("x1"))


@query()
def equation_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered equations grown line by line; tests follow it by brute force over random pages."""
    b = _blocks(spark, sf).withColumn("text", F.when(F.col("n") % 3 == 0, F.concat(F.lit("("), (F.col("n") % 90).cast("string"), F.lit(")"))).when(F.col("n") % 3 == 1, F.lit("x = y + z")).otherwise(F.col("text")))
    wide = F.when(F.col("n") % 3 == 0, F.lit(520.0)).when(F.col("n") % 3 == 2, F.lit(520.0)).otherwise(F.col("x1"))
    lines = b.withColumn("x1", wide).withColumn("y1", F.col("y0") + 12 + F.col("n") % 50)
    prose = lines.filter("n % 3 = 2").withColumn("x0", F.lit(40.0))
    return regions.equation_regions(lines, prose, WIDTH)


@query("""WITH f AS (SELECT user_id AS doc_id, (event_id % 5)::INT AS page, (event_id % 60)::DOUBLE AS x0, (event_id % 60 + 200 + event_id % 300)::DOUBLE AS x1, (event_id * 37 % 1500)::DOUBLE AS y0, (event_id * 37 % 1500 + event_id % 60)::DOUBLE AS y1 FROM events),
  b AS (SELECT * FROM f WHERE x1 - x0 >= 300 AND y1 - y0 >= 20), starts AS (SELECT DISTINCT doc_id, page, y0 FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.page = x.page AND y.y0 < x.y0 AND y.y1 + 1 >= x.y0)),
  owned AS (SELECT b.*, (SELECT max(s.y0) FROM starts s WHERE s.doc_id = b.doc_id AND s.page = b.page AND s.y0 <= b.y0) AS run FROM b)
  SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM owned GROUP BY doc_id, page, run""")
def box_fills(spark: SparkSession, sf: str) -> DataFrame:
    """Fills of half the page's width merged over gaps of at most a point."""
    e = F.col("event_id")
    y = (e * 37 % 1500).cast("double")
    fills = tb.read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), (e % 5).cast("int").alias("page"), (e % 60).cast("double").alias("x0"), (e % 60 + 200 + e % 300).cast("double").alias("x1"), y.alias("y0"), (y + e % 60).alias("y1"))
    return regions.merged_boxes(fills, WIDTH)


@query(r"""WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' the h f ll i pa' WHEN 1 THEN chr(10) || 'W U  V a b c ' WHEN 2 THEN ' w xyz' ELSE '' END AS text, CASE WHEN doc_id % 8 = 0 THEN 'so the h  f ll i pa' WHEN doc_id % 8 = 1 THEN 'W U V a b' END AS reference FROM documents),
  m AS (SELECT *, regexp_replace(regexp_extract(text, '(?:^|\s)([A-Za-z]{1,3}(?:\s+[A-Za-z]{1,3})*)\s*$', 1), '\s+', ' ', 'g') AS run FROM t)
  SELECT doc_id, md5(CASE WHEN len(string_split(run, ' ')) >= 5 AND NOT coalesce(contains(regexp_replace(reference, '\s+', ' ', 'g'), run), false) THEN rtrim(regexp_replace(text, '(?:^|\s)([A-Za-z]{1,3}(?:\s+[A-Za-z]{1,3})*)\s*$', ''), E' \n\t\r\f') ELSE text END) AS kept FROM m""")
def clip_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without the letters that a crop's edge left at their ends, unless a second reading has them too."""
    k = F.col("doc_id")
    d = tb.read(spark, sf, "documents")
    tail = F.when(k % 4 == 0, " the h f ll i pa").when(k % 4 == 1, "\nW U  V a b c ").when(k % 4 == 2, " w xyz").otherwise("")
    reference = F.when(k % 8 == 0, "so the h  f ll i pa").when(k % 8 == 1, "W U V a b")
    return d.select("doc_id", F.md5(T.without_clip_leak(F.concat("text", tail), reference)).alias("kept"))


@query()
def merged_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that overlap by 80 % of the smaller one merged until none do, captions apart; tests follow it by brute force."""
    b = _blocks(spark, sf).withColumn("y1", F.col("y0") + 60 + 3 * (F.col("n") % 50))
    return layout.merged_overlaps(b).select("doc_id", "page", "block_id", "x0", "y0", "x1", "y1", F.md5("text").alias("text"))


@query()
def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The running text of each document around its figures, tables, boxes and equations; tests follow it on fixtures."""
    checkpoint_dir(spark)
    b = _blocks(spark, sf)
    # each is read by several steps of the text, so it is worked out once
    figures = regions.figure_regions(b, _shapes(b), _bottoms(b), WIDTH).checkpoint()
    tables = regions.ruled_regions(b, _rules(spark, sf), WIDTH, HEIGHT).checkpoint()
    fills = b.filter("n % 11 = 0").selectExpr("doc_id", "page", "x0", "x0 + 320 AS x1", "y0", "y1")
    boxes = regions.box_regions(fills, b, figures.unionByName(tables), WIDTH).checkpoint()
    return regions.full_text(b, figures, tables, boxes, regions.equation_regions(b, b, WIDTH).checkpoint())


@query("""WITH b AS (SELECT event_id AS block_id, user_id AS doc_id, (event_id % 3)::INT AS page, (event_id % 2)::DOUBLE AS x0, (event_id % 2 + 50 + event_id % 9)::DOUBLE AS x1, (event_id * 13 % 2000)::DOUBLE AS y0, (event_id * 13 % 2000 + 10 + event_id % 20)::DOUBLE AS y1, event_id::VARCHAR AS text FROM events),
  g AS (SELECT doc_id, median(y1 - y0) * 0.5 AS gap FROM b GROUP BY 1), l AS (SELECT *, lag(y1) OVER (PARTITION BY doc_id, page, x0 ORDER BY y0, y1) AS above FROM b JOIN g USING (doc_id)),
  r AS (SELECT *, count(*) FILTER (WHERE above IS NULL OR y0 - above >= gap) OVER (PARTITION BY doc_id, page, x0 ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS run FROM l)
  SELECT doc_id, page, x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY y0, text) AS text FROM r GROUP BY doc_id, page, x0, run""")
def merged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """X11: blocks of a column that follow one another closely as one, by half the median height of a document's lines."""
    e = F.col("event_id")
    y = (e * 13 % 2000).cast("double")
    b = tb.read(spark, sf, "events").select(e.alias("block_id"), F.col("user_id").alias("doc_id"), (e % 3).cast("int").alias("page"), (e % 2).cast("double").alias("x0"), (e % 2 + 50 + e % 9).cast("double").alias("x1"), y.alias("y0"), (y + 10 + e % 20).alias("y1"), e.cast("string").alias("text"))
    return layout.merged_close(b)


@query("""WITH s AS (SELECT p_partkey AS doc_id, string_split(p_name || ' ' || p_brand, ' ') AS w FROM part) SELECT doc_id, w[1] || coalesce(w[2], '') || CASE WHEN len(w) > 2 THEN ' ' || array_to_string(w[3:], ' ') ELSE '' END AS title FROM s""")
def split_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of spans of which the first two are halves of a word, by the gap between them."""
    p = tb.read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("k", "text"))
    spans = p.select("doc_id", F.lit(1).alias("page"), (F.col("k") % 2).cast("double").alias("dy"), (100.0 * F.col("k")).alias("x0"), F.when(F.col("k") == 0, 99.0).otherwise(100.0 * F.col("k") + 60).alias("x1"), F.lit(17.0).alias("size"), "text")
    return layout.page_title(spans.withColumn("y0", F.lit(80.0)))
