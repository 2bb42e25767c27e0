"""Queries over what was landed: records, edit logs, answers to title searches, review texts, drawings of pages."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia import tables as tb
from marginalia.functions import text as T
from marginalia.operators import layout
from marginalia.plans import enrichment, story
from marginalia.queries.registry import query
from marginalia.queries.textual import _ASPECT, _BULLETS, _SPLIT
from marginalia.session import checkpoint_dir
from marginalia.sources import harvest
from marginalia.streaming import ingest


@query("""SELECT c_custkey::VARCHAR AS id, c_name || ' of ' || c_mktsegment AS title, '2020-01-0' || (1 + c_custkey % 9) AS created, 2 AS categories FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0""")
def harvested_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records from their XML, without deleted ones and those without a title, white space collapsed."""
    k = F.col("c_custkey")
    deleted = F.when(k % 7 == 0, "<deleted>1</deleted>").otherwise("")
    title = F.when(k % 11 == 0, F.lit(" ")).otherwise(F.concat("c_name", F.lit("\n  of "), "c_mktsegment"))
    xml = F.concat(F.lit("<record><identifier>"), k.cast("string"), F.lit("</identifier>"), deleted, F.lit("<title>"), title, F.lit("</title><created>2020-01-0"), (1 + k % 9).cast("string"), F.lit("</created><categories>cs.LG stat.ML</categories></record>"))
    rows = harvest.parsed_records(tb.read(spark, sf, "customer").select(xml.alias("xml")))
    return rows.select("id", "title", F.col("created").cast("string").alias("created"), F.size("categories").alias("categories"))


@query("""SELECT c_custkey AS asked, '24' || (c_custkey % 97) || '.0' || c_custkey AS id, c_name AS title FROM customer WHERE c_custkey % 5 <> 0""")
def title_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """The first entry of each landed answer to a title search."""
    k = F.col("c_custkey")
    entry = F.concat(F.lit("<entry><id>http://x/abs/24"), (k % 97).cast("string"), F.lit(".0"), k.cast("string"), F.lit("v3</id><title> "), "c_name", F.lit("\n</title></entry><entry><id>y</id><title>other</title></entry>"))
    xml = F.concat(F.lit("<feed>"), F.when(k % 5 != 0, entry).otherwise(""), F.lit("</feed>"))
    return harvest.first_entries(tb.read(spark, sf, "customer").select(k.alias("asked"), xml.alias("xml")))


@query("""SELECT user_id AS note_id, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY value, event_id) FILTER (WHERE user_id % 3 <> 0), '') AS edits FROM events GROUP BY 1""")
def edit_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The edits of each note, oldest first; none for the API without edit logs."""
    e = tb.read(spark, sf, "events").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("edit_id"), (F.col("value") * 1000000).cast("long").alias("tcdate"), F.col("event_type").alias("content"))
    papers = e.select("note_id", F.when(F.col("note_id") % 3 == 0, "Elsewhere").otherwise("ICLR").alias("conference")).distinct()
    return harvest.note_edits(e, papers).select("note_id", F.array_join(F.transform("edits", lambda x: x["edit_id"].cast("string")), ",").alias("edits"))


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '(?m)^\s*(?:[-*•·▪]|\(?\d+[.)]|\(?[a-z][.)])\s+')) >= 2 THEN {_BULLETS} ELSE {_SPLIT} END AS p, regexp_matches(text, '{T.WEAK_HEAD.replace("(?imd)", "(?im)")}') AS headed FROM d),
  q AS (SELECT doc_id, list_concat(list_transform(p, lambda t: struct_pack(t := t, s := CASE WHEN doc_id % 2 = 0 AND NOT headed THEN 'unknown' ELSE 'weakness' END)), [struct_pack(t := 'Why is there no baseline of the usual size here?', s := 'question')])[1:12] AS p FROM s),
  x AS (SELECT doc_id, unnest(p) AS p, unnest(range(len(p))) AS n FROM q), y AS (SELECT doc_id, n, p.s AS s, lower(p.t) AS low FROM x)
  SELECT doc_id, string_agg(s || ':' || CASE {_ASPECT} ELSE 'other' END, ',' ORDER BY n) AS points FROM y GROUP BY 1""")
def extracted_points(spark: SparkSession, sf: str) -> DataFrame:
    """The points of reviews with sentiment and aspect; what can't be told apart in an unsplit one is unknown."""
    points = T.review_points(F.coalesce("text", F.lit("")), F.lit("Why is there no baseline of the usual size here?"), (F.col("doc_id") % 2 == 0) & ~F.coalesce(F.col("text").rlike(T.WEAK_HEAD), F.lit(False)))
    return tb.read(spark, sf, "documents").select("doc_id", F.array_join(F.transform(points, lambda p: F.concat_ws(":", p["sentiment"], p["aspect"])), ",").alias("points"))


@query("""WITH d AS (SELECT user_id % 50 AS doc_id, event_id AS drawing, event_id % 12 AS page, (event_id % 40)::DOUBLE AS x0, (event_id % 40 + event_id % 200)::DOUBLE AS x1, CASE WHEN event_id % 9 = 0 THEN 99.0 ELSE event_id % 700 END::DOUBLE AS y0, event_id % 4 AS h FROM events),
  p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM d GROUP BY 1), f AS (SELECT * FROM d WHERE h = 0 AND x1 - x0 >= 0.15::DOUBLE * 600),
  r AS (SELECT doc_id, y0 FROM f JOIN p USING (doc_id) GROUP BY doc_id, y0, pages HAVING pages >= 3 AND count(DISTINCT page) >= greatest(3, 0.3 * pages)) SELECT drawing FROM f ANTI JOIN r USING (doc_id, y0)""")
def page_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Horizontal rules of pages, without those that repeat at one height."""
    e = F.col("event_id")
    y = F.when(e % 9 == 0, F.lit(99)).otherwise(e % 700).cast("double")
    d = tb.read(spark, sf, "events").select((F.col("user_id") % 50).alias("doc_id"), e.alias("drawing"), (e % 12).alias("page"), (e % 40).cast("double").alias("x0"), (e % 40 + e % 200).cast("double").alias("x1"), y.alias("y0"), (y + e % 4).alias("y1"))
    return layout.horizontal_rules(d, 600.0).select("drawing")


@query("""WITH s AS (SELECT conv_id AS doc_id, turn, role, CASE WHEN turn <= 3 THEN 20 - turn % 2 ELSE 8 END AS size FROM conversations), t AS (SELECT doc_id, max(size) AS top FROM s GROUP BY 1)
  SELECT doc_id, string_agg(role || turn, ' ' ORDER BY turn) AS title FROM s JOIN t USING (doc_id) WHERE size >= 0.75 * top GROUP BY 1""")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The spans in the largest type of a first page as its title."""
    c, t = tb.read(spark, sf, "conversations"), F.col("turn")
    spans = c.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), t.cast("double").alias("y0"), F.lit(0.0).alias("x0"), F.when(t <= 3, 20 - t % 2).otherwise(8).alias("size"), F.concat("role", t.cast("string")).alias("text"))
    return layout.page_title(spans)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '> ⚠️ **' || c_name || '**' || chr(10) || chr(10) || '비슷한 논문을 찾지 못해 보여드릴 리뷰가 없습니다.'
  ELSE '비슷하다고 판단할 만한 논문을 찾지 못했습니다. 검색에는 걸렸지만 본문을 대조한 결과 같은 문제를 다루는 논문이 아니었습니다.' END AS summary FROM customer""")
def empty_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """What is said where nothing was selected, by the retrieval's confidence."""
    level = F.when(F.col("c_custkey") % 2 == 0, "weak").otherwise("strong")
    return tb.read(spark, sf, "customer").select("c_custkey", story.nothing_selected(level, F.col("c_name")).alias("summary"))


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderpriority || ' a title of many words ' || o_custkey AS title, year(o_orderdate) AS year, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS ext_id FROM orders),
  x AS (SELECT c_custkey AS ext_id, '1-urgent A Title of: many words ' || c_custkey AS title FROM customer), n AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS k FROM p), m AS (SELECT ext_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS k FROM x),
  f AS (SELECT n.id, n.year, coalesce(n.ext_id, m.ext_id) AS ext_id FROM n LEFT JOIN m USING (k)), c AS (SELECT c_custkey AS ext_id, floor(c_acctbal)::BIGINT AS cites FROM customer WHERE c_custkey % 3 > 0),
  j AS (SELECT f.id, f.year, f.ext_id, cites FROM f LEFT JOIN c USING (ext_id))
  SELECT j.id, j.ext_id, cites AS citation_count, round(pct, 6) AS percentile FROM j LEFT JOIN (SELECT id, cume_dist() OVER (PARTITION BY year ORDER BY cites) AS pct FROM j WHERE cites IS NOT NULL) q USING (id)""")
def enriched_papers(spark: SparkSession, sf: str) -> DataFrame:
    """External ids by title, citations by id, percentiles within the year."""
    o, c = tb.read(spark, sf, "orders"), tb.read(spark, sf, "customer")
    none = F.array().cast("array<string>")
    papers = o.select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(" a title of many words "), F.col("o_custkey").cast("string")).alias("title"), F.year("o_orderdate").alias("year"), none.alias("surnames"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).alias("ext_id"))
    external = c.select(F.col("c_custkey").alias("ext_id"), F.concat(F.lit("1-urgent A Title of: many words "), F.col("c_custkey").cast("string")).alias("title"), F.lit(None).cast("int").alias("created_year"), none.alias("surnames"))
    citations = c.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("ext_id"), F.floor("c_acctbal").alias("citation_count"))
    return enrichment.enriched(papers, external, citations).select("id", "ext_id", "citation_count", F.round("percentile", 6).alias("percentile"))


def _landed(spark: SparkSession, sf: str) -> str:
    """Customers as gzipped JSON lines, some of them blank, in a new folder of the shared one."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    lines = F.explode(F.when(F.col("c_custkey") % 10 == 0, F.array(line, F.lit(""))).otherwise(F.array(line)))
    tb.read(spark, sf, "customer").select(lines.alias("value")).write.option("compression", "gzip").text(path)
    return path


_CUSTOMERS = "SELECT c_custkey AS id, c_name AS name FROM customer"


@query(_CUSTOMERS)
def landed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Records of gzipped JSON lines, blank ones skipped."""
    return harvest.json_lines(spark, _landed(spark, sf), "id long, name string")


@query(_CUSTOMERS)
def ingested(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream of landed files has brought in; its second run finds nothing new."""
    source = _landed(spark, sf)
    for _ in range(2):
        ingest.ingest_new(spark, source, "id long, name string", f"{source}-table", f"{source}-state").awaitTermination()
    return spark.read.schema("id long, name string").parquet(f"{source}-table")


#: Notes of a page of the service, and the pages of a landed folder, which a task reads.
NOTES, NOTE_PAGES = 1000, 100


def note_page(offset: int, limit: int, root: str) -> list[tuple[str, str]]:
    """A page of landed notes, as a service gives it by offset; pages of NOTES don't cross folders, and each is a row group of its own."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root)
    folder = f"{base}/block={offset // (NOTES * NOTE_PAGES)}"
    if where.get_file_info(folder).type != fs.FileType.Directory:
        return []
    n = ds.field("n")
    rows = ds.dataset(folder, filesystem=where, format="parquet").to_table(columns=["id", "content"], filter=(n >= offset) & (n < offset + limit))
    return list(zip(rows["id"].to_pylist(), rows["content"].to_pylist(), strict=True))


@query("""SELECT 'n' || o_orderkey AS id, o_custkey AS n FROM orders""")
def paged_notes(spark: SparkSession, sf: str) -> DataFrame:
    """All pages of notes that were landed by offset, a task for those of a folder."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/notes-{uuid.uuid4().hex}"
    o = tb.read(spark, sf, "orders")
    first = F.row_number().over(Window.partitionBy("k").orderBy("o_orderkey")) - 1
    sizes = o.groupBy((F.col("o_orderkey") % 256).alias("k")).agg(F.count("*").alias("size")).orderBy("k").collect()  # 256 rows
    starts, total = {}, 0
    for r in sizes:
        starts[r.k], total = total, total + r.size
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("k")) if starts else F.lit(0)
    notes = o.withColumn("k", F.col("o_orderkey") % 256).withColumn("n", first + start)
    rows = notes.select(F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("id"), F.to_json(F.struct(F.col("o_custkey").alias("n"))).alias("content"), "n", F.floor(F.col("n") / (NOTES * NOTE_PAGES)).alias("block"))
    rows.repartition("block").sortWithinPartitions("block", "n").write.option("parquet.block.row.count.limit", str(NOTES)).partitionBy("block").parquet(root)
    spark.dataSource.register(harvest.PagedNotes)
    read = spark.read.format("paged_notes").options(fetch=f"{__name__}:note_page", total=str(total), limit=str(NOTES), pages=str(NOTE_PAGES), root=root).load()
    return read.select("id", F.get_json_object("content", "$.n").cast("bigint").alias("n"))


@query("""SELECT replace(c_mktsegment, ' ', '_') AS part, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 40)::INT AS page, c_custkey AS id, c_name AS title FROM customer""")
def harvested_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A harvest by set and token over landed XML pages as a stream, stopped after three pages of each set and taken up again."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/harvest-{uuid.uuid4().hex}"
    c = tb.read(spark, sf, "customer").withColumn("part", F.replace("c_mktsegment", F.lit(" "), F.lit("_")))
    record = F.concat(F.lit("<record><id>"), F.col("c_custkey").cast("string"), F.lit("</id><title>"), "c_name", F.lit("</title></record>"))
    harvest.land_pages(c.withColumn("xml", record), f"{base}/pages", "part", "c_custkey", "xml", 40)
    parts = json.dumps(sorted(r.part for r in c.select("part").distinct().collect()))  # five sets
    spark.dataSource.register(harvest.HarvestStream)
    for pages in ("3", "0"):
        rows = spark.readStream.format("harvest_stream").options(root=f"{base}/pages", parts=parts, pages=pages).load()
        rows.writeStream.format("parquet").option("path", f"{base}/landed").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    landed = spark.read.schema("part string, page int, xml string").parquet(f"{base}/landed")
    found = landed.select("part", "page", F.explode(F.from_xml("xml", F.lit("record ARRAY<STRUCT<id: BIGINT, title: STRING>>"))["record"]).alias("r"))
    return found.select("part", "page", "r.id", "r.title")


@query("""WITH f AS (SELECT page_id, coalesce(html, '') || chr(10) AS body FROM pages) SELECT page_id, octet_length(encode(body)) AS length, md5(body) AS content FROM f WHERE octet_length(encode(body)) <= 2000""")
def attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files, read back as far as they are no larger than a cap (the feature)."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/attachments-{uuid.uuid4().hex}"
    pages = tb.read(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("value"))
    harvest.land_files(pages, root, "page_id", "value")
    files = harvest.attachments(spark, f"{root}/*", 2000)
    page = F.regexp_extract("path", r"page_id=(-?\d+)", 1).try_cast("bigint")
    return files.select(page.alias("page_id"), "length", F.md5("content").alias("content"))
