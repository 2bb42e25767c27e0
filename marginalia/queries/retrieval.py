"""Retrieval queries: lists, nearest vectors, BM25, hybrid search, folding, details."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia import tables as tb
from marginalia.functions import rank as R, text as T
from marginalia.operators import cells, postings, retrieval as op, stats
from marginalia.queries.registry import query
from marginalia.session import checkpoint_dir, written

WORDS = ("the", "thre", "tion", "hean", "erthe")


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking fields of documents: year and citations from the id and length, reviews for two in three."""
    d = tb.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("venue"), (2018 + F.col("doc_id") % 7).cast("int").alias("year"), "n_chars", (F.col("doc_id") % 3).alias("n_reviews"), T.dedupe_key(F.col("text")).alias("norm_title"))
    d = stats.with_cumulative_share(d.withColumn("norm_title", F.sha1("norm_title")), "year", "n_chars", "share")
    return d.withColumn("percentile", F.when(F.col("id") % 10 != 0, F.col("share"))).drop("n_chars", "share")


_FIELDS = """fields AS (SELECT doc_id AS id, source AS venue, (2018 + doc_id % 7)::INT AS year, doc_id % 3 AS n_reviews, sha1(lower(trim(text))) AS norm_title,
  CASE WHEN doc_id % 10 <> 0 THEN cume_dist() OVER (PARTITION BY 2018 + doc_id % 7 ORDER BY n_chars) END AS percentile FROM documents)"""
_BM25 = """tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM documents SEMI JOIN rev ON rev.id = documents.doc_id),
  len AS (SELECT id, len(t) AS l, {tfs} FROM tok), st AS (SELECT count(*) AS n, avg(l) AS al, {dfs} FROM len),
  sc AS (SELECT id, round({score}, 9) AS score FROM len CROSS JOIN st WHERE greatest({any}) > 0),
  fts AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS fts_rank FROM (SELECT * FROM sc ORDER BY score DESC, id LIMIT 100))""".format(
    tfs=", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(sorted(WORDS))),
    dfs=", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(WORDS))),
    score=" + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / al))" for i in range(len(WORDS))),
    any=", ".join(f"tf{i}" for i in range(len(WORDS))),
)
_VEC = """q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7), cs AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], q.e) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q.e, q.e)) AS cosine
    FROM embeddings CROSS JOIN q WHERE vec_id IN (SELECT id FROM rev)),
  vec AS (SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS vector_rank FROM (SELECT * FROM cs ORDER BY cosine DESC, id LIMIT 100))"""
_HYBRID = f"""{_FIELDS}, rev AS (SELECT id FROM fields WHERE n_reviews > 0), {_VEC}, {_BM25},
  fused AS (SELECT coalesce(v.id, f.id) AS id, vector_rank, fts_rank, coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + fts_rank), 0) AS rrf FROM vec v FULL JOIN fts f ON f.id = v.id),
  ranked AS (SELECT fused.*, venue, norm_title, n_reviews, round(0.35 * least(rrf / (2 / 61.0::DOUBLE), 1.0) + 0.45 * 0.5::DOUBLE ** (greatest((SELECT max(year) FROM fields) - coalesce(year, (SELECT max(year) FROM fields)), 0) / 3.0::DOUBLE) + 0.2 * coalesce(percentile, 0.5), 9) AS final_score
    FROM fused LEFT JOIN fields USING (id)),
  placed AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, id) AS position FROM ranked)"""


_PICKED = f"""WITH {_HYBRID}, slots AS (SELECT *, min(position) OVER (PARTITION BY norm_title, venue) AS slot_at FROM placed),
  cut AS (SELECT slot_at FROM (SELECT DISTINCT slot_at FROM slots) ORDER BY 1 OFFSET 50 LIMIT 1),
  picked AS (SELECT * FROM slots WHERE position < coalesce((SELECT slot_at FROM cut), 1000000) QUALIFY row_number() OVER (PARTITION BY norm_title, venue ORDER BY n_reviews DESC, position) = 1)
  SELECT id, row_number() OVER (ORDER BY slot_at)::INT AS slot, round(final_score, 6) AS final_score, CASE WHEN fts_rank IS NULL THEN 'semantic' WHEN vector_rank IS NULL THEN 'lexical' ELSE 'both' END AS match_type FROM picked"""


def _query_vector(spark: SparkSession, sf: str, vec_id: int = 7) -> list[float]:
    return list(tb.read(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _hybrid(spark: SparkSession, sf: str, k: int = 50) -> DataFrame:
    docs = tb.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = tb.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return op.hybrid_search(docs, vectors, _fields(spark, sf), _query_vector(spark, sf), WORDS, k=k)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_search(spark, sf)


@query(_PICKED)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship, 50 slots of a pool of 100 (its own limits)."""
    return _hybrid(spark, sf).select("id", "slot", F.round("final_score", 6).alias("final_score"), "match_type")


def _indexes(spark: SparkSession, sf: str, reviewed: DataFrame) -> tuple[cells.Cells, str]:
    """Both indexes of the reviewed rows, in the shared folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/marginalia/indexes-{uuid.uuid4().hex}"
    docs = tb.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = tb.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return cells.build(vectors.join(reviewed, "id", "left_semi"), f"{base}/cells"), postings.build(docs.join(reviewed, "id", "left_semi"), f"{base}/words")


@query(_PICKED)
def indexed_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship's rows from stored indexes: cells read as far as the bound asks, postings of the query's words."""
    fields = _fields(spark, sf)
    index, words = _indexes(spark, sf, written(fields.filter("n_reviews > 0").select("id"), "reviewed"))  # read by each step of both
    by_vector = cells.nearest(index, spark, _query_vector(spark, sf), 100, exact=True)
    return op.ranked_pool(by_vector, postings.search(spark, words, WORDS, 100), fields).select("id", "slot", F.round("final_score", 6).alias("final_score"), "match_type")


@query()
def nearest_by_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest of every 50th vector (a set of queries), over the cells nearest to each; its recall is tested against exact search."""
    vectors = tb.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = cells.build(vectors, f"{checkpoint_dir(spark).rstrip('/')}/marginalia/cells-{uuid.uuid4().hex}")
    return cells.nearest_of_all(index, vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), 20)


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM documents)
  SELECT doc_id, list_has_all(t, ['the', 'and', 'of']) AS all_terms FROM t WHERE list_has_any(t, ['the', 'and', 'of'])""")
def indexed_term_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold any or all of the query's terms, from the postings of those terms alone."""
    docs = tb.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    path = postings.build(docs, f"{checkpoint_dir(spark).rstrip('/')}/marginalia/words-{uuid.uuid4().hex}")
    some, every = (postings.matching(spark, path, ["the", "and", "of"], every=e) for e in (False, True))
    both = some.join(every.withColumn("all_terms", F.lit(True)), "id", "left")
    return both.select(F.col("id").alias("doc_id"), F.coalesce("all_terms", F.lit(False)).alias("all_terms"))


@query(f"""WITH {_FIELDS}, rev AS (SELECT id FROM fields WHERE n_reviews > 0), {_VEC} SELECT round(avg(cosine) FILTER (WHERE vector_rank <= 5), 6) AS mean_cosine,
  CASE WHEN avg(cosine) FILTER (WHERE vector_rank <= 5) >= 0.93 THEN 'strong' WHEN avg(cosine) FILTER (WHERE vector_rank <= 5) >= 0.9 THEN 'moderate' ELSE 'weak' END AS level FROM vec""")
def retrieval_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cosine of the first five."""
    vectors = tb.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(_fields(spark, sf).filter("n_reviews > 0"), "id", "left_semi")
    return op.confidence(op.nearest(vectors, _query_vector(spark, sf), 100))


@query("""SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(e, q) DESC, vec_id)::INT AS vector_rank, round(list_dot_product(e, q) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(q, q)), 6) AS cosine
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS q FROM embeddings) ORDER BY list_dot_product(e, q) DESC, vec_id LIMIT 20""")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Exact nearest neighbours, the 20 first."""
    top = op.nearest(tb.read(spark, sf, "embeddings"), _query_vector(spark, sf), 20, "vec_id")
    return top.select(F.col("id").alias("vec_id"), "vector_rank", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {tb.PAPERS}, f AS (SELECT * FROM papers WHERE venue = '1-URGENT' AND year = 1997) SELECT id, year, venue, decision, (SELECT count(*) FROM f) AS total FROM f ORDER BY year DESC, id LIMIT 20 OFFSET 20""")
def list_papers(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a filtered list (a page is the operator's limit)."""
    rows = tb.papers(spark, sf)
    return op.list_papers(rows, venue="1-URGENT", year=1997, limit=20, offset=20).select("id", "year", "venue", "decision", "total")


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM documents)
  SELECT doc_id FROM t WHERE list_has_all(t, ['the', 'and', 'of'])""")
def match_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold every query term."""
    d = tb.read(spark, sf, "documents")
    q = F.array(F.lit("the"), F.lit("and"), F.lit("of"))
    return d.filter(T.plain_tsquery_all(T.tokens(F.col("text")), q)).select("doc_id")


@query(f"""WITH {tb.PAPERS}, {tb.REVIEWS} SELECT p.id, coalesce(n, 0) AS n_reviews, n IS NOT NULL AS has_reviews FROM papers p LEFT JOIN (SELECT paper_id, count(*) AS n FROM reviews GROUP BY 1) r ON r.paper_id = p.id""")
def review_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Correlated counts by a pre-aggregated join."""
    n = tb.reviews(spark, sf).groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n"))
    return tb.papers(spark, sf).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_reviews"), F.col("n").isNotNull().alias("has_reviews"))


@query(f"""WITH {tb.PAPERS}, {tb.REVIEWS}, r AS (SELECT paper_id, string_agg(rating::INT || '/' || reviewer_id, ',' ORDER BY rating DESC NULLS LAST, reviewer_id, review_no) AS ratings FROM reviews GROUP BY 1)
  SELECT p.id, c.c_name AS author, r.ratings, 'https://example.org/forum?id=' || p.id AS url FROM papers p LEFT JOIN customer c ON c.c_custkey = p.author_id LEFT JOIN r ON r.paper_id = p.id""")
def paper_details(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with author, ordered reviews and link."""
    parts = F.array_sort(F.collect_list(F.struct((-F.col("rating")).alias("k"), "reviewer_id", "review_no", F.concat_ws("/", F.col("rating").cast("int").cast("string"), F.col("reviewer_id").cast("string")).alias("t"))))
    r = tb.reviews(spark, sf).groupBy(F.col("paper_id").alias("id")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), ",").alias("ratings"))
    c = tb.read(spark, sf, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author"))
    return tb.papers(spark, sf).join(c, "author_id", "left").join(r, "id", "left").select("id", "author", "ratings", T.forum_url("https://example.org/forum?id=", F.lit(None).cast("string"), F.col("id").cast("string")).alias("url"))


@query(f"""WITH {_HYBRID}, sel AS (SELECT id, row_number() OVER (ORDER BY position) AS llm_rank FROM placed WHERE id % 4 = 0 ORDER BY position LIMIT 5)
  SELECT p.id, p.position::INT AS position, s.id IS NOT NULL AS selected, s.llm_rank::INT AS llm_rank FROM placed p LEFT JOIN sel s ON s.id = p.id""")
def candidates_with_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the validated choices among them."""
    docs = tb.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = tb.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    fields = _fields(spark, sf)
    reviewed = fields.filter("n_reviews > 0").select("id")
    found = op.fuse(op.nearest(vectors.join(reviewed, "id", "left_semi"), _query_vector(spark, sf), 100), op.bm25(docs.join(reviewed, "id", "left_semi"), WORDS, 100))
    ranked = op.rerank(found, fields, fields.agg(F.max("year").alias("max_year"))).withColumn("position", F.row_number().over(Window.orderBy(F.desc("final_score"), "id")))
    chosen = ranked.filter("id % 4 = 0").select(F.col("id").alias("paper_id"), F.col("position").alias("pos"), F.lit("high").alias("confidence"), F.lit("").alias("reason"))
    picked = op.validated_selection(chosen, ranked).select(F.col("paper_id").alias("id"), "llm_rank")
    return ranked.join(picked, "id", "left").select("id", "position", F.col("llm_rank").isNotNull().alias("selected"), "llm_rank")


@query("""SELECT label, round(avg(cosine), 6) AS cosine, count(*) AS n FROM (SELECT a.label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY 1""")
def cosine_of_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Cosines of each vector with the next, by label."""
    e = tb.read(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").groupBy("label").agg(F.round(F.avg(R.cosine(F.col("embedding"), F.col("other"))), 6).alias("cosine"), F.count("*").alias("n"))
