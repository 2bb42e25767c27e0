"""Hybrid retrieval: exact vector search, BM25, reciprocal-rank fusion, reranking and folding of duplicates.

The rows that are ranked after the two searches number twice the pool at most, so the windows over them are small at any
corpus size; the searches themselves are a scan with a top-k for each task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from marginalia.functions import rank as R
from marginalia.functions.text import tokens

K1, BM25_B = 1.2, 0.75


def list_papers(papers: DataFrame, *, venue: str | None = None, year: int | None = None, area: str | None = None, words: Sequence[str] = (), limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the papers that pass every filter given, with the total before paging."""
    out = papers
    for name, value in (("venue", venue), ("year", year), ("area", area)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    for word in words:
        out = out.filter(F.array_contains(tokens(F.col("title")), word))
    total = out.agg(F.count("*").alias("total"))
    return out.orderBy(F.desc("year"), "id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, cosine, vector_rank): the k nearest rows by exact cosine, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), R.cosine(F.col(vector_col), q).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k)
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "id")))


def _count(word: str):
    return F.size("t") - F.size(F.array_remove("t", word))


def bm25(docs: DataFrame, words: Sequence[str], k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score, fts_rank): the k best texts that hold any of the words."""
    words = sorted(w for w in set(words) if re.fullmatch("[a-z0-9]+", w))

    def counts(rows: DataFrame) -> DataFrame:
        held = rows.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
        return held.select("id", F.size("t").alias("len"), *[_count(w).alias(f"tf{i}") for i, w in enumerate(words)])

    stats = counts(docs).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len")))
    score = sum((part(i) for i in range(len(words))), F.lit(0.0))
    # on the text itself: a filter on the counts would be pushed below them, with the tokens worked out anew for each word
    any_of = F.lower(text_col).rlike(f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])") if words else F.lit(False)
    top = counts(docs.filter(any_of)).crossJoin(F.broadcast(stats)).select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("fts_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(by_vector: DataFrame, by_words: DataFrame) -> DataFrame:
    """Candidates of either search with both ranks, their fused score and the kind of match."""
    both = by_vector.join(by_words, "id", "full_outer")
    kind = F.when(F.col("fts_rank").isNull(), "semantic").when(F.col("vector_rank").isNull(), "lexical").otherwise("both")
    return both.withColumn("rrf", R.rrf(F.col("vector_rank")) + R.rrf(F.col("fts_rank"))).withColumn("match_type", kind)


def rerank(candidates: DataFrame, fields: DataFrame, newest: DataFrame, preset: str = "balanced") -> DataFrame:
    """Candidates with final_score; fields has id, year, percentile, norm_title, venue, n_reviews, newest one row max_year."""
    ranked = candidates.join(fields, "id", "left").crossJoin(F.broadcast(newest))
    return ranked.withColumn("final_score", F.round(R.final_score(F.col("rrf"), F.col("year"), F.col("max_year"), F.col("percentile"), R.preset(preset)), 9))


def fold_duplicates(ranked: DataFrame, k: int) -> DataFrame:
    """k slots in ranked order (position), one for each (norm_title, venue), held by its member with most reviews.

    Rows without a title are never folded. Only members that stand before the first row past the k-th slot compete.
    """
    key = F.when(F.col("norm_title").isNull(), F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(F.concat_ws("\x1f", "norm_title", "venue"))
    rows = ranked.withColumn("fold", key)
    rows = rows.withColumn("slot_at", F.min("position").over(Window.partitionBy("fold")))
    rows = rows.withColumn("slot", F.dense_rank().over(Window.orderBy("slot_at")))  # of a pool, which is small at any corpus size
    rows = rows.withColumn("cut", F.min(F.when(F.col("slot") > k, F.col("position"))).over(Window.partitionBy()))
    best = Window.partitionBy("fold").orderBy(F.desc(F.coalesce("n_reviews", F.lit(0))), "position")
    out = rows.filter(F.col("cut").isNull() | (F.col("position") < F.col("cut"))).withColumn("pick", F.row_number().over(best))
    return out.filter("pick = 1").drop("fold", "slot_at", "cut", "pick")


def preferred(preferences: DataFrame) -> DataFrame:
    """preferences with the columns w_similarity, w_recency, w_citations and half_life of their focus; unknown ones are balanced."""
    weights = lambda i: F.coalesce(*[F.when(F.col("focus") == name, F.lit(w[i])) for name, w in R.PRESETS.items()], F.lit(R.preset(None)[i]))
    return preferences.withColumns({c: weights(i) for i, c in enumerate(("w_similarity", "w_recency", "w_citations", "half_life"))})


def rerank_preferred(candidates: DataFrame, fields: DataFrame, newest: DataFrame, preferences: DataFrame) -> DataFrame:
    """Candidates (query_id, id, rrf) with final_score and position by the preference of their query (query_id, focus).

    A query without a preference is balanced. The windows hold one query's pool each.
    """
    known = preferred(candidates.select("query_id").distinct().join(preferences.select("query_id", "focus"), "query_id", "left"))
    ranked = candidates.join(known, "query_id").join(fields, "id", "left").crossJoin(F.broadcast(newest))
    weights = tuple(F.col(c) for c in ("w_similarity", "w_recency", "w_citations", "half_life"))
    score = R.final_score(F.col("rrf"), F.col("year"), F.col("max_year"), F.col("percentile"), weights)
    ranked = ranked.withColumn("final_score", F.round(score, 9))
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "id")))


def hybrid_search(docs: DataFrame, vectors: DataFrame, fields: DataFrame, query: list[float], words: Sequence[str], *, k: int = 50, pool: int = 100, preset: str = "balanced") -> DataFrame:
    """The whole search: docs (id, text), vectors (id, embedding), fields as in rerank; docs without reviews don't count."""
    reviewed = fields.filter("n_reviews > 0").select("id")
    found = nearest(vectors.join(reviewed, "id", "left_semi"), query, pool), bm25(docs.join(reviewed, "id", "left_semi"), words, pool)
    return ranked_pool(*found, fields, k=k, preset=preset)


def ranked_pool(by_vector: DataFrame, by_words: DataFrame, fields: DataFrame, *, k: int = 50, preset: str = "balanced") -> DataFrame:
    """k slots of what two searches found, by scans or by indexes: fused, reranked, duplicates folded."""
    found = fuse(by_vector, by_words)
    ranked = rerank(found, fields, fields.agg(F.max("year").alias("max_year")), preset)
    ranked = ranked.withColumn("position", F.row_number().over(Window.orderBy(F.desc("final_score"), "id")))
    return fold_duplicates(ranked, k)


def confidence(by_vector: DataFrame, top: int = 5) -> DataFrame:
    """One row: mean cosine of the first ranks and its level; no rows give 0 and weak."""
    mean = F.coalesce(F.avg(F.when(F.col("vector_rank") <= top, F.col("cosine"))), F.lit(0.0))
    return by_vector.agg(F.round(mean, 6).alias("mean_cosine"), R.confidence_level(mean).alias("level"))


def validated_selection(selections: DataFrame, candidates: DataFrame, cap: int = 5) -> DataFrame:
    """LLM choices (pos, paper_id, confidence, reason) cut to known papers, first mention each, cap rows, renumbered."""
    known = selections.join(candidates.select(F.col("id").alias("paper_id")).distinct(), "paper_id", "left_semi")
    first = known.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("pos"))).filter("n = 1")
    level = F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("low")
    return first.withColumn("llm_rank", F.row_number().over(Window.orderBy("pos"))).filter(F.col("llm_rank") <= cap).select("paper_id", "llm_rank", level.alias("confidence"), F.substring("reason", 1, 300).alias("reason"))


def evidence_pool(points: DataFrame, metas: DataFrame, per_paper: int = 2, metas_cap: int = 3) -> DataFrame:
    """Labels E1.. for weaknesses (two a paper, parsed ones and real aspects first), M1.. for meta reviews, texts cut."""
    order = Window.partitionBy("paper_rank").orderBy(F.col("from_unsplit").cast("int"), (F.col("aspect") == "other").cast("int"), "point_id")
    picked = points.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_paper)
    e = picked.withColumn("i", F.row_number().over(Window.orderBy("paper_rank", "n"))).select(F.concat(F.lit("E"), "i").alias("label"), "paper_rank", F.substring("text", 1, 400).alias("text"))
    m = metas.filter(F.trim("text") != "").withColumn("i", F.row_number().over(Window.orderBy("paper_rank"))).filter(F.col("i") <= metas_cap)
    return e.unionByName(m.select(F.concat(F.lit("M"), "i").alias("label"), "paper_rank", F.substring("text", 1, 700).alias("text")))
