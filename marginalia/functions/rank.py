"""Ranking formulas, similarities and exact tests as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RRF_K = 60
# Weights of similarity, recency and citations, and the half-life in years, by preset.
PRESETS = {"balanced": (0.35, 0.45, 0.20, 3.0), "recent": (0.30, 0.50, 0.20, 2.0), "cited": (0.30, 0.45, 0.25, 4.0)}


def preset(name: str | None) -> tuple[float, float, float, float]:
    return PRESETS.get(name or "", PRESETS["balanced"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def rrf(rank: Column) -> Column:
    return F.coalesce(1.0 / (RRF_K + rank), F.lit(0.0))


def max_rrf(retrievers: int) -> float:
    return retrievers / (RRF_K + 1)


def recency(year: Column, newest: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(newest - year, F.lit(0)) / half_life)


def final_score(rrf_sum: Column, year: Column, newest: Column, percentile: Column, weights: tuple[float, float, float, float], retrievers: int = 2) -> Column:
    """Weighted similarity, recency and citations; an unknown year counts as the newest, an unknown percentile as 0.5."""
    sim, rec, cit, half_life = weights
    similarity = F.least(rrf_sum / max_rrf(retrievers), F.lit(1.0))
    return sim * similarity + rec * recency(F.coalesce(year, newest), newest, half_life) + cit * F.coalesce(percentile, F.lit(0.5))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def image_similarity(a: Column, b: Column) -> Column:
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return 1 - F.try_divide(apart, F.size(a) * 255)


def _log_choose(n: Column, k: Column) -> Column:
    low = F.least(k, n - k)
    return F.when(low > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(low, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log((n - low + i) / i))).otherwise(F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for n trials of chance p, k over n counting as n; 1 where n or p is not valid."""
    k, n = F.least(k.cast("int"), n.cast("int")), n.cast("int")
    first = _log_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("log"))
    # each term from the one before: the last step's logarithm of zero is null and never used
    step = lambda s, i: F.struct((s["sum"] + F.exp(s["log"])).alias("sum"), (s["log"] + F.log((n - i) / (i + 1)) + F.log(p / (1 - p))).alias("log"))
    total = F.aggregate(F.sequence(k, n), start, step)["sum"]
    return F.when((n <= 0) | (p <= 0) | (p >= 1) | (k <= 0), F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def fisher_lower(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided exact test of the table [[a, b], [c, d]]: the chance of at most a; 1 where a margin is zero."""
    a, b, c, d = (x.cast("int") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    low = F.greatest(F.lit(0), col - (c + d))
    first = _log_choose(row, a) + _log_choose(c + d, col - a) - _log_choose(n, col)
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("log"))
    # downwards from a, each term from the one before; the last step's logarithm of zero is null and never used
    less = lambda i: F.log(i) + F.log(c + d - col + i) - F.log(row - i + 1) - F.log(col - i + 1)
    step = lambda s, i: F.struct((s["sum"] + F.exp(s["log"])).alias("sum"), (s["log"] + less(i)).alias("log"))
    total = F.aggregate(F.sequence(a, F.least(low, a)), start, step)["sum"]
    return F.when((row == 0) | (c + d == 0) | (col == 0) | (b + d == 0), F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def confidence_level(mean: Column) -> Column:
    return F.when(mean >= 0.93, "strong").when(mean >= 0.90, "moderate").otherwise("weak")
