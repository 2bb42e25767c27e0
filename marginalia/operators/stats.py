"""Statistics of venues and aspects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marginalia.functions.rank import binomial_tail, fisher_lower


def with_cumulative_share(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """rows with the share of their group's rows whose value is no larger (null values aside, which get null).

    Rows are counted by value before anything is sorted, so a window holds a row for each distinct value of a group, and
    the join back reads two plain shuffles, of which Spark can split the hot values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("_n").over(upto) / F.sum("_n").over(Window.partitionBy(group))
    shares = counts.select(F.col(group).alias("_g"), F.col(value).alias("_v"), share.alias(name))
    return rows.join(shares, F.col(group).eqNullSafe(F.col("_g")) & (F.col(value) == F.col("_v")), "left").drop("_g", "_v")


def citation_percentile(papers: DataFrame) -> DataFrame:
    """Papers with their share of the year's papers that are cited no more often; null where the count is unknown."""
    return with_cumulative_share(papers, "year", "citation_count", "percentile")


def venue_stats(papers: DataFrame, reviews: DataFrame, min_bucket: int = 30) -> DataFrame:
    """A row for each venue: acceptance, rating moments by paper, and the first rating bucket accepted half the time."""
    per_paper = reviews.groupBy("paper_id").agg(F.avg("rating").alias("mean"), F.max("rating").alias("top"))
    rows = papers.join(per_paper, papers.id == per_paper.paper_id, "left").withColumn("accepted", F.col("decision").startswith("accept"))
    stats = rows.groupBy("venue").agg(
        F.count("*").alias("papers"), F.count_if("accepted").alias("accept_count"), F.count_if(F.col("decision").isin("reject", "desk-reject")).alias("reject_count"),
        F.avg("mean").alias("rating_mean"), F.stddev_samp("mean").alias("rating_sd"), F.avg(F.when(F.col("accepted"), F.col("mean"))).alias("accept_rating_mean"),
        F.avg(F.when(~F.col("accepted"), F.col("mean"))).alias("reject_rating_mean"), F.max("top").alias("scale_max"),
    )
    buckets = rows.filter("mean IS NOT NULL").groupBy("venue", (F.rint(F.col("mean") * 2) / 2).alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("accepted").cast("double")).alias("rate"))
    half = buckets.filter((F.col("n") >= min_bucket) & (F.col("rate") >= 0.5)).groupBy("venue").agg(F.min("bucket").alias("threshold"))
    decided = F.col("accept_count") + F.col("reject_count")
    biased = F.coalesce(F.try_divide("reject_count", decided), F.lit(0.0)) < 0.15
    out = stats.join(half, "venue", "left").withColumn("is_coverage_biased", biased)
    return out.withColumn("accept_rate", F.col("accept_count") / F.col("papers")).withColumn("threshold_50", F.when(~F.col("is_coverage_biased"), F.col("threshold"))).drop("threshold")


def base_rates(points: DataFrame, reviews: DataFrame) -> DataFrame:
    """For each aspect the share of measurable papers with a point of it; measurable: every review is parsed."""
    measurable = reviews.groupBy("paper_id").agg(F.bool_and(~F.col("unsplit")).alias("ok")).filter("ok").select("paper_id")
    total = measurable.agg(F.count("*").alias("total_papers"))
    rows = points.join(measurable, "paper_id", "left_semi").filter("sentiment = 'weakness'").groupBy("aspect").agg(F.count_distinct("paper_id").alias("paper_count"))
    return rows.crossJoin(F.broadcast(total)).withColumn("base_rate", F.try_divide("paper_count", "total_papers"))


def area_rates(points: DataFrame, papers: DataFrame, area_col: str = "venue") -> DataFrame:
    """For each area and aspect the share of the area's papers with a weakness of it."""
    pairs = points.filter("sentiment = 'weakness' AND aspect <> 'other'").select("paper_id", "aspect").distinct().join(papers.select(F.col("id").alias("paper_id"), F.col(area_col).alias("area")), "paper_id")
    totals = papers.groupBy(F.col(area_col).alias("area")).agg(F.count("*").alias("area_papers"))
    return pairs.groupBy("area", "aspect").agg(F.count("*").alias("n")).join(totals, "area").withColumn("rate", F.col("n") / F.col("area_papers"))


def aspect_patterns(points: DataFrame, base: DataFrame, decisions: DataFrame, *, min_papers: int = 2, top: int = 8) -> DataFrame:
    """Aspects that a set of papers is criticised for: lift over the base rate, exact tests, contrast of acceptance.

    An aspect is distinctive if its lift is 1.25 or more and the chance of as many papers at the base rate is 0.05 or
    less. `other` is out; papers of unknown decision count in neither side of the contrast, withdrawn ones as not accepted.
    """
    n = points.agg(F.count_distinct("paper_id").alias("n_papers"))
    held = points.filter("aspect <> 'other'").select("aspect", "paper_id").distinct()
    known = decisions.filter("decision IS NOT NULL AND decision <> 'unknown'").select("paper_id", F.col("decision").startswith("accept").alias("acc"))
    mine = known.join(points.select("paper_id").distinct(), "paper_id", "left_semi")
    total = mine.agg(F.count("*").alias("decided"), F.count_if("acc").alias("decided_acc"))
    rows = held.join(known, "paper_id", "left").groupBy("aspect").agg(F.count("*").alias("paper_count"), F.count("acc").alias("with_n"), F.count_if("acc").alias("with_acc"))
    rows = rows.filter(F.col("paper_count") >= min_papers).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total)).join(base.select("aspect", "base_rate"), "aspect", "left")
    rows = rows.withColumn("lift", F.try_divide(F.col("paper_count") / F.col("n_papers"), F.col("base_rate"))).withColumn("p_value", F.coalesce(binomial_tail(F.col("paper_count"), F.col("n_papers"), F.col("base_rate")), F.lit(1.0)))
    rows = rows.withColumn("is_distinctive", F.coalesce((F.col("lift") >= 1.25) & (F.col("p_value") <= 0.05), F.lit(False)))
    without_n, without_acc = F.col("decided") - F.col("with_n"), F.col("decided_acc") - F.col("with_acc")
    rows = rows.withColumns({"without_n": without_n, "without_acc": without_acc})
    rows = rows.withColumn("contrast_p", fisher_lower(F.col("with_acc"), F.col("with_n") - F.col("with_acc"), F.col("without_acc"), F.col("without_n") - F.col("without_acc")))
    return rows.orderBy(F.desc("is_distinctive"), F.desc(F.coalesce("lift", F.lit(0.0))), F.desc("paper_count"), "aspect").limit(top)


def examples(points: DataFrame, cap: int = 3) -> DataFrame:
    """Up to cap texts of each aspect, one a paper, parsed ones and longer ones first."""
    one = Window.partitionBy("aspect", "paper_id").orderBy(F.col("from_unsplit").cast("int"), F.desc(F.length("text")), "point_id")
    few = Window.partitionBy("aspect").orderBy(F.col("from_unsplit").cast("int"), F.desc(F.length("text")), "paper_id")
    rows = points.filter("aspect <> 'other' AND text <> ''").withColumn("n", F.row_number().over(one)).filter("n = 1")
    return rows.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= cap)


def review_summary(reviews: DataFrame) -> DataFrame:
    """Per paper: mean rating, number of reviews, spread of the known ratings."""
    return reviews.groupBy("paper_id").agg(F.avg("rating").alias("avg_rating"), F.count("*").alias("n_reviews"), (F.max("rating") - F.min("rating")).alias("spread"))


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def set_scores(pred: DataFrame, truth: DataFrame, key: str = "id", item: str = "aspect") -> DataFrame:
    """Precision, recall and F1 of predicted against true items for each key of truth."""
    p = pred.select(key, item).distinct().withColumn("p", F.lit(1))
    t = truth.select(key, item).distinct().withColumn("t", F.lit(1))
    both = p.join(t, [key, item], "full_outer").groupBy(key).agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count(F.col("p") * F.col("t")).alias("hit"))
    both = both.filter("n_true > 0")
    pr, rc = F.coalesce(F.try_divide("hit", "n_pred"), F.lit(0.0)), F.col("hit") / F.col("n_true")
    return both.select(key, "n_pred", "n_true", "hit", pr.alias("precision"), rc.alias("recall"), F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"))


def share_sweep(neighbours: DataFrame, points: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(sample_id, k, aspect, n, share): of the first k neighbours of a sample, how many have a point of each aspect, for every k at once.

    neighbours: sample_id, paper_id, rank from 1; points: paper_id, aspect. One join serves all k; a sample with fewer than k
    neighbours divides by those it has, and aspects that none of the k has are left out.
    """
    near = neighbours.filter(F.col("rank") <= max(ks))
    sizes = near.groupBy("sample_id").agg(F.count("*").alias("held"))
    first = lambda k: F.count_if(F.col("rank") <= k)
    counts = near.join(points.select("paper_id", "aspect").distinct(), "paper_id").groupBy("sample_id", "aspect").agg(F.array(*[F.struct(F.lit(k).alias("k"), first(k).alias("n")) for k in ks]).alias("by_k"))
    rows = counts.join(sizes, "sample_id").select("sample_id", "aspect", "held", F.explode("by_k").alias("x")).select("sample_id", "x.k", "aspect", "x.n", "held")
    return rows.filter("n > 0").select("sample_id", "k", "aspect", "n", (F.col("n") / F.least("held", "k")).alias("share"))
