"""Statistics: percentiles, venues, base rates, patterns, evaluation, purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia import tables as tb
from marginalia.functions import rank as R
from marginalia.operators import stats
from marginalia.queries.registry import query

r6 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)


@query(f"""WITH {tb.PAPERS} SELECT p.id, round(s.pct, 6) AS percentile FROM papers p LEFT JOIN
  (SELECT id, cume_dist() OVER (PARTITION BY year ORDER BY citation_count) AS pct FROM papers WHERE citation_count IS NOT NULL) s ON s.id = p.id""")
def citation_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the year's papers cited no more often."""
    return stats.citation_percentile(tb.papers(spark, sf)).select("id", r6("percentile").alias("percentile"))


@query(f"""WITH {tb.PAPERS}, {tb.REVIEWS}, pp AS (SELECT paper_id, avg(rating) AS mean, max(rating) AS top FROM reviews GROUP BY 1),
  r AS (SELECT p.*, pp.mean, pp.top, p.decision LIKE 'accept%' AS acc FROM papers p LEFT JOIN pp ON pp.paper_id = p.id),
  s AS (SELECT venue, count(*) AS papers, count(*) FILTER (WHERE acc) AS accept_count, count(*) FILTER (WHERE decision IN ('reject', 'desk-reject')) AS reject_count,
    avg(mean) AS rating_mean, stddev_samp(mean) AS rating_sd, avg(mean) FILTER (WHERE acc) AS accept_rating_mean, avg(mean) FILTER (WHERE NOT acc) AS reject_rating_mean, max(top) AS scale_max FROM r GROUP BY 1),
  b AS (SELECT venue, round_even(mean * 2, 0) / 2 AS bucket, count(*) AS n, avg(acc::INT) AS rate FROM r WHERE mean IS NOT NULL GROUP BY 1, 2),
  h AS (SELECT venue, min(bucket) AS threshold FROM b WHERE n >= 30 AND rate >= 0.5 GROUP BY 1)
  SELECT s.venue, papers, accept_count, reject_count, round(rating_mean, 6) AS rating_mean, round(rating_sd, 6) AS rating_sd, round(accept_rating_mean, 6) AS accept_rating_mean,
    round(reject_rating_mean, 6) AS reject_rating_mean, scale_max, round(accept_count / papers, 6) AS accept_rate, reject_count / (accept_count + reject_count) < 0.15 AS is_coverage_biased,
    CASE WHEN NOT reject_count / (accept_count + reject_count) < 0.15 THEN threshold END AS threshold_50 FROM s LEFT JOIN h ON h.venue = s.venue""")
def venue_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance and ratings by venue."""
    out = stats.venue_stats(tb.papers(spark, sf), tb.reviews(spark, sf))
    return out.select("venue", "papers", "accept_count", "reject_count", *[r6(c).alias(c) for c in ("rating_mean", "rating_sd", "accept_rating_mean", "reject_rating_mean")], "scale_max", r6("accept_rate").alias("accept_rate"), "is_coverage_biased", "threshold_50")


@query(f"""WITH {tb.POINTS}, {tb.REVIEWS}, m AS (SELECT paper_id FROM reviews GROUP BY 1 HAVING bool_and(NOT unsplit)), t AS (SELECT count(*) AS total_papers FROM m)
  SELECT aspect, count(DISTINCT paper_id) AS paper_count, total_papers, round(count(DISTINCT paper_id) / total_papers, 6) AS base_rate
  FROM points SEMI JOIN m USING (paper_id) CROSS JOIN t WHERE sentiment = 'weakness' GROUP BY aspect, total_papers""")
def base_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Aspect base rates over papers whose reviews are all parsed."""
    return stats.base_rates(tb.points(spark, sf), tb.reviews(spark, sf)).withColumn("base_rate", r6("base_rate"))


@query(f"""WITH {tb.POINTS}, {tb.PAPERS}, d AS (SELECT DISTINCT paper_id, aspect FROM points WHERE sentiment = 'weakness' AND aspect <> 'other'),
  t AS (SELECT venue AS area, count(*) AS area_papers FROM papers GROUP BY 1)
  SELECT area, aspect, count(*) AS n, area_papers, round(count(*) / area_papers, 6) AS rate FROM d JOIN papers p ON p.id = d.paper_id JOIN t ON t.area = p.venue GROUP BY area, aspect, area_papers""")
def area_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Aspect rates by area."""
    return stats.area_rates(tb.points(spark, sf), tb.papers(spark, sf)).withColumn("rate", r6("rate"))


_PATTERN_SQL = f"""WITH {tb.POINTS}, {tb.REVIEWS}, {tb.PAPERS}, m AS (SELECT paper_id FROM reviews GROUP BY 1 HAVING bool_and(NOT unsplit)), t AS (SELECT count(*) AS total FROM m),
  base AS (SELECT aspect, count(DISTINCT paper_id) / total AS rate FROM points SEMI JOIN m USING (paper_id) CROSS JOIN t WHERE sentiment = 'weakness' GROUP BY aspect, total),
  near AS (SELECT * FROM points WHERE paper_id IN (SELECT id FROM papers WHERE venue = '1-URGENT' AND year = 1995) AND sentiment = 'weakness'), n AS (SELECT count(DISTINCT paper_id) AS n_papers FROM near),
  mine AS (SELECT id, decision LIKE 'accept%' AS acc FROM papers WHERE id IN (SELECT paper_id FROM near)), tot AS (SELECT count(*) AS decided, count(*) FILTER (WHERE acc) AS decided_acc FROM mine),
  k AS (SELECT aspect, count(*) AS paper_count, count(acc) AS with_n, count(*) FILTER (WHERE acc) AS with_acc FROM (SELECT DISTINCT aspect, paper_id FROM near WHERE aspect <> 'other') x LEFT JOIN mine ON mine.id = x.paper_id GROUP BY 1 HAVING count(*) >= 2),
  f AS (SELECT k.*, n_papers, rate, paper_count / n_papers / rate AS lift, decided - with_n AS without_n, decided_acc - with_acc AS without_acc,
    least(1.0, (SELECT sum(exp(lgamma(n_papers + 1) - lgamma(i + 1) - lgamma(n_papers - i + 1) + i * ln(rate) + (n_papers - i) * ln(1 - rate))) FROM range(paper_count, n_papers + 1) r(i))) AS p_value
    FROM k CROSS JOIN n CROSS JOIN tot JOIN base USING (aspect))
  SELECT aspect, paper_count, n_papers, with_n, with_acc, without_n, without_acc, round(lift, 6) AS lift, round(p_value, 6) AS p_value, lift >= 1.25 AND p_value <= 0.05 AS is_distinctive
  FROM f ORDER BY is_distinctive DESC, lift DESC, paper_count DESC, aspect LIMIT 8"""


@query(_PATTERN_SQL)
def aspect_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Aspects of a neighbourhood against the base rates, the 8 foremost (the report's length)."""
    papers, points = tb.papers(spark, sf), tb.points(spark, sf)
    near = points.filter("sentiment = 'weakness'").join(papers.filter("venue = '1-URGENT' AND year = 1995").select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    out = stats.aspect_patterns(near, stats.base_rates(points, tb.reviews(spark, sf)), papers.select(F.col("id").alias("paper_id"), "decision"))
    return out.select("aspect", "paper_count", "n_papers", "with_n", "with_acc", "without_n", "without_acc", r6("lift").alias("lift"), r6("p_value").alias("p_value"), "is_distinctive")


@query("""WITH g AS (SELECT nationkey, count(*) FILTER (WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING') AS a, count(*) FILTER (WHERE c_acctbal <= 5000 AND c_mktsegment = 'BUILDING') AS b,
    count(*) FILTER (WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING') AS c, count(*) FILTER (WHERE c_acctbal <= 5000 AND c_mktsegment <> 'BUILDING') AS d FROM (SELECT *, c_nationkey AS nationkey FROM customer) GROUP BY 1),
  lf AS (SELECT *, a + b AS r1, a + c AS c1, a + b + c + d AS n FROM g)
  SELECT nationkey, a, b, c, d, round(CASE WHEN r1 = 0 OR c + d = 0 OR c1 = 0 OR b + d = 0 THEN 1.0 ELSE least(1.0, (SELECT sum(exp(lgamma(r1 + 1) - lgamma(i + 1) - lgamma(r1 - i + 1) + lgamma(n - r1 + 1) - lgamma(c1 - i + 1) - lgamma(n - r1 - c1 + i + 1)
    - lgamma(n + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1))) FROM range(greatest(0, c1 - (n - r1)), a + 1) t(i))) END, 6) AS p_value FROM lf""")
def fisher_exact(spark: SparkSession, sf: str) -> DataFrame:
    """One-sided exact test of a two-by-two table for each nation."""
    rich, build = F.col("c_acctbal") > 5000, F.col("c_mktsegment") == "BUILDING"
    g = tb.read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count_if(rich & build).alias("a"), F.count_if(~rich & build).alias("b"), F.count_if(rich & ~build).alias("c"), F.count_if(~rich & ~build).alias("d"))
    return g.withColumn("p_value", r6(R.fisher_lower(F.col("a"), F.col("b"), F.col("c"), F.col("d"))))


@query(f"""WITH {tb.REVIEWS} SELECT paper_id, round(avg(rating), 6) AS avg_rating, count(*) AS n_reviews, max(rating) - min(rating) AS spread FROM reviews GROUP BY 1""")
def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings by paper."""
    return stats.review_summary(tb.reviews(spark, sf)).withColumn("avg_rating", r6("avg_rating"))


@query(f"""WITH {tb.POINTS}, x AS (SELECT DISTINCT paper_id, point_id, from_unsplit, aspect FROM points WHERE sentiment = 'weakness')
  SELECT paper_id, point_id, from_unsplit, aspect FROM x QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY from_unsplit, aspect = 'other', point_id, aspect) <= 2""")
def weaknesses_per_paper(spark: SparkSession, sf: str) -> DataFrame:
    """Two weaknesses of each paper, parsed ones and real aspects first."""
    rows = tb.points(spark, sf).filter("sentiment = 'weakness'").select("paper_id", "point_id", "from_unsplit", "aspect").distinct()
    return stats.top_per_group(rows, ["paper_id"], ["from_unsplit", F.col("aspect") == "other", "point_id", "aspect"], 2)


@query(f"""WITH {tb.POINTS}, p AS (SELECT DISTINCT paper_id AS id, aspect FROM points WHERE sentiment = 'question' AND aspect <> 'other'), t AS (SELECT DISTINCT paper_id AS id, aspect FROM points WHERE sentiment = 'weakness' AND aspect <> 'other'),
  j AS (SELECT coalesce(p.id, t.id) AS id, count(p.id) AS n_pred, count(t.id) AS n_true, count(*) FILTER (WHERE p.id IS NOT NULL AND t.id IS NOT NULL) AS hit FROM p FULL JOIN t ON p.id = t.id AND p.aspect = t.aspect GROUP BY 1 HAVING count(t.id) > 0)
  SELECT id, n_pred, n_true, hit, round(coalesce(hit / nullif(n_pred, 0), 0), 6) AS precision, round(hit / n_true, 6) AS recall, round(2 * hit / (n_pred + n_true), 6) AS f1 FROM j""")
def retrieval_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 of predicted aspect sets."""
    pts = tb.points(spark, sf).filter("aspect <> 'other'").withColumnRenamed("paper_id", "id")
    out = stats.set_scores(pts.filter("sentiment = 'question'"), pts.filter("sentiment = 'weakness'"))
    return out.select("id", "n_pred", "n_true", "hit", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {tb.PAPERS}, {tb.REVIEWS}, {tb.POINTS}, ok AS (SELECT paper_id FROM reviews GROUP BY 1 HAVING NOT bool_or(unsplit)),
  rich AS (SELECT paper_id FROM points WHERE sentiment = 'weakness' AND aspect <> 'other' GROUP BY 1 HAVING count(DISTINCT aspect) >= 2)
  SELECT id, venue FROM papers WHERE id IN (SELECT paper_id FROM ok) AND id IN (SELECT paper_id FROM rich) QUALIFY row_number() OVER (PARTITION BY venue ORDER BY md5(id::VARCHAR || '-7'), id) <= 20""")
def held_out_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A balanced sample (20 a venue, the operator's own limit) in a seeded order."""
    reviews, points = tb.reviews(spark, sf), tb.points(spark, sf)
    rich = points.filter("sentiment = 'weakness' AND aspect <> 'other'").groupBy("paper_id").agg(F.count_distinct("aspect").alias("n")).filter("n >= 2")
    rows = tb.papers(spark, sf).withColumnRenamed("id", "paper_id").join(reviews, "paper_id", "left_semi").join(reviews.filter("unsplit"), "paper_id", "left_anti").join(rich, "paper_id", "left_semi")
    seeded = F.md5(F.concat(F.col("paper_id").cast("string"), F.lit("-7")))
    return stats.top_per_group(rows, ["venue"], [seeded, "paper_id"], 20).select(F.col("paper_id").alias("id"), "venue")


@query(f"""WITH {tb.POINTS}, near AS (SELECT aspect, count(DISTINCT paper_id) AS n FROM points WHERE sentiment = 'weakness' GROUP BY 1), t AS (SELECT count(DISTINCT paper_id) AS total FROM points),
  base AS (SELECT aspect, count(DISTINCT paper_id) / total AS rate FROM points CROSS JOIN t GROUP BY aspect, total)
  SELECT beta::DOUBLE AS beta, aspect, round(n / total / rate ** beta::DOUBLE, 6) AS score FROM near JOIN base USING (aspect) CROSS JOIN t CROSS JOIN (VALUES (0), (0.25), (0.5), (0.75), (1)) b(beta)""")
def beta_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Observed share over base rate to the power of each beta."""
    pts = tb.points(spark, sf)
    total = pts.agg(F.count_distinct("paper_id").alias("total"))
    near = pts.filter("sentiment = 'weakness'").groupBy("aspect").agg(F.count_distinct("paper_id").alias("n"))
    base = pts.groupBy("aspect").agg(F.count_distinct("paper_id").alias("held"))
    betas = spark.createDataFrame([(float(b),) for b in (0, 0.25, 0.5, 0.75, 1)], "beta double")
    rows = near.join(base, "aspect").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(betas))
    return rows.select("beta", "aspect", r6((F.col("n") / F.col("total")) / F.pow(F.col("held") / F.col("total"), F.col("beta"))).alias("score"))


@query(f"""WITH {tb.POINTS}, h AS (SELECT l_suppkey AS sample_id, l_orderkey AS paper_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT sample_id, paper_id, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, paper_id) AS rank FROM h),
  p AS (SELECT DISTINCT paper_id, aspect FROM points WHERE sentiment = 'weakness'), s AS (SELECT sample_id, k, aspect, count(*) AS n, count(*) / least(k, (SELECT count(*) FROM r q WHERE q.sample_id = r.sample_id AND q.rank <= k)) AS share FROM r JOIN p USING (paper_id) JOIN (VALUES (20), (50), (100), (150)) t(k) ON rank <= k GROUP BY sample_id, k, aspect)
  SELECT k, aspect, sum(n)::BIGINT AS papers, round(avg(share), 6) AS share FROM s GROUP BY k, aspect""")
def top_k_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """How often each aspect stands among a sample's first 20, 50, 100 and 150 neighbours."""
    hits = tb.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_orderkey").alias("paper_id")).agg(F.max("l_extendedprice").alias("score"))
    near = hits.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "paper_id")))
    sweep = stats.share_sweep(near, tb.points(spark, sf).filter("sentiment = 'weakness'"), (20, 50, 100, 150))
    return sweep.groupBy("k", "aspect").agg(F.sum("n").alias("papers"), r6(F.avg("share")).alias("share"))


@query("""WITH last AS (SELECT user_id, max(ts) AS last_ts FROM events WHERE event_type = 'view' GROUP BY 1), running AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 400),
  old AS (SELECT e.event_id, e.props FROM events e LEFT JOIN last l USING (user_id) WHERE e.event_type = 'click' AND greatest(e.ts, coalesce(l.last_ts, e.ts)) < TIMESTAMP '2024-01-29' AND e.user_id NOT IN (SELECT user_id FROM running))
  SELECT count(*) AS n, coalesce(sum(length(props)), 0)::BIGINT AS bytes FROM old""")
def purge_expired(spark: SparkSession, sf: str) -> DataFrame:
    """What a retention purge would delete, running jobs aside."""
    ev = tb.read(spark, sf, "events")
    last = ev.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    running = ev.filter("event_type = 'purchase' AND value > 400").select("user_id")
    age = F.greatest("ts", F.coalesce("last_ts", "ts"))
    old = ev.filter("event_type = 'click'").join(last, "user_id", "left").filter(age < F.lit("2024-01-29").cast("timestamp_ntz")).join(running, "user_id", "left_anti")
    return old.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("props")), F.lit(0)).alias("bytes"))


@query(f"""WITH {tb.PAPERS}, {tb.REVIEWS} SELECT 'papers' AS t, count(*) AS n, count(citation_count) AS known FROM papers UNION ALL SELECT 'reviews', count(*), count(rating) FROM reviews""")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of tables."""
    p, r = tb.papers(spark, sf), tb.reviews(spark, sf)
    of = lambda df, name, c: df.agg(F.count("*").alias("n"), F.count(c).alias("known")).select(F.lit(name).alias("t"), "n", "known")
    return of(p, "papers", "citation_count").unionByName(of(r, "reviews", "rating"))


@query(f"""WITH {tb.POINTS}, f AS (SELECT paper_id, aspect, count(*) AS n FROM points WHERE sentiment = 'weakness' AND NOT from_unsplit GROUP BY 1, 2)
  SELECT paper_id, string_agg(aspect || ':' || n, ',' ORDER BY aspect = 'other', n DESC, aspect) AS top FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY aspect = 'other', n DESC, aspect) <= 5) GROUP BY 1""")
def aspect_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """The five aspects a paper is most criticised for, `other` last."""
    f = tb.points(spark, sf).filter("sentiment = 'weakness' AND NOT from_unsplit").groupBy("paper_id", "aspect").agg(F.count("*").alias("n"))
    w = Window.partitionBy("paper_id").orderBy(F.col("aspect") == "other", F.desc("n"), "aspect")
    top = f.withColumn("i", F.row_number().over(w)).filter("i <= 5")
    parts = F.array_sort(F.collect_list(F.struct("i", F.concat_ws(":", "aspect", F.col("n").cast("string")).alias("t"))))
    return top.groupBy("paper_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), ",").alias("top"))
