"""Entity matching: titles, authors, similarity joins, links between versions of a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marginalia.functions.rank import jaccard
from marginalia.functions.text import normalize_title, trigrams
from marginalia.session import checkpoint_dir


def title_matches(papers: DataFrame, external: DataFrame, min_chars: int = 25) -> DataFrame:
    """(paper_id, ext_id, overlap): the one external record that fits a paper best.

    Titles must be equal once normalised and min_chars long. Records created over a year after the paper's year are out,
    as are those without a common surname where both sides have names. A tie for the largest overlap is no match.
    papers: id, title, year, surnames; external: ext_id, title, created_year, surnames. A later row of external with
    the same ext_id replaces an earlier one.
    """
    p = papers.select(F.col("id").alias("paper_id"), normalize_title(F.col("title")).alias("key"), "year", F.col("surnames").alias("mine")).filter(F.length("key") >= min_chars)
    e = external.select("ext_id", normalize_title(F.col("title")).alias("key"), "created_year", F.col("surnames").alias("theirs"))
    # papers and records that agree in all that counts are one row each here, so a key's copies don't multiply
    kinds = p.select("key", "year", "mine").distinct()
    e = e.groupBy("key", "created_year", "theirs").agg(F.count("*").alias("n"), F.min("ext_id").alias("ext_id"))
    overlap = F.size(F.array_intersect("mine", "theirs"))
    both = kinds.join(e, "key").filter(F.col("created_year").isNull() | (F.col("created_year") <= F.col("year") + 1)).withColumn("overlap", overlap)
    both = both.filter((F.size("mine") == 0) | (F.size("theirs") == 0) | (F.col("overlap") > 0))
    counts = both.groupBy("key", "year", "mine", "overlap").agg(F.sum("n").alias("n"), F.min("ext_id").alias("ext_id"))
    best = counts.groupBy("key", "year", "mine").agg(F.max_by(F.struct("overlap", "n", "ext_id"), "overlap").alias("b")).select(*[F.col(c).alias(f"_{c}") for c in ("key", "year", "mine")], "b.*")
    found = p.join(best, (F.col("key") == F.col("_key")) & F.col("year").eqNullSafe(F.col("_year")) & F.col("mine").eqNullSafe(F.col("_mine")))
    # a paper that comes twice has the best of its rows, and a tie where two of them have it
    found = found.select("paper_id", "overlap", "n", "ext_id").repartition("paper_id").groupBy("paper_id", "overlap").agg(F.sum("n").alias("n"), F.min("ext_id").alias("ext_id"))
    return found.groupBy("paper_id").agg(F.max_by(F.struct("ext_id", "overlap", "n"), "overlap").alias("b")).select("paper_id", "b.*").filter("n = 1").drop("n")


def consume_titles(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Each target title takes the first record that arrives for it: (target_id, ext_id); pages has key and arrival."""
    hit = targets.join(pages, "key")
    return hit.withColumn("n", F.row_number().over(Window.partitionBy("target_id").orderBy("arrival"))).filter("n = 1").select("target_id", "ext_id")


def pairs_by_key(rows: DataFrame, key: str, method: str, confidence: float, *, every: bool = False) -> DataFrame:
    """Links between rows (id, venue, year) of one key that differ in venue or year; null and empty keys aside.

    Each row is linked with the smallest id of every other (venue, year) of its key. So links grow with the rows, each row that
    any other may be linked with has a link, and the same rows reach one another as if all pairs were linked. With every
    all those pairs are given (a < b), whose number grows with the square of a key. Columns: a, b, vy_a, vy_b, method, confidence;
    a pair may come twice.
    """
    mine = rows.filter(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col("id").alias("a"), F.struct("venue", "year").alias("vy_a"), F.col(key).alias("key"))
    other = mine.select(F.col("a").alias("b"), F.col("vy_a").alias("vy_b"), "key")
    if not every:
        other = other.groupBy("key", "vy_b").agg(F.min("b").alias("b"))
    pairs = mine.join(other, "key").filter("vy_a <> vy_b" + (" AND a < b" if every else ""))
    swap = F.col("a") > F.col("b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(either("a", "b").alias("a"), either("b", "a").alias("b"), either("vy_a", "vy_b").alias("vy_a"), either("vy_b", "vy_a").alias("vy_b"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))


def similar_titles(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, sim) with trigram similarity of at least threshold, equal titles as one class.

    A prefix filter makes it a join on rare trigrams: of two sets that are similar enough, the rarest
    n - ceil(t n) + 1 trigrams of each must have one in common. Sizes must agree up to the threshold too.
    """
    titles = rows.select(normalize_title(F.col("title")).alias("norm")).distinct().withColumn("g", trigrams(F.col("norm"))).filter(F.size("g") > 0)
    # written, so that the numbers which stand for titles in all joins stay as they are
    checkpoint_dir(rows.sparkSession)
    titles = titles.withColumn("n", F.monotonically_increasing_id()).checkpoint()
    flat = titles.select("n", F.size("g").alias("size"), F.explode("g").alias("t"))
    often = flat.groupBy("t").agg(F.count("*").alias("df"))
    ranked = flat.join(often, "t").withColumn("i", F.row_number().over(Window.partitionBy("n").orderBy("df", "t")))
    prefix = ranked.filter(F.col("i") <= F.col("size") - F.ceil(threshold * F.col("size")) + 1)
    x, y = prefix.select(F.col("n").alias("a"), "t", F.col("size").alias("sx")), prefix.select(F.col("n").alias("b"), "t", F.col("size").alias("sy"))
    cand = x.join(y, "t").filter((F.col("a") < F.col("b")) & (F.col("sx") >= threshold * F.col("sy")) & (F.col("sy") >= threshold * F.col("sx"))).select("a", "b").distinct()
    gx, gy = titles.select(F.col("n").alias("a"), F.col("norm").alias("na"), F.col("g").alias("ga")), titles.select(F.col("n").alias("b"), F.col("norm").alias("nb"), F.col("g").alias("gb"))
    near = cand.join(gx, "a").join(gy, "b").withColumn("sim", jaccard(F.col("ga"), F.col("gb"))).filter(F.col("sim") >= threshold)
    return near.select(F.least("na", "nb").alias("x"), F.greatest("na", "nb").alias("y"), "sim")


def merged_links(*found: DataFrame) -> DataFrame:
    """Pairs from pairs_by_key(), by methods in falling priority: the first method that has a pair keeps it."""
    out = None
    for n, df in enumerate(found):
        df = df.withColumn("priority", F.lit(n))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("a", "b").agg(F.min_by(F.struct("vy_a", "vy_b", "method", "confidence"), F.struct("priority", -F.col("confidence"))).alias("x")).select("a", "b", "x.*")


def oriented(links: DataFrame, first_venue: str) -> DataFrame:
    """Links from the earlier to the later paper by (year, first_venue before others)."""
    place = lambda c: F.struct(F.col(f"{c}.year"), (F.col(f"{c}.venue") != first_venue).cast("int"))
    keep = place("vy_a") <= place("vy_b")
    return links.select(F.when(keep, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(keep, F.col("b")).otherwise(F.col("a")).alias("later"), "method", "confidence")
