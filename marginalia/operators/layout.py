"""Page layout over tables of text blocks (doc_id, page, x0, y0, x1, y1, text) and rules, without a PDF library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marginalia.functions import text as T


def repeated_blocks(blocks: DataFrame) -> DataFrame:
    """Running heads: texts on at least max(3, 30 %) of the pages of a document of three pages or more."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = blocks.groupBy("doc_id", "text").agg(F.count_distinct("page").alias("n")).join(pages, "doc_id")
    return often.filter((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3.0), 0.3 * F.col("pages")))).select("doc_id", "text", "n")


def without_repeated(blocks: DataFrame) -> DataFrame:
    return blocks.join(repeated_blocks(blocks).select("doc_id", "text"), ["doc_id", "text"], "left_anti")


def line_gap(blocks: DataFrame) -> DataFrame:
    """Half the median line height of each document."""
    return blocks.groupBy("doc_id").agg((F.median(F.col("y1") - F.col("y0")) * 0.5).alias("gap"))


def merged_close(blocks: DataFrame) -> DataFrame:
    """Blocks of one column whose gap is under half the median line height, joined from top to bottom."""
    w = Window.partitionBy("doc_id", "page", "x0").orderBy("y0", "y1")
    rows = blocks.join(line_gap(blocks), "doc_id").withColumn("new", (F.col("y0") - F.lag("y1").over(w) >= F.col("gap")).cast("int"))
    rows = rows.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("y0", "text")))
    return rows.groupBy("doc_id", "page", "x0", "run").agg(F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text")).drop("run")


def horizontal_rules(drawings: DataFrame, page_width: float) -> DataFrame:
    """Flat drawings of 15 % of the page width or more, without those that repeat at one height through a document."""
    flat = drawings.filter((F.col("y1") - F.col("y0") == 0) & (F.col("x1") - F.col("x0") >= 0.15 * page_width)).withColumn("y", F.round("y0", 1))
    pages = drawings.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    again = flat.groupBy("doc_id", "y").agg(F.count_distinct("page").alias("n")).join(pages, "doc_id").filter((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3.0), 0.3 * F.col("pages"))))
    return flat.join(again.select("doc_id", "y"), ["doc_id", "y"], "left_anti")


def captions(blocks: DataFrame) -> DataFrame:
    """Blocks that caption a figure, table or algorithm, with kind and number."""
    kind = F.lower(F.regexp_extract("text", r"(?i)^\s*(figure|table|algorithm)\s+(\d+)", 1))
    number = F.regexp_extract("text", r"(?i)^\s*(figure|table|algorithm)\s+(\d+)", 2)
    mark = F.col("text").rlike(r"(?i)^\s*(?:(?:figure|table)\s+\d+\s*[:.]|algorithm\s+\d+)")
    return blocks.filter(mark).withColumn("kind", kind).withColumn("number", number.cast("int"))


def overlapping(blocks: DataFrame, share: float = 0.8) -> DataFrame:
    """Pairs of blocks of a page whose intersection is at least share of the smaller one."""
    a, b = blocks.alias("a"), blocks.alias("b")
    width = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    height = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    near = a.join(b, F.expr("a.doc_id = b.doc_id AND a.page = b.page AND a.block_id < b.block_id")).filter((width > 0) & (height > 0))
    return near.filter(width * height >= share * F.least(area("a"), area("b"))).select(F.col("a.doc_id").alias("doc_id"), F.col("a.page").alias("page"), F.col("a.block_id").alias("a"), F.col("b.block_id").alias("b"))


def merged_overlaps(blocks: DataFrame, share: float = 0.8) -> DataFrame:
    """(doc_id, page, block_id, x0, y0, x1, y1, text): blocks that overlap by share become one, until none do; captions never merge.

    A merged block has the smallest id, the box around all and their texts from top to bottom. Every round joins a block with
    the smallest it overlaps; pages that are done are compared again at no cost but the join.
    """
    from marginalia.session import checkpoint_dir

    checkpoint_dir(blocks.sparkSession)
    own = F.array(F.struct("y0", "x0", "text")).alias("texts")
    caption = F.coalesce(F.trim("text").rlike(r"(?i)^(figure|table)\s+\d+[:.]"), F.lit(False))
    plain = blocks.select("doc_id", "page", "block_id", "x0", "y0", "x1", "y1", "text", caption.alias("caption"))
    columns = ["doc_id", "page", "block_id", "x0", "y0", "x1", "y1"]
    captions_apart = plain.filter("caption").select(*columns, own)
    rows = plain.filter("NOT caption").select(*columns, own).checkpoint()
    while True:
        into = overlapping(rows, share).groupBy("doc_id", "page", F.col("b").alias("block_id")).agg(F.min("a").alias("into")).checkpoint()
        if into.isEmpty():
            break
        named = rows.join(into, ["doc_id", "page", "block_id"], "left").withColumn("block_id", F.coalesce("into", "block_id"))
        box = (F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        rows = named.groupBy("doc_id", "page", "block_id").agg(*box, F.flatten(F.collect_list("texts")).alias("texts")).checkpoint()
    return rows.select(*columns, "texts").unionByName(captions_apart).withColumn("text", F.array_join(F.transform(F.array_sort("texts"), lambda t: t["text"]), "\n")).drop("texts")


def page_title(spans: DataFrame) -> DataFrame:
    """The title of each document: spans of page 1 in at least 75 % of the largest type, in reading order.

    Spans of one line (tops within 0.6 of the type's size) whose gap is at most 0.15 of it are parts of one word; that takes
    their right ends, the column x1. Others, and spans without x1, are set apart by a blank.
    """
    first = spans.filter("page = 1")
    top = first.groupBy("doc_id").agg(F.max("size").alias("top"))
    big = first.join(top, "doc_id").filter(F.col("size") >= 0.75 * F.col("top"))
    big = big.withColumn("right", F.col("x1") if "x1" in spans.columns else F.lit(None).cast("double"))
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", "text", "right", "size")))

    def add(s: Column, p: Column) -> Column:
        near = (F.abs(p["y0"] - s["y0"]) <= 0.6 * p["size"]) & (p["x0"] - s["right"] <= 0.15 * p["size"])
        glue = F.when(F.coalesce(near, F.lit(False)) | (s["text"] == ""), F.lit("")).otherwise(" ")
        return F.struct(F.concat(s["text"], glue, p["text"]).alias("text"), p["y0"].cast("double").alias("y0"), p["right"].cast("double").alias("right"))

    none = F.lit(None).cast("double")
    text = F.aggregate(parts, F.struct(F.lit("").alias("text"), none.alias("y0"), none.alias("right")), add)["text"]
    return big.groupBy("doc_id").agg(F.regexp_replace(text, r"(\w)- (\p{Ll})", "$1$2").alias("title"))
