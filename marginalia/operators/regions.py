"""Regions of pages that belong to figures, tables, algorithms, equations and boxes, and the text without them.

Tables: blocks (doc_id, page, block_id, x0, y0, x1, y1, text), lines (the same, a block's single lines), shapes (doc_id, page, x0, y0, x1,
y1, image), rules (doc_id, page, y, x0, x1), fills (doc_id, page, x0, y0, x1, y1). y grows downwards. Regions are
(doc_id, page, top, bottom, x0, x1, label). What a scan down a page can be said of by windows and joins on the page is; rules that
are used up and equations that grow line by line are worked off page by page in tasks. A page is a small group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions import text as T
from marginalia.operators.layout import without_repeated

# Captions, line numbers, equation numbers and the measures of a page.
CAPTION, ALGORITHM = r"(?i)^(figure|table)\s+(\d+)[:.]", r"(?i)^algorithm\s+(\d+)\b"
LINE_NUMBERS, EQUATION = r"^\d{1,4}(\s+\d{1,4})*$", r"^\((\d{1,3})\)$"
PROSE_WORDS, LABEL_WORDS, CELL_WORDS, LINE_WORDS = 20, 10, 8, 6
LINE_HEIGHT, GAP, MERGE_GAP = 12.0, 1.5, 0.5
SHAPE, EDGE, PROSE_WIDTH, MARGIN, MORE_LINES = 2.0, 3.0, 0.3, 8.0, 3
BOX_WIDTH, BOX_HEIGHT, BOX_GAP = 0.5, 20.0, 1.0
MAX_PAGES = 60

PAGE = ["doc_id", "page"]
_REGION = "doc_id {}, page int, top double, bottom double, x0 double, x1 double, label string"


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def _told(blocks: DataFrame) -> DataFrame:
    """Blocks with flat text, number of words, whether they are line numbers alone, and the height of their lines."""
    flat = T.flatten_block(F.col("text"))
    words = F.size(F.filter(F.split(flat, r"\s+"), lambda w: w != ""))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    height = F.when((lines >= 2) & (F.col("y1") > F.col("y0")), (F.col("y1") - F.col("y0")) / lines)
    return blocks.withColumn("flat", flat).withColumn("words", words).withColumn("numbers", F.col("flat").rlike(LINE_NUMBERS)).withColumn("line", height)


def line_heights(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line): the median height of a line in blocks of two lines or more, 12 where there is none."""
    return _told(blocks).groupBy(*keys).agg(F.coalesce(F.median("line"), F.lit(LINE_HEIGHT)).alias("line"))


def figure_regions(blocks: DataFrame, shapes: DataFrame, bottoms: DataFrame, page_width: float) -> DataFrame:
    """What belongs to each `Figure N` caption: from the last prose, caption or table above it, or its drawings' top, to its end.

    bottoms: doc_id, page, bottom of tables. Prose has over 20 words; prose beside a caption counts as far as that caption's
    top. Drawings between the last caption or table and this one tell the top and the width (the page's where there are none);
    labels of at most ten words close to them, above and at both sides, belong to them, as does the caption.
    """
    told = _told(blocks)
    caption = F.lower(F.regexp_extract("flat", CAPTION, 1)) == "figure"
    prose = (F.col("words") > PROSE_WORDS) & ~F.col("numbers") & ~caption
    caps = told.filter(caption).select(*PAGE, F.col("y0").alias("c0"), F.col("y1").alias("c1"))
    beside = told.filter(prose).join(caps, PAGE).filter(_overlap(F.col("y0"), F.col("y1"), F.col("c0"), F.col("c1")) > 0).groupBy(*PAGE, "block_id").agg(F.min("c0").alias("until"))
    # a sweep: tables' bottoms and blocks from the top of the page down, bottoms first
    events = told.join(beside, [*PAGE, "block_id"], "left").select(*PAGE, "block_id", F.lit(1).alias("kind"), "y0", "y1", "x0", "x1", caption.alias("caption"), F.when(prose, F.least("y1", "until")).alias("prose"), F.regexp_extract("flat", CAPTION, 2).alias("number"))
    events = events.unionByName(bottoms.select(*PAGE, F.lit(0).alias("kind"), F.col("bottom").alias("y0")), allowMissingColumns=True)
    before = Window.partitionBy(*PAGE).orderBy("y0", "kind", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    swept = events.withColumn("run", F.coalesce(F.count_if("caption").over(before), F.lit(0))).withColumn("table", F.max(F.when(F.col("kind") == 0, F.col("y0"))).over(before)).withColumn("above", F.last(F.when(F.col("caption"), F.col("y1")), True).over(before))
    swept = swept.withColumn("text_end", F.max("prose").over(Window.partitionBy(*PAGE, "run").orderBy("y0", "kind", "block_id").rowsBetween(Window.unboundedPreceding, -1)))
    found = swept.filter("caption").select(*PAGE, "block_id", "y0", "y1", F.col("x0").alias("own0"), F.col("x1").alias("own1"), "number", F.greatest("table", "above", F.lit(0.0)).alias("floor"), F.greatest("table", "above", "text_end", F.lit(0.0)).alias("top"))
    key = [*PAGE, "block_id"]

    def held(cond: Column, other: DataFrame, **values: Column) -> DataFrame:
        """found with aggregates of the page's other rows for which cond holds; null where there are none."""
        near = found.join(other, PAGE).filter(cond).groupBy(*key).agg(*[v.alias(n) for n, v in values.items()])
        return found.join(near, key, "left")

    drawn = shapes.filter(F.col("image") | ((F.col("x1") - F.col("x0") >= SHAPE) & (F.col("y1") - F.col("y0") >= SHAPE))).select(*PAGE, *[F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")])
    found = held((F.col("s_y1") > F.col("floor")) & (F.col("s_y0") < F.col("y0")), drawn, drawn_top=F.min("s_y0")).withColumn("top", F.coalesce("drawn_top", "top")).drop("drawn_top")
    found = held((F.col("s_y1") > F.col("top")) & (F.col("s_y0") < F.col("y1")), drawn, x0=F.min("s_x0"), x1=F.max("s_x1"))
    found = found.withColumns({"x0": F.coalesce("x0", F.lit(0.0)), "x1": F.coalesce("x1", F.lit(float(page_width)))}).join(line_heights(blocks, PAGE).withColumn("near", GAP * F.col("line")).drop("line"), PAGE)
    labels = told.filter((F.col("words") > 0) & (F.col("words") <= LABEL_WORDS) & ~F.col("numbers")).select(*PAGE, *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    gap = F.col("top") - F.col("l_y1")
    above = gap.between(0, F.col("near")) & (F.col("l_y0") >= F.col("floor")) & (_overlap(F.col("l_x0"), F.col("l_x1"), F.col("x0"), F.col("x1")) > 0)
    found = held(above, labels, header=F.min("l_y0")).withColumn("top", F.coalesce("header", "top")).drop("header")
    level = _overlap(F.col("l_y0"), F.col("l_y1"), F.col("top"), F.col("y1")) > 0
    left, right = (F.col("x0") - F.col("l_x1")).between(0, F.col("near")), (F.col("l_x0") - F.col("x1")).between(0, F.col("near"))
    found = held(level & (left | right), labels, left=F.min(F.when(left, F.col("l_x0"))), right=F.max(F.when(right, F.col("l_x1"))))
    x0, x1 = F.least(F.coalesce("left", "x0"), "own0"), F.greatest(F.coalesce("right", "x1"), "own1")
    return found.select(*PAGE, "top", F.col("y1").alias("bottom"), x0.alias("x0"), x1.alias("x1"), F.concat(F.lit("Figure "), "number").alias("label"))


def _meets(a0: float, a1: float, b0: float, b1: float) -> bool:
    return min(a1, b1) > max(a0, b0)


def _assign_rules(captions: list[dict], rules: list[tuple[float, float, float]], height: float, width: float, near: float) -> Iterator[tuple]:
    """(top, bottom, x0, x1, label) of a page's captions, from the top down; a rule belongs to one caption at a place of the line."""
    free, done = sorted(rules), set()
    for c in (c for c in captions if c["kind"] != "figure"):
        if c["label"] in done:
            continue
        others = [o for o in captions if o["label"] != c["label"]]
        ceiling = max((o["y1"] for o in others if o["y1"] < c["y0"]), default=0.0)
        following = min((o["y0"] for o in others if o["y0"] > c["y0"]), default=None)
        ys = sorted({y for y, _, _ in free})
        below = [y for y in ys if c["y0"] <= y <= (height if following is None else following) and (following is None or following - y > near)]
        above = [] if c["kind"] == "algorithm" else [y for y in ys if ceiling <= y <= c["y0"]]
        down, up = (below[0] - c["y0"] if len(below) > 1 else None), (c["y0"] - above[-1] if len(above) > 1 else None)
        if down is not None and (up is None or down <= up):
            end = below[1] if c["kind"] == "algorithm" else below[-1]
            span, taken = (c["y0"], end), {y for y in below if y <= end}
        elif up is not None:
            span, taken = (above[0], c["y1"]), set(above)
        else:
            continue
        done.add(c["label"])
        yield *span, 0.0, width, c["label"]
        used = [r for r in rules if r[0] in taken and _meets(r[1], r[2], c["x0"], c["x1"])]
        free = [r for r in free if not any(u[0] == r[0] and _meets(r[1], r[2], u[1], u[2]) for u in used)]


def ruled_regions(blocks: DataFrame, rules: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Regions of `Table N` and `Algorithm N` captions between the horizontal rules that are theirs.

    The rules below a caption, as far as the next caption, or those above it, whichever are closer; two at least. An
    algorithm's are the first two below it. Rules that a caption above or beside has used up are gone. A page's captions and
    rules are worked off in one task; rules that repeat at one height through a document should be left out before.
    """
    told = _told(blocks)
    kind = F.when(F.col("flat").rlike(CAPTION), F.lower(F.regexp_extract("flat", CAPTION, 1))).when(F.col("flat").rlike(ALGORITHM), F.lit("algorithm"))
    number = F.coalesce(F.nullif(F.regexp_extract("flat", CAPTION, 2), F.lit("")), F.regexp_extract("flat", ALGORITHM, 1))
    caps = told.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("label", F.concat(F.initcap("kind"), F.lit(" "), number))
    caps = caps.join(line_heights(blocks, PAGE).withColumn("near", GAP * F.col("line")).drop("line"), PAGE)
    both = caps.select(*PAGE, "block_id", "kind", "label", "near", "x0", "y0", "x1", "y1").unionByName(rules.select(*PAGE, F.lit("rule").alias("kind"), "x0", "x1", F.round("y", 1).alias("y0")), allowMissingColumns=True)
    schema = _REGION.format(blocks.schema["doc_id"].dataType.simpleString())

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = pdf[pdf["kind"] == "rule"]
        mine = pdf[pdf["kind"] != "rule"].sort_values(["y0", "block_id"], kind="stable")
        if mine.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        out = _assign_rules(mine.to_dict("records"), list(lines[["y0", "x0", "x1"]].itertuples(index=False, name=None)), page_height, page_width, float(mine["near"].iloc[0]))
        return pd.DataFrame([(pdf["doc_id"].iloc[0], pdf["page"].iloc[0], *r) for r in out], columns=[c.split()[0] for c in schema.split(", ")])

    return both.groupBy(*PAGE).applyInPandas(page, schema)


def _grow_equations(lines: list[dict], left: float, right: float, width: float) -> Iterator[tuple]:
    """(top, bottom, x0, x1, label) of the numbered equations of a page, whose lines come from the top down."""
    heights = sorted(x["y1"] - x["y0"] for x in lines if x["y1"] > x["y0"])
    middle = len(heights) // 2
    line = LINE_HEIGHT if not heights else heights[middle] if len(heights) % 2 else (heights[middle - 1] + heights[middle]) / 2
    inner = [x for x in lines if x["x1"] > left]  # the others are line numbers in the margin
    marks = [x for x in lines if x["number"] and abs(x["x1"] - right) <= EDGE]

    def is_prose(x: dict) -> bool:
        return not x["numbers"] and (abs(x["x0"] - left) <= EDGE or x["words"] > LINE_WORDS)

    ends = []
    for mark in marks:
        following = min((m["y0"] for m in marks if m["y0"] > mark["y0"]), default=float("inf"))
        end = max([mark["y1"], *(x["y1"] for x in inner if x["y0"] < mark["y1"] and x["y1"] > mark["y0"])])
        more = 0
        for x in lines:
            if x["y0"] < end:
                continue
            if x["y1"] > following:
                break
            if x["x1"] <= left:
                continue
            if x["y0"] - end > GAP * line or x["number"] or is_prose(x) or more == MORE_LINES:
                break
            end, more = max(end, x["y1"]), more + 1
        ends.append((mark["y0"], end, mark["number"]))
    # the top is the end of the last prose line or equation above; an equation comes before a line at its height
    events = sorted([(y, 0, i, end, n) for i, (y, end, n) in enumerate(ends)] + [(x["y0"], 1, i, x["y1"], None) for i, x in enumerate(lines) if is_prose(x)])
    top = 0.0
    for _, _, _, end, number in events:
        if number:
            yield top, end, 0.0, width, f"Equation {number}"
        top = end


def equation_regions(lines: DataFrame, blocks: DataFrame, page_width: float) -> DataFrame:
    """Regions of numbered equations: `(N)` alone on a line that ends at the right edge of the page's prose.

    The edges are those of blocks over 30 % of the page wide; a page without one has no equations. A region ends with the lowest
    line beside the number and up to three lines below it that are close, indented and short, never beyond the next
    number; it begins where the last prose above, or the equation above, ends. A page's lines are worked off in one task.
    """
    wide = blocks.filter(F.col("x1") - F.col("x0") > PROSE_WIDTH * page_width).groupBy(*PAGE).agg(F.min("x0").alias("left_edge"), F.max("x1").alias("right_edge"))
    told = _told(lines).filter("words > 0").withColumn("number", F.regexp_extract(F.trim("flat"), EQUATION, 1)).join(wide, PAGE)
    told = told.select(*PAGE, "block_id", "x0", "y0", "x1", "y1", "words", "numbers", "number", "left_edge", "right_edge")
    marked = told.filter("number <> '' AND abs(x1 - right_edge) <= 3").select(*PAGE).distinct()
    schema = _REGION.format(blocks.schema["doc_id"].dataType.simpleString())

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["y0", "block_id"], kind="stable").to_dict("records")
        out = _grow_equations(rows, rows[0]["left_edge"], rows[0]["right_edge"], page_width)
        return pd.DataFrame([(rows[0]["doc_id"], rows[0]["page"], *r) for r in out], columns=[c.split()[0] for c in schema.split(", ")])

    return told.join(marked, PAGE, "left_semi").groupBy(*PAGE).applyInPandas(page, schema)


def merged_boxes(fills: DataFrame, page_width: float) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1): fills of half the page's width and 20 points, joined where one begins at most a point below
    the end of those above."""
    big = fills.filter((F.col("x1") - F.col("x0") >= BOX_WIDTH * page_width) & (F.col("y1") - F.col("y0") >= BOX_HEIGHT))
    down = Window.partitionBy(*PAGE).orderBy("y0", "y1", "x0", "x1")
    first = F.coalesce((F.col("y0") > F.max("y1").over(down.rowsBetween(Window.unboundedPreceding, -1)) + BOX_GAP).cast("int"), F.lit(1))
    runs = big.withColumn("first", first).withColumn("run", F.sum("first").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*PAGE, "run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("run")


def box_regions(fills: DataFrame, blocks: DataFrame, media: DataFrame, page_width: float) -> DataFrame:
    """Regions of filled boxes outside the regions of media, labelled by a hash of the text that they hold; with the column text.

    Line numbers don't count, and a box without text is left out (its hash would be that of an image).
    """
    boxes = merged_boxes(fills, page_width).withColumnsRenamed({"x0": "b_x0", "y0": "b_y0", "x1": "b_x1", "y1": "b_y1"})
    inside = media.select(*PAGE, "top", "bottom").alias("m")
    boxes = boxes.alias("b").join(inside, (F.col("b.doc_id") == F.col("m.doc_id")) & (F.col("b.page") == F.col("m.page")) & (F.col("m.top") <= F.col("b_y0")) & (F.col("b_y1") <= F.col("m.bottom")), "left_anti")
    near = boxes.join(_told(blocks).filter("words > 0 AND NOT numbers"), PAGE).filter((_overlap(F.col("x0"), F.col("x1"), F.col("b_x0"), F.col("b_x1")) > 0) & (_overlap(F.col("y0"), F.col("y1"), F.col("b_y0"), F.col("b_y1")) > 0))
    parts = F.array_sort(F.collect_list(F.struct("y0", "block_id", "flat")))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["flat"]), " "), r"\s+", " "))
    held = near.groupBy(*PAGE, "b_x0", "b_y0", "b_x1", "b_y1").agg(text.alias("text"))
    return held.select(*PAGE, F.col("b_y0").alias("top"), F.col("b_y1").alias("bottom"), F.col("b_x0").alias("x0"), F.col("b_x1").alias("x1"), F.concat(F.lit("Box "), T.content_hash(F.col("text"))).alias("label"), "text")


def outside(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """blocks without those that lie in a region of their page, within a margin of 8 points."""
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in ("doc_id", "page", "top", "bottom", "x0", "x1")])
    within = (F.col("r_top") - MARGIN <= F.col("y0")) & (F.col("y1") <= F.col("r_bottom") + MARGIN) & (F.col("r_x0") - MARGIN <= F.col("x0")) & (F.col("x1") <= F.col("r_x1") + MARGIN)
    return blocks.join(r, (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page") == F.col("r_page")) & within, "left_anti")


def full_text(blocks: DataFrame, figures: DataFrame, tables: DataFrame, boxes: DataFrame, equations: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(doc_id, text): the running text of each document, null beyond max_pages; its paragraphs stand apart by an empty line.

    Line numbers and running heads go, and blocks in a region. Captions become places of their media (with the caption's own text
    where no region was found, and then short blocks below a table's or algorithm's are its cells), boxes and equations
    stand in places of their own. Blocks of a column that follow one another closely are one paragraph; sentences that were
    split are joined.
    """
    blocks = blocks.select(*PAGE, "block_id", "x0", "y0", "x1", "y1", "text")
    doc_type = blocks.schema["doc_id"].dataType
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    small = pages.filter(F.col("pages") <= max_pages)
    told = _told(without_repeated(blocks.join(small.select("doc_id"), "doc_id", "left_semi").withColumn("text", F.trim(F.col("text"))))).filter("words > 0 AND NOT numbers")
    algorithm = F.concat(F.lit("Algorithm "), F.regexp_extract("flat", ALGORITHM, 1))
    known = figures.unionByName(tables).select(*PAGE, "label").distinct().withColumn("found", F.lit(True))
    label = F.when(F.col("flat").rlike(CAPTION), F.concat(F.initcap(F.regexp_extract("flat", CAPTION, 1)), F.lit(" "), F.regexp_extract("flat", CAPTION, 2))).when(F.col("flat").rlike(ALGORITHM), algorithm)
    marked = told.withColumn("label", label).join(known, [*PAGE, "label"], "left")
    is_caption = F.col("flat").rlike(CAPTION) | F.coalesce("found", F.lit(False))
    marked = marked.withColumn("caption", F.coalesce(is_caption, F.lit(False)))
    regions = figures.unionByName(tables).unionByName(boxes.select(figures.columns)).unionByName(equations)
    # prose that was joined with an equation's number keeps what follows the number
    eq = equations.select(*[F.col(c).alias(f"e_{c}") for c in ("doc_id", "page", "top", "bottom")], F.regexp_extract("label", r"(\d+)$", 1).alias("e_number"))
    marked = marked.join(eq, (F.col("doc_id") == F.col("e_doc_id")) & (F.col("page") == F.col("e_page")) & (F.col("y0") < F.col("e_bottom")) & (F.col("y1") > F.col("e_top")) & F.contains("text", F.concat(F.lit("("), "e_number", F.lit(")"))), "left")
    after = F.regexp_replace("text", F.concat(F.lit(r"(?s)^.*?\("), "e_number", F.lit(r"\)\s*\n")), F.lit(""))
    first = Window.partitionBy(*PAGE, "block_id").orderBy((F.length(after) == F.length("text")).cast("int"), "e_top")
    marked = marked.withColumn("k", F.row_number().over(first)).filter("k = 1").withColumn("text", F.when(F.col("e_number").isNotNull(), F.trim(after)).otherwise(F.col("text"))).filter("text <> ''")
    kept = marked.filter("caption").unionByName(outside(marked.filter("NOT caption"), regions))
    kept = kept.withColumn("kind", F.when(F.col("caption"), F.lit("caption")).otherwise("text")).withColumn("flat", T.flatten_block(F.col("text")))
    place = lambda df, kind: df.select(*PAGE, F.lit(-1).cast("long").alias("block_id"), F.col("top").alias("y0"), F.col("bottom").alias("y1"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"), F.lit(kind).alias("kind"), "label", T.label_placeholder(F.col("label")).alias("text"))
    rows = kept.select(*PAGE, F.col("block_id").cast("long"), "x0", "y0", "x1", "y1", "kind", "label", "found", "text", "words", "flat")
    for df, kind in ((boxes, "box"), (equations, "equation")):
        rows = rows.unionByName(place(df.join(small.select("doc_id"), "doc_id", "left_semi"), kind), allowMissingColumns=True)
    down = Window.partitionBy(*PAGE).orderBy("y0", "block_id")
    gap = MERGE_GAP * F.col("line")
    rows = rows.join(line_heights(blocks, ["doc_id"]), "doc_id")
    follows = (F.lag("kind").over(down) == "text") & (F.col("kind") == "text") & (F.col("y0") - F.lag("y1").over(down) < gap) & (F.col("x1") >= F.lag("x0").over(down)) & (F.col("x0") <= F.lag("x1").over(down))
    rows = rows.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("y0", "block_id", "text")))
    joined = T.flatten_block(F.array_join(F.transform(parts, lambda p: p["text"]), " "))
    paragraphs = rows.groupBy(*PAGE, "run").agg(joined.alias("text"), F.min("kind").alias("kind"), F.max("label").alias("label"), F.max("found").alias("found"), F.min("y0").alias("y0"))
    media = F.when(F.col("found"), T.label_placeholder(F.col("label"))).otherwise(F.concat(F.regexp_replace(T.label_placeholder(F.col("label")), r"\)$", " — 이미지 추출실패, 텍스트로 대체)\n\n"), "text"))
    short = (F.col("kind") == "text") & (F.size(F.split(F.trim("text"), r"\s+")) <= CELL_WORDS)
    cells = (F.col("kind") == "caption") & F.col("found").isNull() & ~F.col("label").startswith("Figure")
    back = Window.partitionBy(*PAGE).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    paragraphs = paragraphs.withColumn("in_table", F.last(F.when(~short, cells), True).over(back)).filter(~(short & F.coalesce("in_table", F.lit(False))))
    paragraphs = paragraphs.withColumn("text", F.when(F.col("kind") == "caption", media).otherwise(F.col("text")))
    listed = F.array_sort(F.collect_list(F.struct("page", "run", "text")))
    out = paragraphs.groupBy("doc_id").agg(F.array_join(T.stitched(F.transform(listed, lambda p: p["text"])), "\n\n").alias("text"))
    return pages.select(F.col("doc_id").cast(doc_type), F.when(F.col("pages") <= max_pages, F.lit("")).alias("none")).join(out, "doc_id", "left").select("doc_id", F.coalesce("text", "none").alias("text"))
