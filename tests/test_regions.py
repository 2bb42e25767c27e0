"""Regions of pages against plain scans over random pages; running texts on fixtures."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import layout, regions as R

BLOCK = "doc_id string, page int, block_id long, x0 double, y0 double, x1 double, y1 double, text string"
AREA = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"
W, H = 600.0, 800.0
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen more words than a label ever has in it"


def pages(seed, n=60):
    """Pages of up to nine blocks on a coarse grid, so that ties, overlaps and touching edges are common."""
    rng = random.Random(seed)
    out = {}
    for p in range(n):
        blocks = []
        for b in range(rng.randint(1, 9)):
            x0, y0 = 20.0 * rng.randint(0, 20), 20.0 * rng.randint(0, 30)
            text = rng.choice([f"Figure {b}: it", f"Table {b % 3}. of all", f"Algorithm {b} runs", PROSE, PROSE + "\nand on", "a label", "12 13\n14", "(3)", "x = y", "Row 1\nRow 2"])
            blocks.append((f"d{p % 7}", p, b, x0, y0, x0 + 20.0 * rng.randint(1, 20), y0 + 10.0 * rng.randint(1, 8), text))
        out[p] = blocks
    return out


def flat(text):
    return " ".join(text.replace("-\n", "").split())


def is_numbers(text):
    return all(t.isdigit() and len(t) <= 4 for t in text.split())


def typical(blocks):
    heights = [(b[6] - b[4]) / (b[7].count("\n") + 1) for b in blocks if "\n" in b[7] and b[6] > b[4]]
    return statistics.median(heights) if heights else 12.0


def cross(a0, a1, b0, b1):
    return min(a1, b1) - max(a0, b0)


def figure_scan(blocks, shapes, bottoms):
    """One pass down the page, block by block."""
    order = sorted(blocks, key=lambda b: (b[4], b[2]))
    cap = lambda b: b[7].startswith("Figure") and ":" in b[7]
    near = 1.5 * typical(blocks)
    end, floor, out = 0.0, 0.0, []
    for b in order:
        for t in bottoms:
            if t <= b[4]:
                end, floor = max(end, t), max(floor, t)
        if cap(b):
            tops = [s[3] for s in shapes if s[5] > floor and s[3] < b[4]]
            top = min(tops) if tops else end
            sides = [(s[2], s[4]) for s in shapes if s[5] > top and s[3] < b[6]]
            x0, x1 = (min(x for x, _ in sides), max(x for _, x in sides)) if sides else (0.0, W)
            labels = [h for h in order if flat(h[7]) and not is_numbers(h[7]) and len(h[7].split()) <= 10]
            heads = [h[4] for h in labels if h[6] <= top and top - h[6] <= near and h[4] >= floor and cross(h[3], h[5], x0, x1) > 0]
            top = min(heads) if heads else top
            level = [h for h in labels if cross(h[4], h[6], top, b[6]) > 0]
            left, right = [h[3] for h in level if 0 <= x0 - h[5] <= near], [h[5] for h in level if 0 <= h[3] - x1 <= near]
            x0, x1 = min([x0, *left][-1:] if not left else [min(left)]), max([x1] if not right else [max(right)])
            out.append((b[0], b[1], top, b[6], min(x0, b[3]), max(x1, b[5]), f"Figure {b[2]}"))
            end = floor = b[6]
        elif len(b[7].split()) > 20 and not is_numbers(b[7]):
            reach = min([b[6], *(c[4] for c in order if cap(c) and cross(b[4], b[6], c[4], c[6]) > 0)])
            end = max(end, reach)
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_figures_of_random_pages(spark):
    rng = random.Random(11)
    made = pages(1, 120)
    shapes = [(b[0][0], b[0][1], x := 10.0 * rng.randint(0, 50), y := 10.0 * rng.randint(0, 60), x + rng.choice([1.0, 50.0, 200.0]), y + rng.choice([1.0, 40.0])) for b in made.values() for _ in range(rng.randint(0, 3))]
    shapes = [(*s, rng.random() < 0.2) for s in shapes]
    bottoms = [(b[0][0], b[0][1], 20.0 * rng.randint(0, 30)) for b in made.values() if rng.random() < 0.5]
    want = []
    for p, blocks in made.items():
        mine = [s for s in shapes if s[1] == p and (s[6] or (s[4] - s[2] >= 2 and s[5] - s[3] >= 2))]
        want += figure_scan(blocks, mine, [t[2] for t in bottoms if t[1] == p])
    all_blocks = spark.createDataFrame([b for x in made.values() for b in x], BLOCK)
    got = R.figure_regions(all_blocks, spark.createDataFrame(shapes, AREA + ", image boolean"), spark.createDataFrame(bottoms, "doc_id string, page int, bottom double"), W)
    assert len(want) > 40 and rows(got) == sorted(want)


def rule_scan(blocks, rules):
    """Captions from the top down; each looks at the rules that no other has used where they meet."""
    order, near = sorted(blocks, key=lambda b: (b[4], b[2])), 1.5 * typical(blocks)
    caps = [(b, f"{b[7].split()[0]} {b[7].split()[1].strip(':.')}") for b in order if b[7].split()[0] in ("Figure", "Table", "Algorithm")]
    out, used = {}, []
    for b, label in caps:
        if label.startswith("Figure") or label in out:
            continue
        ys = sorted({r[0] for r in rules if not any(u[0] == r[0] and cross(u[1], u[2], r[1], r[2]) > 0 for u in used)})
        later, earlier = [c[4] for c, name in caps if name != label and c[4] > b[4]], [c[6] for c, name in caps if name != label and c[6] < b[4]]
        below = [y for y in ys if b[4] <= y <= min(later, default=H) and not (later and min(later) - y <= near)]
        above = [y for y in ys if max(earlier, default=0.0) <= y <= b[4]] if label.startswith("Table") else []
        if len(below) >= 2 and not (len(above) >= 2 and b[4] - above[-1] < below[0] - b[4]):
            last = below[1] if label.startswith("Algorithm") else below[-1]
            out[label], gone = (b[4], last), [y for y in below if y <= last]
        elif len(above) >= 2:
            out[label], gone = (above[0], b[6]), above
        else:
            continue
        used += [r for r in rules if r[0] in gone and cross(r[1], r[2], b[3], b[5]) > 0]
    return [(blocks[0][0], blocks[0][1], *span, 0.0, W, label) for label, span in out.items()]


def test_rules_of_random_pages(spark):
    rng = random.Random(12)
    made = pages(2, 120)
    rules = {p: [(10.0 * rng.randint(0, 70), x := 50.0 * rng.randint(0, 6), x + 50.0 * rng.randint(2, 8)) for _ in range(rng.randint(0, 8))] for p in made}
    want = [r for p, blocks in made.items() for r in rule_scan(blocks, rules[p])]
    lines = spark.createDataFrame([(made[p][0][0], p, *r) for p, x in rules.items() for r in x], "doc_id string, page int, y double, x0 double, x1 double")
    got = R.ruled_regions(spark.createDataFrame([b for x in made.values() for b in x], BLOCK), lines, W, H)
    assert len(want) > 40 and rows(got) == sorted(want)


def equation_scan(lines, left, right):
    """The definition: for each number its end, then the last prose or equation above it."""
    order = sorted(lines, key=lambda b: (b[4], b[2]))
    number = lambda b: b[7][1:-1] if b[7].startswith("(") and b[7].endswith(")") and b[7][1:-1].isdigit() else None
    prose = lambda b: not is_numbers(b[7]) and (abs(b[3] - left) <= 3 or len(b[7].split()) > 6)
    tall = statistics.median([b[6] - b[4] for b in order if b[6] > b[4]] or [12.0])
    marks = [b for b in order if number(b) and abs(b[5] - right) <= 3]
    found = []
    for m in marks:
        end = max([m[6]] + [b[6] for b in order if b[5] > left and b[4] < m[6] and b[6] > m[4]])
        limit, taken = min([k[4] for k in marks if k[4] > m[4]], default=float("inf")), 0
        for b in order:
            if b[4] < end:
                continue
            if b[6] > limit:
                break
            if b[5] <= left:
                continue
            if b[4] - end > 1.5 * tall or number(b) or prose(b) or taken == 3:
                break
            end, taken = max(end, b[6]), taken + 1
        found.append((m[4], end, number(m)))
    out = []
    for i, (y, end, n) in enumerate(found):
        above = [(b[4], 1, b[6]) for b in order if b[4] < y and prose(b)] + [(f[0], 0 if f[0] < y else -1, f[1]) for f in found[:i]]
        out.append((lines[0][0], lines[0][1], max(above)[2] if above else 0.0, end, 0.0, W, f"Equation {n}"))
    return out


def test_equations_of_random_pages(spark):
    rng = random.Random(13)
    lines, wide, want = [], [], []
    for p in range(150):
        mine, y = [], 0.0
        for b in range(rng.randint(2, 12)):
            y += rng.choice([0.0, 5.0, 12.0, 12.0, 30.0])
            kind = rng.choice(["mark", "mark", "math", "math", "prose", "margin", "inner"])
            x0, x1, text = {"mark": (480.0, 500.0 + rng.choice([0, 2, 9]), f"({rng.randint(1, 20)})"), "math": (200.0, 300.0, "x = y + z"), "prose": (100.0, 500.0, "words of the running text go on here"), "margin": (60.0, 90.0, "197"), "inner": (150.0, 220.0, "V(0)=0 (4)")}[kind]
            mine.append(("d", p, b, x0, y, x1, y + rng.choice([8.0, 10.0, 16.0]), text))
        if p % 10:
            wide.append(("d", p, 99, 100.0, 700.0, 500.0, 720.0, "wide"))
            want += equation_scan(mine, 100.0, 500.0)
        lines += mine
    got = R.equation_regions(spark.createDataFrame(lines, BLOCK), spark.createDataFrame(wide + [("d", 0, 1, 0.0, 0.0, 50.0, 9.0, "narrow")], BLOCK), W)
    assert len(want) > 60 and rows(got) == sorted(want)


def test_blocks_merge_but_captions_stay(spark):
    """Each round, a block goes to the smallest id that it shares 80 % of the smaller area with, captions aside."""
    made = pages(3, 80)
    want = set()
    for blocks in made.values():
        live = {b[2]: list(b[3:7]) for b in blocks if not b[7].startswith(("Figure", "Table"))}
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        while True:
            into = {}
            for b in live:
                for a in sorted(live):
                    w, h = cross(live[a][0], live[a][2], live[b][0], live[b][2]), cross(live[a][1], live[a][3], live[b][1], live[b][3])
                    if a < b and w > 0 and h > 0 and w * h >= 0.8 * min(area(live[a]), area(live[b])):
                        into[b] = a
                        break
            if not into:
                break
            grown = {}
            for b, r in live.items():
                grown.setdefault(into.get(b, b), []).append(r)
            live = {k: [min(r[0] for r in v), min(r[1] for r in v), max(r[2] for r in v), max(r[3] for r in v)] for k, v in grown.items()}
        want |= {(blocks[0][1], i, *r) for i, r in live.items()} | {(b[1], b[2], *b[3:7]) for b in blocks if b[7].startswith(("Figure", "Table"))}
    got = layout.merged_overlaps(spark.createDataFrame([b for x in made.values() for b in x], BLOCK))
    assert {(r.page, r.block_id, r.x0, r.y0, r.x1, r.y1) for r in got.collect()} == want


@pytest.mark.parametrize("text, reference, kept", [
    ("A sentence. h f ll i pa", None, "A sentence."), ("A sentence. h f ll i", None, "A sentence. h f ll i"), ("for U V W X Y", "for U  V\nW X Y", "for U V W X Y"),
    ("a b c d e", None, ""), ("Words.\nh f\nll i pa \n", "other", "Words."), ("x h f ll i longer", None, "x h f ll i longer"), ("", None, ""), (None, None, None), ("w1 a b c d e", "", "w1"),
])
def test_clip_leaks(spark, text, reference, kept):
    df = spark.createDataFrame([(text, reference)], "t string, r string")
    assert df.select(T.without_clip_leak(F.col("t"), F.col("r")).alias("k")).first().k == kept


def test_boxes_are_told_by_their_text(spark):
    fills = spark.createDataFrame([("d", 1, 50.0, 100.0, 400.0, 140.0), ("d", 1, 60.0, 141.0, 420.0, 200.0), ("d", 1, 50.0, 300.0, 300.0, 330.0), ("d", 2, 0.0, 10.0, 400.0, 60.0), ("d", 2, 0.0, 500.0, 400.0, 560.0), ("e", 7, 5.0, 20.0, 400.0, 80.0)], AREA)
    blocks = spark.createDataFrame([("d", 1, 1, 60.0, 110.0, 300.0, 130.0, "same\nwords"), ("d", 1, 2, 60.0, 150.0, 300.0, 160.0, "12"), ("d", 2, 3, 10.0, 20.0, 300.0, 50.0, "in a figure"), ("e", 7, 4, 60.0, 30.0, 300.0, 60.0, "same words")], BLOCK)
    media = spark.createDataFrame([("d", 2, 0.0, 100.0, 0.0, 600.0, "Figure 1")], "doc_id string, page int, top double, bottom double, x0 double, x1 double, label string")
    got = R.box_regions(fills, blocks, media, W).orderBy("doc_id").collect()
    assert [(r.doc_id, r.page, r.top, r.bottom, r.x0, r.x1, r.text) for r in got] == [("d", 1, 100.0, 200.0, 50.0, 420.0, "same words"), ("e", 7, 20.0, 80.0, 5.0, 400.0, "same words")]
    assert got[0].label == got[1].label and got[0].label.startswith("Box ")


def test_running_text(spark):
    head = lambda p: ("d", p, 0, 50.0, 5.0, 500.0, 15.0, "Under review")
    blocks = [head(1), head(2), head(3),
        ("d", 1, 1, 50.0, 50.0, 500.0, 80.0, "An opening para-\ngraph."), ("d", 1, 2, 10.0, 50.0, 20.0, 60.0, "000\n001"), ("d", 1, 3, 60.0, 120.0, 200.0, 140.0, "axis label"), ("d", 1, 4, 50.0, 200.0, 500.0, 212.0, "Figure 1: shown"),
        ("d", 1, 5, 50.0, 300.0, 500.0, 310.0, "Here a sentence"), ("d", 1, 6, 50.0, 312.0, 500.0, 322.0, "goes on and"),
        ("d", 2, 1, 50.0, 40.0, 500.0, 60.0, "ends on a new page."), ("d", 2, 2, 50.0, 100.0, 500.0, 110.0, "Table 2: not found"), ("d", 2, 3, 50.0, 130.0, 300.0, 140.0, "a cell"), ("d", 2, 4, 50.0, 160.0, 500.0, 180.0, "A paragraph of more than eight words stands here again."), ("d", 2, 5, 50.0, 220.0, 200.0, 230.0, "Short."),
        ("d", 3, 1, 300.0, 60.0, 500.0, 120.0, "x = y (4)\nwhere y is known."), ("d", 3, 2, 50.0, 200.0, 500.0, 220.0, "inside a box"), ("d", 3, 3, 50.0, 300.0, 500.0, 310.0, "Algorithm 1 says so.")]
    region = "doc_id string, page int, top double, bottom double, x0 double, x1 double, label string"
    df = spark.createDataFrame(blocks + [("long", p, 1, 0.0, 0.0, 9.0, 9.0, f"page {p}") for p in range(5)] + [("gone", 1, 1, 0.0, 0.0, 9.0, 9.0, "12")], BLOCK)
    make = lambda *r: spark.createDataFrame(list(r), region)
    out = R.full_text(df, make(("d", 1, 100.0, 212.0, 50.0, 500.0, "Figure 1")), make(), make(("d", 3, 190.0, 230.0, 40.0, 510.0, "Box 12ab")), make(("d", 3, 50.0, 90.0, 0.0, 600.0, "Equation 4")), max_pages=4)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text["long"] is None and text["gone"] == ""
    assert text["d"].split("\n\n") == [
        "An opening paragraph.", "(그림 1)", "Here a sentence goes on and ends on a new page.", "(표 2 — 이미지 추출실패, 텍스트로 대체)", "Table 2: not found",
        "A paragraph of more than eight words stands here again.", "Short.", "(수식 4)", "where y is known.", "(박스 12ab)", "Algorithm 1 says so.",
    ]


def test_pages_without_anything(spark):
    none = spark.createDataFrame([], BLOCK)
    area = spark.createDataFrame([], AREA)
    figures = R.figure_regions(none, area.withColumn("image", F.lit(True)), area.selectExpr("doc_id", "page", "y1 AS bottom"), W)
    tables = R.ruled_regions(none, area.selectExpr("doc_id", "page", "y0 AS y", "x0", "x1"), W, H)
    equations = R.equation_regions(none, none, W)
    boxes = R.box_regions(area, none, figures, W)
    assert [x.count() for x in (figures, tables, equations, boxes, R.full_text(none, figures, tables, boxes, equations))] == [0] * 5
