"""Differences between versions of a paper's body, by paragraphs, with its figures and tables.

A body is a text of paragraphs, some of which stand for media: `(그림 2)`. Differences are a table of segments: pair, pos
(an array of numbers that sorts them), op (equal, delete, insert or moved) and text. Paragraphs are aligned for each pair of
versions; what is moved or renumbered is then found by joins between the segments of a pair, so no task ever holds all
combinations of a rewritten paper.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from marginalia.functions import rank as R, text as T
from marginalia.operators.diff import SEGMENTS, greedy_match, in_pieces, letter_bound, letter_ratio, segments_type, sequence_ratio, word_diff, word_segments
from marginalia.session import spread, written

# Thresholds and labels of the comparison.
MOVE_RATIO, MOVE_WORDS = 0.6, 6
BOX_RATIO, CAPTION_CHARS, CAPTION_RATIO, IMAGE_RATIO = 0.5, 8, 0.7, 0.95
MEDIA_KINDS = ("Figure", "Table", "Algorithm", "Box", "Equation")
BODY_LABEL = "본문"

_BLOCKS = "array<struct<tag: string, a: array<string>, b: array<string>>>"


def _aligned(before: Column, after: Column) -> Column:
    """Runs of paragraphs that are equal, deleted, inserted or replaced."""

    kind = pa.list_(pa.struct([("tag", pa.string()), ("a", pa.list_(pa.string())), ("b", pa.list_(pa.string()))]))
    blocks = lambda a, b: [{"tag": tag, "a": a[i:j], "b": b[k:m]} for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes()]

    @arrow_udf(_BLOCKS)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return in_pieces(blocks, x, y, kind)

    return run(before, after)


def media_segments(before: list[str], after: list[str]) -> list[dict[str, str]]:
    """Segments of replaced paragraphs among which media stand, each at the word where it stood in its own version."""
    marks: list[dict[int, list[str]]] = []
    texts = []
    for paragraphs in (before, after):
        at, words, own = 0, [], {}
        for p in paragraphs:
            if re.match(T.MEDIA, p):
                own.setdefault(at, []).append(p)
            else:
                words.append(p)
                at += len(p.split())
        marks.append(own)
        texts.append("\n\n".join(words))
    out: list[dict[str, str]] = []

    def place(side: int, at: int) -> None:
        out.extend({"op": ("delete", "insert")[side], "text": p} for p in marks[side].pop(at, []))

    segments = word_segments(*texts)
    if segments and all(s["op"] == "equal" for s in segments):
        segments = [{"op": "moved", "text": s["text"]} for s in segments]  # only media have changed their places
    at = [0, 0]
    for segment in segments:
        sides = [s for s, op in ((0, "insert"), (1, "delete")) if segment["op"] != op]  # those whose words these are
        run: list[str] = []
        place(0, at[0])
        place(1, at[1])
        for word in segment["text"].split():
            if any(at[s] in marks[s] for s in sides):
                if run:
                    out.append({"op": segment["op"], "text": " ".join(run)})
                run = []
                for s in sides:
                    place(s, at[s])
            run.append(word)
            for s in sides:
                at[s] += 1
        if run:
            out.append({"op": segment["op"], "text": " ".join(run)})
    for side in (0, 1):
        for position in sorted(marks[side]):
            place(side, position)
    media = [bool(re.match(T.MEDIA, s["text"])) for s in out]
    for n, s in enumerate(out):
        if media[n] or n + 1 == len(out) or media[n + 1]:
            s["text"] = s["text"].rstrip() + "\n\n"
    return out


def _media_diff(before: Column, after: Column) -> Column:
    @arrow_udf(SEGMENTS)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return in_pieces(lambda a, b: None if a is None or b is None else media_segments(a, b), x, y, segments_type())

    return run(before, after)


def _segments(op: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(op).alias("op"), F.concat(t, F.lit("\n\n")).alias("text")))


def _closed(segments: Column) -> Column:
    """Segments of which the last one ends its paragraph."""
    last = F.element_at(segments, -1)
    end = F.array(F.struct(last["op"].alias("op"), F.concat(last["text"], F.lit("\n\n")).alias("text")))
    return F.when(F.size(segments) > 0, F.concat(F.slice(segments, 1, F.size(segments) - 1), end)).otherwise(segments)


def aligned_segments(pairs: DataFrame) -> DataFrame:
    """(pair, pos, op, text) of texts (pair, before, after): unchanged paragraphs whole, replaced ones by words where they surely correspond."""
    blocks = pairs.select("pair", F.posexplode(_aligned(T.paragraphs(F.col("before")), T.paragraphs(F.col("after")))).alias("n", "x")).select("pair", "n", "x.*")
    is_media = lambda p: p.rlike(T.MEDIA)
    replaced = F.col("tag") == "replace"
    media = replaced & (F.exists("a", is_media) | F.exists("b", is_media))
    single = replaced & ~media & (F.size("a") == 1) & (F.size("b") == 1)
    one = lambda c: F.when(single, F.get(c, F.lit(0)))
    rows = blocks.withColumn("ratio", F.when(single, letter_ratio(one("a"), one("b"))))
    sure = single & (F.col("ratio") >= MOVE_RATIO)
    by_words = _closed(word_diff(F.when(sure, one("a")), F.when(sure, one("b")), keep_breaks=True))
    with_media = _media_diff(F.when(media, F.col("a")), F.when(media, F.col("b")))
    whole = F.when(F.col("tag") == "equal", _segments("equal", F.col("a"))).otherwise(F.concat(_segments("delete", F.col("a")), _segments("insert", F.col("b"))))
    rows = rows.select("pair", "n", F.when(media, with_media).when(sure, by_words).otherwise(whole).alias("s"))
    return rows.select("pair", "n", F.posexplode("s").alias("m", "s")).select("pair", F.array("n", "m").alias("pos"), "s.op", "s.text")


def _matched_paragraphs(fit: DataFrame) -> DataFrame:
    """(pair, gone, old, pos, new, kept) of deletes and inserts (pair, pos, op, text, bare, fresh), matched one to one, the most alike first.

    Only equal texts score 1, so these are matched first, by their positions; what is left over is compared by letters. Two that
    aren't fresh were compared, and found unlike, in the pass before.
    """
    rows = lambda op: F.array_sort(F.collect_list(F.when(F.col("op") == op, F.struct("pos", "text", "fresh"))))
    texts = written(fit.groupBy("pair", "bare").agg(rows("delete").alias("d"), rows("insert").alias("i")).withColumn("both", F.least(F.size("d"), F.size("i"))), "paragraphs")
    same = texts.filter("both > 0").select("pair", "bare", F.inline(F.arrays_zip(F.slice("d", 1, F.col("both")).alias("d"), F.slice("i", 1, F.col("both")).alias("i"))))
    same = same.select("pair", F.col("d.pos").alias("gone"), F.col("bare").alias("old"), F.col("i.pos").alias("pos"), F.col("bare").alias("new"), F.col("i.text").alias("kept"))
    rest = lambda side: texts.filter(F.size(side) > F.col("both")).select("pair", "bare", F.inline(F.slice(side, F.col("both") + 1, F.size(side))))
    old = rest("d").select("pair", F.col("pos").alias("left"), F.col("bare").alias("old"), F.col("fresh").alias("was_fresh"))
    new = rest("i").select("pair", F.col("pos").alias("right"), F.col("bare").alias("new"), F.col("text").alias("kept"), "fresh")
    near = old.join(new, "pair").filter((F.col("was_fresh") | F.col("fresh")) & (letter_bound(F.col("old"), F.col("new")) >= MOVE_RATIO))
    near = written(spread(near, "pair", "left", "right").withColumn("score", letter_ratio(F.col("old"), F.col("new"))), "scores")  # else a filter on the score goes below the shuffle
    alike = greedy_match(near, "pair", MOVE_RATIO).select("pair", F.col("left").alias("gone"), "old", F.col("right").alias("pos"), "new", "kept")
    return same.unionByName(alike)


def moved_paragraphs(segments: DataFrame) -> DataFrame:
    """Deletes and inserts of six words or more that are alike become one segment at the place of the insert, until none are.

    Equal texts are moved; others are compared by words, which may leave new inserts for the next pass. A pass looks only at
    pairs in which the one before moved a text or found equal words: each such pass leaves fewer words deleted and inserted,
    and one that does not would only match the same texts again, so the passes come to an end.
    """
    bare = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    segments = written(segments.withColumn("fresh", F.lit(True)), "segments")
    while True:
        fit = segments.filter(F.col("op").isin("delete", "insert")).withColumn("bare", bare)
        fit = fit.filter((F.size(F.split("bare", r"\s+")) >= MOVE_WORDS) & ~F.col("bare").rlike(T.MEDIA))
        fresh = fit.filter("fresh").select("pair").distinct()
        if fresh.isEmpty():
            break
        found = written(_matched_paragraphs(fit.join(fresh, "pair", "left_semi")), "matched")
        if found.isEmpty():
            break
        same = F.col("old") == F.col("new")
        words = _closed(word_diff(F.when(same, "").otherwise(F.col("old")), F.when(same, "").otherwise(F.col("new"))))
        put = found.withColumn("s", F.when(same, F.array(F.struct(F.lit("moved").alias("op"), F.col("kept").alias("text")))).otherwise(words))
        put = put.select("pair", "pos", F.posexplode("s").alias("m", "s")).select("pair", F.concat("pos", F.array("m")).alias("pos"), "s.op", "s.text")
        put = put.withColumn("fresh", F.max(F.col("op").isin("equal", "moved")).over(Window.partitionBy("pair")))
        taken = found.select("pair", F.col("gone").alias("pos")).unionByName(found.select("pair", "pos"))
        segments = written(segments.withColumn("fresh", F.lit(False)).join(taken, ["pair", "pos"], "left_anti").unionByName(put), "segments")
    return segments.drop("fresh")


def merged_media(segments: DataFrame, renumbered: DataFrame) -> DataFrame:
    """Media that stand both deleted and inserted become moved ones at the place of the insert.

    renumbered: (pair, before_label, after_label) of media that got another number; a deleted one of these goes to its new
    number and is served first, the others go to their own.
    """
    names = renumbered.select("pair", T.label_placeholder(F.col("before_label")).alias("was"), T.label_placeholder(F.col("after_label")).alias("now")).dropna().distinct()
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    media = segments.filter(bare.rlike(T.MEDIA)).withColumn("label", bare)
    rest = segments.filter(~bare.rlike(T.MEDIA))
    touched = names.select("pair", F.col("was").alias("label")).unionByName(names.select("pair", F.col("now").alias("label"))).distinct().withColumn("touched", F.lit(True))
    media = media.join(touched, ["pair", "label"], "left")
    # what only looks equal, since its number now is another's, is taken apart again
    ops = F.when((F.col("op") == "equal") & F.col("touched"), F.array(F.lit("delete"), F.lit("insert"))).otherwise(F.array("op"))
    media = media.select("pair", "pos", "label", "text", F.posexplode(ops).alias("k", "op")).withColumn("pos", F.concat("pos", F.array("k")))
    gone = media.filter("op = 'delete'").join(names.withColumnRenamed("was", "label"), ["pair", "label"], "left").withColumn("target", F.coalesce("now", "label"))
    gone = gone.withColumn("n", F.row_number().over(Window.partitionBy("pair", "target").orderBy(F.col("now").isNull(), "pos")))
    come = media.filter("op = 'insert'").withColumn("n", F.row_number().over(Window.partitionBy("pair", "label").orderBy("pos")))
    met = come.select("pair", F.col("label").alias("target"), "n").join(gone.select("pair", "target", "n"), ["pair", "target", "n"])
    stays = gone.join(met, ["pair", "target", "n"], "left_anti").select("pair", "pos", "op", "text")
    here = come.join(met.withColumnRenamed("target", "label").withColumn("met", F.lit(True)), ["pair", "label", "n"], "left")
    here = here.select("pair", "pos", F.when(F.col("met"), "moved").otherwise("insert").alias("op"), "text")
    return rest.unionByName(media.filter("op NOT IN ('delete', 'insert')").select("pair", "pos", "op", "text")).unionByName(stays).unionByName(here)


def body_segments(pairs: DataFrame, renumbered: DataFrame | None = None) -> DataFrame:
    """(pair, n, op, text): the segments of texts (pair, before, after) in order.

    equal, insert and moved segments in order make up the text after; a null text is an empty one.
    """
    if renumbered is None:
        renumbered = pairs.sparkSession.createDataFrame([], "pair long, before_label string, after_label string").withColumn("pair", F.col("pair").cast(pairs.schema["pair"].dataType))
    texts = pairs.select("pair", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    rows = merged_media(moved_paragraphs(aligned_segments(texts)), renumbered)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("pair").orderBy("pos"))).select("pair", "n", "op", "text")


def matched_media(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair, kind, before_label, after_label): media of two versions that are the same, one to one.

    before, after: pair, label (`Figure 2`), caption, content (text of boxes), signature (array of grey values), bytes. By
    captions where both are long enough, else by pixels, the most alike first and the same label before others; labels
    that are left on both sides are the same. Boxes go by label, then by their texts or sizes; equations by label alone.
    """
    kind = F.split("label", " ")[0].alias("kind")
    side = lambda df, name: df.select("pair", kind, F.col("label").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("caption", "content", "signature", "bytes")]).filter(F.col("kind").isin(*MEDIA_KINDS))
    a, b = side(before, "a"), side(after, "b")
    by_label = a.select("pair", "kind", "a").join(b.select("pair", "kind", F.col("b").alias("a")), ["pair", "kind", "a"]).withColumn("b", F.col("a"))
    fixed = by_label.filter("kind IN ('Box', 'Equation')")
    boxed = F.col("kind") == "Box"
    free = lambda df, name: df.join(fixed.select("pair", "kind", F.col("a").alias(name)), ["pair", "kind", name], "left_anti")
    both = free(a, "a").join(free(b, "b"), ["pair", "kind"]).filter("kind <> 'Equation'")
    text = lambda c: F.coalesce(c, F.lit(""))
    captions = (F.length(text(F.col("a_caption"))) >= CAPTION_CHARS) & (F.length(text(F.col("b_caption"))) >= CAPTION_CHARS)
    filled = (text(F.col("a_content")) != "") | (text(F.col("b_content")) != "")
    old = F.when(boxed, text(F.col("a_content"))).otherwise(text(F.col("a_caption")))
    new = F.when(boxed, text(F.col("b_content"))).otherwise(text(F.col("b_caption")))
    sizes = 1 - F.abs(F.col("a_bytes") - F.col("b_bytes")) / F.greatest("a_bytes", "b_bytes", F.lit(1))
    ratio = F.when(F.when(boxed, filled).otherwise(captions), letter_ratio(old, new)).when(boxed, sizes).otherwise(F.coalesce(R.image_similarity(F.col("a_signature"), F.col("b_signature")), F.lit(0.0)))
    least = F.when(boxed, BOX_RATIO).when(captions, CAPTION_RATIO).otherwise(IMAGE_RATIO)
    near = written(spread(both, "pair", "kind", "a", "b").select("pair", "kind", "a", "b", ratio.alias("score"), least.alias("least")), "scores").filter(F.col("score") >= F.col("least"))
    order = F.row_number().over(Window.partitionBy("pair", "kind").orderBy(F.desc("score"), F.col("a") != F.col("b"), "a", "b"))
    near = near.select("pair", "kind", F.col("a").alias("left"), F.col("b").alias("right"), (-order).cast("double").alias("score"))
    found = fixed.unionByName(greedy_match(near, ["pair", "kind"], float("-inf")).select("pair", "kind", F.col("left").alias("a"), F.col("right").alias("b")))
    taken = lambda name: found.select("pair", "kind", F.col(name).alias("a"))
    same = by_label.filter("kind NOT IN ('Box', 'Equation')").join(taken("a"), ["pair", "kind", "a"], "left_anti").join(taken("b"), ["pair", "kind", "a"], "left_anti")
    return found.unionByName(same).select("pair", "kind", F.col("a").alias("before_label"), F.col("b").alias("after_label"))


def media_changes(before: DataFrame, after: DataFrame, matched: DataFrame) -> DataFrame:
    """(pair, kind, label, after_label, in_before, in_after): matched media, then what only one version has."""
    kind = F.split("label", " ")[0].alias("kind")
    lone = lambda df, side: df.select("pair", kind, "label").filter(F.col("kind").isin(*MEDIA_KINDS)).join(matched.select("pair", F.col(side).alias("label")), ["pair", "label"], "left_anti")
    none = F.lit(None).cast("string").alias("after_label")
    both = matched.select("pair", "kind", F.col("before_label").alias("label"), F.nullif("after_label", "before_label").alias("after_label"), F.lit(True).alias("in_before"), F.lit(True).alias("in_after"))
    gone = lone(before, "before_label").select("pair", "kind", "label", none, F.lit(True).alias("in_before"), F.lit(False).alias("in_after"))
    come = lone(after, "after_label").select("pair", "kind", "label", none, F.lit(False).alias("in_before"), F.lit(True).alias("in_after"))
    return both.unionByName(gone).unionByName(come)


def body_changes(changes: DataFrame, versions: DataFrame, media: DataFrame) -> DataFrame:
    """(paper_id, revision, place, field, label, after_label, similarity, segments): all changes, bodies and media put in.

    changes: paper_id, revision (0 is the baseline), change_no, field, kind, label, before_url, after_url. versions: url,
    text. media: url, label, caption, content, signature, bytes. Behind each replaced file whose two versions have texts come
    the change of the body and those of its media; place sorts them. A pair of urls is compared once, however many papers
    or revisions name it. The baseline gets its own text, unchanged, from the first file that was replaced.
    """
    known = versions.filter(F.coalesce("text", F.lit("")) != "").select("url", "text")
    files = changes.filter("field = 'pdf' AND kind = 'file' AND before_url IS NOT NULL")
    pairs = files.select("before_url", "after_url").distinct().join(known.select(F.col("url").alias("before_url"), F.col("text").alias("before")), "before_url").join(known.select(F.col("url").alias("after_url"), F.col("text").alias("after")), "after_url")
    pairs = written(pairs.withColumn("pair", F.concat_ws("\n", "before_url", "after_url")), "pairs")
    own = lambda side: pairs.select("pair", F.col(side).alias("url")).join(media, "url").drop("url")
    a, b = own("before_url"), own("after_url")
    matched = written(matched_media(a, b), "media")
    segments = body_segments(pairs.select("pair", "before", "after"), matched.filter("before_label <> after_label"))
    folded = segments.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("n", "op", "text"))).alias("s"))
    folded = folded.select("pair", F.transform("s", lambda x: F.struct(x["op"].alias("op"), x["text"].alias("text"))).alias("segments"))
    bodies = pairs.join(folded, "pair", "left").select("pair", F.lit("body").alias("field"), F.lit(BODY_LABEL).alias("label"), F.lit(None).cast("string").alias("after_label"), F.round(sequence_ratio(F.col("before"), F.col("after")), 3).alias("similarity"), F.coalesce("segments", F.array().cast(SEGMENTS)).alias("segments"), F.array(F.lit(0)).alias("rank"))
    state = F.when(~F.col("in_after"), 1).when(~F.col("in_before"), 2).otherwise(0)
    number = F.coalesce(T.first_number(F.col("label")), F.lit(0))
    shown = media_changes(a, b, matched).select("pair", F.lower("kind").alias("field"), "label", "after_label", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast(SEGMENTS).alias("segments"), F.array(F.array_position(F.array(*map(F.lit, MEDIA_KINDS)), F.col("kind")).cast("int"), state, number).alias("rank"))
    added = bodies.unionByName(shown)
    keyed = files.withColumn("pair", F.concat_ws("\n", "before_url", "after_url")).select("paper_id", "revision", "change_no", "pair")
    added = keyed.join(added, "pair").select("paper_id", "revision", F.concat(F.array("change_no", F.lit(1)), "rank").alias("place"), "field", "label", "after_label", "similarity", "segments")
    listed = changes.select("paper_id", "revision", F.array("change_no", F.lit(0)).alias("place"), "field", "label", F.lit(None).cast("string").alias("after_label"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast(SEGMENTS).alias("segments"))
    first = files.filter("revision > 0").join(known.select(F.col("url").alias("before_url"), "text"), "before_url").groupBy("paper_id").agg(F.min_by("text", F.struct("revision", "change_no")).alias("text"))
    base = first.join(changes.filter("revision = 0").select("paper_id").distinct(), "paper_id", "left_semi")
    base = base.select("paper_id", F.lit(0).alias("revision"), F.array(F.lit((1 << 31) - 1)).alias("place"), F.lit("body").alias("field"), F.lit(BODY_LABEL).alias("label"), F.lit(None).cast("string").alias("after_label"), F.lit(1.0).alias("similarity"), _segments("equal", T.paragraphs(F.col("text"))).alias("segments"))
    return listed.unionByName(added).unionByName(base)
