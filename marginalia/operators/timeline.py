"""Event logs: timelines of notes, folds of partial edits, newest rows and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marginalia.functions import text as T


def fold_edits(edits: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The state of each field after each edit, as <field>_now, from structs (present, value) in <field>.

    A field that an edit leaves out keeps its value; one that is present with a null value is deleted.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    now = {f"{f}_now": F.last(F.when(F.col(f)["present"], F.col(f)), ignorenulls=True).over(w) for f in fields}
    return edits.withColumns(now)


def field_changes(folded: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Rows (key, order..., field, old, new) where a field differs from the version before.

    A field's first appearance is no change, and neither is the first row.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = {f"{f}_was": F.lag(f"{f}_now").over(w) for f in fields}
    rows = folded.withColumns(before)
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_was").alias("was"), F.col(f"{f}_now").alias("now")) for f in fields])
    rows = rows.select(key, *order, F.explode(entries).alias("e"))
    old, new = F.col("e.was.value"), F.col("e.now.value")
    return rows.filter(F.col("e.was").isNotNull() & ~old.eqNullSafe(new)).select(key, *order, F.col("e.field").alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new"))


def note_events(notes: DataFrame) -> DataFrame:
    """Events of one schema from notes (paper_id, note_id, kind, role, created, modified).

    Submissions are dropped; a review that was changed after its creation gives a review_update too; an author's comment
    is a rebuttal. Ordered by time, then by kind.
    """
    at = F.coalesce(F.nullif(F.col("created"), F.lit(0)), F.lit(0))
    kind = F.when((F.col("kind") == "comment") & (F.col("role") == "author"), "rebuttal").otherwise(F.col("kind"))
    base = notes.filter("kind <> 'submission'").select("paper_id", "note_id", kind.alias("kind"), at.alias("at"), "modified")
    updates = base.filter("kind = 'review' AND modified > at").select("paper_id", "note_id", F.lit("review_update").alias("kind"), F.col("modified").alias("at"))
    return base.drop("modified").unionByName(updates).withColumn("shown", T.kst_minute(F.col("at"))).withColumn("kind_order", kind_order(F.col("kind")))


# The order of kinds that happen at one time.
KIND_ORDER = ("submission", "review", "review_update", "rebuttal", "comment", "revision", "decision")


def kind_order(kind):
    order = F.lit(len(KIND_ORDER))
    for i, name in enumerate(KIND_ORDER):
        order = F.when(kind == name, i).otherwise(order)
    return order


def newest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def fail_superseded(jobs: DataFrame, key: str, order: list) -> DataFrame:
    """Of several active jobs of a key the newest stays as it is, the others fail."""
    active = F.col("status").isin("pending", "running")
    n = F.row_number().over(Window.partitionBy(key, active).orderBy(*order))
    return jobs.withColumn("status", F.when(active & (n > 1), "failed").otherwise(F.col("status")))


def expired(jobs: DataFrame, now, minutes: int = 15) -> DataFrame:
    """Active jobs older than minutes fail."""
    stale = F.col("status").isin("pending", "running") & (F.col("created_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def progress(events: DataFrame, key: str, step: str, at: str) -> DataFrame:
    """The newest event of each step."""
    return events.groupBy(key, step).agg(F.max_by(F.struct(*[c for c in events.columns if c not in (key, step)]), at).alias("latest"))


def progress_log(events: DataFrame, key: str, at: str) -> DataFrame:
    """(key, log): the events of each key as an array in the order in which they were appended."""
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, *[c for c in events.columns if c not in (key, at)]))).alias("log"))


# What events are called and said to be.
EVENT_LABELS = {"review": "리뷰", "review_update": "리뷰 수정", "rebuttal": "저자 응답", "comment": "코멘트", "author_revision": "저자 수정", "meta_review": "AC 총평", "decision": "최종 결과"}
EVENT_ORDER = tuple(EVENT_LABELS)
NO_SCORE, OPEN_RESULT, META, FIRST_SEEN = "점수 미기재", "결과 공개", "AC 총평", "관측 가능한 최초 제출본 — 이전 내용은 확인할 수 없습니다"
UPDATED, UNSEEN, COMMENT, RESULT, UNTOUCHED = "가 저자 응답 이후 리뷰를 수정했습니다", " — 수정 전 내용은 공개되지 않습니다", "의 코멘트", "최종 결과: ", "제목·초록·첨부파일에는 변화가 없습니다"


def forum_events(notes: DataFrame, reviews: DataFrame, revisions: DataFrame) -> DataFrame:
    """(paper_id, event_id, at, date, kind, kind_label, actor, headline, text, rating): what happened to papers, in words.

    notes: paper_id, note_id, submission_id, invitations (array of paths), signature, tcdate, cdate, tmdate, title, body,
    verdict, rating_raw. reviews: note_id, rating, rating_raw as stored, which stand before what the note says. revisions:
    paper_id, revision_id, at, kind_label, is_baseline, labels (array). The submission itself is left out, as are notes of
    other kinds. Sorted by at, kind_order it is the timeline.
    """
    kinds = T.path_tails(F.col("invitations"))
    holds = lambda k: F.array_contains(kinds, k)
    answer = F.exists(kinds, lambda k: k.endswith("Comment") | k.contains("Rebuttal"))
    author = T.actor_role(F.col("signature")) == "author"
    kind = F.when(holds("Official_Review"), "review").when(holds("Decision"), "decision").when(holds("Meta_Review"), "meta_review").when(answer & author, "rebuttal").when(answer, "comment")
    at = F.coalesce(F.nullif(F.col("tcdate"), F.lit(0)), F.nullif(F.col("cdate"), F.lit(0)), F.lit(0))
    rows = notes.filter(~((F.coalesce(F.col("note_id") == F.col("submission_id"), F.lit(False))) | holds("Submission") | holds("Blind_Submission")))
    rows = rows.withColumns({"kind": kind, "at": at.cast("long"), "actor": T.actor_name(F.col("signature"))}).filter("kind IS NOT NULL")
    stored = reviews.select("note_id", F.col("rating").alias("db_rating"), F.col("rating_raw").alias("db_raw"), F.lit(True).alias("stored"))
    rows = rows.join(stored, "note_id", "left")
    raw = F.when(F.col("stored"), F.nullif("db_raw", F.lit(""))).otherwise(F.nullif("rating_raw", F.lit("")))
    number = F.when(F.col("stored"), F.col("db_rating")).otherwise(T.parse_score(F.col("rating_raw")))
    said = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    named = F.coalesce(F.concat("actor", F.lit(": "), said("title")), F.concat("actor", F.lit(COMMENT)))
    headline = F.when(F.col("kind") == "review", F.concat("actor", F.lit(" — "), F.coalesce(raw, number.cast("string"), F.lit(NO_SCORE)))).when(F.col("kind") == "decision", F.concat(F.lit(RESULT), F.coalesce(said("verdict"), F.lit(OPEN_RESULT)))).when(F.col("kind") == "meta_review", META).otherwise(named)
    none = F.lit(None).cast("string")
    text = F.when(F.col("kind") != "review", T.clip(said("body")))
    shown = rows.select("paper_id", F.col("note_id").alias("event_id"), "at", "kind", "actor", headline.alias("headline"), text.alias("text"), F.when(F.col("kind") == "review", number).alias("rating"))
    final = F.coalesce(F.concat(F.lit(" (최종 "), F.when(F.col("stored"), F.nullif("db_raw", F.lit(""))), F.lit(")")), F.lit(""))
    later = rows.filter((F.col("kind") == "review") & (F.col("tmdate") > F.col("at")))
    later = later.select("paper_id", F.concat("note_id", F.lit(":update")).alias("event_id"), F.col("tmdate").cast("long").alias("at"), F.lit("review_update").alias("kind"), "actor", F.concat("actor", F.lit(UPDATED), final, F.lit(UNSEEN)).alias("headline"), none.alias("text"), F.col("db_rating").alias("rating"))
    changes = F.when(F.size("labels") > 0, F.array_join(F.slice("labels", 1, 4), ", ")).otherwise(UNTOUCHED)
    told = F.when(F.col("is_baseline"), FIRST_SEEN).otherwise(F.concat("kind_label", F.lit(" — "), changes))
    edits = revisions.select("paper_id", F.col("revision_id").alias("event_id"), F.col("at").cast("long").alias("at"), F.lit("author_revision").alias("kind"), F.lit(T.AUTHOR).alias("actor"), told.alias("headline"), none.alias("text"), F.lit(None).cast("double").alias("rating"))
    events = shown.unionByName(later).unionByName(edits)
    label = F.element_at(F.create_map(*[F.lit(x) for pair in EVENT_LABELS.items() for x in pair]), F.col("kind"))
    order = F.array_position(F.array(*map(F.lit, EVENT_ORDER)), F.col("kind")) - 1
    return events.select("paper_id", "event_id", "at", T.kst_minute(F.col("at")).alias("date"), "kind", order.cast("int").alias("kind_order"), label.alias("kind_label"), "actor", "headline", "text", "rating")
