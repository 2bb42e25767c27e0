"""Log queries: edit folds, timelines, newest rows, upserts, caches, job states, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia import tables as tb
from marginalia.operators import sinks, timeline
from marginalia.queries.registry import query
from marginalia.session import checkpoint_dir
from marginalia.sources import harvest
from marginalia.streaming import jobs

_EDITS = """edits AS (SELECT user_id, event_id, event_type IN ('click', 'view', 'purchase') AS has_title, CASE WHEN event_type <> 'purchase' THEN event_type || (event_id % 3) END AS title, event_type IN ('view', 'login') AS has_pdf, CAST(json_extract(props, '$.k') AS INT) % 4 AS pdf FROM events)"""


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 4
    title = F.when(F.col("event_type") != "purchase", F.concat("event_type", (F.col("event_id") % 3).cast("string")))
    return e.select("user_id", "event_id", F.struct(F.col("event_type").isin("click", "view", "purchase").alias("present"), title.alias("value")).alias("title"), F.struct(F.col("event_type").isin("view", "login").alias("present"), k.cast("string").alias("value")).alias("pdf"))


@query(f"""WITH {_EDITS}, s AS (SELECT user_id, event_id, count(*) FILTER (WHERE has_title) OVER w AS seen, last_value(CASE WHEN has_title THEN [title] END IGNORE NULLS) OVER w AS t, last_value(CASE WHEN has_pdf THEN [pdf::VARCHAR] END IGNORE NULLS) OVER w AS p FROM edits WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS t0, lag(p) OVER (PARTITION BY user_id ORDER BY event_id) AS p0 FROM s)
  SELECT user_id, event_id, 'title' AS field, t0[1] AS old, t[1] AS new FROM l WHERE t0 IS NOT NULL AND t0[1] IS DISTINCT FROM t[1]
  UNION ALL SELECT user_id, event_id, 'pdf', p0[1], p[1] FROM l WHERE p0 IS NOT NULL AND p0[1] IS DISTINCT FROM p[1]""")
def edit_history(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of fields over a log of partial edits, deletes included."""
    folded = timeline.fold_edits(_edits(spark, sf), "user_id", ["event_id"], ["title", "pdf"])
    return timeline.field_changes(folded, "user_id", ["event_id"], ["title", "pdf"])


@query(f"""WITH {_EDITS}, s AS (SELECT user_id, event_id, last_value(CASE WHEN has_pdf THEN [pdf::VARCHAR] END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS p FROM edits),
  l AS (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY event_id) AS p0 FROM s) SELECT u.user_id, count(l.user_id) FILTER (WHERE p0 IS NOT NULL AND p0[1] IS DISTINCT FROM p[1]) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l ON l.user_id = u.user_id GROUP BY 1""")
def body_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions of the body by paper; 0 where it was watched and never changed."""
    e = _edits(spark, sf)
    changes = timeline.field_changes(timeline.fold_edits(e, "user_id", ["event_id"], ["pdf"]), "user_id", ["event_id"], ["pdf"])
    return e.select("user_id").distinct().join(changes.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n"))


_NOTES = """notes AS (SELECT conv_id AS paper_id, conv_id * 1000 + turn AS note_id, CASE role WHEN 'user' THEN 'review' WHEN 'assistant' THEN 'comment' ELSE 'submission' END AS kind, CASE WHEN turn % 2 = 1 THEN 'author' ELSE 'reviewer' END AS role,
  1700000000000 + turn * 60000 + conv_id % 7 AS created, 1700000000000 + turn * 60000 + (conv_id % 3) * 90000 + conv_id % 7 AS modified FROM conversations)"""


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    c = tb.read(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "review").when(F.col("role") == "assistant", "comment").otherwise("submission")
    at = F.lit(1700000000000) + F.col("turn") * 60000 + F.col("conv_id") % 7
    return c.select(F.col("conv_id").alias("paper_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), kind.alias("kind"), F.when(F.col("turn") % 2 == 1, "author").otherwise("reviewer").alias("role"), at.alias("created"), (at + (F.col("conv_id") % 3) * 90000).alias("modified"))


_TIMELINE = f"""{_NOTES}, b AS (SELECT paper_id, note_id, CASE WHEN kind = 'comment' AND role = 'author' THEN 'rebuttal' ELSE kind END AS kind, created AS "at", modified FROM notes WHERE kind <> 'submission'),
  ev AS (SELECT paper_id, note_id, kind, "at" FROM b UNION ALL SELECT paper_id, note_id, 'review_update', modified FROM b WHERE kind = 'review' AND modified > "at")"""


@query(f"""WITH {_TIMELINE} SELECT paper_id, note_id, kind, "at", strftime(make_timestamp("at" * 1000) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS shown FROM ev""")
def timelines(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a paper on one schema, with local times."""
    return timeline.note_events(_notes(spark, sf)).select("paper_id", "note_id", "kind", "at", "shown")


@query(f"""WITH {_TIMELINE} SELECT paper_id, count(*) FILTER (WHERE kind = 'review') AS reviews, count(*) FILTER (WHERE kind = 'review_update') AS updates, count(*) FILTER (WHERE kind = 'rebuttal') AS rebuttals, count(*) FILTER (WHERE kind = 'comment') AS comments FROM ev GROUP BY 1""")
def timeline_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional counts over the timeline."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return timeline.note_events(_notes(spark, sf)).groupBy("paper_id").agg(n("review").alias("reviews"), n("review_update").alias("updates"), n("rebuttal").alias("rebuttals"), n("comment").alias("comments"))


@query("""SELECT user_id, event_type AS step, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def latest_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of each step."""
    e = tb.read(spark, sf, "events").select("user_id", F.col("event_type").alias("step"), "event_id", "value", F.col("event_id").alias("at"))
    return timeline.progress(e, "user_id", "step", "at").select("user_id", "step", "latest.event_id", "latest.value")


@query("""SELECT user_id, count(*) AS n, string_agg(event_type || ':' || event_id, ',' ORDER BY event_id) AS log FROM events GROUP BY 1""")
def progress_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The log of each job as an array, in the order of its events."""
    log = timeline.progress_log(tb.read(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    text = F.array_join(F.transform("log", lambda e: F.concat_ws(":", e["event_type"], e["event_id"].cast("string"))), ",")
    return log.select("user_id", F.size("log").cast("bigint").alias("n"), text.alias("log"))


_FORUM = """n AS (SELECT conv_id, turn, conv_id || '/' || turn AS note_id, text, CASE WHEN turn = 1 THEN 'Submission' WHEN turn % 5 = 0 THEN 'Official_Review' WHEN turn % 5 = 1 THEN 'Official_Comment' WHEN turn % 5 = 2 THEN 'Meta_Review' WHEN turn % 5 = 3 THEN 'Decision' ELSE 'Other' END AS inv,
    CASE WHEN turn % 2 = 0 THEN '리뷰어 ' || turn ELSE '저자' END AS actor, turn % 2 = 1 AS author, 1700000000000 + turn * 60000 AS created, 1700000000000 + turn * 60000 + (conv_id % 2) * 90000 AS modified FROM conversations)"""


@query(f"""WITH {_FORUM}, k AS (SELECT *, CASE inv WHEN 'Official_Review' THEN 'review' WHEN 'Decision' THEN 'decision' WHEN 'Meta_Review' THEN 'meta_review' WHEN 'Official_Comment' THEN CASE WHEN author THEN 'rebuttal' ELSE 'comment' END END AS kind FROM n WHERE inv NOT IN ('Submission', 'Other')),
  e AS (SELECT conv_id, note_id AS event_id, created AS "at", kind, actor, CASE kind WHEN 'review' THEN actor || ' — ' || CASE WHEN conv_id % 3 = 0 THEN '8: accept' ELSE '5: borderline' END WHEN 'decision' THEN '최종 결과: ' || CASE WHEN conv_id % 2 = 0 THEN 'Accept' ELSE '결과 공개' END WHEN 'meta_review' THEN 'AC 총평'
      ELSE actor || CASE WHEN conv_id % 2 = 0 THEN ': About it' ELSE '의 코멘트' END END AS headline,
      CASE WHEN kind <> 'review' THEN md5(CASE WHEN length(text) > 3000 THEN rtrim(substr(text, 1, 3000), ' ') || ' …' ELSE text END) END AS text, CASE WHEN kind = 'review' THEN CASE WHEN conv_id % 3 = 0 THEN 8.0::DOUBLE ELSE 5 END END AS rating FROM k
    UNION ALL SELECT conv_id, note_id || ':update', modified, 'review_update', actor, actor || '가 저자 응답 이후 리뷰를 수정했습니다' || CASE WHEN conv_id % 3 = 0 THEN ' (최종 8: accept)' ELSE '' END || ' — 수정 전 내용은 공개되지 않습니다', NULL, CASE WHEN conv_id % 3 = 0 THEN 8.0::DOUBLE END FROM k WHERE kind = 'review' AND modified > created
    UNION ALL SELECT DISTINCT conv_id, conv_id || '/r' || r, 1700000000000 + r * 1000, 'author_revision', '저자', CASE r WHEN 0 THEN '관측 가능한 최초 제출본 — 이전 내용은 확인할 수 없습니다' WHEN 1 THEN '수정본 — 제목, 초록' ELSE '수정본 — 제목·초록·첨부파일에는 변화가 없습니다' END, NULL, NULL FROM conversations CROSS JOIN range(3) t(r))
  SELECT conv_id AS paper_id, event_id, "at", strftime(make_timestamp("at" * 1000) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS date, kind, actor, headline, text, rating FROM e""")
def forum_timelines(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of forums and revisions as events in words; stored reviews stand before live ones."""
    c = tb.read(spark, sf, "conversations")
    t, p = F.col("turn"), F.col("conv_id")
    inv = F.when(t == 1, "Submission").when(t % 5 == 0, "Official_Review").when(t % 5 == 1, "Official_Comment").when(t % 5 == 2, "Meta_Review").when(t % 5 == 3, "Decision").otherwise("Other")
    at = F.lit(1700000000000) + t * 60000
    note_id = F.concat_ws("/", p.cast("string"), t.cast("string"))
    notes = c.select(
        p.alias("paper_id"), p.alias("forum"), note_id.alias("note_id"), F.lit("none").alias("submission_id"), F.array(F.concat(F.lit("V/-/"), inv)).alias("invitations"),
        F.when(t % 2 == 0, F.concat(F.lit("V/Reviewer_"), t.cast("string"))).otherwise("V/Authors").alias("signature"), F.when(p % 2 == 0, at).alias("tcdate"), at.alias("cdate"), (at + (p % 2) * 90000).alias("tmdate"),
        F.when(p % 2 == 0, "About it").alias("title"), F.col("text").alias("body"), F.when(p % 2 == 0, "Accept").alias("verdict"), F.lit("5: borderline").alias("rating_raw"),
    )
    papers = c.select(p.alias("forum")).distinct()
    stored = c.filter("conv_id % 3 = 0").select(note_id.alias("note_id"), F.lit(8.0).alias("rating"), F.lit("8: accept").alias("rating_raw"))
    edits = papers.select(F.col("forum").alias("paper_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r"))
    labels = F.when(F.col("r") == 1, F.array(F.lit("제목"), F.lit("초록"))).otherwise(F.array().cast("array<string>"))
    revisions = edits.select("paper_id", F.concat_ws("/r", F.col("paper_id").cast("string"), F.col("r").cast("string")).alias("revision_id"), (F.lit(1700000000000) + F.col("r") * 1000).alias("at"), F.lit("수정본").alias("kind_label"), (F.col("r") == 0).alias("is_baseline"), labels.alias("labels"))
    return timeline.forum_events(harvest.forum_replies(notes, papers), stored, revisions).select("paper_id", "event_id", "at", "date", "kind", "actor", "headline", F.md5("text").alias("text"), "rating")


@query("""SELECT event_id, CASE WHEN status IN ('pending', 'running') AND n > 1 THEN 'failed' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, status IN ('pending', 'running') ORDER BY ts DESC, event_id DESC) AS n
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' ELSE 'done' END AS status FROM events))""")
def one_active_job(spark: SparkSession, sf: str) -> DataFrame:
    """Of several active jobs the newest stays."""
    status = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "running").otherwise("done")
    return timeline.fail_superseded(tb.read(spark, sf, "events").withColumn("status", status), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "status")


@query("""SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.name ELSE coalesce(nullif(n.name, ''), o.name) END AS name, CASE WHEN n.k IS NULL THEN o.bal ELSE coalesce(n.bal, o.bal) END AS bal, CASE WHEN n.k IS NULL THEN o.seg ELSE n.seg END AS seg
  FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0) o
  FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE upper(c_name) END AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + 1 END AS bal, 'new' AS seg FROM customer WHERE c_custkey % 2 = 0) n ON n.k = o.k""")
def upserted(spark: SparkSession, sf: str) -> DataFrame:
    """New rows over old ones, nulls and blanks leaving what was there."""
    c = tb.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    new = c.filter("k % 2 = 0").select("k", F.when(F.col("k") % 5 == 0, "").otherwise(F.upper("name")).alias("name"), F.when(F.col("k") % 4 != 0, F.col("bal") + 1).alias("bal"), F.lit("new").alias("seg"))
    return sinks.upsert(c.filter("k % 3 <> 0"), new, "k", keep=("bal",), keep_blank=("name",))


@query("""SELECT event_id, user_id FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN '{' ELSE props END AS payload FROM events) WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 10 DAY AND event_id % 2 = 0 AND json_valid(payload)""")
def cached_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a cache still holds of a key: young enough, made as asked for, and readable."""
    cache = tb.read(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("key"), F.col("ts").alias("built_at"), (F.col("event_id") % 2 == 0).alias("used_llm"), F.when(F.col("event_id") % 7 == 0, "{").otherwise(F.col("props")).alias("payload"))
    return sinks.cached(cache, F.lit("view"), F.lit("2024-01-20").cast("timestamp_ntz"), days=10, needs_llm=True).select("event_id", "user_id")


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 2 = 1),
  r AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 1, 1.0::DOUBLE FROM orders WHERE o_orderkey % 3 = 0)
  SELECT 'authors' AS t, count(*) AS n, sum(hash_part)::BIGINT AS total FROM (SELECT length(name) + k AS hash_part FROM a) UNION ALL SELECT 'reviews', count(*), sum(l_quantity)::BIGINT FROM r UNION ALL SELECT 'papers', count(*), sum(o_orderkey)::BIGINT FROM orders""")
def staged_load(spark: SparkSession, sf: str) -> DataFrame:
    """One load of papers, authors and reviews, each table from the same staged rows, and what it leaves."""
    authors = tb.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    papers, reviews = tb.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), tb.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new_authors = authors.filter("k % 2 = 1").withColumn("name", F.upper("name"))
    new_reviews = papers.filter("k % 3 = 0").select(F.col("k").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    loaded = {
        "authors": sinks.upsert(authors, new_authors, "k", keep_blank=("name",)).select((F.length("name") + F.col("k")).alias("x")),
        "reviews": sinks.replace_children(reviews, new_reviews, "l_orderkey").select(F.col("l_quantity").alias("x")),
        "papers": sinks.upsert(papers.withColumn("v", F.lit(0)), papers.filter("k % 3 = 0").withColumn("v", F.lit(1)), "k").select(F.col("k").alias("x")),
    }
    out = None
    for name, rows in loaded.items():
        row = rows.agg(F.count("*").alias("n"), F.sum("x").cast("bigint").alias("total")).select(F.lit(name).alias("t"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH new AS (SELECT o_orderkey AS l_orderkey, 1 AS l_linenumber, 0.0::DOUBLE AS l_quantity FROM orders WHERE o_orderkey % 5 = 0)
  SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new""")
def replaced_children(spark: SparkSession, sf: str) -> DataFrame:
    """All children of the given parents are replaced."""
    new = tb.read(spark, sf, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return sinks.replace_children(tb.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), new, "l_orderkey")


@query(f"""WITH {tb.PAPERS} SELECT p.id, coalesce(citation_count, c_custkey) AS citation_count FROM papers p LEFT JOIN customer c ON c.c_custkey = p.id""")
def filled(spark: SparkSession, sf: str) -> DataFrame:
    """A column filled where it was null."""
    found = tb.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("citation_count"))
    return sinks.fill(tb.papers(spark, sf), found, "id", "citation_count").select("id", "citation_count")


@query(f"""WITH {tb.PAPERS}, n AS (SELECT id, CASE WHEN id % 7 <> 0 THEN citation_count END AS citation_count FROM papers) SELECT n.id, n.citation_count FROM n JOIN papers p ON p.id = n.id WHERE n.citation_count IS DISTINCT FROM p.citation_count""")
def changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows whose value differs are written."""
    p = tb.papers(spark, sf)
    return sinks.changed_only(p, p.select("id", F.when(F.col("id") % 7 != 0, F.col("citation_count")).alias("citation_count")), "id", "citation_count")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def not_yet_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Where a resumed load starts."""
    done = tb.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return sinks.missing(tb.read(spark, sf, "documents").select("doc_id"), done, "doc_id")


@query("""WITH s AS (SELECT o_orderpriority AS venue, o_orderstatus AS stage, count(*) AS processed FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P' GROUP BY 1, 2), n AS (SELECT o_orderpriority AS venue, o_orderstatus AS stage, -count(*) AS processed FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
  SELECT coalesce(n.venue, s.venue) AS venue, coalesce(n.stage, s.stage) AS stage, coalesce(n.processed, s.processed) AS processed FROM s FULL JOIN n ON n.venue = s.venue AND n.stage = s.stage""")
def stage_status(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoints of stages, newest first."""
    o = tb.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("venue"), F.col("o_orderstatus").alias("stage"), "o_orderkey")
    old = o.filter("o_orderkey % 2 = 0 AND stage <> 'P'").groupBy("venue", "stage").agg(F.count("*").alias("processed"))
    return sinks.set_status(old, o.filter("stage <> 'F'").groupBy("venue", "stage").agg((-F.count("*")).alias("processed")))


@query("""SELECT c.c_custkey, coalesce(n.n_name, 'balanced') AS preset, coalesce(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END, 'balanced') AS focus FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 2 = 0""")
def preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups with defaults and whitelists."""
    n = tb.read(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = tb.read(spark, sf, "customer").join(F.broadcast(n), "c_nationkey", "left")
    return c.select("c_custkey", F.coalesce("n_name", F.lit("balanced")).alias("preset"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).otherwise("balanced").alias("focus"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts)::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """T03, and an addition: tumbling windows over the event log."""
    e = tb.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


_KIND = "CASE event_type WHEN 'view' THEN 'start' WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END"
_JOB_LIMIT = 2 * 24 * 60  # minutes: events of a user are days apart


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS job_id, ts AS seen, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'click'),
  s(key, k, held, since, ended, ended_since, ended_at, status) AS (SELECT key, 0, NULL::BIGINT, NULL::TIMESTAMP, []::BIGINT[], []::TIMESTAMP[], []::TIMESTAMP[], []::VARCHAR[] FROM (SELECT DISTINCT key FROM e)
    UNION ALL SELECT key, k, CASE WHEN kind = 'start' AND (held IS NULL OR old) THEN job_id WHEN kind = 'start' AND NOT old THEN held END, CASE WHEN kind = 'start' AND (held IS NULL OR old) THEN seen WHEN kind = 'start' AND NOT old THEN since END,
      CASE WHEN old OR (held IS NOT NULL AND kind <> 'start') THEN [held] ELSE [] END, CASE WHEN old OR (held IS NOT NULL AND kind <> 'start') THEN [since] ELSE [] END,
      CASE WHEN old THEN [since + INTERVAL {_JOB_LIMIT} MINUTE] WHEN held IS NOT NULL AND kind <> 'start' THEN [seen] ELSE [] END, CASE WHEN old THEN ['expired'] WHEN held IS NOT NULL AND kind <> 'start' THEN [kind] ELSE [] END
    FROM (SELECT s.key, e.k, e.kind, e.job_id, e.seen, s.held, s.since, coalesce(s.held IS NOT NULL AND e.seen >= s.since + INTERVAL {_JOB_LIMIT} MINUTE, false) AS old FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)),
  last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1)
  SELECT key AS user_id, unnest(ended) AS job_id, unnest(ended_since) AS created_at, unnest(ended_at) AS ended_at, unnest(status) AS status FROM s
  UNION ALL SELECT key, held, since, since + INTERVAL {_JOB_LIMIT} MINUTE, 'expired' FROM last WHERE held IS NOT NULL AND since + INTERVAL {_JOB_LIMIT} MINUTE <= (SELECT max(ts) FROM events)""")
def job_ends(spark: SparkSession, sf: str) -> DataFrame:
    """One active job a user, ended by events or by a timer, as a stream over event files that land part by part."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/marginalia/jobs-{uuid.uuid4().hex}"
    e = tb.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("job_id"), F.col("ts").alias("at"), F.expr(_KIND).alias("kind"))
    parts = F.ntile(4).over(Window.orderBy("day"))  # of a row a day
    days = e.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n")).withColumn("part", parts).groupBy("part").agg(F.min("day").alias("first"), F.max("day").alias("last")).orderBy("part").collect()
    for d in days:  # parts land in the order of their events; the stream is stopped after two and taken up again
        e.filter(F.to_date("at").between(d["first"], d["last"])).write.mode("append").parquet(f"{base}/events")
        if d.part % 2 == 0:
            jobs.follow(spark, f"{base}/events", f"{base}/ends", f"{base}/state", _JOB_LIMIT).awaitTermination()
    return spark.read.schema(jobs.SCHEMA).parquet(f"{base}/ends").withColumnRenamed("key", "user_id")
