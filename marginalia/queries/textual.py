"""Text queries: segmentation, classification, parsing, hashing, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia import tables as tb
from marginalia.functions import rank as R, text as T
from marginalia.operators import diff, layout, revisions
from marginalia.queries.registry import query

_SPLIT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1␞\2', 'g'), '␞'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) >= 25)[1:12]"


_BULLETS = r"list_filter(list_transform(regexp_split_to_array(text, '(?m)^\s*(?:[-*•·▪]|\(?\d+[.)]|\(?[a-z][.)])\s+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) >= 25)[1:12]"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '(?m)^\s*(?:[-*•·▪]|\(?\d+[.)]|\(?[a-z][.)])\s+')) >= 2 THEN {_BULLETS} ELSE {_SPLIT} END AS p FROM d)
  SELECT doc_id, len(p) AS points, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::BIGINT AS chars FROM s""")
def sentence_points(spark: SparkSession, sf: str) -> DataFrame:
    """points of texts, by their bullets or sentences."""
    d = tb.read(spark, sf, "documents").select("doc_id", T.split_points(F.col("text")).alias("p"))  # once, for both columns
    return d.select("doc_id", F.size("p").cast("bigint").alias("points"), F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("chars"))


_SENTENCES = ["The baselines are weak and SOTA is missing.", "Limited novelty; it is incremental.", "Unclear how to set hyperparameters.", "The proof is wrong.", "No ImageNet results.", "Typos everywhere.", "It fails to cite prior work.", "The impact is small.", "I like it."]
_ASPECT = " ".join(f"WHEN regexp_matches(low, '{'|'.join(patterns)}') THEN '{aspect}'" for aspect, patterns in T.ASPECT_KEYWORDS)


@query(f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || [{', '.join(f"'{x}'" for x in _SENTENCES)}][1 + doc_id % 9]) AS low FROM documents)
  SELECT doc_id, CASE {_ASPECT} ELSE 'other' END AS aspect FROM t""")
def aspects(spark: SparkSession, sf: str) -> DataFrame:
    """the aspect of every document with a sentence behind it (the texts themselves hold no keywords)."""
    more = F.element_at(F.array(*map(F.lit, _SENTENCES)), (1 + F.col("doc_id") % 9).cast("int"))
    return tb.read(spark, sf, "documents").select("doc_id", T.classify_aspect(F.concat_ws(" ", F.coalesce("text", F.lit("")), more)).alias("aspect"))


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t FROM documents), s AS (SELECT doc_id, t, doc_id % 4 <> 1 AND length(trim(t)) >= 40 AS found FROM d)
  SELECT doc_id, CASE WHEN found THEN length(trim(t)) END AS section_chars FROM s""")
def weakness_sections(spark: SparkSession, sf: str) -> DataFrame:
    """what stands under the weakness headings of unsplit reviews."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "Pros: a good idea that is well written overall.\nCons: ").when(k == 2, "Strengths: it works.\nWeaknesses:\n").otherwise("Summary: as said.\n\nWeaknesses: ")
    body = F.when(k == 1, F.lit("Cons: short")).otherwise(F.concat(head, t, F.lit("\nQuestions: "), t))
    return tb.read(spark, sf, "documents").select("doc_id", F.length(T.weakness_section(body)).alias("section_chars"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t FROM documents)
  SELECT doc_id, md5(trim(CASE WHEN doc_id % 2 = 0 THEN 'a b c 1' ELSE substr(t, 1, 2500) END)) AS abstract FROM d""")
def abstracts_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """the abstract of a first page, between its heading and the introduction, or its beginning."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    page = F.when(F.col("doc_id") % 2 == 0, F.lit("Title\nAbstract: a\n b  c\n1 Introduction\nx")).otherwise(t)
    return tb.read(spark, sf, "documents").select("doc_id", F.md5(T.abstract_of(page)).alias("abstract"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Rebuttal_Revision' WHEN 1 THEN 'Camera_Ready_Revision' WHEN 2 THEN 'Withdrawal' WHEN 3 THEN 'Submission' WHEN 4 THEN 'Desk_Rejection' WHEN 5 THEN 'Revision' ELSE 'Some_Note' END AS suffix,
  ['rebuttal', 'camera_ready', 'withdrawal', 'submission', 'withdrawal', 'revision', 'Some Note'][1 + event_id % 7] AS kind, ['리뷰 반영 수정', '게재 확정본', '철회', '최초 제출', '데스크 리젝', '수정본', 'Some Note'][1 + event_id % 7] AS label,
  ['저자', '리뷰어 ' || user_id, 'AC', 'PC', '익명', 'Some One'][1 + event_id % 6] AS actor, CASE WHEN event_id % 3 = 0 THEN '(그림 ' || event_id || ')' WHEN event_id % 3 = 1 THEN '(박스 a' || event_id || ')' END AS placeholder,
  event_type || '가' AS named FROM events""")
def note_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds and names of invitations and actors, placeholders of media, particles."""
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    pick = lambda xs, n: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (1 + e % n).cast("int"))
    path = F.concat(F.lit("V/2024/-/"), pick(["Rebuttal_Revision", "Camera_Ready_Revision", "Withdrawal", "Submission", "Desk_Rejection", "Revision", "Some_Note"], 7))
    suffix = T.path_tails(F.array(path))[0]
    signature = pick(["V/Authors", F.concat(F.lit("V/Reviewer_"), user), "V/Area_Chair_x", "V/Program_Chairs", "", "V/Some_One"], 6)
    label = F.when(e % 3 == 0, F.concat(F.lit("Figure "), e.cast("string"))).when(e % 3 == 1, F.concat(F.lit("Box a"), e.cast("string"))).otherwise("Section 1")
    return tb.read(spark, sf, "events").select("event_id", suffix.alias("suffix"), T.invitation_kind(suffix).alias("kind"), T.invitation_label(suffix).alias("label"), T.actor_name(signature).alias("actor"), T.label_placeholder(label).alias("placeholder"), T.with_particle(F.col("event_type"), "이", "가").alias("named"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 8.0 WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN 2.5 END AS score,
  CASE p_partkey % 6 WHEN 0 THEN 'accept-poster' WHEN 1 THEN 'reject' WHEN 2 THEN 'withdrawn' WHEN 3 THEN 'desk-reject' WHEN 4 THEN 'accept-oral' ELSE 'unknown' END AS decision FROM part""")
def scores_and_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and decisions from raw texts."""
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, "8: Accept").when(k % 5 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" fair"))).when(k % 5 == 2, "none").when(k % 5 == 3, "2.5")
    venue = F.when(k % 6 == 0, "ICLR 2024 poster").when(k % 6 == 1, "Submitted to ICLR 2024").when(k % 6 == 2, "ICLR 2024 Conference Withdrawn Submission").when(k % 6 == 3, "ICLR 2024 Conference Desk Rejected Submission").when(k % 6 == 4, "")
    note = F.when(k % 6 == 4, "Accept (Oral)").otherwise("")
    return tb.read(spark, sf, "part").select("p_partkey", T.parse_score(raw).alias("score"), T.normalize_decision(venue, note).alias("decision"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g')) AS clean_chars, substr(sha1(text), 1, 10) AS content_hash, length(text) || ':' || substr(sha256(text), 1, 8) AS shape,
  len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p)), lambda p: p <> '')) AS paragraphs, CASE WHEN length(text) > 3000 THEN rtrim(substr(text, 1, 3000), ' ') || ' …' ELSE text END AS clipped FROM documents""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning, clipping, hashing, paragraphs."""
    t = F.col("text")
    return tb.read(spark, sf, "documents").select("doc_id", F.length(T.clean_text(t)).cast("bigint").alias("clean_chars"), T.content_hash(t).alias("content_hash"), T.log_shape(t).alias("shape"), F.size(T.paragraphs(t)).cast("bigint").alias("paragraphs"), T.clip(t).alias("clipped"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS t FROM documents), n AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: regexp_full_match(x, '[A-Za-z]'))) AS s FROM t)
  SELECT doc_id, n >= 20 AND s > 0.18::DOUBLE * n AS garbled FROM n""")
def garbled_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of mostly single letters."""
    return tb.read(spark, sf, "documents").select("doc_id", T.looks_garbled(F.col("text")).alias("garbled"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, (CAST(json_extract(props, '$.k') AS INT) - 44032) IS NOT NULL AS known FROM events""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Values of JSON fields."""
    e = tb.read(spark, sf, "events").withColumn("j", T.loads(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k INT"))
    return e.select("event_id", F.col("j.k").alias("k"), F.col("j.k").isNotNull().alias("known"))


@query("""WITH b AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn % 2 = 0 THEN 'head ' || conv_id ELSE text END AS text FROM conversations), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM b GROUP BY 1)
  SELECT b.doc_id, text, count(DISTINCT page) AS n FROM b JOIN p USING (doc_id) GROUP BY b.doc_id, text, pages HAVING pages >= 3 AND count(DISTINCT page) >= greatest(3, 0.3 * pages)""")
def running_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that repeat over the pages of a document."""
    c = tb.read(spark, sf, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("head "), F.col("conv_id").cast("string"))).otherwise(F.col("text"))
    return layout.repeated_blocks(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), text.alias("text")))


@query("""SELECT conv_id AS doc_id, median(length(text)) * 0.5 AS gap FROM conversations GROUP BY 1""")
def line_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Half the median line height."""
    c = tb.read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("y0"), F.length("text").alias("y1"))
    return layout.line_gap(c)


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: (abs(x) * 255)::INT) AS v FROM embeddings)
  SELECT a.vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))) / (255.0::DOUBLE * 64), 6) AS sim FROM p a JOIN p b ON b.vec_id = a.vec_id + 1""")
def image_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of grey values."""
    e = tb.read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.rint(F.abs(x) * F.lit(255).cast("float")).cast("int")).alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(R.image_similarity(F.col("v"), F.col("w")), 6).alias("sim"))


@query()
def turn_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Word segments between the turns of a conversation, with and without breaks, and segments by paragraphs."""
    c = tb.read(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    rows = c.join(nxt, ["conv_id", "turn"])
    pair = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair")
    paras = revisions.body_segments(rows.select(pair, F.col("text").alias("before"), "after")).groupBy("pair").agg(F.count("*").alias("paragraph_segments"))
    words, kept = diff.word_diff(F.col("text"), F.col("after")), diff.word_diff(F.col("text"), F.col("after"), keep_breaks=True)
    out = rows.select("conv_id", "turn", pair, F.size(words).alias("word_segments"), F.size(kept).alias("kept_segments"), F.round(diff.sequence_ratio(F.col("text"), F.col("after")), 6).alias("ratio"))
    return out.join(paras, "pair", "left").select("conv_id", "turn", "word_segments", "kept_segments", F.coalesce("paragraph_segments", F.lit(0)).alias("paragraph_segments"), "ratio")


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as papers of two versions: the second one has turns in another order, a new paragraph and other figures."""
    turns = tb.read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = turns.select("conv_id", F.transform("t", lambda x: x["text"]).alias("t"))
    n = F.col("conv_id") % 3
    figure = lambda i: F.array(F.concat(F.lit("(그림 "), i.cast("string"), F.lit(")")))
    before = F.concat(F.slice("t", 1, 2), figure(F.lit(1)), F.slice("t", F.lit(3), F.size("t")), figure(F.lit(2)))
    after = F.concat(F.slice("t", 2, 1), figure(n + 1), F.slice("t", 1, 1), F.slice("t", F.lit(3), F.size("t")), F.array(F.lit("One more paragraph that the authors wrote for this version.")), figure(F.lit(2) - n % 2))
    url = lambda v: F.concat(F.lit(f"v{v}/"), F.col("conv_id").cast("string"))
    rows = texts.select("conv_id", F.explode(F.array(F.struct(url(1).alias("url"), before.alias("p")), F.struct(url(2).alias("url"), after.alias("p")))).alias("v"))
    versions = rows.select("v.url", F.array_join("v.p", "\n\n").alias("text"))
    caption = F.when(F.col("url").startswith("v1"), F.col("k")).otherwise((F.col("k") + F.col("conv_id") - 1) % 2 + 1)
    media = rows.select("conv_id", "v.url", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k"))
    media = media.select("url", F.concat(F.lit("Figure "), F.col("k").cast("string")).alias("label"), F.when(caption == 1, "Overview of the whole method").otherwise("Results for each data set").alias("caption"), F.lit(None).cast("string").alias("content"), F.array().cast("array<int>").alias("signature"), F.lit(10).alias("bytes"))
    none = F.lit(None).cast("string")
    change = lambda r, field, kind, a, b: F.struct(F.lit(r).alias("revision"), F.lit(0).alias("change_no"), F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(field).alias("label"), a.alias("before_url"), b.alias("after_url"))
    changes = texts.select(F.col("conv_id").alias("paper_id"), F.explode(F.array(change(0, "title", "text", none, none), change(1, "pdf", "file", url(1), url(2)))).alias("c")).select("paper_id", "c.*")
    return changes, versions, media


@query()
def body_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of papers with their bodies by paragraphs and their figures, moved and renumbered."""
    out = revisions.body_changes(*_versions(spark, sf))
    count = lambda op: F.size(F.filter(F.coalesce("segments", F.array().cast(diff.SEGMENTS)), lambda s: s["op"] == op)).alias(op)
    return out.select("paper_id", "revision", F.array_join(F.transform("place", lambda x: x.cast("string")), ".").alias("place"), "field", "label", "after_label", "similarity", *(count(op) for op in ("equal", "insert", "moved")), count("delete").alias("deleted"))
