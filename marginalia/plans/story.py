"""The parts of a paper's story: what its authors changed, and what is said where nothing was selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions import text as T

# Texts of the report.
REBUTTALS, CHANGED = "저자 응답 {}건", "변경"
NO_REVIEWS = "비슷한 논문을 찾지 못해 보여드릴 리뷰가 없습니다."
NO_MATCH = "비슷하다고 판단할 만한 논문을 찾지 못했습니다. 검색에는 걸렸지만 본문을 대조한 결과 같은 문제를 다루는 논문이 아니었습니다."


def change_text(change: Column) -> Column:
    """A change (kind, label, after, similarity) in words: a share of the text, what became of a file, or that it changed."""
    share = F.bround((1 - change["similarity"]) * 100, 0).cast("int")
    text = F.when((change["kind"] == "text") & change["similarity"].isNotNull(), F.concat(share.cast("string"), F.lit(f"% {CHANGED}")))
    return F.concat_ws(" ", change["label"], text.when(change["kind"] == "file", change["after"]).otherwise(CHANGED))


def changed_items(events: DataFrame, cap: int = 6) -> DataFrame:
    """(paper_id, items): up to cap items of each paper, the number of rebuttals first, then its revisions in time.

    events: paper_id, at (text), seq, kind, is_baseline, changes. Baselines and revisions without changes are left out;
    papers with neither rebuttals nor revisions have no row. Only cap revisions of a paper are ever brought together.
    """
    answers = events.filter("kind = 'rebuttal'").groupBy("paper_id").agg(F.count("*").alias("n"))
    first, last = REBUTTALS.split("{}")
    answers = answers.select("paper_id", F.array(F.concat(F.lit(first), F.col("n").cast("string"), F.lit(last))).alias("answered"))
    edits = events.filter("kind = 'author_revision' AND NOT is_baseline AND size(changes) > 0")
    edits = edits.withColumn("k", F.row_number().over(Window.partitionBy("paper_id").orderBy("at", "seq"))).filter(F.col("k") <= cap)
    text = F.concat_ws(" ", F.substring("at", 1, 10), F.array_join(F.transform("changes", change_text), ", "))
    edits = edits.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("k", text.alias("text")))).alias("edits"))
    both = answers.join(edits, "paper_id", "full_outer")
    none = F.array().cast("array<string>")
    texts = F.transform(F.col("edits"), lambda e: e["text"])
    return both.select("paper_id", F.slice(F.concat(F.coalesce("answered", none), F.coalesce(texts, none)), 1, cap).alias("items"))


# The sentences of a story that nobody wrote.
ASKED, SINGLE_ANSWERS, SINGLE_EDITS, BOTH = "{}을 지적받았고, ", "저자 응답 {}건", "저자 수정 {}회", " · "
DID, RECORDED, NOTHING_DONE, NOTHING_ASKED, RESULT = " 있었습니다.", " 기록돼 있습니다.", "공개된 저자 대응 기록은 없습니다.", "공개된 리뷰 지적 항목이 없습니다.", "이 투고의 결과는 {}입니다."


def headline(topic: Column, rebuttals: Column, revisions: Column) -> Column:
    """The story in a sentence: the foremost aspect (null if none), how often authors answered and revised."""
    counted = lambda text, n: F.when(n > 0, F.concat(F.lit(text.split("{}")[0]), n.cast("string"), F.lit(text.split("{}")[1])))
    did = F.concat_ws(BOTH, counted(SINGLE_ANSWERS, rebuttals), counted(SINGLE_EDITS, revisions))
    asked = F.concat(topic, F.lit(" 등"), F.lit(ASKED.removeprefix("{}")))
    done = T.with_particle(did, "이", "가")
    with_topic = F.when(did != "", F.concat(asked, done, F.lit(DID))).otherwise(F.concat(asked, F.lit(NOTHING_DONE)))
    return F.when(topic.isNotNull(), with_topic).when(did != "", F.concat(done, F.lit(RECORDED))).otherwise(NOTHING_ASKED)


def outcome_note(decision: Column, message: Column) -> Column:
    before, after = RESULT.split("{}")
    return F.coalesce(message, F.concat(F.lit(before), decision, F.lit(after)))


def reports(queries: DataFrame, confidence: DataFrame, candidates: DataFrame, selected: DataFrame, evidence: DataFrame, summaries: DataFrame) -> DataFrame:
    """A row for each query: its title, confidence, candidates, selected papers, evidence and summary with its citations.

    queries: query_id, title, abstract, preferences; confidence: query_id, level, mean_cosine; candidates: query_id, rank,
    paper_id, match_type; selected: query_id, llm_rank, paper_id, reason; evidence: query_id, label, paper_id, text;
    summaries: query_id, summary. Citations are the labels of the evidence that the summary names. What a query
    lacks is an empty list, or no confidence at all: weak.
    """
    rows = lambda df, name, order: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))
    listed = [rows(candidates, "candidates", ("rank", "paper_id", "match_type")), rows(selected, "selected", ("llm_rank", "paper_id", "reason"))]
    numbered = evidence.withColumn("kind", F.substring("label", 1, 1)).withColumn("number", T.number_in(F.col("label")))
    listed.append(rows(numbered, "evidence", ("kind", "number", "label", "paper_id", "text")))
    out = queries.join(confidence, "query_id", "left").join(summaries, "query_id", "left")
    for df in listed:
        out = out.join(df, "query_id", "left")
    labels = F.transform("evidence", lambda e: e["label"])
    cited = F.coalesce(T.citation_labels(F.coalesce("summary", F.lit("")), labels), F.array().cast("array<string>"))
    full = {c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for df, c in zip(listed, ("candidates", "selected", "evidence"), strict=True)}
    return out.withColumn("citations", cited).withColumns({"level": F.coalesce("level", F.lit("weak")), "mean_cosine": F.coalesce("mean_cosine", F.lit(0.0)), **full})


def capped_texts(rows: DataFrame, order: list, cap: int = 6, chars: int = 1200) -> DataFrame:
    """(paper_id, texts): the first cap texts of each paper by order, each cut to chars: what a writer is given of the facts."""
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))).filter(F.col("k") <= cap)
    listed = F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, chars).alias("text"))))
    return rows.groupBy("paper_id").agg(F.transform(listed, lambda x: x["text"]).alias("texts"))


def nothing_selected(level: Column, message: Column) -> Column:
    """The summary where no paper was selected: a warning if the retrieval was weak, else that the texts didn't match."""
    return F.when(level == "weak", F.concat(F.lit("> ⚠️ **"), message, F.lit(f"**\n\n{NO_REVIEWS}"))).otherwise(NO_MATCH)


# What is said of a history that can't be shown, or not in full.
NO_HISTORY, NOT_READ = "{}는 심사 이력을 조회할 수 없는 학회입니다.", "OpenReview 조회에 실패했습니다 ({}). 잠시 후 다시 시도해 주세요."
FINAL_REVIEWS = "리뷰 본문과 점수는 최종 수정본입니다. 리뷰어가 저자 응답 이후 리뷰를 고친 경우 최초 게시 시점의 내용과 다르며, 고치기 전 점수는 공개되지 않습니다."
OLD_INTERFACE = "이 학회는 저자 수정 이력을 공개하지 않습니다(2023년 이전 학회는 구 API를 씁니다). 리뷰와 저자 응답은 아래에 있지만, 저자가 제목·초록·PDF를 어떻게 고쳤는지는 볼 수 없습니다 — 고치지 않았다는 뜻이 아닙니다."
BODY_UNSEEN = "확인할 수 있는 수정은 제목·초록·첨부파일까지입니다. 논문 본문이 어떻게 바뀌었는지는 PDF 안에 있어 알 수 없습니다."
NO_EDITS = "저자가 제목·초록을 고친 기록은 공개되지 않았습니다. 수정하지 않았다는 뜻이 아니라, 학회가 수정 내역을 열지 않은 경우입니다."
NO_EVENTS = "이 논문에는 공개된 리뷰·응답 기록이 없습니다."


def histories(papers: DataFrame, registry: DataFrame, landed: DataFrame) -> DataFrame:
    """(paper_id, supported, replies, caveats): each paper's history, or in its place why there is none; a part that fails takes no row with it.

    papers: paper_id, venue; registry: venue, version (v1 or v2) of venues that have histories; landed: paper_id, replies and
    edits as JSON arrays, error where reading them failed. replies is the landed array where it can be read. Edits of a
    paper that aren't its baseline change what the caveats say.
    """
    rows = papers.join(registry, "venue", "left").join(landed.withColumn("landed", F.lit(True)), "paper_id", "left")
    readable = F.coalesce(F.col("landed") & F.col("error").isNull() & F.try_parse_json("replies").isNotNull() & F.try_parse_json("edits").isNotNull(), F.lit(False))
    known = F.col("version").isNotNull()
    why = F.when(~F.coalesce("landed", F.lit(False)), "NotFound").otherwise(F.coalesce("error", F.lit("JSONDecodeError")))
    said = lambda text, value: F.concat(F.lit(text.split("{}")[0]), value, F.lit(text.split("{}")[1]))
    edited = F.exists(F.from_json("edits", "ARRAY<STRUCT<is_baseline: BOOLEAN>>"), lambda e: ~F.coalesce(e["is_baseline"], F.lit(False)))
    empty = (F.coalesce(F.json_array_length("replies"), F.lit(0)) == 0) & (F.coalesce(F.json_array_length("edits"), F.lit(0)) == 0)
    notes = F.array(F.lit(FINAL_REVIEWS), F.when(F.col("version") != "v2", OLD_INTERFACE).when(F.coalesce(edited, F.lit(False)), BODY_UNSEEN).otherwise(NO_EDITS), F.when(empty, NO_EVENTS))
    caveats = F.when(~known, F.array(said(NO_HISTORY, F.col("venue")))).when(~readable, F.array(said(NOT_READ, why))).otherwise(F.array_compact(notes))
    return rows.select("paper_id", (known & readable).alias("supported"), F.when(known & readable, F.col("replies")).alias("replies"), caveats.alias("caveats"))
