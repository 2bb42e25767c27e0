"""Text functions over review and paper fields, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Kinds of aspect with their keyword patterns, in order of precedence.
ASPECT_KEYWORDS = [
    ("experimental_scale", [r"\bimagenet\b", r"\blarger (?:dataset|scale|benchmark)", r"\bsmall(?:er)? (?:dataset|scale)", r"\btoy (?:dataset|example)", r"\bonly .{0,20}(?:cifar|mnist)", r"\bscalab", r"\bscale up\b"]),
    ("baselines", [r"\bbaseline", r"\bcompar(?:e|ison|ed) (?:to|with|against)", r"\bsota\b", r"\bstate[- ]of[- ]the[- ]art", r"\bmissing compar", r"\bstronger baseline"]),
    ("novelty", [r"\bnovelt", r"\bincrement", r"\bnot novel", r"\blimited (?:novelty|contribution)", r"\bmarginal (?:contribution|improvement)", r"\bsimilar to (?:prior|existing)"]),
    ("theoretical_soundness", [r"\btheor", r"\bproof\b", r"\bassumption", r"\bderivation", r"\bmathematic", r"\bformal(?:ly)? (?:incorrect|wrong)", r"\brigor"]),
    ("reproducibility", [r"\breproduc", r"\bcode (?:is )?(?:not )?(?:available|released)", r"\bimplementation detail", r"\bhyperparameter", r"\bunclear how to"]),
    ("clarity", [r"\bunclear", r"\bhard to (?:follow|read|understand)", r"\bconfusing", r"\bpoorly written", r"\bnotation", r"\btypo", r"\bpresentation (?:is|could)", r"\bwriting"]),
    ("related_work", [r"\brelated work", r"\bmissing (?:citation|reference)", r"\bprior work", r"\bfails? to cite", r"\bliterature"]),
    ("significance", [r"\bsignifican", r"\bimpact", r"\bpractical (?:use|value|relevance)", r"\bmotivat", r"\bwhy .{0,30}(?:matter|important)", r"\bnot useful"]),
]
# Patterns, limits and names of reviews, decisions and invitations. Lines end with line feeds alone (d).
BULLET = r"(?md)^\s*(?:[-*•·▪]|\(?\d+[.)]|\(?[a-z][.)])\s+"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
WEAK_HEAD = r"(?imd)^[ \t]*(?:\*{0,2}|#{0,3})[ \t]*(?:cons|weakness(?:es)?|limitations?|drawbacks?|concerns?|criticisms?|negatives?|issues?)\b[ \t]*:?[ \t]*"
STRONG_HEAD = r"(?imd)^[ \t]*(?:\*{0,2}|#{0,3})[ \t]*(?:pros|strengths?|positives?|advantages?|summary|questions?)\b[ \t]*:?[ \t]*"
MIN_POINT_CHARS, MAX_POINTS, MIN_SECTION_CHARS = 25, 12, 40
ACCEPT_PATTERNS = [(r"\boral\b", "accept-oral"), (r"\bspotlight\b", "accept-spotlight"), (r"\bposter\b", "accept-poster"), (r"\bnotable\b", "accept-notable"), (r"\baccept", "accept")]
INVITATION_KINDS = [("Camera_Ready_Revision", "camera_ready"), ("Rebuttal_Revision", "rebuttal"), ("Desk_Rejection", "withdrawal"), ("Withdrawal", "withdrawal"), ("Revision", "revision"), ("Submission", "submission")]

# Placeholders of media in a body, and what they are called.
MEDIA = r"^\((?:(?:그림|표|알고리즘|수식)\s*\d*|박스\s*[0-9a-f]+)\)$"
MEDIA_OPENING = r"^\((?:그림|표|알고리즘|수식|박스)\s*[^)]*\)"
PARAGRAPH_END = r"[.!?:;][\"')\]]*$"
MEDIA_WORDS = [("Figure", "그림"), ("Table", "표"), ("Algorithm", "알고리즘"), ("Box", "박스"), ("Equation", "수식")]
# What kinds of invitations and actors are called.
INVITATION_LABELS = [("Camera_Ready_Revision", "게재 확정본"), ("Rebuttal_Revision", "리뷰 반영 수정"), ("Desk_Rejection", "데스크 리젝"), ("Withdrawal", "철회"), ("Revision", "수정본"), ("Submission", "최초 제출")]
AUTHOR, REVIEWER, NOBODY = "저자", "리뷰어 ", "익명"


def _first(pairs: list[tuple[Column, str]], otherwise: Column) -> Column:
    return reduce(lambda rest, p: F.when(p[0], F.lit(p[1])).otherwise(rest), reversed(pairs), otherwise)


def _blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def clean_text(text: Column) -> Column:
    """Without control characters other than tab and line feed."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", "")


def unwrap(content: Column) -> Column:
    """The value of a JSON field that is raw or stands under "value"; null where it was deleted."""
    inner = F.coalesce(F.get_json_object(content, "$.value.value"), F.get_json_object(content, "$.value"))
    return F.when(F.get_json_object(content, "$.delete") == "true", None).when(content.startswith("{") & F.get_json_object(content, "$.value").isNotNull(), inner).otherwise(content)


def first_field(*fields: Column) -> Column:
    """The first field that isn't blank, trimmed and cleaned, else empty."""
    return clean_text(F.coalesce(*[_blank_to_null(f) for f in fields], F.lit("")))


def parse_score(text: Column) -> Column:
    """The leading number of a score such as `8: Accept`."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def normalize_decision(venue: Column, decision: Column) -> Column:
    """The decision that the venue text tells, else the one of the decision note, else unknown."""
    v, d = F.lower(F.coalesce(venue, F.lit(""))), F.lower(F.coalesce(decision, F.lit("")))
    by_note = [(d.contains("withdraw"), "withdrawn"), (d.contains("reject"), "reject"), *((d.rlike(p), label) for p, label in ACCEPT_PATTERNS)]
    by_venue = [(v.contains("withdraw"), "withdrawn"), (v.contains("desk reject") | v.contains("desk_reject"), "desk-reject"), *((v.rlike(p), label) for p, label in ACCEPT_PATTERNS), (v.startswith("submitted to"), "reject")]
    return _first(by_venue, _first(by_note, F.lit("unknown")))


def normalize_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def dedupe_key(title: Column) -> Column:
    return F.lower(F.trim(title))


def surname(name: Column) -> Column:
    """The last alphabetic token of a name in lower case, null if there is none."""
    tokens = F.regexp_extract_all(name, F.lit(r"([A-Za-z][A-Za-z'\-]+)"), 1)
    return F.when(F.size(tokens) > 0, F.lower(F.element_at(tokens, -1)))


def created_year(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def strip_version(ref: Column) -> Column:
    return F.regexp_replace(ref, r"v\d+$", "")


def arxiv_ref(ref: Column) -> Column:
    return F.concat(F.lit("ARXIV:"), strip_version(ref))


def conference_of(venue: Column) -> Column:
    return F.split(venue, " ")[0]


def _at_words(patterns: list[str]) -> str:
    """Any of patterns that each begin with a word boundary, which is looked at once for all of them."""
    assert all(p.startswith(r"\b") for p in patterns)
    return r"\b(?:" + "|".join(p.removeprefix(r"\b") for p in patterns) + ")"


def classify_aspect(text: Column) -> Column:
    # one scan up to the first keyword of any aspect; only the rest of the text is told apart by aspect
    first = _at_words([p for _, patterns in ASPECT_KEYWORDS for p in patterns])
    rest = F.coalesce(F.regexp_substr(F.lower(text), F.lit(first + r"[\s\S]*")), F.lit(""))
    aspect = lambda t: _first([(t.rlike(_at_words(patterns)), name) for name, patterns in ASPECT_KEYWORDS], F.lit("other"))
    return F.get(F.transform(F.array(rest), aspect), F.lit(0))  # so that the rest is worked out once


def split_points(text: Column) -> Column:
    """The points of a review: its bullets if it has two or more, else its sentences; short ones are dropped, 12 kept."""
    text = F.coalesce(text, F.lit(""))
    bullets = F.size(F.regexp_extract_all(text, F.lit(f"({BULLET})"), 1))
    parts = F.when(bullets >= 2, F.split(text, BULLET)).otherwise(F.split(text, SENTENCE_END))
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.slice(F.filter(parts, lambda p: F.length(p) >= MIN_POINT_CHARS), 1, MAX_POINTS)


def weakness_section(text: Column) -> Column:
    """The bodies under weakness headings, each up to the next heading, joined by line feeds; null if none is long enough."""
    marked = F.regexp_replace(F.regexp_replace(text, WEAK_HEAD, "␞W␟"), STRONG_HEAD, "␞S␟")
    parts = F.filter(F.split(marked, "␞"), lambda p: p.startswith("W␟"))
    bodies = F.transform(parts, lambda p: F.regexp_replace(F.substring(p, 3, 1 << 30), r"^\s+|\s+$", ""))
    bodies = F.filter(bodies, lambda b: F.length(b) >= MIN_SECTION_CHARS)
    return F.when(F.size(bodies) > 0, F.array_join(bodies, "\n"))


def review_points(weaknesses: Column, questions: Column, unsplit: Column) -> Column:
    """Array of (aspect, sentiment, text): points of the weaknesses, then of the questions, 12 at most."""
    section = weakness_section(weaknesses)
    body = F.when(unsplit & section.isNotNull(), section).otherwise(weaknesses)
    sentiment = F.when(unsplit & section.isNull(), F.lit("unknown")).otherwise(F.lit("weakness"))
    point = lambda s: lambda t: F.struct(classify_aspect(t).alias("aspect"), s.alias("sentiment"), t.alias("text"))
    return F.slice(F.concat(F.transform(split_points(body), point(sentiment)), F.transform(split_points(questions), point(F.lit("question")))), 1, MAX_POINTS)


def invitation_kind(suffix: Column) -> Column:
    return _first([(suffix.contains(needle), kind) for needle, kind in INVITATION_KINDS], F.translate(suffix, "_", " "))


def invitation_label(suffix: Column) -> Column:
    """What the kind of an invitation is called."""
    return _first([(suffix.contains(needle), label) for needle, label in INVITATION_LABELS], F.translate(suffix, "_", " "))


def path_tails(paths: Column) -> Column:
    return F.transform(paths, lambda p: F.element_at(F.split(p, "/"), -1))


def actor_role(signature: Column) -> Column:
    tail = F.element_at(F.split(signature, "/"), -1)
    return _first([(tail == "Authors", "author"), (tail.startswith("Reviewer_"), "reviewer"), (tail.startswith("Area_Chair"), "ac"), (tail.startswith("Program_Chair"), "pc")], F.lit("other"))


def actor_name(signature: Column) -> Column:
    """The name under which a signature is shown."""
    tail = F.element_at(F.split(F.coalesce(signature, F.lit("")), "/"), -1)
    named = F.when(tail.startswith("Reviewer_"), F.concat(F.lit(REVIEWER), F.substring(tail, 10, 1 << 20)))
    other = F.coalesce(F.nullif(F.translate(tail, "_", " "), F.lit("")), F.lit(NOBODY))
    return F.when(tail == "Authors", AUTHOR).otherwise(F.coalesce(named, F.when(tail.startswith("Area_Chair"), "AC").when(tail.startswith("Program_Chair"), "PC").otherwise(other)))


def clip(text: Column, n: int = 3000) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit(" …"))).otherwise(text)


def has_final_consonant(word: Column) -> Column:
    """Whether the last letter is a Hangul syllable with a final consonant, which decides the particle after it."""
    point = F.ascii(F.substring(word, -1, 1))
    return point.between(0xAC00, 0xD7A3) & ((point - 0xAC00) % 28 > 0)


def with_particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """The word with the particle that fits its last sound."""
    return F.concat(word, F.when(has_final_consonant(word), after_consonant).otherwise(after_vowel))


def label_placeholder(label: Column) -> Column:
    """The placeholder of a medium's label, `(그림 2)` for `Figure 2`; null for other labels."""
    number = F.regexp_replace(label, r"^\S*\s?", "")
    word = _first([(F.split(label, " ")[0] == name, word) for name, word in MEDIA_WORDS], F.lit(None).cast("string"))
    return F.when(number != "", F.concat(F.lit("("), word, F.lit(" "), number, F.lit(")")))


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def stitched(texts: Column) -> Column:
    """Paragraphs, of which one that ends within a sentence takes the next one if that begins in lower case; media stay apart."""
    halves = F.aggregate(
        texts, F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")),
        lambda s, p: F.when(
            s["open"].isNotNull() & p.rlike("^[a-z]") & ~p.rlike(MEDIA_OPENING),
            F.struct(F.concat(s["done"], F.array(F.concat(s["open"], F.lit(" "), p))).alias("done"), F.lit(None).cast("string").alias("open")),
        ).otherwise(F.struct(
            F.concat(s["done"], F.when(s["open"].isNotNull(), F.array(s["open"])).otherwise(F.array().cast("array<string>")), F.when(_closes(p), F.array(p)).otherwise(F.array().cast("array<string>"))).alias("done"),
            F.when(~_closes(p), p).alias("open"),
        )),
    )
    return F.concat(halves["done"], F.when(halves["open"].isNotNull(), F.array(halves["open"])).otherwise(F.array().cast("array<string>")))


def _closes(paragraph: Column) -> Column:
    return (paragraph == "") | paragraph.rlike(MEDIA_OPENING) | paragraph.rlike(PARAGRAPH_END)


def forum_url(base: str, forum: Column, note: Column) -> Column:
    return F.concat(F.lit(base), F.coalesce(forum, note))


def file_verb(old: Column, new: Column) -> Column:
    return F.when(old.isNull() & new.isNotNull(), F.lit("added")).when(old.isNotNull() & new.isNull(), F.lit("deleted")).otherwise(F.lit("replaced"))


def abstract_of(text: Column) -> Column:
    """The text between "abstract" and "introduction", else the first 2500 characters, with single blanks."""
    body = F.regexp_extract(text, r"(?is)\babstract\b[:.\s]*(.*?)\bintroduction\b", 1)
    return F.trim(F.regexp_replace(F.when(body != "", body).otherwise(F.substring(text, 1, 2500)), r"\s+", " "))


def looks_garbled(text: Column) -> Column:
    """At least 20 tokens of which over 18 % are single letters."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    single = F.size(F.filter(tokens, lambda t: t.rlike("^[A-Za-z]$")))
    return (F.size(tokens) >= 20) & (single > 0.18 * F.size(tokens))


def without_clip_leak(text: Column, reference: Column, run: int = 5) -> Column:
    """text without the letters that a crop cut off: `run` or more words of one to three letters at its end, unless they stand in
    the reference, whose white space counts as single blanks."""
    tail = r"(?:^|\s)([A-Za-z]{1,3}(?:\s+[A-Za-z]{1,3})*)\s*$"
    found = F.regexp_replace(F.regexp_extract(text, tail, 1), r"\s+", " ")
    stands = F.contains(F.trim(F.regexp_replace(reference, r"\s+", " ")), found)
    leaked = (F.size(F.split(found, " ")) >= run) & ~F.coalesce(stands, F.lit(False))
    return F.when(leaked, F.regexp_replace(F.regexp_replace(text, tail, ""), r"\s+$", "")).otherwise(text)


def flatten_block(text: Column) -> Column:
    """A block's lines as one: a hyphen at a line's end goes with the break, other breaks are blanks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"-\n\s*", ""), r"\s*\n\s*", " "), r"^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 10)


def data_uri(data: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(data))


def log_shape(text: Column) -> Column:
    """Length and checksum in place of the content."""
    return F.concat_ws(":", F.length(text).cast("string"), F.substring(F.sha2(text, 256), 1, 8))


def loads(text: Column, schema: str) -> Column:
    """A JSON answer that may stand in a code fence; null fields where it doesn't parse."""
    return F.from_json(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), schema)


def citation_labels(text: Column, known: Column) -> Column:
    """Known labels inside [E1, M2] blocks, in the order of first use."""
    blocks = F.array_join(F.regexp_extract_all(text, F.lit(r"\[((?:[EM]\d+)(?:\s*,\s*[EM]\d+)*)\]"), 1), ",")
    labels = F.array_distinct(F.transform(F.split(blocks, ","), lambda x: F.trim(x)))
    return F.array_intersect(labels, known)


def number_in(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"(\d+)$", 1), F.lit("")).cast("int")


def kst_minute(millis: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(millis), "+09:00"), "yyyy-MM-dd HH:mm")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each lower-case alphanumeric word, padded by two blanks before and one behind."""
    words = F.filter(F.split(normalize_title(text), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def plain_tsquery_all(doc: Column, query: Column) -> Column:
    """Whether every token of the query is in the document's."""
    return F.forall(query, lambda t: F.array_contains(doc, t))
