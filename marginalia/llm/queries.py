"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.storage import fresh_path
    from marginalia.llm.warc import read_archives, write_archives

    archives = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    found = identify(docs, train(docs.filter("NOT held_out")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.vector_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from marginalia.llm.packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from marginalia.llm.storage import fresh_path
    from marginalia.llm.token_store import digests, read_tokens, write_tokens

    store = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), store, path("word_bpe_49k.json"))
    return digests(read_tokens(spark, store))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.secret_scan import digest, scan_secrets

    return digest(scan_secrets(table(spark, sf_dir, "documents")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import langid, toxicity

    docs = table(spark, sf_dir, "documents")
    learned = docs.filter(~toxicity.held_out())
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out()).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.score_texts(docs, toxicity.train(learned, labels, langid.train(learned)))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "lang_told")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.fill_middle import digest, fill_in_middle

    return digest(fill_in_middle(table(spark, sf_dir, "documents")))


_ALL = (
    op1_benchmark_decontamination, op2_hyperdimensional_langid, op3_embedding_near_dedup, op4_best_fit_packing, op5_url_templates, op6_warc_archives, op7_license_scan,
    op8_minhash_near_dedup, op9_token_store, op10_secret_scan, op11_ranked_search, op12_toxicity, op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _ALL}

_BITS = "".join(f"{' + ' if n else ''}{16 >> n} * substr(bits, 5 * i + {n + 1}, 1)::INT" for n in range(5))


def _license_oracle() -> str:
    """The definition over all units, with the templates and the cuts as data; no filter but the bound on sizes."""
    from marginalia.llm.license_scan import ENDS, PARAGRAPH, SENTENCE, TEMPLATES, bigrams, long_bigrams, window_words

    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    listed = lambda texts: f"[{', '.join(map(quoted, texts))}]"
    known = ", ".join(f"({quoted(name)}, {listed(sorted(bigrams(text)))})" for name, text in TEMPLATES)
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    most = window_words(TEMPLATES, 0.8)
    return f"""WITH t(license, own) AS (VALUES {known}),
      low AS (SELECT DISTINCT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL),
      all_units AS (SELECT doc_id, unnest(list_concat(string_split(low, chr(10)), regexp_split_to_array(low, '{SENTENCE}'), regexp_split_to_array(low, '{PARAGRAPH}'), [low])) AS unit FROM low),
      cut AS (SELECT doc_id, low, regexp_split_to_array(low, '{PARAGRAPH}') AS ps FROM low),
      told AS (SELECT doc_id, low, unnest(range(len(ps))) AS pos, regexp_extract_all(unnest(ps), '[a-z0-9]+') AS w FROM cut),
      ends AS (SELECT *, len(w) AS n, len(list_intersect({grams("w")}, {listed(long_bigrams(TEMPLATES))})) >= {ENDS} AS ends FROM told WHERE len(w) > 0),
      placed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, low ORDER BY pos) AS upto FROM ends),
      windows AS (SELECT a.doc_id, a.low, a.pos AS lo, b.pos AS hi, flatten(list(c.w ORDER BY c.pos)) AS w FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.low = b.low AND a.pos < b.pos AND b.upto - a.upto + a.n <= {most}
        JOIN placed c ON c.doc_id = a.doc_id AND c.low = a.low AND c.pos BETWEEN a.pos AND b.pos WHERE a.ends AND b.ends GROUP BY ALL),
      words AS (SELECT DISTINCT doc_id, NULL AS low, NULL AS lo, NULL AS hi, regexp_extract_all(unit, '[a-z0-9]+') AS w FROM all_units UNION ALL SELECT * FROM windows),
      grams AS (SELECT *, {grams("w")} AS p FROM words WHERE len(w) > 1),
      scored AS (SELECT * EXCLUDE (p, own), len(list_intersect(p, own)) AS shared, 2.0::DOUBLE * len(list_intersect(p, own)) / (len(p) + len(own)) AS dice FROM grams JOIN t ON len(p) BETWEEN len(own) * 0.66 AND len(own) * 1.51),
      best AS (SELECT * FROM scored WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, low, lo, hi, w ORDER BY dice DESC, license, shared) = 1),
      kept AS (SELECT * FROM best b WHERE lo IS NULL OR NOT EXISTS (SELECT 1 FROM best o WHERE o.doc_id = b.doc_id AND o.low = b.low AND o.lo <= b.lo AND o.hi >= b.hi AND (o.lo < b.lo OR o.hi > b.hi) AND o.license <> b.license AND o.shared > b.shared))
      SELECT doc_id, license, max(dice) AS dice, count(DISTINCT w) AS units FROM kept GROUP BY doc_id, license"""


#: SQL for the queries that it can express over whole tables; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_embedding_near_dedup": """WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
      ok AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM u WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
      links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
      reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
      component AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
      counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
      SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN component c ON c.id = e.vec_id LEFT JOIN counts k ON k.a = e.vec_id""",
    "op6_warc_archives": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
      h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
      SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM h""",
    "op7_license_scan": _license_oracle(),
    "op11_ranked_search": r"""WITH lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
      cut AS (SELECT r, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM lowered WHERE low IS NOT NULL),
      sized AS (SELECT r, doc_id, t, len(t)::BIGINT AS n FROM cut WHERE len(t) > 0), s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS l FROM sized),
      items AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL),
      asked AS (SELECT q, item_id, unnest(t) AS term FROM items), terms AS (SELECT DISTINCT term FROM asked),
      tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM sized) SEMI JOIN terms USING (term) GROUP BY ALL),
      w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN s GROUP BY term, n_docs),
      scored AS (SELECT q, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // l))))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN w USING (term) CROSS JOIN s GROUP BY ALL)
      SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "op13_fill_in_middle": r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
      d AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM h),
      c AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
      p AS (SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS pre, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(u[hi + 1:], ''), '') AS suf FROM c)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
