"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.llm import exact_dedup, hard_negatives, language_model, lexical_search, licenses, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, toxicity
from platter.llm.common import remainder, table


def model_path() -> str:
    """Place of the public tokenizer model on this machine; the same package is on every worker."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 1
    return language_model.score_texts(docs, ~held_out).withColumn("held_out", held_out)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digests=True)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), model_path(), ids=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = line_dedup.parsed_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    out = line_dedup.drop_boilerplate(pages, F.col("host"), F.col("lines"))
    return out.select(
        "page_id",
        "host",
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
        F.array_join("kept_lines", "\n").alias("text"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.passes(F.col("failure_bits"), "base")).alias("base_failed"),
        quality_rules.passes(F.col("failure_bits"), "v1").alias("kept"),
        "failure_bits",
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return scores.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return scores.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE]
    digest = F.sha2(secret_scan.span_list(of(*secret_scan.BASE)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secret_scan.span_list(F.col("secrets")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_language_model,
            op2_near_dedup,
            op3_exact_dedup,
            op4_sentencepiece,
            op5_line_dedup,
            op6_quality_rules,
            op7_quality_classifier,
            op8_toxicity,
            op9_licenses,
            op10_mixing,
            op11_lexical_search,
            op12_secrets,
            op13_hard_negatives,
        )
    }


OP3_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), starts AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8
), again AS (
  SELECT doc_id, list(i) AS places FROM (SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM starts) GROUP BY doc_id, win HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place + k) AS n FROM (SELECT doc_id, unnest(places) AS place FROM again), (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_capitals,
         length(t) - length(regexp_replace(t, '!+', '', 'g')) AS n_marks,
         len(list_distinct(ws)) AS n_distinct
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_capitals > 50 * word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_marks > 50 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN n_dup_lines > 3 AND 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > 30 * n_words THEN 64 ELSE 0 END)
    + (CASE WHEN n_words >= 20 AND 100 * n_distinct < least(10 * n_words, 20000) THEN 128 ELSE 0 END) AS bits
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS failure_bits
FROM b
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), s AS (SELECT rid, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0
), c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM s
), m AS (SELECT rid, doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM s, c
), p AS (SELECT rid, w, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY rid, w
), f AS (SELECT w, CAST(floor(1000 * ln((2.0 * docs + 2.0) / (2.0 * df + 1.0))) AS BIGINT) AS weight FROM (SELECT w, count(*) AS df FROM p GROUP BY w), c
), q AS (
  SELECT mark, item_id, w, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT row_number() OVER () AS mark, item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
    FROM benchmark) GROUP BY mark, item_id, w
), t AS (
  SELECT mark, item_id, doc_id, rid, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (w) JOIN p USING (w) JOIN m USING (rid) GROUP BY mark, item_id, doc_id, rid
), r AS (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY score DESC, doc_id NULLS LAST) AS place FROM t WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 20
"""

OP13_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS place
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5
"""


def _op5_sql() -> str:
    text = f"regexp_replace(coalesce(html, ''), '{line_dedup._HIDDEN}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{line_dedup._BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, char in line_dedup._ENTITIES:
        char = char.replace("'", "''")
        text = f"replace({text}, '{entity}', '{char}')"
    blank = line_dedup._BLANK
    return f"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(coalesce(url, ''), '{line_dedup._HOST}', 1)), '') AS host,
         list_filter(list_transform(string_split({text}, chr(10)), lambda x: regexp_replace(x, '{blank}', '', 'g')), lambda x: x <> '') AS lines
  FROM pages
), sites AS (SELECT host, count(*) AS total FROM p WHERE host IS NOT NULL GROUP BY host
), counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host IS NOT NULL) GROUP BY host, line
), bad AS (
  SELECT c.host, list(c.line) AS gone FROM counts c JOIN sites s ON c.host = s.host
  WHERE s.total >= {line_dedup.MIN_PAGES} AND c.n >= {line_dedup.MIN_REPEATS} AND c.n >= CAST({line_dedup.RATIO} AS DOUBLE) * s.total GROUP BY c.host
), k AS (
  SELECT p.page_id, p.host, p.lines, list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.gone, x), false)) AS kept
  FROM p LEFT JOIN bad b ON p.host = b.host
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text
FROM k
"""


def llm_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_line_dedup": _op5_sql(), "op6_quality_rules": OP6_SQL, "op11_lexical_search": OP11_SQL, "op13_hard_negatives": OP13_SQL}
