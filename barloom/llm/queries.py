"""The corpus operators as registered queries over the tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, linededup, packing, pseudo, quality, rules, simhash, simple8b, surrogates
from .common import read_table, scratch_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def op2_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "simple8b")
    simple8b.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return simple8b.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.pseudo_likelihood(read_table(spark, sf_dir, "documents"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(read_table(spark, sf_dir, "documents"))
    base = rules.failed(F.col("fail_bits"), rules.POLICIES[1])
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~rules.failed(F.col("fail_bits"), rules.POLICIES[2])).alias("kept"), "n_lines", "n_upper", "fail_bits",
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '\P{Lu}', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN covered USING (r)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, n_lines, n_upper, fail_bits
FROM f
"""


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its surrogates, and how many surrogates of the corpus stand for several entities."""
    secret = spark.conf.get("spark.barloom.surrogate.key", "a key of your own")
    found = surrogates.pseudonymize(read_table(spark, sf_dir, "documents"), secret)
    n = surrogates.collisions(found.select("entities")).count()
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.to_json("entities").alias("entities"), F.lit(n).alias("n_collisions"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents")).report()


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i - 1 AS line, ls[i] AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
  WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]') AND doc_id IS NOT NULL
), c AS (
  SELECT s, min(doc_id) AS doc, arg_min(line, (doc_id, line)) AS line FROM l GROUP BY s
), k AS (
  SELECT *, m, left(s, m // 2) AS part, 0 AS side FROM c, LATERAL (SELECT unnest([length(s), length(s) - 1]) AS m) WHERE m >= 20
  UNION ALL
  SELECT *, m, right(s, m - m // 2) AS part, 1 AS side FROM c, LATERAL (SELECT unnest([length(s), length(s) - 1]) AS m) WHERE m >= 20
), q AS (
  SELECT DISTINCT a.s AS sa, b.s AS sb, a.doc AS da, b.doc AS db, a.line AS la, b.line AS lb, length(a.s) AS n, length(b.s) AS nb
  FROM k AS a JOIN k AS b USING (m, part, side) WHERE a.s <> b.s AND length(b.s) - length(a.s) IN (0, 1) AND (length(b.s) > length(a.s) OR a.s < b.s)
), p AS (
  SELECT * FROM q WHERE CASE WHEN n = nb THEN len(list_filter(range(1, n + 1), lambda i: sa[i:i] <> sb[i:i])) = 1
    ELSE len(list_filter(range(0, n + 1), lambda i: left(sa, i) = left(sb, i) AND sa[i + 1:] = sb[i + 2:])) > 0 END
), n AS (
  SELECT CASE WHEN (da, la) < (db, lb) THEN sb ELSE sa END AS s, count(*) AS n FROM p GROUP BY ALL
), g AS (
  SELECT l.doc_id, count(*) AS n_dropped, sum(CASE WHEN first THEN coalesce(n.n, 0) ELSE 0 END) AS n_links
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY line) = 1 AS first FROM l) AS l
  JOIN c USING (s) LEFT JOIN n USING (s)
  WHERE l.doc_id <> c.doc OR l.line <> c.line OR n.n IS NOT NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN g USING (doc_id)
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file of its language's folder in its source's folder."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    docs = read_table(spark, sf_dir, "documents")
    return licenses.scan(docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text"), keep=("doc_id",))


OP9_SQL = licenses.oracle("SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || coalesce(doc_id::VARCHAR, '-') AS path, text FROM documents")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_attention, op2_simple8b_tokens, op3_template_decontamination, op4_pseudo_likelihood, op5_rule_ledger, op6_surrogates, op7_packing, op8_line_dedup, op9_license_scan, op10_simhash)
}
ORACLES: dict[str, str] = {"op5_rule_ledger": OP5_SQL, "op8_line_dedup": OP8_SQL, "op9_license_scan": OP9_SQL}
