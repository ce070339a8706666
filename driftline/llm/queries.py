"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from driftline.llm import alignment, bpe, exact_dedup, language_id, mixing, near_dedup, packing, quality_model, quality_rules, records, sharding, substring_dedup, whitening
from driftline.llm.common import documents

#: Share of the expected tokens that each labelled domain is to have.
TARGETS = {"high": 0.9, "low": 0.05, "toxic": 0.05}
VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring the expected tokens of labelled domains to TARGETS, for every document."""
    docs = documents(spark, sf_dir)
    out, domains = mixing.mix(docs, mixing.label_domains(docs, table(spark, sf_dir, "labels")), TARGETS)
    return out.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of all documents."""
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that an anchor document has too."""
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    out = sharding.shard(documents(spark, sf_dir), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as binary records and read back."""
    out = records.round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), end_id=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels that aren't held out."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where(~quality_model.held_out())
    out = quality_model.fit(docs, labels).transform(docs.select("doc_id", "text"))
    return out.select("doc_id", quality_model.held_out().alias("held_out"), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold rules over every document."""
    out = quality_rules.apply(documents(spark, sf_dir).select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents; the largest doc_id stays."""
    return exact_dedup.deduplicate(documents(spark, sf_dir), keep="largest")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), capacity=2048, end_id=0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from rows that aren't held out."""
    docs = documents(spark, sf_dir)
    out = language_id.classifier(docs).transform(docs.select("doc_id", "text"))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in their 32 leading principal components, each of unit variance."""
    return whitening.fit(table(spark, sf_dir, "embeddings"), components=32).transform()


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by prefix dynamic programming, and their text again."""
    out = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in every document."""
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))[0]


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_near_dedup, op3_substring_dedup, op4_sharding, op5_token_records, op6_quality_model, op7_quality_rules, op8_exact_dedup, op9_packing, op10_language_id,
        op11_whitening, op12_bpe, op13_alignment,
    )
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))

ORACLES = {
    "op8_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM n""",
    "op7_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, {_LINES} AS l FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
        h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
        r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
        m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS word_chars,
                     length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                     len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
                     len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
                     len(list_filter(l, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…'))) AS n_ellipsis_lines,
                     len(list_filter(l, lambda x: left(ltrim(x, ' '), 1) IN ('-', '*', '•'))) AS n_bullet_lines
              FROM d LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT base_failed AND n_words BETWEEN 50 AND 1000000 AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
               AND n_symbols <= 0.5 * n_words AND n_stop_words >= 2 AND n_dup_lines <= 0.5 * n_lines
               AND n_ellipsis_lines <= 0.5 * n_lines AND n_bullet_lines <= 0.9 * n_lines AND n_repeat_words <= 0.5 * n_words AS kept
        FROM b""",
}
