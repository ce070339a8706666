"""The corpus pipeline: language identification, exact and near deduplication, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. ``run`` writes each stage's rows to the shared folder and reads them again for the next.

Defined results: null and letterless texts go in the first stage; of rows that repeat one stays; rows that share an identifier
but not the text are kept or dropped together after the second stage; rows with a null identifier are one document there;
an empty table gives an empty table in every stage; ties go to the least identifier.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, language_id, mixing, near_dedup, packing
from driftline.llm.common import Scratch, documents
from driftline.llm.queries import TARGETS, VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _among(docs: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``docs`` whose keys are in ``kept``; null equals null."""
    kept = kept.select(*[F.col(k).alias(f"_kept_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_kept_{k}")) for k in keys]
    return docs.join(kept, same, "left_semi")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; rejected ones go."""
    return language_id.classifier(docs).transform(docs).where("not rejected").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id."""
    kept = exact_dedup.deduplicate(docs).where("kept")
    named = docs.withColumn("text_sha256", F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256))
    return _among(named, kept, "doc_id", "text_sha256").dropDuplicates(["doc_id", "text_sha256"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, the smallest doc_id."""
    return _among(docs, near_dedup.near_duplicates(docs, similarity=0.8).where("kept"), "doc_id")


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins toxic and low documents to their shares in TARGETS at most; rates are at most 1, so no document is repeated.

    High documents decide the total and stay, whatever there is of the others. Without a labelled high row nothing can be judged and all stay.
    """
    labelled = mixing.label_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if labelled.where("domain = 'high'").isEmpty():
        return docs
    kept = mixing.mix(docs, labelled, TARGETS, max_rate=1.0, upper=("low", "toxic"))[0].where("copies > 0")
    return _among(docs, kept, "doc_id")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), capacity=2048, end_id=0)


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Compression, trained posteriors, tokenizers and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(f"{k}-{name}", stage(spark, docs, sf_dir))
    return docs
