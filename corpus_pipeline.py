"""The training-data pipeline: five stages over `documents`, each one operator of tessera.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, langid, secrets, simhash
from tessera.llm.common import shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a letter stay; `und` goes (null, empty and letterless texts). Repeated rows and extra columns stay."""
    return langid.accept(docs, docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least doc_id (a null one last), of its rows one.

    Null and empty texts are one group. Rows that share a doc_id but not a text are told apart. Extra columns stay.
    """
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages stay, null and empty texts among them, repeated rows each, with all columns."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts give way to a mark. Null and empty texts stay as they are."""
    return secrets.redact(docs, secrets.fit(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs' columns but text, with ids_le (the token ids) and the digests of them and of what they decode to.

    A null or empty text has no ids; repeated rows are encoded alike. Columns named as the new ones give way to them.
    """
    ranks, pattern = bpe.public_ranks()
    # fewer common words than op4 shares: the same ids for more time and less memory, beside what earlier stages' workers hold
    encoded = bpe.encode(docs, ranks, pattern, most=1 << 17, packed=True)
    return bpe.digests(encoded, *(c for c in encoded.columns if c not in ("decoded", *bpe.DIGESTS)))


#: (name, function of (spark, docs, sf_dir)); each result is written and read again as the next one's docs.
STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: Greedy tiling, trained classifiers and BPE have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result but the last goes to the shared checkpoint folder as Parquet.

    A result is emptied once the next one is written, so that at most two copies of the corpus lie there; the last one stays, as
    the returned rows are read from it.
    """
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            spark.createDataFrame([], docs.schema).coalesce(1).write.mode("overwrite").parquet(before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
