"""A training-data pipeline over documents: five stages, each written as Parquet and read again by the next.

Language ID drops documents without a letter (null and empty texts among them) and those that no learned language
explains, MinHash keeps one document of each group of near-duplicates, decontamination drops documents with benchmark
passages, PII replaces personal data and terms that disclose it, and byte-level BPE turns the texts that are left into
ids. Each stage keeps all columns of its input but the last, which returns doc_id, source, lang, the number of ids, their
digest and that of the decoded bytes. Of rows with one doc_id one stays, rows without a doc_id all stay; a null language
or source stays null; an empty table gives an empty one. No stage has an SQL form as a whole, so ORACLE_SQL is None and
a test runs the stages against brute-force ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cartolith.llm import bpe, decontam, langid, minhash, pii
from cartolith.llm.common import drop_written, new_folder, small_batches, table


#: Bytes of a batch for Python, at most: all stages run in one session, and a batch stands several times in the memory of
#: an executor and of its workers, beside what earlier stages have left there.
BATCH_BYTES = 4 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_BYTES)
    return langid.keep_identified(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), docs.select("text", "lang"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_BYTES)
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_BYTES)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_BYTES)
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_BYTES)
    return bpe.digests(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", sanitise),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of documents. A stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop_written(before)
        docs = before = spark.read.parquet(path)
    return docs
