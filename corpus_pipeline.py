"""The corpus pipeline: each stage works on all that the one before kept, and is written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import decontam, langid, lines, packing, simhash
from gridspan.llm.common import bounded_batches, read, shared_folder
from gridspan.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; texts without letters go."""
    bounded_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with the lines that are left; ``n_chars`` follows the text."""
    done = lines.dedup_lines(docs)
    old = lambda name: F.col("row").getField(name)  # noqa: E731  names may have dots
    new = {"text": F.when(F.col("n_dropped") == 0, old("text")).otherwise(F.col("kept")), "n_chars": F.when(F.col("n_dropped") == 0, old("n_chars")).otherwise(F.char_length("kept"))}
    return done.select(*[(new[f.name] if f.name in new else old(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (word 5-grams, Jaccard similarity of 0.8) stays."""
    bounded_batches(spark)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go."""
    bounded_batches(spark)
    return decontam.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can express neither a trained classifier nor a tokenizer; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. The stages' tables are written below the shared folder that the session names."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
