"""The corpus pipeline: five operators of ``binlens.llm`` one after the other over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before kept, and
returns a DataFrame that is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binlens.llm.decontaminate import find_leaks, without_leaks
from binlens.llm.mixing import mix, take_copies
from binlens.llm.quality import quality_score, train_quality
from binlens.llm.simhash import keep_one_of_each, simhash_components
from binlens.llm.text import hash_bits
from binlens.llm.token_files import read_token_files, write_token_files
from binlens.session import bound_batches, ensure_checkpoint_dir, materialise, shared_path, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores 0.7 or more; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(hash_bits(F.col("doc_id"), 4) != 2)
    model = train_quality(docs, labels, max_rows=20_000)
    return docs.where(quality_score(model, F.col("text")) >= 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints of 3-word shingles within 3 bits: that of the smallest doc_id."""
    return keep_one_of_each(docs, simhash_components(docs, words=3, max_bits=3))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found, whether word for word or with other numbers or names."""
    return without_leaks(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    return take_copies(docs, mix(docs, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of every row by ascending doc_id, and per row what they hold."""
    path = shared_path(spark, "token-files")
    # workers of the other stages share their memory with this one's
    write_token_files(docs, path, vocabulary="byte_bpe_50k.json", end_id=2, remember=250_000)
    return read_token_files(spark.read.parquet(f"{path}/ids"))


def _stage(fn):
    """A stage that can run on its own, in any session."""
    @functools.wraps(fn)
    def ready(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        bound_batches(spark)
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    return ready


STAGES = [("quality classifier", _stage(quality)), ("simhash near-dedup", _stage(near_dedup)), ("benchmark decontamination", _stage(decontaminate)),
          ("mixing to target weights", _stage(mix_sources)), ("token files", _stage(tokenise))]

#: The classifier, the rounding and the tokenizer have no SQL form; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
