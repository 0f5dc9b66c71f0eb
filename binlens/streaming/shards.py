"""Flatten raw JSONL shards as they land, with Structured Streaming.

The reference walks shard files one at a time to bound memory. Here a file
stream source picks up new shards (``maxFilesPerTrigger`` bounds each
micro-batch), each batch is pruned, label-filtered, normalised and flattened
by the same operators as the batch path, and appended to a Parquet table.
The checkpoint location records which shards were processed, so a restarted
job (or a lost executor) neither skips nor repeats a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import flat as fl
from ..operators import project as pj
from ..operators.record_layout import MIXED_SCHEMA, normalize_layout
from ..sources.io import parse_json_lines
from ..sources.schemas import RAW_SCHEMA, normalise_raw


def _lines(spark: SparkSession, shard_dir: str, files_per_batch: int) -> DataFrame:
    return (spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(shard_dir)
            .select("value", F.col("_metadata.file_path").alias("_file")))


def stream_flat_features(spark: SparkSession, shard_dir: str, files_per_batch: int = 8, malformed: str = "fail", layout: str | None = None) -> DataFrame:
    """Streaming DataFrame of flat features from JSONL shards under ``shard_dir``.

    ``malformed``: ``fail`` stops the query at a line that is no record, as the batch reader does; ``divert`` leaves such
    lines to ``stream_rejects``. ``layout``: None reads layout A; ``auto`` or ``B`` read records of either or that layout.
    """
    if malformed not in ("fail", "divert"):
        raise ValueError(f"malformed must be fail or divert: {malformed}")
    schema = RAW_SCHEMA if layout is None else MIXED_SCHEMA
    if malformed == "fail":
        raw = (spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch)
               .json(shard_dir))
    else:
        raw = parse_json_lines(_lines(spark, shard_dir, files_per_batch), schema)
        raw = raw.where(F.col("_corrupt_record").isNull())
    raw = pj.filter_labelled(pj.prune_columns(raw, ["sha256"] + fl.RAW_COLS_NEEDED))
    raw = normalise_raw(raw) if layout is None else normalize_layout(raw, layout)
    return fl.flatten_record(raw, keep=["sha256"])


def stream_rejects(spark: SparkSession, shard_dir: str, files_per_batch: int = 8, layout: str | None = None) -> DataFrame:
    """Streaming table ``file, line`` of the lines that are no records."""
    rows = parse_json_lines(_lines(spark, shard_dir, files_per_batch), RAW_SCHEMA if layout is None else MIXED_SCHEMA)
    return rows.where(F.col("_corrupt_record").isNotNull()).select(F.col("_file").alias("file"), F.col("_corrupt_record").alias("line"))


def _append(df: DataFrame, out_dir: str, checkpoint: str, once: bool) -> StreamingQuery:
    q = df.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append")
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="30 seconds")).start()


def ingest_shards(spark: SparkSession, shard_dir: str, out_dir: str, checkpoint: str,
                  files_per_batch: int = 8, once: bool = True, malformed: str = "fail", layout: str | None = None) -> StreamingQuery:
    """Append flat features of new shards to Parquet at ``out_dir``.

    ``once=True`` processes everything available and stops (``availableNow``);
    otherwise the query keeps running and picks up shards as they arrive.
    """
    return _append(stream_flat_features(spark, shard_dir, files_per_batch, malformed, layout), out_dir, checkpoint, once)


def ingest_rejects(spark: SparkSession, shard_dir: str, out_dir: str, checkpoint: str,
                   files_per_batch: int = 8, once: bool = True, layout: str | None = None) -> StreamingQuery:
    """Append the malformed lines of new shards to Parquet at ``out_dir``, beside ``ingest_shards(malformed="divert")``."""
    return _append(stream_rejects(spark, shard_dir, files_per_batch, layout), out_dir, checkpoint, once)
