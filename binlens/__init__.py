"""binlens — Spark-native analytics for labelled executable-feature corpora.

Subpackages
-----------
sources    readers/writers (JSONL, CSV, binary files, model tables) and the
           fixture views that bind the operators to the driver tables
functions  Column builders (pure expressions: nested access, coercion,
           byte/string statistics, hashing, regex patterns)
operators  DataFrame -> DataFrame operators (flat features, byte features,
           vectorisers, dataset assembly, evaluation, statistics, catalogue
           selection, boosted trees)
plans      end-to-end pipelines (train, fine-tune, evaluate, explore) and
           the query registry used by ``__spark_entry__``
streaming  incremental shard ingestion with Structured Streaming
"""

__all__ = ["session"]
