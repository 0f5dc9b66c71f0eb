"""End-to-end workflows: the reference's scripts as Spark plans.

* ``train_model``     JSONL shards -> flat features -> dropout -> stratified split ->
                      weights -> monotone boosting -> validation AUC, threshold sweep and
                      low-FPR threshold -> feature importance -> saved model
* ``merge_labelled``  benign + malicious CSV -> labelled union -> seeded shuffle -> CSV
* ``fine_tune_model`` labelled CSV -> coercion -> dropout -> vault/val/train split ->
                      vault CSV -> boosting continued from a stored model -> sweep/threshold
* ``evaluate_model``  vault CSV -> label checks -> score -> confusion, rates, false
                      positives (CSV) and threshold sweep
* ``explore``         correlation tables, coverage and class distributions

Each step is a DataFrame operator; the only driver-side values are small
(threshold tables, split decisions of the trees, report rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boost as bo
from ..operators import dataset as ds
from ..operators import evaluate as ev
from ..operators import flat as fl
from ..operators import project as pj
from ..operators import stats as st
from ..session import materialise
from ..sources import io
from ..sources.schemas import RAW_SCHEMA, normalise_raw


@dataclass
class TrainResult:
    model: bo.BoostModel
    auc: float | None
    sweep: list[dict]
    threshold: dict | None
    importance: list[dict]
    class_counts: dict = field(default_factory=dict)


def record_key(df: DataFrame) -> DataFrame:
    """Stable per-file key: the content hash when present, else a hash of the whole record."""
    if "sha256" in df.columns:
        return df.withColumn("file_key", F.coalesce(F.col("sha256"), F.sha2(F.to_json(F.struct("*")), 256)))
    return df.withColumn("file_key", F.sha2(F.to_json(F.struct("*")), 256))


def flat_features(spark: SparkSession, jsonl_glob: str) -> DataFrame:
    """JSONL shards -> labelled flat features (+ file_key)."""
    raw = io.scan_jsonl(spark, jsonl_glob, RAW_SCHEMA)
    raw = pj.prune_columns(raw, ["sha256"] + fl.RAW_COLS_NEEDED)
    raw = record_key(normalise_raw(pj.filter_labelled(raw)))
    return fl.flatten_record(raw, keep=["file_key"])


def train_model(spark: SparkSession, jsonl_glob: str, model_path: str | None = None,
                params: bo.BoostParams | None = None, target_fpr: float = ev.TARGET_FPR) -> TrainResult:
    flat = flat_features(spark, jsonl_glob)
    flat = ds.group_dropout(flat, "file_key")
    # written once: the shards are read and flattened a single time for all that follows
    split = materialise(ds.stratified_split(flat, "file_key", frac=ds.VAL_FRACTION), "split")
    train = ds.sample_weights(split.filter(F.col("split") == "train"))
    val = split.filter(F.col("split") == "val")
    model = bo.boost_monotone(train, fl.FEATURE_COLS, "label", "file_key", weight="weight",
                              params=params, valid=val)
    scored = materialise(bo.score(val, model), "scored")
    auc = ev.metric_auc(scored).first()["auc"]
    sweep = ev.threshold_sweep(scored, ev.GRID_TRAIN)
    best = ev.pick_threshold(sweep, target_fpr).collect()
    imp = bo.feature_importance(model.tree_frame(spark), model.features, 15)
    counts = {r["label"]: r["n"] for r in ds.class_balance(split.select("label")).collect()}
    if model_path:
        model.save(spark, model_path)
    return TrainResult(model, auc, [r.asDict() for r in sweep.orderBy(F.col("threshold").desc()).collect()],
                       best[0].asDict() if best else None, [r.asDict() for r in imp.collect()], counts)


def merge_labelled(spark: SparkSession, benign_csv: str, malicious_csv: str, out_csv: str,
                   schema: str, seed: int = ds.SEED) -> str:
    """Label 0 / 1, union, seeded shuffle (written in shuffled order)."""
    b = io.scan_csv(spark, benign_csv, schema)
    m = io.scan_csv(spark, malicious_csv, schema)
    both = ds.label_and_union(b, m)
    keyed = both.withColumn("_k", F.sha2(F.to_json(F.struct(*[c for c in both.columns])), 256))
    shuffled = ds.seeded_shuffle(keyed, "_k", seed).orderBy("ordinal").drop("_k", "ordinal")
    return io.sink_csv(shuffled, out_csv)


def fine_tune_model(spark: SparkSession, labelled_csv: str, schema: str, base: bo.BoostModel,
                    vault_csv: str, model_path: str | None = None) -> TrainResult:
    df = io.scan_csv(spark, labelled_csv, schema)
    feats = [c for c in fl.FEATURE_COLS if c in df.columns]
    df = pj.coerce_numeric(df, feats)
    df = df.withColumn("file_key", F.sha2(F.to_json(F.struct(*df.columns)), 256))
    df = ds.group_dropout(df, "file_key")  # before the split: vault rows are perturbed too
    split = materialise(ds.nested_split(df, "file_key"), "split")
    io.sink_csv(split.filter(F.col("split") == "vault").select(*feats, "label"), vault_csv)
    train, val = split.filter(F.col("split") == "train"), split.filter(F.col("split") == "val")
    model = bo.fine_tune(train, base, "label", "file_key", valid=val)
    scored = materialise(bo.score(val, model), "scored")
    sweep = ev.threshold_sweep(scored, ev.GRID_TUNE)
    best = ev.pick_threshold(sweep).collect()
    if model_path:
        model.save(spark, model_path)
    return TrainResult(model, ev.metric_auc(scored).first()["auc"],
                       [r.asDict() for r in sweep.orderBy(F.col("threshold").desc()).collect()],
                       best[0].asDict() if best else None, [])


def evaluate_model(spark: SparkSession, vault_csv: str, schema: str, model: bo.BoostModel,
                   fp_csv: str | None = None, threshold: float = ev.DEFAULT_THRESHOLD) -> dict:
    df = io.scan_csv(spark, vault_csv, schema)
    pj.require_columns(df, ["label"])
    pj.assert_binary_label(df, "label")
    feats = [c for c in fl.FEATURE_COLS if c in df.columns]
    if not feats:
        raise ValueError("no model feature columns were found in the dataset")
    scored = bo.score(pj.coerce_numeric(df, feats), model)
    summary = ev.eval_summary(scored, threshold).first().asDict()
    if fp_csv:
        io.sink_csv(ev.false_positive_rows(scored, threshold).drop("score"), fp_csv)
    summary["sweep"] = [r.asDict() for r in ev.threshold_sweep(scored, ev.GRID_EVAL).orderBy("threshold").collect()]
    return summary


def explore(df: DataFrame, label: str = "label", prefixes=("gen_", "hdr_", "sec_", "imp_", "exp_", "datadir_",
                                                             "str_", "byteH_", "byteEH_")) -> dict[str, DataFrame]:
    """Exploratory tables of a flat feature frame (lazy DataFrames)."""
    labelled = df.filter(F.col(label) != -1)
    feats = [c for c in labelled.columns if c.startswith(tuple(prefixes))]
    target = st.target_correlation(labelled, feats, label)
    fast = [c for c in feats if c.startswith(st.FAST_PREFIXES)]
    return {
        "correlation": st.correlation_matrix(labelled, [label] + feats),
        "fast_correlation": st.correlation_matrix(labelled, [label] + fast),
        "target_correlation": target,
        "top_correlated": st.top_correlated(target),
        "rank_abs_correlation": st.rank_abs_correlation(st.target_correlation(labelled, fast, label)),
        "group_order": st.group_order(labelled, feats + [label]),
        "class_balance": ds.class_balance(df, label),
    }
