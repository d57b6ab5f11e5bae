"""Run summaries and per-run metric reads.

The source answers "latest/final row of each series" with five correlated
top-1 subqueries per run.  Spark rejects correlated subqueries in ON, and they
would be five scans anyway; here it is **one** hash aggregate over the merged
metrics keyed by run, with ``max_by(struct, step)`` restricted by a ``when``
(the FILTER clause), then one join to the run table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import gpu_type_or_default, live, primary_loss


def _top(fields: list[str], where=None, order="step"):
    """``max_by(struct(fields), order)`` as one scalar ``max_by`` per field.

    (run, step) is unique in merged metrics, so the fields come from the same
    row; scalar numeric buffers keep the aggregate a HashAggregate (a struct
    value would force a sort-based aggregate)."""
    o = F.col(order) if where is None else F.when(where, F.col(order))
    return F.struct(*[F.max_by(F.col(f), o).alias(f) for f in fields])


def metric_tops(metrics: DataFrame) -> DataFrame:
    """One row per run: progress, latest val/train, final val/train rows."""
    has_val = F.col("val_loss").isNotNull()
    has_train = F.col("train_loss").isNotNull()
    fin = F.coalesce(F.col("is_final_step"), F.lit(False))
    return metrics.groupBy("experiment_id").agg(
        _top(["step", "total_steps"]).alias("progress"),
        _top(["step", "val_loss", "train_time_ms", "step_avg_ms"], has_val).alias("lv"),
        _top(["step", "train_loss", "train_time_ms", "step_avg_ms"], has_train).alias("lt"),
        _top(["step", "val_loss", "train_time_ms"], fin & has_val).alias("fv"),
        _top(["step", "train_loss", "train_time_ms"], fin & has_train).alias("ft"),
    )


def run_summaries(runs: DataFrame, metrics: DataFrame, include_deleted: bool = False,
                  ids: DataFrame | None = None) -> DataFrame:
    """A2: the canonical run summary (rules of SURVEY 2.11).

    ``ids`` (optional, column ``id``) restricts the runs; it is a semi join so
    Catalyst can push it below the aggregate's join.
    """
    r = runs if include_deleted else runs.where(live())
    if ids is not None:
        r = r.join(ids.select("id").distinct(), "id", "left_semi")
        metrics = metrics.join(ids.select(F.col("id").alias("experiment_id")).distinct(),
                               "experiment_id", "left_semi")
    return summaries_of(r, metric_tops(metrics))


def summaries_of(runs: DataFrame, tops: DataFrame) -> DataFrame:
    """A2 from the runs' top rows (:func:`metric_tops`); runs without any keep their own columns."""
    j = runs.join(tops, runs["id"] == tops["experiment_id"], "left").drop("experiment_id")
    has_val = F.col("lv.step").isNotNull()
    has_train = F.col("lt.step").isNotNull()
    primary = F.when(has_val, F.lit("val_loss")).when(has_train, F.lit("train_loss"))
    pick = lambda v, t: F.when(has_val, v).when(has_train, t)
    latest_loss = pick(F.col("lv.val_loss"), F.col("lt.train_loss"))
    latest_time = pick(F.col("lv.train_time_ms"), F.col("lt.train_time_ms"))
    final_loss = pick(F.col("fv.val_loss"), F.col("ft.train_loss"))
    final_time = pick(F.col("fv.train_time_ms"), F.col("ft.train_time_ms"))
    available = F.filter(F.array(F.when(has_val, F.lit("val_loss")),
                                 F.when(has_train, F.lit("train_loss"))), lambda x: x.isNotNull())
    keep = [c for c in runs.columns if c not in ("gpu_type", "env_vars", "dependencies",
                                                 "revision", "metrics_revision")]
    have = set(runs.columns)
    opt = lambda c, default: F.col(c) if c in have else default
    empty = F.create_map().cast("map<string,string>")
    return j.select(
        *keep,
        gpu_type_or_default(opt("gpu_type", F.lit(None).cast("string"))).alias("gpu_type"),
        F.coalesce(opt("env_vars", empty), empty).alias("env_vars"),
        F.coalesce(opt("dependencies", empty), empty).alias("dependencies"),
        F.coalesce(opt("revision", F.lit(0)), F.lit(0)).cast("bigint").alias("revision"),
        F.coalesce(opt("metrics_revision", F.lit(0)), F.lit(0)).cast("bigint").alias("metrics_revision"),
        F.col("progress.step").alias("current_step"),
        F.col("progress.total_steps").alias("total_steps"),
        F.col("lv.val_loss").alias("val_loss"),
        F.col("lt.train_loss").alias("train_loss"),
        latest_loss.alias("latest_loss"),
        pick(F.col("lv.step"), F.col("lt.step")).alias("latest_loss_step"),
        latest_loss.alias("loss"),
        primary.alias("loss_metric"),
        available.alias("available_loss_metrics"),
        latest_time.alias("train_time_ms"),
        pick(F.col("lv.step_avg_ms"), F.col("lt.step_avg_ms")).alias("step_avg_ms"),
        final_loss.alias("final_loss"),
        pick(F.col("fv.step"), F.col("ft.step")).alias("final_loss_step"),
        # Kept as in the source: "final_val_loss" is the latest primary loss.
        latest_loss.alias("final_val_loss"),
        F.when(final_loss.isNotNull(), final_time).otherwise(latest_time).alias("final_train_time_ms"),
    )


def loss_series(metrics: DataFrame) -> DataFrame:
    """A1: primary series per run; runs without any loss row are absent."""
    g = metrics.groupBy("experiment_id").agg(
        F.bool_or(F.col("val_loss").isNotNull()).alias("has_val"),
        F.bool_or(F.col("train_loss").isNotNull()).alias("has_train"))
    return g.where("has_val OR has_train").select(
        "experiment_id",
        F.when(F.col("has_val"), "val_loss").otherwise("train_loss").alias("loss_metric"))


def metric_counts(metrics: DataFrame) -> DataFrame:
    """A5: rows, val rows, train rows per run."""
    return metrics.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("val_loss").alias("n_val"),
        F.count("train_loss").alias("n_train"))


def metric_history(metrics: DataFrame, run_ids: DataFrame | None = None) -> DataFrame:
    """History rows (ordered by step by the consumer), latest and final flags.

    ``is_latest`` marks each run's highest step; ``is_final`` any final row
    (the source takes an arbitrary final row; the highest final step here).
    """
    m = metrics if run_ids is None else metrics.join(run_ids, "experiment_id", "left_semi")
    tops = m.groupBy("experiment_id").agg(
        F.max("step").alias("_latest"),
        F.max(F.when(F.coalesce("is_final_step", F.lit(False)), F.col("step"))).alias("_final"))
    return (m.join(tops, "experiment_id")
            .withColumn("loss", primary_loss())
            .withColumn("is_latest", F.col("step") == F.col("_latest"))
            .withColumn("is_final", F.coalesce(F.col("step") == F.col("_final"), F.lit(False)))
            .drop("_latest", "_final"))


def decode_runs(raw: DataFrame) -> DataFrame:
    """Stored run rows -> typed runs (JSON maps, defaults)."""
    def as_map(c):
        if c not in raw.columns:
            return F.create_map().cast("map<string,string>")
        t = dict(raw.dtypes)[c]
        if t.startswith("map"):
            return F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))
        return F.coalesce(F.from_json(F.nullif(F.col(c), F.lit("")), "map<string,string>"),
                          F.create_map().cast("map<string,string>"))
    cols = []
    for c in raw.columns:
        if c == "gpu_type":
            cols.append(gpu_type_or_default(c).alias(c))
        elif c in ("env_vars", "dependencies"):
            cols.append(as_map(c).alias(c))
        elif c in ("revision", "metrics_revision"):
            cols.append(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c))
        else:
            cols.append(F.col(c))
    return raw.select(*cols)
