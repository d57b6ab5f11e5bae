"""Keyed metric merge: many arrivals per (run, step) fold into one row.

The source upsert keeps, per column, the last non-null value by arrival and ORs
the final flag.  Here that is one hash aggregate on (experiment_id, step) using
``max_by(col, seq)`` restricted to non-null values -- map-side partial
aggregation included, no sort, no window.  ``seq`` (arrival order within the
run) is mandatory: an unordered ``last()`` would make the answer depend on the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("experiment_id", "step")
VALUE_COLUMNS = ("total_steps", "val_loss", "train_loss", "train_time_ms", "step_avg_ms")


def _require_seq(lines: DataFrame, seq: str) -> None:
    if seq not in lines.columns:
        raise ValueError(f"metric lines need an arrival-order column '{seq}'")


def _last_non_null(c: str, seq: str):
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq)))


def merge_metrics(lines: DataFrame, seq: str = "seq", key=KEY) -> DataFrame:
    """One row per key; last non-null per column by ``seq``; final = OR."""
    _require_seq(lines, seq)
    aggs = [_last_non_null(c, seq).alias(c) for c in VALUE_COLUMNS if c in lines.columns]
    aggs.append(F.coalesce(F.bool_or("is_final_step"), F.lit(False)).alias("is_final_step"))
    # a stored row re-entering the merge carries the arrivals it already counts
    n = F.sum(F.coalesce(F.col("arrivals"), F.lit(1))) if "arrivals" in lines.columns else F.count(F.lit(1))
    aggs.append(n.cast("bigint").alias("arrivals"))
    return lines.groupBy(*key).agg(*aggs)


def merge_changes(lines: DataFrame, seq: str = "seq", key=KEY) -> DataFrame:
    """Per arrival, did it alter the stored row?

    The stored row before an arrival is, per column, the last non-null value
    among earlier arrivals of the same key.  An arrival changes the row if it is
    the first one, or if some non-null value differs (null-safe) from the stored
    one, or it raises the final flag.  Returns the lines with a ``changed`` flag.
    """
    _require_seq(lines, seq)
    w = Window.partitionBy(*key).orderBy(seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cond = F.row_number().over(w) == 1
    for c in VALUE_COLUMNS:
        if c not in lines.columns:
            continue
        prev = F.last(c, ignorenulls=True).over(before)
        cond = cond | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(prev))
    prev_final = F.coalesce(F.bool_or("is_final_step").over(before), F.lit(False))
    cond = cond | (F.coalesce(F.col("is_final_step"), F.lit(False)) & ~prev_final)
    return lines.withColumn("changed", cond)


def change_counts(lines: DataFrame, seq: str = "seq") -> DataFrame:
    """Per run: arrivals, arrivals that changed the stored rows, touched steps."""
    ch = merge_changes(lines, seq)
    return ch.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("arrivals"),
        F.count_if("changed").alias("changed_rows"),
        F.count_distinct("step").alias("steps"),
    )


def revision_bumps(lines: DataFrame, batch_col: str = "batch_id", seq: str = "seq") -> DataFrame:
    """+1 revision and metrics revision per run per batch that changed it.

    ``lines`` carry the micro-batch each arrival belongs to; returns per run
    the number of batches that changed it (the revision increment).
    """
    ch = merge_changes(lines, seq)
    per_batch = ch.where("changed").select("experiment_id", batch_col).distinct()
    return per_batch.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("revision_bump"))


def metric_state(lines: DataFrame, seq: str = "seq", key=KEY) -> DataFrame:
    """Mergeable form of W1: per key, each column's last non-null value *and*
    the seq it came from, the final flag and the arrival count.  Merging states
    (:func:`merge_metric_state`) in any grouping of the arrivals gives the same
    answer as one merge over all of them."""
    _require_seq(lines, seq)
    aggs = []
    for c in [c for c in VALUE_COLUMNS if c in lines.columns]:
        aggs += [_last_non_null(c, seq).alias(c), F.max(F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_{c}_seq")]
    aggs += [F.coalesce(F.bool_or("is_final_step"), F.lit(False)).alias("is_final_step"),
             F.count(F.lit(1)).cast("bigint").alias("arrivals")]
    return lines.groupBy(*key).agg(*aggs)


def merge_metric_state(states: DataFrame, key=KEY) -> DataFrame:
    aggs = []
    for c in [c for c in VALUE_COLUMNS if c in states.columns]:
        aggs += [F.max_by(F.col(c), F.col(f"_{c}_seq")).alias(c), F.max(f"_{c}_seq").alias(f"_{c}_seq")]
    aggs += [F.coalesce(F.bool_or("is_final_step"), F.lit(False)).alias("is_final_step"),
             F.sum("arrivals").cast("bigint").alias("arrivals")]
    return states.groupBy(*key).agg(*aggs)
