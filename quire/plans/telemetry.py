"""Registered queries: metric merge and run summaries (Family B core)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import merge, summary
from quire.plans.registry import register
from quire.sources import fixtures as fx


def merged(spark, d):
    return merge.merge_metrics(fx.metric_lines(spark, d))


@register("merge_metrics", """
SELECT experiment_id, step, total_steps, val_loss, train_loss, train_time_ms, step_avg_ms,
       is_final_step, arrivals FROM metrics""", ("metrics",))
def q_merge_metrics(spark, d):
    return merged(spark, d).select("experiment_id", "step", "total_steps", "val_loss", "train_loss",
                                   "train_time_ms", "step_avg_ms", "is_final_step", "arrivals")


@register("merge_changes", """
WITH ch AS (
  SELECT experiment_id, step,
    row_number() OVER (PARTITION BY experiment_id, step ORDER BY seq) = 1
    OR (total_steps IS NOT NULL AND total_steps IS DISTINCT FROM last_value(total_steps IGNORE NULLS) OVER (
          PARTITION BY experiment_id, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    OR (val_loss IS NOT NULL AND val_loss IS DISTINCT FROM last_value(val_loss IGNORE NULLS) OVER (
          PARTITION BY experiment_id, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    OR (train_loss IS NOT NULL AND train_loss IS DISTINCT FROM last_value(train_loss IGNORE NULLS) OVER (
          PARTITION BY experiment_id, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    OR (train_time_ms IS NOT NULL AND train_time_ms IS DISTINCT FROM last_value(train_time_ms IGNORE NULLS) OVER (
          PARTITION BY experiment_id, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    OR (step_avg_ms IS NOT NULL AND step_avg_ms IS DISTINCT FROM last_value(step_avg_ms IGNORE NULLS) OVER (
          PARTITION BY experiment_id, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    OR (coalesce(is_final_step, false) AND NOT coalesce(bool_or(is_final_step) OVER (
          PARTITION BY experiment_id, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false))
    AS changed
  FROM metric_lines)
SELECT experiment_id, count(*) AS arrivals, count(*) FILTER (WHERE changed) AS changed_rows,
       count(DISTINCT step) AS steps
FROM ch GROUP BY experiment_id""", ("metric_lines",))
def q_merge_changes(spark, d):
    return merge.change_counts(fx.metric_lines(spark, d))


SUMMARY_SQL = "SELECT * FROM summaries"

SUMMARY_COLUMNS = ["id", "name", "track", "status", "gpus", "gpu_type", "revision", "metrics_revision",
                   "started_at", "current_step", "total_steps", "val_loss", "train_loss", "latest_loss",
                   "latest_loss_step", "loss_metric", "available_loss_metrics", "train_time_ms",
                   "step_avg_ms", "final_loss", "final_loss_step", "final_val_loss",
                   "final_train_time_ms"]


def summaries(spark, d, include_deleted=False):
    return summary.run_summaries(fx.runs(spark, d), merged(spark, d), include_deleted=include_deleted)


def flat_summary(df):
    return df.withColumn("available_loss_metrics",
                         F.array_join("available_loss_metrics", ",")).select(*SUMMARY_COLUMNS)


@register("run_summaries", SUMMARY_SQL, ("summaries",))
def q_run_summaries(spark, d):
    return flat_summary(summaries(spark, d))


@register("loss_series", """
SELECT experiment_id, CASE WHEN bool_or(val_loss IS NOT NULL) THEN 'val_loss' ELSE 'train_loss' END AS loss_metric
FROM metrics GROUP BY experiment_id
HAVING bool_or(val_loss IS NOT NULL) OR bool_or(train_loss IS NOT NULL)""", ("metrics",))
def q_loss_series(spark, d):
    return summary.loss_series(merged(spark, d))


@register("metric_counts", """
SELECT experiment_id, count(*) AS n_rows, count(val_loss) AS n_val, count(train_loss) AS n_train
FROM metrics GROUP BY experiment_id""", ("metrics",))
def q_metric_counts(spark, d):
    return summary.metric_counts(merged(spark, d))


@register("metric_history", """
WITH t AS (SELECT experiment_id, max(step) AS latest,
                  max(CASE WHEN is_final_step THEN step END) AS final FROM metrics GROUP BY experiment_id)
SELECT m.experiment_id, m.step, m.total_steps, m.val_loss, m.train_loss, m.train_time_ms, m.step_avg_ms,
       m.is_final_step, coalesce(m.val_loss, m.train_loss) AS loss,
       m.step = t.latest AS is_latest, coalesce(m.step = t.final, false) AS is_final
FROM metrics m JOIN t USING (experiment_id)""", ("metrics",))
def q_metric_history(spark, d):
    return summary.metric_history(merged(spark, d)).select(
        "experiment_id", "step", "total_steps", "val_loss", "train_loss", "train_time_ms",
        "step_avg_ms", "is_final_step", "loss", "is_latest", "is_final")


@register("decode_runs", """
SELECT id, name, coalesce(nullif(gpu_type, ''), 'H100') AS gpu_type,
       CAST(revision AS BIGINT) AS revision, CAST(metrics_revision AS BIGINT) AS metrics_revision,
       concat_ws(',', 'LR=' || env_lr, 'WD=' || env_wd) AS env_text
FROM runs""", ("runs",))
def q_decode_runs(spark, d):
    r = fx.runs(spark, d)
    raw = r.withColumn("env_vars", F.to_json("env_vars")).withColumn("gpu_type", F.col("gpu_type"))
    dec = summary.decode_runs(raw)
    env_text = F.array_join(F.transform(F.array_sort(F.map_entries("env_vars")),
                                        lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return dec.select("id", "name", "gpu_type", "revision", "metrics_revision", env_text.alias("env_text"))
