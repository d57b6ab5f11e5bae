"""Loss curves: downsampling, per-step means and medians, reference gaps,
schedule stages and stop screens (W4, W5, W17-W20, A8, A9, A14, J10-J12).

Curves are partitioned by run: every per-curve window is ``partitionBy(run)``;
per-step statistics are aggregates keyed by step.  No global window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.prefix import prefix_sums
from quire.session import materialize

# The optimizer track's reference validation curve.
REFERENCE_VAL_BY_STEP = {
    125: 4.51874, 250: 4.05652, 375: 3.90008, 500: 3.81916,
    625: 3.76341, 750: 3.72655, 875: 3.69846, 1000: 3.66557,
    1125: 3.63985, 1250: 3.60786, 1375: 3.58225, 1500: 3.54816,
    1625: 3.52684, 1750: 3.49950, 1875: 3.47572, 2000: 3.45172,
    2125: 3.42949, 2250: 3.40805, 2375: 3.38724, 2500: 3.36632,
    2625: 3.34535, 2750: 3.32580, 2875: 3.30741, 3000: 3.29107,
    3100: 3.28049, 3125: 3.27861, 3150: 3.27720, 3175: 3.27659,
}
MAX_POINTS_MIN, MAX_POINTS_MAX = 4, 1200


def reference_curve(spark) -> DataFrame:
    """The fixed reference curve as a 28-row table (step, ref_loss)."""
    return spark.createDataFrame(sorted(REFERENCE_VAL_BY_STEP.items()), "step long, ref_loss double")


def loss_curve(metrics: DataFrame, run: str = "experiment_id") -> DataFrame:
    """Primary series of each run: val_loss if the run has any, else train_loss;
    rows without that series are not points.  Adds ``loss`` and ``loss_metric``.

    The per-run flag is an aggregate joined back (partial aggregation; a hot
    run is split by AQE's skew join), not a window over the whole run."""
    flag = metrics.groupBy(run).agg(F.bool_or(F.col("val_loss").isNotNull()).alias("_has_val"))
    m = metrics.join(flag, run)
    m = m.withColumn("loss_metric", F.when(F.col("_has_val"), "val_loss").otherwise("train_loss")).drop("_has_val")
    m = m.withColumn("loss", F.when(F.col("loss_metric") == "val_loss", F.col("val_loss"))
                     .otherwise(F.col("train_loss")))
    return m.where(F.col("loss").isNotNull())


def _extremes(points: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Per bucket: the position of the minimum and of the maximum value, ties to
    the lowest position -- aggregates, so a large bucket is combined map-side."""
    g = points.groupBy(*keys).agg(
        F.min_by(F.col(pos), F.struct(F.col(value), F.col(pos))).alias("_lo"),
        F.min_by(F.col(pos), F.struct(-F.col(value), F.col(pos))).alias("_hi"))
    return g.select(*keys[:1], F.explode(F.array("_lo", "_hi")).alias(pos)).distinct()


def downsample_step(curve: DataFrame, max_points: int, run: str = "experiment_id",
                    value: str = "loss") -> DataFrame:
    """Keep first and last points; interior points go to step buckets
    ``trunc((step-min-1) * B / max(1, max-min-1))`` with ``B = max(1, (n-2)//2)``;
    each bucket keeps its min and max (ties -> lowest step); cut to ``max_points``
    by step.  Curves with at most ``max_points`` points are returned whole.

    Run statistics and bucket extremes are aggregates; only the kept points
    (at most ``max_points + 2`` per run) see a window."""
    if not MAX_POINTS_MIN <= max_points <= MAX_POINTS_MAX:
        raise ValueError("max_points must be within 4..1200")
    curve = materialize(curve.where(F.col(value).isNotNull()))  # read by three branches below
    c = curve
    stats = c.groupBy(run).agg(F.count(F.lit(1)).alias("_n"), F.min("step").alias("_lo"),
                               F.max("step").alias("_hi"))
    c = c.join(stats, run)
    b = max(1, (max_points - 2) // 2)
    denom = F.greatest(F.col("_hi") - F.col("_lo") - 1, F.lit(1))
    bucket = ((F.col("step") - F.col("_lo") - 1) * b / denom).cast("bigint")
    interior = (F.col("step") > F.col("_lo")) & (F.col("step") < F.col("_hi"))
    c = c.withColumn("_b", F.when(interior, bucket))
    small_or_end = c.where((F.col("_n") <= max_points) | ~interior).select(run, "step")
    ext = _extremes(c.where((F.col("_n") > max_points) & interior), [run, "_b"], "step", value)
    keep = small_or_end.unionByName(ext).distinct()
    kept = curve.join(keep, [run, "step"], "left_semi")
    pos = F.row_number().over(Window.partitionBy(run).orderBy("step"))
    return kept.withColumn("_pos", pos).where(F.col("_pos") <= max_points).drop("_pos")


def downsample_index(curve: DataFrame, max_points: int, run: str = "experiment_id",
                     value: str = "loss", order: str = "step") -> DataFrame:
    """min/max per index bucket ``[1+floor(b*m/B), 1+floor((b+1)*m/B))``,
    ``m = n-2``, ``B = (max_points-2)//2``; ties -> first index; endpoints kept;
    output in source order (no final cut).  The point index comes from the
    distributed prefix sums, bucket extremes from aggregates."""
    if max_points < 4:
        raise ValueError("max_points must be at least 4")
    from quire.plans.prefix import prefix_sums
    bcount = (max_points - 2) // 2
    curve = materialize(curve)  # read by the index, the statistics and the output
    idx = prefix_sums(curve.select(run, order, F.lit(1).cast("bigint").alias("_one")), [run], [order],
                      {"_one": "index"}).select(run, order, "index")
    stats = curve.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    c = curve.join(idx, [run, order]).join(stats, run)
    m = F.col("_n") - 2
    # greatest b with b*m < i*B  <=>  b = floor((i*B - 1) / m)
    bucket = F.floor((F.col("index") * bcount - 1) / m).cast("bigint")
    interior = (F.col("index") >= 1) & (F.col("index") <= F.col("_n") - 2)
    c = c.withColumn("_b", F.when(interior, bucket))
    small_or_end = c.where((F.col("_n") <= max_points) | ~interior).select(run, "index")
    ext = _extremes(c.where((F.col("_n") > max_points) & interior), [run, "_b"], "index", value)
    keep = small_or_end.unionByName(ext).distinct()
    return c.join(keep, [run, "index"], "left_semi").drop("_n", "_b")


def mean_curve(curves: DataFrame, keys=("step",)) -> DataFrame:
    """Per step, mean loss / time / step average over their non-null values;
    ``n`` = number of losses."""
    return curves.groupBy(*keys).agg(
        F.avg("loss").alias("loss"),
        F.avg("train_time_ms").alias("train_time_ms"),
        F.avg("step_avg_ms").alias("step_avg_ms"),
        F.count("loss").alias("n"))


def residual_curves(curves: DataFrame, run: str = "experiment_id", scope=()) -> DataFrame:
    """Residual of each point to the per-step median across curves.

    Steps need at least two points; the median is the middle value or the mean
    of the two middle values, picked by rank: points are ranked within a step by
    prefix sums over blocks of losses, so a step shared by every run is spread
    over the blocks.  A selection needs at least two curves.  ``scope`` columns
    split the input into independent selections (e.g. groups).
    """
    scope = list(scope)
    curves = materialize(curves)
    ncur = curves.groupBy(*scope).agg(F.count_distinct(run).alias("_curves"))
    key = [*scope, "step"]
    ranked = prefix_sums(curves.select(*key, "loss", run, F.lit(1).cast("bigint").alias("_one")), key, ["loss", run],
                         {"_one": "_rank"})
    pts = curves.groupBy(*key).agg(F.count(F.lit(1)).alias("_pts")).where(F.col("_pts") >= 2)
    middle = (F.col("_rank") == F.expr("(_pts - 1) div 2")) | (F.col("_rank") == F.expr("_pts div 2"))
    med = ranked.join(pts, key).where(middle).groupBy(*key).agg((F.sum("loss") / F.count("loss")).alias("median"))
    j = curves.join(med, [*scope, "step"], "inner")
    j = j.join(ncur, scope, "inner") if scope else j.join(ncur.withColumn("_k", F.lit(1)),
                                                          F.lit(1) == F.col("_k"), "inner")
    return j.where(F.col("_curves") >= 2).select(
        *scope, run, "step", "loss", "median", (F.col("loss") - F.col("median")).alias("residual"))


def step_interval(curves: DataFrame, run: str = "experiment_id", scope=(),
                  run_order: Column | None = None, default: int = 250) -> DataFrame:
    """Most frequent positive step gap of the first run (by ``run_order``)
    that has one; ties -> the smaller gap; ``default`` when none."""
    scope = list(scope)
    curves = materialize(curves.select(*scope, run, "step"))
    w = Window.partitionBy(*scope, run).orderBy("step")
    g = curves.select(*scope, run, (F.col("step") - F.lag("step").over(w)).alias("gap")).where(F.col("gap") > 0)
    order = run_order if run_order is not None else F.col(run)
    counts = g.groupBy(*scope, run).agg(F.lit(1).alias("_has"))
    first = counts.join(curves.select(*scope, run, order.alias("_ord")).distinct(), [*scope, run]) \
        .groupBy(*scope).agg(F.min_by(run, "_ord").alias(run))
    modes = g.join(first, [*scope, run], "left_semi").groupBy(*scope, run, "gap").agg(F.count(F.lit(1)).alias("c"))
    best = modes.groupBy(*scope).agg(F.min_by("gap", F.struct(-F.col("c"), F.col("gap"))).alias("interval"))
    if not scope:
        return best.select(F.col("interval").cast("bigint").alias("interval")) \
            .unionByName(curves.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("interval"))) \
            .agg(F.coalesce(F.max("interval"), F.lit(default)).cast("bigint").alias("interval"))
    return curves.select(*scope).distinct().join(best, scope, "left").select(
        *scope, F.coalesce("interval", F.lit(default)).cast("bigint").alias("interval"))


def reference_gap(curves: DataFrame, ref: DataFrame) -> DataFrame:
    """Gap of each point to a reference curve, at the reference's steps only."""
    return curves.join(ref, "step", "inner").withColumn("gap", F.col("loss") - F.col("ref_loss"))


def early_stop_screen(curves: DataFrame, ref: DataFrame, run: str = "experiment_id",
                      catastrophic_steps: int = 125, catastrophic_margin: float = 0.50,
                      grace_steps: int = 1000, margin: float = 0.03, patience: int = 2) -> DataFrame:
    """First checkpoint where a run is hopeless.

    At reference steps before the final step: gap > ``catastrophic_margin`` at
    step >= ``catastrophic_steps`` stops with 'catastrophic_gap'; gap >
    ``margin`` at step >= ``grace_steps`` on ``patience`` consecutive
    checkpoints stops with 'patience_gap'.  One row per run that stops.
    """
    g = reference_gap(curves.where(F.col("step") < F.col("total_steps")), ref)
    cat = (F.col("step") >= catastrophic_steps) & (F.col("gap") > catastrophic_margin)
    bad = (F.col("step") >= grace_steps) & (F.col("gap") > margin)
    g = g.withColumn("_cat", cat).withColumn("_bad", bad)
    w = Window.partitionBy(run).orderBy("step")
    # consecutive bad checkpoints: islands of equal _bad between resets
    g = g.withColumn("_island", F.sum(F.when(~F.col("_bad"), 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    g = g.withColumn("_streak", F.when(F.col("_bad"), F.row_number().over(
        Window.partitionBy(run, "_island", "_bad").orderBy("step"))).otherwise(0))
    hit = g.where(F.col("_cat") | (F.col("_streak") >= patience))
    reason = F.when(F.col("_cat"), "catastrophic_gap").otherwise("patience_gap")
    first = hit.groupBy(run).agg(F.min_by(F.struct(F.col("step"), reason.alias("reason"),
                                                   F.col("gap"), F.col("_streak").cast("bigint").alias("bad_points")),
                                          F.col("step")).alias("s"))
    return first.select(run, "s.step", "s.reason", "s.gap", "s.bad_points")


def target_reached(curves: DataFrame, target: float, run: str = "experiment_id") -> DataFrame:
    """First checkpoint with loss <= target."""
    return curves.where(F.col("loss") <= target).groupBy(run).agg(F.min("step").alias("step"))


def recent_metrics(metrics: DataFrame, n: int = 20, run: str = "experiment_id") -> DataFrame:
    """The last ``n`` metric rows of each run, newest first (``rank`` 1 = newest)."""
    w = Window.partitionBy(run).orderBy(F.col("step").desc())
    return metrics.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def event_retention(feed: DataFrame, now: Column, max_rows: int = 10_000, max_age_days: int = 7,
                    id_col: str = "id", ts: str = "created_at") -> DataFrame:
    """Keep ids at or above the ``max_rows``-th newest id, and rows newer
    than ``now - max_age_days``.  The cutoff id is a top-k (per-task best
    ``max_rows``, merged), not a global window."""
    top = feed.select(id_col).orderBy(F.col(id_col).desc()).limit(max_rows)
    cut = top.agg(F.when(F.count(F.lit(1)) >= max_rows, F.min(id_col)).otherwise(F.lit(0)).alias("_cut"))
    kept = feed.join(cut, F.col(id_col) >= F.col("_cut"), "inner").drop("_cut")  # cut: one row
    return kept.where(F.col(ts) >= now - F.make_interval(days=F.lit(max_age_days)))


def stage_boundaries(durations: list[float], scheduled: int, extension: int) -> list[tuple[int, int]]:
    """Stage (start, end) steps.  A stage ends at its share of the scheduled
    steps, summed up and rounded half to even; the last stage is the extension
    and ends ``extension`` steps after them."""
    shares = np.cumsum(np.asarray(durations, dtype=float)[:-1])
    cuts = np.rint(shares * scheduled).astype(int)
    if not len(cuts) or cuts[-1] != scheduled:
        raise ValueError("stage durations before the extension must sum to 1")
    edge = np.concatenate([[0], cuts, [scheduled + extension]]).tolist()
    return [(edge[i], edge[i + 1]) for i in range(len(durations))]


def stage_lookup(steps: DataFrame, names: list[str], durations: list[float], scheduled: int,
                 extension: int, step: str = "step") -> DataFrame:
    """Step -> (stage, t): the stage with start <= step < end and the
    fraction of it done; at or beyond the end -> last stage, t = 1.0.

    The stage table has a handful of rows, so the range join is a CASE chain
    evaluated in place (no join, no shuffle)."""
    bounds = stage_boundaries(durations, scheduled, extension)
    s = F.col(step)
    name = F.lit(names[-1])
    frac = F.lit(1.0)
    for i in range(len(bounds) - 1, -1, -1):
        start, end = bounds[i]
        name = F.when(s < end, F.lit(names[i])).otherwise(name)
        frac = F.when(s < end, (s - F.lit(start)).cast("double") / F.lit(end - start)).otherwise(frac)
    return steps.withColumn("stage", name).withColumn("t", frac)


#: Bins that a schedule's steps are cut into for :func:`stage_join`.
STAGE_BINS = 1024


def stage_join(steps: DataFrame, stages: DataFrame, schedule: str = "schedule", step: str = "step") -> DataFrame:
    """J12 against a table of schedules: ``stages`` (schedule, stage, start, end), any number of them ->
    the steps with ``stage`` and ``t`` as :func:`stage_lookup` gives them, null before a schedule's
    first stage or in a gap.

    A range join by bins: a stage is listed in the bins that it touches (:data:`STAGE_BINS` of equal width
    over its schedule, so at most that many rows and two more), a step has one bin, and the two meet on
    (schedule, bin).  So a schedule that most steps belong to is as many keys as it has bins."""
    end = F.col("end")
    whole = stages.where(end > F.col("start"))
    over = whole.groupBy(schedule).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    over = over.withColumn("_width", F.expr(f"(_hi - _lo + {STAGE_BINS - 1}) div {STAGE_BINS}"))
    cells = F.sequence(F.expr("(start - _lo) div _width"), F.expr("(end - 1 - _lo) div _width"))
    placed = whole.join(over, schedule).select(schedule, F.explode(cells).alias("_bin"), "stage", "start", "end")
    at = F.least(F.col(step), F.col("_hi") - 1)  # beyond the end: the last stage
    cell = F.when(at >= F.col("_lo"), F.expr(f"(least({step}, _hi - 1) - _lo) div _width"))
    s = steps.join(over, schedule, "left").withColumns({"_at": at, "_bin": cell})
    p = placed.withColumnsRenamed({schedule: "_schedule", "_bin": "_cell", "start": "_start", "end": "_end"})
    met = s.join(p, (s[schedule] == p["_schedule"]) & (s["_bin"] == p["_cell"]) & (s["_at"] >= p["_start"]) & (s["_at"] < p["_end"]), "left")
    t = F.when(F.col("stage").isNull(), F.lit(None).cast("double")).when(F.col(step) >= F.col("_hi"), F.lit(1.0)).otherwise(
        (F.col(step) - F.col("_start")).cast("double") / (F.col("_end") - F.col("_start")))
    return met.select(*steps.columns, "stage", t.alias("t"))
