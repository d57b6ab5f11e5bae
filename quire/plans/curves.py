"""Registered queries: curves, downsampling, medians, reference gaps, screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import curves
from quire.plans.registry import nine_digits, register
from quire.sources import fixtures as fx

MAX_POINTS = 20
SCREEN = dict(catastrophic_steps=125, catastrophic_margin=25.0, grace_steps=1000, margin=3.0, patience=2)
TARGET = 5.0
STAGES = (["s1", "s2", "s3", "extension"], [0.35, 0.35, 0.3, 0.0], 1440, 40)

CURVE_VIEW = """
WITH dc0 AS (
  SELECT *, CASE WHEN bool_or(val_loss IS NOT NULL) OVER (PARTITION BY experiment_id)
                 THEN 'val_loss' ELSE 'train_loss' END AS loss_metric FROM dense),
dc AS (
  SELECT *, CASE WHEN loss_metric = 'val_loss' THEN val_loss ELSE train_loss END AS loss FROM dc0
  WHERE CASE WHEN loss_metric = 'val_loss' THEN val_loss ELSE train_loss END IS NOT NULL)"""


def dense_curves(spark, d):
    return curves.loss_curve(fx.dense(spark, d))


@register("downsample_step", CURVE_VIEW + f""",
s AS (SELECT *, count(*) OVER w AS n, min(step) OVER w AS lo, max(step) OVER w AS hi
      FROM dc WINDOW w AS (PARTITION BY experiment_id)),
b AS (SELECT *, CASE WHEN step > lo AND step < hi THEN
        CAST(trunc((step - lo - 1) * {max(1, (MAX_POINTS - 2) // 2)} / greatest(hi - lo - 1, 1)) AS BIGINT) END AS bk
      FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, bk ORDER BY loss, step) AS lr,
                row_number() OVER (PARTITION BY experiment_id, bk ORDER BY loss DESC, step) AS hr FROM b),
k AS (SELECT * FROM r WHERE n <= {MAX_POINTS} OR bk IS NULL OR lr = 1 OR hr = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY step) AS pos FROM k)
SELECT experiment_id, step, loss FROM p WHERE pos <= {MAX_POINTS}""", ("dense",))
def q_downsample_step(spark, d):
    return curves.downsample_step(dense_curves(spark, d), MAX_POINTS).select("experiment_id", "step", "loss")


@register("downsample_index", CURVE_VIEW + f""",
s AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY step) - 1 AS i,
             count(*) OVER (PARTITION BY experiment_id) AS n FROM dc),
b AS (SELECT *, i >= 1 AND i <= n - 2 AS interior,
             CASE WHEN i >= 1 AND i <= n - 2 THEN CAST(floor((i * {(MAX_POINTS - 2) // 2} - 1) / (n - 2)) AS BIGINT) END AS bk
      FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, bk ORDER BY loss, i) AS lr,
                row_number() OVER (PARTITION BY experiment_id, bk ORDER BY loss DESC, i) AS hr FROM b)
SELECT experiment_id, i AS "index", step, loss FROM r
WHERE n <= {MAX_POINTS} OR NOT interior OR lr = 1 OR hr = 1""", ("dense",))
def q_downsample_index(spark, d):
    return curves.downsample_index(dense_curves(spark, d), MAX_POINTS).select("experiment_id", "index", "step", "loss")


@register("mean_curve", CURVE_VIEW + """
SELECT step, round(avg(loss), 9) AS loss,
       avg(train_time_ms) AS train_time_ms,
       round(avg(step_avg_ms), 9) AS step_avg_ms,
       count(loss) AS n
FROM dc GROUP BY step""", ("dense",))
def q_mean_curve(spark, d):
    return nine_digits(curves.mean_curve(dense_curves(spark, d)), "loss", "step_avg_ms")


@register("residual_curves", CURVE_VIEW + """,
c AS (SELECT *, experiment_id % 5 AS sel FROM dc),
nc AS (SELECT sel, count(DISTINCT experiment_id) AS curves FROM c GROUP BY sel),
o AS (SELECT sel, step, loss, row_number() OVER (PARTITION BY sel, step ORDER BY loss) AS rk,
             count(*) OVER (PARTITION BY sel, step) AS cnt FROM c),
med AS (SELECT sel, step,
          CASE WHEN max(cnt) % 2 = 1 THEN max(CASE WHEN rk = (cnt + 1) / 2 THEN loss END)
               ELSE (max(CASE WHEN rk = cnt / 2 THEN loss END) + max(CASE WHEN rk = cnt / 2 + 1 THEN loss END)) / 2
          END AS median
        FROM o GROUP BY sel, step HAVING max(cnt) >= 2)
SELECT c.sel, c.experiment_id, c.step, c.loss, m.median, c.loss - m.median AS residual
FROM c JOIN med m ON m.sel = c.sel AND m.step = c.step JOIN nc ON nc.sel = c.sel
WHERE nc.curves >= 2""", ("dense",))
def q_residual_curves(spark, d):
    c = dense_curves(spark, d).withColumn("sel", F.col("experiment_id") % 5)
    return curves.residual_curves(c, scope=("sel",))


@register("step_interval", CURVE_VIEW + """,
c AS (SELECT *, experiment_id % 5 AS sel FROM dc),
g AS (SELECT sel, experiment_id, step - lag(step) OVER (PARTITION BY sel, experiment_id ORDER BY step) AS gap FROM c),
pg AS (SELECT * FROM g WHERE gap > 0),
fr AS (SELECT sel, min(experiment_id) AS experiment_id FROM pg GROUP BY sel),
modes AS (SELECT pg.sel, gap, count(*) AS cnt FROM pg JOIN fr USING (sel, experiment_id) GROUP BY pg.sel, gap),
best AS (SELECT sel, arg_min(gap, (-cnt, gap)) AS interval FROM modes GROUP BY sel)
SELECT s.sel, CAST(coalesce(best.interval, 250) AS BIGINT) AS interval
FROM (SELECT DISTINCT sel FROM c) s LEFT JOIN best USING (sel)""", ("dense",))
def q_step_interval(spark, d):
    c = dense_curves(spark, d).withColumn("sel", F.col("experiment_id") % 5)
    return curves.step_interval(c, scope=("sel",))


@register("reference_gap", CURVE_VIEW + """
SELECT dc.experiment_id, dc.step, dc.loss, round(r.ref_loss, 9) AS ref_loss, round(dc.loss - r.ref_loss, 9) AS gap
FROM dc JOIN ref_curve r USING (step)""", ("dense", "ref_curve"))
def q_reference_gap(spark, d):
    dn = fx.dense(spark, d)
    return nine_digits(curves.reference_gap(curves.loss_curve(dn), fx.ref_curve(dn)).select(
        "experiment_id", "step", "loss", "ref_loss", "gap"), "ref_loss", "gap")


@register("early_stop_screen", CURVE_VIEW + f""",
g AS (SELECT dc.experiment_id, dc.step, dc.loss - r.ref_loss AS gap FROM dc JOIN ref_curve r USING (step)
      WHERE dc.step < dc.total_steps),
f AS (SELECT *, step >= {SCREEN['catastrophic_steps']} AND gap > {SCREEN['catastrophic_margin']} AS cat,
             step >= {SCREEN['grace_steps']} AND gap > {SCREEN['margin']} AS bad FROM g),
i AS (SELECT *, sum(CASE WHEN NOT bad THEN 1 ELSE 0 END) OVER (PARTITION BY experiment_id ORDER BY step
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
s AS (SELECT *, CASE WHEN bad THEN row_number() OVER (PARTITION BY experiment_id, island, bad ORDER BY step)
                ELSE 0 END AS streak FROM i),
h AS (SELECT * FROM s WHERE cat OR streak >= {SCREEN['patience']})
SELECT experiment_id, min(step) AS step,
       arg_min(CASE WHEN cat THEN 'catastrophic_gap' ELSE 'patience_gap' END, step) AS reason,
       round(arg_min(gap, step), 9) AS gap, arg_min(streak, step) AS bad_points
FROM h GROUP BY experiment_id""", ("dense", "ref_curve"))
def q_early_stop_screen(spark, d):
    dn = fx.dense(spark, d)
    return nine_digits(curves.early_stop_screen(curves.loss_curve(dn), fx.ref_curve(dn), **SCREEN), "gap")


@register("target_reached", CURVE_VIEW + f"""
SELECT experiment_id, min(step) AS step FROM dc WHERE loss <= {TARGET} GROUP BY experiment_id""", ("dense",))
def q_target_reached(spark, d):
    return curves.target_reached(dense_curves(spark, d), TARGET)


@register("recent_metrics", """
SELECT experiment_id, step, rank FROM (
  SELECT experiment_id, step, row_number() OVER (PARTITION BY experiment_id ORDER BY step DESC) AS rank FROM dense)
WHERE rank <= 20""", ("dense",))
def q_recent_metrics(spark, d):
    return curves.recent_metrics(fx.dense(spark, d), 20).select("experiment_id", "step", "rank")


@register("event_retention", """
WITH cut AS (SELECT CASE WHEN count(*) >= 10000 THEN min(event_id) ELSE 0 END AS c
             FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 10000)),
now AS (SELECT max(ts) AS t FROM events)
SELECT event_id AS id, ts AS created_at FROM events, cut, now
WHERE event_id >= cut.c AND ts >= now.t - INTERVAL 7 DAY""")
def q_event_retention(spark, d):
    from quire.session import table
    feed = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    now = feed.agg(F.max("created_at")).first()[0]  # the clock of the feed (one scalar)
    return curves.event_retention(feed, F.lit(now), 10_000, 7)


def _stage_sql():
    names, durs, sched, ext = STAGES
    bounds = curves.stage_boundaries(durs, sched, ext)
    name, frac = f"'{names[-1]}'", "CAST(1.0 AS DOUBLE)"
    for i in range(len(bounds) - 1, -1, -1):
        st, en = bounds[i]
        name = f"CASE WHEN step < {en} THEN '{names[i]}' ELSE {name} END"
        frac = f"CASE WHEN step < {en} THEN CAST(step - {st} AS DOUBLE) / {en - st} ELSE {frac} END"
    return f"SELECT experiment_id, step, {name} AS stage, {frac} AS t FROM dense"


@register("stage_lookup", _stage_sql(), ("dense",))
def q_stage_lookup(spark, d):
    names, durs, sched, ext = STAGES
    return curves.stage_lookup(fx.dense(spark, d).select("experiment_id", "step"), names, durs, sched, ext)


@register("stage_join", """
WITH tot AS (SELECT experiment_id % 5 AS schedule, max(total_steps) AS total FROM dense GROUP BY 1),
st AS (SELECT schedule, total, k, total * k // 4 AS s, total * (k + 1) // 4 AS e FROM tot, (SELECT unnest(range(4)) AS k))
SELECT d.experiment_id, d.step, 's' || k AS stage,
       CASE WHEN d.step >= total THEN CAST(1 AS DOUBLE) ELSE CAST(d.step - s AS DOUBLE) / (e - s) END AS t
FROM dense d JOIN st ON st.schedule = d.experiment_id % 5 AND least(d.step, total - 1) >= s AND least(d.step, total - 1) < e""", ("dense",))
def q_stage_join(spark, d):
    """Five schedules of four stages, each as long as the longest of its runs."""
    dn = fx.dense(spark, d).select("experiment_id", "step", "total_steps", (F.col("experiment_id") % 5).alias("schedule"))
    k = F.col("k")
    stages = dn.groupBy("schedule").agg(F.max("total_steps").alias("n")).select(
        "schedule", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        "schedule", F.concat(F.lit("s"), k.cast("string")).alias("stage"),
        F.expr("n * k div 4").alias("start"), F.expr("n * (k + 1) div 4").alias("end"))
    return curves.stage_join(dn, stages).select("experiment_id", "step", "stage", "t")
