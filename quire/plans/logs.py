"""Registered queries: log text -> metrics, run identity, outcomes, external history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import logs
from quire.plans.registry import register
from quire.session import table
from quire.sources import fixtures as fx
from quire.sources import logs as logsrc
from quire.sources.text_files import file_ends

# DuckDB text of the line grammar (same patterns as quire.operators.logs)
_NUM = r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
PARSE_SQL = rf"""
WITH p AS (
  SELECT run_id, line_no,
    TRY_CAST(nullif(regexp_extract(line, 'step:(\d+)/(\d+)', 1), '') AS BIGINT) AS step,
    TRY_CAST(nullif(regexp_extract(line, 'step:(\d+)/(\d+)', 2), '') AS BIGINT) AS total_steps,
    TRY_CAST(nullif(regexp_extract(line, 'val_loss:({_NUM})', 1), '') AS DOUBLE) AS val_loss,
    TRY_CAST(nullif(regexp_extract(line, 'train_loss:({_NUM})', 1), '') AS DOUBLE) AS train_loss,
    TRY_CAST(nullif(regexp_extract(line, 'train_time:({_NUM})(ms|s)', 1), '') AS DOUBLE) AS tt,
    regexp_extract(line, 'train_time:({_NUM})(ms|s)', 2) AS tt_unit,
    TRY_CAST(nullif(regexp_extract(line, 'step_avg:({_NUM})ms', 1), '') AS DOUBLE) AS step_avg_ms
  FROM log_lines)
SELECT r.id AS experiment_id, p.line_no AS seq, p.step, p.total_steps, p.val_loss, p.train_loss,
       CAST(trunc(CASE WHEN tt_unit = 's' THEN tt * 1000 ELSE tt END) AS BIGINT) AS train_time_ms,
       p.step_avg_ms, coalesce(p.step = p.total_steps, false) AS is_final_step
FROM p JOIN runs r ON CAST(r.id AS VARCHAR) = p.run_id
WHERE p.step IS NOT NULL AND p.total_steps IS NOT NULL
  AND (p.val_loss IS NOT NULL OR p.train_loss IS NOT NULL)"""

PARSED_COLUMNS = ["experiment_id", "seq", "step", "total_steps", "val_loss", "train_loss",
                  "train_time_ms", "step_avg_ms", "is_final_step"]


@register("parse_metrics", PARSE_SQL, ("log_lines", "runs"))
def q_parse_metrics(spark, d):
    parsed = logs.parse_metric_lines(fx.log_lines(spark, d))
    return logs.attach_runs(parsed, fx.runs(spark, d)).select(*PARSED_COLUMNS)


@register("scan_logs", "SELECT run_id, line_no, line FROM log_lines", ("log_lines",))
def q_scan_logs(spark, d):
    lines = fx.log_lines(spark, d)
    size = lines.agg(F.approx_count_distinct("run_id"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0))).first()  # two scalars
    land = lambda rows, dest: logsrc.land_log_files(rows, dest, deal=True)
    return logsrc.land_and_read(lines, "run_id", "logs", land, lambda dest: logsrc.scan_logs(spark, dest, dealt=True), *size,
                                staged=True)


def log_files(spark, d):
    """Output files: documents with a ``logs/<uuid>.txt`` marker at the start,
    the end, the middle, or nowhere (doc_id mod 4)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    h = F.md5(F.col("doc_id").cast("string"))
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                      F.substring(h, 17, 4), F.substring(h, 21, 12))
    marker = F.concat(F.lit("logs/"), uid, F.lit(".txt"))
    m4 = F.col("doc_id") % 4
    content = (F.when(m4 == 0, F.concat(marker, F.lit(" "), F.col("text")))
               .when(m4 == 1, F.concat(F.col("text"), F.lit(" "), marker))
               .when(m4 == 2, F.concat(F.expr("substring(text, 1, cast(char_length(text) / 2 as int))"), marker,
                                       F.expr("substring(text, cast(char_length(text) / 2 as int) + 1)")))
               .otherwise(F.col("text")))
    return docs.select("doc_id", content.alias("content"))


DETECT_SQL = r"""
WITH f AS (
  SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h, text FROM documents),
g AS (
  SELECT doc_id, text, 'logs/' || substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-'
         || substr(h,17,4) || '-' || substr(h,21,12) || '.txt' AS marker,
         substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-'
         || substr(h,21,12) AS uid
  FROM f),
c AS (
  SELECT doc_id, uid, marker,
    CASE doc_id % 4 WHEN 0 THEN marker || ' ' || text WHEN 1 THEN text || ' ' || marker
      WHEN 2 THEN substring(text, 1, CAST(trunc(length(text) / 2) AS BIGINT)) || marker
                  || substring(text, CAST(trunc(length(text) / 2) AS BIGINT) + 1)
      ELSE text END AS content
  FROM g),
b AS (
  SELECT doc_id, uid, content, strlen(content) AS n, instr(content, marker) AS pos,
         strlen(substring(content, 1, instr(content, marker) - 1)) AS b0
  FROM c)
SELECT doc_id, CASE WHEN pos > 0 AND (b0 + 45 <= 8192 OR b0 >= n - 8192) THEN uid END AS run_id
FROM b"""


@register("detect_run_id", DETECT_SQL)
def q_detect_run_id(spark, d):
    """The files are landed, and of each only its two ends are read."""
    n = logs.RUN_ID_WINDOW_BYTES
    dest = logsrc.landing_dir(spark, "outputs")
    logsrc.land_files(log_files(spark, d).withColumn("relpath", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))), dest).count()
    found = logs.detect_run_id_in_files(file_ends(spark, dest, n, n, "*.txt"))
    return found.select(F.regexp_extract("path", r"^(.*)\.txt$", 1).cast("bigint").alias("doc_id"), "run_id")


TAIL_SQL = f"""
WITH f AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS w, doc_id % 4 AS k,
         'step:' || (doc_id % 800 + 1) || '/875 val_loss:3.25' AS a, 'step:' || (doc_id % 70 + 801) || '/875 train_loss:1.5e-1' AS b
  FROM documents),
g AS (SELECT *, strlen(a) + 1 + 10 * w + 1 AS b0, strlen(a) + 1 + 10 * w + 1 + strlen(b) + 1 + 10 * k * w AS n FROM f)
SELECT doc_id, CASE WHEN b0 >= n - {logs.LOG_TAIL_BYTES} THEN doc_id % 70 + 801 ELSE doc_id % 800 + 1 END AS step,
       CAST(875 AS BIGINT) AS total_steps
FROM g WHERE b0 >= n - {logs.LOG_TAIL_BYTES} OR n <= {logs.LOG_TAIL_BYTES}"""


@register("last_metric_step_in_files", TAIL_SQL)
def q_last_metric_step_in_files(spark, d):
    """Logs with much text around two metric lines; in the long ones none, one or both are in the tail."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    a = F.concat(F.lit("step:"), (i % 800 + 1).cast("string"), F.lit("/875 val_loss:3.25\n"))
    b = F.concat(F.lit("\nstep:"), (i % 70 + 801).cast("string"), F.lit("/875 train_loss:1.5e-1\n"))
    content = F.concat(a, F.repeat(text, F.lit(10)), b, F.repeat(text, (10 * (i % 4)).cast("int")))
    docs = table(spark, d, "documents")
    files = docs.select(F.concat(i.cast("string"), F.lit(".txt")).alias("relpath"), content.alias("content"))
    nbytes = F.octet_length(a) + F.octet_length(b) + F.octet_length(text).cast("bigint") * (10 + 10 * (i % 4))
    size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(nbytes), F.lit(0))).first()  # two scalars
    read = lambda dest: logs.last_metric_step_in_files(file_ends(spark, dest, 0, logs.LOG_TAIL_BYTES, "*.txt"))
    found = logsrc.land_and_read(files, "relpath", "long-logs", logsrc.land_files, read, *size)
    return found.select(F.regexp_extract("path", r"^(.*)\.txt$", 1).cast("bigint").alias("doc_id"), "step", "total_steps")


OUTCOME_SQL = r"""
WITH l AS (
  SELECT run_id, arg_max(regexp_extract(line, 'step:(\d+)/(\d+)', 1), line_no) AS s,
         arg_max(regexp_extract(line, 'step:(\d+)/(\d+)', 2), line_no) AS t
  FROM log_lines WHERE regexp_matches(line, 'step:(\d+)/(\d+)') GROUP BY run_id)
SELECT r.id AS experiment_id, CAST(l.s AS BIGINT) AS last_step, CAST(l.t AS BIGINT) AS last_total,
       CASE WHEN CAST(l.s AS BIGINT) >= CAST(l.t AS BIGINT) THEN 'completed' ELSE 'failed' END AS outcome
FROM runs r LEFT JOIN l ON l.run_id = CAST(r.id AS VARCHAR)"""


@register("classify_outcome", OUTCOME_SQL, ("runs", "log_lines"))
def q_classify_outcome(spark, d):
    ll = fx.log_lines(spark, d)
    run_log = ll.where(F.col("run_id").cast("bigint") % 2 == 0)  # run logs exist for even ids only
    return logs.classify_outcome(fx.runs(spark, d), run_log, ll)


LAST_METRIC_SQL = r"""
SELECT run_id,
  CAST(regexp_extract(arg_max(line, line_no), 'step:(\d+)/(\d+)', 1) AS BIGINT) AS step,
  CAST(regexp_extract(arg_max(line, line_no), 'step:(\d+)/(\d+)', 2) AS BIGINT) AS total_steps
FROM log_lines
WHERE regexp_matches(line, 'step:(\d+)/(\d+)')
  AND regexp_matches(line, '(?:val_loss|train_loss):\d+(?:\.\d+)?(?:[eE][+-]?\d+)?')
GROUP BY run_id"""


@register("last_metric_step", LAST_METRIC_SQL, ("log_lines",))
def q_last_metric_step(spark, d):
    return logs.last_metric_step(fx.log_lines(spark, d))


def jobs(spark, d):
    """External job list from orders: 8 known states, an unknown one, empty;
    every 7th job is a child task; epoch 0 -> no creation time."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    states = F.array(*[F.lit(s) for s in list(logs.JOB_STATE_MAP) + ["JOB_STATE_UNKNOWN", ""]])
    name = F.concat(F.lit("user/job-"), k.cast("string"),
                    F.when(k % 7 == 0, F.lit("/task:reservation:")).otherwise(F.lit("")))
    return o.select(name.alias("name"), F.element_at(states, (k % 10 + 1).cast("int")).alias("state"),
                    F.when(k % 11 == 0, F.lit(0)).otherwise(F.lit(1700000000000) + k * 1000).alias("epoch_ms"))


JOBS_SQL = """
WITH j AS (
  SELECT 'user/job-' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 7 = 0 THEN '/task:reservation:' ELSE '' END AS name,
         ['JOB_STATE_PENDING','JOB_STATE_BUILDING','JOB_STATE_RUNNING','JOB_STATE_SUCCEEDED','JOB_STATE_FAILED',
          'JOB_STATE_KILLED','JOB_STATE_WORKER_FAILED','JOB_STATE_UNSCHEDULABLE','JOB_STATE_UNKNOWN',''][o_orderkey % 10 + 1] AS state,
         CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1700000000000 + o_orderkey * 1000 END AS epoch_ms
  FROM orders),
m AS (
  SELECT name, CASE state WHEN 'JOB_STATE_PENDING' THEN 'queued' WHEN 'JOB_STATE_BUILDING' THEN 'queued'
    WHEN 'JOB_STATE_RUNNING' THEN 'running' WHEN 'JOB_STATE_SUCCEEDED' THEN 'completed'
    WHEN 'JOB_STATE_FAILED' THEN 'failed' WHEN 'JOB_STATE_KILLED' THEN 'cancelled'
    WHEN 'JOB_STATE_WORKER_FAILED' THEN 'failed' WHEN 'JOB_STATE_UNSCHEDULABLE' THEN 'failed' ELSE '' END AS state,
    epoch_ms
  FROM j WHERE name <> '' AND NOT contains(split_part(name, '/', -1), ':'))
SELECT name, state, CASE WHEN epoch_ms <> 0 THEN epoch_ms(epoch_ms) END AS created_at,
       state IN ('queued', 'running') AS in_queue
FROM m"""


@register("job_states", JOBS_SQL)
def q_job_states(spark, d):
    return logs.job_states(jobs(spark, d))


def history_inputs(spark, d):
    dn = fx.dense(spark, d)
    step_txt = F.when(F.col("event_id") % 5 == 0, F.concat(F.col("step").cast("string"), F.lit(".0"))) \
        .otherwise(F.col("step").cast("string"))
    loss = lambda c: F.when(F.col("event_id") % 97 == 0, F.lit("nan")).otherwise(F.col(c).cast("string"))
    evals = dn.where(F.col("val_loss").isNotNull()).select(
        F.col("experiment_id").alias("run"), F.col("step").alias("idx"), step_txt.alias("_step"),
        loss("val_loss").alias("loss"), (F.col("step") * 0.37).alias("runtime"))
    trains = dn.where(F.col("train_loss").isNotNull()).select(
        F.col("experiment_id").alias("run"), F.col("step").alias("idx"), step_txt.alias("_step"),
        loss("train_loss").alias("loss"), (F.col("step_avg_ms") / 1000).alias("duration"))
    configs = dn.groupBy("experiment_id").agg(F.max("total_steps").alias("t")).select(
        F.col("experiment_id").alias("run"),
        F.when(F.col("experiment_id") % 3 == 0, F.col("t").cast("string")).alias("config_total"),
        F.when(F.col("experiment_id") % 3 == 1, (F.col("t") - 25).cast("string")).alias("summary_step"))
    return evals, trains, configs


HISTORY_SQL = """
WITH ev AS (
  SELECT experiment_id AS run, step, CAST(printf('%.6f', val_loss) AS DOUBLE) AS val_loss,
         CAST(trunc(step * CAST(0.37 AS DOUBLE) * 1000) AS BIGINT) AS train_time_ms, event_id
  FROM dense WHERE val_loss IS NOT NULL),
tr AS (
  SELECT experiment_id AS run, step, CAST(printf('%.6f', train_loss) AS DOUBLE) AS train_loss,
         round_even(step_avg_ms / 1000 * 1000, 0) AS step_avg_ms, event_id
  FROM dense WHERE train_loss IS NOT NULL),
steps AS (SELECT run, step FROM ev UNION ALL SELECT run, step FROM tr),
kept AS (SELECT run, step FROM ev WHERE event_id % 97 <> 0 UNION ALL SELECT run, step FROM tr WHERE event_id % 97 <> 0),
tot AS (
  SELECT s.run, coalesce(CASE WHEN s.run % 3 = 0 THEN c.t END, CASE WHEN s.run % 3 = 1 THEN c.t - 25 END,
                         max(s.step)) AS total_steps
  FROM steps s JOIN (SELECT experiment_id, max(total_steps) AS t FROM dense GROUP BY experiment_id) c
    ON c.experiment_id = s.run
  GROUP BY s.run, c.t)
SELECT k.run, k.step, t.total_steps, ev.val_loss, tr.train_loss, ev.train_time_ms, tr.step_avg_ms,
       k.step >= t.total_steps AS is_final_step
FROM (SELECT DISTINCT run, step FROM kept) k
JOIN tot t ON t.run = k.run
LEFT JOIN ev ON ev.run = k.run AND ev.step = k.step AND ev.event_id % 97 <> 0
LEFT JOIN tr ON tr.run = k.run AND tr.step = k.step AND tr.event_id % 97 <> 0
WHERE t.total_steps > 0"""


@register("external_history", HISTORY_SQL, ("dense",))
def q_external_history(spark, d):
    ev, tr, cf = history_inputs(spark, d)
    return logs.external_history(ev, tr, cf).select(
        "run", "step", "total_steps", "val_loss", "train_loss", "train_time_ms", "step_avg_ms",
        "is_final_step")
