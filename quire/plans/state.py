"""Registered queries: mapping feed, queue snapshots, state folds, crash logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.columns import JOB_ID_ENV_KEY
from quire.operators import state as st
from quire.plans.registry import register
from quire.plans.telemetry import merged, summaries
from quire.sources import fixtures as fx
from quire.sources import logs as txt

SNAP_SQL = """
WITH e AS (SELECT event_id, ts, event_type, 's' || CAST(user_id % 4 AS VARCHAR) AS session
           FROM events WHERE event_type IN ('signup', 'click')),
c AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clicks FROM e),
s AS (SELECT session, event_id, ts, clicks, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS rn
      FROM c WHERE event_type = 'signup'),
k AS (SELECT session, clicks AS click_rank, event_id AS click_id FROM c WHERE event_type = 'click'),
snaps AS (
  SELECT s.session, CAST((s.rn - 1) // 100 AS INTEGER) AS segment, CAST((s.rn - 1) % 100 AS BIGINT) AS line_no,
         s.ts, s.event_id AS snapshot_id,
         coalesce(list(k.click_id ORDER BY k.click_rank) FILTER (WHERE k.click_id IS NOT NULL), []) AS ids
  FROM s LEFT JOIN k ON k.session = s.session AND k.click_rank BETWEEN s.clicks - 2 AND s.clicks
  GROUP BY s.session, s.rn, s.ts, s.event_id)"""


def snapshots(spark, d):
    return fx.snapshots(spark, d)


def mapping_records(spark, d):
    dest = txt.landing_dir(spark, "mappings")
    lines = fx.mapping_lines(spark, d).withColumn("relpath", F.concat_ws("/", "session", "file"))
    txt.land_text(lines, dest).count()  # the sink runs here
    got = txt.scan_text_lines(spark, dest, "*.jsonl")
    session = F.regexp_extract("relpath", r"^([^/]+)/", 1)
    segment = F.when(F.col("relpath").endswith("/mappings.jsonl"), F.lit(-1)).otherwise(
        F.regexp_extract("relpath", r"mappings-(\d+)\.jsonl$", 1).cast("int"))
    # read order: legacy file, then segments by name, then lines
    seq = segment.cast("bigint") * (1 << 32) + F.col("line_no")
    return st.parse_mappings(got.select(session.alias("session"), seq.alias("seq"), "line"))


@register("scan_mappings", """
SELECT session_name AS session, id AS experiment_id, 'running' AS status FROM runs
UNION ALL SELECT session_name, id, status FROM runs WHERE status <> 'running'
UNION ALL SELECT session_name, id, 'failed' FROM runs WHERE status = 'completed' AND id % 11 = 0""", ("runs",))
def q_scan_mappings(spark, d):
    return mapping_records(spark, d).select("session", "experiment_id", "status")


@register("fold_mappings", """
WITH f AS (SELECT DISTINCT experiment_id FROM metrics WHERE is_final_step)
SELECT r.id AS experiment_id,
  CASE WHEN r.status = 'completed' AND r.id % 11 = 0 AND f.experiment_id IS NULL THEN 'failed' ELSE r.status END AS status,
  r.name, r.script,
  CAST(1 + CASE WHEN r.status <> 'running' THEN 1 ELSE 0 END
         + CASE WHEN r.status = 'completed' AND r.id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_records,
  CASE WHEN r.status = 'failed' AND r.id % 3 = 0 THEN 'Traceback (most recent call last): ' || r.name END AS crash_log
FROM runs r LEFT JOIN f ON f.experiment_id = r.id""", ("runs", "metrics"))
def q_fold_mappings(spark, d):
    rec = mapping_records(spark, d)
    fin = merged(spark, d).where("is_final_step").select("experiment_id").distinct()
    return st.fold_mappings(rec, fin).select("experiment_id", "status", "name", "script", "n_records", "crash_log")


def snapshot_files(spark, d):
    dest = txt.landing_dir(spark, "queue")
    lines = fx.snapshot_lines(snapshots(spark, d)).withColumn("relpath", F.concat_ws("/", "session", "file"))
    txt.land_text(lines, dest).count()
    got = txt.scan_text_lines(spark, dest, "*.jsonl")
    return got.select(F.regexp_extract("relpath", r"^([^/]+)/", 1).alias("session"),
                      F.regexp_extract("relpath", r"queue-(\d+)\.jsonl$", 1).cast("int").alias("segment"),
                      "line_no", "line")


IDS = lambda c: F.array_join(F.transform(c, lambda x: x["experiment_id"].cast("string")), ",")


@register("latest_queue", SNAP_SQL + """
SELECT session, CAST(len(ids) AS BIGINT) AS n_items, array_to_string(ids, ',') AS ids_text
FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY segment DESC, line_no DESC) AS r FROM snaps)
WHERE r = 1""")
def q_latest_queue(spark, d):
    lq = st.latest_queue(snapshot_files(spark, d))
    return lq.select("session", F.size("queue").cast("bigint").alias("n_items"), IDS(F.col("queue")).alias("ids_text"))


def history_lines(spark, d):
    """One history file: every snapshot with its session, in (ts, id) order."""
    s = fx.snapshot_lines(snapshots(spark, d))
    return s.select(F.col("snapshot_id").alias("file_pos"), "line")


@register("queue_history", SNAP_SQL + """,
h AS (SELECT snapshot_id AS file_pos, session, ids, ts FROM snaps),
o AS (SELECT *, row_number() OVER (ORDER BY ts, file_pos) AS ix FROM h),
d AS (SELECT o.*, lag(session) OVER (ORDER BY ix) AS ps, lag(ids) OVER (ORDER BY ix) AS pids FROM o)
SELECT file_pos, session, array_to_string(ids, ',') AS ids_text FROM d
WHERE NOT (ps IS NOT DISTINCT FROM session AND pids IS NOT DISTINCT FROM ids)
ORDER BY ts DESC, file_pos DESC LIMIT 50""")
def q_queue_history(spark, d):
    h = st.queue_history(history_lines(spark, d), n=50)
    return h.select("file_pos", "session", IDS(F.col("queue")).alias("ids_text"))


def reconcile_runs(spark, d):
    r = fx.runs(spark, d)
    st_ = (F.when((F.col("status") == "running") & (F.col("id") % 13 == 0), "queued")
           .when((F.col("status") == "running") & (F.col("id") % 17 == 0), "unknown").otherwise(F.col("status")))
    # every seventh run belongs to an older incarnation of its session, every fifth to none
    sid = F.when(F.col("id") % 5 == 0, F.lit(None).cast("string")).when(
        F.col("id") % 7 == 0, F.concat(F.col("session_name"), F.lit("-old"))).otherwise(F.concat("session_name", F.lit("-now")))
    return r.withColumn("status", st_).withColumn("session_id", sid)


def accepted(spark, d):
    s = snapshots(spark, d).withColumn("seq", F.col("snapshot_id"))
    # the same instants, written with offsets that a text order would get wrong
    at = F.col("ts").cast("timestamp_ntz")
    odd = F.date_format(at + F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    s = s.withColumn("ts", F.when(F.col("seq") % 2 == 1, F.concat(odd, F.lit("+05:00")))
                     .otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))))
    s = s.withColumn("session_id", F.concat("session", F.lit("-now"))) \
        .withColumn("connected", F.when(F.col("seq") % 3 == 0, F.col("seq") % 2 == 0))
    return st.accepted_snapshot(s)


ACCEPT_SQL = SNAP_SQL + """,
acc AS (SELECT session, arg_max(ids, (ts, -snapshot_id)) AS ids FROM snaps GROUP BY session),
items AS (SELECT session, unnest(ids) AS id FROM acc),
r2 AS (SELECT id, session_name, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN session_name || '-old'
                                     ELSE session_name || '-now' END AS sid, CASE WHEN status = 'running' AND id % 13 = 0 THEN 'queued'
                                     WHEN status = 'running' AND id % 17 = 0 THEN 'unknown' ELSE status END AS status
       FROM runs)"""


@register("queue_reconcile", ACCEPT_SQL + """,
conf AS (SELECT i.session, i.id, r.status AS cur FROM items i LEFT JOIN r2 r ON r.id = i.id
         WHERE i.id > 0 AND (r.session_name IS NULL OR r.session_name = i.session)
           AND (r.sid IS NULL OR r.sid = i.session || '-now'))
SELECT session, id, 'create' AS action, 'queued' AS status FROM conf WHERE cur IS NULL
UNION ALL SELECT session, id, 'requeue', 'queued' FROM conf WHERE cur = 'unknown'
UNION ALL
SELECT r.session_name, r.id, 'lost', 'unknown' FROM r2 r
WHERE r.status = 'queued' AND r.session_name IN (SELECT session FROM acc) AND (r.sid IS NULL OR r.sid = r.session_name || '-now')
  AND NOT EXISTS (SELECT 1 FROM conf c WHERE c.session = r.session_name AND c.id = r.id)""", ("runs",))
def q_queue_reconcile(spark, d):
    return st.queue_reconcile(reconcile_runs(spark, d), accepted(spark, d))


@register("queue_connected", SNAP_SQL + """
SELECT session, coalesce(arg_max(snapshot_id % 2 = 0, snapshot_id) FILTER (WHERE snapshot_id % 3 = 0), true) AS connected,
       arg_max(snapshot_id, (ts, -snapshot_id)) AS snapshot_id
FROM snaps GROUP BY session""")
def q_queue_connected(spark, d):
    return accepted(spark, d).select("session", "connected", F.col("seq").alias("snapshot_id"))


@register("queue_view", ACCEPT_SQL.replace(SNAP_SQL, SNAP_SQL + ",\nsm AS (SELECT * FROM summaries_full)", 1) + """,
pos AS (SELECT session, unnest(ids) AS id, generate_subscripts(ids, 1) AS position FROM acc)
SELECT session_name AS session, id, name, 'running' AS state, CAST(NULL AS BIGINT) AS position, current_step,
       latest_loss AS loss FROM sm WHERE status = 'running'
UNION ALL
SELECT session, id, 'queued-' || CAST(id AS VARCHAR), 'queued', CAST(position AS BIGINT), NULL, NULL FROM pos""",
          ("runs", "summaries_full"))
def q_queue_view(spark, d):
    return st.queue_view(summaries(spark, d), accepted(spark, d))


@register("recent_crashes", """
WITH c AS (SELECT e.experiment_id, e.created_at, r.session_name,
                  row_number() OVER (PARTITION BY r.session_name ORDER BY e.created_at DESC, e.experiment_id DESC) AS rank
           FROM crash_events e JOIN runs r ON r.id = e.experiment_id)
SELECT session_name, experiment_id, rank, false AS seen FROM c WHERE rank <= 20""", ("runs", "crash_events"))
def q_recent_crashes(spark, d):
    runs = fx.runs(spark, d)
    c = fx.crash_events(runs).join(runs.select(F.col("id").alias("experiment_id"), "session_name"), "experiment_id")
    return st.recent_crashes(c.withColumn("seen", F.lit(False)), 20).select(
        "session_name", "experiment_id", "rank", "seen")


@register("crash_logs", """
SELECT experiment_id, arg_min(content, seq) AS content, length(arg_min(content, seq)) AS n_chars,
       length(right(arg_min(content, seq), 2000)) AS tail_2k
FROM crash_events GROUP BY experiment_id""", ("crash_events",))
def q_crash_logs(spark, d):
    c = st.crash_logs(fx.crash_events(fx.runs(spark, d)), "ingest")
    return c.select("experiment_id", "content", F.length("content").cast("bigint").alias("n_chars"),
                    F.length("tail_2k").cast("bigint").alias("tail_2k"))


@register("crash_logs_replaced", """
SELECT experiment_id, arg_max(content, seq) AS content FROM crash_events GROUP BY experiment_id""", ("crash_events",))
def q_crash_logs_replaced(spark, d):
    return st.crash_logs(fx.crash_events(fx.runs(spark, d)), "replace").select("experiment_id", "content")


@register("job_state_diff", """
WITH j AS (SELECT 'user/job-' || CAST(o_orderkey AS VARCHAR) AS name,
                  ['queued','queued','running','completed','failed','cancelled','failed','failed','',''][o_orderkey % 10 + 1] AS state
           FROM orders WHERE o_orderkey % 7 <> 0),
r AS (SELECT id, status, 'user/job-' || CAST(id - 1 AS VARCHAR) AS name FROM runs WHERE id % 5 = 0)
SELECT r.id, r.status AS from_status, j.state AS to_status FROM r JOIN j USING (name)
WHERE j.state <> '' AND j.state <> r.status""", ("runs",))
def q_job_state_diff(spark, d):
    from quire.operators import logs
    from quire.plans.logs import jobs
    r = fx.runs(spark, d)
    r = r.withColumn("env_vars", F.when(F.col("id") % 5 == 0, F.map_concat(
        "env_vars", F.create_map(F.lit(JOB_ID_ENV_KEY), F.concat(F.lit("user/job-"), (F.col("id") - 1).cast("string"))))
    ).otherwise(F.col("env_vars")))
    return st.job_state_diff(r, logs.job_states(jobs(spark, d)))


@register("create_runs", """
SELECT id, name FROM runs WHERE id % 2 = 1""", ("runs",))
def q_create_runs(spark, d):
    r = fx.runs(spark, d)
    creates = r.select("id", "name", F.lit(1).alias("seq")).unionByName(
        r.where(F.col("id") % 3 == 0).select("id", F.lit("dup").alias("name"), F.lit(2).alias("seq")))
    return st.create_runs(r.where(F.col("id") % 2 == 0), creates).select("id", "name")


@register("apply_status", """
SELECT id, status, finished_at, started_at,
       CAST(revision + 1 + CASE WHEN status <> 'running' THEN 1 ELSE 0 END AS BIGINT) AS revision
FROM runs""", ("runs",))
def q_apply_status(spark, d):
    r = fx.runs(spark, d)
    init = r.withColumn("status", F.lit("queued")).withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    ch = r.select("id", F.lit(1).alias("seq"), F.lit("running").alias("status"), F.col("started_at").alias("at")) \
        .unionByName(r.where(F.col("status") != "running").select(
            "id", F.lit(2).alias("seq"), "status", F.col("finished_at").alias("at"))) \
        .unionByName(r.where((F.col("status") != "running") & (F.col("id") % 7 == 0)).select(
            "id", F.lit(3).alias("seq"), "status", (F.col("finished_at") + F.expr("INTERVAL 1 DAY")).alias("at")))
    out = st.apply_status(init, ch)
    return out.select("id", "status", "finished_at", "started_at", F.col("revision").cast("bigint").alias("revision"))


@register("status_gate", """
WITH f AS (SELECT DISTINCT experiment_id FROM metrics WHERE is_final_step)
SELECT r.id, CASE WHEN r.status = 'completed' AND f.experiment_id IS NULL THEN 'failed' ELSE r.status END AS status
FROM runs r LEFT JOIN f ON f.experiment_id = r.id""", ("runs", "metrics"))
def q_status_gate(spark, d):
    r = fx.runs(spark, d)
    fin = merged(spark, d).where("is_final_step").select(F.col("experiment_id").alias("id")).distinct() \
        .withColumn("has_final", F.lit(True))
    obs = F.when(F.col("status") == "completed", F.lit("failed")).otherwise(F.lit("bogus"))
    j = r.join(fin, "id", "left")
    return j.select("id", st.status_gate(F.col("status"), obs, F.coalesce("has_final", F.lit(False))).alias("status"))


@register("patch_runs", """
SELECT id, 'w' || CAST(id % 3 AS VARCHAR) AS tmux_window,
       CASE WHEN id % 2 = 0 THEN 'g' || CAST(id % 5 AS VARCHAR) END AS git_commit,
       CAST(revision + 1 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS revision
FROM runs""", ("runs",))
def q_patch_runs(spark, d):
    r = fx.runs(spark, d)
    tw = F.concat(F.lit("w"), (F.col("id") % 3).cast("string"))
    p = r.select("id", F.lit(1).cast("bigint").alias("seq"), tw.alias("tmux_window"),
                 F.lit(None).cast("string").alias("git_commit")) \
        .unionByName(r.where(F.col("id") % 2 == 0).select(
            "id", F.lit(2).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("tmux_window"),
            F.concat(F.lit("g"), (F.col("id") % 5).cast("string")).alias("git_commit"))) \
        .unionByName(r.select("id", F.lit(3).cast("bigint").alias("seq"), tw.alias("tmux_window"),
                              F.lit(None).cast("string").alias("git_commit")))
    out = st.patch_runs(r, p, ["tmux_window", "git_commit"])
    return out.select("id", "tmux_window", "git_commit", F.col("revision").cast("bigint").alias("revision"))
