"""Registered queries: selection, grouping, paging, cards and tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quire.operators import groups
from quire.plans.registry import nine_digits, register
from quire.plans.telemetry import summaries
from quire.session import table
from quire.sources import fixtures as fx

GROUP_COLS = ["g_hash", "g_track", "gpus", "g_gpu_type"]
# request parameters of the registered queries
SEARCH = "a1"
SESSION = "s1"
GROUP_HASH = hashlib.md5(b"10").hexdigest()[:12]
PAGE = 25


@register("group_identity", "SELECT id, g_hash, g_track, gpus, g_gpu_type FROM groups", ("groups",))
def q_group_identity(spark, d):
    return groups.group_identity(fx.runs(spark, d)).select("id", *GROUP_COLS)


@register("list_runs", f"""
SELECT id, name, started_at FROM runs
WHERE coalesce(deleted, 0) = 0 AND status = 'completed'
  AND (name ILIKE '%{SEARCH}%' OR script ILIKE '%{SEARCH}%' OR track ILIKE '%{SEARCH}%'
       OR code_hash ILIKE '%{SEARCH}%')
ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 50""", ("runs",))
def q_list_runs(spark, d):
    return groups.list_runs(fx.runs(spark, d), status="completed", search=SEARCH, limit=50) \
        .select("id", "name", "started_at")


def id_request(spark, d):
    """An explicit id request from lineitem: position by (order, line), id =
    order key + line number (some ids are unknown), many duplicates."""
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
                     (F.col("l_orderkey") + F.col("l_linenumber")).alias("id"))


@register("select_ids", """
WITH req AS (SELECT l_orderkey * 8 + l_linenumber AS pos, l_orderkey + l_linenumber AS id FROM lineitem),
f AS (SELECT id, min(pos) AS pos FROM req GROUP BY id)
SELECT f.pos, f.id, EXISTS (SELECT 1 FROM runs r WHERE r.id = f.id AND coalesce(r.deleted, 0) = 0) AS found
FROM f""", ("runs",))
def q_select_ids(spark, d):
    return groups.select_ids(fx.runs(spark, d), id_request(spark, d))


@register("select_group", f"""
SELECT id, started_at FROM runs
WHERE coalesce(deleted, 0) = 0 AND code_hash = '{GROUP_HASH}' AND gpus = 1""", ("runs",))
def q_select_group(spark, d):
    return groups.select_group(fx.runs(spark, d), GROUP_HASH, gpus=1, with_gpus=True).select("id", "started_at")


@register("running_runs", f"""
SELECT id, session_name FROM runs
WHERE status = 'running' AND coalesce(deleted, 0) = 0
  AND (session_id = '{SESSION}' OR (session_id IS NULL AND session_name = '{SESSION}'))""", ("runs",))
def q_running_runs(spark, d):
    return groups.running_runs(fx.runs(spark, d), SESSION, SESSION).select("id", "session_name")


@register("filter_env", """
SELECT id FROM runs WHERE coalesce(env_lr, '') = '1' AND coalesce(env_wd, '') = ''""", ("runs",))
def q_filter_env(spark, d):
    return groups.filter_env(fx.runs(spark, d), {"LR": "1", "WD": ""}).select("id")


DISCOVER_SQL = """
WITH matched AS (SELECT * FROM groups WHERE coalesce(deleted, 0) = 0 AND status = 'completed'),
g AS (SELECT g_hash, g_track, gpus, g_gpu_type, max(started_at) AS max_started, max(id) AS max_id
      FROM matched GROUP BY ALL),
{cursor}
page AS (SELECT *, row_number() OVER (ORDER BY max_started DESC NULLS LAST, max_id DESC) AS group_rank
         FROM (SELECT * FROM g2 ORDER BY max_started DESC NULLS LAST, max_id DESC LIMIT {page}))
SELECT p.g_hash, p.g_track, p.gpus, p.g_gpu_type, p.group_rank, p.max_started AS page_started,
       p.max_id AS page_id, v.id, v.started_at
FROM page p JOIN groups v ON v.g_hash = p.g_hash AND v.g_track = p.g_track AND v.gpus = p.gpus
  AND v.g_gpu_type = p.g_gpu_type AND coalesce(v.deleted, 0) = 0"""

MEMBER_COLS = GROUP_COLS + ["group_rank", "page_started", "page_id", "id", "started_at"]


@register("discover_groups", DISCOVER_SQL.format(cursor="g2 AS (SELECT * FROM g),", page=PAGE),
          ("groups",))
def q_discover_groups(spark, d):
    members, _ = groups.discover_groups(fx.runs(spark, d), status="completed", limit=PAGE)
    return members.select(*MEMBER_COLS)


@register("discover_groups_page2", DISCOVER_SQL.format(cursor=f"""
c AS (SELECT max_started AS cs, max_id AS ci FROM g
      ORDER BY max_started DESC NULLS LAST, max_id DESC LIMIT 1 OFFSET {PAGE - 1}),
g2 AS (SELECT g.* FROM g, c WHERE g.max_started < c.cs OR (g.max_started = c.cs AND g.max_id < c.ci)),""",
                                                  page=PAGE), ("groups",))
def q_discover_groups_page2(spark, d):
    runs = fx.runs(spark, d)
    _, info = groups.discover_groups(runs, status="completed", limit=PAGE)
    nxt = info.first()  # one row: the keyset cursor of the next page
    cursor = (str(nxt["next_started"]) if nxt["next_started"] is not None else None, nxt["next_id"])
    members, _ = groups.discover_groups(runs, status="completed", cursor=cursor, limit=PAGE)
    return members.select(*MEMBER_COLS)


EXPAND_SQL = """
WITH live AS (SELECT * FROM groups WHERE coalesce(deleted, 0) = 0),
req AS (
  (SELECT id FROM live ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 1)
  UNION
  (SELECT id FROM live WHERE code_hash IS NULL ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 1)),
k AS (SELECT DISTINCT l.g_hash, l.g_track, l.gpus, l.g_gpu_type FROM live l JOIN req USING (id))
SELECT m.g_hash, m.g_track, m.gpus, m.g_gpu_type, m.id, m.started_at, m.id IN (SELECT id FROM req) AS requested
FROM k JOIN live m ON m.g_hash = k.g_hash AND m.g_track = k.g_track AND m.gpus = k.gpus
  AND m.g_gpu_type = k.g_gpu_type"""


@register("expand_group", EXPAND_SQL, ("groups",))
def q_expand_group(spark, d):
    runs = fx.runs(spark, d)
    live = runs.where(F.coalesce("deleted", F.lit(0)) == 0)
    newest = groups.newest_first()
    req = live.orderBy(*newest).limit(1).select("id").unionByName(
        live.where(F.col("code_hash").isNull()).orderBy(*newest).limit(1).select("id"))
    return groups.expand_group(runs, req)


@register("run_flags", """
SELECT r.id,
  EXISTS (SELECT 1 FROM crash_events c WHERE c.experiment_id = r.id) AS has_crash,
  EXISTS (SELECT 1 FROM metrics m WHERE m.experiment_id = r.id AND m.is_final_step) AS has_final
FROM runs r""", ("runs", "crash_events", "metrics"))
def q_run_flags(spark, d):
    from quire.plans.telemetry import merged
    runs = fx.runs(spark, d)
    return groups.run_flags(runs, fx.crash_events(runs), merged(spark, d))


@register("missing_crash", f"""
SELECT id FROM runs
WHERE id NOT IN (SELECT experiment_id FROM crash_events) AND status IN ('completed', 'failed')
  AND session_name = '{SESSION}'
ORDER BY id DESC LIMIT 5""", ("runs", "crash_events"))
def q_missing_crash(spark, d):
    runs = fx.runs(spark, d)
    return groups.missing_crash(runs, fx.crash_events(runs), SESSION, 5)


@register("tracks_by_recency", """
WITH t AS (SELECT DISTINCT track AS name FROM runs WHERE track IS NOT NULL),
rec AS (SELECT track, max(started_at) AS latest FROM runs
        WHERE coalesce(deleted, 0) = 0 AND track IS NOT NULL GROUP BY track)
SELECT t.name, rec.latest, row_number() OVER (ORDER BY rec.latest DESC NULLS LAST, t.name) AS position
FROM t LEFT JOIN rec ON rec.track = t.name""", ("runs",))
def q_tracks_by_recency(spark, d):
    runs = fx.runs(spark, d)
    return groups.tracks_by_recency(fx.tracks(runs), runs).select("name", "latest", "position")


CARDS_SQL = """
WITH s AS (SELECT *, concat_ws(';', 'LR=' || env_lr, 'WD=' || env_wd) AS env_key,
                  (started_at IS NOT NULL, started_at, id) AS newest FROM sgroups),
g AS (
  SELECT g_hash, g_track, gpus, g_gpu_type,
    arg_max({'id': id, 'name': name, 'script': script, 'status': status, 'started_at': started_at}, newest) AS rep,
    arg_max({'c': current_step, 't': total_steps}, newest) FILTER (WHERE current_step IS NOT NULL) AS prog,
    count(*) AS n_runs, bool_or(status = 'running') AS any_running, bool_or(status = 'completed') AS any_completed,
    round(avg(loss), 9) AS loss,
    avg(train_time_ms) AS train_time_ms,
    min(loss_metric) FILTER (WHERE loss IS NOT NULL) AS lm_min,
    max(loss_metric) FILTER (WHERE loss IS NOT NULL) AS lm_max,
    count(DISTINCT env_key) AS n_env, max(revision) AS revision, max(metrics_revision) AS metrics_revision
  FROM (SELECT *, latest_loss AS loss FROM s) GROUP BY ALL)
SELECT g_hash, g_track, gpus, g_gpu_type, rep.id AS id, rep.name AS name, rep.script AS script,
       rep.started_at AS started_at,
       CASE WHEN any_running THEN 'running' WHEN any_completed THEN 'completed' ELSE rep.status END AS status,
       n_runs, n_env > 1 AS is_sweep, prog.c AS current_step, prog.t AS total_steps, loss, loss AS val_loss,
       train_time_ms, CASE WHEN lm_min = lm_max THEN lm_min END AS loss_metric, revision, metrics_revision
FROM g"""


@register("group_cards", CARDS_SQL, ("sgroups",))
def q_group_cards(spark, d):
    return nine_digits(groups.group_cards(summaries(spark, d)), "loss", "val_loss")


@register("full_group_cards", """
SELECT g_hash, g_track, gpus, g_gpu_type, arg_max(coalesce(code_hash, ''), (started_at IS NOT NULL, started_at, id)) AS code_hash,
  concat_ws(';', arg_max(coalesce('LR=' || env_lr, ''), (started_at IS NOT NULL, started_at, id)),
                 arg_max(coalesce('WD=' || env_wd, ''), (started_at IS NOT NULL, started_at, id))) AS env_text,
  string_agg(CAST(id AS VARCHAR), ',' ORDER BY started_at DESC NULLS LAST, id DESC) AS ids_text,
  coalesce(string_agg(printf('%.6f', latest_loss), ',' ORDER BY started_at DESC NULLS LAST, id DESC), '') AS losses_text,
  coalesce(string_agg(CAST(train_time_ms AS VARCHAR), ',' ORDER BY started_at DESC NULLS LAST, id DESC), '') AS times_text,
  max(id) >= max(id) AS has_group
FROM sgroups GROUP BY g_hash, g_track, gpus, g_gpu_type""", ("sgroups",))
def q_full_group_cards(spark, d):
    c = groups.full_group_cards(summaries(spark, d))
    env = lambda k: F.coalesce(F.concat(F.lit(k + "="), F.col("env_vars")[k]), F.lit(""))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return c.select("g_hash", "g_track", "gpus", "g_gpu_type", F.coalesce("code_hash", F.lit("")).alias("code_hash"),
                    F.concat_ws(";", env("LR"), env("WD")).alias("env_text"), text("experiment_ids").alias("ids_text"),
                    F.array_join(F.transform("losses", lambda x: F.format_string("%.6f", x)), ",").alias("losses_text"),
                    text("train_times").alias("times_text"),
                    (F.col("group.id") == F.col("id")).alias("has_group"))


@register("group_members", """
SELECT g_hash, g_track, gpus, g_gpu_type, id, started_at FROM sgroups""", ("sgroups",))
def q_group_members(spark, d):
    return groups.group_members(summaries(spark, d))


@register("final_stats", """
SELECT g_hash, g_track, gpus, g_gpu_type, count(*) AS n_completed,
  round(avg(coalesce(final_loss, final_val_loss)), 9) AS mean_loss,
  min(coalesce(final_loss, final_val_loss)) AS min_loss, max(coalesce(final_loss, final_val_loss)) AS max_loss,
  avg(final_train_time_ms) AS mean_time_ms, min(final_train_time_ms) AS min_time_ms,
  max(final_train_time_ms) AS max_time_ms
FROM sgroups WHERE status = 'completed' GROUP BY ALL""", ("sgroups",))
def q_final_stats(spark, d):
    return nine_digits(groups.final_stats(summaries(spark, d)), "mean_loss")


@register("runs_table", """
SELECT id, coalesce(final_loss, final_val_loss, CAST('Infinity' AS DOUBLE)) AS sort_key,
  row_number() OVER (ORDER BY coalesce(final_loss, final_val_loss, CAST('Infinity' AS DOUBLE)),
                     started_at DESC NULLS LAST, id DESC) AS position
FROM summaries
ORDER BY position LIMIT 100""", ("summaries",))
def q_runs_table(spark, d):
    return groups.runs_table(summaries(spark, d), "val_loss", True, 100).select("id", "sort_key", "position")
