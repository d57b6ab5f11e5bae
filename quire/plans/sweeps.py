"""Registered queries: sweep heatmaps and env-key comparisons per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import groups, sweeps
from quire.plans.registry import nine_digits, register
from quire.plans.telemetry import summaries

G = "g_hash, g_track, gpus, g_gpu_type"
SCOPE = ["g_hash", "g_track", "gpus", "g_gpu_type"]
PAT = sweeps.NUMERIC_PREFIX


def _env_sql(src: str) -> str:
    return f"""
SELECT {G}, id, started_at, 0 AS pos, 'LR' AS key, env_lr AS value FROM {src}
UNION ALL
SELECT {G}, id, started_at, 1 AS pos, 'WD' AS key, env_wd AS value FROM {src} WHERE env_wd IS NOT NULL"""


def grouped(spark, d):
    return groups.group_identity(summaries(spark, d))


HEATMAP_SQL = f"""
WITH comp AS (SELECT * FROM sgroups WHERE status = 'completed'),
env AS ({_env_sql('comp')}),
ks AS (SELECT {G}, key, max((started_at IS NOT NULL, started_at, id)) AS first_run,
              arg_max(pos, (started_at IS NOT NULL, started_at, id)) AS first_pos
       FROM env GROUP BY {G}, key HAVING count(DISTINCT value) > 1),
act AS (SELECT * FROM (SELECT {G}, key, row_number() OVER (PARTITION BY {G} ORDER BY first_run DESC, first_pos)
                         AS key_rank FROM ks) WHERE key_rank <= 2),
v0 AS (SELECT DISTINCT {G}, key, value FROM env JOIN act USING ({G}, key)),
v1 AS (SELECT *, TRY_CAST(nullif(regexp_extract(trim(value), '{PAT}', 0), '') AS DOUBLE) AS num FROM v0),
v2 AS (SELECT *, bool_and(num IS NOT NULL) OVER (PARTITION BY {G}, key) AS allnum FROM v1),
vals AS (SELECT v2.*, act.key_rank,
           row_number() OVER (PARTITION BY {G}, key ORDER BY CASE WHEN allnum THEN num END, value) - 1 AS idx
         FROM v2 JOIN act USING ({G}, key)),
xs AS (SELECT {G}, key AS x_key, value AS x_val, idx AS x_idx FROM vals WHERE key_rank = 1),
ys AS (SELECT {G}, key AS y_key, value AS y_val, idx AS y_idx FROM vals WHERE key_rank = 2),
dims AS (SELECT {G}, max(key_rank) AS dim FROM act GROUP BY {G}),
grid AS (
  SELECT xs.*, ys.y_key, ys.y_val, ys.y_idx FROM xs JOIN dims USING ({G}) JOIN ys USING ({G}) WHERE dims.dim = 2
  UNION ALL
  SELECT xs.*, NULL, NULL, NULL FROM xs JOIN dims USING ({G}) WHERE dims.dim = 1),
rv AS (SELECT {G}, id, max(CASE WHEN key_rank = 1 THEN value END) AS x_val,
              max(CASE WHEN key_rank = 2 THEN value END) AS y_val
       FROM env JOIN act USING ({G}, key) GROUP BY {G}, id),
cr AS (SELECT c.g_hash, c.g_track, c.gpus, c.g_gpu_type, c.id, c.started_at,
              coalesce(c.final_loss, c.final_val_loss) AS cell_loss, rv.x_val,
              CASE WHEN d.dim = 2 THEN rv.y_val END AS y_val
       FROM comp c JOIN rv USING ({G}, id) JOIN dims d USING ({G})
       WHERE rv.x_val IS NOT NULL AND (d.dim = 1 OR rv.y_val IS NOT NULL)),
cells AS (SELECT {G}, x_val, y_val,
            round(avg(cell_loss), 9) AS mean_loss,
            count(*) AS n_runs, arg_max(id, (started_at IS NOT NULL, started_at, id)) AS first_run
          FROM cr GROUP BY {G}, x_val, y_val),
bounds AS (SELECT {G}, min(coalesce(final_loss, final_val_loss)) AS min_loss,
                  max(coalesce(final_loss, final_val_loss)) AS max_loss
           FROM comp WHERE coalesce(final_loss, final_val_loss) IS NOT NULL GROUP BY {G}),
o AS (SELECT grid.*, cells.mean_loss, coalesce(cells.n_runs, 0) AS n_runs, cells.first_run, b.min_loss, b.max_loss
      FROM grid
      LEFT JOIN cells ON cells.g_hash = grid.g_hash AND cells.g_track = grid.g_track AND cells.gpus = grid.gpus
        AND cells.g_gpu_type = grid.g_gpu_type AND cells.x_val = grid.x_val
        AND cells.y_val IS NOT DISTINCT FROM grid.y_val
      JOIN bounds b ON b.g_hash = grid.g_hash AND b.g_track = grid.g_track AND b.gpus = grid.gpus
        AND b.g_gpu_type = grid.g_gpu_type)
SELECT *, (row_number() OVER (PARTITION BY {G} ORDER BY mean_loss ASC NULLS LAST, y_idx ASC NULLS FIRST, x_idx) = 1
           AND mean_loss IS NOT NULL) AS is_best
FROM o"""


@register("sweep_heatmap", HEATMAP_SQL, ("sgroups",))
def q_sweep_heatmap(spark, d):
    return nine_digits(sweeps.sweep_heatmap(grouped(spark, d), SCOPE), "mean_loss")


@register("partial_vars", f"""
WITH comp AS (SELECT * FROM sgroups WHERE status = 'completed'),
env AS ({_env_sql('comp')}),
n AS (SELECT {G}, count(*) AS n FROM comp GROUP BY {G}),
kc AS (SELECT {G}, key, count(*) AS c FROM env GROUP BY {G}, key)
SELECT {G}, key FROM kc JOIN n USING ({G}) WHERE n >= 2 AND c > 0 AND c < n""", ("sgroups",))
def q_partial_vars(spark, d):
    return sweeps.partial_vars(grouped(spark, d), SCOPE)


def script_defaults(runs):
    """Script defaults from run code hashes: WD defaults to '9' for hashes
    starting with a digit and is blank (no default) for hashes starting 'a'."""
    h = runs.where(F.col("code_hash").rlike("^[0-9a]")).select("code_hash").distinct()
    return h.select("code_hash", F.lit("WD").alias("key"),
                    F.when(F.col("code_hash").rlike("^[0-9]"), "9").otherwise("").alias("default"))


@register("fill_partial_vars", f"""
WITH comp AS (SELECT * FROM sgroups WHERE status = 'completed'),
cenv AS ({_env_sql('comp')}),
n AS (SELECT {G}, count(*) AS n FROM comp GROUP BY {G}),
kc AS (SELECT {G}, key, count(*) AS c FROM cenv GROUP BY {G}, key),
pv AS (SELECT {G}, key FROM kc JOIN n USING ({G}) WHERE n >= 2 AND c > 0 AND c < n),
aenv AS ({_env_sql('sgroups')}),
dflt AS (SELECT DISTINCT code_hash, 'WD' AS key, CASE WHEN regexp_matches(code_hash, '^[0-9]') THEN '9' ELSE '' END AS "default"
         FROM runs WHERE regexp_matches(code_hash, '^[0-9a]')),
need AS (SELECT s.g_hash, s.g_track, s.gpus, s.g_gpu_type, s.id, s.code_hash, pv.key
         FROM sgroups s JOIN pv USING ({G})
         WHERE NOT EXISTS (SELECT 1 FROM aenv a WHERE a.id = s.id AND a.key = pv.key))
SELECT {G}, id, key, CASE WHEN coalesce(dflt."default", '') <> '' THEN dflt."default" ELSE '(default)' END AS value
FROM need LEFT JOIN dflt USING (code_hash, key)""", ("sgroups", "runs"))
def q_fill_partial_vars(spark, d):
    g = grouped(spark, d)
    from quire.sources import fixtures as fx
    return sweeps.fill_partial_vars(g, script_defaults(fx.runs(spark, d)), SCOPE)


@register("differing_keys", f"""
WITH env AS ({_env_sql('sgroups')}),
n AS (SELECT {G}, count(*) AS n FROM sgroups GROUP BY {G}),
k AS (SELECT {G}, key, count(*) AS present, count(DISTINCT value) AS nv, bool_or(value = '') AS has_empty
      FROM env GROUP BY {G}, key)
SELECT {G}, key FROM k JOIN n USING ({G})
WHERE nv + CASE WHEN present < n AND NOT has_empty THEN 1 ELSE 0 END > 1""", ("sgroups",))
def q_differing_keys(spark, d):
    return sweeps.differing_keys(grouped(spark, d), SCOPE)
