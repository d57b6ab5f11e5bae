"""DuckDB text of the fixture views (same rules as :mod:`quire.sources.fixtures`).

Only the driver tables are registered in the oracle, so every oracle query is
``WITH <needed views> <body>``; :func:`with_views` resolves the dependencies.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "runs": ((), """
SELECT o_orderkey + 1 AS id,
       'run-' || CAST(o_orderkey + 1 AS VARCHAR) AS name,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS track,
       'experiments/t' || CAST(o_custkey % 5 AS VARCHAR) || '/c' || CAST(o_custkey AS VARCHAR) || '.py' AS script,
       CASE WHEN o_custkey % 7 <> 0 THEN substr(md5(CAST(o_custkey AS VARCHAR)), 1, 12) END AS code_hash,
       CASE WHEN o_custkey % 4 = 1 THEN substr(md5(CAST(o_custkey - 1 AS VARCHAR)), 1, 12) END AS parent_hash,
       CAST(o_orderkey % 3 AS VARCHAR) AS env_lr,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 2 AS VARCHAR) END AS env_wd,
       CAST(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 8 END AS INTEGER) AS gpus,
       CASE WHEN o_custkey % 3 = 1 THEN 'H100' WHEN o_custkey % 3 = 2 THEN 'A100' END AS gpu_type,
       CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running'
            ELSE 'failed' END AS status,
       1 + o_orderkey % 3 AS revision,
       o_orderkey % 2 AS metrics_revision,
       o_orderdate AS started_at,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY END AS finished_at,
       CASE WHEN o_orderkey % 50 = 0 THEN 1 END AS deleted,
       's' || CAST(o_custkey % 4 AS VARCHAR) AS session_name,
       's' || CAST(o_custkey % 4 AS VARCHAR) AS session_id
FROM orders"""),
    # (id, key, value) rows of env_vars
    "run_env": (("runs",), """
SELECT id, 'LR' AS key, env_lr AS value FROM runs
UNION ALL
SELECT id, 'WD' AS key, env_wd AS value FROM runs WHERE env_wd IS NOT NULL"""),
    "lineitem_metrics": ((), """
SELECT l_orderkey + 1 AS experiment_id,
       CAST(l_linenumber AS BIGINT) * 125 AS step,
       CAST(875 AS BIGINT) AS total_steps,
       CASE WHEN l_returnflag <> 'A' THEN l_extendedprice / 10000 END AS val_loss,
       CASE WHEN l_linestatus <> 'O' THEN l_extendedprice / 1000 END AS train_loss,
       CASE WHEN l_discount <> 0 THEN CAST(l_quantity * 1000 AS BIGINT) END AS train_time_ms,
       l_tax * 100 AS step_avg_ms,
       CAST(l_linenumber AS BIGINT) * 125 = 875 AS is_final_step,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_extendedprice,
                                    l_partkey, l_suppkey, l_linenumber) AS seq
FROM lineitem"""),
    "metric_lines": (("lineitem_metrics",), """
SELECT * FROM lineitem_metrics WHERE val_loss IS NOT NULL OR train_loss IS NOT NULL"""),
    "log_lines": (("lineitem_metrics",), """
SELECT CAST(experiment_id AS VARCHAR) AS run_id, seq AS line_no,
       concat_ws(' ',
         'step:' || CAST(step AS VARCHAR) || '/' || CAST(total_steps AS VARCHAR),
         CASE WHEN val_loss IS NOT NULL THEN 'val_loss:' || printf('%.6f', val_loss) END,
         CASE WHEN train_loss IS NOT NULL THEN 'train_loss:' || printf('%.6f', train_loss) END,
         CASE WHEN train_time_ms IS NOT NULL THEN 'train_time:' || CAST(train_time_ms AS VARCHAR) || 'ms' END,
         'step_avg:' || printf('%.6f', step_avg_ms) || 'ms') AS line
FROM lineitem_metrics"""),
    "dense_base": ((), """
SELECT user_id + 1 AS experiment_id,
       CAST(25 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step,
       CAST(25 * count(*) OVER (PARTITION BY user_id) AS BIGINT) AS total_steps,
       CASE WHEN event_type <> 'error' THEN value END AS val_loss,
       CASE WHEN event_type IN ('error', 'view') THEN value END AS train_loss,
       event_id, ts, event_type, user_id
FROM events"""),
    "dense": (("dense_base",), """
SELECT experiment_id, step, total_steps, val_loss, train_loss,
       CASE WHEN event_type <> 'purchase' THEN step * 40 + user_id END AS train_time_ms,
       CAST(step * 40 + user_id AS DOUBLE) / step AS step_avg_ms,
       step = total_steps AS is_final_step, event_id, ts
FROM dense_base"""),
    "ref_curve": (("dense",), """
SELECT step, avg(val_loss) AS ref_loss
FROM dense WHERE step % 125 = 0 AND val_loss IS NOT NULL GROUP BY step"""),
    "corpus": ((), """
SELECT source AS domain, doc_id, 0 AS source_idx,
       doc_id AS doc_pos, text, CAST(doc_id // 320 AS INTEGER) AS shard_idx
FROM documents"""),
    # one row per (document, word position) of the default tokenizer; pos 0 = BOS
    "corpus_words": (("corpus",), """
SELECT domain, doc_pos, doc_id, w.pos AS pos,
       CAST(('0x' || substr(md5(w.word), 1, 4))::INTEGER % 50256 AS INTEGER) AS token
FROM corpus,
     LATERAL (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS word,
                     generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'), 1) AS pos) w"""),
    "doc_lengths": (("corpus",), """
SELECT c.domain, c.doc_pos, c.doc_id,
       CAST(1 + coalesce(len(regexp_extract_all(coalesce(c.text, ''), '[^ \t\n\r]+')), 0) AS BIGINT) AS n_tokens
FROM corpus c WHERE length(coalesce(c.text, '')) > 0"""),
    # W1 merge of metric_lines (struct wrapper: arg_max skips NULL args)
    "metrics": (("metric_lines",), """
SELECT experiment_id, step,
       arg_max(total_steps, seq) FILTER (WHERE total_steps IS NOT NULL) AS total_steps,
       arg_max(val_loss, seq) FILTER (WHERE val_loss IS NOT NULL) AS val_loss,
       arg_max(train_loss, seq) FILTER (WHERE train_loss IS NOT NULL) AS train_loss,
       arg_max(train_time_ms, seq) FILTER (WHERE train_time_ms IS NOT NULL) AS train_time_ms,
       arg_max(step_avg_ms, seq) FILTER (WHERE step_avg_ms IS NOT NULL) AS step_avg_ms,
       coalesce(bool_or(is_final_step), false) AS is_final_step,
       count(*) AS arrivals
FROM metric_lines GROUP BY experiment_id, step"""),
    # A2 run summaries (live runs), the summary columns plus carried run columns
    "summaries_full": (("runs", "metrics"), """
WITH agg AS (
  SELECT experiment_id,
    arg_max({'step': step, 'total': total_steps}, step) AS progress,
    arg_max({'step': step, 'loss': val_loss, 't': train_time_ms, 'avg': step_avg_ms}, step)
      FILTER (WHERE val_loss IS NOT NULL) AS lv,
    arg_max({'step': step, 'loss': train_loss, 't': train_time_ms, 'avg': step_avg_ms}, step)
      FILTER (WHERE train_loss IS NOT NULL) AS lt,
    arg_max({'step': step, 'loss': val_loss, 't': train_time_ms}, step)
      FILTER (WHERE is_final_step AND val_loss IS NOT NULL) AS fv,
    arg_max({'step': step, 'loss': train_loss, 't': train_time_ms}, step)
      FILTER (WHERE is_final_step AND train_loss IS NOT NULL) AS ft
  FROM metrics GROUP BY experiment_id),
s AS (
  SELECT r.*, a.progress.step AS current_step, a.progress.total AS total_steps,
    a.lv.loss AS val_loss, a.lt.loss AS train_loss,
    CASE WHEN a.lv IS NOT NULL THEN a.lv.loss WHEN a.lt IS NOT NULL THEN a.lt.loss END AS latest_loss,
    CASE WHEN a.lv IS NOT NULL THEN a.lv.step WHEN a.lt IS NOT NULL THEN a.lt.step END AS latest_loss_step,
    CASE WHEN a.lv IS NOT NULL THEN 'val_loss' WHEN a.lt IS NOT NULL THEN 'train_loss' END AS loss_metric,
    concat_ws(',', CASE WHEN a.lv IS NOT NULL THEN 'val_loss' END,
                   CASE WHEN a.lt IS NOT NULL THEN 'train_loss' END) AS available_loss_metrics,
    CASE WHEN a.lv IS NOT NULL THEN a.lv.t WHEN a.lt IS NOT NULL THEN a.lt.t END AS train_time_ms,
    CASE WHEN a.lv IS NOT NULL THEN a.lv.avg WHEN a.lt IS NOT NULL THEN a.lt.avg END AS step_avg_ms,
    CASE WHEN a.lv IS NOT NULL THEN a.fv.loss WHEN a.lt IS NOT NULL THEN a.ft.loss END AS final_loss,
    CASE WHEN a.lv IS NOT NULL THEN a.fv.step WHEN a.lt IS NOT NULL THEN a.ft.step END AS final_loss_step,
    CASE WHEN a.lv IS NOT NULL THEN a.fv.t WHEN a.lt IS NOT NULL THEN a.ft.t END AS final_time
  FROM runs r LEFT JOIN agg a ON a.experiment_id = r.id
  WHERE coalesce(r.deleted, 0) = 0)
SELECT id, name, track, status, gpus, coalesce(nullif(gpu_type, ''), 'H100') AS gpu_type,
       CAST(revision AS BIGINT) AS revision, CAST(metrics_revision AS BIGINT) AS metrics_revision,
       started_at, current_step, total_steps, val_loss, train_loss, latest_loss, latest_loss_step,
       loss_metric, available_loss_metrics, train_time_ms, step_avg_ms, final_loss, final_loss_step,
       latest_loss AS final_val_loss,
       CASE WHEN final_loss IS NOT NULL THEN final_time ELSE train_time_ms END AS final_train_time_ms,
       script, code_hash, parent_hash, session_name, session_id, env_lr, env_wd, gpu_type AS raw_gpu_type
FROM s"""),
    "summaries": (("summaries_full",), """
SELECT id, name, track, status, gpus, gpu_type, revision, metrics_revision, started_at, current_step,
       total_steps, val_loss, train_loss, latest_loss, latest_loss_step, loss_metric, available_loss_metrics,
       train_time_ms, step_avg_ms, final_loss, final_loss_step, final_val_loss, final_train_time_ms
FROM summaries_full"""),
    "crash_events": (("runs",), """
SELECT id AS experiment_id, 'Traceback: ' || name || ' A' AS content, CAST(1 AS BIGINT) AS seq, started_at AS created_at
FROM runs WHERE status = 'failed' AND id % 3 = 0
UNION ALL
SELECT id, 'Traceback: ' || name || ' B', CAST(2 AS BIGINT), finished_at
FROM runs WHERE status = 'failed' AND id % 9 = 0"""),
    "groups": (("runs",), """
SELECT *, coalesce(code_hash, '_no_hash_' || CAST(id AS VARCHAR)) AS g_hash, coalesce(track, '') AS g_track,
       coalesce(gpu_type, 'H100') AS g_gpu_type
FROM runs"""),
    "sgroups": (("summaries_full",), """
SELECT *, coalesce(code_hash, '_no_hash_' || CAST(id AS VARCHAR)) AS g_hash, coalesce(track, '') AS g_track,
       coalesce(raw_gpu_type, 'H100') AS g_gpu_type
FROM summaries_full"""),
    # P1 over the printed log lines (DuckDB regex parse), see quire.plans.logs
    "parsed_metrics": (("log_lines", "runs"), None),
}


def _body(name: str) -> str:
    text = VIEWS[name][1]
    if text is None and name == "parsed_metrics":
        from quire.plans.logs import PARSE_SQL
        text = PARSE_SQL
    return text


def with_views(body: str, *names: str) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = VIEWS[n]
        for dep in deps:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({_body(n).strip()})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
