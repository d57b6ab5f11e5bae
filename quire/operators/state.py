"""Keyed state folds over change feeds (X1-X3, X5, X6/K4, X8, X9, J7, J8, J16,
W14-W16, S6-S8).

Every fold is expressed as aggregates over (entity, arrival seq): last value
by ``max_by``, first by ``min_by``, change counts by ``lag`` in a window
partitioned by the entity.  No per-entity ``collect_list``: the status gate
has a closed form (below), so an entity with many arrivals costs a partial
aggregate, not a list in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import JOB_ID_ENV_KEY

# Statuses a remote observation may set.
TERMINAL = ("completed", "failed", "cancelled")
OBSERVED = TERMINAL + ("queued", "running", "unknown")

MAPPING_SCHEMA = (
    "experiment_id bigint, run_id string, script string, code_hash string, env_vars map<string,string>, "
    "gpus int, gpu_type string, tmux_window string, log_file string, started_at string, finished_at string, "
    "status string, track string, name string, git_commit string, parent_hash string, kernels_path string, "
    "dependencies map<string,string>, failure_phase string, crash_log string")
QUEUE_ITEM = ("struct<experiment_id:bigint,script:string,env_vars:map<string,string>,gpus:int,"
              "gpu_type:string,name:string,track:string,cmd_prefix:string>")
SNAPSHOT_SCHEMA = f"ts string, session string, queue array<{QUEUE_ITEM}>"


def status_gate(current: Column, observed: Column, has_final: Column) -> Column:
    """The status after one authoritative observation."""
    known = observed.isin(*OBSERVED)
    blocked = (current == "completed") & (observed != "completed") & has_final
    return F.when(known & ~blocked & observed.isNotNull(), observed).otherwise(current)


def parse_mappings(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON mapping lines -> records; invalid JSON and records without an
    experiment id are skipped (PERMISSIVE parse, then a filter)."""
    rec = F.from_json(F.col(line), MAPPING_SCHEMA, {"mode": "PERMISSIVE"})
    keep = [c for c in lines.columns if c != line]
    out = lines.select(*keep, rec.alias("m")).where(F.col("m.experiment_id").isNotNull()
                                                     & (F.col("m.experiment_id") != 0))
    return out.select(*keep, "m.*")


def script_stem(script: Column) -> Column:
    return F.regexp_extract(script, r"([^/]*?)(\.[^./]*)?$", 1)


META = ("code_hash", "tmux_window", "run_id", "started_at", "finished_at", "git_commit", "parent_hash",
        "kernels_path", "dependencies", "session")
#: Set when the run is created, never by a later record.
AT_CREATION = ("name", "script", "track", "env_vars", "gpus", "gpu_type")


def mapping_state(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Per-id partial state of the mapping fold -- mergeable aggregates only
    (first / last / min / count, each with the seq that orders it)."""
    known = F.col("status").isin(*OBSERVED)
    crash = (F.col("status") == "failed") & F.col("crash_log").isNotNull()
    s = F.col(seq)
    maps = ("env_vars", "dependencies")
    absent = {c: F.lit(None).cast("map<string,string>" if c in maps else "string")
              for c in (*META, *AT_CREATION) if c not in records.columns}
    records = records.withColumns(absent) if absent else records
    meta = []
    for c in META:
        meta += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), s)).alias(c),
                 F.max(F.when(F.col(c).isNotNull(), s)).alias(f"_{c}_seq")]
    return records.groupBy("experiment_id").agg(
        F.min_by(F.struct("status", *AT_CREATION), s).alias("_first"),
        F.min(s).alias("_first_seq"),
        F.max_by(F.col("status"), F.when(known, s)).alias("_last_known"),
        F.max(F.when(known, s)).alias("_last_known_seq"),
        F.max(F.when(known & ~F.col("status").isin(*TERMINAL), s)).alias("_last_open_seq"),
        F.min(F.when(F.col("status") == "completed", s)).alias("_first_completed_seq"),
        F.count(F.lit(1)).alias("n_records"),
        F.min_by(F.col("crash_log"), F.when(crash, s)).alias("crash_log"),
        F.min(F.when(crash, s)).alias("_crash_seq"),
        *meta)


def merge_mapping_state(states: DataFrame) -> DataFrame:
    """Combine partial states of the same ids (stored state + a new batch)."""
    meta = []
    for c in META:
        meta += [F.max_by(F.col(c), F.col(f"_{c}_seq")).alias(c), F.max(f"_{c}_seq").alias(f"_{c}_seq")]
    return states.groupBy("experiment_id").agg(
        F.min_by("_first", "_first_seq").alias("_first"), F.min("_first_seq").alias("_first_seq"),
        F.max_by("_last_known", "_last_known_seq").alias("_last_known"),
        F.max("_last_known_seq").alias("_last_known_seq"), F.max("_last_open_seq").alias("_last_open_seq"),
        F.min("_first_completed_seq").alias("_first_completed_seq"),
        F.sum("n_records").cast("bigint").alias("n_records"),
        F.min_by("crash_log", "_crash_seq").alias("crash_log"), F.min("_crash_seq").alias("_crash_seq"),
        *meta)


def infer_track(scripts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Track of each script path: the one whose directory is its nearest
    ancestor.  ``scripts``: script; ``tracks``: name, directory -> (script, track)."""
    parts = F.split("script", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = scripts.select("script").distinct().where(F.size(parts) > 1).select("script", F.explode(above).alias("directory"))
    found = up.join(tracks.select("directory", F.col("name").alias("track")), "directory")
    return found.groupBy("script").agg(F.max_by("track", F.length("directory")).alias("track"))


def finish_fold(g: DataFrame, has_final: DataFrame, existing: DataFrame | None = None,
                tracks: DataFrame | None = None) -> DataFrame:
    """Run rows from the mapping-fold state (see :func:`fold_mappings`).

    A stored run (``existing``: id, status and any of the creation columns and
    finished_at) keeps its name, script, track, env and GPUs; the feed changes
    its status and metadata only.  A change to a status that is not terminal
    clears the finish time; a record that carries one sets it again.  Without a
    track of its own a new run takes that of its script's nearest directory in
    ``tracks``."""
    g = g.join(has_final.select("experiment_id", F.lit(True).alias("_final")), "experiment_id", "left")
    stored = {}
    if existing is not None:
        kept = [c for c in (*AT_CREATION, "finished_at") if c in existing.columns]
        g = g.join(existing.select(F.col("id").alias("experiment_id"), F.col("status").alias("_existing"),
                                   *[F.col(c).alias(f"_old_{c}") for c in kept]), "experiment_id", "left")
        stored = {c: F.col(f"_old_{c}") for c in kept}
        initial = F.coalesce(F.col("_existing"), F.col("_first.status"), F.lit("running"))
        known = F.col("_existing").isNotNull()
        later = F.col("_last_known_seq") > F.when(known, F.lit(-(1 << 62))).otherwise(F.col("_first_seq"))
    else:
        initial, known = F.coalesce(F.col("_first.status"), F.lit("running")), F.lit(False)
        later = F.col("_last_known_seq") > F.col("_first_seq")
    plain = F.when(later, F.col("_last_known")).otherwise(initial)
    reached_completed = (initial == "completed") | F.col("_first_completed_seq").isNotNull()
    held = F.coalesce(F.col("_final"), F.lit(False)) & reached_completed  # completed, whatever is observed later
    status = F.when(held, F.lit("completed")).otherwise(plain)
    new = {"script": F.coalesce(F.col("_first.script"), F.lit("unknown")), "track": F.col("_first.track"),
           "env_vars": F.col("_first.env_vars"), "gpus": F.coalesce(F.col("_first.gpus"), F.lit(1)),
           "gpu_type": F.coalesce(F.col("_first.gpu_type"), F.lit("H100"))}
    new["name"] = F.coalesce(F.col("_first.name"), script_stem(new["script"]))
    if tracks is not None:
        inferred = infer_track(g.select(new["script"].alias("script")), tracks).select(
            F.col("script").alias("_script"), F.col("track").alias("_inferred"))
        g = g.join(inferred, new["script"] == F.col("_script"), "left")
        new["track"] = F.coalesce(new["track"], F.col("_inferred"))
    creation = {c: F.when(known, stored[c]).otherwise(new[c]) if c in stored else new[c] for c in AT_CREATION}
    cleared = ~held & (F.col("_last_open_seq") > F.coalesce(F.col("_finished_at_seq"), F.lit(-(1 << 62))))
    finished = F.coalesce(F.col("finished_at"), stored["finished_at"].cast("string")) if "finished_at" in stored \
        else F.col("finished_at")
    return g.select(
        "experiment_id", status.alias("status"), *[creation[c].alias(c) for c in AT_CREATION],
        "code_hash", "run_id", "started_at", F.when(~F.coalesce(cleared, F.lit(False)), finished).alias("finished_at"),
        "git_commit", "parent_hash", "kernels_path", "dependencies", "tmux_window", "session",
        F.col("n_records").cast("bigint").alias("n_records"), "crash_log")


def fold_mappings(records: DataFrame, has_final: DataFrame, existing: DataFrame | None = None,
                  seq: str = "seq", tracks: DataFrame | None = None) -> DataFrame:
    """Mapping records (session, seq order) -> run rows.

    A new id is created from its first record (status or 'running'; name = the
    record's name or the script stem).  Every later record with a known status
    applies it through the gate of :func:`status_gate`; non-null metadata
    fields overwrite (last non-null wins).  The first failed record carrying a
    crash log stores it.

    Closed form of the gated fold: the final status is the last known status
    observed after creation, except that 'completed' sticks once reached when
    the run has a final metric.  The state is made of mergeable aggregates, so
    the streaming form (E2) folds each micro-batch into the stored state.
    """
    return finish_fold(mapping_state(records, seq), has_final, existing, tracks)


def create_runs(existing: DataFrame, creates: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert runs by explicit id, ignoring ids already present (and
    repeats: the first create of an id wins)."""
    cols = [c for c in creates.columns if c not in ("id", seq)]
    first = creates.groupBy("id").agg(F.min_by(F.struct(*cols), F.col(seq)).alias("_r")).select("id", "_r.*")
    return first.join(existing.select("id"), "id", "left_anti")


def apply_status(runs: DataFrame, changes: DataFrame, seq: str = "seq", at: str = "at") -> DataFrame:
    """Status changes (id, seq, status, at) applied in order.

    A change is effective when the status differs from the current one (or a
    terminal status lacks its finish time, or any other still has one).
    Terminal -> finished_at = change time; running -> started_at kept or set,
    finished_at cleared; other -> finished_at cleared.  revision += effective
    changes.  Returns the runs with the new status, times and revision.
    """
    base = runs.select("id", F.col("status").alias("_s0"), F.col("finished_at").alias("_f0"))
    c = changes.join(base, "id")
    w = Window.partitionBy("id").orderBy(seq)
    first = F.row_number().over(w) == 1
    cur = F.when(first, F.col("_s0")).otherwise(F.lag("status").over(w))
    eff = (~F.col("status").eqNullSafe(cur)) | (
        first & (F.col("status").isin(*TERMINAL) == F.col("_f0").isNull()))
    c = c.withColumn("_eff", eff).drop("_s0", "_f0")
    e = c.where("_eff")
    agg = e.groupBy("id").agg(
        F.max_by(F.struct(F.col("status"), F.col(at)), F.col(seq)).alias("_last"),
        F.min(F.when(F.col("status") == "running", F.col(at))).alias("_first_running"),
        F.count(F.lit(1)).alias("_n"))
    j = runs.join(agg, "id", "left")
    has = F.col("_n").isNotNull()
    new_status = F.when(has, F.col("_last.status")).otherwise(F.col("status"))
    finished = F.when(~has, F.col("finished_at")).when(F.col("_last.status").isin(*TERMINAL), F.col("_last." + at))
    started = F.when(has & (F.col("_last.status") == "running"),
                     F.coalesce(F.col("started_at"), F.col("_first_running"))).otherwise(F.col("started_at"))
    return j.withColumn("status", new_status).withColumn("finished_at", finished) \
        .withColumn("started_at", started) \
        .withColumn("revision", F.col("revision") + F.coalesce(F.col("_n"), F.lit(0))) \
        .drop("_last", "_first_running", "_n")


def patch_runs(runs: DataFrame, patches: DataFrame, fields: list[str], seq: str = "seq") -> DataFrame:
    """Metadata patches (id, seq, fields...): non-null fields overwrite;
    revision +1 per patch that changed some field (null-safe compare to the
    state before it)."""
    base = runs.select("id", *fields).withColumn(seq, F.lit(-1).cast("bigint"))
    allp = base.unionByName(patches.select("id", seq, *fields))
    w = Window.partitionBy("id").orderBy(seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.last(f, ignorenulls=True).over(before)))
    allp = allp.withColumn("_chg", (F.col(seq) >= 0) & changed)
    agg = allp.groupBy("id").agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f)
                                   for f in fields], F.count_if("_chg").alias("_bumps"))
    keep = [c for c in runs.columns if c not in fields]
    return runs.select(*keep).join(agg, "id", "left").withColumn(
        "revision", F.col("revision") + F.coalesce("_bumps", F.lit(0))).drop("_bumps")


def crash_logs(events: DataFrame, mode: str = "ingest", seq: str = "seq") -> DataFrame:
    """One crash text per run: 'ingest' keeps the first arrival,
    'replace' the last explicit set.  Adds the tails shown by the tools
    (last 2,000 / 4,000 / 8,000 characters, P19)."""
    pick = F.min_by if mode == "ingest" else F.max_by
    g = events.groupBy("experiment_id").agg(pick(F.struct("content", "created_at"), F.col(seq)).alias("_c"))
    content = F.col("_c.content")
    return g.select("experiment_id", content.alias("content"), F.col("_c.created_at").alias("created_at"),
                    F.expr("right(_c.content, 2000)").alias("tail_2k"),
                    F.expr("right(_c.content, 4000)").alias("tail_4k"),
                    F.expr("right(_c.content, 8000)").alias("tail_8k"))


def parse_snapshots(lines: DataFrame, line: str = "line") -> DataFrame:
    """Queue snapshot / history lines -> (…, ts, session, queue); blank and bad
    lines skipped."""
    keep = [c for c in lines.columns if c != line]
    s = F.from_json(F.col(line), SNAPSHOT_SCHEMA, {"mode": "PERMISSIVE"})
    out = lines.where(F.trim(F.col(line)) != "").select(*keep, s.alias("s"))
    ok = F.col("s.ts").isNotNull() | F.col("s.queue").isNotNull() | F.col("s.session").isNotNull()
    return out.where(ok) \
        .select(*keep, "s.ts", F.coalesce("s.queue", F.array().cast(f"array<{QUEUE_ITEM}>")).alias("queue"),
                F.col("s.session").alias("line_session"))


def latest_queue(snapshot_lines: DataFrame, session: str = "session") -> DataFrame:
    """Per session, the last non-empty line of the highest segment; a line
    without ``ts`` is ignored (no snapshot for that session)."""
    ne = snapshot_lines.where(F.trim("line") != "")
    top = ne.groupBy(session).agg(F.max_by("line", F.struct("segment", "line_no")).alias("line"))
    p = parse_snapshots(top)
    return p.where(F.col("ts").isNotNull() & (F.col("ts") != "")).select(session, "ts", "queue")


def accepted_snapshot(snapshots: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """Last writer wins by ``ts``: strictly newer wins, an equal ts is a
    no-op (the first arrival stays).  Times are compared as instants (an offset
    counts; without one the session's zone), text that does not parse as text.

    With a ``connected`` column the flag is kept as well: an explicit value
    counts even on a stale snapshot, the last arrival wins, and a session that
    never said is connected.  ``session_id`` is carried along if present."""
    t = snapshots.where(F.col("ts").isNotNull() & (F.col("ts") != ""))
    at = F.col("ts").try_cast("timestamp")
    key = F.struct(at.alias("t"), F.when(at.isNull(), F.col("ts")).alias("text"), (-F.col(seq)).alias("first"))
    carried = ["ts", "queue", seq, *[c for c in ("session_id",) if c in snapshots.columns]]
    aggs = [F.max_by(F.struct(*carried), key).alias("_s")]
    if "connected" in snapshots.columns:
        said = F.max_by("connected", F.when(F.col("connected").isNotNull(), F.col(seq)))
        aggs.append(F.coalesce(said, F.lit(True)).alias("connected"))
    return t.groupBy(session).agg(*aggs).select(
        session, *[F.col(f"_s.{c}").alias(c) for c in carried], *(["connected"] if len(aggs) > 1 else []))


def queue_reconcile(runs: DataFrame, accepted: DataFrame, session_col: str = "session") -> DataFrame:
    """Project an accepted snapshot per session onto runs.

    Ids in the queue: unknown -> created as 'queued'; status 'unknown' ->
    'queued'; ids owned by another session -- another name, or another
    incarnation's ``session_id`` -- are ignored.  Queued runs of this
    incarnation (of this name, if they carry no session id) missing from the
    snapshot -> 'unknown'.  ``accepted`` without ``session_id`` stands for
    sessions whose id is their name.  Output (session, id, action, status)."""
    from quire.session import materialize
    if "session_id" not in accepted.columns:
        accepted = accepted.withColumn("session_id", F.col(session_col))
    accepted = materialize(accepted)  # one row per session, read by three branches
    items = accepted.select(session_col, F.col("session_id").alias("_sid"), F.posexplode("queue").alias("pos", "item")) \
        .select(session_col, "_sid", F.col("item.experiment_id").alias("id"), "item.name", "item.script") \
        .where(F.col("id") > 0)
    r = runs.select("id", F.col("status").alias("cur"), F.col("session_name").alias("owner"),
                    F.col("session_id").alias("owner_id"))
    j = items.join(r, "id", "left")
    same = lambda c, own: (F.coalesce(F.col(c), F.lit("")) == "") | (F.col(c) == F.col(own))
    conf = j.where(same("owner", session_col) & same("owner_id", "_sid"))
    created = conf.where(F.col("cur").isNull()).select(session_col, "id", F.lit("create").alias("action"),
                                                       F.lit("queued").alias("status"))
    requeued = conf.where(F.col("cur") == "unknown").select(session_col, "id", F.lit("requeue").alias("action"),
                                                            F.lit("queued").alias("status"))
    waiting = runs.where(F.col("status") == "queued").select("id", "session_name", F.col("session_id").alias("_sid"))
    ids = accepted.select(session_col, F.col("session_id").alias("_sid"))
    queued = waiting.join(ids, "_sid").select(session_col, "id").unionByName(
        waiting.where(F.col("_sid").isNull()).withColumnRenamed("session_name", session_col)
        .join(ids.select(session_col), session_col).select(session_col, "id"))
    gone = queued.join(conf.select(session_col, "id"), [session_col, "id"], "left_anti").select(
        session_col, "id", F.lit("lost").alias("action"), F.lit("unknown").alias("status"))
    return created.unionByName(requeued).unionByName(gone)


def queue_positions(accepted: DataFrame, session_col: str = "session") -> DataFrame:
    """(session, position 1-based, item...)."""
    return accepted.select(session_col, F.posexplode("queue").alias("pos", "item")).select(
        session_col, (F.col("pos") + 1).cast("bigint").alias("position"),
        F.col("item.experiment_id").alias("id"), F.col("item.name").alias("name"),
        F.col("item.script").alias("script"))


def queue_view(summaries: DataFrame, accepted: DataFrame, session_col: str = "session") -> DataFrame:
    """Running runs (with their summaries) followed by queued items with
    their 1-based position, per session."""
    running = summaries.where(F.col("status") == "running").select(
        F.col("session_name").alias(session_col), "id", "name", F.lit("running").alias("state"),
        F.lit(None).cast("bigint").alias("position"), "current_step", "loss")
    q = queue_positions(accepted, session_col).select(
        session_col, "id", "name", F.lit("queued").alias("state"), "position",
        F.lit(None).cast("bigint").alias("current_step"), F.lit(None).cast("double").alias("loss"))
    return running.unionByName(q)


def queue_history(lines: DataFrame, session: str | None = None, n: int = 20,
                  order: str = "file_pos") -> DataFrame:
    """History lines (file order) -> snapshots; optional session filter;
    a snapshot equal in (session, id list) to the **previous** entry (across
    sessions, in file order) is dropped; then the last ``n``.

    The previous entry is found without a global window: entries get a dense
    index by distributed prefix sums, then an equi join on ``index - 1``.
    """
    from quire.plans.prefix import prefix_sums
    p = parse_snapshots(lines).withColumn("session", F.col("line_session"))
    if session:
        p = p.where(F.col("session") == session)
    ids = F.transform("queue", lambda x: x["experiment_id"])
    p = p.withColumn("_key", F.struct(F.col("session"), ids.alias("ids")))
    from quire.session import materialize
    p = materialize(p)  # parsed entries feed the index, the lag join and the output
    idx = prefix_sums(p.select(F.lit(0).alias("_g"), order, F.lit(1).cast("bigint").alias("_one")),
                      ["_g"], [order], {"_one": "_idx"}).select(order, "_idx")
    p = p.join(idx, order)
    prev = p.select((F.col("_idx") + 1).alias("_idx"), F.col("_key").alias("_prev"))
    kept = p.join(prev, "_idx", "left").where(~F.col("_key").eqNullSafe(F.col("_prev")))
    return kept.orderBy(F.col(order).desc()).limit(n).drop("_key", "_prev", "_idx")


def recent_crashes(crashes: DataFrame, n: int = 20, session: str = "session_name") -> DataFrame:
    """The newest ``n`` crash notices per session with an unseen flag."""
    w = Window.partitionBy(session).orderBy(F.col("created_at").desc(), F.col("experiment_id").desc())
    return crashes.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def job_state_diff(runs: DataFrame, jobs: DataFrame, key: str = JOB_ID_ENV_KEY) -> DataFrame:
    """Runs carrying an external job id, left-joined to the job list's
    mapped state; a known state that differs from the run's is a transition."""
    r = runs.select("id", "status", F.col("env_vars")[key].alias("name")).where(F.col("name").isNotNull())
    j = r.join(jobs.select("name", F.col("state").alias("job_state")), "name", "left")
    diff = F.coalesce(F.col("job_state"), F.lit("")) != ""
    return j.where(diff & (F.col("job_state") != F.col("status"))).select(
        "id", F.col("status").alias("from_status"), F.col("job_state").alias("to_status"))
