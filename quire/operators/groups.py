"""Run selection, grouping and paging.

A *group* is the set of live runs sharing (code hash, track, gpus, gpu type);
a run without a code hash is a group of its own.  Group aggregates are plain
hash aggregates (partial on the map side), so one huge group costs no more
than many small ones; member lists are rows, never arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import DEFAULT_GPU_TYPE, group_hash, live

GROUP_KEYS = ("g_hash", "g_track", "gpus", "g_gpu_type")


def group_identity(runs: DataFrame) -> DataFrame:
    """P10: add the four group key columns."""
    return runs.select(
        "*",
        group_hash().alias("g_hash"),
        F.coalesce(F.col("track"), F.lit("")).alias("g_track"),
        F.coalesce(F.col("gpu_type"), F.lit(DEFAULT_GPU_TYPE)).alias("g_gpu_type"),
    )


def _like_term(term: str) -> str:
    """A search term as a LIKE pattern: ``%`` and ``_`` stay wildcards, the
    backslash is literal (as in SQLite, whose LIKE has no escape by default)."""
    return "%" + term.replace("\\", "\\\\") + "%"


def search_predicate(term: str) -> Column:
    """Search across name, script, track and code hash; ASCII case ignored."""
    pat = _like_term(term)
    cols = ("name", "script", "track", "code_hash")
    pred = None
    for c in cols:
        p = F.coalesce(F.col(c).ilike(pat), F.lit(False))
        pred = p if pred is None else (pred | p)
    return pred


def newest_first() -> list[Column]:
    """Newest first; equal (or missing) start times broken by the higher id."""
    return [F.col("started_at").desc_nulls_last(), F.col("id").desc()]


MAX_GROUPS = 500


def list_runs(runs: DataFrame, track: str | None = None, status: str | None = None,
              search: str | None = None, limit: int = 50,
              session_name: str | None = None) -> DataFrame:
    """Live runs by equality filters and search, newest first, top ``limit``.

    The top-k is a ``TakeOrderedAndProject``: each task keeps its own best
    ``limit`` rows, the driver merges ``tasks x limit`` rows.
    """
    r = runs.where(live())
    if track:
        r = r.where(F.col("track") == track)
    if status:
        r = r.where(F.col("status") == status)
    if session_name:
        r = r.where(F.col("session_name") == session_name)
    if search:
        r = r.where(search_predicate(search))
    return r.orderBy(*newest_first()).limit(limit)


def select_ids(runs: DataFrame, requested: DataFrame) -> DataFrame:
    """Explicit ids -> (pos, id, found).

    ``requested`` (pos, id): non-positive ids are rejected, duplicates keep
    their first position.  ``found`` is false for unknown or deleted runs (the
    "missing ids" of the answer).  No size cap: the request is joined like any
    table, and broadcast only when Spark measures it under the threshold.
    """
    positive = F.when(F.col("id") > 0, F.col("id")).otherwise(
        F.raise_error(F.lit("ids must be positive")).cast("bigint"))  # when the plan runs
    first = requested.select("pos", positive.alias("id")).groupBy("id").agg(F.min("pos").alias("pos"))
    known = runs.where(live()).select("id", F.lit(True).alias("found"))
    return first.join(known, "id", "left").select(
        "pos", "id", F.coalesce("found", F.lit(False)).alias("found"))


def select_group(runs: DataFrame, code_hash: str, track: str | None = None,
                 gpus: int | None = None, gpu_type: str | None = None,
                 with_track: bool = False, with_gpus: bool = False,
                 with_gpu_type: bool = False) -> DataFrame:
    """Members of a group by code hash, optionally narrowed by track /
    gpus / gpu type (each filter applies only when asked for)."""
    r = runs.where(live() & (F.col("code_hash") == code_hash))
    if with_track:
        r = r.where(F.coalesce("track", F.lit("")) == (track or ""))
    if with_gpus:
        r = r.where(F.col("gpus") == gpus)
    if with_gpu_type:
        r = r.where(F.coalesce("gpu_type", F.lit(DEFAULT_GPU_TYPE)) == (gpu_type or DEFAULT_GPU_TYPE))
    return r


def running_runs(runs: DataFrame, session_name: str | None,
                 session_id: str | None = None) -> DataFrame:
    """Running, live runs of a session (by id, or legacy rows by name)."""
    r = runs.where((F.col("status") == "running") & live())
    if session_id:
        scope = (F.col("session_id") == session_id) | (
            F.col("session_id").isNull() & (F.col("session_name") == session_name))
    else:
        scope = F.col("session_name") == session_name
    return r.where(F.coalesce(scope, F.lit(False)))


def filter_env(runs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Every ``k=v`` holds as strings; a missing key reads as ''."""
    pred = F.lit(True)
    for k, v in wanted.items():
        pred = pred & (F.coalesce(F.col("env_vars")[k], F.lit("")) == str(v))
    return runs.where(pred)


def discover_groups(runs: DataFrame, track: str | None = None, status: str | None = None,
                    search: str | None = None, cursor: tuple | None = None,
                    limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """One page of groups, newest group first, with **all** live members.

    Groups are ranked by (max started_at, max id) over the runs matching the
    filters; a keyset ``cursor`` (started_at, id) continues after a page.  The
    page brings every live member of its groups, also members that fail the
    filters.  Returns (members, page_info) where page_info holds ``has_more``
    and the next cursor.
    """
    if not 1 <= int(limit) <= MAX_GROUPS:
        raise ValueError(f"a page holds 1 to {MAX_GROUPS} groups")
    limit = int(limit)
    vis = group_identity(runs.where(live()))
    m = vis
    if track:
        m = m.where(F.col("track") == track)
    if status:
        m = m.where(F.col("status") == status)
    if search:
        m = m.where(search_predicate(search))
    g = m.groupBy(*GROUP_KEYS).agg(F.max("started_at").alias("max_started"), F.max("id").alias("max_id"))
    if cursor is not None:
        c_started, c_id = cursor
        if c_started is None:  # encoded '' : no group sorts below it
            g = g.where(F.lit(False))
        else:
            cs = F.lit(c_started).cast("timestamp_ntz")
            g = g.where((F.col("max_started") < cs) | ((F.col("max_started") == cs) & (F.col("max_id") < c_id)))
    order = [F.col("max_started").desc_nulls_last(), F.col("max_id").desc()]
    look = g.orderBy(*order).limit(limit + 1)  # one look-ahead row tells "more"
    look = look.withColumn("group_rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # <= limit+1 rows
    page = look.where(F.col("group_rank") <= limit)
    members = page.join(vis, list(GROUP_KEYS), "inner").select(
        *GROUP_KEYS, "group_rank", F.col("max_started").alias("page_started"),
        F.col("max_id").alias("page_id"), "id", "started_at")
    at_limit = F.col("group_rank") == limit
    info = look.agg(
        (F.max("group_rank") > limit).alias("has_more"),
        F.max(F.when(at_limit, F.col("max_started"))).alias("next_started"),
        F.max(F.when(at_limit, F.col("max_id"))).alias("next_id"),
    ).select("has_more",
             F.when(F.col("has_more"), F.col("next_started")).alias("next_started"),
             F.when(F.col("has_more"), F.col("next_id")).alias("next_id"))
    return members, info


def expand_group(runs: DataFrame, requested: DataFrame) -> DataFrame:
    """The live members of every requested run's group, each group once.

    A run without a code hash matches only itself (the coalesced key does it).
    Output (group keys, id, started_at, requested): ``requested`` marks the
    members that were asked for, so a request finds its group by its own row
    and no request is paired with every member.
    """
    asked = requested.select("id").distinct().withColumn("requested", F.lit(True))
    g = group_identity(runs.where(live())).select(*GROUP_KEYS, "id", "started_at") \
        .join(asked, "id", "left").withColumn("requested", F.coalesce("requested", F.lit(False)))
    keys = g.where("requested").select(*GROUP_KEYS).distinct()
    return g.join(keys, list(GROUP_KEYS)).select(*GROUP_KEYS, "id", "started_at", "requested")


def run_flags(runs: DataFrame, crash_logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """has_crash and has_final per run (two semi-join flags)."""
    c = crash_logs.select(F.col("experiment_id").alias("id")).distinct().withColumn("has_crash", F.lit(True))
    f = (metrics.where(F.coalesce("is_final_step", F.lit(False)))
         .select(F.col("experiment_id").alias("id")).distinct().withColumn("has_final", F.lit(True)))
    return runs.select("id").join(c, "id", "left").join(f, "id", "left").select(
        "id", F.coalesce("has_crash", F.lit(False)).alias("has_crash"),
        F.coalesce("has_final", F.lit(False)).alias("has_final"))


def missing_crash(runs: DataFrame, crash_logs: DataFrame, session_name: str, n: int = 5) -> DataFrame:
    """Finished runs of a session without a crash log, highest ids, top ``n``."""
    r = runs.where(F.col("status").isin("completed", "failed") & (F.col("session_name") == session_name))
    r = r.join(crash_logs.select(F.col("experiment_id").alias("id")), "id", "left_anti")
    return r.select("id").orderBy(F.col("id").desc()).limit(n)


def tracks_by_recency(tracks: DataFrame, runs: DataFrame) -> DataFrame:
    """Tracks ordered by their newest live run; tracks without runs last."""
    rec = (runs.where(live() & F.col("track").isNotNull())
           .groupBy("track").agg(F.max("started_at").alias("latest")))
    t = tracks.join(rec, tracks["name"] == rec["track"], "left").drop("track")
    w = Window.orderBy(F.col("latest").desc_nulls_last(), F.col("name"))
    return t.withColumn("position", F.row_number().over(w).cast("bigint"))  # one row per track: tiny


def group_cards(summaries: DataFrame) -> DataFrame:
    """A3: one card per group of run summaries.

    Representative = newest member (started_at, id); status running >
    completed > the newest member's; loss and time are means over members that
    have one; ``loss_metric`` only when all members with a loss agree;
    ``is_sweep`` when members carry more than one distinct env; progress from
    the newest member that has any; max revisions.
    """
    s = group_identity(summaries)
    newest = F.struct(F.col("started_at").isNotNull(), F.col("started_at"), F.col("id"))
    env_key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(
        F.coalesce("env_vars", F.create_map().cast("map<string,string>"))))))
    rep = F.max_by(F.struct("id", "name", "track", "script", "code_hash", "status", "gpu_type",
                            "started_at"), newest)
    prog = F.max_by(F.struct("current_step", "total_steps"),
                    F.when(F.col("current_step").isNotNull(), newest))
    has_loss = F.col("loss").isNotNull()
    g = s.groupBy(*GROUP_KEYS).agg(
        rep.alias("rep"), prog.alias("prog"),
        F.count(F.lit(1)).alias("n_runs"),
        F.bool_or(F.col("status") == "running").alias("any_running"),
        F.bool_or(F.col("status") == "completed").alias("any_completed"),
        F.avg("loss").alias("loss"),
        F.avg("train_time_ms").alias("train_time_ms"),
        F.min(F.when(has_loss, F.col("loss_metric"))).alias("lm_min"),
        F.max(F.when(has_loss, F.col("loss_metric"))).alias("lm_max"),
        # more than one distinct env <=> min != max of its 64-bit hash: a plain
        # hash aggregate instead of a distinct-aggregate expansion (extra shuffle)
        F.min(F.xxhash64(env_key)).alias("_env_lo"), F.max(F.xxhash64(env_key)).alias("_env_hi"),
        F.max("revision").alias("revision"),
        F.max("metrics_revision").alias("metrics_revision"),
    )
    return g.select(
        *GROUP_KEYS,
        F.col("rep.id").alias("id"), F.col("rep.name").alias("name"),
        F.col("rep.script").alias("script"), F.col("rep.started_at").alias("started_at"),
        F.when(F.col("any_running"), "running").when(F.col("any_completed"), "completed")
         .otherwise(F.col("rep.status")).alias("status"),
        "n_runs", (F.col("_env_lo") != F.col("_env_hi")).alias("is_sweep"),
        F.col("prog.current_step").alias("current_step"), F.col("prog.total_steps").alias("total_steps"),
        "loss", F.col("loss").alias("val_loss"), "train_time_ms",
        F.when(F.col("lm_min") == F.col("lm_max"), F.col("lm_min")).alias("loss_metric"),
        "revision", "metrics_revision",
    )


def full_group_cards(summaries: DataFrame) -> DataFrame:
    """A3 whole: the cards with the newest member's ``track``, ``code_hash``, ``gpu_type`` and ``env_vars``,
    the ``group`` they stand for, and the members newest first: ``experiment_ids``, ``losses`` (also as
    ``val_losses``) and ``train_times``, each without the members that have none.

    The lists are the answer, as long as a group: one row of 24 bytes per member is combined map-side
    per partition.  Where groups may outgrow a row, take :func:`group_cards` and :func:`group_members`."""
    s = group_identity(summaries)
    newest = F.struct(F.col("started_at").isNotNull().alias("has"), F.col("started_at").alias("at"), F.col("id").alias("id"))
    rep = F.max_by(F.struct("track", "code_hash", "gpu_type", "env_vars"), newest)
    lists = s.groupBy(*GROUP_KEYS).agg(
        rep.alias("rep"), F.sort_array(F.collect_list(F.struct(newest.alias("at"), "loss", "train_time_ms")), asc=False).alias("_m"))
    present = lambda f: F.filter(F.transform("_m", lambda x: x[f]), lambda v: v.isNotNull())
    lists = lists.select(*GROUP_KEYS, "rep.*", F.transform("_m", lambda x: x["at"]["id"]).alias("experiment_ids"),
                         present("loss").alias("losses"), present("loss").alias("val_losses"), present("train_time_ms").alias("train_times"))
    group = F.struct(F.col("code_hash").alias("code_hash"), F.col("track").alias("track"), F.col("gpus").alias("gpus"),
                     F.col("g_gpu_type").alias("gpu_type"), F.col("id").alias("id"))
    return group_cards(summaries).join(lists, list(GROUP_KEYS)).withColumn("group", group)


def group_members(summaries: DataFrame) -> DataFrame:
    """Member rows of every group (group keys, id, started_at); sort by
    ``newest_first`` where an order is wanted."""
    return group_identity(summaries).select(*GROUP_KEYS, "id", "started_at")


def final_stats(summaries: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    """A4: over **completed** runs of each group: mean/min/max of the final loss
    (the latest loss when no final) and of the final train time."""
    s = group_identity(summaries).where(F.col("status") == "completed")
    fl = F.coalesce("final_loss", "final_val_loss")
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_completed"),
        F.avg(fl).alias("mean_loss"), F.min(fl).alias("min_loss"), F.max(fl).alias("max_loss"),
        F.avg("final_train_time_ms").alias("mean_time_ms"),
        F.min("final_train_time_ms").alias("min_time_ms"),
        F.max("final_train_time_ms").alias("max_time_ms"),
    )


def runs_table(summaries: DataFrame, sort_col: str = "val_loss", ascending: bool = True,
               limit: int = 100) -> DataFrame:
    """The runs table: sort by a column, missing loss/time last (as +inf),
    equal values in input order (newest first); top ``limit`` with position."""
    if sort_col == "val_loss":
        key = F.coalesce("final_loss", "final_val_loss", F.lit(float("inf")))
    elif sort_col == "time":
        key = F.coalesce(F.col("final_train_time_ms").cast("double"), F.lit(float("inf")))
    elif sort_col in ("status", "script"):
        key = F.coalesce(F.col(sort_col), F.lit(""))
    elif sort_col == "started_at":
        key = F.coalesce(F.col("started_at").cast("string"), F.lit(""))
    else:
        key = F.col(sort_col)
    k = key.asc() if ascending else key.desc()
    order = [k, F.col("started_at").desc_nulls_last(), F.col("id").desc()]
    top = summaries.withColumn("sort_key", key).orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(
        Window.orderBy(F.col("sort_key").asc() if ascending else F.col("sort_key").desc(),
                       F.col("started_at").desc_nulls_last(), F.col("id").desc())).cast("bigint"))
