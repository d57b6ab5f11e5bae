"""Views of the driver's tables in the shapes the operators consume.

Each function reads the driver parquet tables and derives one input shape
(runs, metric lines, log lines, dense curves, queue snapshots, corpus, ...).
Every derivation is a narrow projection or a *partitioned* window, so it scales
with the tables; nothing here needs a global sort.  The DuckDB text of the same
views lives in :mod:`quire.sources.fixture_sql`, kept rule for rule in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.plans.prefix import prefix_sums
from quire.session import materialize, table

# Fixed values of the fixture rules.
TOTAL_STEPS = 875
STEP_UNIT = 125
DENSE_STEP_UNIT = 25
CORPUS_SHARD_IDS = 320
TRACK_DESCRIPTION = "fixture track"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs (experiments) from ``orders``."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    env = F.map_from_entries(F.filter(
        F.array(
            F.struct(F.lit("LR").alias("key"), (k % 3).cast("string").alias("value")),
            F.struct(F.lit("WD").alias("key"),
                     F.when(k % 5 != 0, (k % 2).cast("string")).alias("value")),
        ),
        lambda e: e["value"].isNotNull()))
    return o.select(
        (k + 1).alias("id"),
        F.concat(F.lit("run-"), (k + 1).cast("string")).alias("name"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("track"),
        F.concat(F.lit("experiments/t"), (c % 5).cast("string"), F.lit("/c"),
                 c.cast("string"), F.lit(".py")).alias("script"),
        F.when(c % 7 != 0, F.substring(F.md5(c.cast("string")), 1, 12)).alias("code_hash"),
        F.when(c % 4 == 1, F.substring(F.md5((c - 1).cast("string")), 1, 12)).alias("parent_hash"),
        F.lit(None).cast("string").alias("git_commit"),
        env.alias("env_vars"),
        F.when(c % 2 == 0, 1).otherwise(8).cast("int").alias("gpus"),
        F.when(c % 3 == 1, "H100").when(c % 3 == 2, "A100").alias("gpu_type"),
        F.lit(None).cast("int").alias("run_number"),
        F.lit(None).cast("string").alias("tmux_window"),
        F.lit(None).cast("string").alias("remote_run_id"),
        F.when(F.col("o_orderstatus") == "F", "completed")
         .when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        (1 + k % 3).alias("revision"),
        (k % 2).alias("metrics_revision"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") != "O",
               F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("finished_at"),
        F.when(k % 50 == 0, 1).cast("int").alias("deleted"),
        F.lit(None).cast("string").alias("kernels_path"),
        F.create_map().cast("map<string,string>").alias("dependencies"),
        F.concat(F.lit("s"), (c % 4).cast("string")).alias("session_name"),
        F.concat(F.lit("s"), (c % 4).cast("string")).alias("session_id"),
        F.lit(None).cast("string").alias("queue_command"),
    )


def _lineitem_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every lineitem as one printed metric line, before the no-loss drop."""
    li = table(spark, d, "lineitem")
    step = F.col("l_linenumber").cast("bigint") * STEP_UNIT
    # Arrival order within a run's log.  Metric merges compare arrivals of the
    # same run only, so the order is a window partitioned by the run.
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")
    return li.select(
        (F.col("l_orderkey") + 1).alias("experiment_id"),
        step.alias("step"),
        F.lit(TOTAL_STEPS).cast("bigint").alias("total_steps"),
        F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice") / 10000).alias("val_loss"),
        F.when(F.col("l_linestatus") != "O", F.col("l_extendedprice") / 1000).alias("train_loss"),
        F.when(F.col("l_discount") != 0, (F.col("l_quantity") * 1000).cast("bigint")).alias("train_time_ms"),
        (F.col("l_tax") * 100).alias("step_avg_ms"),
        (step == TOTAL_STEPS).alias("is_final_step"),
        F.row_number().over(w).cast("bigint").alias("seq"),
    )


def metric_lines(spark: SparkSession, d: str) -> DataFrame:
    """Metric rows with arrival order ``seq``; lines without a loss dropped."""
    m = _lineitem_metrics(spark, d)
    return m.where(F.col("val_loss").isNotNull() | F.col("train_loss").isNotNull())


def _fmt_num(c) -> F.Column:
    return F.format_string("%.6f", c)


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, line_no, line): each lineitem printed as a training log line.

    Lines without a loss stay in the log as timing-only lines, so the parser's
    "no loss, no row" rule is exercised.
    """
    m = _lineitem_metrics(spark, d)
    parts = F.concat_ws(
        " ",
        F.concat(F.lit("step:"), F.col("step").cast("string"), F.lit("/"), F.col("total_steps").cast("string")),
        F.when(F.col("val_loss").isNotNull(), F.concat(F.lit("val_loss:"), _fmt_num(F.col("val_loss")))),
        F.when(F.col("train_loss").isNotNull(), F.concat(F.lit("train_loss:"), _fmt_num(F.col("train_loss")))),
        F.when(F.col("train_time_ms").isNotNull(),
               F.concat(F.lit("train_time:"), F.col("train_time_ms").cast("string"), F.lit("ms"))),
        F.concat(F.lit("step_avg:"), _fmt_num(F.col("step_avg_ms")), F.lit("ms")),
    )
    return m.select(F.col("experiment_id").cast("string").alias("run_id"),
                    F.col("seq").alias("line_no"), parts.alias("line"))


def dense(spark: SparkSession, d: str) -> DataFrame:
    """Dense loss curves from ``events``: one run per user, one point per event."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = (F.row_number().over(w) * DENSE_STEP_UNIT).cast("bigint")
    total = (F.count(F.lit(1)).over(Window.partitionBy("user_id")) * DENSE_STEP_UNIT).cast("bigint")
    base = e.select(
        (F.col("user_id") + 1).alias("experiment_id"),
        step.alias("step"), total.alias("total_steps"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("val_loss"),
        F.when(F.col("event_type").isin("error", "view"), F.col("value")).alias("train_loss"),
        "event_id", "ts", "event_type", "user_id",
    )
    t = F.col("step") * 40 + F.col("user_id")
    return base.select(
        "experiment_id", "step", "total_steps", "val_loss", "train_loss",
        F.when(F.col("event_type") != "purchase", t).alias("train_time_ms"),
        (t.cast("double") / F.col("step")).alias("step_avg_ms"),
        (F.col("step") == F.col("total_steps")).alias("is_final_step"),
        "event_id", "ts",
    )


def ref_curve(dense_df: DataFrame) -> DataFrame:
    """Reference curve: mean val_loss over all runs at steps divisible by 125."""
    return (dense_df.where((F.col("step") % 125 == 0) & F.col("val_loss").isNotNull())
            .groupBy("step").agg(F.avg("val_loss").alias("ref_loss")))


def tracks(runs_df: DataFrame) -> DataFrame:
    return (runs_df.where(F.col("track").isNotNull()).select(F.col("track").alias("name")).distinct()
            .select("name", F.concat(F.lit("tracks/"), F.lower(F.regexp_replace("name", "[^A-Za-z0-9]+", "_"))).alias("directory"),
                    F.lit(TRACK_DESCRIPTION).alias("description")))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a blend corpus: domain = source, order = doc_id, one corpus
    shard per ``CORPUS_SHARD_IDS`` ids of a domain.  A narrow projection: no
    operator needs the documents numbered."""
    return table(spark, d, "documents").select(
        F.col("source").alias("domain"), "doc_id", F.lit(0).alias("source_idx"), F.col("doc_id").alias("doc_pos"), "text",
        F.expr(f"CAST(doc_id div {CORPUS_SHARD_IDS} AS INT)").alias("shard_idx"))


def doc_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent) document pairs: every doc_id is the child of doc_id + 1."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    child = docs.select(
        F.col("doc_id").alias("child_id"), F.col("text").alias("child_text"))
    parent = docs.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return child.join(parent, parent["parent_id"] == child["child_id"] + 1, "inner")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Queue snapshots: one per 'signup' event; queue = the session's last 3 clicks."""
    e = (table(spark, d, "events").where(F.col("event_type").isin("signup", "click"))
         .select("event_id", "ts", "event_type",
                 F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("session")))
    # four sessions share all events: ranks come from prefix sums, not a window per session
    is_click = (F.col("event_type") == "click").cast("bigint")
    e = materialize(e.withColumns({"_us": F.unix_micros(F.col("ts").cast("timestamp")), "_click": is_click, "_signup": 1 - is_click}))
    e = prefix_sums(e, ["session"], ["_us", "event_id"], {"_click": "_clicks", "_signup": "_signups"})
    e = e.withColumn("clicks", F.col("_clicks") + F.col("_click")).withColumn("rn", F.col("_signups") + 1) \
        .drop("_us", "_click", "_signup", "_clicks", "_signups")
    snaps = e.where(F.col("event_type") == "signup")
    # Bounded expansion: exactly the three click ranks (c-2 .. c) per snapshot.
    want = snaps.select("session", "event_id", "clicks",
                        F.explode(F.sequence(F.col("clicks") - 2, F.col("clicks"))).alias("click_rank"))
    clicks = e.where(F.col("event_type") == "click").select(
        "session", F.col("clicks").alias("click_rank"), F.col("event_id").alias("click_id"))
    items = (want.join(clicks, ["session", "click_rank"], "inner")
             .groupBy("session", "event_id")
             .agg(F.array_sort(F.collect_list(F.struct("click_rank", "click_id"))).alias("items")))
    item = lambda x: F.struct(
        x["click_id"].alias("experiment_id"),
        F.concat(F.lit("experiments/q"), x["click_id"].cast("string"), F.lit(".py")).alias("script"),
        F.create_map().cast("map<string,string>").alias("env_vars"),
        F.lit(1).alias("gpus"), F.lit("H100").alias("gpu_type"),
        F.concat(F.lit("queued-"), x["click_id"].cast("string")).alias("name"),
        F.lit(None).cast("string").alias("track"), F.lit(None).cast("string").alias("cmd_prefix"))
    out = snaps.join(items, ["session", "event_id"], "left")
    return out.select(
        "session",
        ((F.col("rn") - 1) / 100).cast("int").alias("segment"),
        ((F.col("rn") - 1) % 100).cast("bigint").alias("line_no"),
        F.col("ts").cast("string").alias("ts"),
        F.coalesce(F.transform("items", item),
                   F.array().cast("array<struct<experiment_id:bigint,script:string,env_vars:map<string,string>,"
                                  "gpus:int,gpu_type:string,name:string,track:string,cmd_prefix:string>>")).alias("queue"),
        F.col("event_id").alias("snapshot_id"),
    )


def crash_events(runs_df: DataFrame) -> DataFrame:
    """Crash-log arrivals: failed runs with id % 3 = 0 report one crash text,
    those with id % 9 = 0 a second, later one (first-wins vs replace)."""
    f = runs_df.where((F.col("status") == "failed") & (F.col("id") % 3 == 0))
    first = f.select(F.col("id").alias("experiment_id"),
                     F.concat(F.lit("Traceback: "), F.col("name"), F.lit(" A")).alias("content"),
                     F.lit(1).cast("bigint").alias("seq"), F.col("started_at").alias("created_at"))
    second = f.where(F.col("id") % 9 == 0).select(
        F.col("id").alias("experiment_id"),
        F.concat(F.lit("Traceback: "), F.col("name"), F.lit(" B")).alias("content"),
        F.lit(2).cast("bigint").alias("seq"), F.col("finished_at").alias("created_at"))
    return first.unionByName(second)


def mapping_lines(spark: SparkSession, d: str) -> DataFrame:
    """Run lifecycle feed as JSON text lines (session, file, line_no, line).

    Per run: a 'running' record at start; a final record (with a crash tail
    for failed runs with id % 3 = 0) unless still running; a stale 'failed'
    record after 'completed' for id % 11 = 0.  Noise: an invalid line for id %
    97 = 0 and a record without id for id % 89 = 0.  A session's runs up to id
    200 go to the legacy file ``mappings.jsonl``, the rest to a segment
    ``mappings/mappings-NNNNNN.jsonl`` per 1,000 ids; lines are numbered
    within their file."""
    r = runs(spark, d)
    base = dict(
        experiment_id=F.col("id"), run_id=F.col("id").cast("string"), script=F.col("script"),
        code_hash=F.col("code_hash"), env_vars=F.col("env_vars"), gpus=F.col("gpus"),
        gpu_type=F.col("gpu_type"), started_at=F.col("started_at").cast("string"), track=F.col("track"),
        name=F.col("name"))
    rec = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in {**base, **kv}.items()]))
    fin = F.col("finished_at").cast("string")
    crash = F.when((F.col("status") == "failed") & (F.col("id") % 3 == 0),
                   F.concat(F.lit("Traceback (most recent call last): "), F.col("name")))
    rows = [
        r.select("session_name", "id", F.lit(1).alias("k"), rec(status=F.lit("running")).alias("line")),
        r.where(F.col("status") != "running").select(
            "session_name", "id", F.lit(2).alias("k"),
            rec(status=F.col("status"), finished_at=fin, crash_log=crash).alias("line")),
        r.where((F.col("status") == "completed") & (F.col("id") % 11 == 0)).select(
            "session_name", "id", F.lit(3).alias("k"),
            rec(status=F.lit("failed"), finished_at=fin).alias("line")),
        r.where(F.col("id") % 97 == 0).select("session_name", "id", F.lit(4).alias("k"),
                                             F.lit('{"experiment_id": ').alias("line")),
        r.where(F.col("id") % 89 == 0).select("session_name", "id", F.lit(5).alias("k"),
                                             F.lit('{"status": "running"}').alias("line")),
    ]
    u = rows[0]
    for x in rows[1:]:
        u = u.unionByName(x)
    file = F.when(F.col("id") <= 200, F.lit("mappings.jsonl")).otherwise(
        F.format_string("mappings/mappings-%06d.jsonl", F.expr("CAST(id div 1000 AS INT)")))
    u = u.withColumn("file", file)
    w = Window.partitionBy("session_name", "file").orderBy("id", "k")
    return u.select(F.col("session_name").alias("session"), "file", F.row_number().over(w).cast("bigint").alias("line_no"),
                    "line")


def snapshot_lines(snaps: DataFrame) -> DataFrame:
    """Queue snapshots as JSON lines in ``queue/queue-NNNNNN.jsonl`` files."""
    line = F.to_json(F.struct("ts", "session", "queue"))
    return snaps.select("session", F.format_string("queue/queue-%06d.jsonl", F.col("segment")).alias("file"),
                        "segment", (F.col("line_no") + 1).alias("line_no"), line.alias("line"), "snapshot_id", "ts")
