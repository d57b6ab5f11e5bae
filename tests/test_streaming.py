import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.operators import merge, state
from quire.streaming import folds, streams, tables


def _grow(folder, run, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{run}.txt"), "a") as f:
        f.writelines(line + "\n" for line in lines)


def _runs(spark):
    from quire.sources import fixtures as fx
    r = fx.runs(spark, "/root/testdata/sf0.001").limit(2)
    ids = [x.id for x in r.select("id").collect()]
    return r.withColumn("id", F.when(F.col("id") == ids[0], 1).otherwise(2).cast("long")).withColumn(
        "revision", F.lit(3).cast("long")).withColumn("metrics_revision", F.lit(5).cast("long")).withColumn(
        "deleted", F.lit(None).cast("int"))


def _events(spark, path):
    rows = streams.read_batches(spark, path, streams.EVENT_ROW).select(
        "batch_id", "entity_id", F.get_json_object("payload", "$.revision").cast("int").alias("r"),
        F.get_json_object("payload", "$.metrics_revision").cast("int").alias("m"),
        F.get_json_object("payload", "$.summary.name").alias("name")).collect()
    return sorted((x.batch_id, x.entity_id, x.r, x.m) for x in rows if x.name)


def _folders():
    base = tempfile.mkdtemp(prefix="quire-stream-")
    return [os.path.join(base, x) for x in ("src", "table", "events", "ckpt")]


def test_metrics_survive_a_crash_between_write_and_commit(spark, monkeypatch):
    src, out, ev, ckpt = _folders()
    runs = _runs(spark)
    _grow(src, 1, "step:1/9 val_loss:5.0")
    _grow(src, 2, "step:1/9 val_loss:7.0")
    run = lambda: streams.stream_metrics(spark, src, out, runs, events_path=ev, ckpt=ckpt)
    run()
    # the second batch changes run 1 and repeats a value of run 2; it dies after its writes
    _grow(src, 1, "step:2/9 val_loss:4.0")
    _grow(src, 2, "step:1/9 val_loss:7.0")
    real = streams.metrics_changed

    def dies(*a):
        real(*a)
        raise RuntimeError("killed before the commit")

    monkeypatch.setattr(streams, "metrics_changed", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(streams, "metrics_changed", real)
    run()  # the batch is tried again
    got = {(r.experiment_id, r.step): (r.val_loss, r.arrivals) for r in streams.metrics_table(spark, out).collect()}
    assert got == {(1, 1): (5.0, 1), (1, 2): (4.0, 1), (2, 1): (7.0, 2)}
    assert _events(spark, ev) == [(0, "1", 4, 6), (0, "2", 4, 6), (1, "1", 5, 7)]


def test_a_batch_reads_nothing_that_earlier_batches_wrote(spark, monkeypatch):
    """Events come out of the state: the folders of earlier batches may be gone."""
    src, out, ev, ckpt = _folders()
    runs = _runs(spark)

    def no_reads(*a, **k):
        raise AssertionError("a micro-batch reads earlier batches")

    def summary_of(batch):
        rows = spark.read.parquet(f"{ev}/batch_id={batch}").select(F.from_json(
            "payload", "summary struct<val_loss:double,train_loss:double,current_step:long,final_loss:double,final_loss_step:long>").alias("p"))
        return [tuple(r) for r in rows.select("p.summary.*").collect()]

    for n, line in enumerate(("step:1/3 val_loss:5.0", "step:2/3 train_loss:2.0", "step:3/3 val_loss:4.5", "step:1/3 val_loss:5.5")):
        _grow(src, 1, line)
        with monkeypatch.context() as m:
            m.setattr(streams, "read_batches", no_reads)
            m.setattr(streams, "latest", no_reads)
            streams.stream_metrics(spark, src, out, runs, events_path=ev, ckpt=ckpt)
        rows = spark.read.parquet(f"{out}/batch_id={n}").count()
        assert rows == 1  # what the batch touched, however many came before
    assert [summary_of(n) for n in range(4)] == [
        [(5.0, None, 1, None, None)], [(5.0, 2.0, 2, None, None)], [(4.5, 2.0, 3, 4.5, 3)], [(4.5, 2.0, 3, 4.5, 3)]]
    assert _events(spark, ev) == [(n, "1", 4 + n, 6 + n) for n in range(4)]


def test_metrics_go_on_from_a_batch_table(spark):
    src, out, ev, ckpt = _folders()
    old = spark.createDataFrame([(1, 1, 1, 9, 5.0, None, 10, 1.0, False), (1, 2, 2, 9, 4.0, None, 20, 1.0, False)],
                                "experiment_id long, seq long, step long, total_steps long, val_loss double, train_loss double, "
                                "train_time_ms long, step_avg_ms double, is_final_step boolean")
    _grow(src, 1, "step:2/9 val_loss:4.0", "step:1/9 val_loss:5.5")
    streams.stream_metrics(spark, src, out, _runs(spark), events_path=ev, ckpt=ckpt, initial=merge.merge_metrics(old))
    got = {r.step: (r.val_loss, r.train_time_ms, r.arrivals) for r in streams.metrics_table(spark, out).collect()}
    assert got == {1: (5.5, 10, 2), 2: (4.0, 20, 2)}
    payload = streams.read_batches(spark, ev, streams.EVENT_ROW).first().payload
    assert '"latest_step":2' in payload and '"val_loss":4.0' in payload


def test_a_batch_replaces_its_own_folder(spark):
    path = tempfile.mkdtemp(prefix="quire-sink-") + "/t"
    rows = lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    tables.write_batch(rows("a"), path, 0)
    tables.write_batch(rows("b"), path, 1)
    tables.write_batch(rows("c"), path, 1)
    assert [tuple(r) for r in tables.latest(spark.read.parquet(path), ["k"]).collect()] == [(1, "c")]
    assert tables.read_batches(spark, path, "k long, v string", before=1).collect()[0].v == "a"


def test_compaction_keeps_the_latest_rows(spark):
    path = tempfile.mkdtemp(prefix="quire-sink-") + "/t"
    schema = "k long, v string"
    for n in range(5):
        tables.write_batch(spark.createDataFrame([(n % 2, f"v{n}"), (9, f"w{n}")], schema), path, n)
    now = lambda: sorted(tuple(r) for r in tables.latest(tables.read_batches(spark, path, schema), ["k"]).collect())
    want = [(0, "v4"), (1, "v3"), (9, "w4")]
    assert now() == want
    tables.compact(spark, path, schema, 1, ["k"])
    assert now() == want and not os.path.exists(f"{path}/batch_id=0")
    tables.compact(spark, path, schema, 3, ["k"])
    assert now() == want and tables.read_batches(spark, path, schema).count() == 5  # three keys, and batch 4
    tables.write_batch(spark.createDataFrame([(1, "new")], schema), path, 5)
    assert (1, "new") in now()
    tables.compact(spark, path, schema, 5)  # rows without a key are kept
    assert tables.read_batches(spark, path, schema).count() == 6


def _mapping(exp, status, **more):
    import json
    return json.dumps({"experiment_id": exp, "status": status, "script": f"a/s{exp}.py", **more})


MAPPING_BATCHES = [
    [_mapping(1, "running", started_at="t0", env_vars={"LR": "1"}), _mapping(2, "running"), "not json"],
    [_mapping(1, "completed", finished_at="t1", dependencies={"m": "x"})],
    [_mapping(1, "failed", crash_log="late"), _mapping(3, None, name="n3"), _mapping(2, "odd", git_commit="c")],
    [_mapping(2, "failed", crash_log="boom"), _mapping(2, "failed", crash_log="again"), _mapping(3, "running", started_at="t9")],
]


def _rows(df):
    return sorted((tuple(sorted((k, str(v)) for k, v in r.asDict(True).items())) for r in df.collect()))


@pytest.mark.parametrize("start", [0, 2])
def test_mapping_fold_equals_the_batch_fold(spark, start):
    """Four micro-batches, each after a restart; and the same from a batch table of the first two."""
    src, out, _, ckpt = _folders()
    os.makedirs(f"{src}/s0/mappings")
    numbered = [(i * 1000 + j, line) for i, b in enumerate(MAPPING_BATCHES) for j, line in enumerate(b)]
    records = lambda rows: state.parse_mappings(spark.createDataFrame(rows, "seq long, line string"))
    initial = state.mapping_state(records([r for r in numbered if r[0] < 1000 * start])) if start else None
    initial = initial.withColumns({f"_{c}_seq": F.col(f"_{c}_seq") - 10**6 for c in state.META}) if start else None
    if start:  # arrivals of the batch table come before those of the stream
        initial = initial.withColumns({c: F.col(c) - 10**6 for c in ("_first_seq", "_last_known_seq", "_last_open_seq",
                                                                     "_first_completed_seq", "_crash_seq")})
    for batch in MAPPING_BATCHES[start:]:
        with open(f"{src}/s0/mappings/mappings-000000.jsonl", "a") as f:
            f.writelines(line + "\n" for line in batch)
        streams.stream_mappings(spark, src, out, ckpt=ckpt, initial=initial)
    final = spark.createDataFrame([(1,)], "experiment_id long")
    got = streams.mapping_table(spark, out)
    if start:  # runs that the stream did not touch are in the batch table alone
        got = got.unionByName(initial.join(got, "experiment_id", "left_anti"))
    want = state.fold_mappings(records(numbered), final)
    assert _rows(state.finish_fold(got, final)) == _rows(want)


def test_queue_fold_equals_the_batch_fold(spark):
    src, out, _, ckpt = _folders()
    os.makedirs(f"{src}/s0/queue")
    item = lambda i: {"experiment_id": i, "script": f"q{i}.py", "env_vars": {"A": str(i)}}
    import json
    snaps = [("2024-01-01T10:00:00+00:00", [1]), ("2024-01-01T12:00:00+05:00", [2]), ("no time", [3]),
             ("2024-01-01T10:00:00+00:00", [4]), ("2024-01-01T10:00:01+00:00", [5, 6]), ("2024-01-01T08:00:00+00:00", [7])]
    lines = [json.dumps({"ts": ts, "session": "s0", "queue": [item(i) for i in ids]}) for ts, ids in snaps]
    seen = []
    for n in range(0, 6, 2):
        with open(f"{src}/s0/queue/queue-000000.jsonl", "a") as f:
            f.writelines(line + "\n" for line in lines[n:n + 2])
        streams.stream_queue(spark, src, out, ckpt=ckpt)
        got = streams.queue_table(spark, out).select("session", "ts", "queue").collect()
        df = spark.createDataFrame([("s0", i, line) for i, line in enumerate(lines[:n + 2])], "session string, seq long, line string")
        want = state.accepted_snapshot(state.parse_snapshots(df).select("session", "seq", "ts", "queue")).select("session", "ts", "queue").collect()
        assert [r.asDict(True) for r in got] == [r.asDict(True) for r in want]
        seen.append([q.experiment_id for q in got[0].queue])
    assert seen == [[1], [1], [5, 6]]


def test_revision_gate_over_restarts_and_from_a_table(spark):
    src, out, _, ckpt = _folders()
    os.makedirs(src)
    initial = spark.createDataFrame([("y", 5)], "entity_id string, revision long")
    for n, rows in enumerate(("2,x,4\n1,x,3\n3,y,5\n", "4,x,4\n5,y,6\n6,z,1\n", "7,x,9\n8,z,1\n9,y,6\n", "10,x,8\n")):
        with open(f"{src}/{n}.csv", "w") as f:
            f.write(rows)
        streams.stream_revision_gate(spark, src, out, ckpt=ckpt, initial=initial)
    passed = sorted(r.event_id for r in spark.read.parquet(out).where("accepted").collect())
    assert passed == [1, 2, 5, 6, 7] and spark.read.parquet(out).count() == 10


def test_state_store_choice_ends_with_the_query(spark):
    before = spark.conf.get(folds._PROVIDER, None)
    with folds.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(folds._PROVIDER)
    assert spark.conf.get(folds._PROVIDER, None) == before


def test_queue_events(spark):
    schema = "session string, queue array<int>, connected boolean"
    a = spark.createDataFrame([("s", [1], True), ("t", [2], True), ("u", [3], True)], schema)
    b = spark.createDataFrame([("s", [1], True), ("t", [2], False), ("u", [4], True), ("v", [], True)], schema)
    assert {r.entity_id for r in streams.queue_events(a, b).collect()} == {"t", "u", "v"}


class _Store:
    """State of one key that counts the calls to it."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def getValueState(self, *names):
        return self

    getMapState = getValueState

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_runs_of_a_group_share_the_calls_to_the_store():
    """A call costs far more than a row: their number does not grow with the runs or steps of a batch."""
    metric = folds.Row("experiment_id", "seq", "step", *folds._VALUES, "is_final_step")
    rows = [metric(run, step, step, 2000, None if step % 2 else 0.1 * run, 0.5, None, None, step == 2000)
            for run in range(64) for step in (1, 2, 1023, 1024, 2000)]
    p, store = folds.RunMetrics(), _Store()
    p.init(store)
    first = list(p.handleInputRows((0,), iter(rows), None))
    assert store.calls <= 4 and len(first) == 64 * 6
    more = [metric(run, 3000, 2, 2000, None, 0.5 if run else 0.25, None, None, False) for run in range(64)]
    again = list(p.handleInputRows((0,), iter(more), None))
    assert store.calls <= 8
    assert [(r.experiment_id, r.train_loss, r.val_loss, r.arrivals) for r in again if r.kind == "row"] == [
        (run, 0.5 if run else 0.25, 0.1 * run, 2) for run in range(64)]
    assert [(r.experiment_id, r.batches, r.lv__step, r.lt__train_loss) for r in again if r.kind == "run"] == [(0, 2, 2000, 0.5)]
    schema = folds.StructType()
    for c in ("n_records", "_first_seq", "_first_status", "_last_known", "_last_known_seq", "_last_open_seq", "_first_completed_seq",
              "crash_log", "_crash_seq", *(f"_first_{c}" for c in state.AT_CREATION), *state.META, *(f"_{c}_seq" for c in state.META)):
        schema = schema.add(c, "string")
    record = folds.Row("experiment_id", "seq", "status", "crash_log", *state.AT_CREATION, *state.META)
    m, store = folds.MappingFold(schema), _Store()
    m.init(store)
    none = (None,) * len(state.META)
    out = list(m.handleInputRows((0,), iter([record(run, seq, status, None, f"n{run}", *none[:5], *none) for run in range(64)
                                            for seq, status in ((1, "running"), (2, "completed"))]), None))
    assert store.calls == 2
    assert [(r.experiment_id, r.n_records, r._last_known, r._first_name) for r in out] == [(run, 2, "completed", f"n{run}") for run in range(64)]


def test_state_has_a_few_partitions_per_core_and_the_session_keeps_its_number(spark, monkeypatch):
    """Each partition costs a Python process and a store per micro-batch; a started checkpoint keeps its number."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    monkeypatch.setattr(folds, "STATE_WAVES", 1)
    cores = spark.sparkContext.defaultParallelism
    src, out, ev, ckpt = _folders()
    _grow(src, 1, "step:1/9 val_loss:5.0")
    try:
        spark.conf.set(key, str(cores + 3))
        streams.stream_metrics(spark, src, out, _runs(spark), events_path=ev, ckpt=ckpt)
        assert spark.conf.get(key) == str(cores + 3)
        with folds.state_partitions(spark):
            assert spark.conf.get(key) == str(cores)
        spark.conf.set(key, "1")
        with folds.state_partitions(spark):
            assert spark.conf.get(key) == "1"
    finally:
        spark.conf.set(key, before)
    assert len([x for x in os.listdir(os.path.join(ckpt, "state", "0")) if x.isdigit()]) == cores


def test_logs_and_segments_grow_by_appending(spark):
    """A wave lands the new lines only; no file is written again."""
    from quire.plans import streams as plans
    seen = []

    def follow(folder):
        now = {}
        for top, _, names in os.walk(folder):
            for n in names:
                if not n.startswith("."):
                    with open(os.path.join(top, n), "rb") as f:
                        now[n] = os.stat(f.name).st_ino, f.read()
        seen.append(now)

    lines = spark.createDataFrame([("s", f"{n}.jsonl", k, f"é {n} {k}") for n in (5, 9) for k in range(1, n + 1)],
                                  "session string, file string, line_no long, line string")
    plans.grow_segments(spark, lines, "grown", follow)
    assert len(seen) == plans.WAVES
    for n in (5, 9):
        assert seen[-1][f"{n}.jsonl"][1] == "".join(f"é {n} {k}\n" for k in range(1, n + 1)).encode()
        states = [w[f"{n}.jsonl"] for w in seen]
        assert len({inode for inode, _ in states}) == 1
        assert all(b.startswith(a) and len(b) > len(a) for (_, a), (_, b) in zip(states, states[1:]))
