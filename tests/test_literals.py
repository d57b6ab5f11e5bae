"""Hand-worked cases (FIXTURES.md section 3) for operators and edges."""

from pyspark.sql import functions as F

import numpy as np
import pytest

from quire.operators import batches as bt
from quire.operators import corpus as cp
from quire.operators import curves, logs, merge, state, summary, sweeps


def _lines(spark, *texts):
    return spark.createDataFrame([("r", i + 1, t) for i, t in enumerate(texts)], "run_id string, line_no long, line string")


def test_metric_line_grammar(spark):
    rows = logs.parse_metric_lines(_lines(
        spark, "step:1/2 val_loss:1e-3", "step:1/2 val_loss:{x:.4f}", "step:5/9 train_time:10ms step_avg:2ms",
        "step:1/2 train_loss:2.5 train_time:12.5s", "step:3/4 val_loss:2.0 train_time:7.9ms")).orderBy("seq").collect()
    assert [r.seq for r in rows] == [1, 4, 5]
    assert rows[0].val_loss == 0.001
    assert rows[1].train_time_ms == 12500 and rows[1].train_loss == 2.5
    assert rows[2].train_time_ms == 7  # whole ms, truncated


def test_final_flag_local_vs_external(spark):
    df = _lines(spark, "step:12/10 val_loss:1.0")
    assert logs.parse_metric_lines(df).first().is_final_step is False
    assert logs.parse_metric_lines(df, final_mode="external").first().is_final_step is True


def test_merge_and_changes(spark):
    df = spark.createDataFrame([(1, 1, 1, 3.0, None), (1, 1, 2, None, 4.0), (1, 1, 3, None, None)],
                               "experiment_id long, step long, seq long, val_loss double, train_loss double")
    df = df.withColumn("is_final_step", F.lit(False))
    m = merge.merge_metrics(df).first()
    assert (m.val_loss, m.train_loss, m.arrivals) == (3.0, 4.0, 3)
    assert merge.change_counts(df).first().changed_rows == 2
    # replaying the same arrivals changes nothing
    assert merge.merge_metrics(df.unionByName(df)).first().val_loss == 3.0


def test_metric_state_any_batch_split(spark):
    df = spark.createDataFrame([(1, 1, s, float(v) if v is not None else None)
                                for s, v in [(1, 5), (2, None), (3, 7), (4, None), (5, 9)]],
                               "experiment_id long, step long, seq long, val_loss double") \
        .withColumn("is_final_step", F.col("seq") == 3)
    whole = merge.metric_state(df).select("val_loss", "is_final_step", "arrivals").first()
    parts = [df.where(F.col("seq").isin(*ix)) for ix in ([5, 1], [3], [2, 4])]
    st = merge.metric_state(parts[0])
    for p in parts[1:]:
        st = merge.merge_metric_state(st.unionByName(merge.metric_state(p)))
    assert st.select("val_loss", "is_final_step", "arrivals").first() == whole
    assert whole.val_loss == 9.0 and whole.arrivals == 5


def test_primary_series_and_progress(spark):
    runs = spark.createDataFrame([(1, "a", None, 0)], "id long, name string, gpu_type string, deleted int")
    m = spark.createDataFrame([(1, 1, 10, 2.0, None, None, None, False), (1, 9, 10, None, 3.0, None, None, False)],
                              "experiment_id long, step long, total_steps long, val_loss double, train_loss double, "
                              "train_time_ms long, step_avg_ms double, is_final_step boolean")
    s = summary.run_summaries(runs, m).first()
    assert s.loss_metric == "val_loss" and s.latest_loss == 2.0 and s.latest_loss_step == 1
    assert s.current_step == 9 and s.gpu_type == "H100"


def test_status_gate_completed_with_final_metric(spark):
    rec = spark.createDataFrame([(1, 1, "completed", "s.py"), (1, 2, "failed", "s.py"), (2, 1, "completed", "t.py"),
                                 (2, 2, "failed", "t.py")], "experiment_id long, seq long, status string, script string")
    for c in ("name", "track", "gpu_type", "crash_log", "code_hash", "tmux_window", "run_id", "started_at",
              "finished_at", "git_commit", "parent_hash", "kernels_path"):
        rec = rec.withColumn(c, F.lit(None).cast("string"))
    rec = rec.withColumn("gpus", F.lit(None).cast("int"))
    fin = spark.createDataFrame([(1,)], "experiment_id long")
    out = {r.experiment_id: r.status for r in state.fold_mappings(rec, fin).collect()}
    assert out == {1: "completed", 2: "failed"}


def test_queue_ts_first_arrival_kept(spark):
    s = spark.createDataFrame([("a", 1, "2024-01-02T00:00:00", [1]), ("a", 2, "2024-01-01T00:00:00", [2]),
                               ("a", 3, "2024-01-02T00:00:00", [3])], "session string, seq long, ts string, q array<long>")
    s = s.withColumn("queue", F.transform("q", lambda x: F.struct(x.alias("experiment_id"))))
    acc = state.accepted_snapshot(s).first()
    assert acc.seq == 1 and acc.queue[0].experiment_id == 1


def test_history_consecutive_duplicates(spark):
    lines = [('{"session": "A", "ts": "t", "queue": [{"experiment_id": 1}]}'),
             ('{"session": "A", "ts": "t", "queue": [{"experiment_id": 1}]}'),
             ('{"session": "B", "ts": "t", "queue": [{"experiment_id": 1}]}'),
             ('{"session": "A", "ts": "t", "queue": [{"experiment_id": 1}]}'), "", "not json"]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "file_pos long, line string")
    kept = state.queue_history(df, n=10).orderBy("file_pos").collect()
    assert [r.session for r in kept] == ["A", "B", "A"]


def test_sweep_heatmap_grid(spark):
    data = [(1, "completed", {"A": "1", "B": "x"}, 1.0), (2, "completed", {"A": "1", "B": "y"}, 2.0),
            (3, "completed", {"A": "2", "B": "x"}, 3.0)]
    runs = spark.createDataFrame([(i, s, e, l, None, "2024-01-01") for i, s, e, l in data],
                                 "id long, status string, env_vars map<string,string>, final_loss double, "
                                 "final_val_loss double, started_at string")
    runs = runs.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
    cells = {(r.x_val, r.y_val): (r.mean_loss, r.n_runs, r.is_best) for r in sweeps.sweep_heatmap(runs).collect()}
    assert len(cells) == 4
    assert cells[("2", "y")] == (None, 0, False)
    assert cells[("1", "x")] == (1.0, 1, True)


def test_bigram_hash(spark):
    def wrap(x):
        return ((x + 2 ** 31) % 2 ** 32) - 2 ** 31
    M = bt.BIGRAM_VOCAB
    exp = [M, (wrap(36313 * 5) ^ wrap(27191 * M)) % M, (wrap(36313 * 7) ^ wrap(27191 * 5)) % M]
    assert exp[1] == 47170
    got = spark.createDataFrame([([50256, 5, 7],)], "x array<int>").select(bt.bigram_hash(F.col("x"))).first()[0]
    assert got == exp


def _positions(spark, lengths):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(lengths)], "domain string, doc_pos long, n_tokens long")
    return cp.stream_positions(df)


def test_length_stats_drop_last(spark):
    s = cp.seq_len_stats(_positions(spark, [4, 6, 2])).first()
    assert (s.num_sequences, s.mean_len, s.max_len, s.total_tokens) == (2, 5, 6, 12)


def test_budget_and_splits(spark):
    b = cp.token_budget(_positions(spark, [4, 4, 4]), 6).orderBy("doc_pos").collect()
    assert [r.keep for r in b] == [4, 2]
    c = cp.split_contiguous(_positions(spark, [4, 4]), 6, 2).where("split = 'train'").collect()
    assert [(r.doc_pos, r.from_tok, r.to_tok) for r in c] == [(1, 2, 4)]
    it = cp.split_by_doc(_positions(spark, [4, 4, 4]), 6, 4).where("split = 'train'").collect()
    assert [(r.doc_pos, r.from_tok, r.to_tok) for r in it] == [(2, 0, 4)]


def test_prefix_sums_cross_partitions(spark):
    import random
    rnd = random.Random(7)
    rows = [(k, i, rnd.randint(0, 9)) for k in ("a", "b", "c") for i in range(300)]
    df = spark.createDataFrame(rows, "domain string, doc_pos long, n_tokens long")
    got = {(r.domain, r.doc_pos): r.start for r in cp.stream_positions(df).collect()}
    acc = {}
    for k, i, n in rows:
        assert got[(k, i)] == acc.get(k, 0)
        acc[k] = acc.get(k, 0) + n


def test_contiguous_batches(spark):
    sizes = spark.createDataFrame([("t", "d", 0, 10)], "split string, domain string, shard long, n long")
    b = bt.batches_contiguous(sizes, 4, 1).orderBy("batch").collect()
    assert [r.start for r in b] == [0, 4]


def test_packing():
    rows = bt.packed_segments(np.array([0, 5, 8]), 17, 6, 8, 1)
    assert rows["start"].tolist() == [0, 5, 8] and rows["end"].tolist() == [5, 7, 15]  # 5 + 2 tokens, then 7 of the third
    assert rows["batch"].tolist() == [0, 0, 1] and rows["seg"].tolist() == [0, 1, 0]
    assert bt.packed_segments(np.array([0, 5, 8]), 17, 6, 8, 2)["rank"].tolist() == [0, 0, 1]
    assert not len(bt.packed_segments(np.array([0, 5, 8]), 10, 6, 8, 2)["start"])  # an open batch is dropped


def greedy(starts, n, local, longest, ranks):
    """Fill buffers document by document."""
    docs = [min(e - s, longest) for s, e in zip(starts, [*starts[1:], n])]
    buffers, room, cur = [], local + 1, []
    for s, size in zip(starts, docs):
        take = min(size, room)
        cur.append((s, s + take))
        room -= take
        if not room:
            buffers.append(cur)
            room, cur = local + 1, []
    return [x for b in buffers[:len(buffers) // ranks * ranks] for x in b]


def test_packing_equals_filling_one_by_one():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        sizes = rnd.integers(1, 30, rnd.integers(1, 60))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        local, longest, ranks = int(rnd.integers(1, 40)), int(rnd.integers(1, 25)), int(rnd.integers(1, 4))
        rows = bt.packed_segments(starts, int(sizes.sum()), local, longest, ranks)
        assert list(zip(rows["start"], rows["end"])) == greedy(starts.tolist(), int(sizes.sum()), local, longest, ranks)


def test_bos_aligned_starts():
    bos = np.array([0, 3, 5, 9, 12, 20, 30, 41, 50, 60])
    batch, rank, start = bt.aligned_starts(bos, 25, 4, 2)  # span 2*B = 16; the next window would pass the shard end
    assert list(zip(batch, rank, start)) == [(0, 0, 0), (0, 1, 5)]  # 0 confirmed by 5, 5 by 9
    assert not len(bt.aligned_starts(bos, 17, 4, 2)[0])
    with pytest.raises(RuntimeError):
        bt.aligned_starts(np.array([0, 3, 30]), 40, 4, 2)


def test_boundary_dataset_refuses(spark):
    schema = "domain string, split string, start long, tokens array<int>"
    good = spark.createDataFrame([("d", "val", 0, [50256, 1]), ("d", "val", 2, [50256])], schema)
    row = bt.boundary_dataset(good).first()
    assert (row.n_tokens, row.n_docs, row.num_seqs, row.ok) == (3, 2, 0, True)
    streams = spark.createDataFrame([("d", "val"), ("d", "train")], "domain string, split string")
    bad = [(good, streams), (spark.createDataFrame([("d", "val", 1, [50256])], schema), None),
           (spark.createDataFrame([("d", "val", 0, [7])], schema), None), (spark.createDataFrame([("d", "val", 0, [])], schema), None)]
    for docs, want in bad:
        with pytest.raises(Exception, match="refusing|must start|does not start"):
            bt.boundary_dataset(docs, streams=want).collect()


def test_means_keep_small_values(spark):
    df = spark.createDataFrame([(1, 1e-7, 1e-7, 1), (1, 3e-7, 3e-7, 1)], "step long, loss double, step_avg_ms double, train_time_ms long")
    assert curves.mean_curve(df).first().loss == pytest.approx(2e-7, rel=1e-12)


def test_stage_boundaries():
    assert curves.stage_boundaries([0.35, 0.35, 0.3, 0.0], 1440, 40) == [(0, 504), (504, 1008), (1008, 1440), (1440, 1480)]
    with pytest.raises(ValueError):
        curves.stage_boundaries([0.5, 0.4, 0.0], 100, 10)


def test_empty_text(spark):
    c = spark.createDataFrame([("d", 0, ""), ("d", 1, "a b")], "domain string, doc_pos long, text string")
    assert cp.tokenize(c).count() == 1
    kept = cp.tokenize(c, keep_empty=True).orderBy("doc_pos").first()
    assert kept.tokens == [50256]


def test_downsample_keeps_endpoints_and_extremes(spark):
    pts = [(1, s, float((s * 37) % 11)) for s in range(1, 101)]
    df = spark.createDataFrame(pts, "experiment_id long, step long, loss double")
    out = curves.downsample_step(df, 10).orderBy("step").collect()
    assert len(out) <= 10 and out[0].step == 1
    idx = curves.downsample_index(df, 10).orderBy("index").collect()
    assert idx[0].step == 1 and idx[-1].step == 100
    assert min(r.loss for r in idx) == min(p[2] for p in pts)


def test_detect_run_id_byte_windows(spark):
    uid = "0123abcd-0123-4567-89ab-0123456789ab"
    head = f"logs/{uid}.txt " + "é" * 5000
    tail = "é" * 5000 + f" logs/{uid}.txt"
    middle = "é" * 5000 + f" logs/{uid}.txt " + "é" * 5000
    df = spark.createDataFrame([(1, head), (2, tail), (3, middle)], "k long, content string")
    got = {r.k: r.run_id for r in logs.detect_run_id(df).collect()}
    assert got == {1: uid, 2: uid, 3: None}


def test_token_counts_equal_tokenized_lengths(spark):
    from quire.sources import fixtures as fx
    c = fx.corpus(spark, "/root/testdata/sf0.001")
    a = {(r.domain, r.doc_pos): r.n_tokens for r in cp.token_counts(c).collect()}
    b = {(r.domain, r.doc_pos): r.n_tokens for r in cp.doc_lengths(cp.tokenize(c)).collect()}
    assert a == b and len(a) > 0


def _snapshots(spark, rows):
    item = "array<struct<experiment_id:bigint,name:string,script:string>>"
    return spark.createDataFrame(rows, f"session string, session_id string, ts string, seq long, connected boolean, queue {item}")


def test_snapshots_compare_instants_and_keep_the_flag(spark):
    s = _snapshots(spark, [
        ("a", "a1", "2024-01-01T01:00:00+02:00", 1, None, [(1, "n", "s")]), ("a", "a1", "2024-01-01T00:30:00+00:00", 2, None, [(2, "n", "s")]),
        ("a", "a1", "2024-01-01T02:30:00+02:00", 3, False, [(3, "n", "s")]), ("b", "b1", "2024-01-01T00:00:00", 1, None, []),
        ("b", "b1", "", 2, False, [])])
    got = {r.session: r for r in state.accepted_snapshot(s).collect()}
    assert got["a"].seq == 2 and got["a"].connected is False  # equal instant: the first stays; the flag counts
    assert got["b"].seq == 1 and got["b"].connected is True


def test_reconcile_looks_at_incarnations(spark):
    acc = state.accepted_snapshot(_snapshots(spark, [("s", "s-2", "2024-01-01", 1, None, [(i, "n", "x") for i in (1, 2, 3, 9)])]))
    runs = spark.createDataFrame([
        (1, "unknown", "s", "s-1"), (2, "unknown", "s", "s-2"), (3, "unknown", "t", None), (4, "queued", "s", "s-1"),
        (5, "queued", "s", "s-2"), (6, "queued", "s", None), (7, "queued", "t", None), (8, "queued", "renamed", "s-2")],
        "id long, status string, session_name string, session_id string")
    got = {(r.id, r.action) for r in state.queue_reconcile(runs, acc).collect()}
    assert got == {(9, "create"), (2, "requeue"), (5, "lost"), (6, "lost"), (8, "lost")}


def _records(spark, *recs):
    import json
    rows = [("s", i, json.dumps(r)) for i, r in enumerate(recs)]
    return state.parse_mappings(spark.createDataFrame(rows, "session string, seq long, line string"))


def test_fold_clears_and_keeps(spark):
    rec = _records(
        spark, {"experiment_id": 1, "status": "failed", "finished_at": "T1", "script": "exp/a/x.py", "env_vars": {"LR": "1"}},
        {"experiment_id": 1, "status": "running", "dependencies": {"m": "p"}}, {"experiment_id": 2, "status": "running"},
        {"experiment_id": 2, "status": "failed", "finished_at": "T2", "name": "feed", "script": "feed.py", "track": "feed"},
        {"experiment_id": 3, "status": "completed", "finished_at": "T3"}, {"experiment_id": 3, "status": "running"})
    final = spark.createDataFrame([(3,)], "experiment_id long")
    old = spark.createDataFrame([(2, "queued", "mine", "own.py", None, None)],
                                "id long, status string, name string, script string, track string, finished_at string")
    tracks = spark.createDataFrame([("far", "exp"), ("near", "exp/a")], "name string, directory string")
    got = {r.experiment_id: r for r in state.fold_mappings(rec, final, old, tracks=tracks).collect()}
    assert (got[1].status, got[1].finished_at, got[1].track) == ("running", None, "near")
    assert got[1].env_vars == {"LR": "1"} and got[1].dependencies == {"m": "p"} and got[1].session == "s"
    assert (got[2].status, got[2].finished_at, got[2].name, got[2].script, got[2].track) == ("failed", "T2", "mine", "own.py", None)
    assert (got[3].status, got[3].finished_at) == ("completed", "T3")


def test_status_with_a_stray_finish_time(spark):
    runs = spark.createDataFrame([(1, "queued", "t0", "t1", 1), (2, "queued", "t0", None, 1)],
                                 "id long, status string, started_at string, finished_at string, revision long")
    ch = spark.createDataFrame([(1, 1, "queued", "t9"), (2, 1, "queued", "t9")], "id long, seq long, status string, at string")
    got = {r.id: (r.finished_at, r.revision) for r in state.apply_status(runs, ch).collect()}
    assert got == {1: (None, 2), 2: (None, 1)}


def test_external_totals_of_zero_and_bad_runtimes(spark):
    ev = spark.createDataFrame([("a", 0, "10", 1.0, "x"), ("a", 1, "20", 2.0, None), ("b", 0, "5", 1.0, "2.5")],
                               "run string, idx int, _step string, loss double, runtime string")
    tr = spark.createDataFrame([], "run string, idx int, _step string, loss double, duration double")
    cf = spark.createDataFrame([("a", "0", "0"), ("b", "0", "8")], "run string, config_total string, summary_step string")
    got = {(r.run, r.step): (r.total_steps, r.train_time_ms) for r in logs.external_history(ev, tr, cf).collect()}
    assert got == {("a", 20): (20, 0), ("b", 5): (8, 2500)}


def test_overlong_steps_do_not_fail(spark):
    big = "9" * 20
    lines = spark.createDataFrame([("1", 1, f"step:{big}/5 val_loss:1"), ("2", 1, f"step:3/{big} val_loss:1")],
                                  "run_id string, line_no long, line string")
    runs = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r.experiment_id: r.outcome for r in logs.classify_outcome(runs, lines, lines.limit(0)).collect()}
    assert got == {1: "completed", 2: "failed"}
    assert {r.step for r in logs.last_metric_step(lines).collect()} == {None, 3}


def test_code_hash_layout(spark):
    import hashlib
    import json

    from quire.operators import lineage
    files = {"a.py": b"A", "k.cu": b"K", "d\u00e9\U0001F600.py": b"D"}
    fdf = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    v = spark.createDataFrame([(1, "a.py", "", {}), (2, "a.py", None, {"m\u00fc": "d\u00e9\U0001F600.py"}), (3, "a.py", "k.cu", {})],
                              "id long, script string, kernels_path string, dependencies map<string,string>")
    got = {r.id: r.computed_hash for r in lineage.attach_code_hash(v, lineage.code_hash(v, fdf)).collect()}
    dep = json.dumps({"module": "m\u00fc", "path": "d\u00e9\U0001F600.py"}, sort_keys=True, separators=(",", ":")).encode()
    want = {1: b"A", 2: b"A\n---DEPENDENCY---\n" + dep + b"\nD", 3: b"A\n---KERNELS---\nK"}
    assert got == {k: hashlib.sha256(x).hexdigest()[:12] for k, x in want.items()}


def test_heatmap_needs_a_loss(spark):
    runs = spark.createDataFrame([(i, i, "completed", {"LR": str(i)}, None, None) for i in (1, 2)],
                                 "id long, started_at long, status string, env_vars map<string,string>, final_loss double, final_val_loss double")
    assert sweeps.sweep_heatmap(runs).count() == 0


def test_whole_file_modes(spark):
    uid = "0123abcd-0123-4567-89ab-0123456789ab"
    df = spark.createDataFrame([(1, "x" * 20000 + f" logs/{uid}.txt " + "x" * 20000)], "k long, content string")
    assert logs.detect_run_id(df).first().run_id is None and logs.detect_run_id(df, window=None).first().run_id == uid
    lines = spark.createDataFrame([("r", 1, "step:3/9 val_loss:1"), ("r", 2, "y" * 300)], "run_id string, line_no long, line string")
    assert logs.last_metric_step(lines, tail_bytes=100).count() == 0
    assert logs.last_metric_step(lines, tail_bytes=None).first().step == 3
