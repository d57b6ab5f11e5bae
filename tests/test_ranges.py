"""Range joins, file windows, long documents, requests that a plan refuses."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.operators import curves, groups, logs
from quire.sources import logs as txt
from quire.sources import text_files


def test_stage_join_equals_a_walk_over_all_stages(spark):
    rnd = random.Random(2)
    stages = []
    for schedule in range(4):
        at = rnd.randint(0, 5)
        for i in range(rnd.randint(1, 6)):
            end = at + rnd.randint(0, 5000 if schedule else 3)  # an empty stage now and then
            stages.append((schedule, f"{schedule}.{i}", at, end))
            at = end + rnd.choice([0, 0, 7])  # a gap now and then
    stages += [(9, "only", 10, 11), (8, "empty", 5, 5)]
    steps = [(s, x) for s in (0, 1, 2, 3, 7, 8, 9) for x in {*(rnd.randint(0, 30000) for _ in range(60)), 0, 9, 10, 11, *(e for _, _, a, b in stages for e in (a, b))}]
    st = spark.createDataFrame(stages, "schedule int, stage string, start long, end long")
    got = {(r.schedule, r.step): (r.stage, r.t) for r in curves.stage_join(spark.createDataFrame(steps, "schedule int, step long"), st).collect()}
    assert len(got) == len(steps)
    for s, x in steps:
        mine = [(name, a, b) for k, name, a, b in stages if k == s and b > a]
        top = max((b for _, _, b in mine), default=0)
        hit = [(name, 1.0 if x >= top else (x - a) / (b - a)) for name, a, b in mine if a <= min(x, top - 1) < b]
        assert got[s, x] == (hit[0] if hit else (None, None)), (s, x)


def test_file_windows_equal_the_line_forms(spark):
    uid = "01234567-89ab-cdef-0123-456789abcdef"
    pad = "é" * 5000  # 10,000 bytes: the window cuts a character
    files = [("head", f"logs/{uid}.txt {pad}"), ("tail", f"{pad} logs/{uid}.txt"), ("mid", f"{pad}logs/{uid}.txt{pad}"), ("none", ""),
             ("cut", "x" * (8192 - 20) + f"logs/{uid}.txt" + pad)]
    dest = tempfile.mkdtemp(prefix="quire-ends-")
    df = spark.createDataFrame(files, "relpath string, content string")
    assert sum(r.bytes for r in txt.land_files(df, dest).collect()) == sum(len(c.encode()) for _, c in files)
    ends = text_files.file_ends(spark, dest, 8192, 8192)
    got = {r.path: r.run_id for r in logs.detect_run_id_in_files(ends).collect()}
    assert got == {r.relpath: r.run_id for r in logs.detect_run_id(df).collect()} == {
        "head": uid, "tail": uid, "mid": None, "none": None, "cut": None}


def test_last_step_of_a_long_log(spark):
    dest = tempfile.mkdtemp(prefix="quire-ends-")
    line = "step:{}/900 val_loss:3.5\n"
    files = [("long", line.format(1) + "x" * 60000 + "\n" + line.format(2) + "step:3/900 no loss\n" + "y" * 40000),
             ("old", line.format(1) + "x" * 60000), ("source", 'print(f"step:{step}/{n} val_loss:{v}")\n'),
             ("cut", "a" * 30000 + line.format(4) + "z" * (50000 - len(line.format(4)) + 1)), ("open", "b" * 60000 + "\n" + line.format(5).strip())]
    txt.land_files(spark.createDataFrame(files, "relpath string, content string"), dest).collect()
    ends = text_files.file_ends(spark, dest, 0, logs.LOG_TAIL_BYTES)
    assert {r.path: (r.step, r.total_steps) for r in logs.last_metric_step_in_files(ends).collect()} == {"long": (2, 900), "open": (5, 900)}


def test_aligned_batches_with_a_very_long_document(spark):
    from quire.plans.batches import aligned_batches
    lengths = [("all", i, 200_000 if i == 700 else 900 + i % 300) for i in range(4000)]
    got = aligned_batches(spark.createDataFrame(lengths, "domain string, doc_pos long, n_tokens long")).collect()
    assert got and {r.rank for r in got} == {0, 1} and all(r.end - r.start == 200_001 for r in got)
    starts, at = set(), 0
    for _, _, n in lengths:
        starts.add(at)
        at += n
    shard = 16 * 200_000
    assert all(r.shard * shard + r.start in starts for r in got)


def test_ids_that_are_not_positive_are_refused_when_the_plan_runs(spark):
    runs = spark.createDataFrame([(1, None)], "id long, deleted int")
    asked = groups.select_ids(runs, spark.createDataFrame([(0, 1), (1, -2)], "pos long, id long"))  # no job here
    with pytest.raises(Exception, match="ids must be positive"):
        asked.collect()
