import os
import tempfile

import numpy as np
import pytest


def test_round_trip_and_header_checks(spark):
    from quire.sources import token_bin
    dest = tempfile.mkdtemp(prefix="quire-shards-")
    rows = [("dolma_train_x_0000.bin", 0, [50256, 1, 2]), ("dolma_train_x_0000.bin", 3, [3, 4]),
            ("dolma_val_x_0000.bin", 0, [50256, 9])]
    df = spark.createDataFrame(rows, "name string, shard_pos long, tokens array<int>")
    token_bin.write_shards(df, dest)
    got = token_bin.read_shards(spark, dest, chunk_tokens=2, row_tokens=1).collect()
    by = {}
    for r in got:
        by.setdefault(os.path.basename(r.path), []).append((r.start, r.tokens))
    assert [t for _, ts in sorted(by["dolma_train_x_0000.bin"]) for t in ts] == [50256, 1, 2, 3, 4]
    inv = {os.path.basename(r.path): (r.num_tokens, r.valid) for r in token_bin.shard_inventory(spark, dest).collect()}
    assert inv["dolma_val_x_0000.bin"] == (2, True)
    bad = os.path.join(dest, "broken.bin")
    header = np.zeros(256, dtype="<i4")
    header[:3] = [1, 1, 5]
    with open(bad, "wb") as fh:
        fh.write(header.tobytes() + np.zeros(5, dtype="<u2").tobytes())
    with pytest.raises(Exception):
        token_bin.read_shards(spark, bad).collect()


def _file(dest, name, tokens):
    header = np.zeros(256, dtype="<i4")
    header[:3] = [20240520, 1, len(tokens)]
    with open(os.path.join(dest, name), "wb") as fh:
        fh.write(header.tobytes() + np.array(tokens, dtype="<u2").tobytes())


def test_filters_on_path_and_start_prune_slices(spark):
    from pyspark.sql import functions as F

    from quire.sources import token_bin
    dest = tempfile.mkdtemp(prefix="quire-shards-")
    for k in range(4):
        _file(dest, f"s{k}.bin", list(range(100 * k, 100 * k + 100)))
    read = lambda: token_bin.read_shards(spark, dest, chunk_tokens=20, row_tokens=5)
    assert read().rdd.getNumPartitions() == 20
    one = read().where((F.col("path") == f"{dest}/s2.bin") & (F.col("start") >= 42) & (F.col("start") < 61))
    assert one.rdd.getNumPartitions() == 2  # two of five slices of one of four files
    assert sorted((r.start, r.tokens[0]) for r in one.collect()) == [(45, 245), (50, 250), (55, 255), (60, 260)]
    whole = [(r.path, r.start, r.tokens) for r in read().collect()]
    for cond in ("start = 20", "start > 20 and start <= 45", "start >= 95", "start < 5", "start = 3", "start > 99",
                 f"path in ('{dest}/s0.bin', '{dest}/s3.bin')", "path like '%s1.bin' and start between 10 and 19"):
        got = sorted((r.path, r.start, r.tokens) for r in read().where(cond).collect())
        all_rows = spark.createDataFrame(whole, "path string, start long, tokens array<int>")
        assert got == sorted((r.path, r.start, r.tokens) for r in all_rows.where(cond).collect()), cond


def test_ranges_are_read_in_place(spark):
    from quire.sources import token_bin
    dest = tempfile.mkdtemp(prefix="quire-shards-")
    _file(dest, "a.bin", list(range(50)))
    _file(dest, "b.bin", list(range(100, 130)))
    rows = [(1, f"{dest}/a.bin", [(3, 6), (10, 10), (48, 50)]), (2, f"{dest}/b.bin", [(0, 2)]), (3, f"{dest}/a.bin", [(0, 1)])]
    df = spark.createDataFrame(rows, "k int, path string, spans array<struct<start:long,end:long>>")
    got = {r.k: r.tokens for r in token_bin.read_ranges(df, out_tokens=2).collect()}
    assert got == {1: [3, 4, 5, 48, 49], 2: [100, 101], 3: [0]}
    bad = spark.createDataFrame([(1, f"{dest}/b.bin", [(29, 31)])], df.schema)
    with pytest.raises(Exception, match="tokens 29 to 31 of 30"):
        token_bin.read_ranges(bad).collect()


def test_writer_checks_ids_and_counts(spark):
    from quire.sources import token_bin
    dest = tempfile.mkdtemp(prefix="quire-shards-")
    df = spark.createDataFrame([("x.bin", 0, [1, 70000])], "name string, shard_pos long, tokens array<int>")
    with pytest.raises(Exception, match="uint16"):
        token_bin.write_shards(df, dest)
    ok = df.sparkSession.createDataFrame([("y.bin", 0, [1, 2]), ("y.bin", 2, []), ("z.bin", 0, [])], df.schema)
    wrong = spark.createDataFrame([("y.bin", 3), ("z.bin", 0)], "name string, n_tokens long")
    with pytest.raises(Exception, match="2 tokens where 3 were announced"):
        token_bin.write_shards(ok, dest, wrong)
    assert not [f for f in os.listdir(dest) if f in ("x.bin", "y.bin")]
    token_bin.write_shards(ok, dest)
    assert {r.path.split("/")[-1]: r.tokens for r in token_bin.read_shards(spark, dest + "/y.bin").collect()} == {"y.bin": [1, 2]}
