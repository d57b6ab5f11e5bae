import gzip
import hashlib
import os
import random
import shutil
import tempfile

import pytest

from quire.sources import corpus, logs
from quire.sources import text_files as tf


def _folder(files: dict[str, bytes]) -> str:
    base = tempfile.mkdtemp(prefix="quire-files-")
    for name, data in files.items():
        path = os.path.join(base, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    return base


def _lines(data: bytes) -> list[str]:
    parts = data.split(b"\n")
    return [p.decode("utf-8", "replace") for p in (parts[:-1] if parts[-1] == b"" else parts)]


@pytest.mark.parametrize("range_bytes", [1, 3, 7, 64, 1 << 20])
def test_lines_and_numbers_do_not_depend_on_the_ranges(spark, range_bytes):
    rnd = random.Random(5)
    files = {"empty.txt": b"", "feeds.txt": b"\n\n\n", "open.txt": b"no end", "blank.txt": b"\n", "two.txt": "é漢\n🙂 x".encode(),
             "bad.txt": b"a\xff\xfeb\n\xe6\n", "crlf.txt": b"a\r\nb\r\n", ".hidden.txt": b"x\n", "sub/in.txt": b"y\n", "other.log": b"z\n"}
    files["long.txt"] = b"".join(bytes(rnd.choice(b"ab \n") for _ in range(rnd.randint(0, 40))) + b"\n" for _ in range(9))
    got = logs.scan_logs(spark, _folder(files), range_bytes).collect()
    want = {(n[:-4], i + 1, line) for n, d in files.items() if n.endswith(".txt") and n[0] != "." and "/" not in n
            for i, line in enumerate(_lines(d))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_offsets_are_those_of_the_file(spark):
    data = "ä\nbc\n\nlast".encode()
    rows = tf.numbered_lines(spark, _folder({"a.txt": data}), range_bytes=4).collect()
    assert sorted((r.line_no, r.offset, r.line) for r in rows) == [(1, 0, "ä"), (2, 3, "bc"), (3, 6, ""), (4, 7, "last")]


def test_a_large_log_is_read_by_several_tasks(spark):
    base = _folder({"big.txt": b"".join(b"line %d\n" % i for i in range(20000))})
    df = logs.scan_logs(spark, base, range_bytes=16 << 10)
    assert tf._load(spark, tf.TextRanges, base, range_bytes=16 << 10).rdd.getNumPartitions() > 8
    assert df.where("line != concat('line ', line_no - 1)").count() == 0 and df.count() == 20000


def test_gzip_lines_with_members_and_open_end(spark):
    raw = gzip.compress(b'{"text": "a"}\n') + gzip.compress('{"text": "é"}\n{}'.encode())
    base = _folder({"web/0003.jsonl.gz": raw, "web/0004.jsonl.gz": gzip.compress(b"")})
    got = sorted(tuple(r) for r in corpus.scan_corpus(spark, base).collect())
    assert got == [("web", 3, 1, "a"), ("web", 3, 2, "é"), ("web", 3, 3, "")]


def test_file_ends_and_digests(spark):
    files = {"a.txt": b"0123456789", "b.txt": b"xy", "c.txt": b""}
    base = _folder(files)
    ends = {r.path: (r.bytes, bytes(r.head), bytes(r.tail)) for r in tf.file_ends(spark, base, 3, 4).collect()}
    assert ends == {"a.txt": (10, b"012", b"6789"), "b.txt": (2, b"xy", b"xy"), "c.txt": (0, b"", b"")}
    got = {r.path: (r.bytes, r.sha256) for r in tf.file_digests(spark, base).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}


def test_no_folder_no_rows(spark):
    gone = tempfile.mkdtemp(prefix="quire-files-") + "/none"
    assert tf.numbered_lines(spark, gone).count() == 0 and tf.file_digests(spark, gone).count() == 0


def _read_on(spark, base, out, ckpt):
    q = (tf.growing_lines(spark, base, "*.txt").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return sorted((r.path, r.offset, r.line) for r in spark.read.parquet(out).collect())


def test_a_growing_file_gives_exactly_its_new_lines(spark):
    base, work = _folder({"a.txt": b"one\ntwo\nthr"}), tempfile.mkdtemp(prefix="quire-grow-")
    out, ckpt = work + "/out", work + "/ckpt"
    append = lambda name, data: open(os.path.join(base, name), "ab").write(data)
    first = [("a.txt", 0, "one"), ("a.txt", 4, "two")]
    assert _read_on(spark, base, out, ckpt) == first
    append("a.txt", b"ee")  # no line feed yet: nothing new
    assert _read_on(spark, base, out, ckpt) == first
    append("a.txt", b"\n\nfive")
    append("b.txt", b"other\n")
    # every call is a restart from the checkpoint
    assert _read_on(spark, base, out, ckpt) == first + [("a.txt", 8, "three"), ("a.txt", 14, ""), ("b.txt", 0, "other")]


def test_a_running_stream_sees_growth_between_batches(spark):
    base, work = _folder({"a.txt": b"1\n"}), tempfile.mkdtemp(prefix="quire-grow-")
    q = (tf.growing_lines(spark, base, "*.txt").writeStream.format("memory").queryName("grown")
         .option("checkpointLocation", work + "/ckpt").start())
    try:
        q.processAllAvailable()
        for i in range(2, 4):
            with open(os.path.join(base, "a.txt"), "ab") as f:
                f.write(b"%d\n" % i)
            q.processAllAvailable()
        with open(os.path.join(base, "a.txt"), "wb") as f:  # shorter: left alone until it is longer again
            f.write(b"9\n")
        q.processAllAvailable()
        assert sorted(r.line for r in spark.table("grown").collect()) == ["1", "2", "3"]
    finally:
        q.stop()


@pytest.mark.parametrize("query", ["scan_logs", "last_metric_step_in_files"])
def test_landed_files_are_read_and_deleted_in_slices(spark, monkeypatch, query):
    """However much is landed in all, the files of one slice are there at a time, and the rows stay the same."""
    from quire.plans.catalog import REGISTRY
    from quire.sources import fs
    base = tempfile.mkdtemp(prefix="quire-slices-")
    spark.createDataFrame([(k, n, "ANR"[k % 3], "OF"[k % 2], 1000.0 * n + k, 5.0, 0.1 * (k % 2), 0.01 * n, f"1995-01-0{n}", n, k)
                           for k in range(40) for n in range(1, 1 + k % 7)],
                          "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_extendedprice double, "
                          "l_quantity double, l_discount double, l_tax double, l_shipdate string, l_partkey long, l_suppkey long"
                          ).write.parquet(f"{base}/lineitem.parquet")
    spark.createDataFrame([(k, "word é\n" * (k * 40) if k % 5 else None) for k in range(40)], "doc_id long, text string").write.parquet(
        f"{base}/documents.parquet")
    rows = lambda: sorted(map(tuple, REGISTRY[query].plan(spark, base).collect()))
    want = rows()
    most, gone = [], []
    real = fs.delete_folder

    def delete(folder):
        most.append(sum(size + logs.FILE_BLOCK for _, size in tf.list_files(folder, "*", True)))
        real(folder)
        gone.append(not fs.exists(folder))

    monkeypatch.setattr(fs, "delete_folder", delete)
    monkeypatch.setattr(logs, "LANDED_BYTES", 100_000)
    assert rows() == want and want
    assert len(most) > 1 and all(gone) and max(most) < sum(most)


def test_logs_are_dealt_out_and_their_rows_computed_once(spark, monkeypatch):
    """Every writer has a folder of its own, a try that died leaves nothing to read, and slices do not compute
    the rows again."""
    base = tempfile.mkdtemp(prefix="quire-dealt-")
    want = sorted((str(run), n, f"line {n} é") for run in range(30) for n in range(1, 1 + run % 4))
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            computed.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame(want, "run_id string, line_no long, line string").mapInPandas(
        count, "run_id string, line_no long, line string")
    landed = logs.land_log_files(rows, f"{base}/logs", deal=True).collect()
    assert all(os.path.dirname(r.path).startswith(f"{base}/logs/part-") and r.n_lines == int(r.run_id) % 4 for r in landed)
    writers = {}
    for r in landed:
        writers.setdefault(os.path.dirname(r.path), []).append(r.run_id)
    assert len(writers) > 1 and sorted(x for w in writers.values() for x in w) == sorted({r[0] for r in want})
    shutil.copytree(os.path.dirname(landed[0].path), f"{base}/logs/_part-00000-dead")
    assert sorted(map(tuple, logs.scan_logs(spark, f"{base}/logs", dealt=True).collect())) == want
    before = computed.value
    monkeypatch.setattr(logs, "LANDED_BYTES", 20_000)
    got = logs.land_and_read(rows, "run_id", "logs", lambda part, dest: logs.land_log_files(part, dest, deal=True),
                             lambda dest: logs.scan_logs(spark, dest, dealt=True), 22, 1000, staged=True)
    assert sorted(map(tuple, got.collect())) == want
    assert computed.value - before == len(want)


def test_files_grow_by_what_is_new_whatever_a_try_before_has_left(spark):
    base = tempfile.mkdtemp(prefix="quire-growth-")
    grow = lambda *rows: logs.grow_text(spark.createDataFrame(
        rows, "relpath string, line_no long, line string, start long"), base).collect()
    read = lambda: open(f"{base}/a/1.txt", "rb").read()
    grow(("a/1.txt", 2, "two", 0), ("a/1.txt", 1, "one", 0))
    inode = os.stat(f"{base}/a/1.txt").st_ino
    assert read() == b"one\ntwo\n"
    grow(("a/1.txt", 3, "é", 8))
    assert read() == "one\ntwo\né\n".encode() and os.stat(f"{base}/a/1.txt").st_ino == inode  # not written again
    grow(("a/1.txt", 3, "é", 8))  # the same task again
    assert read() == "one\ntwo\né\n".encode()
    with pytest.raises(Exception, match="of 99 bytes"):
        grow(("a/1.txt", 4, "x", 99))
