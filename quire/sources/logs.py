"""Run-log files: land one text file per run, scan a folder of them."""

from __future__ import annotations

import gzip
import itertools
import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir
from quire.sources import fs
from quire.sources.text_files import RANGE_BYTES, numbered_lines


def landing_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = checkpoint_dir(spark)
    path = fs.join(base, "quire-landing", f"{name}-{uuid.uuid4().hex[:12]}")
    return path


def land_log_files(log_lines: DataFrame, dest: str, partitions: int | None = None, deal: bool = False) -> DataFrame:
    """Write ``<run_id>.txt`` per run under ``dest`` (one writer task per hash
    partition of runs, lines in ``line_no`` order); returns (run_id, path, n_lines).  With ``deal``
    each task writes to a folder of its own: tasks that add files to one folder wait for each other."""
    files = log_lines.select(F.concat("run_id", F.lit(".txt")).alias("relpath"), "line_no", "line")
    out = land_text(files, dest, partitions=partitions, deal=deal)
    run_id = F.regexp_extract("relpath", r"^part-\d+/(.*)\.txt$" if deal else r"^(.*)\.txt$", 1)
    return out.select(run_id.alias("run_id"),
                      F.concat(F.lit(dest.rstrip("/") + "/"), "relpath").alias("path"), "n_lines")


def scan_logs(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, dealt: bool = False) -> DataFrame:
    """Top-level ``*.txt`` of ``folder``, or with ``dealt`` those that :func:`land_log_files` dealt out to
    folders in it -> (run_id, line_no, line).  Files are read in byte ranges
    (:func:`quire.sources.text_files.numbered_lines`), so a long log is several tasks.  A final newline
    does not make an extra empty line."""
    run_id = F.regexp_extract("path", r"^part-\d+/(.*)\.txt$" if dealt else r"^(.*)\.txt$", 1)
    return numbered_lines(spark, folder, "*.txt", dealt, range_bytes).select(run_id.alias("run_id"), "line_no", "line")


def land_text(lines: DataFrame, dest: str, path_col: str = "relpath", order: str = "line_no",
              partitions: int | None = None, compress: bool = False, deal: bool = False) -> DataFrame:
    """Write text files ``<dest>/<relpath>`` (gzip with ``compress``) from
    (relpath, line_no, line) rows, lines in ``line_no`` order, one writer per
    hash partition of files.  Lines stream to the file; none are held.  With
    ``deal`` a task's files go to ``<dest>/part-<task>/<relpath>`` all at once."""
    df = lines.select(F.col(path_col).alias("relpath"), F.col(order).alias("line_no"), "line")
    # a given number: small lines are still many files, which one task would write one after another
    df = df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "relpath")
    df = df.sortWithinPartitions("relpath", "line_no")

    def files(batches, opened, prefix=""):
        rows = (r for pdf in batches for r in zip(pdf["relpath"], pdf["line"]))
        out = []
        for rel, group in itertools.groupby(rows, key=lambda r: r[0]):
            n = 0
            with opened(rel) as raw:
                sink = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if compress else raw
                for _, line in group:
                    sink.write((line + "\n").encode("utf-8"))
                    n += 1
                if compress:
                    sink.close()
            out.append((prefix + rel, n))
        return pd.DataFrame(out, columns=["relpath", "n_lines"])

    def write(batches):
        if not deal:
            yield files(batches, lambda rel: fs.stream_atomic(fs.join(dest, rel)))
            return
        part = f"part-{TaskContext.get().partitionId():05d}"
        with fs.folder_atomic(fs.join(dest, part)) as (store, folder):
            landed = files(batches, lambda rel: store.open_output_stream(f"{folder}/{rel}"), part + "/")
        yield landed

    return df.mapInPandas(write, "relpath string, n_lines long")


def grow_text(lines: DataFrame, dest: str, partitions: int | None = None, key: str = "relpath") -> DataFrame:
    """Let text files ``<dest>/<relpath>`` grow by (relpath, line_no, line, start) rows: lines in ``line_no``
    order behind the first ``start`` bytes, one writer per hash partition of files, or of another ``key``
    that a file's rows share.  A task that is tried again replaces what it had written.  Returns (relpath, n_lines)."""
    df = lines
    df = df.repartition(partitions or file_tasks(df.sparkSession), key)
    df = df.select("relpath", "line_no", "line", "start").sortWithinPartitions("relpath", "line_no")

    def write(batches):
        store, root = fs.resolve(dest)
        rows = (r for pdf in batches for r in zip(pdf["relpath"], pdf["start"], pdf["line"]))
        out = []
        for (rel, start), group in itertools.groupby(rows, key=lambda r: r[:2]):
            n = 0
            with fs.stream_after(store, fs.join(root, rel), int(start)) as sink:
                for _, _, line in group:
                    sink.write((line + "\n").encode("utf-8"))
                    n += 1
            out.append((rel, n))
        yield pd.DataFrame(out, columns=["relpath", "n_lines"])

    return df.mapInPandas(write, "relpath string, n_lines long")


def land_files(files: DataFrame, dest: str, path_col: str = "relpath", content: str = "content") -> DataFrame:
    """Write each row's ``content`` as the file ``<dest>/<relpath>``, byte for byte, replacing what is
    there; returns (relpath, bytes)."""

    def write(batches):
        for pdf in batches:
            sizes = []
            for rel, text in zip(pdf["relpath"], pdf["content"]):
                data = (text or "").encode("utf-8")
                fs.write_atomic(fs.join(dest, rel), data)
                sizes.append(len(data))
            yield pd.DataFrame({"relpath": pdf["relpath"], "bytes": sizes})

    return files.select(F.col(path_col).alias("relpath"), F.col(content).alias("content")).mapInPandas(
        write, "relpath string, bytes long")


#: Disk that landed files may take at a time, and the block that the smallest file takes.  Deleting small
#: files costs more than writing them, so a slice is as large as the disk allows.
LANDED_BYTES = 8 << 30
FILE_BLOCK = 4096


def land_and_read(rows: DataFrame, key: str, name: str, land, read, n_files: int, n_bytes: int,
                  staged: bool = False) -> DataFrame:
    """``read(folder)`` after ``land(rows, folder)``, for rows whose files (``n_files`` of ``n_bytes`` in all)
    are told apart by ``key``.

    Files that take more than ``LANDED_BYTES`` are landed and read a slice of the keys at a time: what a
    slice gave is kept as Parquet and its files are deleted before the next one, so the disk in use does
    not grow with the landed text, nor the listing with the number of files.  With ``staged`` the rows are
    computed once and kept by slice, not once per slice."""
    spark = rows.sparkSession
    slices = -(-(n_files * FILE_BLOCK + n_bytes) // LANDED_BYTES)
    if slices <= 1:
        dest = landing_dir(spark, name)
        land(rows, dest).count()  # the sink runs here
        return read(dest)
    of_slice = F.pmod(F.xxhash64(key), F.lit(slices))
    if staged:
        rows = by_part(rows.withColumn("_slice", of_slice), "_slice", slices, key, f"{name}-rows")
        of_slice = F.col("_slice")
    found = landing_dir(spark, f"{name}-found")
    for k in range(slices):
        dest = landing_dir(spark, name)
        land(rows.where(of_slice == k), dest).count()
        read(dest).write.parquet(fs.join(found, f"part-{k:05d}"))
        fs.delete_folder(dest)
    return spark.read.parquet(*[fs.join(found, f"part-{k:05d}") for k in range(slices)])


def file_tasks(spark: SparkSession) -> int:
    """Tasks that write many files each: a few per core, and no more than the shuffle partitions."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def by_part(rows: DataFrame, part: str, parts: int, key: str, name: str) -> DataFrame:
    """The rows as Parquet with a folder per value of ``part`` (``parts`` whole numbers): computed once,
    and a reader of one part reads its files only.  Rows of a ``key`` stay together."""
    spark = rows.sparkSession
    tasks = file_tasks(spark)
    path = landing_dir(spark, name)
    salt = F.pmod(F.hash(key), F.lit(max(1, tasks // max(parts, 1))))
    rows.repartition(tasks, F.col(part), salt).write.partitionBy(part).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def scan_text_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(relpath, line_no, line) of every matching file under ``folder`` (recursive)."""
    return numbered_lines(spark, folder, glob, True, range_bytes).select(F.col("path").alias("relpath"), "line_no", "line")
