"""``token_bin``: the training shard format as a Spark Python data source.

File = 256 little-endian int32 header (magic 20240520, version 1, token
count, zeros) + the tokens as little-endian uint16.

Read: ``spark.read.format("token_bin").load(glob)``.  Partitions are
(file, token range) slices of ``chunk_tokens`` tokens from a file listing, so
one 100M-token shard is read by many tasks and small files share one; the
tasks open the files and check header and size.  Rows are (path, start, tokens ARRAY<INT>) of at most ``row_tokens`` tokens.
Filters on ``path`` and ``start`` are pushed down: files and slices that they
rule out are neither planned nor opened.
With ``.option("header_only", "true")`` it reads only the headers:
(path, magic, version, num_tokens, file_bytes).  :func:`read_ranges` reads
given token ranges of given files, each by one ranged read.

Write: rows (name, shard_pos, n_tokens, tokens) hash-partitioned by ``name`` and
sorted by ``shard_pos`` -- see :func:`write_shards` -- become one file per
name, written to a temporary name and renamed (a retried task rewrites it).
Tokens go from Arrow's buffers to the file; no Python list is made of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage)

from quire.functions.columns import SHARD_HEADER_INTS, SHARD_MAGIC, SHARD_VERSION
from quire.sources import fs

HEADER_BYTES = SHARD_HEADER_INTS * 4


def read_header(path: str) -> tuple[int, int, int, int]:
    size = fs.size(path)
    head = np.frombuffer(fs.read_range(path, 0, min(HEADER_BYTES, size) // 4 * 4), dtype="<i4")
    if head.size < 3:
        raise ValueError(f"{path}: short header")
    return int(head[0]), int(head[1]), int(head[2]), size


def check_header(path: str) -> int:
    magic, version, n, size = read_header(path)
    if magic != SHARD_MAGIC:
        raise ValueError(f"{path}: magic number mismatch")
    if version != SHARD_VERSION:
        raise ValueError(f"{path}: unsupported version {version}")
    if size != HEADER_BYTES + 2 * n:
        raise ValueError(f"{path}: size {size} does not match {n} tokens")
    return n


class _Slices(InputPartition):
    """(path, first token, tokens) slices that one task reads."""

    def __init__(self, slices: list[tuple[str, int, int]]):
        super().__init__(tuple(slices))
        self.slices = slices


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern = options.get("path") or options.get("paths")
        self.header_only = str(options.get("header_only", "false")).lower() == "true"
        self.chunk = int(options.get("chunk_tokens", 1 << 24))
        self.row_tokens = int(options.get("row_tokens", 1 << 16))
        self.files_per_task = int(options.get("files_per_task", 256))
        self.wanted: list = []  # predicates on a path
        self.first, self.end = 0, 1 << 62  # of ``start``

    def pushFilters(self, filters):
        """Narrow the files and the slices.  Every filter is handed back: rows of a slice that is read
        may still fail it."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("path",):
                test = {EqualTo: value.__eq__, StringStartsWith: lambda p, v=value: p.startswith(v),
                        StringEndsWith: lambda p, v=value: p.endswith(v), In: lambda p, v=value: p in v}.get(type(f))
                if test is not None:
                    self.wanted.append(test)
            elif column == ("start",) and not self.header_only:
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.end = min(self.end, value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self):
        """Slices from one listing with sizes; no file is opened here."""
        files = [(f, size) for f, size in fs.listing(self.pattern) if all(test(f) for test in self.wanted)]
        if self.header_only:
            names = [(f, 0, 0) for f, _ in files]
            return [_Slices(names[i:i + self.files_per_task]) for i in range(0, len(names), self.files_per_task)] or [_Slices([])]
        parts: list[list] = []
        room = 0
        for f, size in files:
            n = max(0, size - HEADER_BYTES) // 2
            for s in range(0, max(n, 1), self.chunk):  # a file without tokens is checked too
                count = min(self.chunk, n - s)
                if s >= self.end or s + max(count, 1) <= self.first:
                    continue
                # rows begin every ``row_tokens`` of a slice: skip those before the first wanted one
                skip = min(max(0, self.first - s) // self.row_tokens * self.row_tokens, max(count - 1, 0) // self.row_tokens * self.row_tokens)
                last = -(-min(count, self.end - s) // self.row_tokens) * self.row_tokens
                s, count = s + skip, min(count, last) - skip
                if count > room or len(parts[-1]) >= self.files_per_task:
                    parts.append([])
                    room = self.chunk
                parts[-1].append((f, s, count))
                room -= count
        return [_Slices(p) for p in parts] or [_Slices([])]

    def read(self, partition: _Slices):
        if self.header_only:
            for path, _, _ in partition.slices:
                yield (path, *read_header(path))
            return
        for path, start, count in partition.slices:
            check_header(path)
            # ranged reads of a row group each (local file, HDFS or object store alike)
            step = self.row_tokens * max(1, (1 << 20) // self.row_tokens)
            for at in range(start, start + count, step):
                n = min(step, start + count - at)
                body = np.frombuffer(fs.read_range(path, HEADER_BYTES + 2 * at, 2 * n), dtype="<u2").astype(np.int32)
                starts = np.arange(0, n, self.row_tokens)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pa.array(body))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(starts)), pa.array(starts + at, pa.int64()), lists],
                    names=["path", "start", "tokens"])


class _Commit(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


def _flat_tokens(column: pa.Array, what: str) -> np.ndarray:
    """All tokens of an Arrow list column, checked to fit in two bytes."""
    tokens = column.flatten().to_numpy(zero_copy_only=False)
    if tokens.size and (tokens.min() < 0 or tokens.max() > 65535):
        raise ValueError(f"{what}: token ids must fit in uint16")
    return tokens.astype("<u2")


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.dest = options["path"]

    def write(self, batches):
        """Rows come sorted by name, so a file's rows are consecutive, over batches too."""
        written: list[tuple[str, int]] = []
        name, total, count, target, out = None, 0, 0, None, None

        def finish():
            if count != total:
                raise ValueError(f"{name}: {count} tokens where {total} were announced")
            target.__exit__(None, None, None)
            written.append((name, total))

        try:
            for b in batches:
                col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
                names, lists, totals = col("name"), col("tokens"), col("n_tokens")
                at = 0
                while at < b.num_rows:
                    this = names[at].as_py()
                    if this != name:
                        if target is not None:
                            finish()
                            target = None
                        name, total, count = this, int(totals[at].as_py()), 0
                        header = np.zeros(SHARD_HEADER_INTS, dtype="<i4")
                        header[:3] = SHARD_MAGIC, SHARD_VERSION, total
                        target = fs.stream_atomic(fs.join(self.dest, name))
                        out = target.__enter__()
                        out.write(header.tobytes())
                    end = at + 1
                    while end < b.num_rows and names[end].as_py() == name:
                        end += 1
                    tokens = _flat_tokens(lists.slice(at, end - at), name)
                    out.write(tokens.tobytes())
                    count += tokens.size
                    at = end
            if target is not None:
                finish()
                target = None
        finally:
            if target is not None:  # an error: the draft is not renamed
                out.close()
        return _Commit(written)


class TokenBinDataSource(DataSource):
    @classmethod
    def name(cls):
        return "token_bin"

    def schema(self):
        if str(self.options.get("header_only", "false")).lower() == "true":
            return "path string, magic int, version int, num_tokens long, file_bytes long"
        return "path string, start long, tokens array<int>"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenBinDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_shards(pieces: DataFrame, dest: str, counts: DataFrame | None = None) -> None:
    """K1: one ``.bin`` file per ``name`` from (name, shard_pos, tokens) rows.  The headers need the
    counts first, so a file is streamed piece by piece; ``counts`` (name, n_tokens) saves
    computing the pieces for them."""
    register(pieces.sparkSession)
    if counts is None:
        counts = pieces.groupBy("name").agg(F.sum(F.size("tokens")).alias("n_tokens"))
    (pieces.select("name", "shard_pos", "tokens").join(counts.select("name", "n_tokens"), "name").repartition("name")
     .sortWithinPartitions("name", "shard_pos")
     .write.format("token_bin").mode("append").option("path", dest).save())


def read_shards(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """S3: token rows of every shard matching ``pattern``."""
    register(spark)
    r = spark.read.format("token_bin")
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(pattern)


def read_ranges(ranges: DataFrame, path: str = "path", spans: str = "spans", out_tokens: int = 1 << 20) -> DataFrame:
    """``ranges`` with ``tokens`` ARRAY<INT>: of each row's file the token ranges ``spans``
    (ARRAY<STRUCT<start, end>>, ends exclusive) one after another.  Each is one ranged read; a task
    opens and checks a file once, and hands on about ``out_tokens`` tokens at a time.  Ranges of a file
    that lie near each other go to one task."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = F.expr(f"{spans}[0].start div {1 << 22}")
    kept = ranges.columns
    schema = StructType([*ranges.schema.fields, StructField("tokens", ArrayType(IntegerType()))])

    def run(batches):
        opened: dict[str, tuple] = {}  # the file read last
        for b in batches:
            places = b.column(kept.index(path)).to_pylist()
            lists = b.column(kept.index(spans))
            first = lists.offsets.to_numpy()
            flat = lists.values
            lo, hi = (flat.field(i).to_numpy() for i in (0, 1))
            at, parts, ends, held = 0, [], [0], 0

            def batch(upto):
                tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                return pa.RecordBatch.from_arrays(
                    [*(c.slice(at, upto - at) for c in b.columns),  # noqa: B023
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32()))],
                    names=[*kept, "tokens"])

            for i, place in enumerate(places):
                if place not in opened:
                    for file, _ in opened.values():
                        file.close()
                    opened = {place: (fs.open_file(place), check_header(place))}
                file, count = opened[place]
                for k in range(first[i], first[i + 1]):
                    start, end = int(lo[k]), int(hi[k])
                    if not 0 <= start <= end <= count:
                        raise ValueError(f"{place}: tokens {start} to {end} of {count}")
                    parts.append(np.frombuffer(file.read_at(2 * (end - start), HEADER_BYTES + 2 * start), "<u2").astype(np.int32))
                    held += end - start
                ends.append(held)
                if held >= out_tokens:
                    yield batch(i + 1)
                    at, parts, ends, held = i + 1, [], [0], 0
            if at < len(places):
                yield batch(len(places))

    return ranges.repartition(n, F.col(path), near).sortWithinPartitions(path, F.expr(f"{spans}[0].start")).mapInArrow(run, schema)


def shard_inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """Headers only (no body read) -> per file token count and validity."""
    register(spark)
    h = spark.read.format("token_bin").option("header_only", "true").load(pattern)
    valid = ((F.col("magic") == SHARD_MAGIC) & (F.col("version") == SHARD_VERSION)
             & (F.col("file_bytes") == HEADER_BYTES + 2 * F.col("num_tokens")))
    return h.withColumn("valid", valid)
