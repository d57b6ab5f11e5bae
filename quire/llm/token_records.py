"""Token ids as length-delimited binary records with an offset index.

File format.  A record file is a sequence of frames

    length   u64 little-endian, bytes of the payload
    check    u32, masked checksum of the length bytes
    payload  the serialized sequence
    check    u32, masked checksum of the payload

and a payload is ``flags u8 (1: the document has an id), doc_id i64, width u8 (bytes of an id: 2 or
4), ids``.  The checksum is CRC-32, masked by rotating it right 15 bits and adding 0xA282EAD8, so
that a checksum of bytes that hold checksums stays useful.  The index file beside it (``.idx``) has
one 24-byte entry per record -- offset u64, frame bytes u64, ids u64 -- so records can be read in
any order without reading the file before them.

Scale.  Texts are tokenized where they are read, and their ids, in as many bytes as a record has, move
to the file they belong to: files are ranges of (doc_id, hash of the text) between approximate
quantiles of the ids, so the files in order hold ascending ids, and an id of very many rows is spread
over several files by the hash.  Each task streams frames to one file in the shared folder (written
under a temporary name and renamed: a retried task replaces its file).  Only one manifest row per file
is kept (path, records, ids); first positions are running sums over that manifest and over a file's
index.  Reading is a task per file slice, which reads its slice of the index and then its frames.

Defined cases.  Null and empty texts are sequences of the end id alone.  A null doc_id sorts first
and comes back null; repeated doc_ids keep all their rows, in the order of their texts' hashes, so a
task that runs again writes the same file.  A frame whose length or checksum does not hold raises an
error.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import column_of, scratch_path
from quire.llm.tokens import encoder
from quire.sources import fs

_LENGTH = struct.Struct("<Q")
_CHECK = struct.Struct("<I")
_HEAD = struct.Struct("<BqB")
INDEX_ENTRY = np.dtype([("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u8")])
_MASK = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CHECK.pack(masked_crc(length)), payload, _CHECK.pack(masked_crc(payload))))


def unframe(data: memoryview) -> tuple[memoryview, int]:
    """(payload, bytes of the whole frame) of the frame that ``data`` starts with."""
    if len(data) < 16:
        raise ValueError("record file ends inside a frame")
    if _CHECK.unpack_from(data, 8)[0] != masked_crc(data[:8]):
        raise ValueError("length checksum does not hold")
    n = _LENGTH.unpack_from(data)[0]
    if len(data) < n + 16:
        raise ValueError("record file ends inside a frame")
    payload = data[12:12 + n]
    if _CHECK.unpack_from(data, 12 + n)[0] != masked_crc(payload):
        raise ValueError("payload checksum does not hold")
    return payload, n + 16


def serialize(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """``ids``: little-endian, ``width`` bytes each."""
    return _HEAD.pack(doc_id is not None, doc_id or 0, width) + ids


def deserialize(payload) -> tuple[int | None, np.ndarray]:
    has_id, doc_id, width = _HEAD.unpack_from(payload)
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype("<u4")


MANIFEST = "file_no int, path string, n_records long, n_ids long, index_steps array<long>"
#: Records between two entries of ``index_steps``, the ids before each such record.
STEP_RECORDS = 1 << 14
#: Text bytes of about one file.
FILE_BYTES = 64 << 20


def file_of(docs: DataFrame, files: int):
    """The number of each row's file, a column over (doc_id, text_hash): files are cut at quantiles of
    the ids; an id that several quantiles fall on owns all their files, and its rows go to them by
    ranges of the hash."""
    probs = [i / files for i in range(1, files)]
    found = docs.approxQuantile("doc_id", probs, 1 / (4 * files)) if files > 1 else []
    bounds = sorted({int(b): found.count(b) for b in found}.items())
    before = [0]
    for _, n in bounds:
        before.append(before[-1] + n)

    def place(lo: int, hi: int):  # of the ids from bounds[lo - 1] on and below bounds[hi], by halving
        if lo == hi:
            if lo == 0:
                return F.lit(0)
            last, n = before[lo], bounds[lo - 1][1]
            if n == 1:
                return F.lit(last)
            share = F.floor((F.shiftrightunsigned("text_hash", 32).cast("double") / float(1 << 32)) * n).cast("int")
            return F.when(F.col("doc_id") == bounds[lo - 1][0], F.lit(last - n + 1) + share).otherwise(F.lit(last))
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= F.lit(bounds[mid][0]), place(mid + 1, hi)).otherwise(place(lo, mid))

    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place(0, len(bounds))).cast("int")


def token_ids(docs: DataFrame, tokenizer_path: str, style: str, end_id: int, width: int,
              plain_specials: bool = True) -> DataFrame:
    """(doc_id, text_hash, ids): the ids of whole texts with the end id, ``width`` bytes each."""
    end = np.array([end_id], f"<u{width}").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer_path, style, plain_specials).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids = [encode(t) for t in column_of(b, "text")]
                if width == 2:  # the lower halves of all
                    data = np.frombuffer(b"".join(ids), "<u2")[::2].tobytes()
                    ends = np.cumsum([0, *(len(i) // 2 for i in ids)]).tolist()
                    ids = [data[a:z] for a, z in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i + end for i in ids], pa.binary())],
                                                 names=["doc_id", "text_hash", "ids"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, ids binary")


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, style: str, end_id: int, width: int = 4,
                  files: int | None = None, plain_specials: bool = True) -> DataFrame:
    """Tokenize ``docs(doc_id, text)`` and write record and index files, ascending by doc_id.
    Runs the job and returns the manifest (kept as Parquet in ``folder``)."""
    spark = docs.sparkSession
    if files is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def run(batches):
        no = TaskContext.get().partitionId()
        target = f"{folder}/part-{no:06d}.rec"
        store, path = fs.resolve(target)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        draft = f"{path}.{uuid.uuid4().hex[:8]}"
        at, total, records, steps, index = 0, 0, 0, [], []
        with store.open_output_stream(draft) as out, fs.stream_atomic(target[:-4] + ".idx") as entries:
            for b in batches:
                for doc_id, ids in zip(column_of(b, "doc_id"), column_of(b, "ids")):
                    data = frame(serialize(doc_id, ids, width))
                    out.write(data)
                    if records % STEP_RECORDS == 0:
                        steps.append(total)
                    index.append((at, len(data), len(ids) // width))
                    at += len(data)
                    total += len(ids) // width
                    records += 1
                entries.write(np.array(index, INDEX_ENTRY).tobytes())
                index = []
        store.move(draft, path)
        yield pa.RecordBatch.from_arrays(
            [pa.array([no], pa.int32()), pa.array([target]), pa.array([records], pa.int64()),
             pa.array([total], pa.int64()), pa.array([steps], pa.list_(pa.int64()))],
            names=["file_no", "path", "n_records", "n_ids", "index_steps"])

    rows = token_ids(docs, tokenizer_path, style, end_id, width, plain_specials)
    (rows.repartitionById(files, file_of(docs, files)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_hash")
     .drop("text_hash").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest"))
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_records(manifest: DataFrame, slice_records: int = STEP_RECORDS) -> DataFrame:
    """Read the files of a manifest back by their index: doc_id, start (ids of all records before
    it), n_tokens, ids (little-endian unsigned 32-bit).  A task reads slices of at most
    ``slice_records`` records; slices may be read in any order."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    first = F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1, F.lit(slice_records).cast("long"))
    slices = (manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
              .filter("n_records > 0").withColumn("first", F.explode(first))
              .select("path", "first", "n_records",
                      (F.col("base") + F.element_at("index_steps", F.expr(f"CAST(first div {STEP_RECORDS} AS INT) + 1"))).alias("start")))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            for path, start, first, n_records in zip(*(column_of(b, c) for c in ("path", "start", "first", "n_records"))):
                count, skip = min(slice_records, n_records - first), first % STEP_RECORDS  # known ids are before the step
                index = np.frombuffer(fs.read_range(path[:-4] + ".idx", (first - skip) * INDEX_ENTRY.itemsize,
                                                    (skip + count) * INDEX_ENTRY.itemsize), INDEX_ENTRY)
                starts = (start + np.concatenate([[0], np.cumsum(index["ids"].astype(np.int64))]))[skip:]
                index = index[skip:]
                ends = (index["offset"] + index["bytes"]).astype(np.int64)
                i = 0
                while i < count:  # about 8 MB of the file at a time
                    at = int(index["offset"][i])
                    upto = max(i + 1, int(np.searchsorted(ends, at + (8 << 20), "right")))
                    data = memoryview(fs.read_range(path, at, int(ends[upto - 1]) - at))
                    got, pos = [], 0
                    for k in range(i, upto):
                        payload, size = unframe(data[pos:])
                        if size != index["bytes"][k]:
                            raise ValueError("index and frame differ")
                        got.append(deserialize(payload))
                        pos += size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[0] for g in got], pa.int64()), pa.array(starts[i:upto], pa.int64()),
                         pa.array([len(g[1]) for g in got], pa.int64()),
                         pa.array([g[1].tobytes() for g in got], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    i = upto

    return (slices.repartition(n, "path", "first")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))


def op8_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.common import table
    manifest = write_records(table(spark, sf_dir, "documents"), scratch_path(spark, "records"),
                             public_tokenizers.path("byte_bpe_50k.json"), "bytes", end_id=0, width=2, plain_specials=False)
    return read_records(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
