"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire import session
from quire.session import checkpoint_dir

__all__ = ["ASCII_UPPER", "ASCII_LOWER", "table", "stage", "scratch_path", "fold", "column_of", "append_columns", "maybe_among",
           "labelled_sample", "sliced", "fresh"]

#: Rows of an Arrow batch: whole texts are long, and both sides of the pipe hold a batch.
ARROW_ROWS = 2048
_ARROW_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus by name; from here on the session makes Arrow batches of at most
    :data:`ARROW_ROWS` rows."""
    if not 0 < int(spark.conf.get(_ARROW_ROWS_KEY)) <= ARROW_ROWS:
        spark.conf.set(_ARROW_ROWS_KEY, str(ARROW_ROWS))
    return session.table(spark, sf_dir, name)


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, whatever reads it,
    and a lineage that a lost executor cannot reach behind."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of the filter below: at most 2^19 rows of (word, bits), about 20 MB, are broadcast.
KEY_BITS = 1 << 25


def maybe_among(df: DataFrame, key, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a flag ``name``: false where the 64-bit ``key`` is surely not in the one column of
    ``keys``.  A bitmap of fixed size, whatever the number of keys, joined by a broadcast; rows it
    lets through need an exact join, the others need not be shuffled for one."""
    bit = lambda k: k.bitwiseAND(F.lit(KEY_BITS - 1).cast("long"))
    mask = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    k = F.col(keys.columns[0])
    word, bits = fresh(df, "__word", "__bits")
    words = keys.groupBy(F.shiftright(bit(k), 6).alias(word)).agg(F.bit_or(mask(k)).alias(bits))
    out = df.withColumn(word, F.shiftright(bit(key), 6)).join(F.broadcast(words), word, "left")
    found = F.coalesce(F.col(bits), F.lit(0).cast("long")).bitwiseAND(mask(key)) != 0
    return out.withColumn(name, found).drop(word, bits)


def fold(id_col, buckets: int):
    """crc32 of the id as text, modulo ``buckets``: the train / held-out split key."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % buckets


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: Rows whose texts are Python objects at the same time.
SLICE_ROWS = 1024


def sliced(batches):
    """The batches in slices of at most :data:`SLICE_ROWS` rows.  A worker that is used again first gives
    back what the task before has freed."""
    pa.default_memory_pool().release_unused()
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def append_columns(df: DataFrame, columns: dict[str, str], compute) -> DataFrame:
    """``df`` with new columns (name -> type) that ``compute(texts) -> list of Arrow arrays`` derives
    from its ``text`` column, in slices of batches.  ``compute`` is made once per task by calling it
    without arguments: ``compute() -> function``."""
    names = list(columns)

    def run(batches):
        f = compute()
        for b in sliced(batches):
            arrays = f(column_of(b, "text"))
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *names])

    added = [StructField(n, StructType.fromDDL(f"x {t}")["x"].dataType) for n, t in columns.items()]
    return df.mapInArrow(run, StructType([*df.schema.fields, *added]))


def labelled_sample(labels: DataFrame, label: str, train, bound: int) -> DataFrame:
    """(doc_id, label) of at most ``bound`` labelled rows for which ``train`` holds, chosen by a hash
    of the id; repeated ids count once, with their larger label."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(train)
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
