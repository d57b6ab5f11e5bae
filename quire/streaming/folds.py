"""Keyed folds of the change feeds as typed streaming state (``transformWithState``).

Each fold is a processor whose state is declared as typed values and maps in the RocksDB store; rows
of a key come as an iterator and leave the state in closed form, so the order of rows within a
micro-batch does not matter (E7 alone needs it and holds two numbers per event of the batch).  The
batch operators are the reference: a processor may start from a batch table as initial state, and after
any number of micro-batches its state equals the batch answer over all rows.

A key's rows of one micro-batch meet in one task.  Keys are groups of runs, entities and sessions: a run
writes one log, so its share of a micro-batch is what that log grew by.  Every key costs several calls
between Python and the store, far more than a row does, so ``GROUP_RUNS`` runs with neighbouring ids
share a key, and what is read and written together is one value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from quire.operators import merge, state

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started in this block keep their state in RocksDB; others keep the session's choice."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: Partitions of the state per core.
STATE_WAVES = 2


@contextmanager
def state_partitions(spark: SparkSession):
    """Queries started in this block cut their state into ``STATE_WAVES`` partitions a core, or the session's
    shuffle partitions if those are fewer: every micro-batch starts a Python process and opens a store for
    each partition, however few rows it has.  A checkpoint keeps the number it began with."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), STATE_WAVES * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Runs that share a key, and steps of theirs that share a value of the state.
GROUP_RUNS = 64
STEP_BLOCK = 1024


def _apply(rows: DataFrame, key: str, processor: StatefulProcessor, schema, initial: DataFrame | None) -> DataFrame:
    return rows.groupBy(key).transformWithState(
        processor, schema, "update", "none", None if initial is None else initial.groupBy(key))


def _part(column: str, size: int, name: str) -> Column:
    """The number of the part of ``size`` neighbouring values."""
    return F.expr(f"({column} - pmod({column}, {size})) div {size}").alias(name)


def _group() -> Column:
    return _part("experiment_id", GROUP_RUNS, "_group")


def _held(value: tuple | None) -> list:
    """The rows that a value of the state holds as JSON text."""
    return json.loads(value[0]) if value is not None else []


def _text(rows: list) -> tuple[str]:
    return (json.dumps(rows, separators=(",", ":"), ensure_ascii=False),)


#: The rows of a run that its summary shows: which rows, and which of their values.
TOPS = {"progress": ("total_steps",), "lv": ("val_loss", "train_time_ms", "step_avg_ms"),
        "lt": ("train_loss", "train_time_ms", "step_avg_ms"), "fv": ("val_loss", "train_time_ms"),
        "ft": ("train_loss", "train_time_ms")}
_TYPES = {"total_steps": "long", "val_loss": "double", "train_loss": "double", "train_time_ms": "long", "step_avg_ms": "double"}
_VALUES = merge.VALUE_COLUMNS
STEP_ROW = ", ".join([*(f"{c} {_TYPES[c]}" for c in _VALUES), "is_final_step boolean", "arrivals long"])
_TOP_FIELDS = [(top, f) for top, fields in TOPS.items() for f in ("step", *fields)]
TOP_ROW = ", ".join(f"{top}__{f} {_TYPES.get(f, 'long')}" for top, f in _TOP_FIELDS)
#: kind ``row``: a merged row that the batch touched; ``run``: a run that it changed, with its top rows
#: and the number of batches that have changed it.
METRIC_CHANGE = f"kind string, experiment_id long, step long, {STEP_ROW}, batches long, {TOP_ROW}"
_CHANGE = Row("kind", "experiment_id", "step", *_VALUES, "is_final_step", "arrivals", "batches", *(f"{t}__{f}" for t, f in _TOP_FIELDS))
_GATED = "event_id long, entity_id string, revision long, accepted boolean"


def _counts_for(top: str, row: dict) -> bool:
    """Whether a merged row may be the run's top row of this kind."""
    if top == "progress":
        return True
    loss = row["val_loss"] if top in ("lv", "fv") else row["train_loss"]
    return loss is not None and (top in ("lv", "lt") or row["is_final_step"])


class RunMetrics(StatefulProcessor):
    """Key: group of runs.  State: their merged rows, one value per block of steps (map), and their top
    rows with the number of batches that changed each run (value).  A row's value is the last one that is
    not null; those of earlier batches are earlier arrivals."""

    def init(self, handle) -> None:
        self.rows = handle.getMapState("rows", "block long", "rows string")
        self.runs = handle.getValueState("runs", "runs string")

    def _load(self) -> dict[int, tuple[int, dict]]:
        """Run -> (batches, its top rows)."""
        runs = {}
        for run, batches, *flat in _held(self.runs.get()):
            tops = {top: {} for top in TOPS}
            for (top, f), v in zip(_TOP_FIELDS, flat):
                tops[top][f] = v
            runs[run] = batches, {top: t if t["step"] is not None else None for top, t in tops.items()}
        return runs

    @staticmethod
    def _flat(tops: dict) -> tuple:
        return tuple(tops[top][f] if tops[top] else None for top, f in _TOP_FIELDS)

    def _store(self, runs: dict[int, tuple[int, dict]]) -> None:
        self.runs.update(_text([(run, batches, *self._flat(tops)) for run, (batches, tops) in runs.items()]))

    def _block(self, block: int) -> dict[tuple[int, int], tuple]:
        """(run, step) -> merged row."""
        return {(run, step): tuple(row) for run, step, *row in _held(self.rows.getValue((block,)))}

    def _store_block(self, block: int, rows: dict[tuple[int, int], tuple]) -> None:
        self.rows.updateValue((block,), _text([(*at, *row) for at, row in rows.items()]))

    @staticmethod
    def _raise(tops: dict, step: int, row: dict) -> None:
        for top, fields in TOPS.items():
            if _counts_for(top, row) and (tops[top] is None or step >= tops[top]["step"]):
                tops[top] = {"step": step, **{f: row[f] for f in fields}}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        touched: dict[tuple[int, int], dict] = {}  # (run, step) -> column -> (arrival, value)
        take = None
        for r in rows:
            if take is None:  # a row looks its names up one by one, a tuple is taken apart at once
                take = itemgetter(*(r.__fields__.index(c) for c in ("experiment_id", "step", "seq", "is_final_step", *_VALUES)))
            run, step, seq, final, *values = take(r)
            t = touched.get((run, step))
            if t is None:
                t = touched[run, step] = {"is_final_step": False, "arrivals": 0}
            t["arrivals"] += 1
            t["is_final_step"] |= bool(final)
            for c, v in zip(_VALUES, values):
                if v is not None and (c not in t or seq > t[c][0]):
                    t[c] = (seq, v)
        blocks: dict[int, list[tuple[int, int]]] = {}
        for at in sorted(touched):
            blocks.setdefault(at[1] // STEP_BLOCK, []).append(at)
        runs = self._load()
        known, changed = bool(runs), set()
        none = (None,) * (len(_TOP_FIELDS) + 1)
        for block in sorted(blocks):
            held = self._block(block) if known else {}
            for run, step in blocks[block]:
                t, old = touched[run, step], held.get((run, step))
                before = dict(zip((*_VALUES, "is_final_step", "arrivals"), old)) if old is not None else None
                row = {c: t[c][1] if c in t else before[c] if before else None for c in _VALUES}
                row["is_final_step"] = t["is_final_step"] or bool(before and before["is_final_step"])
                if before is None or any(row[c] != before[c] for c in row):
                    changed.add(run)
                row["arrivals"] = t["arrivals"] + (before["arrivals"] if before else 0)
                held[run, step] = tuple(row.values())
                self._raise(runs.setdefault(run, (0, dict.fromkeys(TOPS)))[1], step, row)
                yield _CHANGE("row", run, step, *row.values(), *none)
            self._store_block(block, held)
        for run in sorted(changed):
            batches, tops = runs[run]
            runs[run] = batches + 1, tops
            yield _CHANGE("run", run, None, *(None,) * (len(_VALUES) + 2), batches + 1, *self._flat(tops))
        if changed:
            self._store(runs)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """The merged rows of the batch table in one block of steps."""
        runs, held = self._load(), {}
        for r in initialState.rows:
            row = {c: r[c] for c in (*_VALUES, "is_final_step", "arrivals")}
            row["is_final_step"] = bool(row["is_final_step"])
            held[r["experiment_id"], r["step"]] = tuple(row.values())
            _, tops = runs.setdefault(r["experiment_id"], (1, dict.fromkeys(TOPS)))
            self._raise(tops, r["step"], row)
        self._store_block(initialState.block, held)
        self._store(runs)

    def close(self) -> None:
        pass


def fold_metrics(parsed: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Stream of parsed metric rows (experiment_id, seq, step, values) -> :data:`METRIC_CHANGE` rows.
    ``initial``: merged rows as :func:`quire.operators.merge.merge_metrics` gives them; a run in it
    counts as changed once."""
    rows = parsed.select(_group(), "experiment_id", "seq", "step", *_VALUES, "is_final_step")
    if initial is not None:  # at most GROUP_RUNS * STEP_BLOCK merged rows together
        initial = initial.groupBy(_group(), _part("step", STEP_BLOCK, "block")).agg(
            F.collect_list(F.struct("experiment_id", "step", *_VALUES, "is_final_step", "arrivals")).alias("rows"))
    return _apply(rows, "_group", RunMetrics(), METRIC_CHANGE, initial)


def tops_of(changes: DataFrame) -> DataFrame:
    """The ``run`` rows of :func:`fold_metrics` as :func:`quire.operators.summary.metric_tops` has them,
    with ``batches``."""
    structs = [F.struct(*[F.col(f"{top}__{f}").alias(f) for f in ("step", *fields)]).alias(top) for top, fields in TOPS.items()]
    return changes.where("kind = 'run'").select("experiment_id", "batches", *structs)


#: Maps and nested rows are kept in the state as JSON text (the store gives maps back empty).
_KEEP_NULLS = {"ignoreNullFields": "false"}
_MAPS = {"env_vars": "map<string,string>", "dependencies": "map<string,string>"}


class MappingFold(StatefulProcessor):
    """Key: group of runs.  State: the columns of :func:`quire.operators.state.mapping_state` of each run in
    one value, the fields of the first record flattened."""

    def __init__(self, schema: StructType):
        self.schema = schema  # the state's columns

    def init(self, handle) -> None:
        self.value = handle.getValueState("fold", "runs string")

    def _load(self) -> dict[int, dict]:
        return {run: dict(zip(self.schema.names, held)) for run, *held in _held(self.value.get())}

    def _store(self, runs: dict[int, dict]) -> None:
        self.value.update(_text([(run, *s.values()) for run, s in runs.items()]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.schema.names
        runs, touched = self._load(), set()

        def keep(at: str, seq: int, sign: int, **values) -> None:
            """Take the values if ``seq`` is the first (sign -1) or last (1) so far."""
            if s[at] is None or sign * seq > sign * s[at]:
                s[at] = seq
                s.update(values)

        for r in rows:
            seq, status = r.seq, r.status
            s = runs.setdefault(r.experiment_id, dict.fromkeys(names))
            touched.add(r.experiment_id)
            s["n_records"] = (s["n_records"] or 0) + 1
            keep("_first_seq", seq, -1, _first_status=status, **{f"_first_{c}": r[c] for c in state.AT_CREATION})
            if status in state.OBSERVED:
                keep("_last_known_seq", seq, 1, _last_known=status)
                if status not in state.TERMINAL:
                    keep("_last_open_seq", seq, 1)
            if status == "completed":
                keep("_first_completed_seq", seq, -1)
            if status == "failed" and r.crash_log is not None:
                keep("_crash_seq", seq, -1, crash_log=r.crash_log)
            for c in state.META:
                if r[c] is not None:
                    keep(f"_{c}_seq", seq, 1, **{c: r[c]})
        self._store(runs)
        row = Row("experiment_id", *names)
        for run in sorted(touched):
            yield row(run, *runs[run].values())

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """The state of all runs of the group."""
        self._store({r["experiment_id"]: {c: r[c] for c in self.schema.names} for r in initialState.runs})

    def close(self) -> None:
        pass


def _flat(folded: DataFrame) -> DataFrame:
    """The batch fold's state with the first record's fields as columns and maps as JSON text."""
    first = [F.col(f"_first.{c}").alias(f"_first_{c}") for c in ("status", *state.AT_CREATION)]
    out = folded.select(*[c for c in folded.columns if c != "_first"], *first)
    return out.withColumns({c: F.to_json(c, _KEEP_NULLS) for c in out.columns if c.removeprefix("_first_") in _MAPS})


def _nested(flat: DataFrame, columns: list[str]) -> DataFrame:
    """The opposite of :func:`_flat`."""
    out = flat.withColumns({c: F.from_json(c, _MAPS[c.removeprefix("_first_")]) for c in flat.columns if c.removeprefix("_first_") in _MAPS})
    first = F.struct(*[F.col(f"_first_{c}").alias(c) for c in ("status", *state.AT_CREATION)]).alias("_first")
    return out.select(*[first if c == "_first" else c for c in columns])


def fold_mappings(records: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Stream of mapping records (seq and the parsed columns) -> the fold's state of every run that
    the micro-batch touched.  ``initial``: a state table of :func:`quire.operators.state.mapping_state`."""
    records = records.withColumns({c: F.lit(None).cast("string") for c in state.META if c not in records.columns})
    # the state's columns are those of the batch fold over the same records
    batch = state.mapping_state(records.sparkSession.createDataFrame([], records.schema))
    schema = _flat(batch).schema
    value = StructType([f for f in schema.fields if f.name != "experiment_id"])
    rows = records.select(_group(), "experiment_id", "seq", "status", "crash_log", *state.AT_CREATION, *state.META).withColumns(
        {c: F.to_json(c, _KEEP_NULLS) for c in _MAPS})
    if initial is not None:  # at most GROUP_RUNS runs together
        flat = _flat(initial)
        initial = flat.groupBy(_group()).agg(F.collect_list(F.struct(*[F.col(c) for c in flat.columns])).alias("runs"))
    folded = _apply(rows, "_group", MappingFold(value), schema, initial)
    return _nested(folded, batch.columns)


class QueueFold(StatefulProcessor):
    """Key: session.  State: the accepted snapshot, and the last explicit connected flag."""

    names = ("at", "ts", "seq", "queue", "session_id", "connected", "said")

    def init(self, handle) -> None:
        self.value = handle.getValueState("accepted", QUEUE_STATE)

    @staticmethod
    def _rank(s) -> tuple:
        """Later instants win, text that is no instant loses to one, the first arrival wins ties."""
        return s["at"] is not None, s["at"] or 0, s["ts"] if s["at"] is None else "", -s["seq"]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.value.get()
        held = dict(zip(self.names, held)) if held is not None else None
        for r in rows:
            new = {c: r[c] for c in ("at", "ts", "seq", "queue", "session_id")}
            said = (r.connected, r.seq) if r.connected is not None else (None, None)
            if held is None:
                held = {**new, "connected": said[0], "said": said[1]}
                continue
            if self._rank(new) > self._rank(held):
                held.update(new)
            if said[1] is not None and (held["said"] is None or said[1] > held["said"]):
                held["connected"], held["said"] = said
        self.value.update(tuple(held[c] for c in self.names))
        yield Row("session", *self.names)(key[0], *(held[c] for c in self.names))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.value.update(tuple(initialState[c] for c in self.names))

    def close(self) -> None:
        pass


QUEUE_STATE = "at long, ts string, seq long, queue string, session_id string, connected boolean, said long"


def fold_queue(snapshots: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Stream of snapshots (session, seq, ts, queue; session_id and connected if they are known) ->
    the accepted snapshot of every session that the micro-batch touched: those columns, ``at`` (the
    instant in microseconds) and ``said`` (arrival of the last explicit connected flag).  ``initial``:
    rows of the same columns."""
    absent = {c: F.lit(None).cast(t) for c, t in (("session_id", "string"), ("connected", "boolean")) if c not in snapshots.columns}
    s = snapshots.withColumns(absent) if absent else snapshots
    text = F.to_json("queue", _KEEP_NULLS).alias("queue")
    s = s.where(F.col("ts").isNotNull() & (F.col("ts") != "")).select(
        "session", "seq", "ts", text, "session_id", "connected", F.unix_micros(F.col("ts").try_cast("timestamp")).alias("at"))
    before = None if initial is None else initial.withColumn("queue", text)
    folded = _apply(s, "session", QueueFold(), f"session string, {QUEUE_STATE}", before)
    return folded.withColumn("queue", F.from_json("queue", f"array<{state.QUEUE_ITEM}>"))


class RevisionGate(StatefulProcessor):
    """Key: entity.  State: the highest revision seen."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "revision long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = (self.seen.get() or (None,))[0]
        for event_id, revision in sorted((r.event_id, r.revision) for r in rows):
            accepted = seen is None or revision > seen
            if accepted:
                seen = revision
            yield Row(event_id=event_id, entity_id=key[0], revision=revision, accepted=accepted)
        self.seen.update((seen,))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((initialState.revision,))

    def close(self) -> None:
        pass


def fold_revisions(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Stream of (event_id, entity_id, revision) -> the same with ``accepted``; events of later
    micro-batches are later events.  ``initial``: (entity_id, revision), the highest seen before."""
    return events.select("event_id", "entity_id", "revision").groupBy("entity_id").transformWithState(
        RevisionGate(), _GATED, "append", "none",
        None if initial is None else initial.groupBy("entity_id"))
