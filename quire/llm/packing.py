"""Packing by minimum bin slack: fill every window as close to its capacity as the lengths allow.

Documents longer than a window give whole windows first; what remains of each is a piece.  For the
next window the longest remaining piece is taken, and a bitset subset-sum over the multiset of
remaining lengths (binary multiples of each count, longest first) finds the fill closest to the
capacity; walking the stored bitsets back gives how many pieces of each length to take.  Where no
subset meets the capacity, the longest piece that overlaps the gap is cut ("cut freely"), so only
the last window of a task can stay open; its tokens go into sequences of power-of-two lengths,
which need no padding.

Scale.  Tokenizing, packing and slicing happen in one pass over the documents, without a shuffle:
each task packs its own documents in buffers of about ``buffer_tokens`` ids, so memory depends on
the buffer and the longest document, not on the partition, and nothing passes through the driver.
A task that is run again reads the same split and packs it the same way.  Sequence ids are
(partition << 33) + number, unique and dense within a task.

Defined cases.  Null and empty texts are documents of the end id alone.  A null doc_id passes
through.  Repeated rows are documents of their own.  Other columns are ignored.  An empty table
gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_of
from quire.llm.tokens import encoder

#: Ids held by a task at a time (16 MB), besides one Arrow batch and the longest document.
BUFFER_TOKENS = 1 << 22


def best_fill(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset of ``counts`` (length -> pieces left) whose sum is the largest not over
    ``capacity``, as length -> pieces.  ``lengths`` are the keys in ascending order."""
    reach, steps, goal = 1, [], 1 << capacity
    mask = (goal << 1) - 1
    for i in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[i]
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach & goal:
            break
    at, take = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not (before >> at) & 1:
            take[length] = take.get(length, 0) + k
            at -= length * k
    return take


class Packer:
    """Pieces are (document, start, length); ``ready`` gets (sequence, offset, piece)."""

    def __init__(self, window: int):
        self.window, self.sequence, self.ready = window, 0, []
        self.pieces: dict[int, list] = {}
        self.lengths: list[int] = []
        self.waiting = 0

    def add(self, doc, start: int, length: int) -> None:
        if length not in self.pieces:
            self.pieces[length] = []
            insort(self.lengths, length)
        self.pieces[length].append((doc, start))
        self.waiting += length

    def _take(self, length: int):
        got = self.pieces[length].pop()
        if not self.pieces[length]:
            del self.pieces[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)
        self.waiting -= length
        return (*got, length)

    def document(self, doc, n_tokens: int) -> None:
        whole = n_tokens - n_tokens % self.window
        for at in range(0, whole, self.window):
            self._emit([(doc, at, self.window)])
        if whole < n_tokens:
            self.add(doc, whole, n_tokens - whole)

    def _emit(self, pieces) -> None:
        offset = 0
        for p in pieces:
            self.ready.append((self.sequence, offset, p))
            offset += p[2]
        self.sequence += 1

    def fill(self, capacity: int) -> None:
        """One sequence of exactly ``capacity`` tokens; at least so many must be waiting."""
        chosen, gap = [], capacity
        i = bisect_right(self.lengths, gap) - 1
        if i >= 0:
            chosen.append(self._take(self.lengths[i]))
            gap -= chosen[0][2]
        if gap and self.lengths:
            counts = {n: len(p) for n, p in self.pieces.items()}
            for length, k in best_fill(counts, self.lengths, gap).items():
                for _ in range(k):
                    chosen.append(self._take(length))
                    gap -= length
        if gap:  # every piece left is longer than the gap: cut the longest
            doc, start, length = self._take(self.lengths[-1])
            chosen.append((doc, start, gap))
            self.add(doc, start + gap, length - gap)
        self._emit(chosen)

    def pack(self) -> None:
        """All full windows among the waiting pieces."""
        while self.waiting >= self.window:
            self.fill(self.window)

    def finish(self) -> None:
        self.pack()
        while self.waiting:
            self.fill(1 << (self.waiting.bit_length() - 1))


SCHEMA = ("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, style: str, end_id: int, window: int = 4096,
                   buffer_tokens: int = BUFFER_TOKENS, plain_specials: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.  Every id of a document, its end id
    included, lies in exactly one piece; a sequence has at most ``window`` ids.  ``plain_specials``: as
    in :class:`quire.llm.tokens.SegmentEncoder`."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer_path, style, plain_specials).encode
        packer, held, base = Packer(window), 0, TaskContext.get().partitionId() << 33
        arrow_id = None

        def drain():
            nonlocal held
            ready, packer.ready = packer.ready, []
            held = packer.waiting
            for i in range(0, len(ready), 4096):
                part = ready[i:i + 4096]
                yield pa.RecordBatch.from_arrays([
                    pa.array([p[0][0] for _, _, p in part], arrow_id),
                    pa.array([p[1] for _, _, p in part], pa.int64()),
                    pa.array([p[2] for _, _, p in part], pa.int64()),
                    pa.array([p[0][1][4 * p[1]:4 * (p[1] + p[2])] for _, _, p in part], pa.binary()),
                    pa.array([len(p[0][1]) // 4 for _, _, p in part], pa.int64()),
                    pa.array([base + s for s, _, _ in part], pa.int64()),
                    pa.array([o for _, o, _ in part], pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            arrow_id = b.schema.field("doc_id").type
            for at in range(0, b.num_rows, 1024):  # texts of a slice are held, not of a batch
                part = b.slice(at, 1024)
                for doc_id, text in zip(column_of(part, "doc_id"), column_of(part, "text")):
                    ids = encode(text) + end
                    packer.document((doc_id, ids), len(ids) // 4)
                    held += len(ids) // 4
                    if held >= buffer_tokens:
                        packer.pack()
                        yield from drain()
        packer.finish()
        if packer.ready:
            yield from drain()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")


def packed_digest(docs: DataFrame) -> DataFrame:
    """Pieces of 4096-token windows under the word vocabulary, ids as a checksum."""
    import public_tokenizers
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "words", end_id=2, plain_specials=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    from quire.llm.common import table
    return packed_digest(table(spark, sf_dir, "documents"))
