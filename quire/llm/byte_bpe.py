"""Byte-level BPE encoding and decoding over a rank file, with a segment tree per pre-token.

A text is split by the vocabulary's pre-token pattern.  A pre-token that is in the vocabulary is its
id.  Otherwise its bytes are parts, and a segment tree over the byte positions holds at each live
part's first byte the rank of the pair it makes with the next part; a node holds the smallest (rank,
position) below it, so the root is the leftmost pair of the smallest rank.  A merge changes three
leaves -- the pair's own, the vanished part's and the part before's -- and walks up from each until
nothing changes: n bytes cost n log n, however long a pre-token is.

Pre-tokens repeat, so texts are first cut at blanks where a pre-token must begin anyway, and the ids of
segments and pre-tokens are cached (bounded in bytes).  The new pre-tokens of a slice of documents are
merged side by side, a segment tree each, in numpy arrays.  Decoding looks every id up in a table of
the vocabulary's bytes, whole slices of documents at a time.

Scale.  No shuffle; a task reads its documents in slices of bounded size, a very long text in windows.

Defined cases.  Null and empty texts have no ids and decode to no bytes.  Rows stay as they are,
repeated ones and null ids too; other columns pass through (an input column named ``ids``, ``n_tokens``
or ``decoded`` is replaced).  A byte that the vocabulary lacks, or an id that it lacks, is an error.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quire.llm.common import table
from quire.llm.tokens import single_blanks

#: Bytes that cached segments and pre-tokens, their ids and bookkeeping may take in a Python worker; a
#: full cache is emptied between slices.
SEGMENT_CACHE_BYTES, PIECE_CACHE_BYTES = 64 << 20, 32 << 20
_ENTRY_BYTES = 190
#: Rows and text bytes of a slice that is worked on and handed on at once.
SLICE_ROWS, SLICE_BYTES = 2048, 2 << 20
WINDOW_CHARS = 1 << 20
#: Pre-tokens of at most this many bytes are merged side by side, so many at a time.
SIDE_BY_SIDE, _ROWS = 64, 8192

_NONE = 1 << 62
_BITS, _PLACES = 7, 127
_PLACE = (1 << 32) - 1
#: A blank or line feed between two characters that no whitespace rule of any library counts as blank.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n](?=[^\s\x1c-\x1f])")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTree:
    """Smallest (rank, position) of the pairs of a pre-token's parts, under point updates."""

    def __init__(self, keys: list[int]):
        self.base = base = 1 << max(0, len(keys) - 1).bit_length()
        self.node = node = [_NONE] * base + keys + [_NONE] * (base - len(keys))
        for i in range(base - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def set(self, place: int, key: int) -> None:
        node, i = self.node, self.base + place
        node[i] = key
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            if b < a:
                a = b
            if node[i] == a:
                return
            node[i] = a
            i >>= 1


def merge_parts(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: merges by smallest rank, leftmost first."""
    n, rank = len(piece), ranks.get
    if n == 1:
        return [ranks[piece]]

    def key(place: int, end: int) -> int:
        r = rank(piece[place:end])
        return _NONE if r is None else r << 32 | place

    tree = PairTree([key(i, i + 2) for i in range(n - 1)])
    node = tree.node
    after = list(range(1, n + 1))  # a part's end, where the next live part begins
    before = list(range(-1, n))
    while (best := node[1]) != _NONE:
        i = best & _PLACE
        j = after[i]
        end = after[j]
        after[i] = end
        before[end] = i
        if j < n - 1:
            tree.set(j, _NONE)
        tree.set(i, key(i, after[end]) if end < n else _NONE)
        if (p := before[i]) >= 0:
            tree.set(p, key(p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Vocabulary:
    """Ranks by bytes, and by the two ids that a merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        rank = ranks.get
        pairs = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                left, right = rank(token[:i]), rank(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.byte = np.array([rank(bytes([b]), -1) for b in range(256)], np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids put together, ``_NONE`` where the vocabulary has none."""
        if not len(self.pair):
            return np.full(len(left), _NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Id bytes of every pre-token.  Short ones are merged side by side, one segment tree per row of
        an array; a long one has a tree by itself."""
        out = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            groups.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for base, members in groups.items():
            if base > SIDE_BY_SIDE or len(members) < 8:
                for i in members:
                    out[i] = np.array(merge_parts(pieces[i], self.ranks), "<u4").tobytes()
                continue
            for at in range(0, len(members), _ROWS):
                some = members[at:at + _ROWS]
                ids, count = self._merge_rows([pieces[i] for i in some], base)
                data, end = ids.astype("<u4").tobytes(), 0
                for i, n in zip(some, (4 * count).tolist()):
                    out[i] = data[end:end + n]
                    end += n
        return out

    def _merge_rows(self, pieces: list[bytes], base: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids per piece) of pieces of at most ``base`` bytes.  Row r of ``node`` is
        the segment tree of piece r, in the usual layout: children of k at 2k and 2k + 1, leaves from
        ``base``; a key is rank * 2 ** _BITS + position."""
        m = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(base, b"\0") for p in pieces), np.uint8).reshape(m, base)
        place = np.arange(base)
        live = place < n[:, None]
        part = np.where(live, self.byte[raw], 0)
        if (part < 0).any():
            raise KeyError("a byte that the vocabulary lacks")
        after = np.tile(np.arange(1, base + 1), (m, 1))  # where the next live part begins
        before = np.tile(np.arange(-1, base), (m, 1))
        node = np.full((m, 2 * base), _NONE)
        r, i = np.nonzero(place < n[:, None] - 1)
        node[r, base + i] = _keys(self.ranks_of(part[r, i], part[r, i + 1]), i)
        for k in range(base - 1, 0, -1):
            np.minimum(node[:, 2 * k], node[:, 2 * k + 1], out=node[:, k])
        r = np.arange(m)
        while True:
            best = node[r, 1]
            going = best < _NONE
            if not going.any():
                return part[live], live.sum(1)
            r, best = r[going], best[going]
            i = best & _PLACES
            j = after[r, i]
            end = after[r, j]
            part[r, i] = merged = best >> _BITS
            after[r, i] = end
            inside = np.flatnonzero(end < base)
            before[r[inside], end[inside]] = i[inside]
            live[r, j] = False
            node[r, base + j] = _NONE
            # the pair's new key, and that of the part before it
            key = np.full(len(r), _NONE)
            more = np.flatnonzero(end < n[r])
            key[more] = _keys(self.ranks_of(merged[more], part[r[more], end[more]]), i[more])
            node[r, base + i] = key
            p = before[r, i]
            led = np.flatnonzero(p >= 0)
            pr, p = r[led], p[led]
            node[pr, base + p] = _keys(self.ranks_of(part[pr, p], merged[led]), p)
            rows, up = np.concatenate([r, r, pr]), (base + np.concatenate([i, j, p])) >> 1
            while up[0]:
                node[rows, up] = np.minimum(node[rows, 2 * up], node[rows, 2 * up + 1])
                up >>= 1


def _keys(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.where(rank < _NONE, rank << _BITS | place, _NONE)


class Cache(dict):
    """Text -> id bytes, emptied when it holds more than ``bound`` bytes."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.held = bound, 0

    def add(self, text: str, ids: bytes) -> None:
        self.held += _ENTRY_BYTES + len(text) + len(ids)
        self[text] = ids

    def trim(self) -> None:
        if self.held > self.bound:
            self.clear()
            self.held = 0


class Encoder:
    """Whole texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern).findall
        self.of_segment, self.of_piece = Cache(SEGMENT_CACHE_BYTES), Cache(PIECE_CACHE_BYTES)

    def _learn(self, segments: list[str]) -> None:
        """Put segments that the cache lacks into it: all their new pre-tokens are merged at once."""
        split = [self.pattern(s) for s in segments]
        self.of_piece.trim()
        known, ranks = self.of_piece, self.vocabulary.ranks
        new = []
        for piece in {p for pieces in split for p in pieces if p not in known}:
            raw = piece.encode()
            whole = ranks.get(raw)
            if whole is None:
                new.append((piece, raw))
            else:
                known.add(piece, whole.to_bytes(4, "little"))
        for (piece, _), ids in zip(new, self.vocabulary.merge_all([raw for _, raw in new])):
            known.add(piece, ids)
        for s, pieces in zip(segments, split):
            self.of_segment.add(s, known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces]))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; none for null."""
        return [b"".join(ids) for ids in self._parts([list(self.windows(t)) if t else [] for t in texts])]

    def _parts(self, texts: list[list[str]]) -> list[list[bytes]]:
        out = []
        cache = self.of_segment
        cache.trim()
        cut = [[self.segments(w) for w in windows] for windows in texts]
        new = {s for windows in cut for w in windows for s in w if s not in cache}
        if new:
            self._learn(list(new))
        get = cache.__getitem__
        for windows in cut:
            out.append([b"".join(map(get, w)) for w in windows])
        return out

    def windows(self, text: str):
        """The text in parts of bounded length that end where a pre-token begins."""
        at = 0
        while len(text) - at > WINDOW_CHARS:
            m = _CUT.search(text, at + WINDOW_CHARS)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def segments(self, text: str) -> list[str]:
        """The text cut before blanks that stand alone: there, every match of the pattern ends."""
        if single_blanks(text):
            return text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")
        out, at = [], 0
        for m in _CUT.finditer(text):
            out.append(text[at:m.start()])
            at = m.start()
        out.append(text[at:])
        return out


class Decoder:
    """Ids to bytes, by a table of all token bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.length = np.full(size, -1, np.int64)
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
            self.length[rank] = len(token)
        self.start = np.concatenate([[0], np.cumsum(np.maximum(self.length, 0))])[:size]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, bytes of each id)."""
        if len(ids) and (int(ids.max()) >= len(self.length) or (self.length[ids] < 0).any()):
            raise ValueError("id outside the vocabulary")
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.start[ids] - (ends - length), length)
        return self.bytes[shift + np.arange(total)], length


_held: dict = {}


def _vocabulary(path: str, pattern: str | None):
    """One encoder or decoder per worker process and vocabulary."""
    if (path, pattern) not in _held:
        ranks = read_ranks(path)
        _held[path, pattern] = Encoder(Vocabulary(ranks), pattern) if pattern else Decoder(ranks)
    return _held[path, pattern]


def _slices(batch: pa.RecordBatch, column: int):
    """The batch in slices of bounded rows and bytes (one row at least)."""
    at, size = 0, 0
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > at and (i - at >= SLICE_ROWS or size + n > SLICE_BYTES):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield batch.slice(at)


def _mapped(df: DataFrame, source: str, added: list[StructField], compute) -> DataFrame:
    """``df`` with the ``added`` columns that ``compute() -> (column -> arrays)`` derives from ``source``."""
    names = {f.name for f in added}
    df = df.select(*[c for c in df.columns if c not in names or c == source])
    at, kept = df.columns.index(source), [i for i, c in enumerate(df.columns) if c not in names]
    schema = StructType([df.schema.fields[i] for i in kept] + added)

    def run(batches):
        f = compute()
        for batch in batches:
            for b in _slices(batch, at):
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *f(b.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit) and ``n_tokens`` of the whole text."""

    def compute():
        encode_all = _vocabulary(ranks_path, pattern).encode_all

        def ids(texts):
            out = encode_all(texts.to_pylist())
            return pa.array(out, pa.binary()), pa.array([len(o) // 4 for o in out], pa.int64())

        return ids

    return _mapped(docs, text, [StructField("ids", BinaryType()), StructField("n_tokens", LongType())], compute)


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``: the bytes that its ids stand for (none for null)."""

    def compute():
        table_ = _vocabulary(ranks_path, None)

        def decoded(column):
            rows = [r or b"" for r in column.to_pylist()]
            data, length = table_.decode_all(np.frombuffer(b"".join(rows), "<u4"))
            upto = np.concatenate([[0], np.cumsum(length)])
            ends = upto[np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)])]
            if ends[-1] < 1 << 31:
                return [pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])]
            return [pa.array([data[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())]

        return decoded

    return _mapped(tokens, ids, [StructField("decoded", BinaryType())], compute)


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabulary

    path = vocabulary.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs, path, vocabulary.PATTERN).drop("text")
    return decode(ids, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                    F.sha2("decoded", 256).alias("decoded_sha256"))
