"""Exact similarity join on sets of word 5-grams: size-banded tiles with hashed bitmap signatures.

Documents with equal sets are one node.  Two nodes with Jaccard similarity 0.8 or more share one of
their first ``n - ceil(0.8 n) + 1`` shingles in any common order; the order here is by hash, with the
shingles that many documents share last, so those rarely bring strangers together.  The nodes that
share such a shingle and lie in neighbouring size bands form a tile.  Within a tile, bitmaps are
compared: every shingle flips the bit that its hash names, of one to two bits of room for each, folded
to a common width.  As many bits as differ, so many shingles differ at least, which bounds the overlap
from above.

A tile gives a spanning forest of the pairs that pass the bound, and each node's least different one
with a smaller set.  The forests of all tiles are joined
into candidate components; every similar pair lies within one.  Links are verified by intersecting
sorted shingle arrays, in two steps.  First every node tests the least different of its forest's pairs
with a smaller set (or an equally large one of a smaller name): at most one test per node, by which a
group of near copies joins at its smallest ones.  Then each component that is still in several parts is
compared as a whole: all pairs of nodes in different parts that pass the bound are verified, unless
links found meanwhile join them.  So no pair that could join two components goes untested.

Scale.  Prefix shingles are shuffled as a few binary blocks per task and bucket (17 bytes each).  A
tile of more than ``TILE`` nodes is cut into chunks and every pair of chunks with neighbouring bands
is a tile of its own; no task holds more than two chunks, and nothing is dropped.  Texts of candidate
nodes are fetched once.  In the first step a text moves once as the larger one of a test; a node that
many ask for meets them in chunks of ``GROUP``.  In the last step a component of more than ``GROUP`` nodes or
``GROUP_SHINGLES`` shingles is cut into chunks, its largest part apart from the others: chunks of the largest part meet
those of the others and not each other, so N near copies and a few strangers move N texts, not a
multiple of them.  The list of shared shingles holds those found in at least one document in 1000,
so at most 1000 times the mean set size; it is broadcast as 8-byte hashes.  Tiles and components
return forests, never all pairs.

Shingles are 64-bit hashes of the five words; sets are named by a 64-bit hash of their sorted array.

Defined cases.  Words are runs of anything but blank, tab and line ends; A-Z is lower-cased.  Fewer
than five words are one shingle; null, empty and blank texts have no set and stand alone.  Repeated
rows are copies.  A null doc_id comes back null, and counts in a component only if it has no other
id.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_of, fresh, maybe_among, sliced, stage, table
from quire.llm.components import components

SHINGLE = 5
#: Jaccard threshold as a fraction.
PART, WHOLE = 4, 5
TILE = 2048
GROUP, GROUP_SHINGLES = 2048, 1 << 21
#: Rounds of the first step: 1, or 0 to leave all pairs to the second.
ROUNDS = 1
BUCKETS = 1024
SHARED = 0.001
CHUNK_DOCS = 4096
FLUSH_ENTRIES = 1 << 21
WORDS_AT_ONCE = 1 << 17
MIN_BITS, MAX_BITS = 64, 1 << 15

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=5) | 1 for b in range(256)], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_ODD, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def _hash_spans(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    text = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _power_tables(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * up[:len(text)], out=total[1:])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lengths + 1) - 1
    start = (end - lengths)[:len(words) - size + 1]
    h = (total[end[size - 1:]] - total[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return _hash_spans(words, len(words))
    if len(words) <= WORDS_AT_ONCE:
        return np.unique(_hash_spans(words, SHINGLE))
    return np.unique(np.concatenate([_hash_spans(words[i:i + WORDS_AT_ONCE + SHINGLE - 1], SHINGLE)
                                     for i in range(0, len(words) - SHINGLE + 1, WORDS_AT_ONCE)]))


def set_name(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def bitmap(shingles: np.ndarray) -> bytes:
    """The parity of the number of shingles per hashed bit; the width is a power of two, so that it can
    be folded."""
    width = min(MAX_BITS, max(MIN_BITS, 1 << (len(shingles) - 1).bit_length()))
    times = np.bincount((shingles & np.uint64(width - 1)).astype(np.intp), minlength=width)
    return np.packbits(times & 1, bitorder="little").tobytes()


def band_of(n: np.ndarray) -> np.ndarray:
    """Size band: similar sets lie in the same or in neighbouring bands."""
    return np.floor(np.log(n) / np.log(WHOLE / PART)).astype(np.int8)


def prefix_of(shingles: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets have one in common: by hash, shared ones last."""
    n = len(shingles)
    k = n - -(-n * PART // WHOLE) + 1
    if len(shared):
        at = np.minimum(np.searchsorted(shared, shingles), len(shared) - 1)
        late = shared[at] == shingles
        if late.any():
            shingles = np.concatenate([shingles[~late], shingles[late]])
    return shingles[:k]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def similar(common, na, nb):
    """100 * intersection >= 80 * union."""
    return WHOLE * common >= PART * (na + nb - common)


def document_sets(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text_hash, node, n, bitmap), and rows (shingle, times) for the
    shingles that one document in 1000 of a chunk shares."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    types = [("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary()),
             ("shingle", pa.int64()), ("times", pa.int64())]

    def run(batches):
        chunk: list[np.ndarray] = []
        id_arrow = pa.int64()

        def shared():
            if not chunk:
                return
            h, times = np.unique(np.concatenate(chunk), return_counts=True)
            often = times >= max(8, SHARED * len(chunk))
            h, times = h[often].astype(np.int64), times[often]
            chunk.clear()
            nulls = [pa.nulls(len(h), t) for t in (id_arrow, *(t for _, t in types[:4]))]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(h), pa.array(times)], names=names)

        names = ["doc_id", *(n for n, _ in types)]
        for b in sliced(batches):
            id_arrow = b.schema.field("doc_id").type
            sets = [shingle_set(t) for t in column_of(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([set_name(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                 pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())], names=names)
            for s in sets:
                chunk.append(s)
                if len(chunk) >= CHUNK_DOCS:
                    yield from shared()
        yield from shared()

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {id_type}, text_hash long, node long, n long, bitmap binary, shingle long, times long")


def prefix_blocks(docs: DataFrame, shared: np.ndarray) -> DataFrame:
    """(bucket, keys, nodes, bands): the prefix shingles of every node, packed by bucket."""
    held = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        keys, nodes, bands, seen = [], [], [], set()
        size = 0

        def flush():
            if not keys:
                return
            k = np.concatenate(keys)
            count = [len(x) for x in keys]
            node, band = np.repeat(np.array(nodes, np.int64), count), np.repeat(np.array(bands, np.int8), count)
            bucket = (k & np.uint64(BUCKETS - 1)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            parts = np.split(order, first[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array([k[p].tobytes() for p in parts], pa.binary()),
                 pa.array([node[p].tobytes() for p in parts], pa.binary()),
                 pa.array([band[p].tobytes() for p in parts], pa.binary())], names=["bucket", "keys", "nodes", "bands"])

        for b in sliced(batches):
            for text in column_of(b, "text"):
                s = shingle_set(text)
                if not len(s) or (name := set_name(s)) in seen:
                    continue
                seen.add(name)
                keys.append(prefix_of(s, held.value))
                nodes.append(name)
                bands.append(band_of(np.array([len(s)]))[0])
                size += len(keys[-1])
                if size >= FLUSH_ENTRIES:
                    yield from flush()
                    keys, nodes, bands, size = [], [], [], 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, nodes binary, bands binary")


def _tiles_of_run(node: np.ndarray, band: np.ndarray):
    """(left, right) node arrays whose pairs cover all pairs of the run in neighbouring bands; an
    empty right side stands for the pairs within the left."""
    order = np.lexsort((node, band))
    node, band = node[order], band[order]
    for part in np.split(np.arange(len(node)), np.flatnonzero(np.diff(band.astype(np.int16)) > 1) + 1):
        if len(part) < 2:
            continue
        if len(part) <= TILE:
            yield node[part], node[:0]
            continue
        chunks = [part[i:i + TILE] for i in range(0, len(part), TILE)]
        for i, a in enumerate(chunks):
            yield node[a], node[:0]
            for b in chunks[i + 1:]:
                if band[b[0]] > band[a[-1]] + 1:
                    break
                yield node[a], node[b]


def tiles(blocks: DataFrame) -> DataFrame:
    """(tile, side, node): nodes that share a prefix shingle, equal tiles once."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        parts = [(np.frombuffer(k, np.uint64), np.frombuffer(v, np.int64), np.frombuffer(d, np.int8))
                 for b in batches for k, v, d in zip(*(column_of(b, c) for c in ("keys", "nodes", "bands")))]
        if not parts:
            return
        key, node, band = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((node, key))
        key, node, band = key[order], node[order], band[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, band = key[new], node[new], band[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        seen, out = set(), []
        for at, n_run in zip(first[length > 1].tolist(), length[length > 1].tolist()):
            for left, right in _tiles_of_run(node[at:at + n_run], band[at:at + n_run]):
                name = xxhash.xxh64_intdigest(left.tobytes() + b"|" + right.tobytes()) - (1 << 63)
                if name not in seen:
                    seen.add(name)
                    out.append((name, left.tolist(), right.tolist()))
                    if len(out) >= 512:
                        yield _tile_batch(out)
                        out = []
        yield _tile_batch(out)

    lists = (blocks.repartition(n, "bucket").mapInArrow(run, "tile long, left array<long>, right array<long>")
             .dropDuplicates(["tile"]))
    return lists.select("tile", F.explode(F.concat(
        F.transform("left", lambda x: F.struct(F.lit(0).alias("side"), x.alias("node"))),
        F.transform("right", lambda x: F.struct(F.lit(1).alias("side"), x.alias("node"))))).alias("x")).select("tile", "x.*")


def _tile_batch(rows) -> pa.RecordBatch:
    lists = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], lists),
         pa.array([r[2] for r in rows], lists)], names=["tile", "left", "right"])


class Tile:
    """Nodes of a tile by bitmap width, for comparing one node with all larger ones."""

    def __init__(self, node, side, n, bitmaps):
        self.order = order = np.lexsort((node, n))
        self.node, self.side, self.n = (np.asarray(x)[order] for x in (node, side, n))
        self.two_sided = bool(self.side.any())
        raw = [bitmaps[i] for i in order]
        width = np.array([len(b) for b in raw])
        self.groups = []
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            m = np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(len(own), -1)
            nxt = np.flatnonzero(width == 2 * w)
            if len(nxt):  # similar sets differ by one doubling of the width at most
                f = np.frombuffer(b"".join(raw[i] for i in nxt), np.uint64).reshape(len(nxt), 2, -1)
                own, m, k = np.concatenate([own, nxt]), np.concatenate([m, f[:, 0] ^ f[:, 1]]), len(own)
            else:
                k = len(own)
            self.groups.append((own, m, k))

    def candidates(self):
        """(position, positions after it) whose bitmaps allow the similarity, the least different first."""
        for i, hits, _ in self.near():
            yield i, hits

    def near(self):
        """:meth:`candidates` with the share of different bits of each."""
        for own, m, k in self.groups:
            n = self.n[own]
            for i in range(k):
                hi = np.searchsorted(n, n[i] * WHOLE // PART, "right")
                if hi <= i + 1:
                    continue
                differ = np.bitwise_count(m[i + 1:hi] ^ m[i]).sum(1, dtype=np.int64)
                total = n[i + 1:hi] + n[i]
                # overlap <= (total - differ) / 2 must reach PART / (PART + WHOLE) of the total
                ok = (PART + WHOLE) * (total - differ) >= 2 * PART * total
                if self.two_sided:
                    ok &= self.side[own[i + 1:hi]] != self.side[own[i]]
                hits = own[i + 1:hi][ok]
                if len(hits):
                    near = np.argsort(differ[ok], kind="stable")
                    yield own[i], hits[near], (differ[ok] / total[ok])[near]

    def forest(self):
        """A spanning forest of the candidate pairs, with their share of different bits, and for every node the
        least different pair with one before it."""
        label = np.arange(len(self.node))
        least, before = np.full(len(label), np.inf), np.zeros(len(label), np.intp)
        for i, hits, gap in self.near():
            closer = gap < least[hits]
            least[hits[closer]], before[hits[closer]] = gap[closer], i
            found, first = np.unique(label[hits], return_index=True)
            for other, j, g in zip(found, hits[first], gap[first]):
                if other != label[i]:
                    yield self.node[i], self.node[j], float(g)
                    label[label == other] = label[i]
        for j in np.flatnonzero(np.isfinite(least)):
            yield self.node[before[j]], self.node[j], float(least[j])

    def links(self, sets: list[np.ndarray], parts=None):
        """A spanning forest of the similar pairs, over the ``parts`` that links already join; ``sets``
        and ``parts`` as given at the start."""
        label = np.arange(len(self.node)) if parts is None else np.unique(np.asarray(parts)[self.order], return_inverse=True)[1]
        sets = [sets[i] for i in self.order]
        for i, hits in self.candidates():
            for j in hits[label[hits] != label[i]]:  # the least different first
                if label[j] != label[i] and similar(overlap(sets[i], sets[j]), self.n[i], self.n[j]):
                    yield self.node[i], self.node[j]
                    label[label == label[j]] = label[i]


def _pair_batch(pairs, names=("a", "b")) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], types[i]) for i in range(len(names))], names=list(names))


def per_tile(rows: DataFrame, key: list[str], columns: list[str], pairs_of, names=("a", "b")) -> DataFrame:
    """(a, b), perhaps with a gap, that ``pairs_of(rows of one tile)`` gives; rows of a tile meet in one
    task, one tile at a time is held."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        name, held, out = None, [], []
        for b in batches:
            for row in zip(*(column_of(b, c) for c in (*key, *columns))):
                if row[:len(key)] != name:
                    if len(held) > 1:
                        out.extend(pairs_of(held))
                    if len(out) >= 8192:
                        yield _pair_batch(out, names)
                        out = []
                    name, held = row[:len(key)], []
                held.append(row[len(key):])
        if len(held) > 1:
            out.extend(pairs_of(held))
        yield _pair_batch(out, names)

    return (rows.select(*key, *columns).repartition(parts, *key).sortWithinPartitions(*key)
            .mapInArrow(run, "a long, b long" + (", gap double" if len(names) > 2 else "")))


def candidate_forest(rows: DataFrame) -> DataFrame:
    """(a, b, gap) from rows (tile, side, node, n, bitmap): forests of the pairs that pass the bound."""

    def forest(held):
        node, side, n, bits = zip(*held)
        return Tile(node, side, np.array(n), bits).forest()

    return per_tile(rows, ["tile"], ["node", "side", "n", "bitmap"], forest, ("a", "b", "gap"))


def _links_of(held, texts, sides=None, parts=None):
    sets = [shingle_set(t) for t in texts]
    return Tile(held, sides or [0] * len(held), np.array([len(s) for s in sets]), [bitmap(s) for s in sets]).links(sets, parts)


def _parts_of(rows: DataFrame, node: str, joined: DataFrame | None, name: str) -> DataFrame:
    """``rows`` with the part (column ``name``) that ``node`` belongs to: itself without links."""
    if joined is None:
        return rows.withColumn(name, F.col(node))
    j = joined.select(F.col("node").alias(node), F.col("root").alias(name))
    return rows.join(j, node, "left").withColumn(name, F.coalesce(name, node))


def nearest_links(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The first step: (a, b) verified links among the candidate pairs ``edges(a, b, gap)``, ``a`` the smaller
    set: every ``b`` tests the least different of its pairs."""
    stars = stage(edges.groupBy(F.col("b").alias("leaf")).agg(F.min(F.struct("gap", "a"))["a"].alias("hub")), "stars")
    counts = stars.groupBy("hub").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("chunks"))
    rows = stars.join(counts, "hub").select("hub", F.pmod(F.xxhash64("leaf"), "chunks").cast("int").alias("chunk"), F.col("leaf").alias("node"))
    rows = rows.union(rows.select("hub", "chunk", F.col("hub").alias("node")).distinct())
    return stage(per_tile(rows.join(texts, "node"), ["hub", "chunk"], ["node", "text"],
                          lambda held: _links_of(*zip(*{r[0]: r for r in held}.values()))), "nearest-links")


def verified_links(groups: DataFrame, texts: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """The second step: forests (a, b) of the similar pairs between different parts of each group;
    ``groups(node, root, n)``, ``texts(node, text)``, ``joined(node, root)``: parts that links already join.
    Groups of one part have nothing to compare."""
    placed = _parts_of(groups, "node", joined, "part")
    parts = placed.groupBy("root", "part").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    chunks = lambda n, s: F.ceil(F.greatest(n / GROUP, s / GROUP_SHINGLES)).cast("int")
    whole = (parts.groupBy("root").agg(F.count("*").alias("parts"), F.max(F.struct("nodes", "part", "shingles")).alias("m"),
                                       F.sum("nodes").alias("nodes"), F.sum("shingles").alias("shingles"))
             .filter("parts > 1").withColumn("one", chunks(F.col("nodes"), F.col("shingles")) == 1))
    # chunks 0 to k - 1 hold the largest part, k to n - 1 the others; a small group is one chunk
    whole = whole.select("root", F.col("m.part").alias("major"), "one", F.when(F.col("one"), 0).otherwise(chunks(F.col("m.nodes"), F.col("m.shingles"))).alias("k"),
                         F.when(F.col("one"), 1).otherwise(chunks(F.col("nodes") - F.col("m.nodes"), F.col("shingles") - F.col("m.shingles"))).alias("j"))
    placed = placed.join(whole, "root")
    k, n = F.col("k"), F.col("k") + F.col("j")
    hashed = F.xxhash64("node", F.lit(1))
    large = ~F.col("one") & (F.col("part") == F.col("major"))
    placed = placed.withColumn("c", F.when(large, F.pmod(hashed, F.greatest(k, F.lit(1)))).otherwise(k + F.pmod(hashed, "j")).cast("int"))
    c = F.col("c")
    spot = lambda left, right, side: F.struct(left.alias("left"), right.alias("right"), F.lit(side).alias("side"))
    later = F.transform(F.sequence(F.greatest(c, k), n - 1), lambda x: spot(c, x, 0))
    earlier = F.when((c >= k) & (c > 0), F.transform(F.sequence(F.lit(0), c - 1), lambda x: spot(x, c, 1))).otherwise(F.array())
    rows = placed.select("root", "node", "part", F.explode(F.concat(later, earlier)).alias("t")).select("root", "node", "part", "t.*")

    def links(held):
        held = [*{r[0]: r for r in held}.values()]  # a text that is there twice counts once
        node, side, part, texts = zip(*held)
        return _links_of(node, texts, side, part)

    return per_tile(rows.join(texts, "node"), ["root", "left", "right"], ["node", "side", "part", "text"], links)


def similarity_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id (the smallest doc_id
    reachable by links, its own included), root (names the component; null without a set)."""
    rows = stage(document_sets(docs), "document-sets")
    sets = rows.filter("n is not null").drop("shingle", "times")
    n_docs = sets.count()
    often = (rows.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
             .filter(F.col("times") >= max(8, SHARED * n_docs)).select("shingle").collect())
    shared = np.sort(np.array([r.shingle for r in often], np.int64).astype(np.uint64))

    nodes = (sets.filter("node is not null").groupBy("node").agg(
        F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.min("bitmap").alias("bitmap")))
    nodes = stage(nodes, "nodes")
    with_bits = tiles(prefix_blocks(docs, shared)).join(nodes.select("node", "n", "bitmap"), "node")
    edges = stage(candidate_forest(with_bits), "candidate-forest")
    groups = stage(components(edges).join(nodes.select("node", "n", "rep"), "node"), "groups")
    wanted = groups.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_text"))
    same = (F.xxhash64("text") == F.col("rep_text")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    maybe = maybe_among(docs.select("doc_id", "text"), F.xxhash64("text"), wanted.select("rep_text"), "__maybe").filter("__maybe")
    texts = stage(maybe.join(wanted, same).select("node", "text"), "candidate-texts")
    near = nearest_links(edges, texts) if ROUNDS else None
    rest = verified_links(groups.select("node", "root", "n"), texts, components(near) if ROUNDS else None)
    roots = components(rest.union(near) if ROUNDS else rest)

    reached = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = reached.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = reached.join(smallest, "root").select("node", "component_id", "root")
    return (sets.join(of_node, "node", "left")
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"), "root"))


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents")).drop("text_hash", "root")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, of the document with the smallest id (an id
    before none, then the smaller hash of the text), all columns kept.  Documents without a set
    all stay."""
    classes = stage(similarity_components(docs).filter("root is not null").groupBy("root", "doc_id", "text_hash")
                    .agg(F.count("*").alias("n")), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = classes.groupBy("root").agg(F.min(rank).alias("best"))
    id_, hash_, one, maybe = fresh(docs, "__id", "__text", "__one", "__maybe")
    marked = (classes.join(best, "root").withColumn("stays", rank == F.col("best"))
              .filter("not stays or n > 1")
              .select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("stays").alias(one)))
    marked = stage(marked, "marked")
    same = (F.xxhash64("text") == F.col(hash_)) & F.col("doc_id").eqNullSafe(F.col(id_))
    # only rows that may be marked are shuffled for the exact join
    split = maybe_among(docs, F.xxhash64("text"), marked.select(hash_), maybe)
    out = split.filter(~F.col(maybe)).select(docs.columns).unionByName(
        split.filter(maybe).join(marked, same, "left_anti").select(docs.columns))
    repeated = marked.filter(one)
    if not repeated.isEmpty():  # the row that stays is there more than once
        again = docs.join(repeated, same).withColumn(hash_, F.xxhash64("text")).dropDuplicates(["doc_id", hash_])
        out = out.unionByName(again.select(docs.columns))
    return out
