"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: words lower-cased without punctuation, numbers as a
number slot, units behind a number as a unit slot, and names -- capitalised words, neighbours joined
-- as a name slot.  Whether a capitalised word is a name depends on where it stands, so texts on both
sides are read in several ways: raw words without slots, names as words, names but where a sentence
begins, all capitalised words as names, and these without joining neighbours.  Windows of ``WINDOW``
template tokens are hashed; document windows meet benchmark windows in a hash join.  Matches on one
diagonal (the same shift between document and item, in one reading of each) belong together: the
longest run of them counts whose slots map the item's values to the document's one to one; a
conflict ends a run and does not refuse the windows beside it.  So a passage is found word for word,
with other numbers or names put in consistently, or in other case and punctuation, wherever it stands.

An item shorter than a window is one window of its own length.  A window needs ``MIN_LITERAL`` of
its tokens (rounded up, five at least) to be words; an item without such a window is matched by its
raw words only, if it has ``MIN_RAW`` of them.

Scale.  One pass hashes every window of every whole text.  Only windows whose hash is in a bitmap of
the benchmark's windows leave the task -- the bitmap has 2^24 bits (2 MB) whatever the benchmark --
and the join on the exact hash removes the rest.  Matches are aggregated by (document, item,
diagonal), a group no larger than the item.

Defined cases.  Null and empty texts, on either side, match nothing.  Rows that agree in doc_id and
text count once; a null doc_id is a key of its own.  Repeated items are matched under each item_id.
An empty benchmark matches nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_of, fresh, stage, table
from quire.llm.tokens import OTHER_BLANK as _OTHER_BLANK

WINDOW = 13
MIN_LITERAL = 0.6
FILTER_BITS = 1 << 24
CACHE_ENTRIES, KNOWN_ENTRIES = 150_000, 300_000
#: Rows of a batch that are worked on at once, and hits after which they are handed on.
SLICE_ROWS, FLUSH_HITS = 512, 1 << 14
#: Tokens of the shortest item that is matched by its raw words alone.
MIN_RAW = 3

UNITS = frozenset("""mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms oz
ounce ounces lb lbs pound pounds ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute
minutes h hr hour hours day days week weeks month months year years mph kmh hz khz mhz ghz v w kw kwh j kj cal kcal pa kpa
kb mb gb tb percent degree degrees celsius fahrenheit kelvin dollar dollars euro euros cent cents usd eur""".split())
_LINE_END = re.compile("\r\n?|[\x0b\x0c\x85\u2028\u2029]")
_STRIP = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…–—·•¿¡ \t\r"
_NUMBER, _UNIT, _NAME = (xxhash.xxh64_intdigest(f"\x00{k}") for k in ("number", "unit", "name"))
_RAW = xxhash.xxh64_intdigest("\x00raw")
#: Readings of a text: raw words; numbers and units as slots; also names within sentences; also
#: capitalised words that begin one; the same with every name by itself.
RAW, PLAIN, NAMES, ALL, EACH = range(5)


def split(text: str) -> list[str]:
    """The blank-free tokens of a text, and its line feeds.  Every other kind of blank splits words too,
    and every other line end is a line feed."""
    if _OTHER_BLANK.search(text):
        text = _OTHER_BLANK.sub(" ", _LINE_END.sub("\n", text))
    return text.replace("\n", " \n ").split(" ")


def word_hash(core: str) -> int:
    return xxhash.xxh64_intdigest(core.lower().encode("utf-8", "surrogatepass"))


class Known(dict):
    """Token -> whether a window that an item has may hold it: 1 for words of the benchmark and whatever
    may be a slot, 0 for other words, 2 for tokens that are no part of a window (a bounded cache)."""

    def __init__(self, words: np.ndarray):
        """``words``: bitmap of the benchmark's word hashes."""
        super().__init__()
        self.bits = words.astype("<u8").tobytes()

    def __missing__(self, token: str) -> int:
        core = token if token.isalpha() else token.strip(_STRIP)
        if not core.strip():
            code = 2
        elif not core.isalpha() or core[0].isupper():  # a number, a unit with a sign, a name
            code = 1
        else:
            low = word_hash(core) & (FILTER_BITS - 1)
            code = self.bits[low >> 3] >> (low & 7) & 1 or int(core.lower() in UNITS)
        if len(self) >= KNOWN_ENTRIES:
            self.clear()
        self[token] = code
        return code

    def may_match(self, words: list[str], size: int) -> bool:
        """Whether ``size`` tokens in a row may be in a window.  A text without that has in each of its
        windows a word that no item has, in every reading; it need not be read further."""
        code = np.fromiter(map(self.__getitem__, words), np.int8, len(words))
        code = code[code < 2]
        if len(code) < size:
            return False
        ends = np.flatnonzero(code == 0)
        return bool(len(ends) == 0 or ends[0] >= size or len(code) - 1 - ends[-1] >= size or (np.diff(ends) > size).any())


class Tokens(dict):
    """Blank-free token -> row of the property arrays (a bounded cache)."""

    def __init__(self):
        super().__init__()
        self.word = np.zeros(CACHE_ENTRIES, np.uint64)
        self.skip, self.ends, self.number, self.unit, self.name = (np.zeros(CACHE_ENTRIES, bool) for _ in range(5))

    def clear(self) -> None:
        super().clear()
        for a in (self.skip, self.ends, self.number, self.unit, self.name):
            a.fill(False)

    def __missing__(self, token: str) -> int:
        """Properties that a token lacks are left as they are: false since the cache was empty."""
        i = len(self)
        self[token] = i
        plain = token.isalpha()
        core = token if plain else token.strip(_STRIP)
        low = core.lower()
        self.word[i] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
        if low in UNITS or token[:1] in "%€$£°" and not core:
            self.unit[i] = True
        if not plain:
            self.skip[i] = not core.strip()
            self.ends[i] = token == "\n" or token.rstrip("\"')]»”’*_").endswith((".", "!", "?", ":", "…"))
            self.number[i] = core.replace(".", "").replace(",", "").isdecimal()
        if core[:1].isupper() and core[1:].islower():
            self.name[i] = True
        return i

    def rows(self, text: str) -> np.ndarray:
        words = split(text)
        if len(self) + len(words) > CACHE_ENTRIES:
            self.clear()
        if len(words) > CACHE_ENTRIES:  # more words than the cache has rows: distinct ones only
            words_of = {w: None for w in words}
            if len(words_of) > CACHE_ENTRIES:
                self.__init_larger(len(words_of))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def __init_larger(self, n: int) -> None:
        for k in ("word", "skip", "ends", "number", "unit", "name"):
            a = getattr(self, k)
            setattr(self, k, np.concatenate([a, np.zeros(max(0, n - len(a)), a.dtype)]))


def template(text: str, tokens: Tokens) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(reading, template token hashes, slot values, whether a word) for every reading of a text that
    differs from the others.  A slot value is 0 where the token is a word."""
    rows = tokens.rows(text)
    before = np.concatenate([[0], np.cumsum(tokens.ends[rows])])
    kept = np.flatnonzero(~tokens.skip[rows])
    rows = rows[kept]
    if not len(rows):
        return []
    ends = before[kept]
    start = np.ones(len(rows), bool)
    start[1:] = ends[1:] > ends[:-1]
    value = tokens.word[rows]
    number = tokens.number[rows]
    unit = np.zeros(len(rows), bool)
    unit[1:] = tokens.unit[rows][1:] & number[:-1]
    plain = np.where(number, np.uint64(_NUMBER), np.where(unit, np.uint64(_UNIT), value))
    fixed = number | unit
    none = np.zeros(len(rows), np.uint64)
    out = [(RAW, value, none, ~fixed), (PLAIN, plain, np.where(fixed, value | np.uint64(1), none), ~fixed)]
    capital = tokens.name[rows] & ~unit
    for reading, name in ((NAMES, capital & ~start), (ALL, capital)):
        if not name.any() or reading == ALL and not (capital & start).any():
            continue
        token, slot, mixed = np.where(name, np.uint64(_NAME), plain), fixed | name, value
        run_on = np.zeros(len(rows), bool)  # a name that goes on
        run_on[1:] = name[1:] & name[:-1] & ~start[1:]
        if run_on.any():
            if reading == ALL or not (capital & start).any():
                out.append((EACH, token, np.where(slot, value | np.uint64(1), none), ~slot))
            first = np.flatnonzero(~run_on)
            place = np.arange(len(rows)) - np.maximum.accumulate(np.where(run_on, 0, np.arange(len(rows))))
            mixed = np.add.reduceat(value * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), first)
            token, slot = token[first], slot[first]
        out.append((reading, token, np.where(slot, mixed | np.uint64(1), np.uint64(0)), ~slot))
    return out


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as the longest text needs."""

    base = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([a, a * np.uint64(pow(b, k, 1 << 64))])
                                  for a, b in ((self.up, self.base), (self.down, pow(self.base, -1, 1 << 64))))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def windows(reading: int, token: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, whether enough words) of all windows of ``size`` template tokens."""
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = _POWERS.first(len(token))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(token * up)])
    h = (total[size:] - total[:-size]) * down[:n]
    if reading == RAW:  # no template has its hashes
        h += np.uint64(_RAW)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    words = np.concatenate([[0], np.cumsum(word)])
    return h, words[size:] - words[:-size] >= max(5, math.ceil(MIN_LITERAL * size))


_OUT = [("reading", pa.int32()), ("hash", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("slots", pa.list_(pa.int64()))]


def _batch(keys: list, key_types, rows: list[tuple]) -> pa.RecordBatch:
    """``rows``: (key index, reading, hashes, size, positions, values)."""
    own = np.concatenate([np.full(len(p), i) for i, *_, p, _ in rows] or [np.zeros(0, int)])
    slots = [v[p:p + size][v[p:p + size] > 0].astype(np.int64).tolist() for *_, size, ps, v in rows for p in ps]
    arrays = [pa.array([k[i] for i in own], t) for k, (_, t) in zip(keys, key_types)]
    arrays += [pa.array(np.concatenate([np.full(len(p), r) for _, r, _, _, p, _ in rows] or [np.zeros(0)]).astype(np.int32)),
               pa.array(np.concatenate([h for _, _, h, *_ in rows] or [np.zeros(0, np.uint64)]).astype(np.int64)),
               pa.array(np.concatenate([np.full(len(p), s) for *_, s, p, _ in rows] or [np.zeros(0)]).astype(np.int32)),
               pa.array(np.concatenate([p for *_, p, _ in rows] or [np.zeros(0)]).astype(np.int32)),
               pa.array(slots, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in [*key_types, *_OUT]])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_tokens, reading, hash, size, pos, slots): the windows of ``benchmark(item_id, text)``."""

    def run(batches):
        tokens = Tokens()
        for b in batches:
            ids, lengths, rows = [], [], []
            for item_id, text in zip(column_of(b, "item_id"), column_of(b, "text")):
                found = []
                for reading, token, value, word in template(text or "", tokens):
                    size = min(WINDOW, len(token))
                    h, good = windows(reading, token, word, size)
                    found.append((reading, h, good, size, value, len(token)))
                short = not any(good.any() for _, _, good, *_ in found)  # of words: raw words only
                for reading, h, good, size, value, n in found:
                    at = np.flatnonzero(good | (short and reading == RAW and n >= MIN_RAW))
                    rows.append((len(ids), reading, h[at], size, at, value))
                    ids.append(item_id)
                    lengths.append(n)
            yield _batch([ids, lengths], [("item_id", b.schema.field("item_id").type), ("n_tokens", pa.int32())], rows)

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return (benchmark.select("item_id", "text")
            .mapInArrow(run, f"item_id {kind}, n_tokens int, reading int, hash long, size int, pos int, slots array<long>"))


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """(hash): the benchmark's words."""

    def run(batches):
        tokens = Tokens()
        for b in batches:
            for text in column_of(b, "text"):
                rows = np.unique(tokens.rows(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.word[rows].astype(np.int64))], names=["hash"])

    return benchmark.select("text").mapInArrow(run, "hash long")


def hash_filter(bench: DataFrame) -> np.ndarray:
    """Bitmap of the hashes; at most 2^18 words come to the driver."""
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    word = (bench.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int").alias("bit"))
            .groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in word.collect():
        out[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    return out


def document_windows(docs: DataFrame, bitmap: np.ndarray, words: np.ndarray, sizes: list[tuple[bool, int]]) -> DataFrame:
    """(doc_id, text_hash, reading, hash, size, pos, slots): windows of whole texts that pass the
    bitmap.  ``words``: bitmap of the benchmark's words; ``sizes``: (whether of raw words, window size)."""
    held = docs.sparkSession.sparkContext.broadcast((bitmap, words))
    least = min((size for _, size in sizes), default=1)

    def run(batches):
        bits, words = held.value
        tokens, known = Tokens(), Known(words)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(start, SLICE_ROWS)
                texts, keys = column_of(b, "text"), [column_of(b, "doc_id"), column_of(b, "text_hash")]
                types = [("doc_id", b.schema.field("doc_id").type), ("text_hash", pa.int64())]
                rows, hits = [], 0
                for i, text in enumerate(texts):
                    if not text or not known.may_match(split(text), least):
                        continue
                    for reading, token, value, word in template(text, tokens):
                        for raw, size in sizes:
                            if raw != (reading == RAW):
                                continue
                            h, good = windows(reading, token, word, size)
                            low = h & np.uint64(FILTER_BITS - 1)
                            hit = (bits[(low >> np.uint64(6)).astype(np.intp)] >> (low & np.uint64(63))) & np.uint64(1) > 0
                            at = np.flatnonzero(hit if raw else hit & good)
                            if len(at):
                                rows.append((i, reading, h[at], size, at, value))
                                hits += len(at)
                    if hits >= FLUSH_HITS:
                        yield _batch(keys, types, rows)
                        rows, hits = [], 0
                if rows:
                    yield _batch(keys, types, rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(run, f"doc_id {kind}, text_hash long, reading int, hash long, size int, pos int, slots array<long>"))


def longest_run(matches: list[tuple[int, list[tuple[int, int]]]]) -> tuple[int, bool]:
    """(windows, whether all values are the item's) of the longest run of ``matches`` -- (item
    position, (item's value, document's value) of each slot) -- whose values go one to one."""
    matches = sorted(matches)
    best, left = (0, False), 0
    place = list(itertools.accumulate(int(i > 0 and m[0] != matches[i - 1][0]) for i, m in enumerate(matches)))
    there: dict[int, list[int]] = {}  # item's value -> [document's value, uses]
    back: dict[int, int] = {}
    changed = 0

    def drop(pairs):
        nonlocal changed
        for a, b in pairs:
            changed -= a != b
            there[a][1] -= 1
            if not there[a][1]:
                del there[a], back[b]

    for i, (_, pairs) in enumerate(matches):
        if len({a for a, _ in pairs}) != len(set(pairs)) or len({b for _, b in pairs}) != len(set(pairs)):
            while left < i:
                drop(matches[left][1])
                left += 1
            left = i + 1
            continue
        while any(a in there and there[a][0] != b or back.get(b, a) != a for a, b in pairs):
            drop(matches[left][1])
            left += 1
        for a, b in pairs:
            there.setdefault(a, [b, 0])[1] += 1
            back[b] = a
            changed += a != b
        best = max(best, (place[i] - place[left] + 1, not changed))
    return best


def _longest(matches):
    return longest_run([(m["item_pos"], [(p["item_slots"], p["slots"]) for p in m["pairs"]]) for m in matches])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, text_hash, item_id, windows (matched
    windows of the best diagonal), coverage (their share of the item's windows), changed (whether
    any of its slots has another value than in the item)."""
    bench = stage(benchmark_windows(benchmark), "benchmark-windows")
    sizes = sorted(tuple(r) for r in bench.select(F.col("reading") == RAW, "size").distinct().collect())  # 2 x WINDOW at most
    found = document_windows(docs, hash_filter(bench), hash_filter(benchmark_words(benchmark)), sizes).distinct()
    theirs = bench.select("item_id", "n_tokens", F.col("reading").alias("item_reading"), "hash", "size",
                          F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")).distinct()
    pairs = F.arrays_zip("item_slots", "slots")
    matched = (found.join(theirs, ["hash", "size"]).filter(F.size("slots") == F.size("item_slots"))
               .withColumn("pairs", pairs).withColumn("diagonal", F.col("pos") - F.col("item_pos")))
    together = matched.groupBy("doc_id", "text_hash", "item_id", "n_tokens", "size", "reading", "item_reading", "diagonal").agg(
        F.collect_set(F.struct("item_pos", "pairs")).alias("matches"))
    runs = together.select("doc_id", "text_hash", "item_id", "n_tokens", "size",
                           F.udf(_longest, "windows long, same boolean")("matches").alias("run"))
    return (runs.filter("run.windows > 0")
            .groupBy("doc_id", "text_hash", "item_id").agg(
                F.max("run").alias("best"),
                F.max(F.col("run.windows") / (F.col("n_tokens") - F.col("size") + 1)).alias("coverage"))
            .select("doc_id", "text_hash", "item_id", "best.windows", "coverage", (~F.col("best.same")).alias("changed")))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("coverage").alias("coverage"),
                                                  F.min("changed").alias("changed"))


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents in which no benchmark item is found, all columns kept."""
    id_, hash_ = fresh(docs, "__leak_id", "__leak_text")
    leaks = (find_leaks(docs, table(spark, sf_dir, "benchmark"))
             .select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct())
    same = (F.col("doc_id").eqNullSafe(F.col(id_))) & (F.xxhash64("text") == F.col(hash_))
    return docs.join(leaks, same, "left_anti")
