"""Line diffs that know the order of lines (L2).

The lines that stay are a longest common subsequence; the child's other lines are added, the parent's
others removed.  So a moved line is both, and the counts are those of a smallest diff.

Per pair: the common beginning and end are set apart, lines that the other side lacks are dropped (they
belong to no common subsequence), and of the rest the length of the longest one is found in one of two
exact ways, by whichever has less to do.  With few equal lines: the pairs of equal lines, child's order,
parent's order reversed, and a longest increasing run of the parent's positions by sorted search.  With
many: rows of the usual table as bits of one number, one addition per line.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType


def _by_matches(a: list[str], b: list[str]) -> int:
    places = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    ends: list[int] = []  # ends[k]: the earliest place in b where k + 1 common lines can end
    for line in a:
        for j in reversed(places[line]):
            k = bisect_left(ends, j)
            if k == len(ends):
                ends.append(j)
            else:
                ends[k] = j
    return len(ends)


def _by_bits(a: list[str], b: list[str]) -> int:
    n = len(a)
    marks: dict[str, bytearray] = {}
    for i, line in enumerate(a):
        marks.setdefault(line, bytearray(n // 8 + 1))[i // 8] |= 1 << i % 8
    has = {line: int.from_bytes(m, "little") for line, m in marks.items()}
    every = (1 << n) - 1
    row = every  # a zero bit: one more common line ends there
    for line in b:
        both = row & has[line]
        row = (row + both | row - both) & every
    return n - row.bit_count()


def common_lines(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence of two lists of lines."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    in_a, in_b = Counter(a), Counter(b)
    a, b = [x for x in a if x in in_b], [x for x in b if x in in_a]
    matches = sum(k * in_b[x] for x, k in in_a.items())
    if matches:
        head += _by_matches(a, b) if 16 * matches <= len(a) * len(b) or len(a) < 64 else _by_bits(a, b)
    return head + tail


def lines_of(text: str | None) -> list[str]:
    """A null text has no lines, an empty one the empty line; a final line feed ends the last line."""
    return [] if text is None else text.removesuffix("\n").split("\n")


def ordered_line_diff(pairs: DataFrame, key=("child_id", "parent_id"), child: str = "child_text",
                      parent: str = "parent_text") -> DataFrame:
    """Per pair the lines added, removed and common, in order.  Pairs stay where they are; each is
    compared by itself."""
    return _compared(pairs, key, child, parent, common_lines)


def line_counts(pairs: DataFrame, key=("child_id", "parent_id"), child: str = "child_text", parent: str = "parent_text") -> DataFrame:
    """Per pair the lines added, removed and common as multisets, whatever their order."""
    return _compared(pairs, key, child, parent, lambda a, b: (Counter(a) & Counter(b)).total())


def _compared(pairs: DataFrame, key, child: str, parent: str, common) -> DataFrame:
    key = list(key)
    schema = StructType([*(pairs.schema[k] for k in key), *(StructField(c, LongType()) for c in ("added", "removed", "common"))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                counts = []
                for x, y in zip(b.column(len(key)).to_pylist(), b.column(len(key) + 1).to_pylist()):
                    x, y = lines_of(x), lines_of(y)
                    same = common(x, y)
                    counts.append((len(x) - same, len(y) - same, same))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(key)], *(pa.array(c, pa.int64()) for c in zip(*counts))],
                                                 names=schema.names)

    return pairs.select(*key, child, parent).mapInArrow(run, schema)
