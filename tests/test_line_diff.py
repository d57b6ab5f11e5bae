import functools

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import lineage, line_diff


def _table(a, b):
    @functools.cache
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))
    return f(0, 0)


_lines = st.lists(st.sampled_from(["a", "b", "c", "d", "", "long line"]), max_size=24)


@settings(max_examples=300, deadline=None)
@given(_lines, _lines)
def test_common_lines_are_a_longest_common_subsequence(a, b):
    want = _table(tuple(a), tuple(b))
    assert line_diff.common_lines(a, b) == want
    keep = [x for x in a if x in set(b)], [x for x in b if x in set(a)]
    if keep[0]:
        assert line_diff._by_matches(*keep) == line_diff._by_bits(*keep) == want


def test_both_ways_on_long_lists():
    a = [str(i % 7) for i in range(3000)]
    b = [str(i * i % 7) for i in range(2500)]
    assert line_diff._by_bits(a, b) == line_diff._by_matches(a, b)
    n = [str(i) for i in range(50000)]
    assert line_diff.common_lines(n, n[25000:] + n[:25000]) == 25000


def test_moved_lines_are_a_difference(spark):
    pairs = spark.createDataFrame(
        [(1, 2, "a\nb\nc\n", "c\na\nb"), (3, 4, "x", None), (5, 6, "", "x"), (7, 8, None, None), (9, 10, "same\n", "same")],
        "child_id long, parent_id long, child_text string, parent_text string")
    got = {r.child_id: tuple(r)[2:] for r in line_diff.ordered_line_diff(pairs).collect()}
    assert got == {1: (1, 1, 2), 3: (1, 0, 0), 5: (1, 1, 0), 7: (0, 0, 0), 9: (0, 0, 1)}
    plain = {r.child_id: tuple(r)[2:] for r in lineage.lineage_line_diff(pairs).collect()}
    assert plain[1] == (0, 0, 3)  # as multisets of lines they are equal


def test_modules_by_order(spark):
    pairs = spark.createDataFrame([(1, 2, {"m": "a"}, {"m": "b"}, None, None)],
                                  "child_id long, parent_id long, child_dependencies map<string,string>, parent_dependencies map<string,string>, "
                                  "child_kernels string, parent_kernels string")
    files = spark.createDataFrame([("a", "1\n2\n3"), ("b", "3\n1\n2")], "path string, text string")
    assert lineage.module_line_diff(pairs, files).count() == 0
    r = lineage.module_line_diff(pairs, files, ordered=True).first()
    assert (r.module, r.added, r.removed, r.common) == ("m", 1, 1, 2)


def test_modules_share_files_without_moving_lines(spark):
    """The counts are those of the lines' multisets, for shared, missing and repeated files and repeated keys."""
    schema = ("child_id long, parent_id long, child_dependencies map<string,string>, parent_dependencies map<string,string>, "
              "child_kernels string, parent_kernels string")
    pairs = spark.createDataFrame([
        (1, 2, {"m": "a", "n": "b"}, {"m": "b", "n": "gone"}, None, "k"), (3, 4, {"m": "a"}, {"m": "b"}, "k", "k"),
        (5, 6, {"m": "a"}, {"m": "b"}, None, None), (5, 6, {"m": "b"}, {"m": "c"}, None, None),
        (7, 8, {"m": "twice"}, {"m": "a"}, None, None), (None, 9, {"m": "a"}, {"m": "b"}, None, None)], schema)
    files = spark.createDataFrame([("a", "1\n2\n2\n"), ("b", "2\n3"), ("c", ""), ("k", "x"), ("twice", "1"), ("twice", "9\n1")],
                                  "path string, text string")
    df = lineage.module_line_diff(pairs, files)
    got = sorted((r.child_id, r.module, r.added, r.removed, r.common, r.child_path, r.parent_path) for r in df.collect())
    # key 5 comes twice: each module row of one side meets both of the other
    five = [(5, "m", 6, 0, 4, c, p) for c in "ab" for p in "bc"]
    assert got == [(1, "m", 2, 1, 1, "a", "b"), (1, "n", 2, 0, 0, "b", "gone"), (1, "triton_kernels", 0, 1, 0, None, "k"),
                   (3, "m", 2, 1, 1, "a", "b"), *five, *[(7, "m", 1, 4, 2, "twice", "a")] * 2]


def test_module_lines_meet_no_exchange(spark, monkeypatch):
    """Only what comes again (keys or paths) is counted line by line."""
    seen = []
    real = lineage.lineage_line_diff
    monkeypatch.setattr(lineage, "lineage_line_diff", lambda pairs, key: seen.append(pairs.count()) or real(pairs, key))
    pairs = spark.createDataFrame([(i, i + 1, {"m": "a"}, {"m": "b"}, None, None) for i in range(50)],
                                  "child_id long, parent_id long, child_dependencies map<string,string>, "
                                  "parent_dependencies map<string,string>, child_kernels string, parent_kernels string")
    files = spark.createDataFrame([("a", "1\n2"), ("b", "2")], "path string, text string")
    got = lineage.module_line_diff(pairs, files).collect()
    assert len(got) == 50 and {(r.added, r.removed, r.common) for r in got} == {(1, 0, 1)} and seen == [0]
