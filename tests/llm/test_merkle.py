import hashlib
import zlib

from pyspark.sql import functions as F

from quire.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(hashes, fanout):
    levels = [hashes]
    while len(levels[-1]) > 1:
        h = levels[-1]
        levels.append([H(*h[i:i + fanout]) for i in range(0, len(h), fanout)])
    return levels


def walk(levels, pos, fanout):
    for h in levels[:-1]:
        lo = pos // fanout * fanout
        yield h[lo:pos], h[pos + 1:lo + fanout]
        pos //= fanout


def brute(rows, fanout=3, tamper=lambda r: r[4]):
    """All columns of the query, by the definition."""
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    leaf = {i: H(*map(part, r)) for i, r in enumerate(rows)}
    sources = sorted({r[1] for r in rows}, key=order)
    trees = {}
    for s in sources:
        mine = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (order(rows[i][0]), leaf[i], i))
        trees[s] = mine, grow([leaf[i] for i in mine], fanout)
    top = grow([trees[s][1][-1][0] for s in sources], fanout) if sources else None
    out = []
    for k, s in enumerate(sources):
        mine, levels = trees[s]
        for pos, i in enumerate(mine):
            steps = [*walk(levels, pos, fanout), *walk(top, k, fanout)]
            h = H(*map(part, (*rows[i][:4], tamper(rows[i]))))
            for before, behind in steps:
                h = H(*before, h, *behind)
            out.append((rows[i][0], leaf[i], levels[-1][0], top[-1][0], H(*(x for b, a in steps for x in (*b, *a))), h, h == top[-1][0]))
    return sorted(out, key=str)


def tampered(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    return r[4].replace("\n", "") if hit and r[4] is not None else r[4]


def query(docs, **more):
    found = merkle.merkle_manifest(docs, merkle.without_line_feeds(), **more)
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.folded_root == r.root) for r in found.withColumn(
        "proof", merkle.digest(merkle.proof_text(F.col("path")))).collect()), key=str)


ROWS = ([(i, f"s{i % 4}", "en", i, f"line\n{i}\n") for i in range(60)] + [(100 + i, "big", None, None, "x\ny") for i in range(85)]
        + [(7, None, "de", 3, None), (None, None, "de", None, ""), (None, "s1", "", 0, "\n"), (5, "s1", "en", 5, "line\n5\n"),
           (5, "s1", "en", 5, "line\n5\n"), (5, "s1", "en", 5, "other"), (200, "alone", "en", 1, "é\n漢"), (-3, "", "en", 1, "n")])


def test_manifest_equals_the_definition(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    assert query(docs) == brute(ROWS, tamper=tampered)


def test_other_fanouts_and_untouched_texts(spark):
    docs = spark.createDataFrame(ROWS[:40], SCHEMA)
    for fanout in (2, 5):
        assert query(docs, fanout=fanout) == brute(ROWS[:40], fanout, tampered)
    plain = merkle.merkle_manifest(docs).collect()
    assert len(plain) == 40 and all(r.folded_root == r.root for r in plain)


def test_one_row_one_source_no_row(spark):
    for rows in (ROWS[:1], [r for r in ROWS if r[1] == "big"], [(1, None, None, None, None)]):
        assert query(spark.createDataFrame(rows, SCHEMA)) == brute(rows, tamper=tampered)
    assert query(spark.createDataFrame([], SCHEMA)) == []


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame(ROWS[:30], SCHEMA)
    more = docs.withColumns({c: F.lit(1) for c in ("id", "grp", "leaf", "row", "at", "g", "pos", "size", "tree", "hash", "path", "part")})
    assert query(more) == query(docs)


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, SF).collect()), key=str)
    assert got == brute(rows, tamper=tampered)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
