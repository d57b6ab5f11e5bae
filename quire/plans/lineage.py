"""Registered queries: lineage edges, line diffs, checksums, code identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import lineage as ln
from quire.operators.line_diff import ordered_line_diff
from quire.plans.registry import register
from quire.session import table
from quire.sources import fixtures as fx
from quire.sources import logs as txt
from quire.sources.text_files import file_digests


@register("lineage_edges", """
WITH v AS (SELECT DISTINCT code_hash, parent_hash FROM runs WHERE code_hash IS NOT NULL),
k AS (SELECT DISTINCT code_hash AS h FROM runs WHERE code_hash IS NOT NULL)
SELECT v.code_hash, v.parent_hash,
       CASE WHEN v.parent_hash IS NULL THEN NULL ELSE k.h IS NOT NULL END AS parent_known
FROM v LEFT JOIN k ON k.h = v.parent_hash""", ("runs",))
def q_lineage_edges(spark, d):
    return ln.lineage_edges(fx.runs(spark, d))


@register("lineage_line_diff", r"""
WITH p AS (SELECT c.doc_id AS child_id, p.doc_id AS parent_id, c.text AS child_text, p.text AS parent_text
           FROM documents c JOIN documents p ON p.doc_id = c.doc_id + 1),
a AS (SELECT child_id, parent_id, line, count(*) AS nc FROM
        (SELECT child_id, parent_id, unnest(string_split(regexp_replace(coalesce(child_text, ''), '\n$', ''), chr(10))) AS line FROM p)
      GROUP BY ALL),
b AS (SELECT child_id, parent_id, line, count(*) AS np FROM
        (SELECT child_id, parent_id, unnest(string_split(regexp_replace(coalesce(parent_text, ''), '\n$', ''), chr(10))) AS line FROM p)
      GROUP BY ALL),
j AS (SELECT coalesce(a.child_id, b.child_id) AS child_id, coalesce(a.parent_id, b.parent_id) AS parent_id,
             coalesce(nc, 0) AS nc, coalesce(np, 0) AS np
      FROM a FULL OUTER JOIN b ON a.child_id = b.child_id AND a.parent_id = b.parent_id AND a.line = b.line)
SELECT child_id, parent_id, CAST(sum(greatest(nc - np, 0)) AS BIGINT) AS added,
       CAST(sum(greatest(np - nc, 0)) AS BIGINT) AS removed, CAST(sum(least(nc, np)) AS BIGINT) AS common
FROM j GROUP BY child_id, parent_id""")
def q_lineage_line_diff(spark, d):
    return ln.lineage_line_diff(fx.doc_pairs(spark, d))


#: Matches of the two texts' lines by place; ``best`` holds, for each number k of common lines and each
#: place in the child, the earliest place in the parent where such a run of k can end.
ORDERED_SQL = r"""
WITH RECURSIVE p AS (
  SELECT c.doc_id AS child_id, p.doc_id AS parent_id,
         string_split(regexp_replace(c.text, '\n$', ''), chr(10)) AS a, string_split(regexp_replace(p.text, '\n$', ''), chr(10)) AS b
  FROM documents c JOIN documents p ON p.doc_id = c.doc_id + 1),
x AS (SELECT child_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM p),
y AS (SELECT child_id, unnest(b) AS line, generate_subscripts(b, 1) AS j FROM p),
m AS (SELECT child_id, i, j FROM x JOIN y USING (child_id, line)),
best AS (
  SELECT child_id, 1 AS k, i, min(j) AS j FROM m GROUP BY child_id, i
  UNION ALL
  SELECT m.child_id, t.k + 1, m.i, min(m.j) FROM best t JOIN m ON m.child_id = t.child_id AND m.i > t.i AND m.j > t.j
  GROUP BY m.child_id, t.k, m.i),
n AS (SELECT child_id, max(k) AS common FROM best GROUP BY child_id)
SELECT child_id, parent_id, len(a) - coalesce(common, 0) AS added, len(b) - coalesce(common, 0) AS removed,
       CAST(coalesce(common, 0) AS BIGINT) AS common
FROM p LEFT JOIN n USING (child_id)"""


@register("ordered_line_diff", ORDERED_SQL)
def q_ordered_line_diff(spark, d):
    return ordered_line_diff(fx.doc_pairs(spark, d))


@register("module_line_diff", """
WITH n AS (SELECT count(*) AS n FROM documents), f AS (SELECT doc_id, text FROM documents),
c AS (SELECT DISTINCT o_custkey AS c FROM orders),
m AS (
  SELECT c, 'modA' AS module, (c + 2) % n AS cd, (c + 6) % n AS pd FROM c, n
  UNION ALL SELECT c, 'modB', (c + 3) % n, (c + 7) % n FROM c, n
  UNION ALL SELECT c, 'triton_kernels', CASE WHEN c % 3 = 0 THEN (c + 1) % n END, CASE WHEN (c + 4) % 3 = 0 THEN (c + 5) % n END
  FROM c, n WHERE c % 3 = 0 OR (c + 4) % 3 = 0),
t AS (SELECT m.*, nullif(a.text, '') AS ct, nullif(b.text, '') AS pt FROM m LEFT JOIN f a ON a.doc_id = m.cd LEFT JOIN f b ON b.doc_id = m.pd),
x AS (SELECT c, module, line, count(*) AS nc FROM (SELECT c, module, unnest(string_split(ct, chr(10))) AS line FROM t) GROUP BY ALL),
y AS (SELECT c, module, line, count(*) AS np FROM (SELECT c, module, unnest(string_split(pt, chr(10))) AS line FROM t) GROUP BY ALL),
j AS (SELECT coalesce(x.c, y.c) AS c, coalesce(x.module, y.module) AS module, coalesce(nc, 0) AS nc, coalesce(np, 0) AS np
      FROM x FULL OUTER JOIN y ON x.c = y.c AND x.module = y.module AND x.line = y.line)
SELECT c AS child_id, c + 4 AS parent_id, module, CAST(sum(greatest(nc - np, 0)) AS BIGINT) AS added,
       CAST(sum(greatest(np - nc, 0)) AS BIGINT) AS removed, CAST(sum(least(nc, np)) AS BIGINT) AS common
FROM j GROUP BY c, module HAVING sum(abs(nc - np)) > 0""")
def q_module_line_diff(spark, d):
    """Customers as code versions: c against c + 4, with two modules each and kernels every third."""
    n = table(spark, d, "documents").count()
    c = F.col("child_id")
    doc = lambda k: F.concat(F.lit("docs/"), (k % n).cast("string"), F.lit(".txt"))
    deps = lambda b: F.create_map(F.lit("modB"), doc(b + 3), F.lit("modA"), doc(b + 2))
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("child_id")).distinct().select(
        "child_id", (c + 4).alias("parent_id"), deps(c).alias("child_dependencies"), deps(c + 4).alias("parent_dependencies"),
        F.when(c % 3 == 0, doc(c + 1)).alias("child_kernels"), F.when((c + 4) % 3 == 0, doc(c + 5)).alias("parent_kernels"))
    return ln.module_line_diff(pairs, doc_files(spark, d).select("path", "text")).drop("child_path", "parent_path")


def doc_files(spark, d):
    return table(spark, d, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode("text", "UTF-8").alias("content"), "doc_id", "text")


@register("verify_checksums", """
WITH f AS (SELECT 'docs/' || CAST(doc_id AS VARCHAR) || '.txt' AS name, doc_id, text, sha256(text) AS actual FROM documents),
e AS (SELECT name, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE sha256(text || 'x') END AS sha256
      FROM f WHERE doc_id % 3 <> 2)
SELECT f.name, f.actual, CASE WHEN e.sha256 IS NULL THEN 'unset' WHEN e.sha256 = f.actual THEN 'ok'
                              ELSE 'mismatch' END AS status
FROM f LEFT JOIN e USING (name)""")
def q_verify_checksums(spark, d):
    f = doc_files(spark, d)
    exp = f.where(F.col("doc_id") % 3 != 2).select(
        F.col("path").alias("name"),
        F.when(F.col("doc_id") % 3 == 0, F.sha2(F.col("content"), 256))
        .otherwise(F.sha2(F.concat(F.col("text"), F.lit("x")), 256)).alias("sha256"))
    dest = txt.landing_dir(spark, "files")  # the documents as files, each hashed in blocks
    txt.land_files(f.select(F.col("path").alias("relpath"), F.col("text").alias("content")), dest).count()
    return ln.verify_checksums(file_digests(spark, dest).withColumnRenamed("path", "name"), exp)


def code_versions(spark, d):
    """Per run: script, kernels and dependency files chosen by its customer."""
    o = table(spark, d, "orders")
    c = F.col("o_custkey")
    n_docs = table(spark, d, "documents").count()
    doc = lambda k: F.concat(F.lit("docs/"), (k % n_docs).cast("string"), F.lit(".txt"))
    return o.select(
        (F.col("o_orderkey") + 1).alias("id"),
        F.when(c % 10 == 0, F.lit("docs/missing.txt")).otherwise(doc(c)).alias("script"),
        F.when(c % 3 == 0, doc(c + 1)).alias("kernels_path"),
        F.when(c % 4 == 0, F.create_map(F.lit("modB"), doc(c + 3), F.lit("modA"), doc(c + 2)))
        .otherwise(F.create_map().cast("map<string,string>")).alias("dependencies"))


CODE_HASH_SQL = """
WITH f AS (SELECT 'docs/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents),
v AS (SELECT o_orderkey + 1 AS id, o_custkey AS c,
        CASE WHEN o_custkey % 10 = 0 THEN 'docs/missing.txt' ELSE 'docs/' || CAST(o_custkey % n AS VARCHAR) || '.txt' END AS script,
        CASE WHEN o_custkey % 3 = 0 THEN 'docs/' || CAST((o_custkey + 1) % n AS VARCHAR) || '.txt' END AS kern,
        CASE WHEN o_custkey % 4 = 0 THEN 'docs/' || CAST((o_custkey + 2) % n AS VARCHAR) || '.txt' END AS da,
        CASE WHEN o_custkey % 4 = 0 THEN 'docs/' || CAST((o_custkey + 3) % n AS VARCHAR) || '.txt' END AS db
      FROM orders, (SELECT count(*) AS n FROM documents)),
h AS (SELECT v.*, fs.text AS s, fk.text AS k, fa.text AS a, fb.text AS b FROM v
      LEFT JOIN f fs ON fs.path = v.script LEFT JOIN f fk ON fk.path = v.kern
      LEFT JOIN f fa ON fa.path = v.da LEFT JOIN f fb ON fb.path = v.db)
SELECT id, CASE WHEN s IS NULL OR (kern IS NOT NULL AND k IS NULL) OR (da IS NOT NULL AND (a IS NULL OR b IS NULL))
  THEN NULL ELSE substr(sha256(s || coalesce('\n---KERNELS---\n' || k, '')
    || CASE WHEN da IS NOT NULL THEN '\n---DEPENDENCY---\n{"module":"modA","path":"' || da || '"}\n' || a
            || '\n---DEPENDENCY---\n{"module":"modB","path":"' || db || '"}\n' || b ELSE '' END), 1, 12) END AS code_hash
FROM h"""


@register("code_hash", CODE_HASH_SQL)
def q_code_hash(spark, d):
    v = code_versions(spark, d)
    files = doc_files(spark, d).select("path", "content")
    hashes = ln.code_hash(v, files)
    return ln.attach_code_hash(v, hashes).select("id", F.col("computed_hash").alias("code_hash"))
