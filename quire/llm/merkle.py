"""Merkle manifest of a dataset: leaf digests, a tree per source, a tree over the sources, proofs.

Every row is a leaf, the digest of its fields.  The leaves of a source ascend by id; runs of ``fanout``
neighbours become the digest of their digests (a last run may be shorter, and a run of one is digested
too) until one node remains, the subroot.  The subroots, by source, make one more tree the same way.

Slot pivot.  A level is one aggregation by (tree, position div fanout): conditional aggregates put each
child's digest into the column of its slot.  The columns put together are the parent's input, and
without one slot's column they are the siblings of that slot's child.  So a second pass, from the root
down, needs no look-up among siblings: a pivoted row meets the path above its parent and gives each of
its children the pair (siblings before, siblings behind) on top of that path.  At the leaves the path
is folded: once as the proof, once with the row's present digest to a root that must be the root.

Scale.  Texts never leave the scan; a leaf is two digests.  Positions come from a range sort by
(source, id, leaf, row number), so neither a source, nor an id, nor a repeated row makes a large task;
running counts are taken per (source, sort partition).  A level has a third of the rows of the level
below, and its keys are spread however large a source is.  Leaves ride along in the lowest pivot, so
paths are shuffled for a third of the leaves only.  The driver holds two counts and the root.  Each
level is written to the shared folder.

Defined cases.  A null field is ``-``; an empty text is ``0:``.  A null source is a source of its own,
the first.  Null ids stand first; equal ids stand by leaf digest, and repeated rows each are a leaf.
An empty table gives no rows.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stage, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3

_EMPTY_PATH = "cast(array() as array<struct<before:string,behind:string>>)"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as the leaves hold it: ``-`` for null, else byte count, colon, value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaves(docs: DataFrame, present: Column, fields=FIELDS, id_col: str = "doc_id", group: str = "source") -> DataFrame:
    """(id, grp, leaf, now, row): the digest of each row as recorded, and as found when its text is
    ``present``; ``row`` tells repeated rows apart."""
    recorded = [field(F.col(f)) for f in fields]
    found = [field(present) if f == "text" else field(F.col(f)) for f in fields]
    return docs.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), digest(*recorded).alias("leaf"),
                       digest(*found).alias("now"), F.monotonically_increasing_id().alias("row"))


def positions(rows: DataFrame, group: str | None, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (place in its group by ``order``, nulls first, from 0) and ``size`` (rows of
    the group).  ``order`` must tell rows apart.  A range sort numbers the rows of each partition; the
    numbers of a group's first row and its count per partition, a small table, give the rest."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    at = stage(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
               .withColumn("at", F.monotonically_increasing_id()), name)
    at = at.withColumn("part", F.shiftright("at", 33)).withColumn("g", F.col(group) if group else F.lit(0))
    spans = at.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy("g")
    before = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("g").alias("g_"), F.col("part").alias("part_"), "first",
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(of_group).alias("size"))
    return (at.join(spans, F.col("g").eqNullSafe(F.col("g_")) & (F.col("part") == F.col("part_")))
            .withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
            .drop("at", "part", "g", "g_", "part_", "first", "before"))


def _up(fanout: int) -> Column:
    return F.floor(F.col("pos") / fanout)


def pivot(nodes: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """The parents of ``nodes(tree, pos, size, hash, carried...)``: (tree, pos, size, hash) and the
    columns of every slot, ``hash_0`` and so on."""
    slot = F.col("pos") % fanout
    spread = [F.max(F.when(slot == i, F.col(c))).alias(f"{c}_{i}") for i in range(fanout) for c in ("hash", *carried)]
    run = nodes.groupBy("tree", _up(fanout).alias("up"), F.ceil(F.col("size") / fanout).alias("above")).agg(*spread)
    own = digest(*(F.coalesce(f"hash_{i}", F.lit("")) for i in range(fanout)))
    return run.withColumnsRenamed({"up": "pos", "above": "size"}).withColumn("hash", own)


def build(nodes: DataFrame, largest: int, carried: list[str], fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of pivoted parents, lowest first, and the roots (tree, hash, level).  ``largest``: the
    nodes of the largest tree; a tree of one node is its own root."""
    levels: list[DataFrame] = []
    core = ["tree", "pos", "size", "hash"]
    roots = nodes.filter("size = 1").select("tree", "hash", F.lit(0).alias("level"))
    while largest > 1:
        nodes = stage(pivot(nodes.filter("size > 1"), carried, fanout), f"{name}-{len(levels)}")
        levels.append(nodes)
        roots = roots.union(nodes.filter("size = 1").select("tree", "hash", F.lit(len(levels)).alias("level")))
        nodes, carried, largest = nodes.select(core), [], -(-largest // fanout)
    return levels, roots


def _siblings(own: int, fanout: int) -> Column:
    part = lambda slots: F.concat(F.lit(""), *(F.coalesce(f"hash_{i}", F.lit("")) for i in slots))
    return F.struct(part(range(own)).alias("before"), part(range(own + 1, fanout)).alias("behind"))


def paths(levels: list[DataFrame], tops: DataFrame, carried: list[str], fanout: int, name: str) -> DataFrame:
    """(tree, pos, hash, carried..., path) of the nodes below the lowest level.  ``tops(tree, level,
    path)``: the path above each tree's root and the root's level."""
    above = None
    for k in reversed(range(len(levels))):
        ends = tops.filter(F.col("level") == k + 1).select("tree", F.lit(0).cast("long").alias("pos"), "path")
        above = ends if above is None else above.unionByName(ends)
        keep = carried if k == 0 else []
        child = [F.struct((F.col("pos") * fanout + i).alias("pos"), F.col(f"hash_{i}").alias("hash"),
                          *(F.col(f"{c}_{i}").alias(c) for c in keep),
                          F.concat(F.array(_siblings(i, fanout)), F.col("path")).alias("path")) for i in range(fanout)]
        above = (levels[k].drop("hash", "size").join(above, ["tree", "pos"])
                 .select("tree", F.explode(F.array(*child)).alias("x")).select("tree", "x.*").filter("hash is not null"))
        if k:
            above = stage(above.drop("hash"), f"{name}-{k}")
    return above


def fold(path: Column, start: Column) -> Column:
    """The root that ``start`` leads to along ``path``."""
    return F.aggregate(path, start, lambda h, s: digest(s["before"], h, s["behind"]))


def proof_text(path: Column) -> Column:
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["behind"])))


def merkle_manifest(docs: DataFrame, present: Column | None = None, fields=FIELDS, id_col: str = "doc_id",
                    group: str = "source", fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: id, grp, leaf, subroot, root, path (array of the siblings before and
    behind, leaf to root), folded_root (from the row with its text replaced by ``present``)."""
    carried = ["id", "now"]
    found = stage(leaves(docs, F.col("text") if present is None else present, fields, id_col, group), "merkle-leaves")
    placed = positions(found, "grp", ["id", "leaf", "row"], "merkle-sorted")
    groups = positions(placed.select("grp", "size").withColumnRenamed("size", "leaves").distinct(), None, ["grp"], "merkle-sources")
    groups = stage(groups.select("grp", "leaves", F.col("pos").alias("tree"), F.col("size").alias("trees")), "merkle-trees")
    nodes = stage(placed.join(groups.withColumnsRenamed({"grp": "grp_"}), F.col("grp").eqNullSafe(F.col("grp_")))
                  .select("tree", "pos", "size", F.col("leaf").alias("hash"), "id", "now"), "merkle-nodes")
    largest, trees = groups.agg(F.max("leaves"), F.max("trees")).first()

    levels, subroots = build(nodes, largest or 0, carried, fanout, "merkle-level")
    subroots = stage(subroots, "merkle-subroots")
    top = (subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
                           F.lit(trees or 0).cast("long").alias("size"), "hash", "level"))
    top_levels, roots = build(top, trees or 0, ["level"], fanout, "merkle-top")
    start = roots.select("tree", F.col("level").alias("at"), F.expr(_EMPTY_PATH).alias("path"))
    if top_levels:
        tops = paths(top_levels, start.withColumnRenamed("at", "level"), ["level"], fanout, "merkle-top-paths")
    else:
        tops = top.join(start, "tree").select("tree", "pos", "hash", "level", "path")
    tops = stage(tops.select(F.col("pos").alias("tree"), "level", "path", F.col("hash").alias("subroot")), "merkle-tops")

    core = ["tree", "hash", "id", "now", "path"]
    alone = nodes.filter("size = 1").join(tops.select("tree", "path"), "tree").select(core)
    below = paths(levels, tops.drop("subroot"), carried, fanout, "merkle-paths").select(core).union(alone) if levels else alone
    root = roots.select("hash").first()
    names = tops.select("tree", "subroot").join(groups.select("tree", "grp"), "tree")
    return below.join(names, "tree").select(
        "id", "grp", F.col("hash").alias("leaf"), "subroot", F.lit(root.hash if root else None).cast("string").alias("root"), "path",
        fold(F.col("path"), F.col("now")).alias("folded_root"))


def without_line_feeds(id_col: str = "doc_id") -> Column:
    """The query's tampering: texts of every second id lose their line feeds."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    found = merkle_manifest(table(spark, sf_dir, "documents"), without_line_feeds())
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                        digest(proof_text(F.col("path"))).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of the decimal id is written out bit by bit: DuckDB has no such function.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, 0 AS i, 4294967295::BIGINT AS c, CAST(doc_id AS VARCHAR) AS t FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, i + 1,
         list_reduce([xor(c, ascii(substr(t, i + 1, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                     lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), t
  FROM bits WHERE i < length(t)),
odd AS (SELECT doc_id, xor(c, 4294967295) % 2 = 0 AS hit FROM bits WHERE i = length(t)),
recorded AS (
  SELECT d.doc_id, d.source,
    coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(d.source) || ':' || d.source, '-')
      || coalesce(strlen(d.lang) || ':' || d.lang, '-') || coalesce(strlen(CAST(d.n_chars AS VARCHAR)) || ':' || d.n_chars, '-') AS head,
    d.text, CASE WHEN o.hit THEN replace(d.text, chr(10), '') ELSE d.text END AS present
  FROM documents d LEFT JOIN odd o ON d.doc_id = o.doc_id),
leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(present) || ':' || present, '-')) AS now
  FROM recorded),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
levels AS (
  SELECT source, 0 AS k, list(leaf ORDER BY pos) AS hs FROM placed GROUP BY source
  UNION ALL
  SELECT source, k + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], '')))
  FROM levels WHERE len(hs) > 1),
tops AS (SELECT source, k AS height, hs[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS no FROM levels WHERE len(hs) = 1),
top_levels AS (
  SELECT 0 AS k, list(subroot ORDER BY no) AS hs FROM tops
  UNION ALL
  SELECT k + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], ''))) FROM top_levels WHERE len(hs) > 1),
top AS (SELECT k AS top_height, hs[1] AS root FROM top_levels WHERE len(hs) = 1),
walk AS (
  SELECT p.source, p.pos AS row_no, p.doc_id, p.leaf, t.subroot, top.root, t.no, t.height, top.top_height, p.pos AS spot, 0 AS k, p.now AS h, '' AS proof
  FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source, top
  UNION ALL
  SELECT source, row_no, doc_id, leaf, subroot, root, no, height, top_height,
         CASE WHEN k + 1 = height THEN no ELSE spot // 3 END, k + 1,
         sha256(before || h || behind), proof || before || behind
  FROM (
    SELECT w.*, array_to_string(coalesce(l.hs, g.hs)[w.spot // 3 * 3 + 1:w.spot], '') AS before,
           array_to_string(coalesce(l.hs, g.hs)[w.spot + 2:w.spot // 3 * 3 + 3], '') AS behind
    FROM (SELECT * REPLACE (CASE WHEN k = 0 AND height = 0 THEN no ELSE spot END AS spot) FROM walk WHERE k < height + top_height) w
    LEFT JOIN levels l ON l.source IS NOT DISTINCT FROM w.source AND l.k = w.k AND w.k < w.height
    LEFT JOIN top_levels g ON g.k = w.k - w.height AND w.k >= w.height))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM walk WHERE k = height + top_height
"""
