"""Code identity and lineage."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.line_diff import line_counts, ordered_line_diff

# Separators of the code identity byte layout.
KERNELS_SEP = "\n---KERNELS---\n"
DEPENDENCY_SEP = "\n---DEPENDENCY---\n"


def lineage_edges(runs: DataFrame) -> DataFrame:
    """Distinct code versions (code_hash, parent_hash) with the parent
    resolved against known code hashes.  The parent hash is the hash of the
    parent *file alone*, so it can differ from the parent's own code_hash."""
    versions = runs.where(F.col("code_hash").isNotNull()).select("code_hash", "parent_hash").distinct()
    known = runs.where(F.col("code_hash").isNotNull()).select(F.col("code_hash").alias("parent_hash")).distinct() \
        .withColumn("parent_known", F.lit(True))
    return versions.join(known, "parent_hash", "left").select(
        "code_hash", "parent_hash",
        F.when(F.col("parent_hash").isNull(), F.lit(None).cast("boolean"))
        .otherwise(F.coalesce("parent_known", F.lit(False))).alias("parent_known"))


def lineage_line_diff(pairs: DataFrame, key=("child_id", "parent_id"),
                      child: str = "child_text", parent: str = "parent_text") -> DataFrame:
    """L2 (re-aimed): per pair, lines added / removed / common as multisets of
    lines.  Lines are exploded and counted per (pair, line); a full outer join
    of the two counts gives the difference -- no per-pair text diff library."""
    key = list(key)
    # a null text has no lines, an empty one the empty line
    lines = lambda c: F.explode(F.split(F.regexp_replace(F.col(c), r"\n\z", ""), "\n"))
    a = pairs.select(*key, lines(child).alias("line")).groupBy(*key, "line").agg(F.count(F.lit(1)).alias("nc"))
    b = pairs.select(*key, lines(parent).alias("line")).groupBy(*key, "line").agg(F.count(F.lit(1)).alias("np"))
    j = a.join(b, [*key, "line"], "full_outer")
    nc, np_ = F.coalesce("nc", F.lit(0)), F.coalesce("np", F.lit(0))
    return j.groupBy(*key).agg(
        F.sum(F.greatest(nc - np_, F.lit(0))).cast("bigint").alias("added"),
        F.sum(F.greatest(np_ - nc, F.lit(0))).cast("bigint").alias("removed"),
        F.sum(F.least(nc, np_)).cast("bigint").alias("common"))


def module_line_diff(pairs: DataFrame, files: DataFrame, key=("child_id", "parent_id"), ordered: bool = False) -> DataFrame:
    """L2/U5 per module: the modules of a child and its parent side by side (a
    full outer join by module name; kernels count as module
    ``triton_kernels``), with the line counts of :func:`lineage_line_diff`.
    A module one side lacks, or whose file is missing, has no lines there;
    modules without a difference are left out.  ``ordered`` counts by
    :func:`quire.operators.line_diff.ordered_line_diff` instead, where moved
    lines are a difference.

    ``pairs``: key, child_dependencies, parent_dependencies (maps module ->
    path), child_kernels, parent_kernels (paths or null); ``files``: path, text."""
    key = list(key)

    def side(who: str) -> DataFrame:
        kernels = F.nullif(F.col(f"{who}_kernels"), F.lit(""))
        own = F.map_entries(F.coalesce(f"{who}_dependencies", F.create_map().cast("map<string,string>")))
        named = F.when(kernels.isNotNull(), F.array(F.struct(F.lit("triton_kernels").alias("key"), kernels.alias("value"))))
        every = F.concat(own, F.coalesce(named, F.array().cast("array<struct<key:string,value:string>>")))
        return pairs.select(*key, F.explode(every).alias("e")).select(
            *key, F.col("e.key").alias("module"), F.col("e.value").alias(f"{who}_path"))

    both = side("child").join(side("parent"), [*key, "module"], "full_outer")
    paths = ["child_path", "parent_path"]

    def with_texts(rows: DataFrame) -> DataFrame:
        for who in ("child", "parent"):
            f = files.select(F.col("path").alias(f"{who}_path"), F.col("text").alias(f"{who}_text"))
            rows = rows.join(f, f"{who}_path", "left")
        return rows.withColumns({f"{who}_text": F.when(F.coalesce(F.col(f"{who}_text"), F.lit("")) != "", F.col(f"{who}_text"))
                                 for who in ("child", "parent")})

    if ordered:
        both = with_texts(both)
        return ordered_line_diff(both, (*key, "module")).where("added + removed > 0").join(
            both.select(*key, "module", *paths), [*key, "module"])
    # A key that comes once has the counts of its two files.  Those are read once for all keys that share
    # them, and no line leaves its task.  Keys and paths that come again are added up line by line.
    again = files.groupBy("path").agg(F.count(F.lit(1)).alias("_files")).where("_files > 1").select("path", F.lit(1).alias("_again"))
    both = both.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*key, "module")))
    for who in ("child", "parent"):
        both = both.join(again.select(F.col("path").alias(f"{who}_path"), F.col("_again").alias(f"_{who}")), f"{who}_path", "left")
    once = (F.col("_rows") == 1) & F.col("_child").isNull() & F.col("_parent").isNull()
    plain, summed = both.where(once).select(*key, "module", *paths), with_texts(both.where(~once).select(*key, "module", *paths))
    shared = line_counts(with_texts(plain.select(*paths).distinct()), paths)
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in paths]
    counts = shared.where("added + removed > 0").withColumnsRenamed({c: f"_{c}" for c in paths})
    whole = [F.col(c).isNotNull() for c in key]  # keys with a null have no counts of their own
    columns = [*key, "module", "added", "removed", "common", *paths]
    out = plain.where(reduce(and_, whole)).join(counts, reduce(and_, same)).select(*columns)
    old = lineage_line_diff(summed, (*key, "module")).where("added + removed > 0").join(
        summed.select(*key, "module", *paths), [*key, "module"])
    return out.unionByName(old.select(*columns))


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """H1: sha256 of each file against an expected table: ok / mismatch / unset.
    ``files``: (name, content BINARY), or (name, sha256) as
    :func:`quire.sources.text_files.file_digests` computes it, block by block;
    ``expected``: (name, sha256)."""
    actual = F.sha2(F.col("content"), 256) if "content" in files.columns else F.col("sha256")
    j = files.select("name", actual.alias("actual")).join(expected, "name", "left")
    status = F.when(F.col("sha256").isNull(), "unset").when(F.col("sha256") == F.col("actual"), "ok") \
        .otherwise("mismatch")
    return j.select("name", "actual", status.alias("status"))


def ascii_json(text):
    """JSON text with every non-ASCII character as ``\\uXXXX`` escapes of its UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), 0)
    escaped = F.transform(units, lambda u: F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("bigint")))
                          .otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.array_join(escaped, "")).otherwise(text)


def code_hash(versions: DataFrame, files: DataFrame) -> DataFrame:
    """H2: code identity of (script, kernels_path, dependencies) versions:
    sha256(script ‖ KERNELS_SEP ‖ kernels ‖ for each module in sorted order:
    DEPENDENCY_SEP ‖ {"module","path"} JSON ‖ "\\n" ‖ content)[:12]; NULL when
    any file is missing.  ``files``: (path, content BINARY).

    Each *distinct* version is hashed once (dependencies as sorted entries);
    the result joins back on (script, kernels_path, dep_entries)."""
    entries = F.array_sort(F.map_entries(F.coalesce("dependencies", F.create_map().cast("map<string,string>"))))
    kernels = F.nullif(F.col("kernels_path"), F.lit(""))  # an empty path is none
    v = versions.select("script", kernels.alias("kernels_path"), entries.alias("dep_entries")).distinct() \
        .withColumn("_vid", F.sha2(F.to_json(F.struct("script", "kernels_path", "dep_entries")), 256))
    fc = files.select("path", "content")
    j = v.join(fc.withColumnRenamed("path", "script").withColumnRenamed("content", "_script"), "script", "left")
    j = j.join(fc.withColumnRenamed("path", "kernels_path").withColumnRenamed("content", "_kern"),
               "kernels_path", "left")
    deps = v.select("_vid", F.explode("dep_entries").alias("e")).select(
        "_vid", F.col("e.key").alias("module"), F.col("e.value").alias("dpath"))
    deps = deps.join(fc.withColumnRenamed("path", "dpath"), "dpath", "left")
    rec = F.concat(F.lit(DEPENDENCY_SEP).cast("binary"),
                   ascii_json(F.to_json(F.struct(F.col("module"), F.col("dpath").alias("path")))).cast("binary"),
                   F.lit("\n").cast("binary"), F.col("content"))
    dg = deps.groupBy("_vid").agg(  # one row per dependency of one version: bounded by its module count
        F.count(F.lit(1)).alias("_nd"), F.count("content").alias("_found"),
        F.array_sort(F.collect_list(F.struct("module", rec.alias("rec")))).alias("_recs"))
    j = j.join(dg, "_vid", "left")
    empty = F.lit("").cast("binary")
    body = F.concat(
        F.col("_script"),
        F.when(F.col("kernels_path").isNotNull(), F.concat(F.lit(KERNELS_SEP).cast("binary"), F.col("_kern")))
        .otherwise(empty),
        F.coalesce(F.aggregate(F.col("_recs"), empty, lambda acc, x: F.concat(acc, x["rec"])), empty))
    missing = (F.col("_script").isNull() | (F.col("kernels_path").isNotNull() & F.col("_kern").isNull())
               | (F.coalesce("_nd", F.lit(0)) != F.coalesce("_found", F.lit(0))))
    return j.select("script", "kernels_path", "dep_entries",
                    F.when(missing, F.lit(None)).otherwise(F.substring(F.sha2(body, 256), 1, 12)).alias("code_hash"))


def attach_code_hash(runs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Join version hashes back to runs (null-safe on kernels_path)."""
    entries = F.array_sort(F.map_entries(F.coalesce("dependencies", F.create_map().cast("map<string,string>"))))
    r = runs.withColumn("dep_entries", entries)
    h = hashes.select(F.col("script").alias("_s"), F.col("kernels_path").alias("_k"),
                      F.col("dep_entries").alias("_d"), F.col("code_hash").alias("computed_hash"))
    kernels = F.nullif(r["kernels_path"], F.lit(""))
    cond = (r["script"] == h["_s"]) & kernels.eqNullSafe(h["_k"]) & (r["dep_entries"] == h["_d"])
    return r.join(h, cond, "left").drop("_s", "_k", "_d", "dep_entries")
