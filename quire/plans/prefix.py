"""Distributed prefix sums (stream positions) without a single-task window.

``Window.partitionBy(domain).orderBy(pos)`` puts a whole domain -- possibly a
third of the corpus -- into one task.  Instead the order axis is cut into
blocks at approximate quantiles of the first order column:

1. ``approxQuantile`` gives at most ``blocks - 1`` boundaries (a short list on
   the driver); ``_blk`` = number of boundaries <= the order value, a
   deterministic column expression;
2. running sums inside each (key, block) -- a window partitioned by both, so
   a hot key is spread over many tasks;
3. per (key, block) totals -- at most #keys x #blocks rows -- become block
   offsets by a window over that small table;
4. offsets join back on (key, block) (Spark broadcasts them when measured small).

Everything is Catalyst expressions; the result depends on the data only, not
on partition ids, so a recomputed task (executor loss) gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
                blocks: int | None = None) -> DataFrame:
    """Add exclusive running sums: ``values`` maps input column -> output column.

    Output = sum of the input column over earlier rows of the same key in
    ``order`` (0 for the first row).  ``order`` must be unique within a key;
    its first column must be numeric.
    """
    spark = df.sparkSession
    nb = blocks or max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = order[0]
    probs = [i / nb for i in range(1, nb)]
    bounds = sorted(set(df.approxQuantile(first, probs, 1.0 / (4 * nb)))) if nb > 1 else []
    def block(lo: int, hi: int):  # number of boundaries <= the order value, by halving
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(first) >= F.lit(bounds[mid]), block(mid + 1, hi)).otherwise(block(lo, mid))

    d = df.withColumn("_blk", block(0, len(bounds)))
    cols = list(values)
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    loc = d.select("*", *[F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(w), F.lit(0)).alias(f"_loc_{c}")
                          for c in cols])
    tot = d.groupBy(*keys, "_blk").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_tot_{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_blk", *[F.coalesce(F.sum(f"_tot_{c}").over(wb), F.lit(0)).alias(f"_off_{c}")
                                      for c in cols])
    out = loc.join(off, [*keys, "_blk"], "inner")
    for c, o in values.items():
        out = out.withColumn(o, (F.col(f"_off_{c}") + F.col(f"_loc_{c}")).cast("bigint"))
    return out.drop("_blk", *[f"_loc_{c}" for c in cols], *[f"_off_{c}" for c in cols])
