"""Ranks, cumulative counts and exact percentiles without a single-task sort.

Rows are first reduced to distinct values with counts.  The values are cut into
ranges at approximate quantiles (a bounded list of bounds); counts accumulate in a
window inside a range, and ranges add the bounded table of the ranges' sums before them.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_VALUES, MAX_RANGES = 50_000, 2_048


def once(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of ``spark.checkpoint.dir``: no cached block stays behind, and a lost executor loses nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint()


def _bounds(df: DataFrame, value: str) -> list:
    """Bounds of the ranges: one pass counts the values and takes MAX_RANGES quantiles, of which as many are used as there are ranges."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, [k / MAX_RANGES for k in range(1, MAX_RANGES)], 10 * MAX_RANGES).alias("b")).first()
    ranges = min(MAX_RANGES, got["n"] // RANGE_VALUES)
    if ranges < 2:
        return []
    return sorted({got["b"][k * MAX_RANGES // ranges - 1] for k in range(1, ranges)})


def cumulative(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, value, n, before, total): rows of each distinct value, rows of smaller values, rows of the group.  Null values are left out.

    The counts are written once: the bounds, the ranges' sums and the windows read them, not ``df``.
    """
    groups = groups or []
    counted = once(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")))
    bounds = _bounds(counted, value)
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(value))) if bounds else F.lit(0)
    placed = counted.withColumn("_b", bucket)
    sums = placed.groupBy(*groups, "_b").agg(F.sum("n").alias("_s"))
    w = Window.partitionBy(*groups).orderBy("_b")
    heads = sums.select(*groups, "_b", (F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_o"), F.sum("_s").over(Window.partitionBy(*groups)).alias("total")) if groups else sums.select(
        "_b", (F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_o"), F.sum("_s").over(Window.partitionBy(F.lit(1))).alias("total")
    )
    inside = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    on = [*groups, "_b"]
    joined = placed.withColumn("_c", F.sum("n").over(inside) - F.col("n"))
    cond = [joined[c].eqNullSafe(heads[c]) for c in on]
    out = joined.join(heads, cond)
    return out.select(*[joined[c] for c in groups], joined[value], joined["n"], (F.col("_c") + F.col("_o")).alias("before"), "total")


def midranks(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, value, n, rank): the mean rank of each distinct value."""
    c = cumulative(df, value, groups)
    return c.select(*(groups or []), value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """(groups, n, a column a share): exact percentiles, linear between neighbours, for groups of any size."""
    groups = groups or []
    c = cumulative(df, value, groups)
    spots = [(name, F.lit(s) * (F.col("total") - 1)) for name, s in shares.items()]
    covers = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("n"))
    aggs = [F.first("total").alias("n")]
    for name, p in spots:
        # positions carry rounding errors of the share; they are whole or clearly between
        at = F.round(p, 9)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.max(F.when(covers(low), F.col(value))), F.max(F.when(covers(high), F.col(value)))
        aggs.append((a + (b - a) * F.max(at - low)).alias(name))
    return c.groupBy(*groups).agg(*aggs)


def ranked(df: DataFrame, value: str, ties: list[Column]) -> DataFrame:
    """Add ``rank``: 1 for the smallest value, ties in the order of ``ties``; null values are left out.

    One sort by ranges of value and ties, so that rows of one score may fill many tasks.  A row's place in its range is in its
    identifier's low bits; the sorted rows are written before the ranges are counted, so that both see one order.
    """
    placed = once(df.where(F.col(value).isNotNull()).orderBy(F.col(value), *ties).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # a row a task of the sort
    heads = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_o"))
    return placed.withColumn("_p", part).join(F.broadcast(heads), "_p").withColumn("rank", F.col("_o") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_id", "_o")
