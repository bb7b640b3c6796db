"""Cumulative sums, ranks and exact percentiles that do not put a group in one task.

A plain window over ``partitionBy(key)`` sends all rows of a key to one task.  Here
rows are range partitioned on (key, order), each range accumulates on its own, and
the totals of the earlier ranges of the same key are added from a table that has one
row per range and key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.runtime import cut


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums of ``sums`` within ``keys`` in the given total order."""
    keys = list(keys)
    named = {f"_o{n}": col for n, col in enumerate(order)}
    terms = {f"_s{n}": col for n, col in enumerate(sums.values())}
    ranges = [F.col(k) for k in keys] + list(order)
    placed = cut(
        df.repartitionByRange(*ranges)
        .withColumns({"_range": F.spark_partition_id(), **terms})
    )
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range", *keys)
        .agg(*[F.sum(t).alias(t) for t in terms])
        .select(
            "_range", *keys,
            *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"{t}_before") for t in terms],
        )
    )
    local = placed.withColumns({f"{t}_here": F.sum(t).over(inside) for t in terms})
    joined = _join_null_safe(local, offsets, ["_range", *keys])
    return joined.select(
        *[joined[c] for c in df.columns],
        *[(F.col(f"{t}_here") + F.col(f"{t}_before")).alias(name) for t, name in zip(terms, sums)],
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond).drop(*[f"_r_{k}" for k in keys])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add the 1-based position of each row within ``keys``; ``order`` must be total."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the ascending rank of each row within ``keys``; equal values share their mean rank."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    placed = running_totals(counts, keys, [F.col(value)], {"_last": F.col("_ties")})
    ranks = placed.select(*keys, value, (F.col("_last") - (F.col("_ties") - 1) / 2.0).alias(name))
    return _join_null_safe(df, ranks, [*keys, value])


def running_max_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Add the largest ``value`` among the earlier rows of the group, NULL for the first row."""
    keys = list(keys)
    ranges = [F.col(k) for k in keys] + list(order)
    placed = cut(df.repartitionByRange(*ranges).withColumns({"_range": F.spark_partition_id(), "_v": value}))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range", *keys).agg(F.max("_v").alias("_m"))
        .select("_range", *keys, F.max("_m").over(earlier).alias("_before"))
    )
    local = placed.withColumn("_here", F.max("_v").over(inside))
    joined = _join_null_safe(local, offsets, ["_range", *keys])
    return joined.select(*[joined[c] for c in df.columns], F.greatest("_here", "_before").alias(name))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated percentiles per key, from running counts of distinct values.

    NULL values are ignored.  Equals the built-in ``percentile`` but holds no group in
    memory: equal values are pre-aggregated and the rest is range partitioned.
    """
    keys = list(keys)
    if not keys:
        whole = exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, fractions)
        return whole.drop("_all")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    cumulative = running_totals(counts, keys, [F.col(value)], {"_upto_rows": F.col("_rows")})
    totals = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_all_rows"))
    rows = _join_null_safe(cumulative, totals, keys)
    first, last = F.col("_upto_rows") - F.col("_rows"), F.col("_upto_rows") - 1
    aggs = []
    for name, fraction in fractions.items():
        position = F.lit(float(fraction)) * (F.col("_all_rows") - 1)
        low, high = F.floor(position), F.ceil(position)
        at_low = F.max(F.when((first <= low) & (low <= last), F.col(value)))
        at_high = F.max(F.when((first <= high) & (high <= last), F.col(value)))
        weight = F.max(position - low)
        aggs.append((at_low + (at_high - at_low) * weight).alias(name))
    return rows.groupBy(*keys).agg(*aggs)
