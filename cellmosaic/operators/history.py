"""Run histories: best value so far, run summaries and bursts in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import struct_max
from .ranking import running_max_before, running_totals


def best_so_far(history: DataFrame, *, run: str = "run", order: Sequence[Column] = (), value: str = "val_mean") -> DataFrame:
    """Flag rows that are strictly better than every earlier row of their run."""
    order = list(order) or [F.col("epoch")]
    rows = history.where(F.col(value).isNotNull())
    seen = running_max_before(rows, [run], order, F.col(value), "best_before")
    return seen.withColumn("is_best", F.col("best_before").isNull() | (F.col(value) > F.col("best_before")))


def run_summary(history: DataFrame, *, run: str = "run") -> DataFrame:
    """Best validation value, the first epoch that reaches it, epochs and hours of each run."""
    best = struct_max("val_mean", F.col("epoch"), fields=["epoch"])
    return history.groupBy(run).agg(
        F.max(F.when(F.col("val_mean").isNotNull(), F.col("val_mean"))).alias("best"),
        best.alias("_b"), F.count(F.lit(1)).alias("n_epochs"), (F.sum("secs") / 3600.0).alias("hours"),
    ).select(run, "best", F.col("_b.epoch").alias("best_epoch"), "n_epochs", "hours")


def bursts(events: DataFrame, *, entity: str, ts: str, gap_seconds: int, order: Sequence[Column] = ()) -> DataFrame:
    """Maximal runs of an entity's events in which neighbours are less than ``gap_seconds`` apart.

    The one-dimensional form of region labelling; entities with very many events stay spread.
    """
    tie = list(order)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    last = running_max_before(events, [entity], [F.col(ts), *tie], F.col(ts), "_prev")
    micros = F.unix_micros(ts) - F.unix_micros("_prev")
    starts = last.withColumn(
        "_new", F.when(F.col("_prev").isNull() | (micros >= gap_seconds * 1_000_000), 1).otherwise(0)
    )
    numbered = running_totals(starts, [entity], [F.col(ts), *tie], {"burst": F.col("_new")})
    return numbered.groupBy(entity, "burst").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events")
    )
