"""Structured Streaming jobs: incremental intake, duplicate suppression and running scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, pattern: str = "*.parquet",
                files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; each file is taken once."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def _write_batch(rows: DataFrame, target: str, batch_id: int) -> None:
    """Write one batch as its own partition, replacing what an earlier attempt left."""
    (
        rows.withColumn("_batch", F.lit(batch_id).cast("long"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(target)
    )


def keyed_state(spark: SparkSession) -> None:
    """Keep stream state in RocksDB and log only its changes, so that a trigger reads and writes what its rows touch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _first_per_batch(key: str):
    """The first row of every key in each Arrow batch: what a busy key sends on is cut before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.table({"k": batch.column(key), "row": pa.array(range(batch.num_rows), pa.int64())})
            yield batch.take(keys.group_by("k").aggregate([("row", "min")])["row_min"].combine_chunks())

    return run


def intake(stream: DataFrame, key: str, target: str, checkpoint: str):
    """Append each key once to a Parquet table; a repeated batch or key adds nothing, NULL counts as one key.

    The keys seen are state of the stream, so a trigger looks up its own keys and never reads the
    table.  Which of several rows of a new key stays is open.
    """
    keyed_state(stream.sparkSession)
    fewer = stream.mapInArrow(_first_per_batch(key), stream.schema)
    return fewer.dropDuplicates([key]).writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True)


def suppress_duplicates(stream: DataFrame, key: str, *, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a content key that arrive within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_rates(stream: DataFrame, *, label: str, by: str, ts: str = "ts", delay: str = "1 hour",
                   width: str = "1 day") -> DataFrame:
    """Count, false count and false rate per tumbling window; later rows are dropped."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, width), by)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(label)).alias("n_false"))
        .select(
            F.col("window.start").alias("window_start"), by, "n", "n_false",
            (F.col("n_false") / F.col("n")).alias("false_rate"),
        )
    )


def _beats_earlier(order: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of one run's rows that beat all rows of earlier orders; rows of one order do not beat each other."""
    at = np.argsort(order, kind="stable")
    sorted_order, top = order[at], np.maximum.accumulate(value[at])
    start = np.searchsorted(sorted_order, sorted_order, side="left")
    return np.sort(at[(start == 0) | (value[at] > top[start - 1])])


def _thinned(rows: pd.DataFrame, run: str, order: str, value: str) -> pd.DataFrame:
    """Rows that beat all rows of earlier orders of their run; the others cannot, whatever else their run holds."""
    steps = rows.groupby([run, order], dropna=False, sort=True)[value].max().reset_index()
    upto = steps.groupby(run, dropna=False)[value].cummax()
    steps["_before"] = upto.groupby([steps[run]], dropna=False).shift()
    before = rows[[run, order]].merge(steps[[run, order, "_before"]], on=[run, order], how="left")["_before"].to_numpy()
    return rows[np.isnan(before) | (rows[value].to_numpy() > before)]


class _Best(StatefulProcessor):
    """Keeps the best value of a run between batches."""

    def __init__(self, order: str, value: str):
        self.names = (order, value)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "value double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        order, value = self.names
        known = self.best.get()[0] if self.best.exists() else None
        kept = None
        for part in rows:
            fresh = part if known is None else part[part[value] > known]
            if len(fresh):
                kept = fresh if kept is None else pd.concat([kept, fresh])
                kept = kept.iloc[_beats_earlier(kept[order].to_numpy(), kept[value].to_numpy())]
        if kept is not None:
            self.best.update((float(kept[value].max()),))
            yield kept

    def close(self) -> None:
        pass


def streaming_best(stream: DataFrame, target: str, checkpoint: str, *, run: str = "run", order: str = "epoch",
                   value: str = "val_mean"):
    """Append the rows that beat every earlier row of their run; batches arrive in ``order``.

    The state is one number a run.  Before the shuffle each Arrow batch is cut to the rows that
    beat the earlier ones in it, so of a busy run only candidates travel; its task holds no more
    than the improvements of one trigger, which are its result.  Rows without an order or a value
    never improve; of several rows of one order each that beats all earlier orders is kept.
    """
    keyed_state(stream.sparkSession)
    rows = stream.select(run, order, F.col(value).cast("double").alias(value)).where(
        F.col(order).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)
    )

    def thin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _thinned(part, run, order, value)

    best = rows.mapInPandas(thin, rows.schema).groupBy(run).transformWithStateInPandas(
        _Best(order, value), rows.schema, outputMode="Append", timeMode="None"
    )
    return best.writeStream.outputMode("append").format("parquet").option("path", target).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True)


def running_occupancy(stream: DataFrame, cell: list[str], case: str, *, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Cases seen per cell so far; a case counts once per cell within the watermark."""
    once = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([case, *cell])
    return once.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_cases"))


def streaming_bursts(stream: DataFrame, *, entity: str, ts: str = "ts", gap: str = "30 minutes",
                     delay: str = "1 hour") -> DataFrame:
    """Bursts of an entity's events, closed once the watermark passes their gap."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), entity)
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"))
        .select(entity, "first_ts", "last_ts", "n_events")
    )


def run_to_table(stream: DataFrame, target: str, checkpoint: str, *, mode: str = "append") -> None:
    """Run everything that is available into a Parquet table and stop."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )
    query.awaitTermination()


def run_to_changes(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Run an aggregate in update mode and append the rows that each trigger changed, as a partition of their own.

    What a trigger writes follows its batch, not the state; :func:`latest_rows` reads the current state.
    """
    keyed_state(stream.sparkSession)
    query = (
        stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: _write_batch(batch, target, n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_rows(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last written row of every key of a table of changes."""
    changes = spark.read.parquet(target)
    rest = [c for c in changes.columns if c not in (*keys, "_batch")]
    last = F.max_by(F.struct(*rest), "_batch").alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def fold_changes(spark: SparkSession, target: str, keys: list[str], folded: str) -> None:
    """Write the last row of every key, with its batch number, as a table of changes of its own.

    A stream may go on appending to ``folded``: later batches have higher numbers.
    """
    changes = spark.read.parquet(target)
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
    last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest]).repartition("_batch").write.mode("overwrite").partitionBy("_batch").parquet(folded)
