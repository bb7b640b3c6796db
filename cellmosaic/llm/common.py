"""Helpers shared by the corpus operators: tables, Arrow passes over texts, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.runtime import _ensure_checkpoint_dir, cut

__all__ = ["cut", "written", "erase", "table", "crc_fold", "packed", "without_ids", "batches_of", "SPACE", "slices"]

# Fixed value of the word contracts: ASCII white space, as a character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; NULL ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column) % k, F.lit(0))


def slices(batch: pa.RecordBatch, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``budget`` bytes each (one row at least), to bound memory."""
    rows = max(1, int(batch.num_rows * budget / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def batches_of(
    df: DataFrame, schema: str, per_slice: Callable[[pa.RecordBatch], pa.RecordBatch]
) -> DataFrame:
    """Map every bounded slice of the rows to a record batch of ``schema``, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield per_slice(part)

    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint folder and read it back."""
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def erase(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more; what is not there is left alone."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Whole rows in one column ``_all`` with ``_id``, so that no name of a column can clash; unpack with ``_all.*``."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_all")
    return docs.select(whole, docs["doc_id"].cast("long").alias("_id"), *more)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in the one column of ``ids``; rows without an id stay."""
    gone = ids.toDF("_gone").where("_gone is not null").distinct()
    return packed(docs).join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_all.*")
