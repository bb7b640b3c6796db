"""Records of finished work: what is still pending, and once-only application to a held-out split."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.schema import LEDGER
from ..operators.modelling import Model


class AlreadyAppliedError(RuntimeError):
    """The split has been scored with this model before."""


def pending(cases: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases without an entry in the table of finished work."""
    return cases.join(done.select(key).distinct(), key, "left_anti")


def missing_keys(wanted: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested keys that have no row."""
    return wanted.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def model_hash(model: Model) -> str:
    return hashlib.md5(json.dumps(model.as_dict(), sort_keys=True).encode()).hexdigest()


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(path)
    except Exception as error:  # the ledger is created by the first entry
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def refuse_second(spark: SparkSession, path: str, run: str, split: str, model: Model) -> None:
    """Raise if ``model`` of ``run`` has been applied to ``split`` before."""
    seen = _read(spark, path).where(
        (F.col("run") == run) & (F.col("split") == split) & (F.col("model_hash") == model_hash(model))
    )
    if not seen.isEmpty():
        raise AlreadyAppliedError(f"{split} has already been scored with this model of {run}")


def record_application(
    spark: SparkSession, path: str, run: str, split: str, model: Model, *, force: bool = False
) -> None:
    """Note that ``model`` has been applied to ``split``; a second time is refused.

    A refitted model has another hash, so earlier entries of the run do not bind it.  An entry
    has a folder of its own that only one writer can make, so of two runs at once one fails.
    """
    if not force:
        refuse_second(spark, path, run, split, model)
    digest = model_hash(model)
    entry = hashlib.md5(json.dumps([run, split, digest]).encode()).hexdigest()
    row = spark.range(1).select(
        F.lit(run).alias("run"), F.lit(split).alias("split"), F.lit(digest).alias("model_hash"),
        F.current_timestamp().alias("applied_at"),
    )
    try:
        row.write.mode("append" if force else "errorifexists").parquet(f"{path}/entry={entry}")
    except AnalysisException as error:
        if "ALREADY_EXISTS" not in str(error):
            raise
        raise AlreadyAppliedError(f"{split} is being scored with this model of {run}") from error
