"""Typed tables in and out: CSV, Parquet and JSON documents."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import finite
from ..functions.schema import HISTORY
from ..operators.modelling import Model, Renamer, Selector


def read_table(spark: SparkSession, path: str, schema: T.StructType, *, clean: bool = True) -> DataFrame:
    """CSV with a declared schema; empty is NULL, ``nan`` is read and then turned into NULL.

    Columns are found by their names in the header; a missing one, or files whose headers
    differ, are an error, and so is a value that does not fit its type.
    """
    df = spark.read.csv(path, header=True, nullValue="", enforceSchema=False, mode="FAILFAST")
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    columns = []
    for f in schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            words = F.filter(F.split(F.coalesce(column, F.lit("")), " +"), lambda w: w != "")
            column = words.cast(f.dataType)
        else:
            column = column.cast(f.dataType)
            if clean and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                column = finite(column)
        columns.append(column.alias(f.name))
    return df.select(*columns)


def write_table(
    df: DataFrame, path: str, columns: Sequence[str], *, order: Sequence[str | Column] = (), mode: str = "errorifexists"
) -> None:
    """CSV with a declared column order; arrays are written as space-joined text.

    With ``order`` the rows are sorted over all files: read in the order of their names, the
    part files hold the sorted table.
    """
    if order:
        df = df.orderBy(*order)
    out = []
    for name in columns:
        kind = df.schema[name].dataType
        out.append(F.concat_ws(" ", F.transform(name, lambda x: x.cast("string"))).alias(name)
                   if isinstance(kind, T.ArrayType) else F.col(name))
    df.select(*out).write.mode(mode).csv(path, header=True, nullValue="")


def union_ragged(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames with the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_documents(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_model(spark: SparkSession, model: Model, path: str, *, mode: str = "overwrite") -> None:
    text = json.dumps(model.as_dict(), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").write.mode(mode).text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return Model(**json.loads(spark.read.text(path).first().value))


def save_selector(spark: SparkSession, selector: Selector, path: str, *, mode: str = "overwrite") -> None:
    """Store a fitted selector: model and threshold as JSON, its tables as Parquet, one folder each."""
    for name in ("stakes", "calibration", "validation"):
        getattr(selector, name).write.mode(mode).parquet(f"{path}/{name}")
    _save_json(spark, {"model": selector.model.as_dict(), "p_star": selector.p_star}, f"{path}/model", mode)


def load_selector(spark: SparkSession, path: str) -> Selector:
    plain = _load_json(spark, f"{path}/model")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("stakes", "calibration", "validation")}
    return Selector(Model(**plain["model"]), plain["p_star"], **tables)


def save_renamer(spark: SparkSession, renamer: Renamer, path: str, *, mode: str = "overwrite") -> None:
    """Store a fitted renamer with the model of every fold, the folds and the runner-up levels."""
    for name in ("folds", "diagnostics"):
        getattr(renamer, name).write.mode(mode).parquet(f"{path}/{name}")
    plain = {
        "model": renamer.model.as_dict(), "runner_ups": renamer.runner_ups,
        "fold_models": {str(fold): model.as_dict() for fold, model in renamer.fold_models.items()},
    }
    _save_json(spark, plain, f"{path}/model", mode)


def load_renamer(spark: SparkSession, path: str) -> Renamer:
    plain = _load_json(spark, f"{path}/model")
    return Renamer(
        Model(**plain["model"]), spark.read.parquet(f"{path}/folds"),
        {int(fold): Model(**model) for fold, model in plain["fold_models"].items()},
        plain["runner_ups"], spark.read.parquet(f"{path}/diagnostics"),
    )


def _save_json(spark: SparkSession, plain: dict, path: str, mode: str) -> None:
    spark.createDataFrame([(json.dumps(plain, sort_keys=True),)], "value string").write.mode(mode).text(path)


def _load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def guarded_write(
    df: DataFrame, path: str, *, limit: int = 0, mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> bool:
    """Write a Parquet result, unless the run was limited: a smoke run never replaces full results.

    Partitioning large tables by data set and split lets later reads skip the other splits.
    """
    if limit:
        return False
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return True


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Run histories with the run name taken from the folder of each file."""
    rows = spark.read.schema(HISTORY).option("multiLine", True).json(path)
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def class_scores(history: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Validation score per run, epoch and class."""
    names = F.array(*[F.lit(c) for c in class_names])
    return history.where(F.col("val_per_class").isNotNull()).select(
        "run", "epoch", F.posexplode("val_per_class").alias("_pos", "score")
    ).select("run", "epoch", F.get(names, F.col("_pos")).alias("class_name"), "score")
