"""Session helpers shared by the iterative operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows of a task where rows are dealt over as many tasks as their number asks for.
DEALT_ROWS = 500_000


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only where none is configured."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    sc.setCheckpointDir(_shared_folder(spark) or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; empty in local mode without one, refused on a cluster without one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not configured and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured


def scratch(spark: SparkSession, prefix: str) -> str:
    """A new folder for intermediate output: in the shared folder, or a private one in local mode without it."""
    shared = _shared_folder(spark)
    return f"{shared.rstrip('/')}/{prefix}{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=prefix)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    Used where a result feeds several branches or a driver loop.  The copy is on
    reliable storage, so a lost executor costs a re-read and not a recomputation.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(rows: DataFrame, total: int, *keys: str | Column) -> DataFrame:
    """``rows`` by ``keys`` over tasks that grow in number with their ``total`` and not in size.

    Aggregates whose keys hold these need no further exchange, and none of their tasks a longer table.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / DEALT_ROWS))
    return rows.repartition(tasks, *keys)
