"""Case discovery and file hashes from a directory tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Layout:
    """How one dataset names its case folders and files."""

    dataset: str
    entity_prefix: str
    folder: str  # regular expression with the entity and the time point as groups
    file: str  # regular expression on the file name with the modality as group
    required: tuple[str, ...]
    label: str


# Fixed naming patterns of the two supported datasets.
GLIOMA = Layout(
    "gli", "gli-", r"BraTS-GLI-(\d+)-(\d+)$", r"^BraTS-GLI-\d+-\d+-(\w+)\.nii\.gz$",
    ("t1c", "t1n", "t2f", "t2w"), "seg",
)
MENINGIOMA = Layout(
    "men_rt", "men-", r"BraTS-MEN-RT-(\d+)-(\d+)$", r"^BraTS-MEN-RT-\d+-\d+_(\w+)\.nii\.gz$", ("t1c",), "gtv",
)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of every file under ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    )


def cases_from_files(files: DataFrame, layout: Layout, subset: str) -> DataFrame:
    """One record per case folder that matches the layout."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(
        folder.alias("case_id"), F.regexp_extract(name, layout.file, 1).alias("_kind"), "path"
    ).where(F.col("case_id").rlike("^" + layout.folder) & (F.col("_kind") != ""))
    wanted = F.col("_kind").isin(list(layout.required))
    return rows.groupBy("case_id").agg(
        F.map_from_entries(F.collect_list(F.when(wanted, F.struct("_kind", "path")))).alias("images"),
        F.max(F.when(F.col("_kind") == layout.label, F.col("path"))).alias("label"),
    ).select(
        F.lit(layout.dataset).alias("dataset"), F.lit(subset).alias("subset"), "case_id",
        F.concat(F.lit(layout.entity_prefix), F.regexp_extract("case_id", layout.folder, 1)).alias("entity_id"),
        F.regexp_extract("case_id", layout.folder, 2).alias("timepoint"), "images", "label",
    )


def missing_modalities(cases: DataFrame, required: Sequence[str]) -> DataFrame:
    """Cases that lack a required modality, with what is missing."""
    gap = F.array_except(F.array(*[F.lit(m) for m in required]), F.map_keys("images"))
    return cases.select("case_id", gap.alias("missing")).where(F.size("missing") > 0)


def require_complete(cases: DataFrame, required: Sequence[str]) -> DataFrame:
    """The same cases; evaluation fails on the first incomplete one."""
    gap = F.array_except(F.array(*[F.lit(m) for m in required]), F.map_keys("images"))
    message = F.concat(F.col("case_id"), F.lit(": missing modalities "), F.concat_ws(",", gap))
    checked = F.when(F.size(gap) > 0, F.raise_error(message).cast("string")).otherwise(F.col("case_id"))
    return cases.withColumn("case_id", checked)


def prefer_source(cases: DataFrame, order: Sequence[str], *, source: str = "source") -> DataFrame:
    """One record per case id: the copy from the earliest source in ``order``.

    Sources that are not listed come last, in the order of their names; no case is lost.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in order]).cast("array<string>"), F.col(source))
    rank = F.when(place > 0, place).otherwise(F.lit(len(order) + 1))
    ties = [F.col(c) for c in ("subset", "label") if c in cases.columns]
    w = Window.partitionBy("dataset", "case_id").orderBy(rank, F.col(source), *ties)
    return cases.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def load_cases(
    spark: SparkSession, roots: Mapping[str, tuple[str, Layout, str]], *,
    prefer: Sequence[str] | None = None, subsets: Sequence[str] | None = None,
) -> DataFrame:
    """Cases of several sources ``{name: (root, layout, subset)}``; the preferred copy in the wanted subsets wins."""
    out = None
    for name, (root, layout, subset) in roots.items():
        found = require_complete(cases_from_files(list_files(spark, root), layout, subset), layout.required)
        rows = found.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    wanted = out if subsets is None else out.where(F.col("subset").isin(list(subsets)))
    return prefer_source(wanted, list(prefer or roots))


def file_hash(spark: SparkSession, root: str, *, pattern: str = "*") -> DataFrame:
    """MD5 of each file's bytes."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    return files.select("path", "length", F.md5("content").alias("file_md5"))
