"""Mask edits: size filters, keep/drop decisions, renames, fallback fill and oracle masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import CLASS_NAMES, MIN_CELLS, struct_max
from ..functions.runtime import cut
from .geometry import CELL
from .labelling import label_regions, region_sizes
from .matching import Matching, label_both, match_regions

CLASS_REGION = ("case_id", "class_value", "comp_id")


def label_classes(cells: DataFrame, keys: Sequence[str] = ("case_id",), **options) -> DataFrame:
    """Regions of every class on its own."""
    rows = cells.where("value > 0").withColumn("class_value", F.col("value").cast("int"))
    return label_regions(rows, [*keys, "class_value"], **options)


def _as_cells(lab: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lab.select(*keys, *CELL, F.col("class_value").alias("value"))


def threshold_of(thresholds: int | Mapping[int, int]) -> Column:
    if isinstance(thresholds, Mapping):
        if not thresholds:
            return F.lit(0)
        pairs = [F.lit(int(x)) for kv in thresholds.items() for x in kv]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col("class_value")), F.lit(0))
    return F.lit(int(thresholds))


def drop_small(cells: DataFrame, thresholds: int | Mapping[int, int], **options) -> DataFrame:
    """Remove regions under the size of their class; 0 or a missing class keeps everything."""
    lab = label_classes(cells, **options)
    return _as_cells(lab.where(F.col("n_cells") >= threshold_of(thresholds)), ["case_id"])


def keep_decisions(regions: DataFrame, p_star: float | Column, *, floor: int = MIN_CELLS, posterior: str = "posterior") -> DataFrame:
    """Decision per region: under the floor is always kept, the rest by posterior."""
    limit = F.lit(p_star) if isinstance(p_star, (int, float)) else p_star
    return regions.withColumn("keep", (F.col("n_cells") < floor) | (F.col(posterior) >= limit))


def with_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add ``keep`` to rows with a region key; NULL where nothing is decided, an error where the size differs.

    ``decisions`` has ``case_id, class_value, comp_id, keep`` and, where sizes are to be
    verified, ``n_cells``.
    """
    columns = [*CLASS_REGION, "keep"] + (["n_cells"] if "n_cells" in decisions.columns else [])
    known = decisions.select(*columns)
    if "n_cells" in columns:
        known = known.withColumnRenamed("n_cells", "_recorded")
    joined = rows.join(known, list(CLASS_REGION), "left")
    if "n_cells" not in columns:
        return joined
    message = F.concat(
        F.lit("component mismatch for "), F.concat_ws("/", *CLASS_REGION), F.lit(": recorded "),
        F.col("_recorded").cast("string"), F.lit(" cells, mask has "), F.col("n_cells").cast("string"),
    )
    differs = F.col("_recorded").isNotNull() & (F.col("_recorded") != F.col("n_cells"))
    return joined.withColumn("keep", F.when(differs, F.raise_error(message).cast("boolean")).otherwise(F.col("keep"))).drop("_recorded")


def apply_decisions(cells: DataFrame, decisions: DataFrame, **options) -> DataFrame:
    """Remove rejected regions; unknown regions stay, a size that differs is an error."""
    lab = label_classes(cells, **options)
    return _as_cells(with_decisions(lab, decisions).where(F.coalesce("keep", F.lit(True))), ["case_id"])


def apply_rename(cells: DataFrame, decisions: DataFrame, **options) -> DataFrame:
    """Give renamed regions their new value; all decisions refer to the original mask.

    ``decisions`` has ``case_id, class_value, comp_id, new_value``.
    """
    lab = label_classes(cells, **options)
    named = decisions.select(*CLASS_REGION, "new_value")
    return lab.join(named, list(CLASS_REGION), "left").select(
        "case_id", *CELL, F.coalesce("new_value", "class_value").alias("value")
    )


def fill_empty(pred: DataFrame, probs: DataFrame, *, fraction: float = 0.5, **options) -> DataFrame:
    """Fill cases without any foreground around their most probable foreground cell.

    ``probs`` has a ``p`` array indexed by class value.  The filled region is the connected
    set at or above ``fraction`` of the peak that holds the peak.
    """
    busy = pred.where("value > 0").select("case_id").distinct()
    fg = 1.0 - F.get(F.col("p"), F.lit(0))
    classes = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    best_class = F.array_position(classes, F.array_max(classes)).cast("int")
    empty = probs.join(busy, "case_id", "left_anti").select("case_id", *CELL, fg.alias("_fg"), best_class.alias("_c"))
    peak = (
        empty.groupBy("case_id")
        .agg(struct_max("_fg", *[F.col(c) for c in CELL], fields=["_fg", "_c", *CELL]).alias("_b"))
        .select("case_id", F.col("_b._fg").alias("_peak"), F.col("_b._c").alias("value"),
                *[F.col(f"_b.{c}").alias(f"_p{c}") for c in CELL])
        .where("_peak > 0")
    )
    above = empty.join(peak.select("case_id", "_peak"), "case_id").where(F.col("_fg") >= fraction * F.col("_peak"))
    lab = cut(label_regions(above, ["case_id"], **options))
    at_peak = lab.join(
        peak.select("case_id", *[F.col(f"_p{c}").alias(c) for c in CELL], "value"), ["case_id", *CELL]
    ).select("case_id", "comp_id", "value")
    filled = lab.join(at_peak, ["case_id", "comp_id"]).select("case_id", *CELL, F.col("value").cast("int").alias("value"))
    return pred.select("case_id", *CELL, F.col("value").cast("int").alias("value")).unionByName(filled)


def under_regions(lab: DataFrame, other: DataFrame, *, majority: float = 0.5) -> DataFrame:
    """What the other mask says under each region: foreground share and leading class.

    The leading class is the most frequent foreground value, the smallest on ties, or 0
    when less than ``majority`` of the region is foreground there.
    """
    below = other.where("value > 0").select("case_id", *CELL, F.col("value").cast("int").alias("_class"))
    region = list(CLASS_REGION)
    votes = lab.join(below, ["case_id", *CELL]).groupBy(*region, "_class").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(*region).agg(
        F.sum("_n").alias("_covered"), struct_max("_n", F.col("_class"), fields=["_class"]).alias("_b")
    )
    share = F.coalesce("_covered", F.lit(0)) / F.col("n_cells")
    return region_sizes(lab, ["case_id", "class_value"]).join(best, region, "left").select(
        *region, "n_cells", share.alias("covered_frac"),
        F.when(share >= majority, F.col("_b._class")).otherwise(0).alias("covered_by"),
    )


def false_positive_origin(pred_lab: DataFrame, ref: DataFrame, matching: Matching, *, majority: float = 0.5) -> DataFrame:
    """Each false positive with what the reference calls its cells."""
    false = matching.comps.where("false_positive").select(*CLASS_REGION)
    return under_regions(pred_lab, ref, majority=majority).join(false, list(CLASS_REGION), "left_semi")


def missed_origin(ref_lab: DataFrame, pred: DataFrame, matching: Matching, *, majority: float = 0.5) -> DataFrame:
    """Each missed reference region with what was predicted under it."""
    missed = matching.refs.where("scored and not detected").select(
        "case_id", "class_value", F.col("ref_id").alias("comp_id")
    )
    return under_regions(ref_lab, pred, majority=majority).join(missed, list(CLASS_REGION), "left_semi")


ORACLES = ("none", "relabel", "delete", "both")


def oracle_fates(rows: DataFrame, origin: DataFrame) -> DataFrame:
    """Add ``fates``: what becomes of a region's value (0: gone) under each of ``ORACLES``."""
    fate = origin.select(*CLASS_REGION, F.col("covered_by").alias("_to"))
    own, to = F.col("class_value"), F.col("_to")
    values = (own, F.when(to > 0, to).otherwise(own), F.when(to.isNull(), own).otherwise(0), F.coalesce(to, own))
    fates = F.array(*[F.struct(F.lit(name).alias("variant"), value.alias("value")) for name, value in zip(ORACLES, values)])
    return rows.join(fate, list(CLASS_REGION), "left").withColumn("fates", fates).drop("_to")


def oracle_masks(pred: DataFrame, pred_lab: DataFrame, origin: DataFrame) -> DataFrame:
    """The four masks ``none``, ``relabel``, ``delete`` and ``both`` in one table, by ``variant``."""
    return (
        oracle_fates(pred_lab, origin).select("case_id", *CELL, F.explode("fates").alias("_m"))
        .select("case_id", *CELL, "_m.variant", "_m.value").where("value > 0")
    )


def match_classes(pred: DataFrame, ref: DataFrame, *, min_cells: int = MIN_CELLS, **options):
    """Label both masks class by class and match them: ``(pred_lab, ref_lab, matching)``."""
    sides = [d.where("value > 0").withColumn("class_value", F.col("value").cast("int")) for d in (pred, ref)]
    pred_lab, ref_lab = label_both(*sides, ["case_id", "class_value"], **options)
    return pred_lab, ref_lab, match_regions(pred_lab, ref_lab, ["case_id", "class_value"], min_cells=min_cells)


def origin_name(column: str = "covered_by", *, absent: str = "background", class_names: Mapping[int, str] = CLASS_NAMES) -> Column:
    pairs = [F.lit(x) for v, n in class_names.items() if v for x in (int(v), n)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column).cast("int")), F.lit(absent))
