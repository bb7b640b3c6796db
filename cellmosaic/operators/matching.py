"""Matching of predicted regions to reference regions, and the scores built on it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import MIN_CELLS, default_targets, dice, targets_of
from ..functions.runtime import cut
from .labelling import label_pieces, label_regions, region_sizes

CELL = ("i", "j", "k")
#: What regions add to the scores of a case: cells and regions that count on both sides, shared cells, predicted regions
#: that count and meet, Dice of the reference regions found, and their number.
SCORE_SUMS = ("pred_cells", "decidable", "ref_cells", "scored", "shared", "met", "dice_sum", "found")


@dataclass(frozen=True)
class Matching:
    """``comps`` and ``refs`` have one row per region, ``overlap`` one per touching pair."""

    comps: DataFrame
    refs: DataFrame
    overlap: DataFrame


def overlap_table(pred_lab: DataFrame, ref_lab: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared cells and both sizes for every (predicted region, reference region) that touch."""
    ref = ref_lab.select(*keys, *CELL, F.col("comp_id").alias("ref_id"), F.col("n_cells").alias("ref_cells"))
    return (
        pred_lab.select(*keys, *CELL, "comp_id", "n_cells")
        .join(ref, [*keys, *CELL])
        .groupBy(*keys, "comp_id", "ref_id")
        .agg(F.count(F.lit(1)).alias("shared"), F.max("n_cells").alias("n_cells"), F.max("ref_cells").alias("ref_cells"))
    )


def touched_sets(overlap: DataFrame, keys: Sequence[str], side: str = "comp") -> DataFrame:
    """Ids of the other side that each region touches, sorted."""
    mine, other = ("comp_id", "ref_id") if side == "comp" else ("ref_id", "comp_id")
    return overlap.groupBy(*keys, mine).agg(F.sort_array(F.collect_set(other)).alias(f"touched_{other}s"))


def match_regions(
    pred_lab: DataFrame, ref_lab: DataFrame, keys: Sequence[str] = ("case_id", "target"), *,
    min_cells: int = MIN_CELLS,
) -> Matching:
    """Match by shared cells.

    Reference regions under ``min_cells`` are not scored and cannot rescue a prediction.
    One shared cell is a match.  Each scored reference region is compared with the union
    of all predicted regions that touch it, and each predicted region with the union of
    the scored reference regions it touches.  The id lists are pruned from the plan where
    only scores are asked for.
    """
    keys = list(keys)
    ref_sizes = region_sizes(ref_lab, keys).select(
        *keys, F.col("comp_id").alias("ref_id"), F.col("n_cells").alias("ref_cells")
    )
    return match_tables(region_sizes(pred_lab, keys), ref_sizes, overlap_table(pred_lab, ref_lab, keys), keys, min_cells=min_cells)


def match_tables(
    comp_sizes: DataFrame, ref_sizes: DataFrame, overlap: DataFrame, keys: Sequence[str], *, min_cells: int = MIN_CELLS
) -> Matching:
    """The matching of ``match_regions`` from the sizes of both sides and their overlap table alone."""
    keys = list(keys)
    id_list = f"array<{comp_sizes.schema['comp_id'].dataType.simpleString()}>"
    scored = F.col("ref_cells") >= min_cells
    by_comp = overlap.where(scored).groupBy(*keys, "comp_id").agg(
        F.sum("shared").alias("_shared"),
        F.sum("ref_cells").alias("_other"),
        F.sort_array(F.collect_set("ref_id")).alias("_ids"),
    )
    comps = comp_sizes.join(by_comp, [*keys, "comp_id"], "left").select(
        *keys, "comp_id", "n_cells",
        F.col("_shared").isNotNull().alias("matched"),
        F.coalesce("_ids", F.array().cast(id_list)).alias("matched_ref_ids"),
        F.coalesce(2.0 * F.col("_shared") / (F.col("n_cells") + F.col("_other")), F.lit(0.0)).alias("dice_with_matched"),
        (F.col("_shared").isNull() & (F.col("n_cells") >= min_cells)).alias("false_positive"),
    )
    by_ref = overlap.groupBy(*keys, "ref_id").agg(
        F.sum("shared").alias("_shared"),
        F.sum("n_cells").alias("_other"),
        F.sort_array(F.collect_set("comp_id")).alias("_ids"),
    )
    entry = 2.0 * F.col("_shared") / (F.col("ref_cells") + F.col("_other"))
    refs = ref_sizes.join(by_ref, [*keys, "ref_id"], "left").select(
        *keys, "ref_id", F.col("ref_cells").alias("n_cells"),
        scored.alias("scored"),
        F.col("_shared").isNotNull().alias("detected"),
        F.when(scored, F.coalesce(entry, F.lit(0.0))).otherwise(0.0).alias("dice"),
        F.coalesce("_ids", F.array().cast(id_list)).alias("matched_comp_ids"),
    )
    return Matching(comps, refs, overlap)


def region_dice(comps: DataFrame, refs: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean entry per group: each scored reference region's Dice plus a zero per false positive.

    ``grid`` lists every group that must have a row; a group without entries scores 1.
    """
    keys = list(keys)
    ref_side = refs.where("scored").groupBy(*keys).agg(
        F.sum("dice").alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~F.col("detected")).alias("_missed"),
    )
    comp_side = comps.groupBy(*keys).agg(F.count_if("false_positive").alias("_false"))
    n, missed, false = (F.coalesce(c, F.lit(0)) for c in ("_n", "_missed", "_false"))
    return (
        grid.join(ref_side, keys, "left")
        .join(comp_side, keys, "left")
        .select(
            *grid.columns,
            F.when(n + false == 0, F.lit(1.0))
            .otherwise(F.coalesce("_sum", F.lit(0.0)) / (n + false)).alias("lesion_dice"),
            (n - missed).alias("lesions_found"),
            missed.alias("lesions_missed"),
            false.alias("lesions_false"),
        )
    )


def volumetric_dice(pred: DataFrame, ref: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlap ratio of the two masks per group of ``grid``."""
    keys = list(keys)
    sides = (
        pred.select(*keys, *CELL, F.lit(1).alias("_p"), F.lit(0).alias("_r"))
        .unionByName(ref.select(*keys, *CELL, F.lit(0).alias("_p"), F.lit(1).alias("_r")))
        .groupBy(*keys, *CELL).agg(F.max("_p").alias("_p"), F.max("_r").alias("_r"))
    )
    sums = sides.groupBy(*keys).agg(
        F.sum("_p").alias("n_pred"), F.sum("_r").alias("n_ref"), F.sum(F.col("_p") * F.col("_r")).alias("n_shared")
    )
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "n_ref", "n_shared")}
    return grid.join(sums, keys, "left").select(
        *grid.columns, *zero.values(), dice("n_pred", "n_ref", "n_shared").alias("dice")
    )


def explode_targets(cells: DataFrame, targets: Mapping[str, Iterable[int]]) -> DataFrame:
    """One row per cell and target whose value set holds the cell's value."""
    keep = [c for c in cells.columns if c != "value"]
    return cells.select(*keep, F.explode(targets_of("value", targets)).alias("target"))


def case_target_grid(cases: DataFrame, targets: Iterable[str], keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Every case with every target, so that correct absences keep their row."""
    names = F.array(*[F.lit(t) for t in targets])
    return cases.select(*keys).distinct().select(*keys, F.explode(names).alias("target"))


def label_both(
    pred: DataFrame, ref: DataFrame, keys: Sequence[str], *, numbered: bool = True, **options
) -> tuple[DataFrame, DataFrame]:
    """Label both masks in one job; returns the two labelled tables.

    ``numbered=False`` keeps the packed first cell as region id, which scoring does not need
    to turn into 1..n.
    """
    sides = pred.select(*keys, *CELL, F.lit("pred").alias("side")).unionByName(
        ref.select(*keys, *CELL, F.lit("ref").alias("side"))
    )
    full = ["side", *keys]
    lab = cut(label_regions(sides, full, **options)) if numbered else label_pieces(sides, full, **options)
    return lab.where("side = 'pred'").drop("side"), lab.where("side = 'ref'").drop("side")


def score_cases(
    pred: DataFrame, ref: DataFrame, cases: DataFrame,
    targets: Mapping[str, Iterable[int]] | None = None, *,
    min_cells: int = MIN_CELLS, keys: Sequence[str] = ("case_id",), variants: tuple[str, Column] | None = None, **options,
) -> DataFrame:
    """Volumetric and region scores for every case and target.

    A composite target is labelled on the union of its classes, not put together from
    the class regions.  ``keys`` may hold more columns, such as a variant name.  With
    ``variants``, a key and the list of its values, ``ref`` comes without that key: it is the
    same for all of them and is labelled once.
    """
    targets = targets or default_targets()
    if variants is None and list(keys) == ["case_id"]:
        from .contacts import score_as_is  # which builds on this module

        return score_as_is(pred, ref, cases, targets, min_cells=min_cells, **options)
    full = [*keys, "target"]
    if variants is not None:
        ref = ref.withColumn(variants[0], F.get(variants[1], F.lit(0)))
    pred_lab, ref_lab = label_both(
        explode_targets(pred, targets), explode_targets(ref, targets), full, numbered=False, **options
    )
    if variants is not None:
        ref_lab = ref_lab.withColumn(variants[0], F.explode(variants[1]))
    matching = match_regions(pred_lab, ref_lab, full, min_cells=min_cells)
    return score_matching(matching, case_target_grid(cases, targets, keys), full)


def score_matching(matching: Matching, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Case scores from match tables alone; no further pass over cells."""
    keys = list(keys)
    p = matching.comps.groupBy(*keys).agg(F.sum("n_cells").alias("_p"))
    r = matching.refs.groupBy(*keys).agg(F.sum("n_cells").alias("_r"))
    s = matching.overlap.groupBy(*keys).agg(F.sum("shared").alias("_s"))
    volumes = grid.select(*keys).join(p, keys, "left").join(r, keys, "left").join(s, keys, "left")
    scored = region_dice(matching.comps, matching.refs, volumes, keys)
    return scored.select(
        *keys, dice("_p", "_r", "_s").alias("dice"), "lesion_dice", "lesions_missed", "lesions_false",
        F.col("_r").isNotNull().alias("present"),
    )


def score_sums(
    comps: DataFrame, refs: DataFrame, overlap: DataFrame, keys: Sequence[str], variants: tuple[str, Column], *, min_cells: int = MIN_CELLS,
) -> DataFrame:
    """``SCORE_SUMS`` from region sizes and overlaps, by counting: no region is joined to another table.

    ``comps`` has ``keys, n_cells`` per predicted region, ``overlap`` is as in ``overlap_table``, ``refs`` has the other
    keys and ``ref_cells`` per reference region, the same for all ``variants`` (a key and the list of its values).
    """
    keys = list(keys)
    others = [k for k in keys if k != variants[0]]
    scored, real = F.col("ref_cells") >= min_cells, F.col("n_cells") >= min_cells
    per_comp = overlap.groupBy(*keys, "comp_id").agg(F.sum("shared").alias("shared"), F.max(real & scored).alias("_met"))
    per_ref = overlap.groupBy(*keys, "ref_id").agg(
        F.max("ref_cells").alias("ref_cells"), F.sum("shared").alias("shared"), F.sum("n_cells").alias("_other")
    ).where(scored)
    parts = (
        comps.groupBy(*keys).agg(F.sum("n_cells").alias("pred_cells"), F.count_if(real).alias("decidable")),
        refs.groupBy(*others).agg(F.sum("ref_cells").alias("ref_cells"), F.count_if(scored).alias("scored"))
        .withColumn(variants[0], F.explode(variants[1])),
        per_comp.groupBy(*keys).agg(F.sum("shared").alias("shared"), F.count_if("_met").alias("met")),
        per_ref.groupBy(*keys).agg(
            F.sum(2.0 * F.col("shared") / (F.col("ref_cells") + F.col("_other"))).alias("dice_sum"), F.count(F.lit(1)).alias("found")
        ),
    )

    def filled(part: DataFrame) -> DataFrame:
        zero = F.lit(0.0)
        return part.select(*keys, *[(F.col(c).cast("double") if c in part.columns else zero).alias(c) for c in SCORE_SUMS])

    first, *rest = [filled(part) for part in parts]
    for part in rest:
        first = first.unionByName(part)
    return first


def finish_scores(sums: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Case scores of every row of ``grid`` from the ``SCORE_SUMS`` of its regions."""
    keys = list(keys)
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SCORE_SUMS])
    rows = grid.select(*keys).join(total, keys, "left").fillna(0.0, list(SCORE_SUMS))
    n, found = F.col("scored"), F.col("found")
    false = F.col("decidable") - F.col("met")
    return rows.select(
        *keys, dice("pred_cells", "ref_cells", "shared").alias("dice"),
        F.when(n + false == 0, F.lit(1.0)).otherwise(F.col("dice_sum") / (n + false)).alias("lesion_dice"),
        (n - found).cast("long").alias("lesions_missed"), false.cast("long").alias("lesions_false"), (F.col("ref_cells") > 0).alias("present"),
    )
