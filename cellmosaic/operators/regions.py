"""The region table: statistics, context and match of every predicted region of a case."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import CLASS_NAMES, COMPOSITES, MIN_CELLS
from ..functions.runtime import cut
from .geometry import CELL, cell_volume, distance_to_set, midline, mirror, shell_sums, with_depth
from .labelling import DEFAULT_TILE, label_regions, region_sizes
from .matching import Matching, label_both, match_regions
from .ranking import exact_percentiles, ranked
from .whole_cases import predicted_regions, reference_regions, wide_cases

REGION = ("case_id", "class_value", "comp_id")


def probability(class_value: Column | int) -> Column:
    """Probability of a class in the ``p`` array of a cell; absent cells are background."""
    value = F.lit(class_value) if isinstance(class_value, int) else class_value
    stored = F.get(F.col("p"), value.cast("int"))
    return F.coalesce(stored, F.when(value == 0, F.lit(1.0)).otherwise(0.0))


def dominant_region(
    cells: DataFrame, values: Iterable[int] | None = None, keys: Sequence[str] = ("case_id",), **options
) -> DataFrame:
    """Cells of the largest connected region over a value set; the first one wins ties."""
    keys = list(keys)
    values = COMPOSITES["WT"] if values is None else values
    chosen = cells.where(F.col("value").isin([int(v) for v in values])).select(*keys, *CELL)
    lab = cut(label_regions(chosen, keys, **options))
    largest = region_sizes(lab, keys).groupBy(*keys).agg(
        F.max(F.struct("n_cells", (-F.col("comp_id")).alias("_neg"))).alias("_top")
    ).select(*keys, (-F.col("_top._neg")).alias("comp_id"))
    return lab.join(largest, [*keys, "comp_id"], "left_semi").select(*keys, *CELL)


def cells_with_context(lab: DataFrame, probs: DataFrame, ref: DataFrame) -> DataFrame:
    """Region cells with their probability array and the reference value under them."""
    below = ref.select("case_id", *CELL, F.col("value").alias("ref_value"))
    return (
        lab.join(probs.select("case_id", *CELL, "p"), ["case_id", *CELL], "left")
        .join(below, ["case_id", *CELL], "left")
        .withColumn("ref_value", F.coalesce("ref_value", F.lit(0)))
    )


def region_statistics(context: DataFrame, class_values: Sequence[int]) -> DataFrame:
    """Size, centroid, own-class confidence, class means and what the reference has there."""
    own = probability(F.col("class_value"))
    rows = context.withColumn("_own", own)
    stats = rows.groupBy(*REGION).agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.avg(c).alias(f"centroid_{c}") for c in CELL],
        F.avg("_own").alias("mean_prob"),
        F.max("_own").alias("max_prob"),
        *[F.avg(probability(v)).alias(f"prob_c{v}") for v in class_values],
        *[F.count_if(F.col("ref_value") == v).alias(f"_under{v}") for v in class_values if v != 0],
    )
    # From running counts at every size: no region is held in one buffer.
    return stats.join(exact_percentiles(rows, REGION, "_own", {"p90_prob": 0.9}), list(REGION), "left")


def runner_up(stats: DataFrame, class_values: Sequence[int]) -> DataFrame:
    """Best mean probability among the other foreground classes; the first value wins ties."""
    foreground = [v for v in class_values if v != 0]
    entries = F.array_compact(F.array(*[
        F.when(F.col("class_value") != v, F.struct(F.col(f"prob_c{v}").alias("p"), F.lit(-v).alias("v")))
        for v in foreground
    ]))
    best = F.array_max(entries)
    return stats.withColumns({"runner_up_value": -best["v"], "runner_up_prob": best["p"]})


def reference_majority(stats: DataFrame, class_values: Sequence[int], *, majority: float = 0.5) -> DataFrame:
    """Foreground share of the reference under each region and its most frequent class."""
    foreground = [v for v in class_values if v != 0]
    total = sum((F.col(f"_under{v}") for v in foreground[1:]), F.col(f"_under{foreground[0]}"))
    fraction = total / F.greatest(F.lit(1), F.col("n_cells"))
    best = F.array_max(F.array(*[
        F.struct(F.col(f"_under{v}").alias("n"), F.lit(-v).alias("v")) for v in foreground
    ]))
    return stats.withColumns({
        "ref_tumour_frac": fraction,
        "ref_majority_value": F.when(fraction >= majority, -best["v"]).otherwise(0),
    })


def border_mean(lab: DataFrame, probs: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean own-class probability on the one-cell shell of each region; NULL without a shell."""
    classes = sorted(r[0] for r in lab.select("class_value").distinct().collect())
    values = probs.select("case_id", *CELL, *[probability(c).alias(f"_p{c}") for c in classes])
    rim = shell_sums(lab, values, REGION, [f"_p{c}" for c in classes], grid=grid)
    own = F.coalesce(*[F.when(F.col("class_value") == c, F.col(f"_p{c}")) for c in classes], F.lit(0.0))
    absent = F.when(F.col("class_value") == 0, F.col("n_shell") - F.col("n_met")).otherwise(0)
    return rim.where("n_shell > 0").select(*REGION, ((own + absent) / F.col("n_shell")).alias("mean_border_prob"))


def region_ranks(stats: DataFrame, keys: Sequence[str] = ("case_id", "class_value")) -> DataFrame:
    """Positions by size and by mean probability, 1 = largest, and the regions per group."""
    keys = list(keys)
    by_size = ranked(stats, keys, [F.col("n_cells").desc(), F.col("comp_id").asc()], "rank_by_volume")
    both = ranked(by_size, keys, [F.col("mean_prob").desc(), F.col("comp_id").asc()], "rank_by_prob")
    totals = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_comps_in_class"))
    return both.join(totals, keys)


def mean_over_regions(lab: DataFrame, variance: DataFrame) -> DataFrame:
    """Mean pass variance of each region's own class."""
    own = variance.select("case_id", *CELL, "class_value", "variance")
    return (
        lab.join(own, ["case_id", *CELL, "class_value"], "left")
        .groupBy(*REGION).agg(F.avg(F.coalesce("variance", F.lit(0.0))).alias("mc_mean_var"))
    )


def region_table(
    pred: DataFrame, ref: DataFrame, probs: DataFrame, grid: DataFrame,
    class_names: Mapping[int, str] = CLASS_NAMES, *, variance: DataFrame | None = None,
    min_cells: int = MIN_CELLS, **options,
) -> tuple[DataFrame, DataFrame]:
    """Predicted regions and scored reference regions of every case.

    ``pred`` and ``ref`` have ``case_id, i, j, k, value``; ``probs`` has a ``p`` array
    indexed by class value; ``grid`` is the case geometry.  A case whose array and cells lie in
    the first tile is measured whole in the task that holds it; other cases go by joins.
    """
    named = F.col("value").isin([v for v in class_names if v != 0])
    sides = [d.where(named).withColumn("class_value", F.col("value").cast("int")) for d in (pred, ref)]
    values = sorted({0, *class_names})
    composite = set(class_names) >= {1, 2, 3}
    mass = COMPOSITES["WT"] if composite else [v for v in values if v]
    tile = options.get("tile", DEFAULT_TILE)
    wide = cut(wide_cases(sides, grid, tile))
    if wide.isEmpty():
        near, shapes, parts = sides, grid, ()
    else:
        near, shapes = [d.join(wide, "case_id", "left_anti") for d in sides], grid.join(wide, "case_id", "left_anti")
        far = [d if d is None else d.join(wide, "case_id", "left_semi") for d in (*sides, pred, ref, probs, grid, variance)]
        parts = _wide_tables(*far, values, mass, class_names, min_cells, options)
    inner = predicted_regions(near, probs, shapes, values, mass, variance=variance, min_cells=min_cells, tile=tile)
    inner = reference_majority(runner_up(inner, values), values).drop(*[f"_under{v}" for v in values])
    regions = _finished(inner if variance is not None else inner.withColumn("mc_mean_var", F.lit(None).cast("double")), class_names)
    refs = _finished(reference_regions(near, shapes, values, mass, min_cells=min_cells, tile=tile), class_names)
    if not parts:
        return regions, refs
    return regions.unionByName(parts[0]), refs.unionByName(parts[1])


def _finished(rows: DataFrame, class_names: Mapping[int, str]) -> DataFrame:
    """Regions with their physical volume, from the volume of a cell, and the name of their class."""
    return rows.withColumns(
        {"volume_mm3": F.col("n_cells") * F.col("_cell"), "class_name": class_name_of(class_names)}
    ).drop("_cell")


def _wide_tables(
    pred_side, ref_side, pred, ref, probs, grid, variance, values, mass, class_names, min_cells, options
) -> tuple[DataFrame, DataFrame]:
    """Both tables of ``region_table`` by joins, for cases of any size."""
    keys = ["case_id", "class_value"]
    pred_lab, ref_lab = label_both(pred_side, ref_side, keys, **options)
    matching = match_regions(pred_lab, ref_lab, keys, min_cells=min_cells)
    target = cut(dominant_region(pred, mass, **options))
    return (
        _region_side(pred_lab, ref, probs, grid, target, matching, values, class_names, variance),
        _reference_side(ref_lab, grid, target, matching, class_names),
    )


def class_name_of(class_names: Mapping[int, str]) -> Column:
    pairs = [F.lit(x) for value, name in class_names.items() for x in (int(value), name)]
    return F.element_at(F.create_map(*pairs), F.col("class_value").cast("int"))


def _region_side(pred_lab, ref, probs, grid, mass, matching: Matching, values, class_names, variance) -> DataFrame:
    stats = region_statistics(cells_with_context(pred_lab, probs, ref), values)
    stats = reference_majority(runner_up(stats, values), values)
    stats = region_ranks(stats.drop(*[f"_under{v}" for v in values]))
    region = list(REGION)
    out = (
        stats.join(border_mean(pred_lab, probs, grid), region, "left")
        .join(distance_to_set(pred_lab, mass, grid).withColumnRenamed("distance", "dist_to_dominant_mm"), region, "left")
        .join(matching.comps.select(*region, "matched", "matched_ref_ids", "dice_with_matched", "false_positive"), region)
        .join(grid.select("case_id", cell_volume().alias("_cell")), "case_id")
    )
    out = _finished(out, class_names)
    if variance is None:
        return out.withColumn("mc_mean_var", F.lit(None).cast("double"))
    return out.join(mean_over_regions(pred_lab, variance), region, "left")


def _reference_side(ref_lab, grid, mass, matching: Matching, class_names) -> DataFrame:
    ids = ["case_id", "class_value", "ref_id"]
    scored = matching.refs.where("scored")
    held = ref_lab.withColumnRenamed("comp_id", "ref_id").join(scored.select(*ids), ids, "left_semi")
    distance = distance_to_set(held, mass, grid, region=ids).withColumnRenamed("distance", "dist_to_dominant_mm")
    out = scored.join(distance, ids, "left").join(grid.select("case_id", cell_volume().alias("_cell")), "case_id")
    return _finished(out, class_names).drop("scored")


def image_feature_names(modalities: Sequence[str]) -> list[str]:
    """Columns that ``image_features`` returns for these modalities, without the key."""
    out = [f"z_{m}_{kind}" for m in modalities for kind in ("mean", "contrast", "mirror")]
    if {"t1c", "t1n"} <= set(modalities):
        out.append("enhancement")
    if {"t2f", "t2w"} <= set(modalities):
        out.append("flair_minus_t2")
    return [*out, "dist_to_brain_edge_mm", "frac_outside_brain", "n_voxels_check"]


def image_features(
    lab: DataFrame, intensities: DataFrame, mask: DataFrame, grid: DataFrame, modalities: Sequence[str], *,
    steps: int = 3,
) -> DataFrame:
    """Intensity contrast, asymmetry and depth of each region.

    ``intensities`` is wide, one column per modality, zeros omitted; ``mask`` lists the
    brain cells.  An absent cell has intensity zero, hence the background's z-score.
    """
    region, cell = list(REGION), ["case_id", *CELL]
    brain = mask.select(*cell, F.lit(True).alias("_brain"))
    volume = cut(
        intensities.select(*cell, *modalities).join(brain, cell, "full_outer")
        .fillna(0.0, subset=list(modalities)).fillna(False, subset=["_brain"])
    )
    scale = volume.where("_brain").groupBy("case_id").agg(
        *[F.avg(m).alias(f"_mu_{m}") for m in modalities],
        *[F.stddev_pop(m).alias(f"_sd_{m}") for m in modalities],
    )

    def z(m: str) -> Column:
        spread = F.when(F.col(f"_sd_{m}") > 1e-6, F.col(f"_sd_{m}")).otherwise(1.0)
        return (F.coalesce(F.col(m), F.lit(0.0)) - F.col(f"_mu_{m}")) / spread

    def averages(cells: DataFrame, suffix: str) -> DataFrame:
        rows = cells.join(volume.drop("_brain"), cell, "left").join(scale, "case_id")
        return rows.groupBy(*region).agg(*[F.avg(z(m)).alias(f"_{suffix}_{m}") for m in modalities])

    inside = averages(lab, "in")
    scores = volume.where("_brain").join(scale, "case_id").select(*cell, *[z(m).alias(f"_out_{m}") for m in modalities])
    rim = shell_sums(lab, scores, region, [f"_out_{m}" for m in modalities], steps=steps).where("n_met > 0")
    around = rim.select(*region, *[(F.col(f"_out_{m}") / F.col("n_met")).alias(f"_out_{m}") for m in modalities])
    mirrored = averages(mirror(lab.select(*region, *CELL), midline(mask), grid), "mir")
    depth = (
        with_depth(lab.select(*region, *CELL).join(brain, cell, "left"), mask, grid, "_brain")
        .groupBy(*region).agg(
            F.max("depth").alias("dist_to_brain_edge_mm"),
            F.avg(F.when(F.col("_brain"), 0.0).otherwise(1.0)).alias("frac_outside_brain"),
            F.count(F.lit(1)).alias("n_voxels_check"),
        )
    )
    out = inside.join(around, region, "left").join(mirrored, region, "left").join(depth, region)
    columns = {}
    for m in modalities:
        columns[f"z_{m}_mean"] = F.col(f"_in_{m}")
        columns[f"z_{m}_contrast"] = F.col(f"_in_{m}") - F.col(f"_out_{m}")
        columns[f"z_{m}_mirror"] = F.col(f"_in_{m}") - F.col(f"_mir_{m}")
    if {"t1c", "t1n"} <= set(modalities):
        columns["enhancement"] = F.col("_in_t1c") - F.col("_in_t1n")
    if {"t2f", "t2w"} <= set(modalities):
        columns["flair_minus_t2"] = F.col("_in_t2f") - F.col("_in_t2w")
    return out.withColumns(columns).select(*region, *image_feature_names(modalities))


def region_verdicts(regions: DataFrame, *, floor: int = MIN_CELLS, smallest: int = 20) -> DataFrame:
    """Display verdict of each region from its size, match and decision (``keep``, NULL = keep)."""
    keys = ["case_id", "class_name"]
    top = regions.groupBy(*keys).agg(
        F.max(F.struct("n_cells", (-F.col("comp_id")).alias("_neg"))).alias("_top")
    ).select(*keys, (-F.col("_top._neg")).alias("_biggest"))
    kept = F.coalesce(F.col("keep"), F.lit(True))
    verdict = (
        F.when(F.col("n_cells") < floor, "below_floor")
        .when((F.col("comp_id") == F.col("_biggest")) & F.col("matched") & kept, "main")
        .otherwise(F.concat(
            F.when(kept, "kept").otherwise("dropped"), F.lit("_"), F.when(F.col("matched"), "real").otherwise("spurious")
        ))
    )
    return regions.join(top, keys).where(F.col("n_cells") >= smallest).withColumn("verdict", verdict).drop("_biggest")


VERDICTS = ("main", "kept_real", "kept_spurious", "dropped_real", "dropped_spurious", "below_floor")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Regions per case and verdict, one column each."""
    return verdicts.groupBy("case_id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
