"""Case-level aggregates over cells, and the averaging of repeated predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import CLASS_NAMES, seeded_key, struct_max
from .geometry import CELL, downsample, zoom_linear
from .labelling import pack_cell
from .ranking import exact_percentiles, ranked


def class_histogram(labels: DataFrame, grid: DataFrame, class_names: Mapping[int, str] = CLASS_NAMES) -> DataFrame:
    """Cells per class, array size and foreground size for every case of ``grid``."""
    counts = labels.groupBy("case_id").agg(
        *[F.count_if(F.col("value") == v).alias(f"vox_{n}") for v, n in class_names.items() if v],
        F.count_if(F.col("value") > 0).alias("vox_foreground"),
    )
    numbers = [c for c in counts.columns if c != "case_id"]
    return grid.select("case_id", (F.col("ni") * F.col("nj") * F.col("nk")).cast("long").alias("vox_total")).join(
        counts, "case_id", "left"
    ).fillna(0, subset=numbers)


def foreground_extent(labels: DataFrame) -> DataFrame:
    """Centroid and inclusive bounding box; cases without foreground have no row."""
    return labels.where("value > 0").groupBy("case_id").agg(
        *[F.avg(c).alias(f"centroid_{c}") for c in CELL],
        *[F.min(c).alias(f"{c}_min") for c in CELL],
        *[F.max(c).alias(f"{c}_max") for c in CELL],
    )


def scan_stats(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Largest value, non-zero share, shape and spacing text of each volume."""
    stats = cells.groupBy("case_id").agg(F.max("v").alias("_max"), F.count_if(F.col("v") > 0).alias("_n"))
    size = F.col("ni") * F.col("nj") * F.col("nk")
    spacing = [F.format_string("%.2f", F.col(c)) for c in ("si", "sj", "sk")]
    return grid.join(stats, "case_id", "left").select(
        "case_id",
        F.greatest(F.coalesce("_max", F.lit(0.0)), F.when(F.coalesce("_n", F.lit(0)) < size, 0.0)).alias("v_max"),
        (F.coalesce("_n", F.lit(0)) / size).alias("nonzero_frac"),
        F.concat_ws("x", "ni", "nj", "nk").alias("shape"),
        F.concat_ws("x", *spacing).alias("spacing"),
    )


def case_stats(cells: DataFrame, labels: DataFrame, grid: DataFrame,
               class_names: Mapping[int, str] = CLASS_NAMES) -> DataFrame:
    """Scan statistics, class sizes and foreground extent in one row per case."""
    return (
        scan_stats(cells, grid)
        .join(class_histogram(labels, grid, class_names), "case_id", "left")
        .join(foreground_extent(labels), "case_id", "left")
    )


def occupancy(labels: DataFrame, grid: DataFrame | None = None, *, shape: Sequence[int] | None = None,
              factor: int = 2) -> DataFrame:
    """In how many cases a class occupies each coarse cell; a case counts once per cell.

    With ``grid`` and ``shape`` only cases of the common shape contribute.
    """
    rows = labels.where("value > 0")
    if shape is not None:
        same = (F.col("ni") == shape[0]) & (F.col("nj") == shape[1]) & (F.col("nk") == shape[2])
        rows = rows.join(grid.where(same).select("case_id"), "case_id", "left_semi")
    coarse = downsample(rows, factor=factor, how="any", keys=("value", "case_id"))
    return coarse.groupBy("value", *CELL).agg(F.count(F.lit(1)).alias("n_cases"))


def prevalence(histogram: DataFrame, heat: DataFrame, class_names: Mapping[int, str] = CLASS_NAMES) -> DataFrame:
    """Cases with each class, their share, and the hottest coarse cell."""
    names = [(v, n) for v, n in class_names.items() if v]
    wide = histogram.agg(
        F.count(F.lit(1)).alias("n_cases"), *[F.count_if(F.col(f"vox_{n}") > 0).alias(n) for _, n in names]
    )
    long = wide.select("n_cases", F.explode(F.array(*[
        F.struct(F.lit(v).alias("value"), F.lit(n).alias("class_name"), F.col(n).alias("present_cases"))
        for v, n in names
    ])).alias("_r")).select("n_cases", "_r.*")
    peak = heat.groupBy(F.col("value").cast("int").alias("value")).agg(F.max("n_cases").alias("_peak"))
    return long.join(peak, "value", "left").select(
        "class_name", "n_cases", "present_cases",
        (100.0 * F.col("present_cases") / F.col("n_cases")).alias("present_pct"),
        F.coalesce("_peak", F.lit(0)).alias("peak_cases"),
        (100.0 * F.coalesce("_peak", F.lit(0)) / F.col("n_cases")).alias("peak_pct"),
    )


def clip_normalise(cells: DataFrame, *, fraction: float = 0.99, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Values over the group's own percentile of positive values, clipped to [0, 1]."""
    level = exact_percentiles(cells.where("v > 0"), keys, "v", {"_level": fraction})
    scaled = F.col("v") / F.greatest(F.coalesce("_level", F.lit(1.0)), F.lit(1e-6))
    return (
        cells.join(level, list(keys), "left")
        .withColumn("v", F.greatest(F.lit(0.0), F.least(scaled, F.lit(1.0)))).drop("_level")
    )


def seeded_sample(cases: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """A reproducible sample of ``n`` cases without replacement."""
    return cases.orderBy(seeded_key(seed, "case_id"), "case_id").limit(n)


def mean_template(cells: DataFrame, cases: DataFrame, *, n: int = 200, seed: int = 0, factor: int = 2) -> DataFrame:
    """Average half-resolution volume over a seeded sample of cases."""
    chosen = seeded_sample(cases.select("case_id").distinct(), n, seed=seed)
    used = max(1, chosen.count())
    small = downsample(clip_normalise(cells.join(chosen, "case_id", "left_semi")), factor=factor, how="mean")
    totals = small.groupBy(*CELL).agg(F.sum("v").alias("_v"))
    return totals.select(*CELL, (F.col("_v") / used).alias("v"))


def brain_mask(cells: DataFrame, grid: DataFrame, *, dense: float = 0.55, fraction: float = 0.25) -> DataFrame:
    """Cells above zero; where they fill most of the array, cells above a low percentile."""
    size = F.col("ni") * F.col("nj") * F.col("nk")
    positive = cells.where("v > 0")
    full = (
        positive.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
        .join(grid, "case_id").where(F.col("_n") / size > dense).select("case_id")
    )
    level = exact_percentiles(positive.join(full, "case_id", "left_semi"), ["case_id"], "v", {"_level": fraction})
    above = positive.join(level, "case_id", "left").select(
        "case_id", *CELL, F.col("_level"), (F.col("_level").isNull() | (F.col("v") > F.col("_level"))).alias("_in")
    )
    flat = above.groupBy("case_id").agg(F.bool_or("_in").alias("_any")).where("not _any")
    return (
        above.join(flat, "case_id", "left").where("_in or _any is not null").select("case_id", *CELL)
    )


def standardise(cells: DataFrame, keys: Sequence[str] = ("case_id", "modality")) -> DataFrame:
    """Z-scores of the non-zero cells of each volume; absent cells stay zero."""
    stats = cells.where("v != 0").groupBy(*keys).agg(F.avg("v").alias("_mu"), F.stddev_pop("v").alias("_sd"))
    spread = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return (
        cells.join(stats, list(keys))
        .withColumn("v", F.when(F.col("v") != 0, (F.col("v") - F.col("_mu")) / spread).otherwise(0.0))
        .drop("_mu", "_sd")
    )


def fingerprint(cells: DataFrame, grid: DataFrame, *, edge: int = 16) -> DataFrame:
    """Fixed-size descriptor: the volume resampled to ``edge`` cubed and z-scored on its positive cells.

    The array holds ``edge`` cubed numbers per case, so its size does not depend on the scan.
    """
    n = edge**3
    small = zoom_linear(cells.select("case_id", *CELL, "v"), grid, edge)
    stats = small.where("v > 0").groupBy("case_id").agg(
        F.avg("v").alias("_mu"), (F.stddev_pop("v") + 1e-6).alias("_sd")
    )
    slot = ((F.col("i") * edge + F.col("j")) * edge + F.col("k")).alias("_slot")
    filled = small.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(slot, F.col("v")))).alias("_m"))
    slots = F.sequence(F.lit(0), F.lit(n - 1))
    z = F.transform(
        slots, lambda s: ((F.coalesce(F.element_at("_m", s), F.lit(0.0)) - F.col("_mu")) / F.col("_sd")).cast("float")
    )
    zero = F.array_repeat(F.lit(0.0).cast("float"), n)
    return grid.select("case_id").join(filled, "case_id", "left").join(stats, "case_id", "left").select(
        "case_id", F.when(F.col("_mu").isNull(), zero).otherwise(z).alias("embedding")
    )


def content_hash(cells: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Hash of the decoded non-zero values, line by line, plane by plane and then per volume.

    No step gathers more than one grid edge into a row.
    """
    level = cells.where("v != 0").select(*keys, *CELL, F.col("v").cast("string").alias("_h"))
    for axis in reversed(CELL):
        rest = [c for c in CELL if c in level.columns and c != axis]
        parts = F.transform(
            F.array_sort(F.collect_list(F.struct(axis, "_h"))), lambda x: F.concat_ws(":", x[axis].cast("string"), x["_h"])
        )
        level = level.groupBy(*keys, *rest).agg(F.md5(F.concat_ws(",", parts)).alias("_h"))
    return level.withColumnRenamed("_h", "content_md5")


def pass_variance(passes: DataFrame) -> DataFrame:
    """Sample variance over repeated passes per cell and class; one pass gives 0."""
    return passes.groupBy("case_id", *CELL, "class_value").agg(
        F.coalesce(F.var_samp("p"), F.lit(0.0)).alias("variance")
    )


def undo_flips(probs: DataFrame, grid: DataFrame) -> DataFrame:
    """Move flipped predictions back; ``flip`` is the set of flipped axes as text, such as ``ik``."""
    moved = probs.join(grid.select("case_id", "ni", "nj", "nk"), "case_id")
    return moved.withColumns({
        c: F.when(F.contains(F.col("flip"), F.lit(c)), F.col(f"n{c}") - 1 - F.col(c)).otherwise(F.col(c)).cast("int")
        for c in CELL
    }).select(*probs.columns)


def average_members(probs: DataFrame) -> DataFrame:
    """Mean probability over all members and flips, floored at 1e-12."""
    return probs.groupBy("case_id", *CELL, "class_value").agg(F.greatest(F.avg("p"), F.lit(1e-12)).alias("p"))


def _per_class(make, n_classes: int, name: str) -> Column:
    """``make`` over every place of the arrays ``p``; a place that an array lacks counts as 0."""
    return F.array(*[make(F.coalesce(F.get("p", F.lit(c)), F.lit(0.0))) for c in range(n_classes)]).alias(name)


def average_arrays(probs: DataFrame, n_classes: int, *, spread: bool = False) -> DataFrame:
    """Mean over all members and flips of ``p``, one array of class probabilities per row, floored at 1e-12.

    Arrays are added place by place on the map side, so a cell crosses the one shuffle once per
    task and no row is made per class.  ``spread`` adds ``variance``, the sample variance per class
    (0 for one row).  Rows without an array are left out.
    """
    aggs = [_per_class(lambda p: F.greatest(F.avg(p), F.lit(1e-12)), n_classes, "p")]
    if spread:
        aggs.append(_per_class(lambda p: F.coalesce(F.var_samp(p), F.lit(0.0)), n_classes, "variance"))
    return probs.where(F.col("p").isNotNull()).groupBy("case_id", *CELL).agg(*aggs)


def _comparable(p: str | Column) -> Column:
    """A mean probability in units of 1e-12, so that means that differ only by the order of their sums are ties."""
    return F.rint((F.col(p) if isinstance(p, str) else p) * 1e12)


def predicted_place(p: str | Column = "p") -> Column:
    """Most probable class of an array of probabilities to twelve places, the lowest class on ties."""
    rounded = F.transform(p, _comparable)
    return (F.array_position(rounded, F.array_max(rounded)) - 1).cast("int")


def predicted_class(probs: DataFrame) -> DataFrame:
    """Most probable class per cell to twelve places, the lowest class value on ties; background cells are dropped."""
    best = struct_max(_comparable("p"), F.col("class_value"), fields=["class_value"]).alias("_b")
    return probs.groupBy("case_id", *CELL).agg(best).select(
        "case_id", *CELL, F.col("_b.class_value").alias("value")
    ).where("value > 0")


def merge_windows(windows: DataFrame, *, size: int, sigma: float = 0.125) -> DataFrame:
    """Blend overlapping windows with Gaussian weights centred on each window.

    ``windows`` has ``case_id, oi, oj, ok`` (window origin), ``i, j, k, class_value, p``.
    """
    centre, width = (size - 1) / 2.0, sigma * size
    square = sum(
        (F.pow(F.col(c) - F.col(f"o{c}") - centre, 2) for c in CELL[1:]), F.pow(F.col("i") - F.col("oi") - centre, 2)
    )
    weight = F.exp(-square / (2.0 * width * width))
    return (
        windows.withColumn("_w", weight).groupBy("case_id", *CELL, "class_value")
        .agg((F.sum(F.col("_w") * F.col("p")) / F.sum("_w")).alias("p"))
    )


# Fixed sampling weights of background and the four classes.
CLASS_RATIOS = (1, 2, 2, 3, 2)


def class_balanced_centres(
    labels: DataFrame, cases: DataFrame, *, ratios: Sequence[float] = CLASS_RATIOS, n: int = 2, seed: int = 0,
    patch: Sequence[int] = (128, 128, 128),
) -> DataFrame:
    """``n`` patch centres per case: a class drawn by weight among those present, then one of its cells.

    ``labels`` must list background cells (value 0) for background to be drawn.
    """
    weight = F.element_at(F.array(*[F.lit(float(r)) for r in ratios]), F.col("value") + 1)
    sizes = labels.groupBy("case_id", "value").agg(F.count(F.lit(1)).alias("_n")).withColumn("_w", weight)
    upto = Window.partitionBy("case_id").orderBy("value")
    whole = Window.partitionBy("case_id")
    shares = sizes.withColumns({
        "_hi": F.sum("_w").over(upto) / F.sum("_w").over(whole),
        "_lo": (F.sum("_w").over(upto) - F.col("_w")) / F.sum("_w").over(whole),
    })
    draws = cases.select("case_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def unit(salt: str):
        word = F.substring(F.md5(F.concat_ws(":", F.col("case_id").cast("string"), F.col("draw").cast("string"), F.lit(f"{seed}{salt}"))), 1, 8)
        return F.conv(word, 16, 10).cast("double") / 4294967296.0

    picked = (
        draws.withColumns({"_u": unit("c"), "_v": unit("p")}).join(shares, "case_id")
        .where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
        .select("case_id", "draw", "value", (F.floor(F.col("_v") * F.col("_n")) + 1).alias("_pos"))
    )
    placed = ranked(labels, ["case_id", "value"], [pack_cell(F.col("i"), F.col("j"), F.col("k"))], "_pos")
    return picked.join(placed, ["case_id", "value", "_pos"]).select(
        "case_id", "draw", "value", *CELL,
        *[(F.col(c) - int(s) // 2).alias(f"{c}_from") for c, s in zip(CELL, patch)],
        *[(F.col(c) - int(s) // 2 + int(s)).alias(f"{c}_to") for c, s in zip(CELL, patch)],
    )
