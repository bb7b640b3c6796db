"""Evaluation over region and score tables: summaries, AUC, calibration, curves and costs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import MIN_CELLS, break_even, dice, finite, struct_max
from ..functions.runtime import cut
from .contacts import PRED, REF, ContactGraph, TileNodes, contact_graph, match_nodes, nodes_under, score_edits, score_masks
from .filters import ORACLES, oracle_fates, threshold_of, with_decisions
from .matching import score_cases
from .ranking import exact_percentiles, ranked, running_totals

# Fixed grids of the reports.
SIZE_GRID = (0, 25, 50, 100, 200, 400, 800, 1600)
DISTANCES = (10, 20, 40)


def decidable(regions: DataFrame, *, floor: int = MIN_CELLS) -> DataFrame:
    return regions.where(F.col("n_cells") >= floor)


def summarise_present(scores: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Mean of both scores where the target is present and over all cases."""
    return scores.groupBy(*keys).agg(
        F.avg(F.when(F.col("present"), F.col("dice"))).alias("dice_where_present"),
        F.avg(F.when(F.col("present"), F.col("lesion_dice"))).alias("lesion_where_present"),
        F.count_if("present").alias("n_present"),
        F.avg("dice").alias("dice_all_cases"),
        F.avg("lesion_dice").alias("lesion_all_cases"),
    )


def summarise(scores: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Per target: mean scores and lesion totals over the cases where the target is present.

    ``false_all_cases`` counts false regions over every case instead.
    """
    here = F.col("present")
    return scores.groupBy(*keys).agg(
        F.avg(F.when(here, F.col("lesion_dice"))).alias("lesion"),
        F.avg(F.when(here, F.col("dice"))).alias("volumetric"),
        F.coalesce(F.sum(F.when(here, F.col("lesions_false"))), F.lit(0)).alias("false_lesions"),
        F.coalesce(F.sum(F.when(here, F.col("lesions_missed"))), F.lit(0)).alias("missed_lesions"),
        F.count_if(here).alias("n"),
        F.sum("lesions_false").alias("false_all_cases"),
    )


def mean_lesion(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over targets of the mean region score."""
    return summary.groupBy(*keys).agg(F.avg("lesion").alias("mean_lesion"))


def case_mean(scores: DataFrame, keys: Sequence[str] = ("case_id",), *, only_present: bool = True) -> DataFrame:
    """Mean region score of each case over its present targets; NULL when none is present."""
    value = F.when(F.col("present"), F.col("lesion_dice")) if only_present else F.col("lesion_dice")
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean_lesion_dice"))


def estimate_stakes(regions: DataFrame, refs: DataFrame) -> DataFrame:
    """Value of a typical entry (L), Dice of a marginal detection (d) and the threshold they imply.

    One row per class where both exist, and one row for all classes (``class_name`` NULL).
    """
    levels_ref = refs.groupingSets([[F.col("class_name")], []], F.col("class_name")).agg(
        F.avg("dice").alias("l_value"), F.count(F.lit(1)).alias("n_ref"), F.grouping("class_name").alias("_all")
    )
    marginal = F.col("matched") & (F.col("rank_by_volume") > 1)
    levels_comp = regions.groupingSets([[F.col("class_name")], []], F.col("class_name")).agg(
        F.avg(F.when(marginal, F.col("dice_with_matched"))).alias("_d"),
        F.coalesce(F.avg(F.when(F.col("matched"), F.col("dice_with_matched"))), F.lit(0.0)).alias("d_all_matched"),
        F.count_if(marginal).alias("n_marginal"),
        F.grouping("class_name").alias("_all"),
    )
    both = levels_ref.alias("r").join(
        levels_comp.alias("c"),
        F.expr("r._all = c._all and r.class_name <=> c.class_name"),
    )
    whole = F.col("r._all") == 1
    d = F.when(whole, F.coalesce("_d", "d_all_matched")).otherwise(F.col("_d"))
    return both.where(whole | F.col("_d").isNotNull()).select(
        F.col("r.class_name").alias("class_name"), "l_value", "n_ref", d.alias("d_value"), "n_marginal",
        "d_all_matched", break_even(F.col("l_value"), d).alias("p_star"),
        break_even(F.col("l_value"), F.col("d_all_matched")).alias("p_star_all_matched"),
    )


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC with ties counted half; non-finite scores dropped, NULL if a class is empty."""
    keys = list(by)
    counts = (
        df.select(*keys, finite(score).alias("_s"), F.col(label).cast("boolean").alias("_y"))
        .where(F.col("_s").isNotNull() & F.col("_y").isNotNull())
        .groupBy(*keys, "_s").agg(F.count_if("_y").alias("_pos"), F.count_if(~F.col("_y")).alias("_neg"))
    )
    upto = running_totals(counts, keys, [F.col("_s")], {"_below": F.col("_neg")})
    twice = F.col("_pos").cast("decimal(19,0)") * (2 * F.col("_below") - F.col("_neg")).cast("decimal(19,0)")
    sums = upto.groupBy(*keys).agg(
        F.sum(twice).cast("double").alias("_u"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg")
    )
    pairs = 2.0 * F.col("n_pos") * F.col("n_neg")
    return sums.select(*keys, "n_pos", "n_neg", F.when(pairs > 0, F.col("_u") / pairs).alias("auc"))


def long_features(regions: DataFrame, names: Sequence[str], *, extra: Sequence[str] = ()) -> DataFrame:
    """One row per region and feature: ``extra, feature, value`` with non-finite values as NULL."""
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), finite(n).alias("value")) for n in names])
    return regions.select(*extra, F.explode(entries).alias("_f")).select(*extra, "_f.feature", "_f.value")


def feature_aucs(regions: DataFrame, names: Sequence[str], *, label: str = "matched") -> DataFrame:
    """AUC of every feature overall (``scope = 'all'``) and per class; the direction is kept."""
    rows = long_features(regions, names, extra=["class_name", label])
    scoped = rows.select(
        "feature", "value", label, F.explode(F.array(F.lit("all"), F.col("class_name"))).alias("scope")
    )
    sizes = scoped.groupBy("scope", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("n_matched")
    )
    return sizes.join(auc(scoped, "value", label, ["scope", "feature"]), ["scope", "feature"], "left").select(
        "scope", "feature", "n", "n_matched", "auc"
    )


def _bin_of(p: Column, bins: int) -> Column:
    edges = [b / bins for b in range(1, bins)]
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= p))


def reliability(df: DataFrame, p: str, y: str, *, bins: int = 10, min_rows: int = 5,
                by: Sequence[str] = ()) -> DataFrame:
    """Mean prediction, observed share and count of each probability bin with enough rows."""
    rows = df.where(finite(p).isNotNull()).withColumn("bin", _bin_of(F.col(p), bins))
    return rows.groupBy(*by, "bin").agg(
        F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("int")).alias("observed"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= min_rows)


def calibration_error(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over the bins of a reliability curve."""
    gap = F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))
    return curve.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def reference_criticals(regions: DataFrame, refs: DataFrame, *, probability: str, floor: int, region_keys: Sequence[str]) -> DataFrame:
    """Highest threshold at which each reference region still has a surviving detector."""
    crit = F.when(F.col("n_cells") < floor, F.lit(float("inf"))).otherwise(F.col(probability))
    keep = regions.select(*region_keys, "comp_id", crit.alias("_crit"))
    ids = [*region_keys, "ref_id"]
    touching = (
        refs.select(*ids, F.explode("matched_comp_ids").alias("comp_id"))
        .join(keep, [*region_keys, "comp_id"]).groupBy(*ids).agg(F.max("_crit").alias("_crit"))
    )
    return refs.select(*ids).join(touching, ids, "left")


def detection_curve(
    regions: DataFrame, refs: DataFrame, n_cases: int, thresholds: Iterable[float], *,
    probability: str = "posterior", floor: int = MIN_CELLS, by: Sequence[str] = (),
    region_keys: Sequence[str] = ("case_id", "class_name"),
) -> DataFrame:
    """Sensitivity and false positives per case at every threshold.

    Each reference region is detected up to its critical threshold and each false positive
    survives up to its own probability, so one histogram over the grid gives all points.
    """
    grid = sorted({float(t) for t in thresholds})
    grid_array = F.array(*[F.lit(t) for t in grid])

    def reached(column: Column) -> Column:
        return F.size(F.filter(grid_array, lambda t: t <= column))

    crit = reference_criticals(regions, refs, probability=probability, floor=floor, region_keys=region_keys)
    ref_bins = crit.select(*by, F.coalesce(reached(F.col("_crit")), F.lit(0)).alias("_b"), F.lit(1).alias("_ref"), F.lit(0).alias("_fp"))
    false = regions.where(~F.col("matched") & (F.col("n_cells") >= floor))
    fp_bins = false.select(*by, reached(F.col(probability)).alias("_b"), F.lit(0).alias("_ref"), F.lit(1).alias("_fp"))
    seen = ref_bins.unionByName(fp_bins).groupBy(*by, "_b").agg(F.sum("_ref").alias("_ref"), F.sum("_fp").alias("_fp"))
    points = F.explode(F.array(*[
        F.struct(F.lit(n + 1).alias("pos"), F.lit(t).alias("threshold")) for n, t in enumerate(grid)
    ])).alias("_t")
    survives = F.col("_b") >= F.col("_t.pos")
    per_point = seen.select("*", points).groupBy(*by, F.col("_t.threshold").alias("threshold")).agg(
        F.sum(F.when(survives, F.col("_ref")).otherwise(0)).alias("n_detected"),
        F.sum(F.when(survives, F.col("_fp")).otherwise(0)).alias("n_fp"),
        F.sum("_ref").alias("n_ref"),
    )
    return per_point.select(
        *by, "threshold",
        (F.col("n_detected") / F.greatest(F.lit(1), F.col("n_ref"))).alias("sensitivity"),
        (F.col("n_fp") / F.lit(float(max(1, n_cases)))).alias("fp_per_case"),
        "n_ref", "n_detected", "n_fp",
    )


def detection_summary(
    regions: DataFrame, refs: DataFrame, p_star: float, n_cases: int, *,
    probability: str = "posterior", floor: int = MIN_CELLS, region_keys: Sequence[str] = ("case_id", "class_name"),
) -> DataFrame:
    """Detection before (threshold 0) and after (``p_star``), overall and per class."""
    scope = F.explode(F.array(F.lit("all"), F.col("class_name"))).alias("scope")
    keys = ["scope", *region_keys]
    both = [d.select("*", scope) for d in (regions, refs)]
    stages = [
        detection_curve(*both, n_cases, [at], probability=probability, floor=floor, by=["scope"], region_keys=keys)
        .withColumn("stage", F.lit(stage)) for stage, at in (("before", 0.0), ("after", p_star))
    ]
    return stages[0].unionByName(stages[1])


def with_losses(refs: DataFrame, decisions: DataFrame, region_keys: Sequence[str]) -> DataFrame:
    """Add ``_lost``: detected reference regions none of whose matching regions is kept."""
    ids = [*region_keys, "ref_id"]
    alive = (
        refs.where("detected").select(*ids, F.explode("matched_comp_ids").alias("comp_id"))
        .join(decisions.select(*region_keys, "comp_id", "keep"), [*region_keys, "comp_id"], "left")
        .groupBy(*ids).agg(F.bool_or(F.coalesce("keep", F.lit(True))).alias("_alive"))
    )
    return refs.join(alive, ids, "left").withColumn(
        "_lost", F.col("detected") & ~F.coalesce("_alive", F.lit(False))
    ).drop("_alive")


def tradeoff_totals(
    refs: DataFrame, decisions: DataFrame, *, region_keys: Sequence[str] = ("case_id", "class_name")
) -> DataFrame:
    """Overall row of the trade-off: scored references, those detected before, and detections deleted."""
    return with_losses(refs, decisions, region_keys).agg(
        F.count(F.lit(1)).alias("n_refs"), F.count_if("detected").alias("n_detected"), F.count_if("_lost").alias("n_deleted")
    )


def distance_tradeoff(
    refs: DataFrame, decisions: DataFrame, before: DataFrame, after: DataFrame, *,
    bands: Sequence[float] = DISTANCES, region_keys: Sequence[str] = ("case_id", "class_name"),
) -> DataFrame:
    """Cost of the decisions for reference regions beyond each distance from the dominant mass.

    ``decisions`` has the region key and ``keep``; a region that is not listed survives.
    """
    distance = finite("dist_to_dominant_mm")
    far = (
        with_losses(refs, decisions, region_keys).select(*region_keys, "ref_id", "_lost", distance.alias("_d"))
        .select("*", F.explode(F.array(*[F.lit(float(b)) for b in bands])).alias("band"))
        .where(F.col("_d") > F.col("band"))
    )
    per_case = far.groupBy("band", "case_id").agg(
        F.count(F.lit(1)).alias("_far"), F.count_if("_lost").alias("_lost")
    )
    counts = per_case.groupBy("band").agg(
        F.sum("_far").alias("n_beyond"), F.count(F.lit(1)).alias("n_cases_with_one"),
        F.sum("_lost").alias("n_deleted"), F.count_if(F.col("_lost") > 0).alias("n_cases_hurt"),
    )
    delta = case_mean(before).withColumnRenamed("mean_lesion_dice", "_b").join(
        case_mean(after).withColumnRenamed("mean_lesion_dice", "_a"), "case_id"
    ).select("case_id", (F.col("_a") - F.col("_b")).alias("_delta"))
    tagged = (
        delta.select("*", F.explode(F.array(*[F.lit(float(b)) for b in bands])).alias("band"))
        .join(per_case.select("band", "case_id", F.lit(True).alias("_is_far")), ["band", "case_id"], "left")
        .groupBy("band").agg(
            F.avg(F.when(F.col("_is_far"), F.col("_delta"))).alias("delta_on_those"),
            F.avg(F.when(F.col("_is_far").isNull(), F.col("_delta"))).alias("delta_on_rest"),
        )
    )
    zero = ("n_beyond", "n_cases_with_one", "n_deleted", "n_cases_hurt")
    return tagged.join(counts, "band", "left").fillna(0, subset=list(zero)).select(
        "band", *zero, "delta_on_those", "delta_on_rest"
    )


def concentration(
    false_per_case: DataFrame, missed_per_case: DataFrame, n_cases: int, *, shares: Sequence[float] = (0.1, 0.2, 0.5)
) -> DataFrame:
    """Cases without false positives, with misses, with both, and the share held by the worst cases.

    Inputs have ``case_id, n`` for cases with at least one.
    """
    placed = ranked(false_per_case, [], [F.col("n").desc(), F.col("case_id")], "_pos")
    joined = placed.join(missed_per_case.select("case_id", F.lit(1).alias("_m")), "case_id", "left")
    worst = [
        (F.sum(F.when(F.col("_pos") <= max(1, int(n_cases * s)), F.col("n")).otherwise(0)) / F.sum("n"))
        .alias(f"worst_{int(s * 100)}pct") for s in shares
    ]
    missed = missed_per_case.agg(F.count(F.lit(1)).alias("m")).first().m
    return joined.agg(
        (F.lit(n_cases) - F.count(F.lit(1))).alias("cases_without_false"),
        F.lit(missed).alias("cases_with_missed"),
        F.count("_m").alias("cases_with_both"),
        *worst,
    )


def error_anatomy(origins: DataFrame, called: Column) -> DataFrame:
    """Count of regions per class and what they are called on the other side."""
    return origins.groupBy("class_value", called.alias("called")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("covered_frac").alias("mean_covered")
    )


def sweep_sizes(
    pred: DataFrame, ref: DataFrame, cases: DataFrame, targets: Mapping[str, Iterable[int]],
    grid: Sequence[int] = SIZE_GRID, *, min_cells: int = MIN_CELLS, **options,
) -> DataFrame:
    """Scores of every case at every size threshold.

    Cells are labelled once; a threshold keeps the nodes of the contact graph that reach it.
    """
    levels = [int(g) for g in grid]

    def edits(nodes: TileNodes) -> np.ndarray:
        return np.stack([np.where((nodes.side == REF) | (nodes.size >= t), nodes.value, 0) for t in levels])

    def edited(graph: ContactGraph) -> DataFrame:
        left = [F.when(F.col("n_cells") >= t, F.col("value")).otherwise(0) for t in levels]
        return graph.side(PRED)[0].withColumn("values", F.array(*left))

    return score_masks(pred, ref, cases, targets, ("threshold", levels), edits, edited, min_cells=min_cells, **options)


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """Summary per threshold and target of a size sweep."""
    return summarise(sweep, ["threshold", "target"])


def best_threshold(summary: DataFrame) -> DataFrame:
    """Threshold with the best mean over targets; the first wins ties."""
    means = mean_lesion(summary, ["threshold"])
    best = struct_max("mean_lesion", F.col("threshold"), fields=["threshold"]).alias("_b")
    return means.agg(best).select("_b.threshold", F.col("_b._v").alias("mean_lesion"))


def best_thresholds(summary: DataFrame, classes: Iterable[str]) -> DataFrame:
    """Best threshold of each labelled class; composites get none."""
    best = struct_max("lesion", F.col("threshold"), fields=["threshold"]).alias("_b")
    return summary.where(F.col("target").isin(list(classes))).groupBy("target").agg(best).select(
        "target", "_b.threshold", F.col("_b._v").alias("lesion")
    )


def compare_variants(
    pred: DataFrame, ref: DataFrame, cases: DataFrame, targets: Mapping[str, Iterable[int]],
    thresholds: int | Mapping[int, int], decisions: DataFrame | Callable[[DataFrame], DataFrame], *, min_cells: int = MIN_CELLS, **options,
) -> DataFrame:
    """Scores of the mask as it is, after the size filter and after the decisions, from one contact graph.

    ``decisions`` may be a function that adds ``keep`` to the regions (``case_id, class_value, comp_id, n_cells``)
    where a region's own row decides; no region is joined to a table then.
    """
    graph = contact_graph(pred, ref, **options)
    regions = graph.numbered(PRED)
    decided = decisions(regions) if callable(decisions) else with_decisions(regions, decisions)
    big, keep = F.col("n_cells") >= threshold_of(thresholds), F.coalesce("keep", F.lit(True))
    own = F.col("value")
    edited = decided.withColumn("values", F.array(own, F.when(big, own).otherwise(0), F.when(keep, own).otherwise(0)))
    return score_edits(graph, edited, cases, targets, ("variant", ("none", "size", "selector")), min_cells=min_cells)


def score_oracles(
    graph: ContactGraph, origin: DataFrame, cases: DataFrame, targets: Mapping[str, Iterable[int]], *, min_cells: int = MIN_CELLS
) -> DataFrame:
    """Scores of the masks of ``filters.oracle_masks`` without building them: fates are given to nodes."""
    return score_edits(graph, _with_fates(graph, origin), cases, targets, ("variant", ORACLES), min_cells=min_cells)


def _with_fates(graph: ContactGraph, origin: DataFrame) -> DataFrame:
    return oracle_fates(graph.numbered(PRED), origin).withColumn("values", F.col("fates.value"))


def score_oracle_masks(
    pred: DataFrame, ref: DataFrame, cases: DataFrame, targets: Mapping[str, Iterable[int]], *,
    min_cells: int = MIN_CELLS, majority: float = 0.5, **options,
) -> DataFrame:
    """:func:`score_oracles` of the false positives of ``match_classes``, without their tables."""

    def edits(nodes: TileNodes) -> np.ndarray:
        n, own = len(nodes.size), nodes.value
        p, r, cells = nodes.shared
        hit = p[(own[p] == own[r]) & (nodes.size[r] >= min_cells)]
        false = (nodes.side == PRED) & (nodes.size >= min_cells)
        false[hit] = False
        classes, called = np.unique(own[nodes.side == REF]), np.zeros(n, own.dtype)
        votes = np.stack([np.bincount(p[own[r] == c], cells[own[r] == c], n) for c in classes]) if len(classes) else np.zeros((1, n))
        enough = votes.sum(0) / nodes.size >= majority
        if len(classes):
            called[enough] = classes[votes.argmax(0)][enough]
        renamed = np.where(false & (called > 0), called, own)
        return np.stack([own, renamed, np.where(false, 0, own), np.where(false, called, own)])

    def edited(graph: ContactGraph) -> DataFrame:
        region = ["case_id", "class_value", "comp_id"]
        lost = match_nodes(graph, min_cells=min_cells).comps.where("false_positive").select(*region)
        return _with_fates(graph, cut(nodes_under(graph, PRED, majority=majority).join(lost, region, "left_semi")))

    return score_masks(pred, ref, cases, targets, ("variant", ORACLES), edits, edited, min_cells=min_cells, **options)


def evaluate_masks(
    masks: DataFrame, ref: DataFrame, cases: DataFrame, targets: Mapping[str, Iterable[int]],
    variants: Sequence[str], *, min_cells: int = MIN_CELLS, **options,
) -> DataFrame:
    """Scores of several masks of the same cases held in one table under ``variant``."""
    names = F.array(*[F.lit(n) for n in variants])
    return score_cases(
        masks, ref, cases.select("case_id").distinct().select("case_id", F.explode(names).alias("variant")),
        targets, min_cells=min_cells, keys=["variant", "case_id"], variants=("variant", names), **options,
    )


def gate(summary_a: DataFrame, summary_b: DataFrame) -> DataFrame:
    """Whether run A's mean where present is strictly above run B's; targets without a value are skipped."""
    both = summary_a.select(F.lit("a").alias("run"), "lesion_where_present").unionByName(
        summary_b.select(F.lit("b").alias("run"), "lesion_where_present")
    )
    means = [F.avg(F.when(F.col("run") == r, F.col("lesion_where_present"))).alias(f"mean_{r}") for r in ("a", "b")]
    return both.agg(*means).withColumn("proceed", F.col("mean_a") > F.col("mean_b"))


def separation_histograms(regions: DataFrame, names: Sequence[str], *, bins: int = 35, label: str = "matched") -> DataFrame:
    """Density of each feature per class and outcome between the pooled 0.5 and 99.5 percentiles."""
    rows = long_features(regions, names, extra=["class_name", label]).where(F.col("value").isNotNull())
    keys = ["class_name", "feature"]
    limits = exact_percentiles(rows, keys, "value", {"_lo": 0.005, "_hi": 0.995}).withColumn(
        "_hi", F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1e-6).otherwise(F.col("_hi"))
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    spot = F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    inside = rows.join(limits, keys).where(F.col("value").between(F.col("_lo"), F.col("_hi")))
    counts = inside.withColumns({"bin": spot, "_w": width}).groupBy(*keys, label, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_w").alias("_w")
    )
    totals = counts.groupBy(*keys, label).agg(F.sum("n").alias("_t"))
    return counts.join(totals, [*keys, label]).select(
        *keys, label, "bin", "n", (F.col("n") / (F.col("_t") * F.col("_w"))).alias("density")
    )


def feature_means(regions: DataFrame, names: Sequence[str], *, label: str = "matched") -> DataFrame:
    """Mean of each feature for real and spurious regions of every class."""
    rows = long_features(regions, names, extra=["class_name", label])
    return rows.groupBy("class_name", "feature").agg(
        F.avg(F.when(F.col(label), F.col("value"))).alias("real"),
        F.avg(F.when(~F.col(label), F.col("value"))).alias("spurious"),
    )


def miss_rate_by_size(refs: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Share of missed reference regions per size band."""
    band = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("n_cells")))
    return refs.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n_refs"), F.avg((~F.col("detected")).cast("int")).alias("miss_rate")
    )


def median_size_by_outcome(refs: DataFrame) -> DataFrame:
    """Exact median size of detected and of missed reference regions."""
    sized = refs.select("detected", F.col("n_cells").cast("double").alias("_n"))
    return exact_percentiles(sized, ["detected"], "_n", {"median_cells": 0.5})


def compare_runs(before: DataFrame, after: DataFrame, *, margin: float = 0.01) -> DataFrame:
    """Cases better, worse or unchanged between two runs, and those newly fixed or newly failed."""
    b = case_mean(before).withColumnRenamed("mean_lesion_dice", "_b")
    a = case_mean(after).withColumnRenamed("mean_lesion_dice", "_a")
    delta = F.round(F.col("_a") - F.col("_b"), 12)  # a margin is not crossed by summation noise
    return b.join(a, "case_id").agg(
        F.count_if(delta > margin).alias("improved"),
        F.count_if(delta < -margin).alias("worse"),
        F.count_if(F.abs(delta) <= margin).alias("unchanged"),
        F.count_if((F.col("_b") == 0) & (F.col("_a") > 0)).alias("newly_fixed"),
        F.count_if((F.col("_b") > 0) & (F.col("_a") == 0)).alias("newly_failed"),
    )


def score_bands(scores: DataFrame, keys: Sequence[str] = ("run",), *, edges: Sequence[float] = (0.2, 0.5, 0.8, 0.9)) -> DataFrame:
    """Number of cases per score band and run."""
    value = F.round("mean_lesion_dice", 12)  # an edge is not crossed by summation noise
    band = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))
    return scores.where(F.col("mean_lesion_dice").isNotNull()).groupBy(*keys).agg(
        *[F.count_if(band == n).alias(f"band_{n}") for n in range(len(edges) + 1)]
    )


def class_epoch_dice(counts: DataFrame) -> DataFrame:
    """Mean Dice per epoch and class from per-case cell counts."""
    return counts.withColumn("_d", dice("n_pred", "n_ref", "n_shared")).groupBy("epoch", "class_name").agg(
        F.avg("_d").alias("mean_dice")
    )


def pick_spread(case_scores: DataFrame, n: int, *, how: str = "spread") -> DataFrame:
    """Cases to show: evenly spaced over the sorted scores, or the best, worst or first ones."""
    order = [F.col("mean_lesion_dice").asc(), F.col("case_id").asc()]
    if how == "first":
        return case_scores.orderBy("case_id").limit(n)
    if how == "worst":
        return case_scores.orderBy(*order).limit(n)
    if how == "best":
        return case_scores.orderBy(F.col("mean_lesion_dice").desc(), F.col("case_id").desc()).limit(n)
    placed = cut(ranked(case_scores, [], order, "position"))
    total = placed.count()
    n = min(n, total)
    wanted = sorted({int(round(s * (total - 1) / (n - 1))) + 1 if n > 1 else 1 for s in range(n)})
    return placed.where(F.col("position").isin(wanted))


def pick_cases(regions: DataFrame, n: int, strategy: str = "cost", *, floor: int = MIN_CELLS) -> DataFrame:
    """Cases ordered by what the decisions cost or won; ``keep`` is the decision."""
    dropped = (F.col("n_cells") >= floor) & ~F.col("keep")
    counts = regions.where(F.col("n_cells") >= floor).groupBy("case_id").agg(
        F.count_if(dropped & F.col("matched")).alias("lost"),
        F.count_if(dropped & ~F.col("matched")).alias("won"),
    )
    order = {
        "cost": [F.col("lost").desc(), F.col("won").desc()],
        "win": [F.col("won").desc(), F.col("lost").asc()],
        "first": [],
    }[strategy]
    return counts.orderBy(*order, "case_id").limit(n)
