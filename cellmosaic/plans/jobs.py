"""End-to-end jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import MIN_CELLS
from ..functions.runtime import cut
from ..operators.contacts import PRED, REF, contact_graph, match_nodes, nodes_under
from ..operators.evaluation import (
    compare_variants, detection_curve, detection_summary, distance_tradeoff, score_oracles, summarise,
)
from ..operators.filters import keep_decisions
from ..operators.modelling import Model, with_derived, with_posterior
from ..operators.regions import region_table
from ..sources.ledger import record_application, refuse_second


@dataclass(frozen=True)
class Applied:
    decisions: DataFrame
    scores: DataFrame
    summary: DataFrame
    detection: DataFrame
    tradeoff: DataFrame
    curve: DataFrame


def apply_job(
    pred: DataFrame, ref: DataFrame, probs: DataFrame, grid: DataFrame, model: Model, p_star: float,
    targets: Mapping[str, Iterable[int]], thresholds: int | Mapping[int, int], *, ledger: str, run: str, split: str,
    force: bool = False, min_cells: int = MIN_CELLS, class_names: Mapping[int, str] | None = None,
    variance: DataFrame | None = None,
) -> Applied:
    """Score a held-out split once with a fitted selector; the ledger notes it when all results exist."""
    spark = pred.sparkSession
    if not force:
        refuse_second(spark, ledger, run, split, model)
    options = {} if class_names is None else {"class_names": class_names}
    regions, refs = region_table(pred, ref, probs, grid, variance=variance, min_cells=min_cells, **options)
    regions, refs = cut(with_posterior(with_derived(regions), model)), cut(refs)
    decided = cut(keep_decisions(regions, p_star, floor=min_cells))
    scores = cut(compare_variants(pred, ref, grid, targets, thresholds, decided, min_cells=min_cells))
    n_cases = grid.select("case_id").distinct().count()
    with_regions = regions.select("case_id").distinct().count()
    before, after = (
        scores.where(F.col("variant") == v).drop("variant") for v in ("none", "selector")
    )
    applied = Applied(
        decided,
        scores,
        cut(summarise(scores, ["variant", "target"])),
        cut(detection_summary(regions, refs, p_star, n_cases, floor=min_cells)),
        cut(distance_tradeoff(refs, decided, before, after)),
        cut(detection_curve(regions, refs, with_regions, [n / 100 for n in range(101)], floor=min_cells)),
    )
    record_application(spark, ledger, run, split, model, force=force)
    return applied


def attribute_errors(
    pred: DataFrame, ref: DataFrame, cases: DataFrame, targets: Mapping[str, Iterable[int]], *, min_cells: int = MIN_CELLS
) -> dict[str, DataFrame]:
    """False and missed regions with what is there instead, and the score of each oracle mask."""
    graph = contact_graph(pred, ref)
    matching = match_nodes(graph, min_cells=min_cells)
    region = ["case_id", "class_value", "comp_id"]
    false = cut(nodes_under(graph, PRED).join(matching.comps.where("false_positive").select(*region), region, "left_semi"))
    lost = matching.refs.where("scored and not detected").select("case_id", "class_value", F.col("ref_id").alias("comp_id"))
    missed = cut(nodes_under(graph, REF).join(lost, region, "left_semi"))
    scores = score_oracles(graph, false, cases, targets, min_cells=min_cells)
    return {"false": false, "missed": missed, "scores": scores, "summary": summarise(scores, ["variant", "target"])}
