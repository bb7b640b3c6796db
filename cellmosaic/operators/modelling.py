"""Keep/drop and rename models over region tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import MIN_CELLS, entity_of, finite
from ..functions.runtime import cut
from .evaluation import (
    auc, calibration_error, decidable, detection_curve, estimate_stakes, feature_aucs, long_features, reliability,
)
from .groups import assign_folds
from .ranking import exact_percentiles

# Fixed feature lists of the models.
FIT_FEATURES = (
    "log_n_voxels", "mean_prob", "p90_prob", "max_prob", "mean_border_prob",
    "log1p_dist", "log_mc_var", "rank_by_prob", "n_comps_in_class",
)
DIAGNOSTIC_FEATURES = (
    "dist_to_dominant_mm", "mean_prob", "p90_prob", "max_prob", "mean_border_prob", "log_n_voxels",
    "mc_mean_var", "rank_by_prob",
)
IMAGE_FIT_FEATURES = (
    "z_t1c_mean", "z_t1c_contrast", "z_t1c_mirror", "z_t1n_contrast", "z_t2f_mean", "z_t2f_contrast",
    "z_t2f_mirror", "z_t2w_mean", "z_t2w_contrast", "z_t2w_mirror", "enhancement", "flair_minus_t2",
    "log1p_edge", "frac_outside_brain",
)
RENAME_FEATURES = (
    "log_n_voxels", "mean_prob", "runner_up_prob", "margin", "log_ratio", "prob_c0", "log1p_dist",
)
_SOURCES = {
    "log_n_voxels": "n_cells", "log1p_dist": "dist_to_dominant_mm", "log_mc_var": "mc_mean_var",
    "log1p_edge": "dist_to_brain_edge_mm",
}


@dataclass(frozen=True)
class Model:
    """A fitted model as plain values, so that it can be stored as JSON and replayed."""

    features: list[str]
    classes: list[str]
    columns: list[str]
    impute: dict[str, float]
    mean: list[float]
    std: list[float]
    coef: list[float]
    intercept: float
    n_train: int = 0
    n_positive: int = 0
    extra: dict = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


def available(regions: DataFrame, names: Iterable[str]) -> list[str]:
    """Names whose column, or source column for derived ones, is in the table."""
    return [n for n in names if n in regions.columns or _SOURCES.get(n) in regions.columns]


def with_derived(regions: DataFrame) -> DataFrame:
    """Logarithmic features of the table; NULL where the source is missing or not finite."""
    forms = {
        "log_n_voxels": lambda c: F.log(F.greatest(F.lit(1.0), c)),
        "log1p_dist": lambda c: F.log1p(c),
        "log_mc_var": lambda c: F.log10(c + F.lit(1e-9)),
        "log1p_edge": lambda c: F.log1p(c),
    }
    return regions.withColumns({n: forms[n](finite(s)) for n, s in _SOURCES.items() if s in regions.columns})


def join_features(regions: DataFrame, extra: DataFrame, *, check: str = "n_voxels_check",
                  keys: Sequence[str] = ("case_id", "class_name", "comp_id")) -> DataFrame:
    """Attach image features by region key; a missing key or another cell count is an error."""
    keys = list(keys)
    joined = regions.join(extra, keys, "left")
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    missing = F.concat(F.lit("no image features for "), name)
    differs = F.concat(
        F.lit("image features disagree for "), name, F.lit(": "), F.col(check).cast("string"),
        F.lit(" cells against "), F.col("n_cells").cast("string"),
    )
    checked = (
        F.when(F.col(check).isNull(), F.raise_error(missing).cast("long"))
        .when(F.col(check) != F.col("n_cells"), F.raise_error(differs).cast("long"))
        .otherwise(F.col("n_cells"))
    )
    return joined.withColumn("n_cells", checked).drop(check)


def require_present(regions: DataFrame, names: Sequence[str]) -> None:
    """Refuse to go on when a feature is missing in every row."""
    counts = regions.agg(*[F.count(finite(n)).alias(n) for n in names]).first()
    missing = [n for n in names if counts[n] == 0]
    if missing:
        raise ValueError(f"feature {missing[0]!r} is missing for every region")


def medians(regions: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Exact median of the finite values of each feature."""
    rows = exact_percentiles(long_features(regions, names), ["feature"], "value", {"m": 0.5}).collect()
    found = {r.feature: r.m for r in rows}
    return {n: float(found.get(n, 0.0)) for n in names}


def class_list(regions: DataFrame) -> list[str]:
    return sorted(r.class_name for r in regions.select("class_name").distinct().collect())


def design_columns(names: Sequence[str], classes: Sequence[str], impute: Mapping[str, float]) -> dict[str, Column]:
    """Imputed features, then an indicator for every class but the first."""
    out = {n: F.coalesce(finite(n), F.lit(float(impute[n]))) for n in names}
    out.update({f"is_{c}": F.when(F.col("class_name") == c, 1.0).otherwise(0.0) for c in classes[1:]})
    return out


def fit_logistic(
    regions: DataFrame, names: Sequence[str], label: Column, *, classes: Sequence[str] | None = None,
    c: float = 1.0, max_iter: int = 2000,
) -> Model:
    """L2 logistic regression on standardised features; one outcome only gives the base rate."""
    classes = list(classes) if classes is not None else class_list(regions)
    require_present(regions, names)
    impute = medians(regions, names)
    columns = design_columns(names, classes, impute)
    x = [f"x{n}" for n in range(len(columns))]
    table = regions.select(*[col.alias(a) for a, col in zip(x, columns.values())], label.cast("double").alias("label"))
    stats = table.agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"),
        *[F.avg(a).alias(f"m_{a}") for a in x], *[F.stddev_pop(a).alias(f"s_{a}") for a in x],
    ).first()
    mean = [float(stats[f"m_{a}"]) for a in x]
    std = [float(stats[f"s_{a}"]) or 1.0 for a in x]
    n, pos = int(stats.n), int(stats.pos)
    if pos in (0, n):
        rate = min(max(pos / n, 1e-6), 1 - 1e-6)
        coef, intercept = [0.0] * len(x), math.log(rate / (1 - rate))
    else:
        scaled = table.select(
            *[((F.col(a) - m) / s).alias(a) for a, m, s in zip(x, mean, std)], "label"
        )
        vectors = VectorAssembler(inputCols=x, outputCol="features").transform(scaled).select("features", "label")
        fitted = LogisticRegression(
            regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=max_iter
        ).fit(vectors)
        coef, intercept = [float(v) for v in fitted.coefficients], float(fitted.intercept)
    return Model(list(names), classes, list(columns), impute, mean, std, coef, intercept, n, pos)


def posterior_expr(model: Model) -> Column:
    """The model as one column expression."""
    columns = design_columns(model.features, model.classes, model.impute)
    z = F.lit(model.intercept)
    for name, m, s, b in zip(model.columns, model.mean, model.std, model.coef):
        z = z + F.lit(b) * (columns[name] - F.lit(m)) / F.lit(s)
    return 1.0 / (1.0 + F.exp(-z))


def with_posterior(regions: DataFrame, model: Model, name: str = "posterior") -> DataFrame:
    require_present(regions, model.features)
    return regions.withColumn(name, posterior_expr(model))


def fit_selector(regions: DataFrame, names: Sequence[str], *, classes: Sequence[str] | None = None, c: float = 1.0) -> Model:
    """Probability that a region is real, from the region table with derived features."""
    return fit_logistic(regions, names, F.col("matched"), classes=classes, c=c)


def _routed(folds: Mapping[int, Model], full: Model) -> Column:
    """Posterior by the fold model of the row, or the full model where the entity was never seen."""
    out = None
    for f, model in folds.items():
        condition = F.col("fold") == f
        out = F.when(condition, posterior_expr(model)) if out is None else out.when(condition, posterior_expr(model))
    return posterior_expr(full) if out is None else out.otherwise(posterior_expr(full))


def fit_folds(
    regions: DataFrame, names: Sequence[str], label: Column, *, by: str = "case_id", k: int = 5, seed: int = 0,
) -> tuple[DataFrame, dict[int, Model]]:
    """Fold table of ``by`` and one model per fold fitted without that fold; one shared encoding."""
    classes = class_list(regions)
    folds = cut(assign_folds(regions, by=by, k=k, seed=seed))
    rows = cut(regions.join(folds, by))
    present = sorted(r.fold for r in folds.select("fold").distinct().collect())
    models = {}
    for f in present:
        training = rows.where(F.col("fold") != f)
        if not training.isEmpty():
            models[f] = fit_logistic(training, names, label, classes=classes)
    return folds, models


def route_models(regions: DataFrame, folds: DataFrame, models: Mapping[int, Model], full: Model, *,
                 by: str = "case_id", name: str = "posterior") -> DataFrame:
    """Apply to every row the model that never saw its ``by`` value."""
    joined = regions.join(folds, by, "left")
    return joined.withColumn(name, _routed(models, full)).drop("fold")


def out_of_fold(regions: DataFrame, names: Sequence[str], *, by: str = "case_id", k: int = 5, seed: int = 0,
                label: Column | None = None, name: str = "posterior") -> DataFrame:
    """Posterior of every row from a model fitted without the row's ``by`` value."""
    folds, models = fit_folds(regions, names, F.col("matched") if label is None else label, by=by, k=k, seed=seed)
    out = None
    for f, model in models.items():
        cond = F.col("fold") == f
        out = F.when(cond, posterior_expr(model)) if out is None else out.when(cond, posterior_expr(model))
    return regions.join(folds, by).withColumn(name, F.lit(0.0) if out is None else out.otherwise(0.0))


def coefficients(model: Model, spark) -> DataFrame:
    """Coefficients by absolute size."""
    rows = list(zip(model.columns, model.coef))
    return spark.createDataFrame(rows, "column_name string, coefficient double").orderBy(
        F.abs("coefficient").desc(), "column_name"
    )


def eligible(regions: DataFrame, *, floor: int = MIN_CELLS) -> DataFrame:
    """Regions a rename can be decided for: decidable and with a runner-up class."""
    return decidable(regions, floor=floor).where(F.col("runner_up_value").isNotNull())


def rename_features(regions: DataFrame, runner_ups: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """Margin, log ratio and runner-up indicators; the first runner-up is the reference level."""
    own, other = F.col("mean_prob"), F.col("runner_up_prob")
    columns = {
        "margin": own - other,
        "log_ratio": F.log((other + F.lit(1e-6)) / (own + F.lit(1e-6))),
        **{f"ru_is_{v}": F.when(F.col("runner_up_value") == v, 1.0).otherwise(0.0) for v in runner_ups},
    }
    return regions.withColumns(columns), [*RENAME_FEATURES, *[f"ru_is_{v}" for v in runner_ups[1:]]]


def rename_label() -> Column:
    return F.col("ref_majority_value").cast("int") == F.col("runner_up_value").cast("int")


@dataclass(frozen=True)
class Renamer:
    model: Model
    folds: DataFrame
    fold_models: dict[int, Model]
    runner_ups: list[int]
    diagnostics: DataFrame


def fit_renamer(regions: DataFrame, *, k: int = 5, seed: int = 0, threshold: float = 0.5, floor: int = MIN_CELLS) -> Renamer:
    """Probability that a region's runner-up class is its true class; folds by entity."""
    rows = eligible(with_derived(regions), floor=floor).withColumn("entity_id", entity_of("case_id"))
    ups = sorted(int(r.runner_up_value) for r in rows.select("runner_up_value").distinct().collect())
    table, names = rename_features(rows, ups)
    table = cut(table)
    full = fit_logistic(table, names, rename_label())
    folds, models = fit_folds(table, names, rename_label(), by="entity_id", k=k, seed=seed)
    scored = cut(route_models(table, folds, models, full, by="entity_id"))
    return Renamer(full, folds, models, ups, rename_diagnostics(scored, threshold=threshold))


def rename_diagnostics(scored: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Eligible regions, correct runner-ups, renames, their precision and what they touch."""
    rows = scored.withColumns({"_y": rename_label(), "_r": F.col("posterior") > threshold})
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_eligible"),
        F.count_if("_y").alias("n_runner_up_correct"),
        F.count_if("_r").alias("renames"),
        F.avg(F.when(F.col("_r"), F.col("_y").cast("int"))).alias("rename_precision"),
        F.count_if(F.col("_r") & F.col("matched")).alias("renames_of_matched"),
        F.count_if(F.col("_r") & F.col("_y") & ~F.col("matched")).alias("false_positives_caught"),
    )
    score = auc(rows, "posterior", "_y").select(F.col("auc").alias("out_of_fold_auc"))
    parts = counts.unionByName(score, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def rename_decisions(regions: DataFrame, renamer: Renamer, *, out_of_fold: bool = False, threshold: float = 0.5,
                     floor: int = MIN_CELLS) -> DataFrame:
    """Regions to rename with their new value, for ``apply_rename``."""
    rows = eligible(with_derived(regions), floor=floor).withColumn("entity_id", entity_of("case_id"))
    table, _ = rename_features(rows, renamer.runner_ups)
    if out_of_fold:
        scored = route_models(table, renamer.folds, renamer.fold_models, renamer.model, by="entity_id")
    else:
        scored = table.withColumn("posterior", posterior_expr(renamer.model))
    return scored.where(F.col("posterior") > threshold).select(
        "case_id", "class_value", "comp_id", F.col("runner_up_value").cast("int").alias("new_value")
    )


def optimism(regions: DataFrame, refs: DataFrame, in_sample: DataFrame, held_out: DataFrame, p_star: float,
             n_cases: int, *, floor: int = MIN_CELLS) -> DataFrame:
    """Detection at ``p_star`` with in-sample and with out-of-fold posteriors, and without a filter."""
    key = ["case_id", "class_name", "comp_id"]
    out = None
    for label, source in (("in_sample", in_sample), ("out_of_fold", held_out)):
        full = regions.join(source.select(*key, F.col("posterior").alias("_p")), key, "left").withColumn(
            "_p", F.coalesce("_p", F.lit(1.0))
        )
        for stage, at in (("before", 0.0), (label, p_star)):
            if stage == "before" and out is not None:
                continue
            curve = detection_curve(full, refs, n_cases, [at], probability="_p", floor=floor)
            rows = curve.withColumn("stage", F.lit(stage))
            out = rows if out is None else out.unionByName(rows)
    return out.select("stage", "sensitivity", "fp_per_case", "n_detected", "n_fp")


@dataclass(frozen=True)
class Selector:
    model: Model
    p_star: float
    stakes: DataFrame
    calibration: DataFrame
    validation: DataFrame


def diagnose(regions: DataFrame, names: Sequence[str] = DIAGNOSTIC_FEATURES, *, floor: int = MIN_CELLS) -> DataFrame:
    """AUC table of the decidable regions; a variance column without values is left out."""
    rows = decidable(with_derived(regions), floor=floor)
    return feature_aucs(rows, _usable(rows, names))


def _usable(rows: DataFrame, names: Sequence[str]) -> list[str]:
    chosen = available(rows, names)
    optional = [n for n in chosen if n in ("mc_mean_var", "log_mc_var")]
    if optional and rows.where(finite("mc_mean_var").isNotNull()).isEmpty():
        chosen = [n for n in chosen if n not in optional]
    return chosen


def fit_job(regions: DataFrame, refs: DataFrame, names: Sequence[str] = FIT_FEATURES, *, seed: int = 0, k: int = 5,
            floor: int = MIN_CELLS) -> Selector:
    """Fit on the decidable regions, derive the threshold, calibrate and check for optimism."""
    table = cut(with_derived(regions))
    rows = decidable(table, floor=floor)
    chosen = _usable(rows, names)
    stakes = cut(estimate_stakes(rows, refs))
    p_star = round(stakes.where("class_name is null").first().p_star, 4)
    model = fit_selector(rows, chosen)
    held_out = cut(out_of_fold(rows, chosen, k=k, seed=seed))
    calibration = None
    for name, column in (("raw", "mean_prob"), ("fitted", "posterior")):
        ece = calibration_error(reliability(held_out, column, "matched")).select(F.lit(name).alias("source"), "ece")
        part = ece.join(auc(held_out, column, "matched").select(F.lit(name).alias("source"), "auc"), "source")
        calibration = part if calibration is None else calibration.unionByName(part)
    n_cases = table.select("case_id").distinct().count()
    validation = optimism(table, refs, with_posterior(rows, model), held_out, p_star, n_cases, floor=floor)
    return Selector(model, p_star, stakes, calibration, validation)
