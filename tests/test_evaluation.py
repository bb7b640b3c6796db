import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.operators import evaluation as ev, modelling as ml


def test_auc_counts_ties_half_and_drops_what_is_not_finite(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 8, 300) / 8, rng.random(300) < 0.4
    rows = [(float(a), bool(b)) for a, b in zip(s, y)] + [(float("nan"), True), (float("inf"), False)]
    got = ev.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()
    pos, neg = s[y], s[~y]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (pos.size * neg.size)
    assert got.auc == pytest.approx(want) and (got.n_pos, got.n_neg) == (pos.size, neg.size)


def test_auc_of_one_class_is_null(spark):
    rows = spark.createDataFrame([(0.1, True), (0.2, True)], "s double, y boolean")
    assert ev.auc(rows, "s", "y").first().auc is None


def test_reliability_bins_follow_the_edges(spark):
    p = np.repeat(np.linspace(0, 1, 11), 6)
    rows = spark.createDataFrame([(float(v), bool(v > 0.5)) for v in p], "p double, y boolean")
    got = {r.bin: r.n for r in ev.reliability(rows, "p", "y").collect()}
    idx = np.clip(np.digitize(p, np.linspace(0, 1, 11)[1:-1]), 0, 9)
    assert got == {int(b): int((idx == b).sum()) for b in set(idx)}


def detection_tables(spark):
    regions = spark.createDataFrame([
        ("a", "x", 1, 100, True, 0.9), ("a", "x", 2, 80, False, 0.6), ("a", "x", 3, 20, True, 0.0),
        ("b", "x", 1, 70, True, 0.3), ("b", "x", 2, 10, False, 0.9),
    ], "case_id string, class_name string, comp_id int, n_cells long, matched boolean, posterior double")
    refs = spark.createDataFrame([
        ("a", "x", 1, True, 0.8, 5.0, [1]), ("a", "x", 2, True, 0.5, 30.0, [3]), ("b", "x", 1, True, 0.4, 50.0, [1]),
        ("b", "x", 2, False, 0.0, 60.0, []),
    ], "case_id string, class_name string, ref_id int, detected boolean, dice double, dist_to_dominant_mm double, matched_comp_ids array<int>")
    return regions, refs


def test_detection_curve(spark):
    regions, refs = detection_tables(spark)
    got = {r.threshold: (r.n_detected, r.n_fp, r.sensitivity) for r in ev.detection_curve(regions, refs, 2, [0.0, 0.5, 0.95]).collect()}
    assert got == {0.0: (3, 1, 0.75), 0.5: (2, 1, 0.5), 0.95: (1, 0, 0.25)}


def test_distance_tradeoff(spark):
    regions, refs = detection_tables(spark)
    decided = regions.withColumn("keep", (F.col("n_cells") < 50) | (F.col("posterior") >= 0.5))
    schema = "case_id string, target string, lesion_dice double, present boolean"
    before = spark.createDataFrame([("a", "x", 0.5, True), ("b", "x", 0.4, True), ("c", "x", 0.2, True)], schema)
    after = spark.createDataFrame([("a", "x", 0.6, True), ("b", "x", 0.1, True), ("c", "x", 0.3, True)], schema)
    got = {r.band: r for r in ev.distance_tradeoff(refs, decided, before, after).collect()}
    assert (got[40.0].n_beyond, got[40.0].n_cases_with_one, got[40.0].n_deleted, got[40.0].n_cases_hurt) == (2, 1, 1, 1)
    assert got[40.0].delta_on_those == pytest.approx(-0.3) and got[40.0].delta_on_rest == pytest.approx(0.1)
    assert got[20.0].n_beyond == 3 and got[10.0].delta_on_rest == pytest.approx(0.1)


def test_stakes_fall_back_to_all_matched(spark):
    regions = spark.createDataFrame(
        [("x", True, 1, 0.8), ("x", False, 2, 0.0)], "class_name string, matched boolean, rank_by_volume int, dice_with_matched double"
    )
    refs = spark.createDataFrame([("x", 0.8), ("x", 0.4)], "class_name string, dice double")
    rows = ev.estimate_stakes(regions, refs).collect()
    assert len(rows) == 1 and rows[0].class_name is None
    assert rows[0].d_value == pytest.approx(0.8) and rows[0].p_star == pytest.approx(0.6 / 1.4)


def test_published_sweep_choices(spark):
    # Region scores of a published size sweep; the first best threshold wins.
    grid = ev.SIZE_GRID
    table = {"x": [0.1, 0.3, 0.3, 0.2, 0.1, 0.0, 0.0, 0.0], "TC": [1.0] * 8}
    rows = [(t, g, v) for t, values in table.items() for g, v in zip(grid, values)]
    out = ev.best_thresholds(spark.createDataFrame(rows, "target string, threshold int, lesion double"), ["x"]).collect()
    assert [(r.target, r.threshold) for r in out] == [("x", 25)]


def test_concentration(spark):
    false = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "case_id string, n long")
    missed = spark.createDataFrame([("b", 1), ("z", 2)], "case_id string, n long")
    r = ev.concentration(false, missed, 10).first()
    assert (r.cases_without_false, r.cases_with_missed, r.cases_with_both) == (7, 2, 1)
    assert (r.worst_10pct, r.worst_20pct, r.worst_50pct) == pytest.approx((0.6, 0.9, 1.0))


def logistic_optimum(x, y, c=1.0):
    """Newton iterations on the same penalised likelihood, intercept free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.eye(a.shape[1]) / c
    ridge[-1, -1] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
    return w


def selector_rows(n=300):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        real = bool(rng.random() < 0.6)
        rows.append((
            f"c{i % 40}", ("x", "y")[i % 2], i, int(50 + rng.integers(900)), float(np.clip(rng.normal(0.7 if real else 0.5, 0.15), 0, 1)),
            None if i % 11 == 0 else float(rng.random() * 40), real,
        ))
    return rows


def test_selector_reaches_the_optimum(spark):
    rows = selector_rows()
    df = ml.with_derived(spark.createDataFrame(
        rows, "case_id string, class_name string, comp_id int, n_cells long, mean_prob double, dist_to_dominant_mm double, matched boolean"
    ))
    names = ["log_n_voxels", "mean_prob", "log1p_dist"]
    model = ml.fit_selector(df, names)
    d = np.array([np.nan if r[5] is None else np.log1p(r[5]) for r in rows])
    d = np.where(np.isnan(d), np.nanmedian(d), d)
    x = np.column_stack([[np.log(r[3]) for r in rows], [r[4] for r in rows], d, [r[1] == "y" for r in rows]]).astype(float)
    z = (x - x.mean(0)) / x.std(0)
    want = logistic_optimum(z, np.array([r[6] for r in rows], float))
    assert np.allclose([*model.coef, model.intercept], want, atol=1e-5)
    p = [r.posterior for r in ml.with_posterior(df, model).orderBy("comp_id").collect()]
    assert np.allclose(p, 1 / (1 + np.exp(-(z @ want[:-1] + want[-1]))), atol=1e-5)


def test_all_missing_feature_is_refused(spark):
    df = spark.createDataFrame([("c", "x", None, True)], "case_id string, class_name string, mean_prob double, matched boolean")
    with pytest.raises(ValueError, match="missing for every region"):
        ml.fit_selector(df, ["mean_prob"])


def test_join_features_checks_counts_and_keys(spark):
    regions = spark.createDataFrame([("a", "x", 1, 9)], "case_id string, class_name string, comp_id int, n_cells long")
    extra = spark.createDataFrame([("a", "x", 1, 9, 0.5)], "case_id string, class_name string, comp_id int, n_voxels_check long, z double")
    assert ml.join_features(regions, extra).first().z == 0.5
    with pytest.raises(Exception, match="image features disagree"):
        ml.join_features(regions, extra.withColumn("n_voxels_check", F.lit(8).cast("long"))).collect()
    with pytest.raises(Exception, match="no image features"):
        ml.join_features(regions, extra.where("false")).collect()
