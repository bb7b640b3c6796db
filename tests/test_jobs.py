import pytest
from pyspark.sql import functions as F

from cellmosaic.operators.geometry import make_grid
from cellmosaic.operators.groups import split_cases
from cellmosaic.operators.modelling import Model, available, fit_job
from cellmosaic.operators.regions import image_feature_names
from cellmosaic.plans.jobs import apply_job
from cellmosaic.sources import tables
from cellmosaic.sources.ledger import AlreadyAppliedError
from tests.conftest import box, cell_table

NAMES = {1: "NETC", 2: "SNFH"}
TARGETS = {"NETC": (1,), "SNFH": (2,), "ALL": (1, 2)}


@pytest.fixture(scope="module")
def scene(spark):
    """Two cases: a large confident region each, plus a faint invented one in the first."""
    large, extra = box((2, 8)), box((12, 16))
    pred = cell_table(spark, [("a", c, 1) for c in large + extra] + [("b", c, 2) for c in large])
    ref = cell_table(spark, [("a", c, 1) for c in large] + [("b", c, 2) for c in large])
    p = [("a", *c, [0.1, 0.9, 0.0]) for c in large] + [("a", *c, [0.4, 0.55, 0.05]) for c in extra]
    p += [("b", *c, [0.1, 0.0, 0.9]) for c in large]
    probs = spark.createDataFrame(p, "case_id string, i int, j int, k int, p array<double>")
    return pred, ref, probs, make_grid(pred, (20, 20, 20))


# A model that looks at the mean probability alone: 0.55 gives 0.18, 0.9 gives 0.88.
MODEL = Model(["mean_prob"], ["NETC", "SNFH"], ["mean_prob", "is_SNFH"], {"mean_prob": 0.5}, [0.7, 0.0], [1.0, 1.0], [10.0, 0.0], 0.0)


def test_apply_job_scores_once_and_removes_the_invented_region(spark, scene, tmp_path):
    path = str(tmp_path / "ledger")

    def run(**options):
        return apply_job(
            *scene, MODEL, 0.5, TARGETS, 20, ledger=path, run="r", split="test", class_names=NAMES, **options
        )

    out = run()
    assert out.decisions.where("not keep").count() == 1
    summary = {(r.variant, r.target): r for r in out.summary.collect()}
    assert summary[("none", "NETC")].lesion == pytest.approx(0.5) and summary[("none", "NETC")].false_lesions == 1
    assert summary[("size", "NETC")].lesion == pytest.approx(0.5)
    assert summary[("selector", "NETC")].lesion == 1.0 and summary[("selector", "NETC")].false_lesions == 0
    stages = {(r.scope, r.stage): (r.n_detected, r.n_fp) for r in out.detection.collect()}
    assert stages[("all", "before")] == (2, 1) and stages[("all", "after")] == (2, 0)
    assert {r.n_deleted for r in out.tradeoff.collect()} == {0}
    assert out.curve.count() == 101
    with pytest.raises(AlreadyAppliedError):
        run()
    assert run(force=True).decisions.count() == 3


def test_fit_job_derives_the_threshold(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(6)
    regions, refs = [], []
    for n in range(160):
        real = bool(rng.random() < 0.6)
        prob = float(np.clip(rng.normal(0.75 if real else 0.45, 0.12), 0.01, 0.99))
        regions.append((f"c{n // 8}", ("x", "y")[n % 2], n, int(40 + rng.integers(400)), real, 0.6 if real else 0.0, 1 + n % 4,
                        prob, prob, prob, prob / 2, float(rng.random() * 30), 1 + n % 3, 4))
        if real:
            refs.append((f"c{n // 8}", ("x", "y")[n % 2], n, 100, True, 0.6, 5.0, [n]))
    table = spark.createDataFrame(regions, "case_id string, class_name string, comp_id int, n_cells long, matched boolean, "
                                           "dice_with_matched double, rank_by_volume int, mean_prob double, p90_prob double, "
                                           "max_prob double, mean_border_prob double, dist_to_dominant_mm double, rank_by_prob int, "
                                           "n_comps_in_class int").withColumn("mc_mean_var", F.lit(None).cast("double"))
    ref_table = spark.createDataFrame(refs, "case_id string, class_name string, ref_id int, n_cells long, detected boolean, "
                                            "dice double, dist_to_dominant_mm double, matched_comp_ids array<int>")
    out = fit_job(table, ref_table)
    assert out.p_star == 0.5 and "log_mc_var" not in out.model.features
    cal = {r.source: r for r in out.calibration.collect()}
    assert cal["fitted"].auc > 0.85 and cal["fitted"].ece < cal["raw"].ece
    stages = {r.stage: r for r in out.validation.collect()}
    assert set(stages) == {"before", "in_sample", "out_of_fold"}
    assert stages["before"].sensitivity == 1.0 and stages["out_of_fold"].n_fp < stages["before"].n_fp
    tables.save_selector(spark, out, f"{tmp_path}/selector")
    again = tables.load_selector(spark, f"{tmp_path}/selector")
    assert (again.model, again.p_star) == (out.model, out.p_star)
    for name in ("stakes", "calibration", "validation"):
        assert sorted(map(repr, getattr(again, name).collect())) == sorted(map(repr, getattr(out, name).collect()))


def test_small_helpers(spark):
    assert image_feature_names(["t1c"]) == [
        "z_t1c_mean", "z_t1c_contrast", "z_t1c_mirror", "dist_to_brain_edge_mm", "frac_outside_brain", "n_voxels_check",
    ]
    assert {"enhancement", "flair_minus_t2"} <= set(image_feature_names(["t1c", "t1n", "t2f", "t2w"]))
    df = spark.createDataFrame([(1, 2.0)], "n_cells long, mean_prob double")
    assert available(df, ["log_n_voxels", "mean_prob", "log1p_edge"]) == ["log_n_voxels", "mean_prob"]
    cases = spark.createDataFrame(
        [("a", {"t2": "/2", "t1": "/1"}, "/l"), ("b", {"t1": "/1"}, None)], "case_id string, images map<string,string>, label string"
    )
    splits = spark.createDataFrame([("a", "val"), ("b", "train")], "case_id string, split string")
    assert split_cases(cases, splits, "val").first() == (["/1", "/2"], "/l", "a")
