import pytest
from pyspark.sql import functions as F

from cellmosaic.functions.exprs import break_even
from cellmosaic.operators import filters as fl
from tests.conftest import box, cell_table, mask


def size(df):
    return {r.value: r.n for r in df.groupBy("value").agg(F.count(F.lit(1)).alias("n")).collect()}


@pytest.fixture(scope="module")
def blobs(spark):
    return mask(spark, [(2, box((2, 12)) + box((20, 26)) + box((35, 38)))])


@pytest.fixture(scope="module")
def regions(spark):
    rows = [("a", 2, 1, 1000, 0.9), ("a", 2, 2, 216, 0.4), ("a", 2, 3, 27, 0.1)]
    return spark.createDataFrame(rows, "case_id string, class_value int, comp_id int, n_cells long, posterior double")


def test_threshold_zero_keeps_everything(spark, blobs, regions):
    assert size(fl.apply_decisions(blobs, fl.keep_decisions(regions, 0.0))) == {2: 1243}


def test_threshold_above_one_keeps_only_what_is_below_the_floor(spark, blobs, regions):
    assert size(fl.apply_decisions(blobs, fl.keep_decisions(regions, 1.0001))) == {2: 27}


def test_unknown_regions_are_kept(spark, blobs, regions):
    known = fl.keep_decisions(regions, 0.5).where("comp_id = 2")
    assert size(fl.apply_decisions(blobs, known)) == {2: 1027}


def test_other_size_is_refused(spark, blobs, regions):
    wrong = fl.keep_decisions(regions, 0.5).withColumn("n_cells", F.lit(999).cast("long"))
    with pytest.raises(Exception, match="component mismatch"):
        fl.apply_decisions(blobs, wrong).collect()


def test_break_even_values(spark):
    row = spark.range(1).select(
        break_even(F.lit(0.7), F.lit(0.7)), break_even(F.lit(0.72), F.lit(0.70)), break_even(F.lit(0.6191), F.lit(0.4915))
    ).first()
    assert row[0] == pytest.approx(0.5) and row[1] == pytest.approx(0.5070, abs=1e-4)
    assert row[2] == pytest.approx(0.5574, abs=1e-4)


@pytest.mark.parametrize("thresholds, want", [
    (0, {2: 1125, 1: 216}), ({}, {2: 1125, 1: 216}), ({2: 500}, {2: 1000, 1: 216}), (500, {2: 1000}),
])
def test_drop_small(spark, thresholds, want):
    pred = mask(spark, [(2, box((2, 12)) + box((20, 25))), (1, box((2, 8), (20, 26), (2, 8)))])
    out = fl.drop_small(pred, thresholds)
    assert size(out) == want
    assert out.join(pred, ["case_id", "i", "j", "k", "value"], "left_anti").isEmpty()


def test_rename_decides_on_the_original_mask(spark):
    pred = mask(spark, [(1, box((2, 8))), (2, box((14, 20)))])
    rows = [("a", 1, 1, 2), ("a", 2, 1, 1)]
    decisions = spark.createDataFrame(rows, "case_id string, class_value int, comp_id int, new_value int")
    out = {(r.i, r.j, r.k): r.value for r in fl.apply_rename(pred, decisions).collect()}
    assert out[(2, 2, 2)] == 2 and out[(14, 14, 14)] == 1


def probabilities(spark, parts, case="a"):
    rows = {}
    for p, cells in parts:
        for c in cells:
            rows[c] = p
    return spark.createDataFrame(
        [(case, *c, [1.0 - p, p]) for c, p in rows.items()], "case_id string, i int, j int, k int, p array<double>"
    )


def test_fill_takes_the_half_maximum_region_of_the_peak(spark):
    parts = [(0.30, box((4, 7))), (0.40, [(5, 5, 5)]), (0.10, box((14, 16)))]
    out = fl.fill_empty(cell_table(spark, []), probabilities(spark, parts)).collect()
    assert len(out) == 27 and {r.value for r in out} == {1}


def test_fill_stays_with_the_peak(spark):
    parts = [(0.40, box((2, 4))), (0.35, box((15, 17)))]
    out = fl.fill_empty(cell_table(spark, []), probabilities(spark, parts)).collect()
    assert {(r.i, r.j, r.k) for r in out} == set(box((2, 4)))


def test_fill_leaves_other_cases_alone(spark):
    pred = mask(spark, [(1, [(0, 0, 0)])])
    assert fl.fill_empty(pred, probabilities(spark, [(0.9, box((4, 7)))])).count() == 1


def test_oracle_masks(spark):
    pred = mask(spark, [(1, box((0, 4)) + box((8, 12)) + box((16, 20)))])
    ref = mask(spark, [(1, box((0, 4))), (2, box((8, 12)))])
    pred_lab, _, m = fl.match_classes(pred, ref)
    origin = fl.false_positive_origin(pred_lab, ref, m)
    masks = fl.oracle_masks(pred, pred_lab, origin)
    got = {(r.variant, r.value): r.n for r in masks.groupBy("variant", "value").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {
        ("none", 1): 192, ("relabel", 1): 128, ("relabel", 2): 64, ("delete", 1): 64, ("both", 1): 64, ("both", 2): 64,
    }
