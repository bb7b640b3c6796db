import numpy as np
import pytest

from cellmosaic.functions.exprs import default_targets
from cellmosaic.operators.filters import match_classes
from cellmosaic.operators.matching import score_cases
from tests.conftest import box, cell_table, flood, mask, volume_cells


def scores(spark, pred, ref, targets=None, **options):
    cases = spark.createDataFrame([("a",)], "case_id string")
    rows = score_cases(pred, ref, cases, targets or {"x": (1,)}, **options).collect()
    return {r.target: r for r in rows}


def test_empty_against_empty_is_one(spark):
    none = cell_table(spark, [])
    row = scores(spark, none, none)["x"]
    assert (row.dice, row.lesion_dice, row.present) == (1.0, 1.0, False)


def test_invented_region_scores_zero(spark):
    row = scores(spark, mask(spark, [(1, box((2, 4)))]), cell_table(spark, []), min_cells=1)["x"]
    assert (row.dice, row.lesion_dice, row.lesions_false) == (0.0, 0.0, 1)


def test_composites_leave_out_the_cavity(spark):
    slabs = {v: box((2 * v - 2, 2 * v), (0, 10), (0, 10)) for v in (1, 2, 3, 4)}
    ref = mask(spark, list(slabs.items()))
    perfect = scores(spark, ref, ref, default_targets())
    assert set(perfect) == {"NETC", "SNFH", "ET", "RC", "TC", "WT"}
    assert all(r.dice == 1.0 and r.lesion_dice == 1.0 for r in perfect.values())
    wrong = mask(spark, [(v if v < 4 else 3, cells) for v, cells in slabs.items()])
    got = scores(spark, wrong, ref, default_targets())
    assert got["RC"].dice == 0.0 and got["WT"].dice < 1.0


def test_missed_region_costs_a_full_zero(spark):
    ref = mask(spark, [(1, box((2, 12)) + box((30, 36)))])
    row = scores(spark, mask(spark, [(1, box((2, 12)))]), ref)["x"]
    assert row.dice > 0.8 and row.lesion_dice <= 0.55 and row.lesions_missed == 1


def test_spurious_region_costs_a_full_zero(spark):
    pred = mask(spark, [(1, box((2, 12)) + box((30, 36)))])
    row = scores(spark, pred, mask(spark, [(1, box((2, 12)))]))["x"]
    assert row.lesions_false == 1 and row.lesion_dice < 0.6


def test_fragments_are_scored_as_their_union(spark):
    ref = box((5, 15))
    pred = [c for c in ref if 5 <= c[0] < 10 or 12 <= c[0] < 15]
    _, _, m = match_classes(mask(spark, [(1, pred)]), mask(spark, [(1, ref)]))
    comps, refs = m.comps.collect(), m.refs.collect()
    assert len(comps) == 2 and all(c.matched and c.matched_ref_ids == [1] for c in comps)
    assert len(refs) == 1 and refs[0].matched_comp_ids == [1, 2]
    assert refs[0].dice == pytest.approx(2 * len(pred) / (len(pred) + len(ref)))


def test_small_reference_cannot_rescue(spark):
    ref = mask(spark, [(1, box((2, 12)) + box((25, 27)))])
    pred = mask(spark, [(1, box((2, 12)) + box((24, 28)))])
    _, _, m = match_classes(pred, ref)
    small = [c for c in m.comps.collect() if c.n_cells == 64][0]
    assert not small.matched and small.false_positive


def test_small_prediction_is_not_charged(spark):
    pred = mask(spark, [(1, box((2, 12)) + box((25, 28)))])
    _, _, m = match_classes(pred, mask(spark, [(1, box((2, 12)))]))
    small = [c for c in m.comps.collect() if c.n_cells == 27][0]
    assert not small.matched and not small.false_positive


@pytest.mark.parametrize("floor", [1, 10, 50])
def test_scores_equal_a_direct_count(spark, floor):
    rng = np.random.default_rng(floor)
    pred, ref = {}, {}
    for n in range(3):
        blobs = [np.zeros((16, 16, 16), bool) for _ in range(2)]
        for b in blobs:
            for _ in range(5):
                at, size = rng.integers(0, 12, 3), rng.integers(1, 6, 3)
                b[tuple(slice(a, a + s) for a, s in zip(at, size))] = True
        pred[f"c{n}"], ref[f"c{n}"] = blobs
    cases = spark.createDataFrame([(c,) for c in pred], "case_id string")
    got = score_cases(
        volume_cells(spark, pred), volume_cells(spark, ref), cases, {"x": (1,)}, min_cells=floor, tile=8
    ).collect()
    for row in got:
        p, r = flood(pred[row.case_id]), flood(ref[row.case_id])
        scored = [i for i in range(1, r.max() + 1) if (r == i).sum() >= floor]
        entries, missed = [], 0
        for i in scored:
            hits = set(p[r == i]) - {0}
            union = np.isin(p, list(hits)) if hits else np.zeros_like(p, bool)
            entries.append(2 * (union & (r == i)).sum() / (union.sum() + (r == i).sum()))
            missed += not hits
        false = sum(
            1 for j in range(1, p.max() + 1)
            if (p == j).sum() >= floor and not set(r[p == j]) & set(scored)
        )
        want = np.mean(entries + [0.0] * false) if entries or false else 1.0
        assert row.lesion_dice == pytest.approx(want, abs=1e-12)
        assert (row.lesions_missed, row.lesions_false) == (missed, false)
