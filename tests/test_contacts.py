"""The contact graph beside masks that are edited and labelled again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.operators import contacts as ct, evaluation as ev, filters as fl, matching as mt
from cellmosaic.plans.jobs import attribute_errors
from tests.conftest import CELLS, flood, volume_cells

TARGETS = {"A": (1,), "B": (2,), "C": (3,), "AC": (1, 3), "all": (1, 2, 3)}
KEYS = ["case_id", "class_value", "comp_id"]


def volumes(seed, n=3, edge=10, empty=True):
    rng = np.random.default_rng(seed)
    out = {}
    for c in range(n):
        coarse = rng.integers(0, 4, (edge // 2,) * 3) * (rng.random((edge // 2,) * 3) < 0.7)
        fine = coarse.repeat(2, 0).repeat(2, 1).repeat(2, 2)
        noise = rng.random(fine.shape)
        out[f"c{c}"] = np.where(noise < 0.25, 0, np.where(noise < 0.3, rng.integers(1, 4, fine.shape), fine))
    if empty:
        out["none"] = np.zeros((edge,) * 3, int)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == pytest.approx(q, abs=1e-12) if isinstance(p, float) else p == q for p, q in zip(x, y)), (x, y)


@pytest.fixture(scope="module")
def masks(spark):
    pred, ref = volume_cells(spark, volumes(1)), volume_cells(spark, volumes(2))
    return pred.cache(), ref.cache(), spark.createDataFrame([(c,) for c in ("c0", "c1", "c2", "none", "absent")], "case_id string")


@pytest.mark.parametrize("tile", [2, 3, 32])
def test_graph_against_flood_fill(spark, tile):
    pred, ref = volumes(5, 2, empty=False), volumes(6, 2, empty=False)
    graph = ct.contact_graph(volume_cells(spark, pred), volume_cells(spark, ref), tile=tile)
    nodes, contacts, shared = set(), set(), {}
    names = {}
    for side, masks in ((0, pred), (1, ref)):
        for case, v in masks.items():
            label = np.zeros(v.shape, object)
            for value in (1, 2, 3):
                lab = flood(v == value)
                for n in range(1, lab.max() + 1):
                    i, j, k = np.argwhere(lab == n)[0]
                    node = (int(i) << 42) | (int(j) << 21) | int(k)
                    label[lab == n] = node + 1
                    nodes.add((side, case, value, node, int((lab == n).sum())))
            names[side, case] = label
            for axis in range(3):
                a, b = np.moveaxis(label, axis, 0)[:-1], np.moveaxis(label, axis, 0)[1:]
                contacts |= {(side, case, min(x, y) - 1, max(x, y) - 1) for x, y in zip(a.ravel(), b.ravel()) if x and y and x != y}
    for case in pred:
        for x, y in zip(names[0, case].ravel(), names[1, case].ravel()):
            if x and y:
                shared[case, x - 1, y - 1] = shared.get((case, x - 1, y - 1), 0) + 1
    assert {tuple(r) for r in graph.nodes.select("side", "case_id", "value", "node", "n_cells").collect()} == nodes
    assert [tuple(r) for r in graph.contacts.select("side", "case_id", "a", "b").collect()].__len__() == len(contacts)
    assert {tuple(r) for r in graph.contacts.select("side", "case_id", "a", "b").collect()} == contacts
    assert {tuple(r)[:3]: r.shared for r in graph.shared.select("case_id", "pred_node", "ref_node", "shared").collect()} == shared


def test_sweep_equals_relabelled_masks(masks):
    pred, ref, cases = masks
    grid = (3, 10_000)
    got = ev.sweep_sizes(pred, ref, cases, TARGETS, grid, min_cells=4, tile=3).cache()
    columns = ["case_id", "target", "dice", "lesion_dice", "lesions_missed", "lesions_false", "present"]
    for t in grid:
        want = mt.score_cases(fl.drop_small(pred, t), ref, cases, TARGETS, min_cells=4)
        close(rows(got.where(F.col("threshold") == t).select(*columns)), rows(want.select(*columns)))


def test_variants_and_oracles_equal_relabelled_masks(masks):
    pred, ref, cases = masks
    pred_lab, ref_lab, matching = fl.match_classes(pred, ref, min_cells=4)
    decisions = matching.comps.select(*KEYS, "n_cells", ((F.col("comp_id") + F.col("n_cells")) % 3 != 0).alias("keep"))
    columns = ["case_id", "target", "dice", "lesion_dice", "lesions_missed", "lesions_false", "present"]
    got = ev.compare_variants(pred, ref, cases, TARGETS, {1: 5, 2: 9}, decisions, min_cells=4).cache()
    for name, mask in (("size", fl.drop_small(pred, {1: 5, 2: 9})), ("selector", fl.apply_decisions(pred, decisions))):
        want = mt.score_cases(mask, ref, cases, TARGETS, min_cells=4)
        close(rows(got.where(F.col("variant") == name).select(*columns)), rows(want.select(*columns)))
    out = attribute_errors(pred, ref, cases, TARGETS, min_cells=4)
    origin = fl.false_positive_origin(pred_lab, ref, matching)
    close(rows(out["false"].select(*KEYS, "n_cells", "covered_frac", "covered_by")), rows(origin.select(*KEYS, "n_cells", "covered_frac", "covered_by")))
    lost = fl.missed_origin(ref_lab, pred, matching)
    close(rows(out["missed"].select(*KEYS, "n_cells", "covered_frac", "covered_by")), rows(lost.select(*KEYS, "n_cells", "covered_frac", "covered_by")))
    edited = fl.oracle_masks(pred, pred_lab, origin)
    for name in ("relabel", "both"):
        want = mt.score_cases(edited.where(F.col("variant") == name), ref, cases, TARGETS, min_cells=4)
        close(rows(out["scores"].where(F.col("variant") == name).select(*columns)), rows(want.select(*columns)))


def test_recorded_size_that_differs_is_an_error(masks):
    pred, ref, cases = masks
    wrong = fl.match_classes(pred, ref)[2].comps.select(*KEYS, (F.col("n_cells") + 1).alias("n_cells"), F.lit(True).alias("keep"))
    with pytest.raises(Exception, match="component mismatch"):
        ev.compare_variants(pred, ref, cases, TARGETS, 5, wrong).collect()


def test_repeated_cells_count_once_and_two_values_are_refused(spark, masks):
    ref = masks[1]
    once = spark.createDataFrame([("c0", 1, 1, 1, 2)], CELLS)
    assert ct.contact_graph(once.unionByName(once), ref).side(ct.PRED)[0].first().n_cells == 1
    with pytest.raises(Exception, match="more than one value"):
        ct.contact_graph(once.unionByName(once.withColumn("value", F.lit(3))), ref).nodes.collect()


def test_long_chains_over_many_blocks(spark):
    n = 2_000
    edges = spark.createDataFrame([("a", (x << 42), ((x + 1) << 42)) for x in range(n)], "case_id string, a long, b long").repartition(7)
    got = ct.components(edges, ["case_id"]).collect()
    assert {(r.node >> 42, r.root) for r in got} == {(x, 0) for x in range(n + 1)} and len(got) == n + 1


def test_half_of_all_cells_in_one_case_is_many_tasks(spark):
    """The rows of a tile, the unit that goes to a task, do not grow with a case."""
    big = {"giant": np.ones((40, 40, 40), int)}
    small = {f"s{n}": np.ones((8, 8, 8), int) for n in range(60)}
    cells = volume_cells(spark, {**big, **small})
    keyed = cells.groupBy("case_id", *[F.floor(F.col(c) / 8).alias(f"t{c}") for c in "ijk"]).count()
    top, middle = keyed.agg(F.max("count"), F.percentile_approx("count", 0.5)).first()
    assert top <= 3 * middle
    graph = ct.contact_graph(cells, cells, tile=8)
    assert {(r.case_id, r.n_cells) for r in graph.side(ct.PRED)[0].collect()} == {("giant", 64_000)} | {(f"s{n}", 512) for n in range(60)}
    assert graph.shared.count() == 61


SCORES = ["case_id", "target", "dice", "lesion_dice", "lesions_missed", "lesions_false", "present"]


@pytest.fixture(scope="module")
def mixed(spark):
    """Small cases that one tile of 8 holds without touching its far faces, beside one over many tiles."""
    def made(seed):
        return {**volumes(seed, 3, edge=6), **{"big" + c: v for c, v in volumes(seed + 10, 1, edge=14, empty=False).items()}}
    cases = spark.createDataFrame([(c,) for c in ("c0", "c1", "c2", "bigc0", "none", "absent")], "case_id string")
    return volume_cells(spark, made(1)).cache(), volume_cells(spark, made(2)).cache(), cases


def _decided(regions):
    return regions.withColumn("keep", (F.col("comp_id") + F.col("n_cells")) % 3 != 0)


def test_compare_variants_of_closed_and_open_tiles(mixed):
    got = [rows(ev.compare_variants(*mixed, TARGETS, {1: 5, 2: 9}, _decided, min_cells=4, tile=t).select("variant", *SCORES)) for t in (32, 8, 3)]
    assert len(got[0]) == 6 * 5 * 3
    close(got[0], got[1])
    close(got[0], got[2])
    labelled = _decided(fl.match_classes(*mixed[:2], min_cells=4)[2].comps.select(*KEYS, "n_cells"))
    close(got[0], rows(ev.compare_variants(*mixed, TARGETS, {1: 5, 2: 9}, labelled, min_cells=4, tile=8).select("variant", *SCORES)))


def test_oracle_masks_of_closed_and_open_tiles(mixed):
    want = rows(attribute_errors(*mixed, TARGETS, min_cells=4)["scores"].select("variant", *SCORES))
    for t in (32, 8, 3):
        close(rows(ev.score_oracle_masks(*mixed, TARGETS, min_cells=4, tile=t).select("variant", *SCORES)), want)


def test_sweep_of_closed_and_open_tiles(mixed):
    got = [rows(ev.sweep_sizes(*mixed, TARGETS, (0, 3, 6, 10_000), min_cells=4, tile=t).select("threshold", *SCORES)) for t in (32, 8, 3)]
    close(got[0], got[1])
    close(got[0], got[2])


def test_scores_leave_closed_tiles_as_sums(mixed):
    pred, ref, cases = mixed
    wanted = list(TARGETS.values())
    met = ct._met_tiles(pred, ref, 32, ct._as_they_are, wanted, 4)
    assert met.where(F.col("kind") != ct.SCORE).isEmpty() and met.count() <= 4 * len(TARGETS)
    # The general way, with a key more, labels the masks of the targets cell by cell.
    more = [d.withColumn("run", F.lit("x")) for d in mixed]
    want = rows(mt.score_cases(*more, TARGETS, min_cells=4, keys=["run", "case_id"]).select(*SCORES))
    for t in (32, 8, 3):
        close(rows(mt.score_cases(*mixed, TARGETS, min_cells=4, tile=t).select(*SCORES)), want)
