import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.operators import regions as rg, volumes as vol
from cellmosaic.operators.geometry import make_grid
from cellmosaic.operators.labelling import label_regions
from cellmosaic.operators.modelling import fit_renamer, rename_decisions
from cellmosaic.operators.ranking import exact_percentiles, ranked, running_max_before
from cellmosaic.sources import tables
from tests.conftest import box, mask

NAMES = {1: "NETC", 2: "SNFH"}


def test_runner_up_and_majority(spark):
    a, b = box((2, 8)), box((14, 20))
    pred = mask(spark, [(1, a + b)])
    ref = mask(spark, [(1, a), (2, b)])
    rows = [("a", *c, [0.05, 0.90, 0.05]) for c in a] + [("a", *c, [0.06, 0.48, 0.46]) for c in b]
    probs = spark.createDataFrame(rows, "case_id string, i int, j int, k int, p array<double>")
    grid = make_grid(spark.createDataFrame([("a",)], "case_id string"), (24, 24, 24))
    regions, refs = rg.region_table(pred, ref, probs, grid, NAMES)
    got = {r.comp_id: r for r in regions.collect()}
    assert [got[n].runner_up_value for n in (1, 2)] == [2, 2]
    assert [got[n].ref_majority_value for n in (1, 2)] == [1, 2]
    assert got[1].mean_prob == pytest.approx(0.9) and got[2].runner_up_prob == pytest.approx(0.46)
    assert got[1].dist_to_dominant_mm == 0.0 and got[2].dist_to_dominant_mm == pytest.approx(7 * np.sqrt(3))
    assert got[1].mean_border_prob == 0.0 and got[1].rank_by_prob == 1 and got[2].rank_by_prob == 2
    assert got[1].matched and not got[2].matched and refs.where("detected").count() == 1


def test_dominant_region_takes_the_first_of_equals(spark):
    pred = mask(spark, [(1, box((0, 2))), (2, box((5, 7))), (4, box((10, 20)))])
    assert {(r.i, r.j, r.k) for r in rg.dominant_region(pred).collect()} == set(box((0, 2)))


def test_verdicts(spark):
    rows = [
        ("a", "x", 1, 900, True, True), ("a", "x", 2, 400, True, True), ("a", "x", 3, 100, False, False),
        ("a", "x", 4, 30, False, True), ("a", "x", 5, 10, False, True), ("b", "x", 1, 90, False, None),
    ]
    table = spark.createDataFrame(rows, "case_id string, class_name string, comp_id int, n_cells long, matched boolean, keep boolean")
    got = {(r.case_id, r.comp_id): r.verdict for r in rg.region_verdicts(table).collect()}
    assert got == {
        ("a", 1): "main", ("a", 2): "kept_real", ("a", 3): "dropped_spurious", ("a", 4): "below_floor", ("b", 1): "kept_spurious",
    }


def test_pass_variance_equals_sample_variance(spark):
    rng = np.random.default_rng(0)
    p = rng.random((6, 5))
    rows = [("a", c, 0, 0, 1, float(p[t, c])) for t in range(6) for c in range(5)]
    out = vol.pass_variance(spark.createDataFrame(rows, "case_id string, i int, j int, k int, class_value int, p double"))
    got = np.array([r.variance for r in out.orderBy("i").collect()])
    assert np.allclose(got, p.var(axis=0, ddof=1), atol=1e-9)


def test_undoing_a_flip_averages_matching_cells(spark):
    grid = make_grid(spark.createDataFrame([("a",)], "case_id string"), (4, 1, 1))
    rows = [("a", f, (3 - i) if f else i, 0, 0, 1, p) for i in range(4) for f, p in (("", i / 10), ("i", i / 10 + 0.2))]
    probs = spark.createDataFrame(rows, "case_id string, flip string, i int, j int, k int, class_value int, p double")
    out = vol.average_members(vol.undo_flips(probs, grid)).orderBy("i").collect()
    assert [r.p for r in out] == pytest.approx([i / 10 + 0.1 for i in range(4)])


def test_arrays_average_place_by_place_in_one_exchange(spark):
    rng = np.random.default_rng(3)
    p = rng.random((5, 40, 3)).round(2)
    rows = [("a", m, c, 0, 0, p[m, c].tolist()) for m in range(5) for c in range(40)]
    rows += [("b", 0, 0, 0, 0, [0.5]), ("b", 1, 0, 0, 0, [0.1, 0.6, 0.0]), ("b", 2, 0, 0, 0, None), ("c", 0, 0, 0, 0, [0.4, 0.4, 0.2])]
    probs = spark.createDataFrame(rows, "case_id string, member int, i int, j int, k int, p array<double>")
    out = vol.average_arrays(probs, 3, spread=True).withColumn("value", vol.predicted_place())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    got = {(r.case_id, r.i): r for r in out.collect()}
    assert len(got) == 42
    mean, spread = p.mean(axis=0), p.var(axis=0, ddof=1)
    for c in range(40):
        assert np.allclose(got[("a", c)].p, np.maximum(mean[c], 1e-12)) and np.allclose(got[("a", c)].variance, spread[c])
    assert got[("b", 0)].p == pytest.approx([0.3, 0.3, 1e-12]) and got[("c", 0)].value == 0 and got[("c", 0)].variance == [0, 0, 0]
    long = probs.where("case_id = 'a'").select("case_id", "i", "j", "k", F.posexplode("p").alias("class_value", "p"))
    assert {(r.i, r.value) for r in vol.predicted_class(vol.average_members(long)).collect()} == {
        (r.i, r.value) for k, r in got.items() if k[0] == "a" and r.value > 0
    }


def test_ranks_and_percentiles_with_one_hot_key(spark):
    rng = np.random.default_rng(2)
    values = [("hot", n, float(v)) for n, v in enumerate(rng.normal(size=3000).round(2))] + [("cold", 1, 5.0)]
    df = spark.createDataFrame(values, "g string, n int, v double").repartition(7)
    got = ranked(df, ["g"], [F.col("v").desc(), F.col("n")], "pos").where("g = 'hot'").collect()
    order = sorted(got, key=lambda r: (-r.v, r.n))
    assert [r.pos for r in order] == list(range(1, 3001))
    p = {r.g: r for r in exact_percentiles(df, ["g"], "v", {"a": 0.9, "b": 0.005}).collect()}
    x = np.array([v for g, _, v in values if g == "hot"])
    assert p["hot"].a == pytest.approx(np.percentile(x, 90)) and p["hot"].b == pytest.approx(np.percentile(x, 0.5))
    assert p["cold"].a == 5.0
    best = running_max_before(df, ["g"], [F.col("n")], F.col("v"), "m").where("g = 'hot'").orderBy("n").collect()
    assert best[0].m is None
    assert [r.m for r in best[1:]] == list(np.maximum.accumulate(x)[:-1])


def test_region_percentile_is_exact(spark):
    lab = label_regions(mask(spark, [(1, box((0, 4)))]).withColumn("class_value", F.lit(1)), ["case_id", "class_value"])
    context = lab.withColumns({"p": F.array(F.lit(0.0), F.col("i") * 0.1 + F.col("j") * 0.01), "ref_value": F.lit(0)})
    row = rg.region_statistics(context, [0, 1]).first()
    want = [0.1 * i + 0.01 * j for i, j, _ in box((0, 4))]
    assert row.p90_prob == pytest.approx(np.percentile(want, 90))


def test_renamer_learns_a_clear_signal(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for n in range(400):
        wrong = bool(rng.random() < 0.4)
        own = float(np.clip(rng.normal(0.5 if wrong else 0.85, 0.05), 0.05, 0.99))
        rows.append((
            f"P-{n % 100:03d}-{n % 4}", "NETC" if n % 2 else "SNFH", 1 if n % 2 else 2, n, int(60 + rng.integers(500)), own,
            float(np.clip(1 - own - 0.05, 0.01, 1)), 2 if n % 2 else 1, (2 if n % 2 else 1) if wrong else 0, not wrong, 0.05,
            float(rng.random() * 30),
        ))
    table = spark.createDataFrame(rows, "case_id string, class_name string, class_value int, comp_id int, n_cells long, "
                                        "mean_prob double, runner_up_prob double, runner_up_value int, ref_majority_value int, "
                                        "matched boolean, prob_c0 double, dist_to_dominant_mm double")
    renamer = fit_renamer(table)
    d = renamer.diagnostics.first()
    assert d.n_eligible == 400 and d.out_of_fold_auc > 0.95 and d.rename_precision > 0.9
    assert renamer.folds.groupBy("entity_id").count().where("count > 1").isEmpty()
    routed = rename_decisions(table, renamer, out_of_fold=True)
    assert routed.count() == d.renames
    tables.save_renamer(spark, renamer, f"{tmp_path}/renamer")
    again = tables.load_renamer(spark, f"{tmp_path}/renamer")
    assert (again.model, again.fold_models, again.runner_ups) == (renamer.model, renamer.fold_models, renamer.runner_ups)
    replayed = rename_decisions(table, again, out_of_fold=True)
    assert sorted(map(tuple, replayed.collect())) == sorted(map(tuple, routed.collect())) and again.diagnostics.first() == d


def _rows(table):
    return {tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in table.select(sorted(table.columns)).collect()}


def _random_cases(spark, names, edge=7):
    rng = np.random.default_rng(5)
    cells = {n: [(c, *map(int, at), int(v)) for c in names for at, v in np.ndenumerate(rng.choice([0, 0, 1, 2, 3, 4], (edge,) * 3)) if v] for n in ("pred", "ref")}
    masks = [spark.createDataFrame(cells[n], "case_id string, i int, j int, k int, value int") for n in ("pred", "ref")]
    p = [(c, *map(int, at), (rng.integers(0, 64, 5) / 64).tolist()) for c in names for at in np.ndindex(edge, edge, edge) if rng.random() < 0.7]
    # Sixty-fourths add up exactly, so equal means are equal in any order of a sum.
    p[3] = (*p[3][:4], [0.5, None])
    p[4] = (*p[4][:4], None)
    var = [(*r[:4], v, float(rng.integers(0, 64)) / 64) for r in p for v in (1, 3)]
    probs = spark.createDataFrame(p, "case_id string, i int, j int, k int, p array<double>")
    variance = spark.createDataFrame(var, "case_id string, i int, j int, k int, class_value int, variance double")
    return *masks, probs, make_grid(masks[0], (edge,) * 3, (1.0, 0.75, 2.5)), variance


def test_whole_cases_equal_the_way_by_joins(spark):
    pred, ref, probs, grid, variance = _random_cases(spark, ["a", "b", "c"])
    # Case b is not in the array: one cell lies far beyond; case d has an array and no cells, case e no array.
    pred = pred.unionByName(spark.createDataFrame([("b", 90, 2, 2, 1), ("e", 1, 1, 1, 1), ("a", 0, 0, 0, 9)], pred.schema))
    grid = grid.unionByName(grid.where("case_id = 'a'").withColumn("case_id", F.lit("d")))
    for extra in (None, variance):
        whole = rg.region_table(pred, ref, probs, grid, variance=extra, min_cells=3)
        joined = rg.region_table(pred, ref, probs, grid, variance=extra, min_cells=3, tile=4)
        for a, b in zip(whole, joined):
            assert sorted((f.name, f.dataType) for f in a.schema) == sorted((f.name, f.dataType) for f in b.schema)
            assert len(_rows(a)) > 20 and _rows(a) == _rows(b)


def test_region_tables_meet_masks_and_probabilities_in_one_exchange(spark, monkeypatch):
    from cellmosaic.functions import runtime

    pred, ref, probs, grid, _ = _random_cases(spark, ["a", "b", "c", "d"], 6)
    plain = [cells.localCheckpoint() for cells in (pred, ref, probs, grid)]
    whole = [_rows(t) for t in rg.region_table(*plain, min_cells=3)]
    monkeypatch.setattr(runtime, "DEALT_ROWS", 100)
    for table, rows in zip(rg.region_table(*plain, min_cells=3), whole):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
        assert table.rdd.getNumPartitions() == 9  # 864 cells of arrays
        assert _rows(table) == rows
