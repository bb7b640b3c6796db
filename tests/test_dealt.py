"""Steps whose tasks grow in number with their rows, and not in size."""

from cellmosaic.functions import runtime
from cellmosaic.plans.queries import QUERIES


def test_pass_variance_deals_its_rows_once(spark, monkeypatch):
    whole = {tuple(r) for r in QUERIES["pass_variance"](spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(runtime, "DEALT_ROWS", 200)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    out = QUERIES["pass_variance"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == -(-rows // 200)
    assert {tuple(r) for r in out.collect()} == whole


def test_linear_resampling_spreads_cells_where_they_are_summed(spark, monkeypatch):
    from cellmosaic.operators.geometry import make_grid, regrid_linear
    from tests.conftest import box

    cells = spark.createDataFrame([(c, i, j, k, float(i + 2 * j + 3 * k + 1)) for c in "ab" for i, j, k in box((0, 5))], "case_id string, i int, j int, k int, v double")
    grid = make_grid(cells, (5, 5, 5), (1.0, 0.75, 2.5))
    whole = {tuple(r)[:4]: r.v for r in regrid_linear(cells, grid).collect()}
    monkeypatch.setattr(runtime, "DEALT_ROWS", 20)
    out = regrid_linear(cells, grid)
    assert out.rdd.getNumPartitions() == 13  # 250 cells
    got = {tuple(r)[:4]: r.v for r in out.collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-9 for k in whole)
