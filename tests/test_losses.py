"""Inputs that once lost rows or gave wrong answers without an error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.functions import runtime
from cellmosaic.operators import audit, evaluation, filters
from cellmosaic.operators.labelling import label_pieces, label_regions
from cellmosaic.sources import cases, ledger, tables

from .conftest import cell_table, mask
from .test_sources import MODEL


def test_fill_empty_chooses_classes_beyond_sixty_four(spark):
    pred = mask(spark, [(1, [(0, 0, 0)])], case="busy")
    p = [0.0] * 72
    p[71] = 1.0
    probs = spark.createDataFrame([("empty", 1, 1, 1, p), ("flat", 1, 1, 1, [1.0])], "case_id string, i int, j int, k int, p array<double>")
    got = {(r.case_id, r.value) for r in filters.fill_empty(pred, probs).collect()}
    assert got == {("busy", 1), ("empty", 71)}


@pytest.mark.parametrize("cell", [(-1, 0, 0), (0, 0, 1 << 21)])
def test_cells_that_cannot_be_packed_are_refused(spark, cell):
    cells = cell_table(spark, [("a", (0, 0, 0), 1), ("a", cell, 1)])
    with pytest.raises(Exception, match="outside 0"):
        label_regions(cells).collect()


def test_repeated_cells_count_once(spark):
    cells = cell_table(spark, [("a", (0, 0, 0), 1), ("a", (0, 0, 0), 1), ("a", (0, 0, 1), 1), ("b", (0, 0, 1), 1)])
    for label in (label_regions, label_pieces):
        got = sorted((r.case_id, r.k, r.n_cells, r["head"]) for r in label(cells).collect())
        assert got == [("a", 0, 2, True), ("a", 1, 2, False), ("b", 1, 1, True)]


def test_unlisted_sources_come_last(spark):
    rows = [("d", "1", "yy"), ("d", "2", "mm"), ("d", "2", "yy"), ("d", "3", "zz"), ("d", "3", "yy")]
    df = spark.createDataFrame(rows, "dataset string, case_id string, source string")
    got = {(r.case_id, r.source) for r in cases.prefer_source(df, ["mm"]).collect()}
    assert got == {("1", "yy"), ("2", "mm"), ("3", "yy")}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType().add("a", T.IntegerType()).add("b", T.DoubleType())
    (tmp_path / "x.csv").write_text("b,a\n1.5,2\nnan,\n")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "x.csv"), schema).collect()] == [(2, 1.5), (None, None)]
    (tmp_path / "y.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="no column b"):
        tables.read_table(spark, str(tmp_path / "y.csv"), schema)


def test_both_stages_remain_at_a_threshold_of_zero(spark):
    regions = spark.createDataFrame(
        [("a", "x", 1, 60, True, 0.4, [1])], "case_id string, class_name string, comp_id int, n_cells long, matched boolean, posterior double, matched_ref_ids array<int>"
    )
    refs = spark.createDataFrame(
        [("a", "x", 1, 60, True, [1])], "case_id string, class_name string, ref_id int, n_cells long, detected boolean, matched_comp_ids array<int>"
    )
    got = {(r.scope, r.stage) for r in evaluation.detection_summary(regions, refs, 0.0, 1).collect()}
    assert got == {(s, t) for s in ("all", "x") for t in ("before", "after")}


def test_closest_pairs_with_copies_of_several_entities(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 6))
    x = [base[0], base[0], base[0], base[0] + 0.02 * base[1], base[2], base[3], base[0], base[0]]
    entity = ["A", "B", "C", "A", "D", "E", "A", "A"]
    rows = [(f"v{i}", [float(a) for a in v]) for i, v in enumerate(x)]
    fp = spark.createDataFrame(rows, "case_id string, embedding array<double>")
    entities = spark.createDataFrame([(f"v{i}", e) for i, e in enumerate(entity)], "case_id string, entity_id string")
    u = np.array(x) - np.mean(x, axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True) + 1e-8
    pairs = sorted(((-round(float(u[a] @ u[b]), 9), f"v{a}", f"v{b}") for a in range(8) for b in range(a + 1, 8) if entity[a] != entity[b]))
    for k in (5, 9, len(pairs)):
        got = audit.closest_cross_entity(fp, entities, k=k, pivots=3).collect()
        assert sorted((-round(r.similarity, 9), r.id_a, r.id_b) for r in got) == pairs[:k]


def test_ledger_is_written_once_per_application(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.refuse_second(spark, path, "r", "test", MODEL)
    ledger.record_application(spark, path, "r", "test", MODEL)
    with pytest.raises(ledger.AlreadyAppliedError):
        ledger.refuse_second(spark, path, "r", "test", MODEL)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.scratch(Session(), "x-")


def test_ordered_export_is_sorted_over_all_files(spark, tmp_path):
    rows = [(int(n), f"x{n % 7}") for n in np.random.default_rng(1).permutation(500)]
    path = str(tmp_path / "sorted")
    tables.write_table(spark.createDataFrame(rows, "n int, x string").repartition(6), path, ["x", "n"], order=["x", F.desc("n")])
    lines = [line for f in sorted((tmp_path / "sorted").glob("part-*.csv")) for line in f.read_text().splitlines()[1:]]
    assert lines == [f"{x},{n}" for n, x in sorted(rows, key=lambda r: (r[1], -r[0]))]


def test_totals_of_the_tradeoff(spark):
    refs = spark.createDataFrame(
        [("a", "x", 1, True, [1, 2]), ("a", "x", 2, True, [2]), ("a", "x", 3, False, []), ("b", "x", 1, True, [9])],
        "case_id string, class_name string, ref_id int, detected boolean, matched_comp_ids array<int>",
    )
    decisions = spark.createDataFrame([("a", "x", 1, True), ("a", "x", 2, False)], "case_id string, class_name string, comp_id int, keep boolean")
    assert tuple(evaluation.tradeoff_totals(refs, decisions).first()) == (4, 3, 1)
