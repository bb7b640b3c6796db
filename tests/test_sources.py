import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from cellmosaic.functions.schema import REFS
from cellmosaic.operators.modelling import Model
from cellmosaic.sources import cases as sc, ledger, tables
from cellmosaic.streaming import jobs

MODEL = Model(["f"], ["x"], ["f"], {"f": 0.0}, [0.0], [1.0], [2.0], 0.5)


def make_cases(root, names, kinds, separator="-"):
    for n in names:
        folder = root / n
        folder.mkdir(parents=True)
        for k in kinds:
            (folder / f"{n}{separator}{k}.nii.gz").write_bytes(b"x" + n.encode())


def test_case_discovery(spark, tmp_path):
    make_cases(tmp_path / "g", ["BraTS-GLI-00005-100", "BraTS-GLI-00005-101"], ["t1c", "t1n", "t2f", "t2w", "seg"])
    make_cases(tmp_path / "g", ["BraTS-GLI-00006-100"], ["t1c", "t1n", "t2f", "t2w"])
    make_cases(tmp_path / "g", ["notes"], ["t1c"])
    found = {r.case_id: r for r in sc.load_cases(spark, {"g": (str(tmp_path / "g"), sc.GLIOMA, "train")}).collect()}
    assert set(found) == {"BraTS-GLI-00005-100", "BraTS-GLI-00005-101", "BraTS-GLI-00006-100"}
    one = found["BraTS-GLI-00005-101"]
    assert (one.entity_id, one.timepoint, sorted(one.images)) == ("gli-00005", "101", ["t1c", "t1n", "t2f", "t2w"])
    assert one.label.endswith("-seg.nii.gz") and found["BraTS-GLI-00006-100"].label is None


def test_incomplete_case_is_an_error(spark, tmp_path):
    make_cases(tmp_path, ["BraTS-GLI-00005-100"], ["t1c", "t1n"])
    rows = sc.cases_from_files(sc.list_files(spark, str(tmp_path)), sc.GLIOMA, "train")
    assert sorted(sc.missing_modalities(rows, sc.GLIOMA.required).first().missing) == ["t2f", "t2w"]
    with pytest.raises(Exception, match="missing modalities"):
        sc.require_complete(rows, sc.GLIOMA.required).collect()


def test_resampled_copy_wins(spark, tmp_path):
    make_cases(tmp_path / "raw", ["BraTS-MEN-RT-0001-1", "BraTS-MEN-RT-0002-1"], ["t1c", "gtv"], "_")
    make_cases(tmp_path / "mm", ["BraTS-MEN-RT-0001-1"], ["t1c", "gtv"], "_")
    roots = {n: (str(tmp_path / n), sc.MENINGIOMA, "train") for n in ("raw", "mm")}
    got = {r.case_id: r.source for r in sc.load_cases(spark, roots, prefer=["mm", "raw"]).collect()}
    assert got == {"BraTS-MEN-RT-0001-1": "mm", "BraTS-MEN-RT-0002-1": "raw"}


def test_file_hash(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"same")
    (tmp_path / "b.bin").write_bytes(b"same")
    (tmp_path / "c.bin").write_bytes(b"other")
    assert sc.file_hash(spark, str(tmp_path)).select("file_md5").distinct().count() == 2


def test_csv_round_trip_keeps_types(spark, tmp_path):
    rows = [("a", "x", 1, 1, 60, 60.0, math.nan, True, 0.5, [1, 2]), ("b", "x", 1, 2, 70, 70.0, 3.5, False, None, [])]
    df = spark.createDataFrame(rows, REFS)
    tables.write_table(df, str(tmp_path / "refs"), REFS.fieldNames())
    got = {r.case_id: r for r in tables.read_table(spark, str(tmp_path / "refs"), REFS).collect()}
    assert got["a"].dist_to_dominant_mm is None and got["a"].matched_comp_ids == [1, 2] and got["a"].detected is True
    assert got["b"].dice is None and got["b"].matched_comp_ids == [] and got["b"].dist_to_dominant_mm == 3.5


def test_documents_models_and_histories(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "n int, v array<double>")
    tables.write_documents(df, str(tmp_path / "d"))
    assert tables.read_documents(spark, str(tmp_path / "d"), df.schema).first() == df.first()
    tables.save_model(spark, MODEL, str(tmp_path / "m"))
    assert tables.load_model(spark, str(tmp_path / "m")) == MODEL
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "history.json").write_text(
        '[{"epoch": 1, "loss": 2.0, "lr": 0.1, "secs": 5.0}, {"epoch": 2, "loss": 1.0, "lr": 0.1, "secs": 5.0, "val_mean": 0.4, "val_per_class": [0.3, 0.5]}]'
    )
    history = tables.read_history(spark, str(tmp_path / "runs" / "*" / "history.json"))
    assert history.count() == 2 and history.first().run == "r1"
    scores = {r.class_name: r.score for r in tables.class_scores(history, ["x", "y"]).collect()}
    assert scores == {"x": 0.3, "y": 0.5}


def test_limited_run_does_not_overwrite(spark, tmp_path):
    path = str(tmp_path / "scores")
    assert tables.guarded_write(spark.range(10).toDF("n"), path)
    assert not tables.guarded_write(spark.range(3).toDF("n"), path, limit=3)
    assert spark.read.parquet(path).count() == 10


def test_ledger_allows_one_application_per_model(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.record_application(spark, path, "r", "test", MODEL)
    with pytest.raises(ledger.AlreadyAppliedError):
        ledger.record_application(spark, path, "r", "test", MODEL)
    ledger.record_application(spark, path, "r", "test", MODEL, force=True)
    refitted = Model(["f"], ["x"], ["f"], {"f": 0.0}, [0.0], [1.0], [2.5], 0.5)
    ledger.record_application(spark, path, "r", "test", refitted)
    ledger.record_application(spark, path, "r", "val", MODEL)
    assert spark.read.parquet(path).count() == 4


SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("epoch", T.LongType()), T.StructField("val_mean", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
])


def drop_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_intake_and_best_so_far_continue_over_restarts(spark, tmp_path):
    source, kept, best = (str(tmp_path / n) for n in ("in", "kept", "best"))
    state = [str(tmp_path / n) for n in ("s1", "s2")]
    drop_file(spark, source, [("a", 1, 0.2, at(1)), ("a", 2, 0.5, at(2)), ("b", 1, 0.1, at(3))])

    def run():
        stream = jobs.file_stream(spark, source, SCHEMA)
        jobs.intake(stream.select("run"), "run", kept, state[0]).start().awaitTermination()
        jobs.streaming_best(jobs.file_stream(spark, source, SCHEMA), best, state[1]).start().awaitTermination()

    run()
    drop_file(spark, source, [("a", 3, 0.4, at(4)), ("a", 4, 0.6, at(5)), ("c", 1, 0.3, at(6)), ("b", 2, 0.1, at(7))])
    run()
    assert sorted(r.run for r in spark.read.parquet(kept).collect()) == ["a", "b", "c"]
    got = sorted((r.run, r.epoch) for r in spark.read.parquet(best).collect())
    assert got == [("a", 1), ("a", 2), ("a", 4), ("b", 1), ("c", 1)]


def test_one_file_a_trigger_gives_what_a_batch_gives(spark, tmp_path):
    """Best so far and intake over many triggers, ended and taken up again in between."""
    rng = np.random.default_rng(5)
    source, best, kept = (str(tmp_path / n) for n in ("in", "best", "kept"))
    rows = [(None if n % 9 == 8 else "abc"[n % 3], epoch, None if n % 11 == 10 else float(rng.integers(12)) / 10 + epoch / 40, at(epoch))
            for epoch in range(24) for n in range(5)]
    rows.append(("a", None, 9.0, at(30)))
    for part in (0, 1):
        for epoch in range(12 * part, 12 * part + 12, 3):
            drop_file(spark, source, [r for r in rows if r[1] is not None and epoch <= r[1] < epoch + 3] or rows[-1:])
        if part:
            drop_file(spark, source, rows[-1:])
        for name, start in (("best", jobs.streaming_best), ("kept", jobs.intake)):
            stream = jobs.file_stream(spark, source, SCHEMA, files_per_trigger=1)
            if name == "best":
                start(stream, best, str(tmp_path / "s1")).start().awaitTermination()
            else:
                start(stream.select("epoch"), "epoch", kept, str(tmp_path / "s2")).start().awaitTermination()
    want, top = set(), {}
    for epoch in range(24):
        step = [r for r in rows if r[1] == epoch and r[2] is not None]
        want |= {r[:3] for r in step if r[0] not in top or r[2] > top[r[0]]}
        for r in step:
            top[r[0]] = max(top.get(r[0], r[2]), r[2])
    got = [tuple(r) for r in spark.read.parquet(best).select("run", "epoch", "val_mean").collect()]
    assert set(got) == want and len({r[1] for r in want}) > 8
    epochs = [r.epoch for r in spark.read.parquet(kept).collect()]
    assert sorted(epochs, key=lambda e: -1 if e is None else e) == [None, *range(24)]


def test_a_trigger_writes_the_cells_that_it_changed(spark, tmp_path):
    source, out, state, folded = (str(tmp_path / n) for n in ("in", "out", "state", "folded"))

    def run():
        stream = jobs.file_stream(spark, source, SCHEMA, files_per_trigger=1)
        jobs.run_to_changes(jobs.running_occupancy(stream, ["epoch"], "run"), out, state)

    drop_file(spark, source, [("a", n, 0.0, at(n)) for n in range(200)])
    run()
    drop_file(spark, source, [("b", 3, 0.0, at(201)), ("a", 3, 0.0, at(202)), ("b", 500, 0.0, at(203)), ("b", 3, 0.0, at(204))])
    run()
    sizes = {r["_batch"]: r["count"] for r in spark.read.parquet(out).groupBy("_batch").count().collect()}
    assert sorted(sizes.values()) == [2, 200]
    want = {(n, 2 if n == 3 else 1) for n in [*range(200), 500]}
    assert {tuple(r) for r in jobs.latest_rows(spark, out, ["epoch"]).select("epoch", "n_cases").collect()} == want
    jobs.fold_changes(spark, out, ["epoch"], folded)
    assert spark.read.parquet(folded).count() == 201
    assert {tuple(r) for r in jobs.latest_rows(spark, folded, ["epoch"]).select("epoch", "n_cases").collect()} == want


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = jobs.file_stream(spark, source, SCHEMA).withColumn("good", F.col("val_mean") > 0.5)
        jobs.run_to_table(jobs.windowed_rates(stream, label="good", by="run", width="10 minutes", delay="10 minutes"), out, state)

    drop_file(spark, source, [("a", 1, 0.9, at(1)), ("a", 2, 0.1, at(2)), ("a", 3, 0.9, at(60))])
    run()
    drop_file(spark, source, [("a", 4, 0.9, at(3)), ("a", 5, 0.9, at(120))])
    run()
    got = {r.window_start: (r.n, r.n_false) for r in spark.read.parquet(out).collect()}
    assert got == {at(0): (2, 1), at(60): (1, 0)}


def test_means_that_differ_by_the_order_of_their_sums_are_ties(spark):
    from cellmosaic.operators import volumes as vol

    # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 are two doubles, whichever class has the larger one.
    up, down = 0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1
    assert up != down
    rows = [("a", 0, 0, 0, [down / 3, up / 3, 0.1]), ("a", 0, 0, 1, [0.1, up / 3, down / 3]), ("a", 0, 0, 2, [0.1, down / 3, up / 3]),
            ("a", 0, 0, 3, [0.2, 0.2 + 1e-9, 0.1])]
    arrays = spark.createDataFrame(rows, "case_id string, i int, j int, k int, p array<double>")
    assert [r[0] for r in arrays.orderBy("k").select(vol.predicted_place()).collect()] == [0, 1, 1, 1]
    long = arrays.selectExpr("case_id", "i", "j", "k", "posexplode(p) as (class_value, p)")
    assert {r.k: r.value for r in vol.predicted_class(long).collect()} == {1: 1, 2: 1, 3: 1}
