import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.operators import audit, groups as gr


def vectors(spark, x):
    return spark.createDataFrame([(f"v{n:04d}", [float(a) for a in v]) for n, v in enumerate(x)], "case_id string, embedding array<double>")


def brute(x, threshold):
    c = x - x.mean(1, keepdims=True)
    c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-8
    s = c @ c.T
    return {(f"v{a:04d}", f"v{b:04d}"): s[a, b] for a in range(len(x)) for b in range(a + 1, len(x)) if s[a, b] >= threshold}


@pytest.mark.parametrize("threshold, pivots, block", [(0.99, 8, 16), (0.8, 5, 7), (0.3, 4, 1000)])
def test_near_duplicates_are_exact(spark, threshold, pivots, block):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(20, 12))
    x = np.vstack([base, base[:10] + rng.normal(scale=0.03, size=(10, 12)), base[:8] + rng.normal(scale=0.4, size=(8, 12))])
    got = audit.near_duplicates(vectors(spark, x), threshold=threshold, pivots=pivots, block=block).collect()
    want = brute(x, threshold)
    assert {(r.id_a, r.id_b) for r in got} == set(want) and len(got) == len(want)
    assert all(r.similarity == pytest.approx(want[(r.id_a, r.id_b)]) for r in got)


@pytest.mark.parametrize("threshold, block", [(0.99, 16), (0.9, 5), (0.99, 1000)])
def test_hashed_near_duplicates_find_what_the_exact_ones_find(spark, threshold, block):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(60, 24))
    x = np.vstack([base, base[:30] + rng.normal(scale=0.05, size=(30, 24)), base[:20] + rng.normal(scale=0.3, size=(20, 24)),
                   np.repeat(base[:1], 15, axis=0)])
    table = vectors(spark, x)
    found = audit.near_duplicates(table, threshold=threshold, block=block, method="lsh")
    exact = audit.near_duplicates(table, threshold=threshold, block=block)
    key = lambda r: (r.id_a, r.id_b, round(r.similarity, 9))
    assert sorted(map(key, found.collect())) == sorted(map(key, exact.collect()))
    got = audit.lsh_recall(found, exact).first()
    assert got.n_exact == got.n_found > 15 and got.recall == 1.0
    full = audit.near_duplicates(table, threshold=threshold, block=block, method="lsh", expand=True)
    assert {(r.id_a, r.id_b) for r in full.collect()} == set(brute(x, threshold))


def test_hash_plan_follows_the_number_of_vectors(spark):
    plans = [audit.lsh_plan(n, 0.99, 1e-6) for n in (10, 10**4, 10**7, 10**10)]
    assert [bits for bits, _ in plans] == [4, 8, 18, 28]
    for bits, bands in plans:
        agree = (1 - np.arccos(0.99) / np.pi) ** bits
        assert (1 - agree) ** bands <= 1e-6 and bands < 60
    assert audit.lsh_plan(1000, 1.0, 1e-6) == (4, 1)
    with pytest.raises(ValueError, match="exact"):
        audit.lsh_plan(10**10, 0.3, 1e-6)
    with pytest.raises(ValueError, match="method"):
        audit.near_duplicates(vectors(spark, np.eye(3)), method="other")
    none = audit.near_duplicates(vectors(spark, np.eye(3)).limit(0), method="lsh")
    assert none.count() == 0 and audit.lsh_recall(none, none).first().recall == 1.0


def test_copies_hang_on_their_representative_and_expand(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(6, 8))
    x = np.vstack([base, np.repeat(base[:1], 20, axis=0), base[1:2] + 1e-3])
    folded = audit.near_duplicates(vectors(spark, x), threshold=0.99, pivots=3, block=4)
    assert folded.count() == 20 + 1
    full = audit.near_duplicates(vectors(spark, x), threshold=0.99, pivots=3, block=4, expand=True)
    assert {(r.id_a, r.id_b) for r in full.collect()} == set(brute(x, 0.99))


def test_constant_vectors_match_nothing(spark):
    x = np.vstack([np.ones((3, 4)), np.eye(4)])
    assert {(r.id_a, r.id_b) for r in audit.near_duplicates(vectors(spark, x), threshold=0.5, pivots=2).collect()} == set(brute(x, 0.5))


def test_similarity_profile_is_exact_over_blocks(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 10))
    values = np.array(list(brute(x, -2).values()))
    got = audit.similarity_profile(vectors(spark, x), block=13, bins=50).first()
    assert got.n_pairs == values.size and got["max"] == pytest.approx(values.max())
    assert got["median"] == pytest.approx(np.median(values)) and got.p99 == pytest.approx(np.percentile(values, 99))


@pytest.mark.parametrize("n, block", [(2, 8), (3, 8), (60, 13), (61, 1000), (300, 50)])
def test_similarity_sketch_is_linear_and_near_the_percentiles(spark, n, block):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(n, 10))
    values = np.array(list(brute(x, -2).values()))
    got = audit.similarity_sketch(vectors(spark, x), block=block, offsets=32).first()
    reach = min(32, (n - 1) // 2) if n > 2 else 1
    assert got.n_pairs == values.size and got.n_sampled == (n * reach if n > 2 else 1)
    assert got["max"] == pytest.approx(values.max())
    if got.n_sampled == values.size:
        for q, v in ((0.5, got["median"]), (0.99, got.p99)):
            assert abs(np.percentile(values, 100 * q, method="inverted_cdf") - v) <= 1 / 2000 + 1e-9
    else:
        assert np.mean(values <= got["median"]) == pytest.approx(0.5, abs=0.02) and np.mean(values <= got.p99) == pytest.approx(0.99, abs=0.01)


def test_similarity_sketch_of_too_few(spark):
    assert tuple(audit.similarity_sketch(vectors(spark, np.ones((1, 4)))).first()) == (0, 0, None, None, None)


def test_closest_cross_entity_ignores_the_threshold(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(30, 6))
    entities = spark.createDataFrame([(f"v{n:04d}", n // 2) for n in range(30)], "case_id string, entity_id int")
    got = audit.closest_cross_entity(vectors(spark, x), entities, k=8, pivots=4).orderBy(F.col("similarity").desc()).collect()
    cross = {k: v for k, v in brute(x, -2).items() if int(k[0][1:]) // 2 != int(k[1][1:]) // 2}
    assert [r.similarity for r in got] == pytest.approx(sorted(cross.values(), reverse=True)[:8])


def greedy(sizes, ratios):
    total = sum(sizes)
    target = {s: r * total for s, r in ratios.items()}
    count = dict.fromkeys(ratios, 0)
    out = {}
    for size in sorted(sizes, reverse=True):
        best = max(count, key=lambda s: (target[s] - count[s]) / max(target[s], 1))
        count[best] += size
        out[(size, best)] = out.get((size, best), 0) + 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_quotas_equal_the_one_by_one_choice(seed):
    rng = np.random.default_rng(seed)
    sizes = [int(s) for s in rng.geometric(0.3, size=int(rng.integers(1, 400)))]
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    got = {(size, split): last - first + 1 for size, split, first, last in gr._quotas(histogram, gr.RATIOS)}
    assert got == greedy(sizes, gr.RATIOS)


def test_splits_keep_groups_whole(spark):
    cases = spark.createDataFrame([(n, n % 60) for n in range(300)], "case_id long, entity_id long")
    links = spark.createDataFrame([(1, 2), (2, 3), (40, 10)], "a long, b long")
    groups = gr.leak_safe_groups(cases, links)
    assert {r.entity_id: r.group_id for r in groups.where("entity_id in (1, 2, 3, 40)").collect()} == {1: 1, 2: 1, 3: 1, 40: 10}
    splits = gr.assign_splits(cases, groups)
    assert splits.count() == 300 and gr.split_leaks(splits).isEmpty()
    assert splits.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    again = gr.assign_splits(cases.repartition(3), groups)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, splits.collect()))


def test_folds_are_balanced(spark):
    rows = spark.createDataFrame([(f"c{n % 23}",) for n in range(200)], "case_id string")
    counts = [r["count"] for r in gr.assign_folds(rows).groupBy("fold").count().collect()]
    assert sum(counts) == 23 and max(counts) - min(counts) <= 1


def test_published_p_star_and_gate(spark):
    from cellmosaic.operators.evaluation import gate

    schema = "target string, lesion_where_present double"
    a = spark.createDataFrame([("x", 0.5637), ("y", None)], schema)
    b = spark.createDataFrame([("x", 0.5598), ("y", None)], schema)
    assert gate(a, b).first().proceed and not gate(b, b).first().proceed


def test_similarity_profile_query_looks_at_every_pair(spark):
    from cellmosaic.plans.queries import QUERIES, SQL

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    values = np.array(list(brute(np.array([r.embedding for r in rows], float), -2).values()))
    got = QUERIES["similarity_profile"](spark, d).first()
    assert got.n_pairs == values.size and "n_sampled" not in got and "ring" not in SQL["similarity_profile"]
    assert tuple(got)[1:] == pytest.approx((np.median(values), np.percentile(values, 99), values.max()), abs=1e-6)


@pytest.mark.parametrize("n, block", [(2, 8), (3, 1), (90, 7), (1100, 300)])
def test_similarity_profile_in_bands(spark, n, block, monkeypatch):
    monkeypatch.setattr(audit, "_BAND", 50 * block)
    x = np.random.default_rng(18).normal(size=(n, 6))
    x[n // 2:] = x[: n - n // 2]  # copies: values that occur many times
    values = np.array(list(brute(x, -2).values()))
    got = audit.similarity_profile(vectors(spark, x), block=block, bins=50).first()
    want = (values.size, np.median(values), np.percentile(values, 99), values.max())
    assert tuple(got) == pytest.approx(want)


@pytest.mark.parametrize("block", [16, 64, 5_000])
def test_low_thresholds_meet_in_blocks_and_copy_no_more(spark, block, monkeypatch):
    monkeypatch.setattr(audit, "_BAND", 900)
    monkeypatch.setattr(audit, "_DEALT_ROWS", 100)
    asked = []
    meet = audit._block_meetings
    monkeypatch.setattr(audit, "_block_meetings", lambda reps, blocks, total: asked.append((blocks, total)) or meet(reps, blocks, total))
    x = np.random.default_rng(3).normal(size=(300, 12))
    got = audit.near_duplicates(vectors(spark, x), threshold=0.1, pivots=16, block=block).collect()
    want = brute(x, 0.1)
    assert {(r.id_a, r.id_b) for r in got} == set(want) and len(got) == len(want)
    assert asked == [(max(1, -(-300 // block)), 300 * (max(1, -(-300 // block)) + 1))]


def test_tasks_of_meetings_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(audit, "_DEALT_ROWS", 50)
    reps = vectors(spark, np.random.default_rng(4).normal(size=(400, 8))).select(F.col("case_id").alias("id"), F.col("embedding").alias("u"))
    sent = audit._block_meetings(reps, 5, 400 * 6).applyInArrow(lambda rows: rows.select(["_h", "_a"]), "_h int, _a int")
    assert sent.count() == 2_400 and sent.distinct().count() == 15 and sent.rdd.getNumPartitions() == 48


def test_sketches_of_near_vectors_differ_in_few_signs():
    assert audit._tail(2, 0.5) == pytest.approx([0.75, 0.25, 0.0])
    assert audit.sketch_plan(1.0, 1e-9) == (1, 0)
    for threshold, miss in ((0.99, 1e-6), (0.98, 1e-9), (0.9, 1e-6)):
        words, apart = audit.sketch_plan(threshold, miss)
        over = audit._tail(64 * words, np.arccos(threshold) / np.pi)
        assert over[apart] <= miss < over[apart - 1] and 1 - audit._tail(64 * words, 0.5)[apart] <= 1e-6


@pytest.mark.parametrize("block, checked", [(8, 20), (1000, 1 << 15)])
def test_hashed_search_sends_no_vector_to_its_bands(spark, block, checked, monkeypatch):
    """Vectors travel to be checked, at most twice a pair; a large cell of near copies is met block by block."""
    rng = np.random.default_rng(22)
    base = rng.normal(size=(200, 24))
    x = np.vstack([base, base[:1] + rng.normal(scale=0.03, size=(40, 24)), base[50:60] + rng.normal(scale=0.03, size=(10, 24))])
    want, moved = brute(x, 0.98), []
    cut, dealt = audit.cut, audit._dealt
    monkeypatch.setattr(audit, "_CHECKED", checked)
    monkeypatch.setattr(audit, "_LISTED", 50)
    monkeypatch.setattr(audit, "cut", lambda rows: moved.append(rows) or cut(rows))
    monkeypatch.setattr(audit, "_dealt", lambda rows, keys, total: moved.append(rows) or dealt(rows, keys, total))
    got = audit.near_duplicates(vectors(spark, x), threshold=0.98, block=block, method="lsh", miss=1e-9).collect()
    assert {(r.id_a, r.id_b) for r in got} == set(want) and len(got) == len(want) > 800
    assert all(r.similarity == pytest.approx(want[(r.id_a, r.id_b)]) for r in got)
    assert all(rows.count() <= max(len(x), 2 * len(want)) for rows in moved if "u" in rows.columns)


def _copied(seed):
    """Vectors with near and with equal ones among them, in a random order, and an entity of each (``None``: none)."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 8))
    x = np.vstack([base, np.repeat(base[:4], 6, axis=0), base[4:9] + rng.normal(scale=0.02, size=(5, 8)), np.zeros((4, 8))])
    x = x[rng.permutation(len(x))]
    return x, [None if e == 5 else int(e) for e in rng.integers(0, 6, len(x))]


@pytest.mark.parametrize("method", ["exact", "lsh"])
def test_entity_links_lose_no_copy(spark, method):
    x, entity = _copied(31)
    of = {f"v{n:04d}": e for n, e in enumerate(entity)}
    entities = spark.createDataFrame(list(of.items()), "case_id string, entity_id int")
    pairs = [(of[a], of[b]) for a, b in brute(x, 0.98)]
    want = {(a, b) for a, b in pairs if a is not None and b is not None and a != b}
    got = audit.entity_links(vectors(spark, x), entities, threshold=0.98, pivots=4, method=method).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want) and len(want) > 10
    assert audit.entity_links(vectors(spark, x).limit(0), entities).count() == 0


def test_links_of_the_query_include_those_of_copies(spark, tmp_path):
    from cellmosaic.plans.queries import QUERIES, SQL

    import duckdb

    rng = np.random.default_rng(32)
    base = rng.normal(size=(6, 16)).round(2)
    rows = [(n, [float(v) for v in base[n % 6]], n * 7 % 11) for n in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("cross_entity_links", "top_cross_pairs"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(SQL[name]).fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 15


@pytest.mark.parametrize("seed, n", [(31, 20), (32, 3), (33, 1), (34, 500)])
def test_top_cross_pairs_lose_no_copy(spark, seed, n):
    x, entity = _copied(seed)
    of = {f"v{k:04d}": e for k, e in enumerate(entity)}
    entities = spark.createDataFrame(list(of.items()), "case_id string, entity_id int")
    # Pairs of the same two vectors are equally similar, whatever the last bits say.
    want = [(-round(s, 12), a, b) for (a, b), s in brute(x, 0.9).items() if None not in (of[a], of[b]) and of[a] != of[b]]
    got = audit.top_cross_pairs(vectors(spark, x), entities, n=n, threshold=0.9, pivots=4).collect()
    assert sorted((-round(r.similarity, 12), r.id_a, r.id_b) for r in got) == sorted(want)[:n] and len(want) > 30
    assert audit.top_cross_pairs(vectors(spark, x).limit(0), entities).count() == 0


def test_centres_that_hardly_differ_lose_no_pair():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(20):
        x = np.vstack([3 * rng.normal(size=(1, 8)) + rng.normal(size=(10, 1)), rng.normal(size=(6, 8))])
        x -= x.mean(1, keepdims=True)
        x = np.unique(x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8), axis=0)
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x))], names=["id", "u"])
        found = next(audit._placer(x, np.sqrt(2 - 2 * 0.99))([rows])).to_pydict()
        home, present = dict(zip(found["id"], found["home"])), set(zip(found["id"], found["cell"]))
        near = [(a, b) for a in range(len(x)) for b in range(len(x)) if a != b and x[a] @ x[b] >= 0.99]
        assert len(near) > 2 and all((a, home[b]) in present for a, b in near)
