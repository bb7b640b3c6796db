"""Queries over cases and entities: duplicates, links, groups, splits and key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, groups as gr, modelling as ml
from ..sources.cases import prefer_source
from ..sources.ledger import missing_keys, pending
from ..sources.tables import union_ragged
from .registry import query, r6
from .views import table, view, with_views

THRESHOLD = 0.35  # suits the embeddings at hand, whose centred cosine stays near 0.5 at most
_UNIT = """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings),
c AS (SELECT vec_id, label, list_transform(e, lambda x: x - list_avg(e)) AS e FROM m),
u AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8)) AS e FROM c),
p AS MATERIALIZED (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label AS la, b.label AS lb, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.vec_id < b.vec_id)
"""


@query("exact_duplicates", with_views("doc_cases") + """
SELECT content_md5, COUNT(*) AS n_cases, min(case_id) AS first_case, COUNT(DISTINCT entity_id) AS n_entities, COUNT(DISTINCT entity_id) = 1 AS same_entity
FROM doc_cases GROUP BY 1 HAVING COUNT(*) > 1""")
def _(spark, d):
    return audit.exact_duplicates(view(spark, d, "doc_cases"))


@query("duplicate_counts", with_views("doc_cases") + """
SELECT 'content' AS hash_kind, COUNT(*) AS n_groups FROM (SELECT 1 FROM doc_cases GROUP BY content_md5 HAVING COUNT(*) > 1) t
UNION ALL SELECT 'file', COUNT(*) FROM (SELECT 1 FROM doc_cases GROUP BY file_md5 HAVING COUNT(*) > 1) t""")
def _(spark, d):
    return audit.duplicate_counts(view(spark, d, "doc_cases"))


def _pairs(spark, d):
    return audit.near_duplicates(table(spark, d, "embeddings"), threshold=THRESHOLD, id_column="vec_id", pivots=16)


@query("near_duplicates", _UNIT + "SELECT id_a, id_b, round(s, 6) AS similarity FROM p WHERE s >= 0.35")
def _(spark, d):
    return _pairs(spark, d).select("id_a", "id_b", r6("similarity"))


# Every vector and a copy of it that is mixed with a tenth of its mirror image, which keeps a centred cosine of 0.98 or more.
_MIXED = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
m AS (SELECT 2 * vec_id AS vec_id, e FROM v UNION ALL
  SELECT 2 * vec_id + 1, list_transform(e, lambda x, i: x + 0.1e0 * e[len(e) + 1 - i]) FROM v),
c AS (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS e FROM m),
u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8)) AS e FROM c),
p AS MATERIALIZED (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.vec_id < b.vec_id)
"""


def _mixed(spark, d):
    plain = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    blend = F.zip_with("e", F.reverse("e"), lambda x, y: x + F.lit(0.1) * y)
    return plain.select((2 * F.col("vec_id")).alias("vec_id"), F.col("e").alias("embedding")).unionByName(
        plain.select((2 * F.col("vec_id") + 1).alias("vec_id"), blend.alias("embedding"))
    )


@query("near_duplicates_lsh", _MIXED + "SELECT id_a, id_b, round(s, 6) AS similarity FROM p WHERE s >= 0.98")
def _(spark, d):
    found = audit.near_duplicates(_mixed(spark, d), threshold=0.98, id_column="vec_id", method="lsh", miss=1e-9)
    return found.select("id_a", "id_b", r6("similarity"))


def _entities(vectors):
    return vectors.select("vec_id", F.col("label").alias("entity_id"))


def _vector_cases(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("case_id"), F.col("label").alias("entity_id"),
        F.when(F.col("vec_id") % 3 == 0, "val").otherwise("train").alias("subset"),
        F.concat(F.lit("d"), (F.col("label") % 2).cast("string")).alias("dataset"),
        F.md5(F.col("label").cast("string")).alias("file_md5"),
    )


@query("describe_pairs", _UNIT + """
SELECT id_a AS case_a, id_b AS case_b, round(s, 6) AS similarity, la = lb AS same_entity, la = lb AS same_file,
  CASE WHEN id_a % 3 = 0 THEN 'val' ELSE 'train' END AS subset_a, 'd' || CAST(lb % 2 AS VARCHAR) AS dataset_b FROM p WHERE s >= 0.35""")
def _(spark, d):
    out = audit.describe_pairs(_pairs(spark, d), _vector_cases(spark, d))
    return out.select("case_a", "case_b", r6("similarity"), "same_entity", "same_file", "subset_a", "dataset_b")


@query("top_cross_pairs", _UNIT + """
SELECT id_a AS case_a, id_b AS case_b, round(s, 6) AS similarity FROM p WHERE s >= 0.35 AND la <> lb ORDER BY s DESC, id_a, id_b LIMIT 20""")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    out = audit.top_cross_pairs(vectors, _entities(vectors), threshold=THRESHOLD, id_column="vec_id", pivots=16)
    return out.select(F.col("id_a").alias("case_a"), F.col("id_b").alias("case_b"), r6("similarity"))


@query("closest_cross_entity", _UNIT + """
SELECT id_a, id_b, round(s, 6) AS similarity FROM p WHERE la <> lb ORDER BY s DESC, id_a, id_b LIMIT 8""")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    entities = vectors.select("vec_id", F.col("label").alias("entity_id"))
    out = audit.closest_cross_entity(vectors, entities, id_column="vec_id", pivots=16)
    return out.select("id_a", "id_b", r6("similarity"))


@query("similarity_profile", _UNIT + """
SELECT COUNT(*) AS n_pairs, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.99), 6) AS p99, round(max(s), 6) AS max FROM p""")
def _(spark, d):
    out = audit.similarity_profile(table(spark, d, "embeddings"), id_column="vec_id")
    return out.select("n_pairs", r6("median"), r6("p99"), r6("max"))


@query("cross_entity_links", _UNIT + "SELECT DISTINCT la AS a, lb AS b FROM p WHERE s >= 0.35 AND la <> lb")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    return audit.entity_links(vectors, _entities(vectors), threshold=THRESHOLD, id_column="vec_id", pivots=16)


# The links are paths through each bucket of customers; the SQL side takes the bucket's smallest key.
_GROUPS = """WITH grp AS (SELECT c_custkey AS entity_id, MIN(c_custkey) OVER (
  PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 2000)) AS group_id FROM customer)"""


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("entity_id"))


def _entity_groups(spark, d):
    return gr.leak_safe_groups(table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id")), view(spark, d, "links"))


@query("leak_safe_groups", _GROUPS + " SELECT entity_id, group_id FROM grp")
def _(spark, d):
    return _entity_groups(spark, d)


# The SQL side makes the greedy choice one group at a time, largest first.
_SPLIT = _GROUPS.replace("WITH ", "WITH RECURSIVE ", 1) + """
, gs AS (SELECT group_id, COUNT(*) AS size FROM orders JOIN grp ON o_custkey = entity_id GROUP BY 1),
sq AS MATERIALIZED (SELECT group_id, size, row_number() OVER (ORDER BY size DESC, md5(concat(CAST(group_id AS VARCHAR), ':42')), group_id) AS n FROM gs),
tot AS (SELECT CAST(SUM(size) AS DOUBLE) AS t FROM gs),
st(n, c0, c1, c2, s, size) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), -1, CAST(0 AS BIGINT)
  UNION ALL SELECT n + 1, c0 + CASE WHEN p = 0 THEN z ELSE 0 END, c1 + CASE WHEN p = 1 THEN z ELSE 0 END, c2 + CASE WHEN p = 2 THEN z ELSE 0 END, p, z FROM (
    SELECT st.n, c0, c1, c2, sq.size AS z, CASE WHEN (0.7e0 * t - c0) / (0.7e0 * t) >= (0.15e0 * t - c1) / (0.15e0 * t) AND (0.7e0 * t - c0) / (0.7e0 * t) >= (0.15e0 * t - c2) / (0.15e0 * t) THEN 0
      WHEN (0.15e0 * t - c1) / (0.15e0 * t) >= (0.15e0 * t - c2) / (0.15e0 * t) THEN 1 ELSE 2 END AS p
    FROM st JOIN sq ON sq.n = st.n + 1, tot) q)
"""
_MEMBERS = _SPLIT + """
, members AS (SELECT o_orderkey AS case_id, o_custkey AS entity_id, s AS split
  FROM orders JOIN grp ON o_custkey = entity_id JOIN sq USING (group_id) JOIN st ON st.n = sq.n)
"""


def _splits(spark, d):
    return gr.assign_splits(_orders(spark, d), _entity_groups(spark, d))


@query("assign_splits", _SPLIT + """
SELECT CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, size, COUNT(*) AS n_groups FROM st WHERE s >= 0 GROUP BY 1, 2""")
def _(spark, d):
    sized = _splits(spark, d).groupBy("split", "group_id").agg(F.count(F.lit(1)).alias("size"))
    return sized.groupBy("split", "size").agg(F.count(F.lit(1)).alias("n_groups"))


@query("audit_splits", _SPLIT + """
SELECT CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, CAST(SUM(size) AS BIGINT) AS n_cases,
  round(SUM(size) / (SELECT t FROM tot), 6) AS share FROM st WHERE s >= 0 GROUP BY 1""")
def _(spark, d):
    return gr.audit_splits(_splits(spark, d)).select("split", "n_cases", r6("share"))


@query("split_leaks", _MEMBERS + """
SELECT 'case_id' AS kind, CAST(case_id AS VARCHAR) AS key, COUNT(DISTINCT split) AS n_splits FROM members GROUP BY 2 HAVING COUNT(DISTINCT split) > 1
UNION ALL
SELECT 'entity_id', CAST(entity_id AS VARCHAR), COUNT(DISTINCT split) FROM members GROUP BY 2 HAVING COUNT(DISTINCT split) > 1""")
def _(spark, d):
    return gr.split_leaks(_splits(spark, d))


@query("split_members", _MEMBERS + """
SELECT COUNT(*) FILTER (WHERE n IS NULL) AS lost, COUNT(*) FILTER (WHERE n > 1) AS doubled
FROM orders LEFT JOIN (SELECT case_id, COUNT(*) AS n FROM members GROUP BY 1) m ON o_orderkey = case_id""")
def _(spark, d):
    """Cases that no split or more than one split holds; both counts must be zero."""
    splits = _splits(spark, d)
    members = [gr.select_split(splits, s) for s in gr.RATIOS]
    joined = members[0].unionByName(members[1]).unionByName(members[2]).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return _orders(spark, d).join(joined, "case_id", "left").agg(
        F.count_if(F.col("n").isNull()).alias("lost"), F.count_if(F.col("n") > 1).alias("doubled")
    )


@query("cases_by_entity", """
SELECT o_custkey AS entity_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderkey AS case_id,
  COUNT(*) OVER (PARTITION BY o_custkey) AS n_cases FROM orders""")
def _(spark, d):
    return gr.cases_by_entity(_orders(spark, d))


@query("pending_cases", "SELECT c_custkey AS case_id FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def _(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"))
    return pending(wanted, table(spark, d, "orders").select(F.col("o_custkey").alias("case_id")))


@query("missing_keys", """
SELECT DISTINCT l_partkey, l_suppkey FROM (SELECT p_partkey AS l_partkey, p_partkey % 100 AS l_suppkey FROM part) w ANTI JOIN lineitem USING (l_partkey, l_suppkey)""")
def _(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 100).alias("l_suppkey"))
    return missing_keys(wanted, table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("members_of_list", "SELECT o_orderpriority, COUNT(*) AS n FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(found, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("prefer_source", """
SELECT user_id AS case_id, arg_min(event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END) AS source FROM
  (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('purchase', 'signup', 'click')) t GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.lit("x").alias("dataset"), F.col("event_type").alias("source")).distinct()
    return prefer_source(rows, ["purchase", "signup", "click"]).select("case_id", "source")


@query("union_ragged", """
SELECT c_nationkey AS nation, c_acctbal AS a, NULL AS b FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier""")
def _(spark, d):
    return union_ragged([
        table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("a")),
        table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("b")),
    ])


@query("join_features", with_views("regions") + "SELECT case_id, class_name, comp_id, n_cells, round(mean_prob * 2, 6) AS z FROM regions")
def _(spark, d):
    regions = view(spark, d, "regions").select("case_id", "class_name", "comp_id", "n_cells", "mean_prob")
    extra = regions.select("case_id", "class_name", "comp_id", F.col("n_cells").alias("n_voxels_check"), r6(F.col("mean_prob") * 2, "z"))
    return ml.join_features(regions.drop("mean_prob"), extra)


@query("typed_null_cleanup", "SELECT COUNT(*) AS n, COUNT(CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END) AS n_finite FROM lineitem")
def _(spark, d):
    from ..functions.exprs import finite

    ratio = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") / F.nullif(F.col("l_tax"), F.lit(0.0)))
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count(finite(ratio)).alias("n_finite"))
