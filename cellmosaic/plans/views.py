"""Views over the driver's tables, written once in SQL that Spark and DuckDB both run.

Every view reads all rows of its tables.  Cases are suppliers on a 12 x 12 x 12 grid, so the
number of cases grows with the data while the density of a case does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GRID_EDGE = 12
MIN_CELLS = 4  # region floor that suits masks of this density
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_PRED_VALUE = "1 + CASE WHEN i >= 6 THEN 1 ELSE 0 END + CASE WHEN j >= 6 THEN 2 ELSE 0 END"
_REF_VALUE = "1 + CASE WHEN i >= 5 THEN 1 ELSE 0 END + CASE WHEN j >= 7 THEN 2 ELSE 0 END"
_WEIGHTS = ", ".join(
    f"SUM((CAST(l_quantity AS BIGINT) + {v} * l_linenumber) % 11 + 1)"
    + (
        f" + CASE WHEN MAX(l_discount) >= 0.05 AND MAX({_PRED_VALUE}) = {v} THEN 30 ELSE 0 END"
        f" + CASE WHEN MIN(l_discount) <= 0.06 AND MAX({_REF_VALUE}) = {v} THEN 12 ELSE 0 END" if v else ""
    )
    + f" AS w{v}"
    for v in range(5)
)

# name -> (tables and views it reads, SQL)
VIEWS: dict[str, str] = {
    "placed": """
        SELECT l_suppkey AS case_id, CAST(l_partkey % 12 AS INT) AS i, CAST(l_orderkey % 12 AS INT) AS j,
               CAST(floor(l_partkey / 12e0) % 12 AS INT) AS k, l_discount, l_quantity, l_linenumber, l_tax
        FROM lineitem""",
    "pred": f"SELECT DISTINCT case_id, i, j, k, {_PRED_VALUE} AS value FROM placed WHERE l_discount >= 0.05",
    "ref": f"SELECT DISTINCT case_id, i, j, k, {_REF_VALUE} AS value FROM placed WHERE l_discount <= 0.06",
    "weights": f"SELECT case_id, i, j, k, {_WEIGHTS} FROM placed GROUP BY case_id, i, j, k",
    "volume": "SELECT case_id, i, j, k, CAST(SUM(l_quantity) AS DOUBLE) AS v FROM placed GROUP BY case_id, i, j, k",
    "cases": "SELECT s_suppkey AS case_id FROM supplier",
    "found": """
        SELECT event_id, user_id AS case_id, event_type AS class_name, CAST(event_id AS INT) AS comp_id, ts,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS kk, value,
               CAST(day(ts) AS INT) AS ref_id
        FROM events""",
    "regions": """
        SELECT case_id, class_name, comp_id, ref_id, CAST(30 + 2 * kk AS BIGINT) AS n_cells,
               kk + value > 60 AS matched, value / (value + 20) AS mean_prob,
               (value + kk) / (value + kk + 60) AS posterior,
               CASE WHEN kk + value > 60 THEN kk / 100e0 ELSE 0e0 END AS dice_with_matched,
               CAST((kk * 13 + comp_id) % 70 AS DOUBLE) AS dist_to_dominant_mm,
               row_number() OVER (PARTITION BY case_id, class_name ORDER BY kk DESC, comp_id) AS rank_by_volume
        FROM found""",
    "refs": """
        SELECT case_id, class_name, ref_id, CAST(SUM(n_cells) AS BIGINT) AS n_cells,
               MAX(CASE WHEN matched THEN 1 ELSE 0 END) = 1 AS detected,
               SUM(dice_with_matched) / COUNT(*) AS dice,
               CAST(SUM(n_cells) % 60 AS DOUBLE) AS dist_to_dominant_mm
        FROM regions GROUP BY case_id, class_name, ref_id""",
    "scores": """
        SELECT o_custkey AS case_id, o_orderpriority AS target,
               (SUM(o_orderkey) % 101) / 100e0 AS lesion_dice, (SUM(o_orderkey) % 97) / 96e0 AS dice,
               (SUM(o_orderkey * 7) % 101) / 100e0 AS lesion_after,
               CAST(SUM(o_orderkey) % 3 AS INT) AS lesions_false, CAST(SUM(o_orderkey) % 2 AS INT) AS lesions_missed,
               MIN(o_orderkey) % 4 <> 0 AS present
        FROM orders GROUP BY o_custkey, o_orderpriority""",
    "links": """
        SELECT a, b FROM (
          SELECT c_custkey AS a, LAG(c_custkey) OVER (
            PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 2000) ORDER BY c_acctbal, c_custkey) AS b FROM customer) t
        WHERE b IS NOT NULL""",
    "doc_cases": """
        SELECT doc_id AS case_id, source AS entity_id, lang AS dataset, lang AS subset,
               md5(text) AS content_md5, md5(concat(lang, ':', text)) AS file_md5 FROM documents""",
    "history": """
        SELECT CAST(user_id AS STRING) AS run, CAST(event_id AS INT) AS epoch, value AS val_mean,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS secs, ts FROM events""",
}
_NEEDS = {
    "pred": ["placed"], "ref": ["placed"], "weights": ["placed"], "volume": ["placed"], "regions": ["found"],
    "refs": ["regions"],
}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in _closure(tuple(_NEEDS.get(name, ()))):
            if need not in out:
                out.append(need)
        if name not in out:
            out.append(name)
    return out


def with_views(*names: str, recursive: bool = False) -> str:
    """The ``WITH`` clause that defines the named views, for the SQL side."""
    body = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in _closure(names))
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n".replace("AS STRING", "AS VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; base tables and inner views are passed in by reference."""
    frames = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in _text(name)}
    clause = ",\n".join(f"{n} AS ({_bound(VIEWS[n])})" for n in _closure((name,)))
    return spark.sql(f"WITH {clause} SELECT * FROM {name}", **frames)


def _text(name: str) -> str:
    return " ".join(VIEWS[n] for n in _closure((name,))).replace("\n", " ")


def _bound(sql: str) -> str:
    out = sql.strip()
    for t in TABLES:
        for word in ("FROM", "JOIN"):
            out = out.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t})", f"{word} {{{t}}})")
            if out.endswith(f"{word} {t}"):
                out = out[: -len(t)] + f"{{{t}}}"
    return out


# Recursive labelling for the SQL side: masks -> lab(nid, root) and numbered regions.
# ``masks`` must give side (0 predicted, 1 reference), case_id, target (a small integer), i, j, k.
LABEL_SQL = """
nodes AS MATERIALIZED (
  SELECT side, case_id, target, i, j, k,
         ((side * 100000000 + case_id) * 100 + target) * 1728 + i * 144 + j * 12 + k AS nid FROM masks),
edges AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.nid AS a, y.nid AS b FROM nodes x JOIN nodes y ON y.nid = x.nid + 1 WHERE x.k < 11
    UNION ALL SELECT x.nid, y.nid FROM nodes x JOIN nodes y ON y.nid = x.nid + 12 WHERE x.j < 11
    UNION ALL SELECT x.nid, y.nid FROM nodes x JOIN nodes y ON y.nid = x.nid + 144 WHERE x.i < 11) e
  UNION ALL SELECT b, a FROM (
    SELECT x.nid AS a, y.nid AS b FROM nodes x JOIN nodes y ON y.nid = x.nid + 1 WHERE x.k < 11
    UNION ALL SELECT x.nid, y.nid FROM nodes x JOIN nodes y ON y.nid = x.nid + 12 WHERE x.j < 11
    UNION ALL SELECT x.nid, y.nid FROM nodes x JOIN nodes y ON y.nid = x.nid + 144 WHERE x.i < 11) e),
lab(nid, root) USING KEY (nid) AS (
  SELECT nid, nid AS root FROM nodes
  UNION
  SELECT m.b, m.r FROM (SELECT e.b, MIN(l.root) AS r FROM lab l JOIN edges e ON e.a = l.nid GROUP BY e.b) m
  JOIN recurring.lab c ON c.nid = m.b WHERE m.r < c.root),
labelled AS MATERIALIZED (
  SELECT n.*, CAST(dense_rank() OVER (PARTITION BY side, case_id, target ORDER BY root) AS INT) AS comp_id,
         COUNT(*) OVER (PARTITION BY root) AS n_cells
  FROM nodes n JOIN lab USING (nid))"""

TARGETS = {"NETC": (1,), "SNFH": (2,), "ET": (3,), "RC": (4,), "TC": (1, 3), "WT": (1, 2, 3)}
TARGET_CODES = "(VALUES (1,'NETC',1),(2,'SNFH',2),(3,'ET',3),(4,'RC',4),(5,'TC',1),(5,'TC',3)," \
    "(6,'WT',1),(6,'WT',2),(6,'WT',3)) bridge(target, name, value)"
TARGET_NAMES = "(VALUES (1,'NETC'),(2,'SNFH'),(3,'ET'),(4,'RC'),(5,'TC'),(6,'WT')) names(target, name)"

MASKS_BY_CLASS = """masks AS (
  SELECT 0 AS side, case_id, value AS target, i, j, k FROM pred
  UNION ALL SELECT 1, case_id, value, i, j, k FROM ref)"""
MASKS_BY_TARGET = f"""masks AS (
  SELECT 0 AS side, case_id, b.target, i, j, k FROM pred JOIN {TARGET_CODES.replace('bridge(', 'b(')} ON b.value = pred.value
  UNION ALL SELECT 1, case_id, b.target, i, j, k FROM ref JOIN {TARGET_CODES.replace('bridge(', 'b(')} ON b.value = ref.value)"""

# Match tables on the SQL side, for any ``labelled``.
MATCH_SQL = """
sizes AS (SELECT side, case_id, target, comp_id, COUNT(*) AS n FROM labelled GROUP BY ALL),
touch AS MATERIALIZED (
  SELECT p.case_id, p.target, p.comp_id, r.comp_id AS ref_id, COUNT(*) AS shared,
         ANY_VALUE(p.n_cells) AS pn, ANY_VALUE(r.n_cells) AS rn
  FROM labelled p JOIN labelled r ON p.side = 0 AND r.side = 1 AND p.case_id = r.case_id AND p.target = r.target
   AND p.i = r.i AND p.j = r.j AND p.k = r.k GROUP BY p.case_id, p.target, p.comp_id, r.comp_id),
comps AS MATERIALIZED (
  SELECT s.case_id, s.target, s.comp_id, s.n AS n_cells, t.shared IS NOT NULL AS matched,
         COALESCE(2.0 * t.shared / (s.n + t.other), 0.0) AS dice_with_matched,
         t.shared IS NULL AND s.n >= {floor} AS false_positive, t.ids AS ids
  FROM sizes s LEFT JOIN (
    SELECT case_id, target, comp_id, SUM(shared) AS shared, SUM(rn) AS other,
           string_agg(CAST(ref_id AS VARCHAR), ' ' ORDER BY ref_id) AS ids
    FROM touch WHERE rn >= {floor} GROUP BY ALL) t USING (case_id, target, comp_id) WHERE s.side = 0),
refsx AS MATERIALIZED (
  SELECT s.case_id, s.target, s.comp_id AS ref_id, s.n AS n_cells, s.n >= {floor} AS scored,
         t.shared IS NOT NULL AS detected,
         CASE WHEN s.n >= {floor} THEN COALESCE(2.0 * t.shared / (s.n + t.other), 0.0) ELSE 0.0 END AS dice,
         t.ids AS ids
  FROM sizes s LEFT JOIN (
    SELECT case_id, target, ref_id AS comp_id, SUM(shared) AS shared, SUM(pn) AS other,
           string_agg(CAST(comp_id AS VARCHAR), ' ' ORDER BY comp_id) AS ids
    FROM touch GROUP BY ALL) t USING (case_id, target, comp_id) WHERE s.side = 1)""".format(floor=MIN_CELLS)

SCORES_SQL = f"""
scored AS (
  SELECT c.case_id, n.name AS target,
    CASE WHEN COALESCE(p.n,0) = 0 AND COALESCE(r.n,0) = 0 THEN 1.0 WHEN COALESCE(p.n,0) = 0 OR COALESCE(r.n,0) = 0 THEN 0.0
         ELSE 2.0 * COALESCE(t.s,0) / (p.n + r.n) END AS dice,
    CASE WHEN COALESCE(r.sc,0) + COALESCE(p.fp,0) = 0 THEN 1.0
         ELSE COALESCE(r.d,0.0) / (COALESCE(r.sc,0) + COALESCE(p.fp,0)) END AS lesion_dice,
    COALESCE(r.fn,0) AS lesions_missed, COALESCE(p.fp,0) AS lesions_false, r.n IS NOT NULL AS present
  FROM cases c CROSS JOIN {TARGET_NAMES.replace('names(', 'n(')}
  LEFT JOIN (SELECT case_id, target, SUM(n_cells) n, COUNT(*) FILTER (WHERE false_positive) fp FROM comps GROUP BY ALL) p
    ON p.case_id = c.case_id AND p.target = n.target
  LEFT JOIN (SELECT case_id, target, SUM(n_cells) n, COUNT(*) FILTER (WHERE scored) sc, SUM(dice) FILTER (WHERE scored) d,
               COUNT(*) FILTER (WHERE scored AND NOT detected) fn FROM refsx GROUP BY ALL) r
    ON r.case_id = c.case_id AND r.target = n.target
  LEFT JOIN (SELECT case_id, target, SUM(shared) s FROM touch GROUP BY ALL) t
    ON t.case_id = c.case_id AND t.target = n.target)"""
