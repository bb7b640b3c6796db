"""Queries over cells: aggregates, geometry and averaging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import dealt
from ..operators import geometry as geo, volumes as vol
from ..operators.matching import explode_targets, volumetric_dice
from .registry import big, query, r6
from .views import GRID_EDGE, TARGET_CODES, TARGETS, view, with_views

CLASSES = {1: "NETC", 2: "SNFH", 3: "ET", 4: "RC"}
EDGE = (GRID_EDGE,) * 3


def grid_of(spark, d, spacing=(1.0, 1.0, 1.0)):
    return geo.make_grid(view(spark, d, "cases"), EDGE, spacing)


@query("volumetric_dice", with_views("pred", "ref", "cases") + """
SELECT c.case_id, COALESCE(p.n, 0) AS n_pred, COALESCE(r.n, 0) AS n_ref, COALESCE(s.n, 0) AS n_shared,
  round(CASE WHEN COALESCE(p.n, 0) = 0 AND COALESCE(r.n, 0) = 0 THEN 1e0
             WHEN COALESCE(p.n, 0) = 0 OR COALESCE(r.n, 0) = 0 THEN 0e0
             ELSE 2e0 * COALESCE(s.n, 0) / (p.n + r.n) END, 6) AS dice
FROM cases c LEFT JOIN (SELECT case_id, COUNT(*) n FROM pred GROUP BY 1) p USING (case_id)
LEFT JOIN (SELECT case_id, COUNT(*) n FROM ref GROUP BY 1) r USING (case_id)
LEFT JOIN (SELECT case_id, COUNT(*) n FROM pred JOIN ref USING (case_id, i, j, k) GROUP BY 1) s USING (case_id)""")
def _(spark, d):
    out = volumetric_dice(view(spark, d, "pred"), view(spark, d, "ref"), view(spark, d, "cases"), ["case_id"])
    return out.select("case_id", big("n_pred"), big("n_ref"), big("n_shared"), r6("dice"))


@query("cell_agreement", with_views("pred", "ref") + """
SELECT case_id, CASE WHEN p.value IS NOT NULL AND r.value IS NOT NULL THEN 'both'
  WHEN r.value IS NOT NULL THEN 'reference_only' ELSE 'prediction_only' END AS agreement, COUNT(*) AS n
FROM pred p FULL JOIN ref r USING (case_id, i, j, k) GROUP BY 1, 2""")
def _(spark, d):
    out = geo.agreement(view(spark, d, "pred"), view(spark, d, "ref"))
    return out.groupBy("case_id", "agreement").agg(F.count(F.lit(1)).alias("n"))


@query("composite_targets", with_views("pred") + f"""
SELECT case_id, n.name AS target, COUNT(*) AS n FROM pred JOIN {TARGET_CODES.replace('bridge(', 'n(')}
ON n.value = pred.value GROUP BY 1, 2""")
def _(spark, d):
    return explode_targets(view(spark, d, "pred"), TARGETS).groupBy("case_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("class_mask", with_views("pred") + "SELECT value, COUNT(*) AS n_cells, COUNT(DISTINCT case_id) AS n_cases FROM pred GROUP BY value")
def _(spark, d):
    return view(spark, d, "pred").groupBy("value").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("case_id").alias("n_cases")
    )


@query("class_histogram", with_views("ref", "cases") + """
SELECT case_id, CAST(1728 AS BIGINT) AS vox_total,
  COUNT(*) FILTER (WHERE value = 1) AS vox_NETC, COUNT(*) FILTER (WHERE value = 2) AS vox_SNFH,
  COUNT(*) FILTER (WHERE value = 3) AS vox_ET, COUNT(*) FILTER (WHERE value = 4) AS vox_RC,
  COUNT(*) FILTER (WHERE value > 0) AS vox_foreground
FROM cases LEFT JOIN ref USING (case_id) GROUP BY case_id""")
def _(spark, d):
    return vol.class_histogram(view(spark, d, "ref"), grid_of(spark, d), CLASSES)


@query("foreground_extent", with_views("ref") + """
SELECT case_id, round(avg(i), 6) AS centroid_i, round(avg(j), 6) AS centroid_j, round(avg(k), 6) AS centroid_k,
  min(i) AS i_min, min(j) AS j_min, min(k) AS k_min, max(i) AS i_max, max(j) AS j_max, max(k) AS k_max
FROM ref GROUP BY case_id""")
def _(spark, d):
    out = vol.foreground_extent(view(spark, d, "ref"))
    return out.select(
        "case_id", *[r6(f"centroid_{c}") for c in "ijk"], *[f"{c}_min" for c in "ijk"], *[f"{c}_max" for c in "ijk"]
    )


@query("scan_stats", with_views("volume", "cases") + """
SELECT case_id, round(COALESCE(max(v), 0), 6) AS v_max, round(COUNT(*) FILTER (WHERE v > 0) / 1728e0, 6) AS nonzero_frac,
  '12x12x12' AS shape, '1.00x0.75x2.50' AS spacing
FROM cases LEFT JOIN volume USING (case_id) GROUP BY case_id""")
def _(spark, d):
    out = vol.scan_stats(view(spark, d, "volume"), grid_of(spark, d, (1.0, 0.75, 2.5)))
    return out.select("case_id", r6("v_max"), r6("nonzero_frac"), "shape", "spacing")


@query("case_index", with_views("volume", "ref", "cases") + """
SELECT case_id, round(COALESCE(v.m, 0), 6) AS v_max, round(COALESCE(v.n, 0) / 1728e0, 6) AS nonzero_frac,
  COALESCE(r.n, 0) AS vox_foreground, round(r.ci, 6) AS centroid_i, r.k_max
FROM cases LEFT JOIN (SELECT case_id, max(v) AS m, COUNT(*) FILTER (WHERE v > 0) AS n FROM volume GROUP BY 1) v USING (case_id)
LEFT JOIN (SELECT case_id, COUNT(*) AS n, avg(i) AS ci, max(k) AS k_max FROM ref GROUP BY 1) r USING (case_id)""")
def _(spark, d):
    out = vol.case_stats(view(spark, d, "volume"), view(spark, d, "ref"), grid_of(spark, d), CLASSES)
    return out.select("case_id", r6("v_max"), r6("nonzero_frac"), "vox_foreground", r6("centroid_i"), "k_max")


@query("occupancy_heatmap", with_views("ref") + """
SELECT value, CAST(floor(i / 2e0) AS INT) AS i, CAST(floor(j / 2e0) AS INT) AS j, CAST(floor(k / 2e0) AS INT) AS k,
  COUNT(DISTINCT case_id) AS n_cases FROM ref GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return vol.occupancy(view(spark, d, "ref"), grid_of(spark, d), shape=EDGE)


@query("class_prevalence", with_views("ref", "cases") + """
, total AS (SELECT COUNT(*) AS n FROM cases),
peak AS (SELECT value, max(n) AS m FROM (SELECT value, floor(i / 2e0) a, floor(j / 2e0) b, floor(k / 2e0) c,
  COUNT(DISTINCT case_id) AS n FROM ref GROUP BY 1, 2, 3, 4) t GROUP BY 1),
here AS (SELECT value, COUNT(DISTINCT case_id) AS n FROM ref GROUP BY 1)
SELECT c.name AS class_name, total.n AS n_cases, COALESCE(here.n, 0) AS present_cases,
  round(100e0 * COALESCE(here.n, 0) / total.n, 6) AS present_pct, COALESCE(peak.m, 0) AS peak_cases,
  round(100e0 * COALESCE(peak.m, 0) / total.n, 6) AS peak_pct
FROM (VALUES (1,'NETC'),(2,'SNFH'),(3,'ET'),(4,'RC')) c(value, name) CROSS JOIN total
LEFT JOIN here ON here.value = c.value LEFT JOIN peak ON peak.value = c.value""")
def _(spark, d):
    ref, grid = view(spark, d, "ref"), grid_of(spark, d)
    out = vol.prevalence(vol.class_histogram(ref, grid, CLASSES), vol.occupancy(ref), CLASSES)
    return out.select(
        "class_name", "n_cases", "present_cases", r6("present_pct"), big("peak_cases"), r6("peak_pct")
    )


@query("clip_normalise", with_views("volume") + """
, lv AS (SELECT case_id, quantile_cont(v, 0.99) AS q FROM volume WHERE v > 0 GROUP BY 1)
SELECT case_id, i, j, k, round(greatest(0e0, least(v / greatest(q, 1e-6), 1e0)), 6) AS v FROM volume JOIN lv USING (case_id)""")
def _(spark, d):
    return vol.clip_normalise(view(spark, d, "volume")).select("case_id", "i", "j", "k", r6("v"))


@query("mean_template", with_views("volume", "cases") + """
, chosen AS (SELECT case_id FROM cases ORDER BY md5(concat(CAST(case_id AS VARCHAR), ':0')), case_id LIMIT 40),
lv AS (SELECT case_id, quantile_cont(v, 0.99) AS q FROM volume WHERE v > 0 GROUP BY 1),
norm AS (SELECT v.case_id, i, j, k, greatest(0e0, least(v / greatest(q, 1e-6), 1e0)) AS v
  FROM volume v JOIN lv USING (case_id) JOIN chosen USING (case_id))
SELECT CAST(floor(i / 2e0) AS INT) AS i, CAST(floor(j / 2e0) AS INT) AS j, CAST(floor(k / 2e0) AS INT) AS k,
  round(SUM(v) / 8e0 / (SELECT COUNT(*) FROM chosen), 6) AS v FROM norm GROUP BY 1, 2, 3""")
def _(spark, d):
    out = vol.mean_template(view(spark, d, "volume"), view(spark, d, "cases"), n=40)
    return out.select("i", "j", "k", r6("v"))


@query("seeded_sample", with_views("cases") + """
SELECT case_id FROM cases ORDER BY md5(concat(CAST(case_id AS VARCHAR), ':0')), case_id LIMIT 40""")
def _(spark, d):
    return vol.seeded_sample(view(spark, d, "cases"), 40)


@query("first_cases", with_views("cases") + "SELECT case_id FROM cases ORDER BY case_id LIMIT 25")
def _(spark, d):
    return view(spark, d, "cases").orderBy("case_id").limit(25)


@query("downsample_mean", with_views("volume") + """
SELECT case_id, CAST(floor(i / 2e0) AS INT) AS i, CAST(floor(j / 2e0) AS INT) AS j, CAST(floor(k / 2e0) AS INT) AS k,
  round(SUM(v) / 8e0, 6) AS v FROM volume GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return geo.downsample(view(spark, d, "volume"), how="mean").select("case_id", "i", "j", "k", r6("v"))


@query("mirror_cells", with_views("ref") + """
, mid AS (SELECT case_id, CAST(round_even(avg(i), 0) AS INT) AS m FROM ref GROUP BY 1)
SELECT case_id, CAST((2 * m - i + 24) % 12 AS INT) AS i, j, k, value FROM ref JOIN mid USING (case_id)""")
def _(spark, d):
    ref = view(spark, d, "ref")
    return geo.mirror(ref, geo.midline(ref), grid_of(spark, d)).select("case_id", "i", "j", "k", "value")


@query("reorient_cells", with_views("ref") + """
SELECT case_id, 11 - i AS i, CASE WHEN case_id % 2 = 0 THEN j ELSE 11 - j END AS j, k, value FROM ref""")
def _(spark, d):
    axes = grid_of(spark, d).withColumns(
        {"flip_i": F.lit(True), "flip_j": F.col("case_id") % 2 != 0, "flip_k": F.lit(False)}
    )
    return geo.reorient(view(spark, d, "ref"), axes)


_REGRID = """
, axis_map AS (
  SELECT a, t, t * (1e0 / s) AS x, m FROM (
    SELECT a, s, CAST(round_even(11 * s / 1e0, 0) AS INT) + 1 AS m FROM (VALUES ('i', 1e0), ('j', 0.75e0), ('k', 2.5e0)) g(a, s)) q,
  LATERAL (SELECT unnest(generate_series(0, m - 1)) AS t) u)
"""


@query("regrid_nearest", with_views("ref") + _REGRID + """
SELECT r.case_id, CAST(a.t AS INT) AS i, CAST(b.t AS INT) AS j, CAST(c.t AS INT) AS k, r.value FROM ref r
JOIN axis_map a ON a.a = 'i' AND CAST(round_even(a.x, 0) AS INT) = r.i
JOIN axis_map b ON b.a = 'j' AND CAST(round_even(b.x, 0) AS INT) = r.j
JOIN axis_map c ON c.a = 'k' AND CAST(round_even(c.x, 0) AS INT) = r.k""")
def _(spark, d):
    out = geo.regrid_nearest(view(spark, d, "ref"), grid_of(spark, d, (1.0, 0.75, 2.5)))
    return out.select("case_id", "i", "j", "k", "value")


@query("regrid_linear", with_views("volume") + _REGRID + """
, axis_w AS (SELECT a, t, n, 1e0 - abs(least(x, 11e0) - n) AS w FROM axis_map,
  LATERAL (SELECT unnest(generate_series(0, 11)) AS n) s WHERE abs(least(x, 11e0) - n) < 1)
SELECT r.case_id, CAST(a.t AS INT) AS i, CAST(b.t AS INT) AS j, CAST(c.t AS INT) AS k, round(SUM(a.w * b.w * c.w * r.v), 6) AS v
FROM volume r JOIN axis_w a ON a.a = 'i' AND a.n = r.i JOIN axis_w b ON b.a = 'j' AND b.n = r.j
JOIN axis_w c ON c.a = 'k' AND c.n = r.k GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    out = geo.regrid_linear(view(spark, d, "volume"), grid_of(spark, d, (1.0, 0.75, 2.5)))
    return out.select("case_id", "i", "j", "k", r6("v"))


@query("standardise", with_views("volume") + """
, s AS (SELECT case_id, avg(v) AS m, stddev_pop(v) AS sd FROM volume WHERE v <> 0 GROUP BY 1)
SELECT case_id, i, j, k, round(CASE WHEN v <> 0 THEN (v - m) / CASE WHEN sd = 0 THEN 1e0 ELSE sd END ELSE 0e0 END, 6) AS v
FROM volume JOIN s USING (case_id)""")
def _(spark, d):
    return vol.standardise(view(spark, d, "volume"), ["case_id"]).select("case_id", "i", "j", "k", r6("v"))


@query("crop_foreground", with_views("volume", "ref") + """
, box AS (SELECT case_id, min(i) a, max(i) b, min(j) c, max(j) e, min(k) f, max(k) g FROM ref WHERE value = 4 GROUP BY 1)
SELECT case_id, i - a AS i, j - c AS j, k - f AS k, round(v, 6) AS v FROM volume JOIN box USING (case_id)
WHERE i BETWEEN a AND b AND j BETWEEN c AND e AND k BETWEEN f AND g""")
def _(spark, d):
    out = geo.crop_foreground(view(spark, d, "volume"), view(spark, d, "ref").where("value = 4"))
    return out.select("case_id", "i", "j", "k", r6("v"))


@query("context_slab", with_views("volume", "ref", "pred", "cases") + """
, span AS (SELECT case_id, min(k) lo, max(k) hi FROM (SELECT case_id, k FROM pred WHERE value = 1
  UNION ALL SELECT case_id, k FROM ref WHERE value = 1) t GROUP BY 1),
rng AS (SELECT c.case_id, CASE WHEN lo IS NULL THEN 6 - 3 ELSE greatest(0, lo - 1) END AS a,
  CASE WHEN hi IS NULL THEN 6 + 3 ELSE least(12, hi + 2) END AS b FROM cases c LEFT JOIN span USING (case_id))
SELECT case_id, a AS k_from, b AS k_to, COUNT(*) AS n FROM volume JOIN rng USING (case_id) WHERE k >= a AND k < b GROUP BY ALL""")
def _(spark, d):
    one = [view(spark, d, n).where("value = 1") for n in ("pred", "ref")]
    out = geo.context_slab(view(spark, d, "volume"), *one, grid_of(spark, d), margin=1, fallback=3)
    return out.groupBy("case_id", "k_from", "k_to").agg(F.count(F.lit(1)).alias("n"))


@query("max_projection", with_views("volume") + "SELECT case_id, i, j, round(max(v), 6) AS v FROM volume GROUP BY 1, 2, 3")
def _(spark, d):
    return geo.max_projection(view(spark, d, "volume"), "k").select("case_id", "i", "j", r6("v"))


@query("brain_mask", with_views("volume") + """
, n AS (SELECT case_id, COUNT(*) AS c, quantile_cont(v, 0.25) AS q FROM volume WHERE v > 0 GROUP BY 1)
SELECT case_id, i, j, k FROM volume JOIN n USING (case_id) WHERE v > 0 AND (c / 1728e0 <= 0.29 OR v > q)""")
def _(spark, d):
    return vol.brain_mask(view(spark, d, "volume"), grid_of(spark, d), dense=0.29)


@query("depth_in_mask", with_views("volume", "ref") + """
, mask AS (SELECT case_id, i, j, k FROM volume),
full_grid AS (SELECT DISTINCT case_id, a.x AS i, b.x AS j, c.x AS k FROM (SELECT DISTINCT case_id FROM mask) m,
  (SELECT unnest(generate_series(0, 11)) x) a, (SELECT unnest(generate_series(0, 11)) x) b, (SELECT unnest(generate_series(0, 11)) x) c),
outside AS (SELECT g.* FROM full_grid g ANTI JOIN mask USING (case_id, i, j, k)),
inside AS (SELECT r.* FROM ref r SEMI JOIN mask USING (case_id, i, j, k)),
dist AS (SELECT r.case_id, r.i, r.j, r.k, min((r.i - o.i) * (r.i - o.i) + (r.j - o.j) * (r.j - o.j) * 0.5625e0
  + (r.k - o.k) * (r.k - o.k) * 6.25e0) AS d2 FROM inside r JOIN outside o ON o.case_id = r.case_id GROUP BY ALL)
SELECT case_id, i, j, k, round(COALESCE(sqrt(d2), 0e0), 6) AS depth FROM ref LEFT JOIN dist USING (case_id, i, j, k)""")
def _(spark, d):
    out = geo.depth_in_mask(view(spark, d, "ref"), view(spark, d, "volume"), grid_of(spark, d, (1.0, 0.75, 2.5)))
    return out.select("case_id", "i", "j", "k", r6("depth"))


@query("shell_three_steps", with_views("ref") + """
, moves AS (SELECT a.x di, b.x dj, c.x dk FROM (SELECT unnest(generate_series(-3, 3)) x) a, (SELECT unnest(generate_series(-3, 3)) x) b,
  (SELECT unnest(generate_series(-3, 3)) x) c WHERE abs(a.x) + abs(b.x) + abs(c.x) BETWEEN 1 AND 3),
near AS (SELECT DISTINCT case_id, value, CAST(i + di AS INT) AS i, CAST(j + dj AS INT) AS j, CAST(k + dk AS INT) AS k FROM ref, moves)
SELECT case_id, value, COUNT(*) AS n_cells, CAST(SUM(i * 144 + j * 12 + k) AS BIGINT) AS code
FROM near n ANTI JOIN ref r USING (case_id, value, i, j, k)
WHERE i BETWEEN 0 AND 11 AND j BETWEEN 0 AND 11 AND k BETWEEN 0 AND 11 GROUP BY 1, 2""")
def _(spark, d):
    out = geo.shell(view(spark, d, "ref"), ["case_id", "value"], steps=3, grid=grid_of(spark, d))
    return out.groupBy("case_id", "value").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(F.expr("i * 144 + j * 12 + k")).alias("code")
    )


_PASSES = """
, members AS (SELECT case_id, i, j, k, l_linenumber AS member, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'i' WHEN 2 THEN 'jk' ELSE 'ik' END AS flip,
    max(l_quantity) / 60e0 AS q FROM placed GROUP BY 1, 2, 3, 4, 5)"""


def _members(spark, d, alone=False):
    """Members of every cell; ``alone`` deals the rows by cell first, for queries that keep every cell where it is."""
    placed = view(spark, d, "placed")
    if alone:
        placed = dealt(placed.select("case_id", "i", "j", "k", "l_linenumber", "l_quantity"), placed.count(), "case_id", "i", "j", "k")
    flips = F.element_at(F.array(*[F.lit(f) for f in ("", "i", "jk", "ik")]), F.col("l_linenumber") % 4 + 1)
    return placed.groupBy("case_id", "i", "j", "k", F.col("l_linenumber").alias("member"), flips.alias("flip")).agg(
        (F.max("l_quantity") / 60.0).alias("q")
    )


def _probabilities(members):
    return members.select(
        "case_id", "member", "flip", "i", "j", "k",
        F.explode(F.array(*[
            F.struct(F.lit(0).alias("class_value"), (1.0 - F.col("q")).alias("p")),
            F.struct(F.lit(1).alias("class_value"), (F.col("q") * 0.6).alias("p")),
            F.struct(F.lit(2).alias("class_value"), (F.col("q") * 0.4).alias("p")),
        ])).alias("_x"),
    ).select("case_id", "member", "flip", "i", "j", "k", "_x.class_value", "_x.p")


@query("pass_variance", with_views("placed") + _PASSES + """
, p AS (SELECT case_id, i, j, k, 0 AS class_value, 1 - q AS p FROM members UNION ALL SELECT case_id, i, j, k, 1, q * 0.6e0 FROM members
  UNION ALL SELECT case_id, i, j, k, 2, q * 0.4e0 FROM members)
SELECT case_id, i, j, k, class_value, round(COALESCE(var_samp(p), 0e0), 6) AS variance FROM p GROUP BY 1, 2, 3, 4, 5""")
def _(spark, d):
    out = vol.pass_variance(_probabilities(_members(spark, d, alone=True)))
    return out.select("case_id", "i", "j", "k", "class_value", r6("variance"))


@query("ensemble_average", with_views("placed") + _PASSES + """
, u AS (SELECT case_id, CASE WHEN contains(flip, 'i') THEN 11 - i ELSE i END AS i, CASE WHEN contains(flip, 'j') THEN 11 - j ELSE j END AS j,
  CASE WHEN contains(flip, 'k') THEN 11 - k ELSE k END AS k, q FROM members),
p AS (SELECT case_id, i, j, k, avg(1 - q) AS p0, avg(q * 0.6e0) AS p1, avg(q * 0.4e0) AS p2 FROM u GROUP BY 1, 2, 3, 4),
r AS (SELECT *, round(p0, 12) AS r0, round(p1, 12) AS r1, round(p2, 12) AS r2 FROM p)
SELECT case_id, i, j, k, round(p0, 6) AS p0, round(p1, 6) AS p1, CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END AS value FROM r""")
def _(spark, d):
    members = _members(spark, d).select(
        "case_id", "flip", "i", "j", "k", F.array(1.0 - F.col("q"), F.col("q") * 0.6, F.col("q") * 0.4).alias("p")
    )
    mean = vol.average_arrays(vol.undo_flips(members, grid_of(spark, d)), 3)
    return mean.select(
        "case_id", "i", "j", "k", r6(F.col("p")[0], "p0"), r6(F.col("p")[1], "p1"), vol.predicted_place().alias("value")
    )


@query("ensemble_long", with_views("placed") + _PASSES + """
, u AS (SELECT case_id, CASE WHEN contains(flip, 'i') THEN 11 - i ELSE i END AS i, CASE WHEN contains(flip, 'j') THEN 11 - j ELSE j END AS j,
  CASE WHEN contains(flip, 'k') THEN 11 - k ELSE k END AS k, q FROM members),
p AS (SELECT case_id, i, j, k, round(avg(1 - q), 12) AS p0, round(avg(q * 0.6e0), 12) AS p1, round(avg(q * 0.4e0), 12) AS p2 FROM u GROUP BY 1, 2, 3, 4)
SELECT case_id, i, j, k, CASE WHEN p1 >= p2 THEN 1 ELSE 2 END AS value FROM p WHERE NOT (p0 >= p1 AND p0 >= p2)""")
def _(spark, d):
    mean = vol.average_members(vol.undo_flips(_probabilities(_members(spark, d)), grid_of(spark, d)))
    return vol.predicted_class(mean)


@query("merge_windows", with_views("placed") + """
, w AS (SELECT case_id, i, j, k, i - CAST(l_linenumber AS INT) AS oi, j - CAST(l_quantity AS INT) % 6 AS oj, k - CAST(l_tax * 100 AS INT) % 6 AS ok,
  l_quantity / 60e0 AS p FROM placed),
g AS (SELECT *, exp(-(power(i - oi - 3.5e0, 2) + power(j - oj - 3.5e0, 2) + power(k - ok - 3.5e0, 2)) / 2e0) AS wt FROM w)
SELECT case_id, i, j, k, 1 AS class_value, round(SUM(wt * p) / SUM(wt), 6) AS p FROM g GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    windows = view(spark, d, "placed").select(
        "case_id", "i", "j", "k", F.lit(1).alias("class_value"), (F.col("l_quantity") / 60.0).alias("p"),
        (F.col("i") - F.col("l_linenumber")).alias("oi"), (F.col("j") - F.col("l_quantity").cast("int") % 6).alias("oj"),
        (F.col("k") - F.round(F.col("l_tax") * 100).cast("int") % 6).alias("ok"),
    )
    return vol.merge_windows(windows, size=8).select("case_id", "i", "j", "k", "class_value", r6("p"))


@query("class_balanced_centres", with_views("ref", "cases") + """
, sz AS (SELECT case_id, value, COUNT(*) AS n, CASE value WHEN 1 THEN 2e0 WHEN 2 THEN 2e0 WHEN 3 THEN 3e0 ELSE 2e0 END AS w FROM ref GROUP BY 1, 2),
sh AS (SELECT *, SUM(w) OVER (PARTITION BY case_id ORDER BY value) / SUM(w) OVER (PARTITION BY case_id) AS hi,
  (SUM(w) OVER (PARTITION BY case_id ORDER BY value) - w) / SUM(w) OVER (PARTITION BY case_id) AS lo FROM sz),
dr AS (SELECT case_id, draw,
  CAST(('0x' || substr(md5(concat_ws(':', CAST(case_id AS VARCHAR), CAST(draw AS VARCHAR), '0c')), 1, 8)) AS BIGINT) / 4294967296e0 AS u,
  CAST(('0x' || substr(md5(concat_ws(':', CAST(case_id AS VARCHAR), CAST(draw AS VARCHAR), '0p')), 1, 8)) AS BIGINT) / 4294967296e0 AS v
  FROM cases, (SELECT unnest([0, 1]) AS draw) q),
pk AS (SELECT dr.case_id, draw, value, CAST(floor(v * n) AS BIGINT) + 1 AS pos FROM dr JOIN sh ON sh.case_id = dr.case_id AND u >= lo AND u < hi),
nm AS (SELECT *, row_number() OVER (PARTITION BY case_id, value ORDER BY i, j, k) AS pos FROM ref)
SELECT case_id, draw, value, i, j, k, i - 4 AS i_from, i + 4 AS i_to FROM pk JOIN nm USING (case_id, value, pos)""")
def _(spark, d):
    out = vol.class_balanced_centres(view(spark, d, "ref"), view(spark, d, "cases"), patch=(8, 8, 8))
    return out.select("case_id", "draw", "value", "i", "j", "k", "i_from", "i_to")


@query("content_hash", with_views("volume") + """
, lines AS (SELECT case_id, i, j, md5(string_agg(concat_ws(':', CAST(k AS VARCHAR), CAST(v AS VARCHAR)), ',' ORDER BY k)) AS h FROM volume WHERE v <> 0 GROUP BY 1, 2, 3),
planes AS (SELECT case_id, i, md5(string_agg(concat_ws(':', CAST(j AS VARCHAR), h), ',' ORDER BY j)) AS h FROM lines GROUP BY 1, 2)
SELECT case_id, md5(string_agg(concat_ws(':', CAST(i AS VARCHAR), h), ',' ORDER BY i)) AS content_md5 FROM planes GROUP BY 1""")
def _(spark, d):
    return vol.content_hash(view(spark, d, "volume"))


@query("fingerprint", with_views("volume") + """
, axis_w AS (SELECT t, n, 1e0 - abs(t * (11 / 5e0) - n) AS w FROM (SELECT unnest(generate_series(0, 5)) AS t) a,
  (SELECT unnest(generate_series(0, 11)) AS n) b WHERE abs(t * (11 / 5e0) - n) < 1),
z AS (SELECT r.case_id, a.t AS i, b.t AS j, c.t AS k, SUM(a.w * b.w * c.w * r.v) AS v FROM volume r
  JOIN axis_w a ON a.n = r.i JOIN axis_w b ON b.n = r.j JOIN axis_w c ON c.n = r.k GROUP BY 1, 2, 3, 4),
s AS (SELECT case_id, avg(v) AS m, stddev_pop(v) + 1e-6 AS sd FROM z WHERE v > 0 GROUP BY 1),
slots AS (SELECT case_id, unnest(generate_series(0, 215)) AS slot FROM s)
SELECT case_id, CAST(slot AS INT) AS slot, round((COALESCE(v, 0) - m) / sd, 3) AS z FROM slots JOIN s USING (case_id)
LEFT JOIN (SELECT case_id, (i * 6 + j) * 6 + k AS slot, v FROM z) y USING (case_id, slot)""")
def _(spark, d):
    fp = vol.fingerprint(view(spark, d, "volume"), grid_of(spark, d), edge=6)
    return fp.select("case_id", F.posexplode("embedding").alias("slot", "z")).select(
        "case_id", "slot", F.round(F.col("z").cast("double"), 3).alias("z")
    )


@query("cell_volume", with_views("ref") + """
SELECT case_id, COUNT(*) AS n_cells, round(COUNT(*) * 1.875e0, 6) AS volume_mm3 FROM ref GROUP BY 1""")
def _(spark, d):
    axes = [[F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.45), F.lit(0.6)], [F.lit(0.0), F.lit(-2.0), F.lit(1.5)]]
    si, sj, sk = geo.spacing_from_affine(axes)
    counts = view(spark, d, "ref").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_cells"))
    sized = counts.withColumns({"si": si, "sj": sj, "sk": sk})
    return sized.select("case_id", "n_cells", r6(F.col("n_cells") * geo.cell_volume(), "volume_mm3"))
