"""Queries over region tables, score tables and run histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import break_even, entity_of
from ..functions.runtime import cut
from ..operators import evaluation as ev, history as hist, modelling as ml
from ..operators.groups import assign_folds
from ..operators.ranking import average_ranks, exact_percentiles
from .registry import big, query, r6
from .views import table, view, with_views

FLOOR = 50
P_STAR = 0.55
_REGIONS = with_views("regions", "refs")


def regions_of(spark, d):
    return view(spark, d, "regions")


def refs_of(spark, d):
    """Reference rows with the list of matched regions."""
    regions = view(spark, d, "regions")
    ids = regions.groupBy("case_id", "class_name", "ref_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("matched"), F.col("comp_id")))).alias("matched_comp_ids")
    )
    return view(spark, d, "refs").join(ids, ["case_id", "class_name", "ref_id"])


@query("decidable_regions", with_views("regions") + "SELECT class_name, COUNT(*) AS n FROM regions WHERE n_cells >= 50 GROUP BY 1")
def _(spark, d):
    return ev.decidable(regions_of(spark, d)).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


@query("derived_features", with_views("regions") + """
SELECT comp_id, round(ln(n_cells), 6) AS log_n_voxels, round(ln(1 + dist_to_dominant_mm), 6) AS log1p_dist, round(log10(mean_prob + 1e-9), 6) AS log_mc_var
FROM regions""")
def _(spark, d):
    out = ml.with_derived(regions_of(spark, d).withColumn("mc_mean_var", F.col("mean_prob")))
    return out.select("comp_id", r6("log_n_voxels"), r6("log1p_dist"), r6("log_mc_var"))


def _rename_table(spark, d):
    own, other = F.col("mean_prob"), F.col("posterior")
    return regions_of(spark, d).withColumns({
        "runner_up_value": F.when(F.col("ref_id") % 5 != 0, F.col("ref_id") % 3 + 2).cast("int"),
        "runner_up_prob": other, "mean_prob": own,
        "ref_majority_value": F.when(F.col("matched"), F.col("ref_id") % 3 + 2).otherwise(0).cast("int"),
        "prob_c0": 1.0 - own, "case_id": F.concat(F.lit("E-"), F.col("case_id").cast("string"), F.lit("-"), F.col("ref_id").cast("string")),
    })


@query("rename_features", with_views("regions") + """
SELECT comp_id, round(mean_prob - posterior, 6) AS margin, round(ln((posterior + 1e-6) / (mean_prob + 1e-6)), 6) AS log_ratio,
  CASE WHEN ref_id % 3 + 2 = 3 THEN 1e0 ELSE 0e0 END AS ru_is_3, CASE WHEN ref_id % 3 + 2 = 4 THEN 1e0 ELSE 0e0 END AS ru_is_4
FROM regions WHERE n_cells >= 50 AND ref_id % 5 <> 0""")
def _(spark, d):
    rows, _ = ml.rename_features(ml.eligible(_rename_table(spark, d)), [2, 3, 4])
    return rows.select("comp_id", r6("margin"), r6("log_ratio"), "ru_is_3", "ru_is_4")


@query("entity_of_case", "SELECT DISTINCT regexp_replace(source || '-' || lang || '-' || CAST(doc_id AS VARCHAR), '-[^-]*$', '') AS entity_id FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    case_id = F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select(entity_of(case_id).alias("entity_id")).distinct()


def scores_of(spark, d, after=False):
    s = view(spark, d, "scores")
    return s.withColumn("lesion_dice", F.col("lesion_after")) if after else s


@query("summarise_present", with_views("scores") + """
SELECT target, round(avg(dice) FILTER (WHERE present), 6) AS dice_where_present, round(avg(lesion_dice) FILTER (WHERE present), 6) AS lesion_where_present,
  COUNT(*) FILTER (WHERE present) AS n_present, round(avg(dice), 6) AS dice_all_cases, round(avg(lesion_dice), 6) AS lesion_all_cases FROM scores GROUP BY 1""")
def _(spark, d):
    out = ev.summarise_present(scores_of(spark, d))
    return out.select("target", r6("dice_where_present"), r6("lesion_where_present"), "n_present", r6("dice_all_cases"), r6("lesion_all_cases"))


@query("summarise_targets", with_views("scores") + """
SELECT target, round(avg(lesion_dice) FILTER (WHERE present), 6) AS lesion, CAST(SUM(lesions_false) FILTER (WHERE present) AS BIGINT) AS false_lesions,
  CAST(SUM(lesions_missed) FILTER (WHERE present) AS BIGINT) AS missed_lesions, COUNT(*) FILTER (WHERE present) AS n,
  CAST(SUM(lesions_false) AS BIGINT) AS false_all_cases FROM scores GROUP BY 1""")
def _(spark, d):
    out = ev.summarise(scores_of(spark, d))
    return out.select("target", r6("lesion"), "false_lesions", "missed_lesions", "n", "false_all_cases")


@query("mean_over_targets", with_views("scores") + """
SELECT round(avg(m), 6) AS mean_lesion FROM (SELECT target, avg(lesion_dice) FILTER (WHERE present) AS m FROM scores GROUP BY 1) t""")
def _(spark, d):
    return ev.mean_lesion(ev.summarise(scores_of(spark, d))).select(r6("mean_lesion"))


@query("case_mean_score", with_views("scores") + "SELECT case_id, round(avg(lesion_dice) FILTER (WHERE present) + 1e-9, 6) AS mean_lesion_dice FROM scores GROUP BY 1")
def _(spark, d):
    return ev.case_mean(scores_of(spark, d)).select("case_id", r6(F.col("mean_lesion_dice") + 1e-9, "mean_lesion_dice"))


@query("estimate_stakes", _REGIONS + """
, r AS (SELECT class_name, avg(dice) AS l, COUNT(*) AS n FROM refs GROUP BY GROUPING SETS ((class_name), ())),
c AS (SELECT class_name, avg(dice_with_matched) FILTER (WHERE matched AND rank_by_volume > 1) AS dm, avg(dice_with_matched) FILTER (WHERE matched) AS da,
  COUNT(*) FILTER (WHERE matched AND rank_by_volume > 1) AS nm FROM regions WHERE n_cells >= 50 GROUP BY GROUPING SETS ((class_name), ()))
SELECT c.class_name, round(l, 6) AS l_value, n AS n_ref, round(dm, 6) AS d_value, nm AS n_marginal, round(da, 6) AS d_all_matched,
  round(l / (l + dm), 6) AS p_star, round(l / (l + da), 6) AS p_star_all_matched FROM r JOIN c ON r.class_name IS NOT DISTINCT FROM c.class_name""")
def _(spark, d):
    out = ev.estimate_stakes(ev.decidable(regions_of(spark, d)), refs_of(spark, d))
    return out.select(
        "class_name", r6("l_value"), "n_ref", r6("d_value"), "n_marginal", r6("d_all_matched"), r6("p_star"), r6("p_star_all_matched")
    )


_AUC = """SELECT {keys} SUM(pos * (below + neg / 2e0)) / (SUM(pos) * SUM(neg)) AS auc FROM (
  SELECT {keys} pos, neg, SUM(neg) OVER (PARTITION BY {part} ORDER BY s) - neg AS below FROM (
    SELECT {keys} s, COUNT(*) FILTER (WHERE y) AS pos, COUNT(*) FILTER (WHERE NOT y) AS neg FROM {source} GROUP BY ALL) g) h"""


@query("auc", with_views("regions") + ", x AS (SELECT mean_prob AS s, matched AS y FROM regions WHERE n_cells >= 50) SELECT round(auc, 6) AS auc FROM ("
       + _AUC.format(keys="", part="1", source="x") + ") q")
def _(spark, d):
    return ev.auc(ev.decidable(regions_of(spark, d)), "mean_prob", "matched").select(r6("auc"))


_FEATURES = ("mean_prob", "n_cells", "dist_to_dominant_mm", "rank_by_volume")
_LONG = ", lng AS (" + " UNION ALL ".join(
    f"SELECT class_name, '{f}' AS feature, CAST({f} AS DOUBLE) AS s, matched AS y FROM regions WHERE n_cells >= 50" for f in _FEATURES
) + "), x AS (SELECT 'all' AS scope, feature, s, y FROM lng UNION ALL SELECT class_name, feature, s, y FROM lng)"


@query("feature_aucs", with_views("regions") + _LONG + """
SELECT q.scope, q.feature, n, n_matched, round(auc, 6) AS auc FROM (""" + _AUC.format(keys="scope, feature,", part="scope, feature", source="x") + """
 GROUP BY scope, feature) q JOIN (SELECT scope, feature, COUNT(*) AS n, COUNT(*) FILTER (WHERE y) AS n_matched FROM x GROUP BY 1, 2) c USING (scope, feature)""")
def _(spark, d):
    return ev.feature_aucs(ev.decidable(regions_of(spark, d)), _FEATURES).select("scope", "feature", "n", "n_matched", r6("auc"))


@query("diagnose_features", with_views("regions") + _LONG.replace("n_cells >= 50", "n_cells >= 60") + """
SELECT q.scope, q.feature, n, n_matched, round(auc, 6) AS auc FROM (""" + _AUC.format(keys="scope, feature,", part="scope, feature", source="x") + """
 GROUP BY scope, feature) q JOIN (SELECT scope, feature, COUNT(*) AS n, COUNT(*) FILTER (WHERE y) AS n_matched FROM x GROUP BY 1, 2) c USING (scope, feature)""")
def _(spark, d):
    rows = regions_of(spark, d).withColumn("mc_mean_var", F.lit(None).cast("double"))
    return ml.diagnose(rows, (*_FEATURES, "mc_mean_var"), floor=60).select("scope", "feature", "n", "n_matched", r6("auc"))


_BIN = " + ".join(f"CASE WHEN p >= {b / 10}e0 THEN 1 ELSE 0 END" for b in range(1, 10))
_CURVE = with_views("regions") + f""", c AS (SELECT {_BIN} AS bin, avg(p) AS mean_p, avg(CASE WHEN matched THEN 1e0 ELSE 0e0 END) AS observed, COUNT(*) AS n
  FROM (SELECT *, posterior AS p FROM regions) t GROUP BY 1 HAVING COUNT(*) >= 5)"""


@query("reliability_curve", _CURVE + " SELECT bin, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed, n FROM c")
def _(spark, d):
    out = ev.reliability(regions_of(spark, d), "posterior", "matched")
    return out.select("bin", r6("mean_p"), r6("observed"), "n")


@query("calibration_error", _CURVE + " SELECT round(SUM(n * abs(mean_p - observed)) / SUM(n), 6) AS ece, CAST(SUM(n) AS BIGINT) AS n FROM c")
def _(spark, d):
    out = ev.calibration_error(ev.reliability(regions_of(spark, d), "posterior", "matched"))
    return out.select(r6("ece"), "n")


_DETECT = _REGIONS + """
, cr AS (SELECT r.case_id, r.class_name, r.ref_id, max(CASE WHEN c.n_cells < 50 THEN 1e9 ELSE c.posterior END) AS crit
  FROM refs r LEFT JOIN regions c ON c.case_id = r.case_id AND c.class_name = r.class_name AND c.ref_id = r.ref_id AND c.matched GROUP BY 1, 2, 3),
nc AS (SELECT COUNT(DISTINCT case_id) AS n FROM regions)"""


@query("detection_curve", _DETECT + """
, t AS (SELECT unnest(generate_series(0, 100)) / 100e0 AS threshold),
a AS (SELECT threshold, COUNT(*) AS n_ref, COUNT(*) FILTER (WHERE crit >= threshold) AS n_detected FROM t, cr GROUP BY 1),
b AS (SELECT threshold, COUNT(*) FILTER (WHERE posterior >= threshold) AS n_fp FROM t, regions WHERE NOT matched AND n_cells >= 50 GROUP BY 1)
SELECT threshold, round(n_detected / CAST(n_ref AS DOUBLE), 6) AS sensitivity, round(n_fp / CAST((SELECT n FROM nc) AS DOUBLE), 6) AS fp_per_case,
  n_ref, n_detected, n_fp FROM a JOIN b USING (threshold)""")
def _(spark, d):
    regions, refs = regions_of(spark, d), refs_of(spark, d)
    n = regions.select("case_id").distinct().count()
    out = ev.detection_curve(regions, refs, n, [s / 100 for s in range(101)])
    return out.select("threshold", r6("sensitivity"), r6("fp_per_case"), "n_ref", "n_detected", "n_fp")


@query("detection_summary", _DETECT + """
, t AS (SELECT * FROM (VALUES (0e0, 'before'), (0.55e0, 'after')) v(threshold, stage)),
sc AS (SELECT 'all' AS scope, crit FROM cr UNION ALL SELECT class_name, crit FROM cr),
sf AS (SELECT 'all' AS scope, posterior FROM regions WHERE NOT matched AND n_cells >= 50 UNION ALL SELECT class_name, posterior FROM regions WHERE NOT matched AND n_cells >= 50),
a AS (SELECT scope, threshold, stage, COUNT(*) AS n_ref, COUNT(*) FILTER (WHERE crit >= threshold) AS n_detected FROM t, sc GROUP BY ALL),
b AS (SELECT scope, threshold, COUNT(*) FILTER (WHERE posterior >= threshold) AS n_fp FROM t, sf GROUP BY ALL)
SELECT scope, stage, round(n_detected / CAST(n_ref AS DOUBLE), 6) AS sensitivity, round(n_fp / CAST((SELECT n FROM nc) AS DOUBLE), 6) AS fp_per_case,
  n_ref, n_detected, n_fp FROM a JOIN b USING (scope, threshold)""")
def _(spark, d):
    regions, refs = regions_of(spark, d), refs_of(spark, d)
    n = regions.select("case_id").distinct().count()
    out = ev.detection_summary(regions, refs, P_STAR, n)
    return out.select("scope", "stage", r6("sensitivity"), r6("fp_per_case"), "n_ref", "n_detected", "n_fp")


@query("distance_tradeoff", with_views("regions", "refs", "scores") + """
, alive AS (SELECT case_id, class_name, ref_id, bool_or(n_cells < 50 OR posterior >= 0.55) AS ok FROM regions WHERE matched GROUP BY 1, 2, 3),
far AS (SELECT b.band, r.case_id, r.detected AND NOT COALESCE(ok, false) AS lost FROM refs r LEFT JOIN alive USING (case_id, class_name, ref_id),
  (VALUES (10e0), (20e0), (40e0)) b(band) WHERE dist_to_dominant_mm > b.band),
pc AS (SELECT band, case_id, COUNT(*) AS f, COUNT(*) FILTER (WHERE lost) AS l FROM far GROUP BY 1, 2),
dl AS (SELECT case_id, avg(lesion_after) FILTER (WHERE present) - avg(lesion_dice) FILTER (WHERE present) AS dd FROM scores GROUP BY 1)
SELECT b.band, (SELECT CAST(SUM(f) AS BIGINT) FROM pc WHERE pc.band = b.band) AS n_beyond, (SELECT COUNT(*) FROM pc WHERE pc.band = b.band) AS n_cases_with_one,
  (SELECT CAST(SUM(l) AS BIGINT) FROM pc WHERE pc.band = b.band) AS n_deleted, (SELECT COUNT(*) FROM pc WHERE pc.band = b.band AND l > 0) AS n_cases_hurt,
  (SELECT round(avg(dd), 6) FROM dl SEMI JOIN (SELECT * FROM pc WHERE pc.band = b.band) z USING (case_id)) AS delta_on_those,
  (SELECT round(avg(dd), 6) FROM dl ANTI JOIN (SELECT * FROM pc WHERE pc.band = b.band) z USING (case_id)) AS delta_on_rest
FROM (VALUES (10e0), (20e0), (40e0)) b(band)""")
def _(spark, d):
    regions = regions_of(spark, d)
    decisions = regions.withColumn("keep", (F.col("n_cells") < 50) | (F.col("posterior") >= P_STAR))
    out = ev.distance_tradeoff(refs_of(spark, d), decisions, scores_of(spark, d), scores_of(spark, d, after=True))
    return out.select("band", "n_beyond", "n_cases_with_one", "n_deleted", "n_cases_hurt", r6("delta_on_those"), r6("delta_on_rest"))


@query("separation_histograms", with_views("regions") + """
, lng AS (SELECT class_name, 'mean_prob' AS feature, mean_prob AS v, matched FROM regions UNION ALL SELECT class_name, 'dist_to_dominant_mm', dist_to_dominant_mm, matched FROM regions),
lim AS (SELECT class_name, feature, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM lng GROUP BY 1, 2),
b AS (SELECT class_name, feature, matched, CAST(least(floor((v - lo) / ((hi - lo) / 35)), 34) AS INT) AS bin, (hi - lo) / 35 AS w FROM lng JOIN lim USING (class_name, feature) WHERE v BETWEEN lo AND hi)
SELECT class_name, feature, matched, bin, COUNT(*) AS n, round(COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY class_name, feature, matched) * any_value(w)), 5) AS density
FROM b GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    out = ev.separation_histograms(regions_of(spark, d), ["mean_prob", "dist_to_dominant_mm"])
    return out.select("class_name", "feature", "matched", "bin", "n", F.round("density", 5).alias("density"))


@query("feature_means", with_views("regions") + """
SELECT class_name, 'mean_prob' AS feature, round(avg(mean_prob) FILTER (WHERE matched), 6) AS "real", round(avg(mean_prob) FILTER (WHERE NOT matched), 6) AS spurious FROM regions GROUP BY 1
UNION ALL SELECT class_name, 'n_cells', round(avg(n_cells) FILTER (WHERE matched), 6), round(avg(n_cells) FILTER (WHERE NOT matched), 6) FROM regions GROUP BY 1""")
def _(spark, d):
    out = ev.feature_means(regions_of(spark, d), ["mean_prob", "n_cells"])
    return out.select("class_name", "feature", r6("real"), r6("spurious"))


@query("miss_rate_by_size", _REGIONS + """
SELECT CASE WHEN n_cells >= 400 THEN 3 WHEN n_cells >= 200 THEN 2 WHEN n_cells >= 100 THEN 1 ELSE 0 END AS band, COUNT(*) AS n_refs,
  round(avg(CASE WHEN detected THEN 0e0 ELSE 1e0 END), 6) AS miss_rate FROM refs GROUP BY 1""")
def _(spark, d):
    return ev.miss_rate_by_size(view(spark, d, "refs"), [100, 200, 400]).select("band", "n_refs", r6("miss_rate"))


@query("median_size_by_outcome", _REGIONS + "SELECT detected, median(CAST(n_cells AS DOUBLE)) AS median_cells FROM refs GROUP BY 1")
def _(spark, d):
    return ev.median_size_by_outcome(view(spark, d, "refs"))


@query("compare_runs", with_views("scores") + """
, m AS (SELECT case_id, avg(lesion_dice) FILTER (WHERE present) AS b, avg(lesion_after) FILTER (WHERE present) AS a FROM scores GROUP BY 1)
SELECT COUNT(*) FILTER (WHERE round(a - b, 12) > 0.01) AS improved, COUNT(*) FILTER (WHERE round(a - b, 12) < -0.01) AS worse,
  COUNT(*) FILTER (WHERE round(abs(a - b), 12) <= 0.01) AS unchanged,
  COUNT(*) FILTER (WHERE b = 0 AND a > 0) AS newly_fixed, COUNT(*) FILTER (WHERE b > 0 AND a = 0) AS newly_failed FROM m""")
def _(spark, d):
    return ev.compare_runs(scores_of(spark, d), scores_of(spark, d, after=True))


@query("score_bands", with_views("scores") + """
, m AS (SELECT 'before' AS run, case_id, round(avg(lesion_dice) FILTER (WHERE present), 12) AS s FROM scores GROUP BY 2
  UNION ALL SELECT 'after', case_id, round(avg(lesion_after) FILTER (WHERE present), 12) FROM scores GROUP BY 2)
SELECT run, COUNT(*) FILTER (WHERE s < 0.2) AS band_0, COUNT(*) FILTER (WHERE s >= 0.2 AND s < 0.5) AS band_1, COUNT(*) FILTER (WHERE s >= 0.5 AND s < 0.8) AS band_2,
  COUNT(*) FILTER (WHERE s >= 0.8 AND s < 0.9) AS band_3, COUNT(*) FILTER (WHERE s >= 0.9) AS band_4 FROM m GROUP BY 1""")
def _(spark, d):
    runs = [
        ev.case_mean(scores_of(spark, d, after=a)).withColumn("run", F.lit(n)) for n, a in (("before", False), ("after", True))
    ]
    return ev.score_bands(runs[0].unionByName(runs[1]))


@query("class_epoch_dice", with_views("regions") + """
SELECT ref_id AS epoch, class_name, round(avg(CASE WHEN n_cells + rank_by_volume = 0 THEN 1e0 ELSE 2e0 * least(n_cells, rank_by_volume) / (n_cells + rank_by_volume) END), 6) AS mean_dice
FROM regions GROUP BY 1, 2""")
def _(spark, d):
    rows = regions_of(spark, d).select(
        F.col("ref_id").alias("epoch"), "class_name", F.col("n_cells").alias("n_pred"), F.col("rank_by_volume").alias("n_ref"),
        F.least("n_cells", "rank_by_volume").alias("n_shared"),
    )
    return ev.class_epoch_dice(rows).select("epoch", "class_name", r6("mean_dice"))


_SPREAD = with_views("scores") + """
, m AS (SELECT case_id, round(avg(lesion_dice), 6) AS mean_lesion_dice FROM scores GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY mean_lesion_dice, case_id) AS position, COUNT(*) OVER () AS total FROM m)"""


@query("pick_spread", _SPREAD + """
SELECT case_id, mean_lesion_dice, position FROM r WHERE position IN (SELECT CAST(round_even(s * ((SELECT max(total) FROM r) - 1) / 7e0, 0) AS BIGINT) + 1
  FROM (SELECT unnest(generate_series(0, 7)) AS s) g)""")
def _(spark, d):
    scored = ev.case_mean(scores_of(spark, d), only_present=False).select("case_id", r6("mean_lesion_dice"))
    return ev.pick_spread(scored, 8)


@query("pick_worst", _SPREAD + "SELECT case_id, mean_lesion_dice FROM r WHERE position <= 8")
def _(spark, d):
    scored = ev.case_mean(scores_of(spark, d), only_present=False).select("case_id", r6("mean_lesion_dice"))
    return ev.pick_spread(scored, 8, how="worst")


_LOST = with_views("regions") + """, c AS (SELECT case_id, COUNT(*) FILTER (WHERE posterior < 0.55 AND matched) AS lost, COUNT(*) FILTER (WHERE posterior < 0.55 AND NOT matched) AS won
  FROM regions WHERE n_cells >= 50 GROUP BY 1)"""


@query("pick_costly_cases", _LOST + " SELECT case_id, lost, won FROM c ORDER BY lost DESC, won DESC, case_id LIMIT 10")
def _(spark, d):
    return ev.pick_cases(regions_of(spark, d).withColumn("keep", F.col("posterior") >= P_STAR), 10)


@query("pick_winning_cases", _LOST + " SELECT case_id, lost, won FROM c ORDER BY won DESC, lost, case_id LIMIT 10")
def _(spark, d):
    return ev.pick_cases(regions_of(spark, d).withColumn("keep", F.col("posterior") >= P_STAR), 10, "win")


@query("run_summary", with_views("history") + """
SELECT run, max(val_mean) AS best, CAST(arg_min(epoch, (-val_mean, epoch)) AS INT) AS best_epoch, COUNT(*) AS n_epochs, round(SUM(secs) / 3600, 6) AS hours FROM history GROUP BY 1""")
def _(spark, d):
    out = hist.run_summary(view(spark, d, "history"))
    return out.select("run", "best", "best_epoch", "n_epochs", r6("hours"))


@query("best_so_far", with_views("history") + """
SELECT run, epoch, val_mean FROM (SELECT *, max(val_mean) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM history) t
WHERE b IS NULL OR val_mean > b""")
def _(spark, d):
    return hist.best_so_far(view(spark, d, "history")).where("is_best").select("run", "epoch", "val_mean")


@query("bursts", """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, SUM(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, CAST(burst AS BIGINT) AS burst, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, COUNT(*) AS n_events FROM b GROUP BY 1, 2""")
def _(spark, d):
    out = hist.bursts(table(spark, d, "events"), entity="user_id", ts="ts", gap_seconds=6 * 3600, order=[F.col("event_id")])
    return out.select(
        "user_id", big("burst"), F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"),
        F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "n_events",
    )


@query("assign_folds", with_views("regions") + """
SELECT case_id, CAST((row_number() OVER (ORDER BY md5(concat(CAST(case_id AS VARCHAR), ':0')), case_id) - 1) % 5 AS INT) AS fold
FROM (SELECT DISTINCT case_id FROM regions) t""")
def _(spark, d):
    return assign_folds(regions_of(spark, d))


@query("feature_medians", with_views("regions") + """
SELECT 'mean_prob' AS feature, median(mean_prob) AS median FROM regions UNION ALL SELECT 'dist_to_dominant_mm', median(dist_to_dominant_mm) FROM regions
UNION ALL SELECT 'posterior', median(posterior) FROM regions""")
def _(spark, d):
    long = ev.long_features(regions_of(spark, d), ["mean_prob", "dist_to_dominant_mm", "posterior"])
    return exact_percentiles(long, ["feature"], "value", {"median": 0.5})


_MODEL = ml.Model(
    ["mean_prob", "log_n_voxels", "log1p_dist"], ["click", "error", "purchase", "signup", "view"],
    ["mean_prob", "log_n_voxels", "log1p_dist", "is_error", "is_purchase", "is_signup", "is_view"],
    {"mean_prob": 0.5, "log_n_voxels": 4.0, "log1p_dist": 3.0}, [0.5, 4.5, 3.0, 0.2, 0.2, 0.2, 0.2],
    [0.25, 0.5, 1.0, 0.4, 0.4, 0.4, 0.4], [1.25, 0.75, -0.5, 0.125, -0.25, 0.0, 0.5], 0.3,
)


@query("posterior_from_model", with_views("regions") + """
SELECT comp_id, round(1 / (1 + exp(-(0.3e0 + 1.25e0 * (mean_prob - 0.5e0) / 0.25e0 + 0.75e0 * (ln(n_cells) - 4.5e0) / 0.5e0 - 0.5e0 * (ln(1 + dist_to_dominant_mm) - 3e0)
  + 0.125e0 * (CASE WHEN class_name = 'error' THEN 1 ELSE 0 END - 0.2e0) / 0.4e0 - 0.25e0 * (CASE WHEN class_name = 'purchase' THEN 1 ELSE 0 END - 0.2e0) / 0.4e0
  + 0.5e0 * (CASE WHEN class_name = 'view' THEN 1 ELSE 0 END - 0.2e0) / 0.4e0))), 6) AS posterior FROM regions""")
def _(spark, d):
    out = ml.with_posterior(ml.with_derived(regions_of(spark, d)), _MODEL)
    return out.select("comp_id", r6("posterior"))


@query("break_even_threshold", _REGIONS + "SELECT class_name, round(avg(dice) / (avg(dice) + 0.5e0), 6) AS p_star FROM refs GROUP BY 1")
def _(spark, d):
    means = view(spark, d, "refs").groupBy("class_name").agg(F.avg("dice").alias("l"))
    return means.select("class_name", r6(break_even("l", F.lit(0.5)), "p_star"))


def _fit_rows(spark, d):
    return cut(ml.with_derived(ev.decidable(regions_of(spark, d))))


_FIT = ("log_n_voxels", "mean_prob", "log1p_dist")


@query("tie_averaged_ranks", with_views("regions") + """
SELECT class_name, comp_id, rank() OVER w + (COUNT(*) OVER (PARTITION BY class_name, n_cells) - 1) / 2e0 AS size_rank FROM regions WINDOW w AS (PARTITION BY class_name ORDER BY n_cells)""")
def _(spark, d):
    rows = regions_of(spark, d).select("class_name", "comp_id", "n_cells")
    return average_ranks(rows, ["class_name"], "n_cells", "size_rank").drop("n_cells")


# Newton steps for one standardised feature and an intercept, by fold; fold -1 holds nobody out.
_NEWTON = with_views("regions").replace("WITH ", "WITH RECURSIVE ", 1) + """
, fold AS (SELECT case_id, (row_number() OVER (ORDER BY md5(concat(CAST(case_id AS VARCHAR), ':0')), case_id) - 1) % 5 AS fold
  FROM (SELECT DISTINCT case_id FROM regions WHERE n_cells >= 50) t),
base AS MATERIALIZED (SELECT r.case_id, comp_id, mean_prob AS x0, CASE WHEN matched THEN 1e0 ELSE 0e0 END AS y, fold FROM regions r JOIN fold USING (case_id) WHERE n_cells >= 50),
st AS MATERIALIZED (SELECT f, avg(x0) AS mu, stddev_pop(x0) AS sd FROM base, (SELECT unnest(generate_series(-1, 4)) AS f) g WHERE fold <> f GROUP BY f),
tr AS MATERIALIZED (SELECT f, (x0 - mu) / sd AS x, y FROM base JOIN st ON fold <> f),
nw(f, n, b0, b1) AS (SELECT f, 0, 0e0, 0e0 FROM st UNION ALL
  SELECT f, n + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT nw.f, n, b0, b1, SUM(p - y) AS g0, SUM((p - y) * x) + b1 AS g1, SUM(p * (1 - p)) AS h00, SUM(p * (1 - p) * x) AS h01, SUM(p * (1 - p) * x * x) + 1 AS h11
    FROM nw JOIN (SELECT * FROM tr) t ON t.f = nw.f, LATERAL (SELECT 1 / (1 + exp(-(b0 + b1 * x))) AS p) q WHERE n < 25 GROUP BY nw.f, n, b0, b1) s)"""


@query("fit_one_feature", _NEWTON + " SELECT round(b1, 4) AS coefficient, round(b0, 4) AS intercept FROM nw WHERE n = 25 AND f = -1")
def _(spark, d):
    model = ml.fit_selector(_fit_rows(spark, d), ["mean_prob"], classes=[])
    return spark.range(1).select(
        F.round(F.lit(model.coef[0]), 4).alias("coefficient"), F.round(F.lit(model.intercept), 4).alias("intercept")
    )


@query("out_of_fold_one_feature", _NEWTON + """
SELECT comp_id, round(1 / (1 + exp(-(b0 + b1 * (x0 - mu) / sd))), 4) AS posterior FROM base JOIN nw ON nw.f = fold AND n = 25 JOIN st ON st.f = fold""")
def _(spark, d):
    rows = _fit_rows(spark, d).withColumn("class_name", F.lit("one"))
    return ml.out_of_fold(rows, ["mean_prob"]).select("comp_id", F.round("posterior", 4).alias("posterior"))


@query("fit_selector")
def _(spark, d):
    model = ml.fit_selector(_fit_rows(spark, d), _FIT)
    return ml.coefficients(model, spark).select("column_name", F.round("coefficient", 4).alias("coefficient"))


@query("out_of_fold_posterior")
def _(spark, d):
    out = ml.out_of_fold(_fit_rows(spark, d), _FIT)
    return out.select("case_id", "class_name", "comp_id", "fold", F.round("posterior", 4).alias("posterior"))


@query("optimism_check")
def _(spark, d):
    regions, refs = cut(ml.with_derived(regions_of(spark, d).drop("posterior"))), cut(refs_of(spark, d))
    rows = ev.decidable(regions)
    model = ml.fit_selector(rows, _FIT)
    n = regions.select("case_id").distinct().count()
    out = ml.optimism(regions, refs, ml.with_posterior(rows, model), ml.out_of_fold(rows, _FIT), P_STAR, n)
    return out.select("stage", F.round("sensitivity", 4).alias("sensitivity"), F.round("fp_per_case", 4).alias("fp_per_case"))


@query("fit_renamer")
def _(spark, d):
    return ml.fit_renamer(cut(_rename_table(spark, d))).diagnostics


@query("selector_fit_job")
def _(spark, d):
    regions = regions_of(spark, d).drop("posterior").withColumns({
        "mc_mean_var": F.lit(None).cast("double"), "rank_by_prob": F.col("rank_by_volume"),
    })
    return ml.fit_job(cut(regions), cut(refs_of(spark, d))).calibration
