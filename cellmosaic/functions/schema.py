"""Declared schemas of the stored tables; a missing column fails at read time."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    out = T.StructType()
    for item in text.split(", "):
        name, kind = item.split(" ", 1)
        out = out.add(name, T._parse_datatype_string(kind) if "<" in kind else _SIMPLE[kind])
    return out


_SIMPLE = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "ints": T.ArrayType(T.IntegerType()), "doubles": T.ArrayType(T.DoubleType()),
    "strings": T.ArrayType(T.StringType()), "paths": T.MapType(T.StringType(), T.StringType()),
    "timestamp": T.TimestampType(),
}

CASES = _struct(
    "dataset string, subset string, case_id string, entity_id string, timepoint string, images paths, label string"
)
CELLS = _struct("case_id string, i int, j int, k int, value int")
PROBS = _struct("case_id string, i int, j int, k int, p doubles")
REGIONS = _struct(
    "case_id string, class_name string, class_value int, comp_id int, n_cells long, volume_mm3 double, "
    "centroid_i double, centroid_j double, centroid_k double, mean_prob double, p90_prob double, "
    "max_prob double, mean_border_prob double, mc_mean_var double, dist_to_dominant_mm double, "
    "rank_by_volume int, rank_by_prob int, n_comps_in_class int, matched boolean, matched_ref_ids ints, "
    "dice_with_matched double, prob_c0 double, prob_c1 double, prob_c2 double, prob_c3 double, prob_c4 double, "
    "runner_up_value int, runner_up_prob double, ref_majority_value int, ref_tumour_frac double"
)
REFS = _struct(
    "case_id string, class_name string, class_value int, ref_id int, n_cells long, volume_mm3 double, "
    "dist_to_dominant_mm double, detected boolean, dice double, matched_comp_ids ints"
)
SCORES = _struct(
    "case_id string, target string, dice double, lesion_dice double, lesions_missed int, lesions_false int, "
    "present boolean"
)
PAIRS = _struct(
    "case_a string, case_b string, entity_id_a string, entity_id_b string, similarity double, same_entity boolean, "
    "same_file boolean, subset_a string, subset_b string, dataset_a string, dataset_b string"
)
HISTORY = _struct("epoch int, loss double, lr double, secs double, val_mean double, val_per_class doubles")
LEDGER = _struct("run string, split string, model_hash string, applied_at timestamp")
