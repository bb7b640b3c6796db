"""Leakage-safe grouping, splits and folds by entity."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import seeded_key
from .labelling import contract
from .ranking import ranked

# Fixed values of the split: shares in order of preference on ties.
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}


def cases_by_entity(cases: DataFrame) -> DataFrame:
    """Cases of every entity in order: ``entity_id, position, case_id, n_cases``.

    One row per case rather than one list per entity, so a frequent entity stays spread out.
    """
    placed = ranked(cases.select("entity_id", "case_id"), ["entity_id"], [F.col("case_id")], "position")
    sizes = cases.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_cases"))
    return placed.join(sizes, "entity_id").select("entity_id", "position", "case_id", "n_cases")


def cross_entity_links(pairs: DataFrame) -> DataFrame:
    """Entity links from the described pair table.

    Where copies hang on one representative these connect the same entities; ``audit.entity_links`` lists all.
    """
    return pairs.where(~F.col("same_entity")).select(
        F.col("entity_id_a").alias("a"), F.col("entity_id_b").alias("b")
    ).distinct()


def leak_safe_groups(cases: DataFrame, links: DataFrame | None) -> DataFrame:
    """Group of every entity: entities joined by links share the smallest id among them."""
    entities = cases.select("entity_id").distinct()
    if links is None:
        return entities.withColumn("group_id", F.col("entity_id"))
    roots = contract(links.select("a", "b")).select(
        F.col("node").alias("entity_id"), F.col("root").alias("group_id")
    )
    return entities.join(roots, "entity_id", "left").withColumn("group_id", F.coalesce("group_id", "entity_id"))


def _quotas(sizes: Sequence[tuple[int, int]], ratios: Mapping[str, float]) -> list[tuple[int, str, int, int]]:
    """How many groups of each size every split takes: ``(size, split, first, last)`` positions.

    Largest sizes first; each group goes to the split with the largest relative deficit.
    Groups of one size are interchangeable, so the levels are solved at once and only the
    last few picks of a size are made one by one.
    """
    total = sum(size * n for size, n in sizes)
    target = {s: r * total for s, r in ratios.items()}
    scale = {s: max(t, 1) for s, t in target.items()}
    count = dict.fromkeys(ratios, 0)
    out = []
    for size, n in sorted(sizes, reverse=True):
        low, high = -1.0 - size * n, 2.0
        for _ in range(200):
            level = (low + high) / 2
            if sum(max(0.0, (target[s] - count[s] - level * scale[s]) / size) for s in ratios) > n:
                low = level
            else:
                high = level
        taken = {s: max(0, math.floor((target[s] - count[s] - high * scale[s]) / size) - 2) for s in ratios}
        for _ in range(n - sum(taken.values())):
            best = max(ratios, key=lambda s: (target[s] - count[s] - size * taken[s]) / scale[s])
            taken[best] += 1
        first = 1
        for s in ratios:
            if taken[s]:
                out.append((size, s, first, first + taken[s] - 1))
                first += taken[s]
            count[s] += size * taken[s]
    return out


def assign_splits(
    cases: DataFrame, groups: DataFrame, ratios: Mapping[str, float] = RATIOS, *, seed: int = 42
) -> DataFrame:
    """Split of every case: whole groups, largest first, to the split furthest below its share.

    The driver sees the histogram of group sizes, never the groups.  Which groups of a size
    fill a split's quota is decided by a seeded hash.
    """
    members = cases.join(groups, "entity_id")
    sized = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_size"))
    histogram = [(r._size, r.n) for r in sized.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()]
    quotas = cases.sparkSession.createDataFrame(
        _quotas(histogram, ratios), "_size long, split string, _first long, _last long"
    )
    placed = ranked(sized, ["_size"], [seeded_key(seed, "group_id"), F.col("group_id")], "_pos")
    chosen = placed.join(quotas, "_size").where(F.col("_pos").between(F.col("_first"), F.col("_last")))
    return members.join(chosen.select("group_id", "split"), "group_id").select(
        "case_id", "entity_id", "group_id", "split", F.lit(seed).alias("seed")
    )


def audit_splits(splits: DataFrame) -> DataFrame:
    """Cases, share and entities of every split."""
    counts = splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_distinct("entity_id").alias("n_entities")
    )
    total = splits.groupBy().agg(F.count(F.lit(1)).alias("_t")).first()._t
    return counts.withColumn("share", F.col("n_cases") / F.lit(total))


def split_leaks(splits: DataFrame) -> DataFrame:
    """Cases and entities that occur in more than one split; empty when the split is safe."""
    found = []
    for kind in ("case_id", "entity_id"):
        found.append(
            splits.groupBy(F.col(kind).cast("string").alias("key")).agg(F.count_distinct("split").alias("n_splits"))
            .where("n_splits > 1").select(F.lit(kind).alias("kind"), "key", "n_splits")
        )
    return found[0].unionByName(found[1])


def select_split(splits: DataFrame, name: str) -> DataFrame:
    return splits.where(F.col("split") == name).select("case_id")


def split_cases(cases: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    """Join-ready records of one split: image paths in modality order, label and id."""
    paths = F.transform(F.array_sort(F.map_keys("images")), lambda m: F.element_at(F.col("images"), m))
    return cases.join(select_split(splits, name), "case_id", "left_semi").select(
        paths.alias("image"), "label", "case_id"
    )


def assign_folds(rows: DataFrame, *, by: str = "case_id", k: int = 5, seed: int = 0) -> DataFrame:
    """Fold of every distinct ``by`` value; fold sizes differ by at most one."""
    keys = rows.select(by).distinct()
    placed = ranked(keys, [], [seeded_key(seed, by), F.col(by)], "_pos")
    return placed.select(by, F.pmod(F.col("_pos") - 1, F.lit(k)).cast("int").alias("fold"))
