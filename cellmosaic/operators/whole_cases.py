"""Regions and depths of cases whose array fits a tile, measured where the case's cells meet.

Such a case is bounded by its array, so a task that holds it labels both masks, matches and
measures their regions, and gives one row per region.  Masks, probabilities and geometry meet in
one exchange; cells, labels and numbers of regions are never joined.  Tasks follow the cells that
the arrays can hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.runtime import dealt
from .geometry import _DENSE, _around
from .labelling import _label_tiles, changes, per_tile

CELL = ("i", "j", "k")
GEOMETRY, PRED, REF, PROBS, VARIANCE = range(5)


def fits(tile: int) -> Column:
    """If the array of a ``grid`` row lies in the first tile."""
    return F.coalesce((F.col("ni") <= tile) & (F.col("nj") <= tile) & (F.col("nk") <= tile), F.lit(False))


def wide_cases(masks: Sequence[DataFrame], grid: DataFrame, tile: int) -> DataFrame:
    """``case_id`` of the cases whose array, or a cell of a mask, reaches beyond the first tile."""
    out = grid.where(~fits(tile)).select("case_id")
    inside = [F.coalesce(F.col(c).between(0, tile - 1), F.lit(False)) for c in CELL]
    for cells in masks:
        out = out.unionByName(cells.where(~(inside[0] & inside[1] & inside[2])).select("case_id"))
    return out.distinct()


def _starts(sorted_ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(sorted_ids, prepend=-1))


def _found(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every ``wanted`` code in the sorted ``known`` ones and if it is there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    spot = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return spot, known[spot] == wanted


def _squared_distances(group: np.ndarray, cells: np.ndarray, targets: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Squared distance of every cell to the nearest ``targets`` cell of its group; axis by axis over blocks of groups."""
    out = np.full(len(cells), np.inf)
    if not len(cells):
        return out
    edge = cells.max(0) + 1
    step = max(1, _DENSE // int(edge.prod()))
    for low in range(0, int(group[-1]) + 1, step):
        rows = np.arange(*np.searchsorted(group, [low, low + step]))
        goal = rows[targets[rows]]
        if not len(goal):
            continue
        high = int(group[rows[-1]]) + 1
        block = np.full((high - low, *edge), np.inf)
        block[group[goal] - low, cells[goal, 0], cells[goal, 1], cells[goal, 2]] = 0.0
        for axis in range(3):
            shape = [1, 1, 1, 1]
            shape[axis + 1] = -1
            places, near = np.arange(edge[axis]).reshape(shape), np.full_like(block, np.inf)
            for s in range(edge[axis]):
                away = (gap[low:high, axis].reshape(-1, 1, 1, 1) * (places - s)) ** 2
                np.minimum(near, np.take(block, [s], axis + 1) + away, out=near)
            block = near
        out[rows] = block[group[rows] - low, cells[rows, 0], cells[rows, 1], cells[rows, 2]]
    return out


@dataclass
class _Cases:
    """Both masks of whole cases: cells as arrays in the order of mask, class and place, and regions numbered in that order."""

    table: pa.Table
    tile: int
    values: list[int]
    mass: Sequence[int]

    def __post_init__(self) -> None:
        table, tile, named = self.table, self.tile, [v for v in self.values if v != 0]
        self.case = np.cumsum(changes(table, ["case_id"]))
        self.first = np.concatenate([[0], np.flatnonzero(np.diff(self.case)) + 1])
        self.role, self.value = table["role"].to_numpy(), table["value"].to_numpy()
        lists = table["numbers"].combine_chunks()
        self.length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        self.blank, self.flat = flat.is_null().to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False)
        self.at = np.cumsum(self.length) - self.length
        place = np.stack([table[c].to_numpy() for c in CELL], 1).astype(np.int64)
        self.place = (place[:, 0] * tile + place[:, 1]) * tile + place[:, 2]
        shapes = np.flatnonzero(self.role == GEOMETRY)
        self.geometry = np.full((len(self.first), 6), np.nan)
        for n in range(6):
            self.geometry[self.case[shapes], n] = self.flat[self.at[shapes] + n]
        known = np.zeros(len(self.first), bool)
        known[self.case[shapes]] = True

        n_cells, n_classes = tile**3, len(named)
        rows = np.flatnonzero(((self.role == PRED) | (self.role == REF)) & known[self.case])
        kind = np.searchsorted(named, self.value[rows])
        side = (self.role[rows] == REF).astype(np.int64)
        key = np.unique(((self.case[rows] * 2 + side) * n_classes + kind) * n_cells + self.place[rows])
        self.part, self.cell_place = np.divmod(key, n_cells)  # a part is a class of a mask of a case
        self.cells = np.stack([self.cell_place // tile**2, self.cell_place // tile % tile, self.cell_place % tile], 1)
        self.group, rest = np.divmod(self.part, 2 * n_classes)
        self.side, self.kind = np.divmod(rest, n_classes)
        root = _label_tiles(self.part, self.cells, tile)
        heads = np.flatnonzero(root == np.arange(len(root)))
        number = np.zeros(len(root), np.int64)
        number[heads] = np.arange(len(heads))
        self.region = number[root]
        self.size = np.bincount(self.region, minlength=len(heads))
        self.region_part, self.region_group = self.part[heads], self.group[heads]
        self.region_side, self.region_kind = self.side[heads], self.kind[heads]
        self.comp = np.arange(len(heads)) - np.searchsorted(self.region_part, self.region_part) + 1
        self.named = np.array(named)
        self._overlap(n_classes)

    def _overlap(self, n_classes: int) -> None:
        """Pairs of regions of one class that share cells: predicted region, reference region, cells."""
        code = (self.group * n_classes + self.kind) * self.tile**3 + self.cell_place
        p, r = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        spot, hit = _found(code[r], code[p])
        n = max(1, len(self.size))
        pair, self.shared = np.unique(self.region[p[hit]] * n + self.region[r[spot[hit]]], return_counts=True)
        self.pred, self.ref = pair // n, pair % n

    def take(self, rows: np.ndarray) -> pa.Array:
        """``case_id`` of these cases."""
        return self.table["case_id"].combine_chunks().take(pa.array(self.first[rows]))

    def distances(self) -> np.ndarray:
        """Smallest distance of every region to the largest region over the mass classes; NaN without one."""
        rows = np.flatnonzero((self.side == 0) & np.isin(self.named[self.kind], self.mass))
        _, some = np.unique(self.group[rows] * self.tile**3 + self.cell_place[rows], return_index=True)
        rows = rows[some]
        root = _label_tiles(self.group[rows], self.cells[rows], self.tile)
        size = np.bincount(root, minlength=len(rows))[root]
        order = np.lexsort((root, -size, self.group[rows]))
        top = np.full(len(self.first), -1)
        heads = order[_starts(self.group[rows][order])]
        top[self.group[rows][heads]] = root[heads]
        chosen = rows[root == top[self.group[rows]]]
        code = self.group * self.tile**3 + self.cell_place
        by_case = np.argsort(code, kind="stable")
        _, goal = _found(np.sort(code[chosen]), code[by_case])
        d2 = np.empty(len(code))
        d2[by_case] = _squared_distances(self.group[by_case], self.cells[by_case], goal, self.geometry[:, 3:])
        low = np.full(len(self.size), np.inf)
        np.minimum.at(low, self.region, d2)
        return np.sqrt(np.where(np.isinf(low), np.nan, low))

    def probabilities(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes of the cells with probabilities, and these by class; the last row is that of an absent cell."""
        rows = np.flatnonzero(self.role == PROBS)
        code = self.case[rows] * self.tile**3 + self.place[rows]
        code, some = np.unique(code, return_index=True)
        rows = rows[some]
        out = np.zeros((len(rows) + 1, len(self.values)))
        for n, v in enumerate(self.values):
            out[:, n] = 1.0 if v == 0 else 0.0
            has = np.flatnonzero((self.length[rows] > v) & (v >= 0))
            spot = self.at[rows[has]] + v
            has, spot = has[~self.blank[spot]], spot[~self.blank[spot]]
            out[has, n] = self.flat[spot]
        return code, out

    def lists(self, owner: np.ndarray, other: np.ndarray, wanted: np.ndarray) -> pa.Array:
        """Sorted region numbers of the ``other`` side that each of the ``wanted`` regions touches."""
        order = np.lexsort((self.comp[other], owner))
        held = np.bincount(owner, minlength=len(self.size))[wanted]
        keep = order[np.isin(owner[order], wanted)]
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), pa.array(self.comp[other[keep]].astype(np.int32))
        )

    def ranks(self, wanted: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Position of each of the ``wanted`` regions in its class by falling ``value``, then by number."""
        part = self.region_part[wanted]
        order = np.lexsort((self.comp[wanted], np.where(np.isnan(value), -np.inf, -value), part))
        out = np.empty(len(wanted), np.int64)
        out[order] = np.arange(len(wanted)) - np.searchsorted(part, part[order]) + 1
        return out


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


def _batch(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: c if isinstance(c, pa.Array) else pa.array(c) for n, c in columns.items()})


def _predicted(cases: _Cases, min_cells: int, has_variance: bool) -> pa.RecordBatch:
    """One row per predicted region."""
    mine = np.flatnonzero(cases.region_side == 0)  # regions; a row of the output each
    spot = np.full(len(cases.size), -1)
    spot[mine] = np.arange(len(mine))
    cells = np.flatnonzero(cases.side == 0)
    at, n = spot[cases.region[cells]], cases.size[mine]
    total = lambda weights: np.bincount(at, weights, len(mine))
    code = cases.group[cells] * cases.tile**3 + cases.cell_place[cells]

    known, probs = cases.probabilities()
    columns_of = np.searchsorted(cases.values, cases.named)
    place, hit = _found(known, code)
    row = np.where(hit, place, len(known))
    own = probs[row, columns_of[cases.kind[cells]]]
    order = np.lexsort((own, at))
    first, ranked = _starts(at[order]), own[order]
    position = 0.9 * (n - 1)
    low, high = np.floor(position).astype(np.int64), np.ceil(position).astype(np.int64)
    p90 = ranked[first + low] + (ranked[first + high] - ranked[first + low]) * (position - low)
    mean = total(own) / n

    zero = np.zeros(len(cells), np.int32)
    shape = cases.geometry[cases.group[cells], :3].astype(np.int64)
    around = pa.table({
        **{c: cases.cells[cells, a] for a, c in enumerate(CELL)}, **{f"_t{c}": zero for c in CELL}, **{f"n{c}": shape[:, a] for a, c in enumerate(CELL)}
    })
    shell, near = _around(around, at, 1, cases.tile)
    near = (near[:, 0] * cases.tile + near[:, 1]) * cases.tile + near[:, 2]
    place, hit = _found(known, cases.region_group[mine[shell]] * cases.tile**3 + near)
    border = probs[np.where(hit, place, len(known)), columns_of[cases.region_kind[mine[shell]]]]
    n_shell = np.bincount(shell, minlength=len(mine))
    rim = np.where(n_shell > 0, np.bincount(shell, border, len(mine)) / np.maximum(1, n_shell), np.nan)

    scored = cases.size[cases.ref] >= min_cells
    p, r, shared = spot[cases.pred[scored]], cases.ref[scored], cases.shared[scored]
    met = np.bincount(p, shared, len(mine))
    other = np.bincount(p, cases.size[r], len(mine))
    out = {
        "case_id": cases.take(cases.region_group[mine]),
        "class_value": cases.named[cases.region_kind[mine]].astype(np.int32),
        "comp_id": cases.comp[mine].astype(np.int32),
        "n_cells": n,
        **{f"centroid_{c}": total(cases.cells[cells, a]) / n for a, c in enumerate(CELL)},
        "mean_prob": mean,
        "max_prob": np.maximum.reduceat(ranked, first) if len(first) else ranked,
        **{f"prob_c{v}": total(probs[row, m]) / n for m, v in enumerate(cases.values)},
    }
    for m, v in enumerate(cases.named):
        theirs = np.flatnonzero((cases.side == 1) & (cases.kind == m))
        under = _found(cases.group[theirs] * cases.tile**3 + cases.cell_place[theirs], code)[1]
        out[f"_under{v}"] = total(under).astype(np.int64)
    out |= {
        "p90_prob": p90,
        "rank_by_volume": cases.ranks(mine, n.astype(np.float64)),
        "rank_by_prob": cases.ranks(mine, mean),
        "n_comps_in_class": np.bincount(cases.region_part[mine])[cases.region_part[mine]] if len(mine) else n,
        "mean_border_prob": _nullable(rim),
        "dist_to_dominant_mm": _nullable(cases.distances()[mine]),
        "matched": met > 0,
        "matched_ref_ids": cases.lists(cases.pred[scored], r, mine),
        "dice_with_matched": 2.0 * met / (n + other),
        "false_positive": (met == 0) & (n >= min_cells),
        "_cell": cases.geometry[cases.region_group[mine], 3:].prod(1),
    }
    if has_variance:
        rows = np.flatnonzero(cases.role == VARIANCE)
        key = (cases.case[rows] * len(cases.named) + np.searchsorted(cases.named, cases.value[rows])) * cases.tile**3 + cases.place[rows]
        place, hit = _found(key, (cases.group[cells] * len(cases.named) + cases.kind[cells]) * cases.tile**3 + cases.cell_place[cells])
        out["mc_mean_var"] = total(np.where(hit, cases.flat[cases.at[rows]][place] if len(rows) else 0.0, 0.0)) / n
    return _batch(out)


def _reference(cases: _Cases, min_cells: int) -> pa.RecordBatch:
    """One row per reference region that is scored."""
    mine = np.flatnonzero((cases.region_side == 1) & (cases.size >= min_cells))
    met = np.bincount(cases.ref, cases.shared, len(cases.size))[mine]
    other = np.bincount(cases.ref, cases.size[cases.pred], len(cases.size))[mine]
    return _batch({
        "case_id": cases.take(cases.region_group[mine]),
        "class_value": cases.named[cases.region_kind[mine]].astype(np.int32),
        "ref_id": cases.comp[mine].astype(np.int32),
        "n_cells": cases.size[mine],
        "detected": met > 0,
        "dice": 2.0 * met / (cases.size[mine] + other),
        "matched_comp_ids": cases.lists(cases.ref, cases.pred, mine),
        "dist_to_dominant_mm": _nullable(cases.distances()[mine]),
        "_cell": cases.geometry[cases.region_group[mine], 3:].prod(1),
    })


def _met(masks: Sequence[DataFrame], grid: DataFrame, tile: int, *more: DataFrame) -> DataFrame:
    """Rows of whole cases side by side, each case in one task."""
    shapes = grid.where(fits(tile))
    room = shapes.agg(F.sum(F.col("ni").cast("long") * F.col("nj") * F.col("nk"))).first()[0] or 0
    numbers = F.array(*[F.col(c).cast("double") for c in ("ni", "nj", "nk", "si", "sj", "sk")])
    rows = shapes.select(
        "case_id", F.lit(GEOMETRY).alias("role"), F.lit(0).alias("value"), *[F.lit(0).alias(c) for c in CELL], numbers.alias("numbers")
    )
    nothing = F.lit(None).cast("array<double>").alias("numbers")
    place = [F.col(c).cast("int").alias(c) for c in CELL]
    for role, cells in ((PRED, masks[0]), (REF, masks[1])):
        rows = rows.unionByName(cells.select("case_id", F.lit(role).alias("role"), F.col("class_value").alias("value"), *place, nothing))
    for extra in more:
        inside = [F.col(c).between(0, tile - 1) for c in CELL]  # no other cell can be on a region or its shell
        rows = rows.unionByName(extra.where(inside[0] & inside[1] & inside[2]))
    order = ["role", "value", *CELL]
    return dealt(rows, room, "case_id").sortWithinPartitions("case_id", *order)


def predicted_regions(
    masks: Sequence[DataFrame], probs: DataFrame, grid: DataFrame, values: Sequence[int], mass: Sequence[int], *,
    variance: DataFrame | None, min_cells: int, tile: int,
) -> DataFrame:
    """Statistics, context and match of the predicted regions of cases whose array fits ``tile``.

    ``masks`` are the predicted and the reference mask with ``class_value``, inside the first tile.
    ``_under`` and the class are the cells of the reference's class below a region, ``_cell`` is the volume of a cell.
    """
    named = [v for v in values if v != 0]
    place = [F.col(c).cast("int").alias(c) for c in CELL]
    more = [probs.select("case_id", F.lit(PROBS).alias("role"), F.lit(0).alias("value"), *place, F.col("p").cast("array<double>").alias("numbers"))]
    has_variance = variance is not None
    if has_variance:
        known = F.array(F.coalesce(F.col("variance").cast("double"), F.lit(0.0))).alias("numbers")
        own = variance.where(F.col("class_value").isin(named))
        more.append(own.select("case_id", F.lit(VARIANCE).alias("role"), F.col("class_value").cast("int").alias("value"), *place, known))

    def finish(table: pa.Table) -> pa.RecordBatch:
        return _predicted(_Cases(table, tile, list(values), mass), min_cells, has_variance)

    rows = _met(masks, grid, tile, *more)
    doubles = lambda *names: ", ".join(f"{n} double" for n in names)
    schema = (
        f"class_value int, comp_id int, n_cells long, {doubles('centroid_i', 'centroid_j', 'centroid_k', 'mean_prob', 'max_prob')}, "
        f"{doubles(*[f'prob_c{v}' for v in values])}, {', '.join(f'_under{v} long' for v in named)}, p90_prob double, "
        "rank_by_volume long, rank_by_prob long, n_comps_in_class long, mean_border_prob double, dist_to_dominant_mm double, "
        "matched boolean, matched_ref_ids array<int>, dice_with_matched double, false_positive boolean, _cell double"
        + (", mc_mean_var double" if has_variance else "")
    )
    return rows.mapInArrow(per_tile(["case_id"], finish), _typed(rows, schema))


def reference_regions(
    masks: Sequence[DataFrame], grid: DataFrame, values: Sequence[int], mass: Sequence[int], *, min_cells: int, tile: int
) -> DataFrame:
    """Match and distance of the scored reference regions of cases whose array fits ``tile``."""

    def finish(table: pa.Table) -> pa.RecordBatch:
        return _reference(_Cases(table, tile, list(values), mass), min_cells)

    rows = _met(masks, grid, tile)
    schema = (
        "class_value int, ref_id int, n_cells long, detected boolean, dice double, matched_comp_ids array<int>, "
        "dist_to_dominant_mm double, _cell double"
    )
    return rows.mapInArrow(per_tile(["case_id"], finish), _typed(rows, schema))


def _typed(rows: DataFrame, schema: str) -> T.StructType:
    kind = rows.schema["case_id"].dataType
    return T.StructType([T.StructField("case_id", kind), *T.StructType.fromDDL(schema).fields])


def depths(cells: DataFrame, mask: DataFrame, grid: DataFrame) -> DataFrame:
    """``case_id, i, j, k, depth`` of each distinct cell, see ``geometry.depth_in_mask``, for cases that fit a tile.

    Both sets and the shape of a case meet in one exchange, over tasks that follow the cells of the arrays.
    """

    def finish(table: pa.Table) -> pa.RecordBatch:
        case = np.cumsum(changes(table, ["case_id"]))
        role = table["role"].to_numpy()
        heads = np.flatnonzero(role == GEOMETRY)
        first = np.concatenate([[0], np.flatnonzero(np.diff(case)) + 1])
        geometry = np.zeros((len(first), 6))
        geometry[case[heads]] = table["numbers"].combine_chunks().take(pa.array(heads)).flatten().to_numpy().reshape(-1, 6)
        place = np.stack([table[c].to_numpy() for c in CELL], 1).astype(np.int64)
        edge = np.maximum(place.max(0) + 1, geometry[:, :3].max(0).astype(np.int64))
        step = max(1, _DENSE // int(edge.prod()))
        rows, numbers = [], []
        for low in range(0, len(first), step):
            at, to = np.searchsorted(case, [low, low + step])
            here = np.arange(at, to)
            wanted, own = here[role[at:to] == REF], here[role[at:to] == PRED]
            held = np.zeros((min(step, len(first) - low), *edge), bool)
            held[(case[own] - low, *place[own].T)] = True
            block = _depth_block(held, geometry[low : low + step])
            spot = (case[wanted] - low, *place[wanted].T)
            _, once = np.unique(np.ravel_multi_index(spot, held.shape), return_index=True)
            rows.append(wanted[once])
            numbers.append(np.where(held[spot], np.sqrt(block[spot]), 0.0)[once])
        picked, depth = pa.array(np.concatenate(rows)), np.concatenate(numbers)
        columns = [table[c].combine_chunks().take(picked) for c in ("case_id", *CELL)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(depth, mask=~np.isfinite(depth))], ["case_id", *CELL, "depth"])

    numbers = F.array(*[F.col(c).cast("double") for c in ("ni", "nj", "nk", "si", "sj", "sk")]).alias("numbers")
    origin = [F.lit(0).alias(c) for c in CELL]
    none = F.lit(None).cast("array<double>").alias("numbers")
    shapes = grid.select("case_id", *origin, F.lit(GEOMETRY).alias("role"), numbers)
    parts = [
        rows.select("case_id", *[F.col(c).cast("int").alias(c) for c in CELL], F.lit(role).alias("role"), none)
        for rows, role in ((mask, PRED), (cells, REF))
    ]
    total = grid.agg(F.sum(F.col("ni").cast("long") * F.col("nj") * F.col("nk"))).first()[0] or 0
    met = dealt(shapes.unionByName(parts[0]).unionByName(parts[1]), total, "case_id").sortWithinPartitions("case_id")
    return met.mapInArrow(per_tile(["case_id"], finish), _typed(met, "i int, j int, k int, depth double"))


def _depth_block(held: np.ndarray, geometry: np.ndarray) -> np.ndarray:
    """Squared distance of every place to the nearest cell of the array that touches the mask from outside."""
    near = np.zeros_like(held)
    block = ~held
    for axis in range(3):
        ahead, behind = ([slice(None)] * 4 for _ in range(2))
        ahead[axis + 1], behind[axis + 1] = slice(1, None), slice(None, -1)
        near[tuple(ahead)] |= held[tuple(behind)]
        near[tuple(behind)] |= held[tuple(ahead)]
        shape = [1, 1, 1, 1]
        shape[axis + 1] = -1
        block &= np.arange(held.shape[axis + 1]).reshape(shape) < geometry[:, axis].reshape(-1, 1, 1, 1)
    block = np.where(block & near, 0.0, np.inf)
    for axis in (2, 1, 0):
        shape = [1, 1, 1, 1]
        shape[axis + 1] = -1
        places, found = np.arange(block.shape[axis + 1]).reshape(shape), np.full_like(block, np.inf)
        for s in range(block.shape[axis + 1]):
            away = (geometry[:, 3 + axis].reshape(-1, 1, 1, 1) * (places - s)) ** 2
            np.minimum(found, np.take(block, [s], axis + 1) + away, out=found)
        block = found
    return block
