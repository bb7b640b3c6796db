"""Region contact graph: class regions, the contacts between them, and what they share with the reference.

Many questions ask for the scores of edited masks: without the regions under a size, without
rejected regions, with false regions renamed or deleted.  All of them keep, drop or rename
whole class regions, so a region of an edited mask is a connected set of class regions.

Cells are therefore read once.  A tile, bounded by construction and held by one task with the
cells of both masks, gives its pieces (connected cells of one class), the contacts between
pieces, the cells that pieces of the two masks share, and the pieces on its faces; a large case
is many tiles.  All else works on these: pieces that continue across a face are one class
region, an edit is a choice of class regions, its own regions are the components of what remains
of the graph, and sizes and overlaps are sums.

A tile without a cell on an inner face is closed: whatever an edit makes of its pieces ends in it.
The task that holds it counts its share of the scores, and only sums leave the task; tiles
that others continue go on as a graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import MIN_CELLS, struct_max, targets_of
from ..functions.runtime import cut
from .labelling import _BITS, DEFAULT_TILE, _merge_pieces, _numbered, changes, contract, packable, per_tile
from .matching import CELL, SCORE_SUMS, Matching, case_target_grid, finish_scores, match_tables, score_sums

PRED, REF = 0, 1
NODE, CONTACT, SHARED, FACE, SCORE = range(5)
#: What ``_tile_graph`` gives for every row of its output, after the key of the case.
_TILE_ROW = "kind int, side int, value int, a long, b long, n long, home long"
#: Edges that a task connects together before they meet the rest.
CHUNK = 1_000_000
#: Cells along the edge of the blocks in which edges are connected first, as a power of two.
BLOCK_BITS = 7


@dataclass(frozen=True)
class ContactGraph:
    """``nodes``: ``side, case_id, value, node, n_cells``; ``contacts``: ``side, case_id, a, b``;
    ``shared``: ``case_id, pred_node, ref_node, shared``.  A node is the packed first cell of a class region.
    ``home`` in all three is the packed tile of a row if that tile is closed, else -1."""

    nodes: DataFrame
    contacts: DataFrame
    shared: DataFrame

    def side(self, side: int) -> tuple[DataFrame, DataFrame]:
        """Nodes and contacts of one mask."""
        return self.nodes.where(F.col("side") == side).drop("side"), self.contacts.where(F.col("side") == side).drop("side")

    def numbered(self, side: int) -> DataFrame:
        """Nodes of one mask with the region key of the labelled mask: ``class_value`` and ``comp_id`` 1..n."""
        nodes = self.side(side)[0].withColumn("class_value", F.col("value"))
        keys = ["case_id", "class_value"]
        ids = _numbered(nodes.select(*keys, F.col("node").alias("piece")), keys).withColumnRenamed("piece", "node")
        return nodes.join(ids, [*keys, "node"])


def _distinct_rows(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of every distinct combination and how often it occurs."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.append(starts, len(order)))


@dataclass
class TileNodes:
    """Nodes of whole closed tiles as arrays; contacts and shared cells name nodes by their row."""

    group: np.ndarray
    side: np.ndarray
    value: np.ndarray
    size: np.ndarray
    contacts: tuple[np.ndarray, np.ndarray]
    shared: tuple[np.ndarray, np.ndarray, np.ndarray]  # node of the predicted mask, of the reference, cells


def _tile_sums(nodes: TileNodes, values: np.ndarray, wanted: Sequence[Sequence[int]], n_groups: int, min_cells: int) -> np.ndarray:
    """``SCORE_SUMS`` by variant, target and tile.  ``values`` has a row per variant: the nodes' values, 0 for a node that is gone."""
    n, own = len(nodes.size), np.arange(len(nodes.size))
    x, y = nodes.contacts
    p, r, cells = nodes.shared
    out = np.zeros((len(values), len(wanted), n_groups, len(SCORE_SUMS)))

    def total(rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(nodes.group[rows], None if weights is None else weights, n_groups)

    for v, value in enumerate(values):
        for t, chosen in enumerate(wanted):
            member = np.isin(value, chosen)
            near = member[x] & member[y]
            root = _merge_pieces(n, x[near], y[near]) if near.any() else own
            size = np.bincount(root[member], nodes.size[member], n)
            head = member & (root == own)
            comps, refs = np.flatnonzero(head & (nodes.side == PRED)), np.flatnonzero(head & (nodes.side == REF))
            meet = member[p] & member[r]
            mine, theirs, shared = root[p[meet]], root[r[meet]], cells[meet]
            pair = np.unique(mine * n + theirs)
            one, other = pair // max(1, n), pair % max(1, n)
            met = np.unique(one[(size[one] >= min_cells) & (size[other] >= min_cells)])
            under = np.bincount(theirs, shared, n)
            found = refs[(size[refs] >= min_cells) & (under[refs] > 0)]
            touching = np.bincount(other, size[one], n)
            out[v, t] = np.stack([
                total(comps, size[comps]), total(comps[size[comps] >= min_cells]), total(refs, size[refs]),
                total(refs[size[refs] >= min_cells]), total(mine, shared), total(met),
                total(found, 2.0 * under[found] / (size[found] + touching[found])), total(found),
            ], 1)
    return out


def _sum_rows(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Variant, target, tile and sums of every entry that is not empty."""
    v, t, g = np.nonzero(sums.any(-1))
    return v, t, g, sums[v, t, g]


def _sums_column(values: np.ndarray, rows: int) -> pa.Array:
    """``values`` as lists, after ``rows`` rows without any."""
    width = len(SCORE_SUMS)
    bounds = np.concatenate([np.zeros(rows, np.int32), np.arange(len(values) + 1, dtype=np.int32) * width])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel()))


def _tile_graph(
    boundary: Sequence[str], tile: int, edits: Callable[[TileNodes], np.ndarray] | None = None,
    wanted: Sequence[Sequence[int]] = (), min_cells: int = MIN_CELLS,
):
    """Function for ``mapInArrow``: pieces, contacts, shared cells and face pieces of every tile.

    With ``edits``, which gives the values of the nodes in every variant of the predicted mask, closed
    tiles give their sums by variant (``side``) and target (``value``) instead.
    """

    def finish(table: pa.Table) -> pa.RecordBatch:
        change = changes(table, boundary)
        cells = cells_of = np.stack([table[c].to_numpy() for c in CELL], 1).astype(np.int64)
        side, value = table["side"].to_numpy(), table["value"].to_numpy()
        again = np.zeros(len(side), bool)
        again[1:] = (change[1:] == 0) & (cells[1:] == cells[:-1]).all(1) & (side[1:] == side[:-1])
        if (again[1:] & (value[1:] != value[:-1])).any():
            raise ValueError("a mask gives a cell more than one value")
        group, first = np.cumsum(change), np.concatenate([[0], np.flatnonzero(change)])
        if again.any():  # a repeated cell counts once
            cells, side, value, group = cells[~again], side[~again], value[~again], group[~again]
        local = cells % tile
        code = ((group * tile + local[:, 0]) * tile + local[:, 1]) * tile + local[:, 2]
        packed = (cells[:, 0] << 2 * _BITS) | (cells[:, 1] << _BITS) | cells[:, 2]
        left, right = [], []
        for s in (PRED, REF):
            rows = np.flatnonzero(side == s)
            here = code[rows]
            for axis, stride in enumerate((tile * tile, tile, 1)):
                low = np.flatnonzero(local[rows, axis] < tile - 1)
                spot = np.searchsorted(here, here[low] + stride)
                low, spot = low[spot < len(here)], spot[spot < len(here)]
                hit = here[spot] == here[low] + stride
                left.append(rows[low[hit]])
                right.append(rows[spot[hit]])
        x, y = np.concatenate(left), np.concatenate(right)
        alike = value[x] == value[y]
        root = _merge_pieces(len(code), x[alike], y[alike])
        piece = packed[root]
        x_row, y_row = x[~alike], y[~alike]
        where = x_row
        x, y = piece[x_row], piece[y_row]
        p, r = np.flatnonzero(side == PRED), np.flatnonzero(side == REF)
        spot = np.searchsorted(code[p], code[r])
        fits = spot < len(p)
        both = p[spot[fits]], r[fits]
        meet = code[both[0]] == code[both[1]]
        shared = both[0][meet], both[1][meet]
        heads = np.flatnonzero(root == np.arange(len(root)))
        sizes = np.bincount(root, minlength=len(root))[heads]
        found = [  # kind, group, side, a, b, n, value
            (NODE, group[heads], side[heads], piece[heads], 0, sizes, value[heads]),
            (CONTACT, group[where], side[where], np.minimum(x, y), np.maximum(x, y), 1, 0),
            (SHARED, group[shared[0]], 0, piece[shared[0]], piece[shared[1]], 1, 0),
        ]
        for n in (1, 2):
            rows, counts = _distinct_rows(*[np.broadcast_to(c, found[n][1].shape) for c in found[n][1:5]])
            found[n] = (found[n][0], *[np.broadcast_to(c, found[n][1].shape)[rows] for c in found[n][1:5]], counts, 0)
        for axis, shift in enumerate((2 * _BITS, _BITS, 0)):
            for role, rows in ((0, np.flatnonzero(local[:, axis] == tile - 1)), (1, np.flatnonzero((local[:, axis] == 0) & (cells[:, axis] > 0)))):
                found.append((FACE, group[rows], side[rows], packed[rows] - (role << shift), piece[rows], 2 * axis + role, value[rows]))
        closed = np.ones(len(first), bool)
        for face in found[3:]:
            closed[face[1]] = False
        kind, g, s, a, b, n, v = (
            np.concatenate([np.broadcast_to(np.asarray(f[c], np.int64), f[1].shape) for f in found]) for c in range(7)
        )
        scores, values = [], np.zeros((0, len(SCORE_SUMS)))
        if edits is not None:
            stays = ~closed[g]
            row = np.full(len(root), -1)
            inside = heads[closed[group[heads]]]
            row[inside] = np.arange(len(inside))
            touch, common = closed[group[where]], closed[group[shared[0]]]
            ends = row[root[x_row[touch]]], row[root[y_row[touch]]]
            pairs, counts = np.unique(row[root[shared[0][common]]] * max(1, len(root)) + row[root[shared[1][common]]], return_counts=True)
            nodes = TileNodes(
                group[inside], side[inside], value[inside], np.bincount(root, minlength=len(root))[inside], ends,
                (pairs // max(1, len(root)), pairs % max(1, len(root)), counts),
            )
            variant, target, at, values = _sum_rows(_tile_sums(nodes, edits(nodes), wanted, len(first), min_cells))
            scores = [np.full(len(at), SCORE), at, variant, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), target]
            kind, g, s, a, b, n, v = (np.concatenate([c[stays], c2]) for c, c2 in zip((kind, g, s, a, b, n, v), scores))
        case = table["case_id"].combine_chunks().take(pa.array(first[g]))
        corner = cells_of[first] // tile
        home = np.where(closed, (corner[:, 0] << 2 * _BITS) | (corner[:, 1] << _BITS) | corner[:, 2], -1)[g]
        return pa.RecordBatch.from_arrays(
            [case, *[pa.array(c.astype(np.int32)) for c in (kind, s, v)], *[pa.array(c) for c in (a, b, n, home)], _sums_column(values, len(g) - len(values))],
            ["case_id", "kind", "side", "value", "a", "b", "n", "home", "sums"],
        )

    return per_tile(boundary, finish)


def _met_tiles(pred: DataFrame, ref: DataFrame, tile: int, *work) -> DataFrame:
    """What the tasks give that hold the tiles of both masks, see ``_tile_graph``."""
    cells = pred.where("value > 0").select(F.lit(PRED).alias("side"), "case_id", *CELL, "value").unionByName(
        ref.where("value > 0").select(F.lit(REF).alias("side"), "case_id", *CELL, "value")
    )
    boundary = ["case_id", "_ti", "_tj", "_tk"]
    placed = cells.select(
        "case_id", *[F.floor(F.col(c) / tile).cast("int").alias(f"_t{c}") for c in CELL],
        *[packable(c).alias(c) for c in CELL], "side", F.col("value").cast("int").alias("value"),
    ).repartition(*boundary).sortWithinPartitions(*boundary, *CELL, "side", "value")
    case = cells.schema["case_id"].dataType.simpleString()
    return cut(placed.mapInArrow(_tile_graph(boundary, tile, *work), f"case_id {case}, {_TILE_ROW}, sums array<double>"))


def contact_graph(pred: DataFrame, ref: DataFrame, *, tile: int = DEFAULT_TILE) -> ContactGraph:
    """Class regions of both masks and how they meet.  A mask that gives a cell two values is refused."""
    return _graph_of(_met_tiles(pred, ref, tile))


def _graph_of(met: DataFrame) -> ContactGraph:
    """Pieces that continue across a face are one region."""
    low, high = F.col("n") % 2 == 0, F.col("n") % 2 == 1
    across = cut(met.where(F.col("kind") == FACE).groupBy("side", "case_id", F.expr("n div 2").alias("axis"), F.col("a").alias("at")).agg(
        F.max(F.when(low, F.col("b"))).alias("a"), F.max(F.when(high, F.col("b"))).alias("b"),
        F.max(F.when(low, F.col("value"))).alias("va"), F.max(F.when(high, F.col("value"))).alias("vb"),
    ).where("va is not null and vb is not null").select("side", "case_id", "a", "b", (F.col("va") == F.col("vb")).alias("alike")).distinct())
    nodes = met.where(F.col("kind") == NODE).select("side", "case_id", "value", F.col("a").alias("node"), F.col("n").alias("n_cells"), "home")
    contacts = met.where(F.col("kind") == CONTACT).select("side", "case_id", "a", "b", "home").unionByName(
        across.where("not alike").select("side", "case_id", "a", "b", F.lit(-1).cast("long").alias("home"))
    )
    shared = met.where(F.col("kind") == SHARED).select(
        "case_id", F.col("a").alias("pred_node"), F.col("b").alias("ref_node"), F.col("n").alias("shared"), "home"
    )
    alike = across.where("alike")
    if alike.isEmpty():  # no region continues across a face
        return ContactGraph(nodes, contacts, shared)
    roots = cut(components(alike, ["side", "case_id"]))

    def rooted(rows: DataFrame, column: str, side: Column) -> DataFrame:
        known = roots.select(F.col("side").alias("_side"), F.col("case_id").alias("_case"), F.col("node").alias("_node"), "root")
        on = (F.col("_side") == side) & (F.col("_case") == F.col("case_id")) & (F.col("_node") == F.col(column))
        return rows.join(known, on, "left").withColumn(column, F.coalesce("root", column)).drop("_side", "_case", "_node", "root")

    own = F.col("side")
    nodes = rooted(nodes, "node", own).groupBy("side", "case_id", "value", "node", "home").agg(F.sum("n_cells").alias("n_cells"))
    pairs = rooted(rooted(contacts, "a", own), "b", own)
    contacts = pairs.select("side", "case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "home").distinct()
    shared = rooted(rooted(shared, "pred_node", F.lit(PRED)), "ref_node", F.lit(REF))
    shared = shared.groupBy("case_id", "pred_node", "ref_node", "home").agg(F.sum("shared").alias("shared"))
    return ContactGraph(cut(nodes), cut(contacts), cut(shared))


def match_nodes(graph: ContactGraph, *, min_cells: int = MIN_CELLS) -> Matching:
    """The matching of ``filters.match_classes``, class by class, without a look at cells."""
    keys = ["case_id", "class_value"]
    comps = cut(graph.numbered(PRED).select(*keys, "node", "comp_id", "n_cells"))
    refs = cut(graph.numbered(REF).select(*keys, "node", F.col("comp_id").alias("ref_id"), F.col("n_cells").alias("ref_cells")))
    overlap = (
        graph.shared.join(comps.withColumnRenamed("node", "pred_node"), ["case_id", "pred_node"])
        .join(refs.withColumnRenamed("node", "ref_node"), [*keys, "ref_node"])
        .select(*keys, "comp_id", "ref_id", "shared", "n_cells", "ref_cells")
    )
    return match_tables(comps.drop("node"), refs.drop("node"), cut(overlap), keys, min_cells=min_cells)


def nodes_under(graph: ContactGraph, side: int, *, majority: float = 0.5) -> DataFrame:
    """``filters.under_regions`` of one mask's class regions from what they share with the other's."""
    mine, theirs = ("pred_node", "ref_node") if side == PRED else ("ref_node", "pred_node")
    region = ["case_id", "class_value", "comp_id"]
    other = graph.side(REF if side == PRED else PRED)[0].select("case_id", F.col("node").alias(theirs), F.col("value").alias("_class"))
    votes = graph.shared.join(other, ["case_id", theirs]).groupBy("case_id", F.col(mine).alias("node"), "_class").agg(F.sum("shared").alias("_n"))
    best = votes.groupBy("case_id", "node").agg(
        F.sum("_n").alias("_covered"), struct_max("_n", F.col("_class"), fields=["_class"]).alias("_b")
    )
    share = F.coalesce("_covered", F.lit(0)) / F.col("n_cells")
    return graph.numbered(side).join(best, ["case_id", "node"], "left").select(
        *region, "n_cells", share.alias("covered_frac"), F.when(share >= majority, F.col("_b._class")).otherwise(0).alias("covered_by"),
    )


def _forest(keys: Sequence[str]):
    """Function for ``mapInArrow``: a spanning forest of a task's edges, each node hung under its smallest."""

    def reduced(table: pa.Table) -> pa.RecordBatch:
        group = np.zeros(table.num_rows, np.int64)
        for key in keys:
            coded = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
            group = group * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()])
        both = np.concatenate([group, group])
        order = np.lexsort((ends, both))
        new = np.ones(len(order), bool)
        new[1:] = (both[order][1:] != both[order][:-1]) | (ends[order][1:] != ends[order][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        firsts = order[new]  # one end for every node, in the order of group and node
        root = _merge_pieces(len(firsts), place[: len(group)], place[len(group) :])
        hung = np.flatnonzero(root != np.arange(len(root)))
        take = pa.array(firsts[hung] % max(1, table.num_rows))
        columns = [table[key].combine_chunks().take(take) for key in keys]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ends[firsts[hung]]), pa.array(ends[firsts[root[hung]]])], [*keys, "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= CHUNK:
                yield reduced(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield reduced(pa.Table.from_batches(held))

    return run


def components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, node, root`` for the nodes of ``edges`` (``a``, ``b``: packed first cells).

    Edges are first connected within blocks of space, one block in one task.  Where no node is
    in two of the forests that come out, they are the components; else star contraction joins them.
    """
    mask = (1 << _BITS) - 1
    block = [F.shiftright("a", shift + BLOCK_BITS).bitwiseAND(F.lit(mask >> BLOCK_BITS)) for shift in (2 * _BITS, _BITS, 0)]
    rows = edges.select(*keys, "a", "b").repartition(*[F.col(k) for k in keys], *block)
    stars = cut(rows.mapInArrow(_forest(keys), rows.schema))
    hung = stars.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    both = hung.unionByName(roots)
    apart = both.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return both if apart.isEmpty() else contract(stars, keys)


def target_regions(
    nodes: DataFrame, contacts: DataFrame, targets: Mapping[str, Iterable[int]], keys: Sequence[str], on: Sequence[str] = ("case_id",)
) -> DataFrame:
    """``keys, target, node, comp_id, n_cells, head``: the region of each target to which every node belongs, and the region's size.

    ``nodes`` may hold a case in several variants (more ``keys`` than ``on``, which ``contacts``
    have) and with changed values.  ``head`` is true on one node of each region.
    """
    keys, on = list(keys), list(on)
    full = [*keys, "target"]
    members = nodes.select(*keys, F.explode(targets_of("value", targets)).alias("target"), "node", "n_cells")
    near = members.select(*full, F.col("node").alias("a")).join(contacts, [*on, "a"])
    edges = near.join(members.select(*full, F.col("node").alias("b")), [*full, "b"])
    # Only nodes that touch another one of their target have a root; most regions stay what they are.
    rooted = members.join(components(edges, full), [*full, "node"], "left")
    totals = rooted.where("root is not null").groupBy(*full, "root").agg(F.sum("n_cells").alias("_total"))
    return rooted.join(totals, [*full, "root"], "left").select(
        *full, "node", F.coalesce("root", "node").alias("comp_id"), F.coalesce("_total", "n_cells").alias("n_cells"),
        (F.col("root").isNull() | (F.col("root") == F.col("node"))).alias("head"),
    )


def _graph_sums(
    graph: ContactGraph, edited: DataFrame, targets: Mapping[str, Iterable[int]], variants: tuple[str, Column], min_cells: int
) -> DataFrame:
    """Sums of ``score_edits`` by joins on the graph, for regions of any extent."""
    name, levels = variants
    keys = [name, "case_id", "target"]
    # The reference is one more variant, whose values differ from all others by their side.
    columns = ["side", name, "case_id", "node", "value", "n_cells"]
    kept = edited.drop("value").select("*", F.posexplode("values").alias("_v", "value")).where("value > 0")
    nodes = kept.withColumns({"side": F.lit(PRED), name: F.get(levels, F.col("_v"))}).select(*columns).unionByName(
        graph.nodes.where(F.col("side") == REF).withColumn(name, F.get(levels, F.lit(0))).select(*columns)
    )
    regions = cut(target_regions(nodes, graph.contacts, targets, ["side", name, "case_id"], ["side", "case_id"]))
    mine, theirs = regions.where(F.col("side") == PRED), regions.where(F.col("side") == REF)
    pairs = (
        graph.shared
        .join(theirs.select("case_id", "target", F.col("node").alias("ref_node"), F.col("comp_id").alias("ref_id"), F.col("n_cells").alias("ref_cells")), ["case_id", "ref_node"])
        .join(mine.select(*keys, F.col("node").alias("pred_node"), "comp_id", "n_cells"), ["case_id", "target", "pred_node"])
    )
    overlap = pairs.groupBy(*keys, "comp_id", "ref_id").agg(
        F.sum("shared").alias("shared"), F.max("n_cells").alias("n_cells"), F.max("ref_cells").alias("ref_cells")
    )
    comps = mine.where("head").select(*keys, "n_cells")
    refs = theirs.where("head").select("case_id", "target", F.col("n_cells").alias("ref_cells"))
    return score_sums(comps, refs, overlap, keys, (name, levels), min_cells=min_cells)


def _home_scorer(n_variants: int, wanted: Sequence[Sequence[int]], min_cells: int):
    """Function for ``mapInArrow``: sums of closed tiles from the rows of their nodes, contacts and shared cells."""
    boundary = ["case_id", "home"]

    def finish(table: pa.Table) -> pa.RecordBatch:
        change = changes(table, boundary)
        group, first = np.cumsum(change), np.concatenate([[0], np.flatnonzero(change)])
        kind, side, a, b, n = (table[c].to_numpy() for c in ("kind", "side", "a", "b", "n"))
        rows = {k: np.flatnonzero(kind == k) for k in (NODE, CONTACT, SHARED)}
        names = np.unique(a[rows[NODE]])
        held = (group[rows[NODE]] * 2 + side[rows[NODE]]) * len(names) + np.searchsorted(names, a[rows[NODE]])

        def row(at: np.ndarray, of: np.ndarray, node: np.ndarray) -> np.ndarray:
            return np.searchsorted(held, (group[at] * 2 + of) * len(names) + np.searchsorted(names, node))

        near, common, node = rows[CONTACT], rows[SHARED], rows[NODE]
        values = table["values"].combine_chunks().take(pa.array(node)).flatten().to_numpy().reshape(-1, n_variants).T
        nodes = TileNodes(
            group[node], side[node], values[0], n[node], (row(near, side[near], a[near]), row(near, side[near], b[near])),
            (row(common, PRED, a[common]), row(common, REF, b[common]), n[common]),
        )
        variant, target, at, sums = _sum_rows(_tile_sums(nodes, values, wanted, len(first), min_cells))
        case = table["case_id"].combine_chunks().take(pa.array(first[at]))
        columns = [pa.array(variant.astype(np.int32)), pa.array(target.astype(np.int32)), _sums_column(sums, 0)]
        return pa.RecordBatch.from_arrays([case, *columns], ["case_id", "side", "value", "sums"])

    return per_tile(boundary, finish)


def _home_sums(graph: ContactGraph, edited: DataFrame, n_variants: int, wanted: Sequence[Sequence[int]], min_cells: int) -> DataFrame:
    """Sums of the closed tiles, whose nodes meet again in one task."""
    columns = ["case_id", "home", "kind", "side", "a", "b", "n", "values"]
    none, zero = F.lit(None).cast("array<int>"), F.lit(0).cast("long")

    def node(rows: DataFrame, side: int, values: Column) -> DataFrame:
        made = {"kind": F.lit(NODE), "side": F.lit(side), "a": F.col("node"), "b": zero, "n": F.col("n_cells"), "values": values.cast("array<int>")}
        return rows.withColumns(made).select(*columns)

    rows = node(edited, PRED, F.col("values")).unionByName(
        node(graph.nodes.where(F.col("side") == REF), REF, F.array_repeat("value", n_variants))
    ).unionByName(
        graph.contacts.withColumns({"kind": F.lit(CONTACT), "n": zero, "values": none}).select(*columns)
    ).unionByName(
        graph.shared.withColumns({
            "kind": F.lit(SHARED), "side": F.lit(PRED), "a": F.col("pred_node"), "b": F.col("ref_node"), "n": F.col("shared"), "values": none,
        }).select(*columns)
    ).where("home >= 0")
    placed = rows.repartition("case_id", "home").sortWithinPartitions("case_id", "home", "kind", "side", "a")
    case = rows.schema["case_id"].dataType.simpleString()
    return placed.mapInArrow(_home_scorer(n_variants, wanted, min_cells), f"case_id {case}, side int, value int, sums array<double>")


def _named_sums(rows: DataFrame, variants: tuple[str, Column], targets: Mapping[str, Iterable[int]]) -> DataFrame:
    """Rows of a task with the names of their variant and target."""
    name, levels = variants
    names = F.array(*[F.lit(t) for t in targets])
    return rows.select(
        F.get(levels, F.col("side")).alias(name), "case_id", F.get(names, F.col("value")).alias("target"),
        *[F.get("sums", F.lit(n)).alias(c) for n, c in enumerate(SCORE_SUMS)],
    )


def _finished(sums: Sequence[DataFrame], cases: DataFrame, targets: Mapping[str, Iterable[int]], variants: tuple[str, Column]) -> DataFrame:
    name, levels = variants
    grid = case_target_grid(cases.select("case_id").distinct().select("case_id", F.explode(levels).alias(name)), targets, [name, "case_id"])
    return finish_scores(reduce(DataFrame.unionByName, sums), grid, [name, "case_id", "target"])


def score_edits(
    graph: ContactGraph, edited: DataFrame, cases: DataFrame, targets: Mapping[str, Iterable[int]],
    variants: tuple[str, Sequence], *, min_cells: int = MIN_CELLS,
) -> DataFrame:
    """Scores of every case, target and variant of the predicted mask.

    ``edited`` has the nodes of the predicted mask (``case_id, node, n_cells, home``) with their ``values``, one per
    variant, 0 where the node is gone; ``variants`` is the name of the variant's column and its values.
    """
    levels = F.array(*[F.lit(v) for v in variants[1]])
    wanted = [tuple(int(x) for x in values) for values in targets.values()]
    edited = cut(edited.select("case_id", "node", "n_cells", "home", "values"))
    sums = [_named_sums(_home_sums(graph, edited, len(variants[1]), wanted, min_cells), (variants[0], levels), targets)]
    across = _open_part(graph)
    if not across.nodes.isEmpty():
        sums.append(_graph_sums(across, edited.where("home < 0").withColumn("value", F.lit(0)), targets, (variants[0], levels), min_cells))
    return _finished(sums, cases, targets, (variants[0], levels))


def _open_part(graph: ContactGraph) -> ContactGraph:
    return ContactGraph(*[rows.where("home < 0") for rows in (graph.nodes, graph.contacts, graph.shared)])


def score_masks(
    pred: DataFrame, ref: DataFrame, cases: DataFrame, targets: Mapping[str, Iterable[int]], variants: tuple[str, Sequence],
    edits: Callable[[TileNodes], np.ndarray], edited: Callable[[ContactGraph], DataFrame], *, min_cells: int = MIN_CELLS, tile: int = DEFAULT_TILE,
) -> DataFrame:
    """``score_edits`` for edits that depend on a region and what it meets: the tasks that read the cells of closed tiles score them.

    ``edits`` gives the values of a closed tile's nodes by variant, ``edited`` the same for a graph of the other tiles
    as the predicted nodes with ``values``.
    """
    levels = F.array(*[F.lit(v) for v in variants[1]])
    wanted = [tuple(int(x) for x in values) for values in targets.values()]
    met = _met_tiles(pred, ref, tile, edits, wanted, min_cells)
    sums = [_named_sums(met.where(F.col("kind") == SCORE), (variants[0], levels), targets)]
    rest = met.where(F.col("kind") != SCORE)
    if not rest.isEmpty():
        graph = _graph_of(rest)
        sums.append(_graph_sums(graph, edited(graph), targets, (variants[0], levels), min_cells))
    return _finished(sums, cases, targets, (variants[0], levels))


def _as_they_are(nodes: TileNodes) -> np.ndarray:
    return nodes.value[None, :]


def score_as_is(pred: DataFrame, ref: DataFrame, cases: DataFrame, targets: Mapping[str, Iterable[int]], **options) -> DataFrame:
    """Scores of the masks as they are: every region of a closed tile is made and counted where its cells are read."""
    def edited(graph: ContactGraph) -> DataFrame:
        return graph.side(PRED)[0].withColumn("values", F.array("value"))

    return score_masks(pred, ref, cases, targets, ("_variant", (0,)), _as_they_are, edited, **options).drop("_variant")
