"""Vector codes: product quantisation in integers with distances pruned by LAESA pivots.

Components become integers floor(1024 * x), vectors are cut into four parts, and every part
position has a codebook of 256 entries that four rounds refine.  The nearest entry is found by
pivots: the distances of every part to a few fixed pivots are computed once and stored; each
round computes the pivots' distances to the entries.  The largest difference of the two over
the pivots is a lower bound of the distance (triangle inequality).  Entries of least bound are evaluated first, in exact
integers; of the others only those whose bound does not pass the best distance so far.

Spark splits the rows; a task keeps its slice, the codebooks and one sum per entry.  What
comes to the driver is one row per codebook entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Pivots of a part position, and the entries that are evaluated before any is pruned.
PIVOTS = 8
FIRST = 4
#: Labels up to this number have their sums broadcast; more are joined by shuffle.
FEW_LABELS = 50_000
#: Bytes of stored rows that a task looks at together.
SLICE = 1 << 20

Codebooks = np.ndarray  # (parts, entries, width) of int64


def _limit(dim: int) -> int:
    """Integers saturate here, so that the squared error of a vector stays within a long."""
    return isqrt((1 << 60) // max(dim, 1))


def integers(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, label, v`` (integers) of the kept rows, and their length."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), x.alias("x"), fine.alias("fine"))
    rows = rows.where("fine").drop("fine")
    sizes = rows.groupBy(F.size("x").alias("n")).count().where(f"n > 0 and n % {PARTS} = 0")
    common = sizes.orderBy(F.desc("count"), "n").first()
    dim = common.n if common else 0
    limit = float(_limit(dim))

    def whole(c: Column) -> Column:
        return F.greatest(F.least(F.floor(F.greatest(F.least(c, F.lit(limit)), F.lit(-limit)) * SCALE), F.lit(int(limit))), F.lit(-int(limit))).cast("int")

    return rows.where(F.size("x") == dim).select("vec_id", "label", F.transform("x", whole).alias("v")), dim


def first_entries(rows: DataFrame, dim: int) -> Codebooks:
    """The parts of the ``ENTRIES`` smallest vec_ids; rows without an id come last, equal ids by their vectors."""
    found = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    flat = np.array([r.v for r in found], np.int64).reshape(len(found), PARTS, dim // PARTS)
    return np.ascontiguousarray(flat.transpose(1, 0, 2))


def choose_pivots(books: Codebooks) -> np.ndarray:
    """Entries far from one another: each next pivot is the entry whose nearest pivot is furthest."""
    chosen = []
    for book in books:
        picks = [0]
        while len(picks) < min(PIVOTS, len(book)):
            nearest = ((book[:, None] - book[picks]) ** 2).sum(-1).min(1)
            picks.append(int(nearest.argmax()))
        chosen.append(book[picks] if len(book) else book)
    return np.stack(chosen)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two integer arrays, pair by pair, as floats."""
    out = np.empty((len(a), len(b)), np.float32)
    for k in range(len(b)):
        out[:, k] = np.sqrt(((a - b[k]) ** 2).sum(1).astype(np.float64))
    return out


def _squared(part: np.ndarray, book: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of listed pairs, a bounded number at a time."""
    out = np.empty(len(row), np.int64)
    step = max(1, (1 << 18) // max(1, part.shape[1]))
    for at in range(0, len(row), step):
        gap = part[row[at : at + step]] - book[entry[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(part: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, of_entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of every part's nearest entry, ties to the lower index.

    ``to_pivots`` and ``of_entries`` are the distances of parts and of entries to the pivots.
    """
    n = len(part)
    bound = np.zeros((n, len(book)), np.float32)
    for p in range(of_entries.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - of_entries[None, :, p]), out=bound)
    # What rounding may add to a difference of two stored distances.
    slack = 1e-6 * (to_pivots.max(1, initial=0.0) + of_entries.max(initial=0.0))
    lead = min(FIRST, len(book))
    order = np.argpartition(bound, lead - 1, axis=1)[:, :lead]
    tried = _squared(part, book, np.repeat(np.arange(n), lead), order.ravel()).reshape(n, lead)
    best = tried.min(1)
    reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-6) + slack
    row, entry = np.nonzero(bound <= reach[:, None].astype(np.float32) * np.float32(1 + 1e-6))
    squared = _squared(part, book, row, entry)
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(squared, starts)
    at = np.flatnonzero(squared == least[row])
    _, first = np.unique(row[at], return_index=True)
    return entry[at[first]], least


def _parts(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    """A list column as ``(parts, rows, width)``."""
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return np.ascontiguousarray(flat.reshape(batch.num_rows, PARTS, -1).transpose(1, 0, 2))


def with_pivot_distances(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``d``: the distances of every part to the pivots of its position, part after part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE):
                parts = _parts(some, "v", np.int64)
                d = np.stack([_distances(x, p) for x, p in zip(parts, pivots)], 1).reshape(some.num_rows, -1)
                lists = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(d.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], ["vec_id", "label", "v", "d"])

    return rows.mapInArrow(run, "vec_id long, label int, v array<int>, d array<float>")


class Assigner:
    """Nearest entries of the parts of a batch under given codebooks; all it holds has the codebooks' size."""

    def __init__(self, books: Codebooks, pivots: np.ndarray):
        self.books = books
        self.of_entries = [_distances(book, p) for book, p in zip(books, pivots)]

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts, and the index and squared distance for every part position and row."""
        parts, to_pivots = _parts(batch, "v", np.int64), _parts(batch, "d", np.float32)
        found = [nearest(x, d, book, e) for x, d, book, e in zip(parts, to_pivots, self.books, self.of_entries)]
        return parts, np.stack([f[0] for f in found]), np.stack([f[1] for f in found])


def refined(stored: DataFrame, books: Codebooks, pivots: np.ndarray) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts nearest to it, or stays if it has none."""
    assign, (_, entries, width) = Assigner(books, pivots), books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for some in slices(batch, SLICE):
                parts, index, _ = assign(some)
                for q in range(PARTS):
                    np.add.at(sums[q], index[q], parts[q])
                    counts[q] += np.bincount(index[q], minlength=entries)
        q, e = np.nonzero(counts)
        lists = pa.ListArray.from_arrays(np.arange(0, len(q) * width + 1, width, dtype=np.int32), pa.array(sums[q, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[q, e]), lists], ["q", "e", "n", "s"])

    partial = stored.select("v", "d").mapInArrow(run, "q int, e int, n long, s array<long>")
    totals = partial.groupBy("q", "e").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(k))) for k in range(width)]).alias("s"))
    out = books.copy()
    for r in totals.collect():  # one row per entry
        out[r.q, r.e] = [s // r.n for s in r.s]
    return out


def encode(vectors: DataFrame) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of every kept row, and the final codebooks.

    Dropped are rows whose vector is NULL or holds a NULL or non-finite component, and rows
    whose length is not the commonest one that four divides (ties to the shorter).  Integers
    saturate where an error would leave the range of a long: at 2^27 for 64 components.  Rows
    without an id or label are coded like others; repeated rows are coded again, and those of
    one id stand in the order of their vectors for the first codebooks; fewer than
    256 rows give fewer entries; an empty table gives no rows; other columns are ignored.
    """
    rows, dim = integers(vectors)
    books = first_entries(rows, dim)
    if not dim:  # nothing is kept
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    pivots = choose_pivots(books)
    stored = written(with_pivot_distances(rows, pivots), "vectors")
    for _ in range(ROUNDS):
        books = refined(stored, books, pivots)
    assign = Assigner(books, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE):
                _, index, squared = assign(some)
                codes = ["".join(map("{:02x}".format, c)) for c in index.T.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(codes, pa.string()), pa.array(squared.sum(0), pa.int64())], ["vec_id", "label", "code", "error"]
                )

    return stored.mapInArrow(run, "vec_id long, label int, code string, error long"), books


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the summed error of the rows of the same label, those without one together."""
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "_label")
    few = sums.count() <= FEW_LABELS
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every kept row; see ``encode``."""
    coded, books = encode(vectors)
    return label_errors(written(coded, "codes")).withColumn("codebooks_sha256", F.lit(digest(books)))
