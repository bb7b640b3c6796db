"""SimHash near-duplicates linked through pivot distance tables.

Every fingerprint gets its Hamming distances to a fixed set of reference fingerprints,
kept block by block.  Two fingerprints that differ in at most ``b`` bits leave at least
``blocks - b`` blocks untouched, so they agree in all pivot distances of those blocks:
candidates meet on equal coordinates of ``blocks - b`` blocks.  A pair is discarded when
any whole-fingerprint coordinate differs by more than ``b`` (triangle inequality), and
the survivors are verified bit by bit.  No link is lost and none is invented.

Equal fingerprints are folded first, so a group of copies is one node however large it is.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.labelling import contract
from .common import batches_of, cut, packed, without_ids

BITS, SHINGLE, SEED = 64, 3, 42
MAX_BITS, BLOCKS, PIVOTS = 3, 6, 8


def fingerprint_of(text: bytes | None, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for every row: ASCII capitals lowered, words split at ASCII white space.

    NULL, empty and blank texts have fingerprint zero.  Repeated rows give repeated results.
    """

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary())
        fps = pa.array([fingerprint_of(t.as_py()) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return batches_of(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, fp long", per_slice)


def pivot_values(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of 0..n-1, the same on every cluster, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), SEED)).astype(np.int64)) for i in range(n)]


def _masks(blocks: int) -> list[int]:
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    out = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def pivot_table(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, pivots: int = PIVOTS) -> DataFrame:
    """``fp, coords, meets``: distances to the pivots, whole (packed) and as one key per block choice."""
    if blocks <= max_bits:
        raise ValueError("more blocks than differing bits are needed")
    refs = pivot_values(pivots)
    packed = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i) for i, p in enumerate(refs)],
    )
    per_block = [
        F.xxhash64(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(m))) for p in refs]).alias(f"_b{j}")
        for j, m in enumerate(_masks(blocks))
    ]
    rows = fps.select("fp", packed.alias("coords"), *per_block)
    meets = [
        F.xxhash64(F.lit(t), *[F.col(f"_b{j}") for j in chosen])
        for t, chosen in enumerate(combinations(range(blocks), blocks - max_bits))
    ]
    return rows.select("fp", "coords", F.array(*meets).alias("meets"))


def _coordinate_gap(a: Column, b: Column, pivots: int) -> Column:
    gaps = [
        F.abs(F.shiftright(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(b, 8 * i).bitwiseAND(F.lit(255)))
        for i in range(pivots)
    ]
    return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]


def hamming_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, pivots: int = PIVOTS) -> DataFrame:
    """All pairs ``a < b`` of the distinct fingerprints in ``fps`` that differ in at most ``max_bits`` bits.

    A pair that meets under several block choices may come more than once.
    """
    if not 1 <= pivots <= 8:
        raise ValueError("one to eight pivots fit a packed row")
    placed = pivot_table(fps, max_bits, blocks, pivots).select(F.explode("meets").alias("meet"), "fp", "coords")
    left = placed.select("meet", F.col("fp").alias("a"), F.col("coords").alias("ca"))
    right = placed.select(F.col("meet").alias("_m"), F.col("fp").alias("b"), F.col("coords").alias("cb"))
    near = (
        (F.col("meet") == F.col("_m")) & (F.col("a") < F.col("b"))
        & (_coordinate_gap(F.col("ca"), F.col("cb"), pivots) <= max_bits)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )
    return left.join(right, near).select("a", "b")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable through links of at most ``max_bits``
    differing bits, itself included.  NULL ids take part in linking; their component is
    NULL only where no member has an id.  An empty table gives no rows.
    """
    rows = cut(fingerprints(docs))
    folded = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = contract(hamming_links(folded.select("fp"), max_bits))
    rooted = folded.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(members, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id; all columns are kept.

    Rows without an id cannot be named as duplicates and stay.
    """
    return one_per_component(docs, near_duplicates(docs, max_bits))


def one_per_component(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those that ``found`` (``doc_id, component_id``) places in a component of a smaller id."""
    kept = packed(without_ids(docs, found.where("doc_id <> component_id").select("doc_id")))
    with_id = kept.where("_id is not null").dropDuplicates(["_id"])
    return with_id.unionByName(kept.where("_id is null")).select("_all.*")
