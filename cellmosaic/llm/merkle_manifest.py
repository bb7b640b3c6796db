"""Merkle manifest of a data set: leaf, subroot, root and inclusion proof of every document.

A leaf is the digest of a row.  The leaves of a language are ranked by doc_id and every eight
neighbours become their parent's digest, until one node, the subroot, remains; the subroots,
by language, give the root in the same way.

The tree is a rollup of nested structs.  A rank is written in digits of base eight, and the
lowest ``DEPTH`` digits make a block of 512 nodes, which one shuffle brings together; its digit columns
are grouped away one after the other, each time nesting the children as structs
in their parent, so a block is one row of bounded size that holds its whole subtree.  The blocks'
digests are the nodes of the next, 512 times smaller stage.  On the way back a block is
exploded level by level with the digests beside each child, which are the proof; what lies
above a block meets it by a union and a group, so nothing is joined.

Ties: rows of equal language and doc_id are ordered by leaf.  NULL ids come first, are encoded as
``-`` and never tampered with.  NULL texts, other NULLs and empty texts have leaves
like all others; a repeated row is one more leaf; an empty table gives no rows; other columns
do not enter a leaf.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import ranked
from .common import written

FANOUT = 8
DEPTH = 3
WIDTH = FANOUT**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string,hashed:boolean>"

__all__ = ["FANOUT", "DEPTH", "manifest", "leaves"]


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; texts that are all ASCII take the faster built-in."""
    kept = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(kept)


def leaves(docs: DataFrame) -> DataFrame:
    """``lang, doc_id, leaf, tampered`` of every row; ``tampered`` is NULL where the row was left alone."""
    def digest(text: Column) -> Column:
        return F.sha2(F.concat(*[_encoded(text if c == "text" else F.col(c)) for c in FIELDS]), 256)

    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.col("text").cast("string")
    return docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"),
        digest(text).alias("leaf"), F.when(chosen, digest(lower_ascii(text))).alias("tampered"),
    )


def _alone(first: Column) -> Column:
    """Ranks have no gaps: a first group of one child means that no other node is left on the level."""
    return first & (F.size("kids") == 1)


def _blocks(nodes: DataFrame) -> DataFrame:
    """``key, block, h, kids``: nodes ``key, pos, h, item`` rolled up to one row per 512 of them."""
    digits = [F.expr(f"pos div {FANOUT**d} % {FANOUT}").alias(f"d{d}") for d in range(DEPTH)]
    rows = nodes.select("key", F.expr(f"pos div {WIDTH}").alias("block"), *digits, "h", F.col("item").alias("kids"))
    # Every group below keeps the key and the block, so the rows of a block stay where this puts them.
    rows = rows.repartition("key", "block")
    for d in range(DEPTH):
        above = [f"d{k}" for k in range(DEPTH - 1, d, -1)]
        nested = rows.groupBy("key", "block", *above).agg(
            F.sort_array(F.collect_list(F.struct(F.col(f"d{d}").alias("d"), "h", "kids"))).alias("kids")
        )
        first = F.col("block") == 0
        for digit in above:
            first = first & (F.col(digit) == 0)
        together = F.sha2(F.array_join(F.transform("kids", lambda k: k["h"]), ""), 256)
        rows = nested.withColumn("h", F.when(_alone(first), F.get("kids", F.lit(0))["h"]).otherwise(together))
    return rows.select("key", "block", "h", "kids")


def _opened(blocks: DataFrame, *carried: str) -> DataFrame:
    """Nodes of ``blocks`` (``key, pos, h, item`` and the carried columns) with ``up``, the steps from each to the root.

    A step holds the digests left and right of the node within its run, from the node upwards.
    """
    rows = blocks.withColumn("pos", F.col("block"))
    for _ in range(DEPTH):
        first = F.col("pos") == 0
        beside = lambda start, n: F.array_join(F.transform(F.slice("kids", start, n), lambda k: k["h"]), "")
        alone = _alone(first)
        children = F.transform("kids", lambda k, i: F.struct(
            k["d"].alias("d"), k["h"].alias("h"), k["kids"].alias("kids"),
            F.struct(beside(F.lit(1), i).alias("left"), beside(i + 2, F.lit(FANOUT)).alias("right"), (~alone).alias("hashed")).alias("step"),
        ))
        rows = rows.select("key", "pos", "up", *carried, F.explode(children).alias("c")).select(
            "key", (F.col("pos") * FANOUT + F.col("c.d")).alias("pos"), F.col("c.h").alias("h"), F.col("c.kids").alias("kids"),
            F.concat(F.array("c.step"), F.col("up")).alias("up"), *carried,
        )
    return rows.withColumnRenamed("kids", "item")


def _met(blocks: DataFrame, above: DataFrame, *carried: str) -> DataFrame:
    """``blocks`` with what lies above them: both sides are put under one another and grouped by block."""
    both = blocks.unionByName(above, allowMissingColumns=True)
    return both.groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("h", "kids", "up", *carried)])


def _stages(nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """All stages of blocks over ``nodes``; the last has one block per key, whose digest is the key's root."""
    stages = [written(_blocks(nodes), name)]
    while largest > WIDTH:
        largest = -(-largest // WIDTH)
        upper = stages[-1].select("key", F.col("block").alias("pos"), "h", F.struct("block").alias("item"))
        stages.append(written(_blocks(upper), name))
    return stages


def _descend(stages: list[DataFrame], top: DataFrame, *carried: str) -> DataFrame:
    """Nodes of the first stage with their steps; ``top`` holds what lies above the last stage's blocks."""
    above = top
    for stage in reversed(stages[1:]):
        above = _opened(_met(stage, above, *carried), *carried).select("key", F.col("pos").alias("block"), "up", *carried)
    return _opened(_met(stages[0], above, *carried), *carried)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row, and ``lang`` and ``proof``.

    ``proof`` lists the digests beside the leaf, level by level up to the root; ``folded_root``
    is what they give with the leaf of the tampered row.
    """
    # The reading order only parts equal rows, so that no range holds all copies of one.
    rows = leaves(docs).withColumn("_at", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("_at")]
    placed = written(ranked(rows, ["lang"], order, "rank"), "leaves")
    largest = placed.agg(F.max("rank")).first()[0] or 0
    own = _stages(placed.select(
        F.col("lang").alias("key"), (F.col("rank") - 1).alias("pos"), F.col("leaf").alias("h"), F.struct("doc_id", "tampered").alias("item"),
    ), largest, "blocks")

    subroots = own[-1].select(F.lit(0).alias("all"), F.col("key").alias("lang"), "h")
    languages = written(ranked(subroots, ["all"], [F.asc_nulls_first("lang")], "rank"), "languages")
    upper = _stages(languages.select(
        F.col("all").alias("key"), (F.col("rank") - 1).alias("pos"), "h", F.struct("lang").alias("item"),
    ), languages.count(), "roots")
    root = upper[-1].select("key", "block", F.array().cast(f"array<{STEP}>").alias("up"), F.col("h").alias("root"))
    above = _descend(upper, root, "root").select(
        F.col("item.lang").alias("key"), F.lit(0).cast("long").alias("block"), "up", "root", F.col("h").alias("subroot"),
    )
    found = _descend(own, above, "root", "subroot")

    folded = F.aggregate(
        "up", F.coalesce(F.col("item.tampered"), F.col("h")),
        lambda h, step: F.when(step["hashed"], F.sha2(F.concat(step["left"], h, step["right"]), 256)).otherwise(h),
    )
    proof = F.transform("up", lambda step: F.concat(step["left"], step["right"]))
    out = found.select(
        F.col("item.doc_id").alias("doc_id"), F.col("key").alias("lang"), F.col("h").alias("leaf"), "subroot", "root",
        F.array_join(proof, "").alias("proof"), folded.alias("folded_root"),
    )
    return out.withColumns({"proof_sha256": F.sha2("proof", 256), "verified": F.col("folded_root") == F.col("root")})
