"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at minimiser positions: places whose hash of ``gram`` words is the
smallest of some ``window`` neighbouring ones.  The choice depends on content alone, so two
copies of a passage keep the same places.  Kept suffixes are sorted by their next words and
compared with their neighbours; matches are then extended left and right.

With ``core = min_words - window + 1``: every passage of ``min_words`` words has a kept
place among its first ``window`` that is followed by ``core`` words of the passage.  So

1. suffixes go on only if their first ``core`` words have the hash of a suffix of another document;
2. suffixes with equal core and surroundings (``window`` words before and after the core, two
   64-bit hashes together) fold into one, and folded ones with equal right sides into one right side;
3. the distinct right sides are sorted over all tasks and compared with their neighbours word by
   word.  The common lengths cut the order into intervals, one set for every length of match; an
   interval that passes the end of a task's range is carried over from the edge rows;
4. matches are extended left: in an interval of right sides that agree for ``min_words - b`` words,
   suffixes whose ``b`` words before are equal share a passage of ``min_words`` words.  Only
   lengths that a neighbour reaches are looked up;
5. a suffix covers its shared passages, which all hold its core.  Overlapping and touching spans
   of a document are merged.

So the result is every word of a passage of ``min_words`` words that stands in two documents, and
no other.  Words are told by 64-bit hashes, words to the left by one 64-bit hash within an interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, written

MIN_WORDS, WINDOW, GRAM = 50, 24, 8
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words (ASCII capitals lowered, split at ASCII white space)."""
    words = (text or b"").lower().split()
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL
    return x ^ (x >> np.uint64(29))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, by doubling: runs of powers of two are joined to any length."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    whole, at, piece, size, rest = None, 0, words, 1, n
    while rest:
        if rest & 1:
            if whole is None:
                whole = piece
            else:
                m = min(len(whole), len(piece) - at)
                whole = _mixed(whole[:m] * np.uint64(3) + _mixed(piece[at : at + m]))
            at += size
        rest >>= 1
        if rest:
            piece = _mixed(piece[:-size] * np.uint64(3) + _mixed(piece[size:])) if len(piece) > size else np.empty(0, np.uint64)
            size *= 2
    return whole[: len(words) - n + 1]


def minimisers(words: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Places that hold the smallest ``gram`` hash of some window; in ties the last place counts."""
    grams = _mixed(run_hashes(words, gram))
    if len(grams) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    picked = len(grams) - 1 - (np.arange(len(views)) + views.argmin(axis=1))
    return np.unique(picked)


def suffixes(docs: DataFrame, min_words: int, window: int, gram: int) -> DataFrame:
    """``uid, doc_id, pos, core, around`` of every kept suffix with a whole core, and one row per document
    (``pos`` -1, ``core`` its number of words).  ``uid`` tells rows with one doc_id apart."""
    size = min_words - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 2 << 20):
                uids, ids, places, cores, arounds = [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                    words = word_hashes(text.as_py())
                    at = minimisers(words, gram, window)
                    at = at[at + size <= len(words)]
                    padded = np.concatenate([np.zeros(window, np.uint64), words, np.zeros(window, np.uint64)])
                    core = run_hashes(words, size)[at] if len(at) else np.empty(0, np.uint64)
                    around = run_hashes(padded, size + 2 * window)[at] if len(at) else np.empty(0, np.uint64)
                    uids.append(np.full(len(at) + 1, uid))
                    ids += [doc_id] * (len(at) + 1)
                    places.append(np.concatenate([[-1], at]))
                    cores.append(np.concatenate([[np.int64(len(words))], core.view(np.int64)]))
                    arounds.append(np.concatenate([[np.int64(0)], around.view(np.int64)]))
                    uid += 1
                if uids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(uids), pa.int64()), pa.array(ids, pa.int64()), pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(cores), pa.int64()), pa.array(np.concatenate(arounds), pa.int64())],
                        ["uid", "doc_id", "pos", "core", "around"],
                    )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "uid long, doc_id long, pos long, core long, around long")


def _contexts(docs: DataFrame, folded: DataFrame, min_words: int, window: int) -> DataFrame:
    """One row per folded suffix: ``core, around, lo, hi``, ``proof`` (a second hash of the core), ``side`` (hash of the
    right side), ``after`` (the ``window - 1`` words behind the core, 0 for none), ``lefts`` (hash of the last 0 to
    ``window - 1`` words before it), ``n_left`` and ``n_right`` (how many of these words there are)."""
    size, deep = min_words - window + 1, window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                flat, lists = [[] for _ in range(8)], [[], []]
                for text, lo, places in zip(part.column(0).cast(pa.binary()), part.column(1).to_pylist(), part.column(2)):
                    words = word_hashes(text.as_py())
                    padded = np.concatenate([np.zeros(window, np.uint64), words, np.zeros(window, np.uint64)])
                    around = run_hashes(padded, size + 2 * window).view(np.int64)
                    at, want, hi = (np.array(places.values.field(k), np.int64) for k in range(3))
                    # Rows with one doc_id share their places; the surroundings tell which are this row's.
                    own = at + size <= len(words)
                    own[own] = around[at[own]] == want[own]
                    at, want, hi = at[own], want[own], hi[own]
                    if not len(at):
                        continue
                    after = padded[(at + window + size)[:, None] + np.arange(deep)]
                    before = padded[(at + window - 1)[:, None] - np.arange(deep)]
                    lefts = np.zeros((len(at), window), np.uint64)
                    for b in range(deep):
                        lefts[:, b + 1] = _mixed(lefts[:, b] * np.uint64(3) + _mixed(before[:, b]) + np.uint64(1))
                    core = run_hashes(words, size)[at]
                    proof = run_hashes(_mixed(words ^ _MUL), size)[at]
                    side = run_hashes(_mixed(after.ravel()), deep)[::deep]
                    left, right = np.minimum(at, deep), np.minimum(len(words) - size - at, deep)
                    for into, x in zip(flat, (core.view(np.int64), want, np.full(len(at), lo), hi, proof.view(np.int64), side.view(np.int64), left, right)):
                        into.append(x)
                    lists[0].append(after.view(np.int64).ravel())
                    lists[1].append(lefts.view(np.int64).ravel())
                if flat[0]:
                    n = sum(len(x) for x in flat[0])
                    arrays = [
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.concatenate(x), pa.int64()))
                        for k, x in zip((deep, window), lists)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x), pa.int64()) for x in flat] + arrays,
                        ["core", "around", "lo", "hi", "proof", "side", "n_left", "n_right", "after", "lefts"],
                    )

    per_doc = folded.groupBy("lo").agg(F.sort_array(F.collect_list(F.struct("pos", "around", "hi"))).alias("places"))
    rows = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text")
    )
    joined = rows.join(per_doc, F.col("_d") == F.col("lo")).select("text", "lo", "places")
    return joined.mapInArrow(
        run, "core long, around long, lo long, hi long, proof long, side long, n_left long, n_right long, after array<long>, lefts array<long>"
    )


def _agreed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common beginning of rows ``(core, proof, words...)``: number of equal words, -1 where the cores differ; 0 is no word."""
    same = (a == b) & ((a != 0) | (np.arange(a.shape[1]) < 2))
    whole = same.cumprod(axis=1).sum(axis=1)
    return np.maximum(whole - 2, -1)


def intervals(rights: DataFrame, deep: int) -> DataFrame:
    """Sort distinct right sides ``core, proof, side, after`` and compare neighbours.

    Returns ``core, proof, side, reach`` (most words of ``after`` that a neighbour has too, -1 if none has the core)
    and ``ids``: for 0 to ``deep`` words, the interval of right sides that agree with this one for so many.
    The sort runs over ranges of all tasks; the driver sees the first and the last row of each range only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, depths = TaskContext.get().partitionId(), np.arange(deep + 1)
        held, last, starts, seen = None, None, np.zeros(deep + 1, np.int64), 0

        def finish(held, following: int, final: bool) -> pa.RecordBatch:
            keys, side, common, begins, at = held
            reach = np.maximum(common, np.append(common[1:], following))
            edge = [k.tolist() if i == 0 or (final and i == at[-1]) else None for i, k in zip(at.tolist(), keys)]
            n = len(at)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(keys[:, 1]), side, pa.array(reach), pa.array(np.full(n, number), pa.int64()), pa.array(at),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (deep + 1), pa.int32()), pa.array(begins.ravel())), pa.array(edge, pa.list_(pa.int64()))],
                ["core", "proof", "side", "reach", "part", "at", "starts", "edge"],
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            words = batch.column(3).flatten().to_numpy().reshape(n, deep)
            keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), words])
            common = np.full(n, -1, np.int64)
            common[1:] = _agreed(keys[1:], keys[:-1])
            if last is not None:
                common[:1] = _agreed(keys[:1], last)
            at = np.arange(seen, seen + n)
            begins = np.where(common[:, None] < depths, at[:, None], starts)
            begins = np.maximum.accumulate(begins, axis=0)
            if held is not None:
                yield finish(held, int(common[0]), False)
            held, last, starts, seen = (keys, batch.column(2), common, begins, at), keys[-1:], begins[-1], seen + n
        if held is not None:
            yield finish(held, -1, True)

    order = ["core", "proof", "after"]
    ranged = rights.select("core", "proof", "side", "after").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(
        ranged.mapInArrow(run, "core long, proof long, side long, reach long, part long, at long, starts array<long>, edge array<long>"), "intervals"
    )
    ends: dict[int, list] = {}
    for r in placed.where("edge is not null").select("part", "at", "starts", "edge").orderBy("part", "at").collect():
        ends.setdefault(r.part, []).append(r)
    rows, before = [], None
    for part, own in sorted(ends.items(), key=lambda item: item[1][0].edge):
        ahead = -1 if before is None else int(_agreed(np.array([own[0].edge]), np.array([before[0].edge]))[0])
        carried = [before[1][d] if d <= ahead else None for d in range(deep + 1)]
        final = own[-1]
        ids = [c if c is not None and s == 0 else (part << 40) + s for c, s in zip(carried, final.starts)]
        if rows:
            rows[-1][3] = ahead
        rows.append([part, carried, ahead, -1, final.at])
        before = (final, ids)
    carry = placed.sparkSession.createDataFrame([tuple(r) for r in rows], "part long, carried array<long>, ahead long, behind long, final long")
    own_id = F.zip_with("starts", "carried", lambda s, c: F.when((s == 0) & c.isNotNull(), c).otherwise(F.shiftleft("part", 40) + s))
    # One row per range: their number is the number of shuffle partitions.
    return placed.join(F.broadcast(carry), "part").select(
        "core", "proof", "side",
        F.greatest("reach", F.when(F.col("at") == 0, F.col("ahead")), F.when(F.col("at") == F.col("final"), F.col("behind"))).alias("reach"),
        own_id.alias("ids"),
    )


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_repeated, spans``: per row, the word spans (inclusive) that repeat across documents.

    Rows with the same doc_id are one document here: what only they share is no repeat.  NULL,
    empty and short texts have no spans; rows without an id have none either.  An empty table
    gives no rows.
    """
    size = min_words - window + 1
    if not gram <= size:
        raise ValueError("min_words must exceed the window by the length of a gram at least")
    # Written as Parquet: ids repeat and places ascend, so a suffix takes little more than its two hashes.
    found = written(suffixes(docs, min_words, window, gram), "suffixes")
    documents = found.where("pos < 0").select("uid", "doc_id", F.col("core").alias("n_words"))
    kept = found.where("pos >= 0 and doc_id is not null")
    # A table of its own, so that the join can split a core that a large part of all suffixes share.
    several = written(
        kept.groupBy("core").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select("core"), "cores"
    )
    meeting = written(kept.join(several, "core"), "meeting")
    folded = meeting.groupBy("core", "around").agg(F.min(F.struct("doc_id", "pos")).alias("one"), F.max("doc_id").alias("hi")).select(
        "around", F.col("one.doc_id").alias("lo"), F.col("one.pos").alias("pos"), "hi"
    )
    contexts = written(_contexts(docs, folded, min_words, window), "contexts")
    deep = window - 1
    sides = contexts.groupBy("core", "proof", "side").agg(
        F.any_value("after").alias("after"), F.count(F.lit(1)).alias("n"), F.max("n_right").alias("n_right")
    )
    # A right side that several folded suffixes have is its own neighbour.
    several_lefts = sides.where("n > 1").select("core", "proof", "side", F.lit(True).alias("again"))
    placed = intervals(sides, deep)
    rights = written(placed.join(several_lefts, ["core", "proof", "side"], "left"), "rights")
    copied = F.col("lo") < F.col("hi")
    reach = F.when(F.col("again"), F.col("n_right")).otherwise(F.least("reach", "n_right"))
    # Passages that start ``b`` words before the suffix: the right side must agree for the others behind the core.
    first = F.greatest(F.lit(deep) - reach, F.lit(0).cast("long"))
    backs = F.when(first <= F.col("n_left"), F.sequence(first, F.col("n_left")))
    keys = F.transform(backs, lambda b: F.struct(
        b.alias("back"), F.get("ids", (deep - b).cast("int")).alias("interval"), F.get("lefts", b.cast("int")).alias("left")
    ))
    # Tables of their own, so that the joins can split a side or a passage that a large part of all suffixes share.
    matches = written(contexts.join(rights, ["core", "proof", "side"]).select("core", "around", "lo", "hi", keys.alias("keys")), "matches")
    named = matches.select("core", "around", "lo", "hi", F.explode("keys").alias("key")).select("core", "around", "lo", "hi", "key.*")
    passage = ["back", "interval", "left"]
    shared = written(named.groupBy(*passage).agg(F.min("lo").alias("_a"), F.max("hi").alias("_b")).where("_a < _b").select(*passage), "shared")
    met = named.where(~copied).join(shared, passage).groupBy("core", "around").agg(
        F.max("back").alias("first"), F.min("back").alias("last")
    )
    # Of surroundings that two documents have, every passage within the text is shared.
    same = contexts.where(copied & (F.lit(deep) - F.col("n_right") <= F.col("n_left"))).select(
        "core", "around", F.col("n_left").alias("first"), (F.lit(deep) - F.col("n_right")).alias("last")
    )
    extents = written(met.unionByName(same), "extents")
    spans = meeting.join(extents, ["core", "around"]).groupBy("uid").agg(
        F.sort_array(F.collect_set(F.struct(
            (F.col("pos") - F.col("first")).alias("start"), (F.col("pos") - F.col("last") + (min_words - 1)).alias("end")
        ))).alias("spans")
    )
    rows = documents.join(spans, "uid", "left").select("doc_id", "n_words", _merged(F.col("spans"), F.col("n_words")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans")).select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"] + 1).alias("n_repeated"), "spans",
    )


def _merged(spans: Column, n_words: Column) -> Column:
    """Sorted spans joined where they overlap or touch, none past the last word."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(s: Column, x: Column) -> Column:
        end = F.least(x["end"], n_words - 1)
        last = F.element_at(s, -1)
        joined = F.concat(
            F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end")))
        )
        apart = F.concat(s, F.array(F.struct(x["start"].alias("start"), end.alias("end"))))
        return F.when((F.size(s) > 0) & (x["start"] <= last["end"] + 1), joined).otherwise(apart)

    return F.aggregate(spans, empty, add)
