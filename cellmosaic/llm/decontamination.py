"""Benchmark decontamination over a distributed positional inverted index.

The index keeps, for every corpus occurrence of an indexed term, a posting
``term, uid, pos`` with the term numbers of the ``width - 1`` places on either side.  Test
items are matched from their rarest terms: each window of ``width`` consecutive item words
contributes its term of the lowest corpus frequency, only those terms are indexed, and the
lists of the neighbouring terms are intersected offset by offset from the anchor outwards.
A run of at least ``width`` agreeing places is an exact phrase match; many item terms near
the anchor in any order are a proximity match.

Test items are taken in blocks of bounded vocabulary, each block against all documents, so
what a task holds does not grow with the test set or the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, slices, without_ids

WIDTH = 10
#: Words of test items in one block at most (a single longer item is a block of its own).
BLOCK_WORDS = 400_000
NEAR_TERMS = 8

_DOC_ROW = -1
# Lower-case A-Z, and a space for every ASCII byte that is not a letter or a digit.
_FOLD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered."""
    return (text or b"").translate(_FOLD).split()


def _item_words(items: DataFrame) -> DataFrame:
    """``item, item_id, words``: ``item`` tells rows apart; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.binary()))], ["item_id", "words"]
            )

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    split = rows.mapInArrow(run, "item_id long, words array<binary>").where("size(words) > 0")
    return cut(split.withColumn("item", F.monotonically_increasing_id()))


def _occurrences(block: DataFrame, number, width: int) -> DataFrame:
    """``item, item_id, n, off, term, before, after``: item words as numbers with their neighbours, nearest first."""
    reach = width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = number.value.__getitem__
        for batch in batches:
            ids = [list(map(find, words)) for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["item", "item_id", "ids"]
            )

    items = block.select("item", "item_id", "words").mapInArrow(run, "item long, item_id long, ids array<int>")
    return items.select("item", "item_id", "ids", F.size("ids").alias("n"), F.posexplode("ids").alias("off", "term")).select(
        "item", "item_id", "n", "off", "term",
        F.reverse(F.slice("ids", F.greatest(F.col("off") - (reach - 1), F.lit(1)), F.least("off", F.lit(reach)))).alias("item_before"),
        F.slice("ids", F.col("off") + 2, F.lit(reach)).alias("item_after"),
    )


def _numbered(texts: pa.Array, number: dict[bytes, int]) -> Iterator[np.ndarray]:
    find = number.get
    for t in texts.cast(pa.binary()):
        yield np.fromiter((find(w, -1) for w in words_of(t.as_py())), np.int32)


def _frequencies(docs: DataFrame, number) -> DataFrame:
    """``term, df`` over the whole corpus: how often each numbered term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(number.value) + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                ids = np.concatenate(list(_numbered(part.column(0), number.value)) or [np.empty(0, np.int32)])
                counts += np.bincount(ids + 1, minlength=len(counts))
        terms = np.flatnonzero(counts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(counts[1:][terms])], ["term", "df"])

    part = docs.select(F.col("text").cast("string")).mapInArrow(run, "term int, df long")
    return part.groupBy("term").agg(F.sum("df").alias("df"))


def build_index(docs: DataFrame, number, wanted, width: int = WIDTH) -> DataFrame:
    """Postings ``uid, doc_id, term, pos, before, after`` of the wanted terms, with one row per
    document (``term`` -1, ``pos`` its number of words) so that documents without postings stay.

    ``uid`` is a hash of the row that, with the doc_id, tells rows apart.  It is the same whenever and
    wherever the row is read, so indexes made for different blocks of items name the same documents;
    rows that are equal share it, and their hits.
    """
    reach = width - 1
    steps = np.arange(1, reach + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(len(number.value) + 1, bool)
        keep[wanted.value + 1] = True
        for batch in batches:
            for part in slices(batch, 1 << 20):
                uids, ids_of, terms, places, befores, afters, b_off, a_off = [], [], [], [], [], [], [0], [0]
                for doc_id, uid, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), _numbered(part.column(1), number.value)):
                    padded = np.concatenate([np.full(reach, -2, np.int32), ids, np.full(reach, -2, np.int32)])
                    at = np.flatnonzero(keep[ids + 1])
                    uids.append(np.full(len(at) + 1, uid, np.int64))
                    ids_of += [doc_id] * (len(at) + 1)
                    terms.append(np.concatenate([[_DOC_ROW], ids[at]]))
                    places.append(np.concatenate([[len(ids)], at]))
                    befores.append(padded[(at + reach)[:, None] - steps].ravel())
                    afters.append(padded[(at + reach)[:, None] + steps].ravel())
                    b_off += [b_off[-1]] + [b_off[-1] + reach * (i + 1) for i in range(len(at))]
                if not uids:
                    continue
                a_off = pa.array(np.array(b_off), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(uids), pa.int64()), pa.array(ids_of, pa.int64()),
                        pa.array(np.concatenate(terms), pa.int32()), pa.array(np.concatenate(places), pa.int64()),
                        pa.ListArray.from_arrays(a_off, pa.array(np.concatenate(befores), pa.int32())),
                        pa.ListArray.from_arrays(a_off, pa.array(np.concatenate(afters), pa.int32())),
                    ],
                    ["uid", "doc_id", "term", "pos", "before", "after"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("uid", F.xxhash64("doc_id", "text"))
    return cut(rows.mapInArrow(
        run, "uid long, doc_id long, term int, pos long, before array<int>, after array<int>"
    ))


def _run_length(a: Column, b: Column) -> Column:
    """How many leading elements of ``a`` (an item side, perhaps short) equal those of ``b``."""
    miss = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(miss == 0, F.size(a)).otherwise(miss - 1)


def _anchors(occurrences: DataFrame, frequency: DataFrame, width: int) -> DataFrame:
    """Occurrences that are the rarest word of some window; ties go to the first word of the window.

    A word that the corpus lacks anchors its windows too: without postings they match nowhere.
    """
    weighed = occurrences.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # A window that starts at s covers s..s+width-1; a short item is one window.
    starts = F.sequence(
        F.greatest(F.lit(0), F.col("off") - (width - 1)),
        F.greatest(F.lit(0), F.least(F.col("off"), F.col("n") - width)),
    )
    rarest = (
        weighed.select("item", F.explode(starts).alias("s"), "off", "df")
        .groupBy("item", "s").agg(F.min_by("off", F.struct("df", "off")).alias("off"))
        .select("item", "off").distinct()
    )
    return weighed.where("df > 0").join(rarest, ["item", "off"]).drop("df")


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Documents ``uid, doc_id, n_words`` and matches ``uid, doc_id, item_id, start, end, exact, near``.

    ``start..end`` (word places, inclusive) is the run of agreeing words around an anchor;
    ``exact`` marks runs that hold a whole window.  ``near`` marks anchors with at least
    ``NEAR_TERMS`` distinct item words within ``width - 1`` places on both sides.
    """
    spark = docs.sparkSession
    words = _item_words(items)
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = -(-total // BLOCK_WORDS) or 1
    blocks = words.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    documents, found = None, None
    for part in range(parts):
        index, hits = _block(spark, docs, blocks.where(F.col("part") == part), width)
        documents = index if documents is None else documents
        found = hits if found is None else found.unionByName(hits)
    return documents, found


def _block(spark: SparkSession, docs: DataFrame, block: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    vocabulary = sorted(bytes(r.word) for r in block.select(F.explode("words").alias("word")).distinct().collect())
    number = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    anchors = cut(_anchors(_occurrences(block, number, width), _frequencies(docs, number), width))
    terms = np.array(sorted(r.term for r in anchors.select("term").distinct().collect()), np.int64)
    index = build_index(docs, number, spark.sparkContext.broadcast(terms), width)
    documents = index.where(F.col("term") == _DOC_ROW).select("uid", "doc_id", F.col("pos").alias("n_words"))
    joined = index.where(F.col("term") != _DOC_ROW).join(anchors, "term")
    left, right = _run_length(F.col("item_before"), F.col("before")), _run_length(F.col("item_after"), F.col("after"))
    around = lambda b, a: F.array_distinct(F.concat(b, a, F.array("term")))
    common = F.size(F.array_intersect(around(F.col("item_before"), F.col("item_after")), around(F.col("before"), F.col("after"))))
    rows = joined.withColumns({"left": left, "right": right, "common": common}).select(
        "uid", "doc_id", "item_id", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"),
        (F.col("left") + 1 + F.col("right") >= F.least(F.col("n"), F.lit(width))).alias("exact"),
        (F.col("common") >= NEAR_TERMS).alias("near"),
    )
    return documents, cut(rows.where("exact or near"))


def _with_hits(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits joined to their documents; a NULL doc_id is one like any other."""
    right = hits.withColumnsRenamed({"uid": "_u", "doc_id": "_d"})
    return documents.join(right, (F.col("uid") == F.col("_u")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_u", "_d")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, spans``.

    ``spans`` are the hit runs of words.  A NULL or wordless text has no words and no hits;
    without items nothing is hit; rows with the same doc_id are judged one by one; an item id
    that occurs twice counts once; NULL item ids are hit but not listed.
    """
    documents, found = matches(docs, items, width)
    exact = found.where("exact").groupBy("uid", "doc_id").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"),
    )
    near = found.where("near").groupBy("uid", "doc_id").agg(F.count_distinct("item_id").alias("n_near_items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(-1).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["upto"], x["end"]).alias("upto"),
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"] - 1))).alias("n"),
        ),
        lambda s: s["n"],
    )
    none = F.array().cast("array<string>")
    return _with_hits(_with_hits(documents, exact), near).select(
        "doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
        F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"), "spans",
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` without any hit word; all columns are kept, and so are rows without an id.

    Where rows share a doc_id and one of them is hit, all of them go.
    """
    return without_ids(docs, contamination(docs, items, width).where("contaminated").select("doc_id"))
