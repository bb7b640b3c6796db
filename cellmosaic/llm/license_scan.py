"""Licence scan: ordered signature rules behind a keyword prefilter, nested detections resolved.

Every rule of ``license_rules`` names one keyword.  Only the places where a keyword stands are
looked at: the words around it meet the rules of that keyword, a table of fixed size, and a
rule that fits gives a detection, an interval of words.  Of two detections of which one
contains the other, one goes:

- the contained one, if its priority is not higher (of equal intervals and priorities the
  later rule goes);
- the containing one, if its priority is lower.

All detections count as suppressors, also those that go themselves, so the outcome does not
depend on an order of evaluation.  Detections that only overlap both stay.  Base phrases take
no part: their places and labels are always reported.  DataFrame functions only; what is
shuffled is one short row per document and one per detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import license_rules
from .license_rules import REACH, WEIGHTS, Rule

# Fixed value of the contract: what stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OPEN, CLOSE = "\x01", "\x02"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """One row per document (``p`` -1) and one per place of a keyword with ``around``, the words about it.

    Documents are numbered where they are read (``rid``), because ids may be missing or repeated.
    """
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = F.col("words")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.array_remove(F.split(text, BETWEEN, -1), "").alias("words"),
    )
    at = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(keywords), i)))
    p = F.col("p")
    before = F.slice(words, F.greatest(p - REACH, F.lit(0)) + 1, F.least(p, F.lit(REACH)))
    after = F.slice(words, p + 2, F.lit(REACH))
    marked = F.concat(F.lit(OPEN), F.get(words, p), F.lit(CLOSE))
    return rows.select("rid", "doc_id", "words", F.explode(F.concat(F.array(F.lit(-1)), at)).alias("p")).select(
        "rid", "doc_id", F.size("words").cast("long").alias("n_words"), "p",
        F.when(p >= 0, F.get(words, p)).alias("keyword"),
        F.when(p >= 0, F.array_join(F.concat(before, F.array(marked), after), " ")).alias("around"),
    )


def detections(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """``rid, doc_id, n_words`` of every document, and a row for each detection with its rule and ``start, end`` in words.

    A document without detections has one row whose ``rule`` is NULL; so has every other, beside its detections.
    """
    signatures = license_rules.rules() if signatures is None else signatures
    spark = docs.sparkSession
    # The table of rules does not depend on the data.
    table = F.broadcast(spark.createDataFrame(
        [tuple(s) for s in signatures], "rule int, label string, priority int, base boolean, _keyword string, pattern string"
    ))
    places = _places(docs, sorted({s.keyword for s in signatures}))
    match = F.trim(F.expr("regexp_extract(around, pattern, 0)"))
    tried = places.join(table, F.col("keyword") == F.col("_keyword"), "left").withColumn("match", match)
    start = F.col("p") - _spaces(F.substring_index("match", OPEN, 1))
    return tried.where("p < 0 or match <> ''").select(
        "rid", "doc_id", "n_words", "rule", "label", "priority", "base",
        F.when(F.col("p") >= 0, start).cast("long").alias("start"),
        F.when(F.col("p") >= 0, start + _spaces(F.col("match")) + 1).cast("long").alias("end"),
    )


def resolved(found: DataFrame) -> DataFrame:
    """Add ``stays``: false where a detection is suppressed.

    Within a document the detections are sorted by start, widest and foremost first, so all that may contain a row
    come before it and all that it may contain come after it; the furthest end before and the
    nearest end after are kept per priority.  A row per document is the unit: no text's detections leave its document.
    """
    levels = sorted(WEIGHTS)
    order = [F.col("start"), F.desc("end"), F.desc("priority"), F.col("rule")]
    # Base phrases and the documents' own rows do not take part.
    part = F.col("base").eqNullSafe(F.lit(False))
    window = Window.partitionBy("rid").orderBy(*order)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    # Rows of the same start that come later are no wider, so together with the later starts they are all that can lie inside.
    later = window.rowsBetween(1, Window.unboundedFollowing)
    furthest = [F.max(F.when(part & (F.col("priority") >= level), F.col("end"))).over(earlier) for level in levels]
    nearest = [F.min(F.when(part & (F.col("priority") > level), F.col("end"))).over(later) for level in levels]
    inside = _pick(levels, furthest) >= F.col("end")
    # An equal interval of higher priority comes first, so it is seen by ``furthest``.
    around = _pick(levels, nearest) <= F.col("end")
    return found.withColumn("stays", part & ~F.coalesce(inside, F.lit(False)) & ~F.coalesce(around, F.lit(False)))


def _pick(levels: list[int], columns: list[Column]) -> Column:
    out = F.when(F.col("priority") == levels[0], columns[0])
    for level, column in zip(levels[1:], columns[1:]):
        out = out.when(F.col("priority") == level, column)
    return out


def scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """Licences of every row: counts and places of the base phrases, labels, and ``found``, the detections that stay.

    ``score`` is the weight of the surest detection that stays, that of a name at least where a base phrase
    stands, 0 without any.  A NULL or empty text has no words and no labels; a repeated row is
    judged again; rows without an id keep NULL; an empty table gives no rows; other columns are ignored.
    Labels of one interval that tie in priority are told by the order of the rules.
    """
    rows = resolved(detections(docs, signatures))
    weight = F.coalesce(*[F.when(F.col("priority") == k, F.lit(w)) for k, w in WEIGHTS.items()])
    base = F.col("base")
    listed = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return rows.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), listed(base).alias("base_labels"),
        listed(base | F.col("stays")).alias("labels"),
        F.coalesce(F.max(F.when(base | F.col("stays"), weight)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("start", "end", "rule", "label", "priority")))).alias("found"),
    ).drop("rid")
