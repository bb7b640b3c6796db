"""Quality rules: base counts, and distribution divergence from language references.

A document is compared with the reference of its declared language in two histograms: the
shares of character classes and the shares of the language's most common words.  Both
references are counted over all documents.  The Jensen-Shannon distance (base 2, 0 to 1) to
either may not exceed its limit; texts under a minimum length are not judged by divergence,
because short histograms are noise.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, cut, written

MIN_WORDS = 50
COMMON_WORDS = 20
POOLED = ""


def _ref(lang: Column) -> Column:
    """Name of a language's reference; no language can have the name of the pooled one."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(POOLED))


@dataclass(frozen=True)
class Limits:
    """Largest distances that pass, and the fewest characters and words that are judged."""

    class_distance: float = 0.32
    word_distance: float = 0.50
    min_chars: int = 300
    min_words: int = 60


# Fixed values of the character classes, in the order in which they are taken out of a text.
CLASSES = {
    "lower": "[a-z]+", "space": f"[{SPACE}]+", "upper": "[A-Z]+", "digit": "[0-9]+",
    "symbol": "[#*$%&|<>]+", "punct": r"[\x00-\x7F]+",
}


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, words, c``, the base counts and the guards of every row.

    ``c`` holds the characters of every class, with all that is not ASCII last.  A NULL or
    empty text has no words and all counts zero.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest, lengths = text, [F.length(text)]
    for pattern in CLASSES.values():
        rest = F.regexp_replace(rest, pattern, "")
        lengths.append(F.length(rest))
    counts = F.array(*[(a - b).cast("long") for a, b in zip(lengths, lengths[1:])], lengths[-1].cast("long"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"),
        F.array_remove(F.split(text, f"[{SPACE}]+", -1), "").alias("words"), counts.alias("c"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"),
    )
    space, symbol = (F.element_at("c", list(CLASSES).index(k) + 1) for k in ("space", "symbol"))
    return rows.select(
        "doc_id", "lang", "text", "words", "c",
        F.length("text").cast("long").alias("n_chars"), F.size("words").cast("long").alias("n_words"),
        (F.length("text") - space).cast("long").alias("word_chars"), symbol.alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )


def with_repeated_words(rows: DataFrame, width: int = 3) -> DataFrame:
    """Add ``n_repeat_words``: words in ``width``-word windows found twice or more, the first included.

    Windows are told by a 64-bit hash within their row.  A row whose hashes are all distinct
    has no repeat; in the others the hashes are sorted with their places, and neighbours whose
    words are equal too are the repeats.
    """
    words, h = F.col("words"), F.col("_h")
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, width)]),
    )
    hashed = rows.withColumn("_h", hashes)
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))).otherwise(none)
    ordered = hashed.withColumn("_g", F.sort_array(placed)).drop("_h")
    g = F.col("_g")

    def equal(x: Column, y: Column) -> Column:
        out = x["h"] == y["h"]
        for k in range(width):
            out = out & (F.get(words, x["p"] + k) == F.get(words, y["p"] + k))
        return out

    twice = F.filter(g, lambda x, i: equal(x, F.get(g, i + 1)) | equal(x, F.get(g, i - 1)))
    found = ordered.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("_g")
    p = F.col("_p")
    steps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return found.withColumn("n_repeat_words", covered).drop("_p")


def references(docs: DataFrame) -> DataFrame:
    """Language references: ``ref, classes, common, shares``, one for every language and the pooled one.

    ``classes`` are shares of the character classes; ``common`` are the most frequent words
    (lower case, ties in word order) and ``shares`` their shares of all words, the rest last.
    """
    rows = counted(docs).select(_ref(F.col("lang")).alias("ref"), "c", "n_words")
    n = len(CLASSES) + 1
    totals = [F.sum(c).alias(c) for c in ("n", *[f"c{i}" for i in range(n)])]
    own = cut(rows.groupBy("ref").agg(
        F.sum("n_words").alias("n"), *[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(n)]
    ))
    # Each count goes to its language and to the pooled reference.
    both = F.array_distinct(F.array(F.col("ref"), F.lit(POOLED)))
    sums = own.withColumn("ref", F.explode(both)).groupBy("ref").agg(*totals)
    lower = docs.select(_ref(F.col("lang")).alias("ref"), F.lower(F.col("text").cast("string")).alias("text"))
    words = (
        lower.select("ref", F.explode(F.split("text", f"[{SPACE}]+", -1)).alias("word")).where("word <> ''")
        .groupBy("ref", "word").agg(F.count(F.lit(1)).alias("k"))
        .withColumn("ref", F.explode(both)).groupBy("ref", "word").agg(F.sum("k").alias("k"))
    )
    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("k"), "word"))
    top = words.withColumn("r", rank).where(F.col("r") <= COMMON_WORDS).groupBy("ref").agg(
        F.sort_array(F.collect_list(F.struct("r", "word", "k"))).alias("top")
    )
    total = F.greatest(sum((F.col(f"c{i}") for i in range(1, n)), F.col("c0")), F.lit(1))
    return sums.join(top, "ref", "left").select(
        "ref", F.array(*[F.col(f"c{i}") / total for i in range(n)]).alias("classes"),
        F.coalesce(F.transform("top", lambda x: x["word"]), F.array().cast("array<string>")).alias("common"),
        F.coalesce(F.transform("top", lambda x: x["k"] / F.col("n")), F.array().cast("array<double>")).alias("shares"),
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _with_rest(shares: Column) -> Column:
    used = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - used)))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Base counts, distances and verdict of every row.

    ``class_distance`` and ``word_distance`` are NULL where the text is under the minimum
    length; such texts are kept unless the base rules fail.  Documents without a language
    are compared with the pooled reference.  Repeated rows
    are judged alike; an empty table gives no rows; other columns are ignored.
    """
    # A table, so that Spark knows its size and broadcasts it only if that is small; else rows are shuffled by language,
    # and the join splits a language with a large part of them.
    longest = F.array_max(F.transform("common", F.octet_length))
    refs = written(references(docs).withColumn("longest", longest), "references")
    rows = with_repeated_words(counted(docs)).select(
        "doc_id", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "c",
        _ref(F.col("lang")).alias("ref"), F.transform("words", F.lower).alias("lowered"),
    )
    # Only common words are counted; most others are longer than any of them.
    common = F.filter("lowered", lambda x: (F.octet_length(x) <= F.col("longest")) & F.array_contains("common", x))
    # every word between two spaces of its own, so that neighbours are found independently
    spaced = F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" "))
    compared = rows.join(refs, "ref").withColumn("spaced", spaced).drop("lowered")
    found = lambda w: (
        (F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))))
        / (F.octet_length(w) + 2) / F.col("n_words")
    )
    own = F.transform("c", lambda x: x / F.col("n_chars"))
    distances = compared.withColumns({
        "class_distance": F.when(F.col("n_chars") >= limits.min_chars, _distance(own, F.col("classes"))),
        "word_distance": F.when(
            F.col("n_words") >= limits.min_words,
            _distance(_with_rest(F.transform("common", found)), _with_rest(F.col("shares"))),
        ),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= limits.class_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= limits.word_distance
    )
    return distances.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & near).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
