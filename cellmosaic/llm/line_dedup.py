"""Line dedup by a segment-partition edit join.

A line goes when an earlier line of the corpus (in the order of doc_id and line number) is
equal to it, or is within ``max_edits`` edits of it while both have at least ``min_chars``
characters.  Equal lines, told by their 128-bit digest, are folded first, so copies cost
nothing further.

Of two lines within ``t`` edits the shorter one, cut into ``t + 1`` segments, has a segment
that the longer one contains unchanged near its place.  Segments are indexed under (length,
segment number, hash); a line probes, for every possible shorter length, only the substrings
whose place the multi-match-aware bounds allow.  Candidates are filtered by letter counts
(an edit changes at most two of them by one) and verified by a bit-parallel edit distance on
the band of 2t + 1 diagonals.  DataFrame functions only.

Texts are shuffled once, by a hash of the row; every later step joins small tables to that
exchange.  Index rows name a line by that hash and its number, which only looks lines up:
what is verified and removed are the lines themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE

MAX_EDITS, MIN_CHARS = 2, 24
# Letters whose counts filter candidates: frequent in many languages.
_COUNTED = "etaoinsrhldcumg"
_PLACE_BITS, _ROW_BITS = 28, 35


def dealt(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row`` dealt by ``row``, a hash of both that tells rows with one doc_id apart.

    Rows without an id or a text have no place in the order and are left out.
    """
    rows = docs.where("text is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.withColumn("row", _row_hash(F.col("doc_id"), F.col("text"))).repartition("row")


def _row_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def first_places(texts: DataFrame) -> DataFrame:
    """``doc_id, row, firsts``: numbers of the lines with a word that occur in no earlier place of the corpus.

    Lines end at a line feed; numbers start at 0.
    """
    lines = texts.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(
        F.col("line").rlike(f"[^{SPACE}]")
    )
    digest = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    folded = lines.groupBy(*digest).agg(F.min(F.struct("doc_id", "row", "line_no")).alias("at"))
    return _per_document(folded.select("at.*"), "firsts")


def _per_document(places: DataFrame, name: str) -> DataFrame:
    """Line numbers of ``doc_id, row, line_no`` as a sorted list per document, dealt by ``row``."""
    return places.repartition("row").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("line_no")).alias(name))


def _at_home(texts: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Join per-document lists to the texts where they lie.

    The doc_id, if ``small`` has it, is compared by a condition that is not a join key, so the
    exchange by ``row`` serves as it is.
    """
    right = small.withColumnRenamed("row", "_r")
    same = F.col("row") == F.col("_r")
    if "doc_id" in small.columns:
        right = right.withColumnRenamed("doc_id", "_d")
        same = same & (F.col("doc_id") - F.col("_d") == 0)
    return texts.join(right.hint("shuffle_hash"), same, how).drop("_d", "_r")


def _picked(texts: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """``doc_id, row, line_no, line, place`` of the lines whose numbers ``places`` lists.

    ``place`` packs the row hash and the line number.
    """
    split = _at_home(texts, places).select("doc_id", "row", F.split("text", "\n", -1).alias("_all"), name)
    lines = F.col("_all")
    pick = F.transform(
        F.filter(name, lambda i: i < F.size(lines)), lambda i: F.struct(i.alias("line_no"), F.get(lines, i).alias("line"))
    )
    place = F.shiftleft("row", _PLACE_BITS).bitwiseOR(F.col("line_no").cast("long"))
    return split.select("doc_id", "row", F.explode(pick).alias("_p")).select("doc_id", "row", "_p.*").withColumn("place", place)


def entries(lines: DataFrame, max_edits: int) -> DataFrame:
    """``key, place, sketch`` of every segment of a line and of every substring that may equal one of another line.

    Bit 60 of ``sketch`` tells probes (1) from segments (0).  A segment is also the probe of its
    own place for lines of the same length and stands once for both.
    """
    parts, moves = max_edits + 1, []
    for i in range(parts):
        for shorter in range(parts):
            low, high = max(-i, shorter - (max_edits - i)), min(i, shorter + (max_edits - i))
            moves += [(int((shorter, move) != (0, 0)), shorter, i, move) for move in range(low, high + 1)]
    kinds = ("probe", "shorter", "i", "move")
    spread = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(kinds, m)]) for m in moves]))
    rows = lines.select("place", "line", "len", "sketch", spread.alias("m")).select("place", "line", "len", "sketch", "m.*")
    # Of the parts + 1 segments of an indexed line the last ``l % parts`` are one character longer.
    sized = rows.withColumn("l", F.col("len") - F.col("shorter")).withColumns({
        "short": F.expr(f"cast(l div {parts} as int)"), "extra": F.col("i") - (F.lit(parts) - F.col("l") % parts),
    })
    start = F.col("i") * F.col("short") + F.greatest(F.lit(0), F.col("extra")) + 1 + F.col("move")
    size = F.col("short") + (F.col("extra") >= 0).cast("int")
    cut_out = sized.withColumns({"start": start, "size": size}).where("start >= 1 and start + size - 1 <= len and size > 0")
    return cut_out.select(
        F.xxhash64("l", "i", F.substring(F.col("line"), F.col("start"), F.col("size"))).alias("key"), "place",
        F.col("sketch").bitwiseOR(F.shiftleft(F.col("probe").cast("long"), 60)).alias("sketch"),
    )


def _sketch(line: Column) -> Column:
    """Counts of the letters modulo 16, packed in a long."""
    packed = F.lit(0).cast("long")
    for k, c in enumerate(_COUNTED):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(15)).cast("long"), 4 * k))
    return packed


def _letter_gap(a: Column, b: Column) -> Column:
    """A lower bound of the sum of differences of the letter counts: an edit adds at most two."""
    one = lambda k: F.shiftright(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * k).bitwiseAND(F.lit(15))
    return sum(F.least(F.abs(one(k)), F.lit(16) - F.abs(one(k))) for k in range(len(_COUNTED)))


def within_edits(a: Column, b: Column, max_edits: int) -> Column:
    """True if two lists of characters are within ``max_edits`` edits, their sizes already being so.

    Bit-parallel on a band: vector ``e`` has a bit for each of the 2t + 1 diagonals, set if the
    prefixes that end there are within ``e`` edits.  A character of ``b`` advances all of them:
    a match or a substitution stays on its diagonal, an insertion comes from the next and a
    deletion from the previous one.  ``a`` and ``b`` must be plain columns, because every step
    reads them.
    """
    t, width = max_edits, 2 * max_edits + 1
    long = lambda x: F.lit(x).cast("long")
    full = long((1 << width) - 1)

    def step(s: Column, x: Column) -> Column:
        same = [F.when(F.get(a, x["j"] + (k - t)) == x["c"], long(1 << k)).otherwise(long(0)) for k in range(width)]
        equal = same[0]
        for bit in same[1:]:
            equal = equal.bitwiseOR(bit)
        return _advance(s, equal, t, full)

    start = F.array(*[long(sum(1 << (t + i) for i in range(e + 1))) for e in range(t + 1)])
    steps = F.transform(b, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
    reached = F.aggregate(steps, start, step, lambda s: F.get(s, F.lit(t)))
    last = F.get(F.array(*[long(1 << k) for k in range(width)]), F.size(a) - F.size(b) + t)
    return F.coalesce(reached.bitwiseAND(last) != 0, F.lit(False))


def _advance(s: Column, equal: Column, t: int, full: Column) -> Column:
    rows = [F.get(s, F.lit(0)).bitwiseAND(equal)]
    for e in range(1, t + 1):
        old, fewer = F.get(s, F.lit(e)), F.get(s, F.lit(e - 1))
        rows.append(
            old.bitwiseAND(equal).bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(rows[-1], 1)).bitwiseAND(full)
        )
    return F.array(*rows)


def near_pairs(
    texts: DataFrame, firsts: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``a, b``: places of two different first lines, each of ``min_chars`` or more, within ``max_edits`` edits."""
    if max_edits < 1 or min_chars <= 2 * max_edits:
        raise ValueError("max_edits of 1 or more and lines of more than twice as many characters are needed")
    lines = _picked(texts, firsts, "firsts").withColumn("len", F.length("line")).where(F.col("len") >= min_chars)
    dealt_out = entries(lines.withColumn("sketch", _sketch(F.col("line"))), max_edits).repartition("key")
    # Both sides read one exchange: a segment comes before a probe in bit 60, the only one above the counts.
    # Two segments meet from the smaller place.  No part of the condition is about one side alone, or the exchanges would differ.
    segment = dealt_out.select("key", F.col("place").alias("a"), F.col("sketch").alias("ca"))
    probe = dealt_out.select(F.col("key").alias("_k"), F.col("place").alias("b"), F.col("sketch").alias("cb"))
    kind_a, kind_b = F.shiftright("ca", 60), F.shiftright("cb", 60)
    meet = ((kind_a < kind_b) & (F.col("a") != F.col("b"))) | ((kind_a + kind_b == 0) & (F.col("a") < F.col("b")))
    candidates = segment.join(
        probe,
        (F.col("key") == F.col("_k")) & meet
        & (_letter_gap(F.col("ca"), F.col("cb")) <= 2 * max_edits),
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("place")).distinct().select(
        F.shiftrightunsigned("place", _PLACE_BITS).alias("row"), F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int").alias("line_no")
    )
    per_row = wanted.repartition("row").groupBy("row").agg(F.sort_array(F.collect_list("line_no")).alias("wanted"))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    spelled = _picked(texts, per_row, "wanted").select(
        "place", F.struct("doc_id", "row", "line_no").alias("at"), chars(F.col("line")).alias("x")
    )
    both = candidates.join(
        spelled.select(F.col("place").alias("a"), F.col("at").alias("at_a"), F.col("x").alias("xa")), "a"
    ).join(spelled.select(F.col("place").alias("b"), F.col("at").alias("at_b"), F.col("x").alias("xb")), "b")
    fitting = F.abs(F.size("xa") - F.size("xb")) <= max_edits
    return both.where(fitting & within_edits(F.col("xa"), F.col("xb"), max_edits)).select(
        F.col("at_a").alias("a"), F.col("at_b").alias("b")
    )


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; every row stays, and so do blank lines.

    A document may end up with an empty text.  NULL texts and rows without a doc_id are left
    as they are.  Repeated rows (same id and text) get the same result; rows with the same id
    and different texts are ordered by a hash of the text.  Other columns pass through.
    """
    texts = dealt(docs)
    firsts = first_places(texts)
    later = near_pairs(texts, firsts, max_edits, min_chars).select(F.greatest("a", "b").alias("at")).distinct()
    gone = _per_document(later.select("at.*"), "gone")
    kept = _at_home(firsts, gone, "left").select(
        "doc_id", "row", F.array_except("firsts", F.coalesce("gone", F.array().cast("array<int>"))).alias("kept")
    )
    split = _at_home(texts, kept, "left").select("doc_id", "row", F.split("text", "\n", -1).alias("_all"), "kept")
    lines = F.col("_all")
    blank = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(f"[^{SPACE}]"), i)), lambda i: i.isNotNull())
    placed = split.withColumn("_at", F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blank)))
    text = F.array_join(F.transform("_at", lambda i: F.get(lines, i)), "\n")
    made = placed.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.when(F.size(lines) > 0, text).alias("_new"))
    made = made.dropDuplicates(["_d", "_r"])
    named = [c for c in docs.columns if c != "text"]
    others = docs.where("text is not null and doc_id is not null").select(
        F.struct(*named).alias("_all"), F.col("doc_id").cast("long").alias("_id"),
        _row_hash(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_h"),
    )
    joined = others.join(made, (F.col("_h") == F.col("_r")) & (F.col("_id") - F.col("_d") == 0))
    changed = joined.select(*[F.col("_all")[c].alias(c) for c in named], F.col("_new").alias("text")).select(*docs.columns)
    as_is = docs.where("text is null or doc_id is null").withColumn("text", F.col("text").cast("string"))
    return changed.unionByName(as_is)
