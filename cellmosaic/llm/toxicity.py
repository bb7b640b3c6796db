"""Toxicity scores after noisy-channel deobfuscation.

1. A character trigram model is counted over all documents.
2. Tokens that may be disguised become lattices: a digit or symbol may stand for the letters
   it resembles, a separator or a space between single letters may be noise, a run of a
   letter may be a drawn-out one.  A Viterbi pass picks the most probable reading under the
   character model and the channel costs.  Plain words have one reading and skip the lattice.
3. Restored words and word beginnings are the features of a logistic model, learned from a
   bounded sample of labelled documents outside the held-out fold.

Every pass maps documents where they lie; only counts, the sample's words and the model move.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_fold, cut, slices

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Labelled rows and features that the fit uses at most.
MAX_SAMPLE, MAX_FEATURES = 20_000, 4_000
#: Lengths of word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Toxic sample documents that must share a feature.
MIN_SUPPORT = 3
#: Tokens whose restored form a task remembers; only speed depends on it.
MEMORY = 200_000

# The modelled letters (0 is the end of a word and everything else) and what a sign may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
SUBSTITUTE, DROP, COLLAPSE = 1.0, 0.7, 0.3

_SIZE = 64
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x110000, np.uint8)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
    if len(_c.upper()) == 1:
        _TABLE[ord(_c.upper())] = _i
_SIGN, _MONEY = re.compile(r"[^\w$@]+"), re.compile(r"[$@]{2,}")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!])(?:[ ._*-]+(?:[^\W_]|[@$!])){2,}(?!\S)")
_RUNS = re.compile(r"(.)\1*", re.S)


def _trigrams(text: str) -> np.ndarray:
    codes = _TABLE[np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    return codes[:-2] * (_SIZE * _SIZE) + codes[1:-1] * _SIZE + codes[2:]


def character_counts(docs: DataFrame) -> DataFrame:
    """``gram, n``: how often each packed character trigram occurs in all texts, ends of words included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                joined = "  ".join(t for t in part.column(0).to_pylist() if t)
                counts += np.bincount(_trigrams(joined), minlength=len(counts))
        grams = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(counts[grams])], ["gram", "n"])

    part = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram int, n long")
    return part.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: Iterable[tuple[int, int]]) -> np.ndarray:
    """Log probabilities of a character after two others, smoothed towards shorter contexts."""
    c3 = np.zeros(_SIZE**3)
    for gram, n in counts:
        c3[gram] = n
    c3 = c3.reshape(_SIZE, _SIZE, _SIZE)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + _SIZE)
    p2 = (c2 + 8 * p1) / (c2.sum(1, keepdims=True) + 8)
    return np.log((c3 + 8 * p2) / (c3.sum(2, keepdims=True) + 8)).astype(np.float32)


def readings(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice of a token: for every run of one character its possible letters and their costs."""
    out = []
    for run in _RUNS.finditer(token):
        c, n = run.group(1), len(run.group(0))
        if c in _CODE:
            # two of a letter are as common as one; more are drawn out
            out.append([(c * n, 0.0)] if n < 3 else [(c, COLLAPSE), (c * 2, COLLAPSE)])
        elif c in LOOKALIKES:
            kept = [(x * min(n, 2), SUBSTITUTE * min(n, 2)) for x in LOOKALIKES[c]]
            out.append(kept + ([(x, SUBSTITUTE) for x in LOOKALIKES[c]] if n > 1 else []) + [("", DROP * n)])
        else:
            out.append([("", 0.0 if spaced or c in " ._*-" else DROP)])
    return out


def restore(token: str, model: np.ndarray, spaced: bool = False) -> str:
    """The most probable reading of a lower-case token (Viterbi over the last two letters)."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in readings(token, spaced):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, back) in best.items():
            for letters, cost in choices:
                s, x, y, trail = score - cost, a, b, back
                for c in letters:
                    z = _CODE[c]
                    s, x, y, trail = s + float(model[x, y, z]), y, z, (c, trail)
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, trail)
        best = after
    ended = [(score + float(model[a, b, 0]), trail) for (a, b), (score, trail) in best.items()]
    trail = max(ended, key=lambda x: x[0])[1]
    out = []
    while trail:
        out.append(trail[0])
        trail = trail[1]
    return "".join(reversed(out))


def stripped(token: str) -> str:
    """A token without the signs at its edges, in one scan; a single ``$`` or ``@`` may be a letter and stays."""
    at, end = 0, len(token)
    while found := _SIGN.match(token, at) or _MONEY.match(token, at):
        at = found.end()
    while end > at:
        last, start = token[end - 1], end - 1
        if last in "$@":
            while start > at and token[start - 1] in "$@":
                start -= 1
            if end - start < 2:
                break
        elif last.isalnum() or last == "_":
            break
        end = start
    return token[at:end]


def restored(token: str, model: np.ndarray) -> str:
    """A token without its decoration; disguised ones are decoded; empty where it has no letter."""
    core = stripped(token)
    if core.isalpha() and not _DRAWN.search(core):
        return core
    if not any(c.isalpha() for c in core):
        return ""
    return restore(core, model)


def words_of(text: str, model: np.ndarray, memory: dict[str, str]) -> set[str]:
    """Distinct restored words of a whole text, with those hidden in rows of single letters."""
    lower, out = text.lower(), set()
    for token in set(lower.split()):
        word = memory.get(token)
        if word is None:
            if len(memory) >= MEMORY:
                memory.clear()
            word = memory[token] = restored(token, model)
        out.add(word)
    for row in _SPACED.finditer(lower):
        out.add(restore(row.group(0), model, spaced=True))
    out.discard("")
    return out


def marks_of(word: str) -> list[str]:
    """Features of a word: itself and its beginnings."""
    return [f"={word}"] + [f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]


@dataclass
class Scorer:
    model: np.ndarray
    weights: dict[str, float]
    bias: float

    def of(self, words: Iterable[str]) -> float:
        found = {m for w in words for m in marks_of(w) if m in self.weights}
        return 1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[m] for m in found), -40, 40)))


def _fit(rows: list[list[int]], toxic: np.ndarray, n_features: int, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic model of present features by Adam on the regularised likelihood."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.fromiter((c for r in rows for c in r), np.int64)
    w, b = np.zeros(n_features), float(np.log((toxic.mean() + 1e-6) / (1 - toxic.mean() + 1e-6)))
    m, v, mb, vb, decay = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0, 1e-4
    for step in range(1, steps + 1):
        z = b + np.bincount(at, w[cols], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic) / len(rows)
        g, gb = np.bincount(cols, error[at], n_features) + decay * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-10)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-10)
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """Scorer from the labelled rows outside the held-out fold; None without a toxic label.

    A document with several labels counts as toxic if one says so.  The sample is the
    ``MAX_SAMPLE`` labelled documents with the smallest id hashes.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        (crc_fold("doc_id", FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = {r.doc_id: r.toxic for r in marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_SAMPLE).collect()}
    if not any(sample.values()):
        return None
    model = language_model((r.gram, r.n) for r in character_counts(docs).collect())
    shared, chosen = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(sample)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str] = {}
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                rows = [k for k, i in enumerate(ids) if i in chosen.value]
                found = [sorted({m for w in words_of(part.column(1)[k].as_py() or "", shared.value, memory) for m in marks_of(w)}) for k in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in rows], pa.int64()), pa.array([chosen.value[ids[k]] for k in rows], pa.int32()), pa.array(found, pa.list_(pa.string()))],
                    ["doc_id", "toxic", "marks"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = cut(rows.mapInArrow(words, "doc_id long, toxic int, marks array<string>").dropDuplicates(["doc_id"]))
    totals = seen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not totals.t:
        return None
    counts = seen.select("toxic", F.explode("marks").alias("mark")).groupBy("mark").agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")
    )
    lift = F.log((F.col("t") + 0.5) / (totals.t + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (totals.n - totals.t + 1))
    top = counts.where(F.col("t") >= MIN_SUPPORT).withColumn("lift", lift).where("lift > 1")
    names = [r.mark for r in top.orderBy(F.desc(F.col("lift") * F.sqrt("t")), "mark").limit(MAX_FEATURES).collect()]
    place = {m: i for i, m in enumerate(names)}
    known = spark.createDataFrame(list(place.items()) or [("", -1)], "mark string, place int")
    matrix = seen.select("doc_id", "toxic", F.explode_outer("marks").alias("mark")).join(F.broadcast(known), "mark", "left").groupBy(
        "doc_id"
    ).agg(F.max("toxic").alias("toxic"), F.sort_array(F.collect_set("place")).alias("places")).orderBy("doc_id").collect()
    weights, bias = _fit([list(r.places) for r in matrix], np.array([r.toxic for r in matrix], float), len(names))
    return Scorer(model, {m: float(weights[i]) for m, i in place.items()}, float(bias))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    NULL and empty texts have no words and get the score of an empty text.  Without a toxic
    label outside the held-out fold every score is 0.  NULL ids count as fold 0; repeated rows
    get equal scores.
    """
    scorer = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str] = {}
        known = shared.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                scores = [known.of(words_of(t or "", known.model, memory)) if known else 0.0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
