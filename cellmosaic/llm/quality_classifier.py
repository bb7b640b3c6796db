"""Quality classifier learned from positive and unlabelled documents.

Trusted positives are documents labelled good; everything else is unlabelled web text.  The
class prior of the unlabelled text is estimated from the most positive score bins (the
smallest ratio of unlabelled to positive mass above a threshold), and a one-hidden-layer
network minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

stepping back on the second term when it goes below zero.  Bad labels are never used.

Features are computed for every whole text in one pass without a shuffle; the fit uses a
bounded sample (``MAX_SAMPLE`` rows of each kind, the smallest id hashes).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_fold, cut, slices, without_ids

#: Rows of each kind, trusted positives and unlabelled, that the fit uses at most.
MAX_SAMPLE = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

# Bytes of the character classes.
_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_SYMBOL, _PUNCT, _WHITE = b"#*$%&|<>{}[]\\^~=+_@/", b".,;:!?'\"()-", b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_CHUNK = 1 << 20

FEATURES = (
    "log_words", "mean_word", "upper", "lower", "digit", "symbol", "bang", "punct", "white", "high", "line_end",
    "distinct_words", "distinct_pairs", "same_as_before", "dup_lines", "words_per_line", "capped_words", "packed", "pipes", "links", "empty",
)
_LINK = re.compile(rb"https?:|www\.|@")


def features_of(text: bytes | None) -> list[float]:
    """Shape of a whole text; every value is finite, also for NULL and empty texts."""
    b = text or b""
    n = len(b)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    share = lambda chars: (n - len(b.translate(None, chars))) / n
    words, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
    k, pairs = len(words), list(zip(words, words[1:]))
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(b[i : i + _CHUNK])) for i in range(0, n, _CHUNK)) + len(packer.flush())
    return [
        math.log1p(k), min(n / max(k, 1), 50.0), share(_UPPER), share(_LOWER), share(_DIGIT), share(_SYMBOL), b.count(b"!") / n,
        share(_PUNCT), share(_WHITE), share(_HIGH), len(lines) / n * 10, len(set(words)) / max(k, 1),
        len(set(pairs)) / max(len(pairs), 1), sum(x == y for x, y in pairs) / max(len(pairs), 1),
        1 - len(set(lines)) / max(len(lines), 1), math.log1p(k / max(len(lines), 1)),
        sum(w.isupper() for w in words) / max(k, 1), packed / (n + 30), b.count(b"|") / n * 10,
        len(_LINK.findall(b)) / max(k, 1), float(not k),
    ]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` for every row; materialised, because the fit and the scoring both read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [features_of(t.as_py()) for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "x"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut(rows.mapInArrow(run, "doc_id long, x array<float>"))


@dataclass
class Network:
    """Standardisation and weights; ``prior`` is the estimated share of good unlabelled documents."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _descend(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, rate: float) -> None:
    """Adam on the non-negative risk; without a prior, on the plain positive-against-unlabelled risk."""
    z_p, z_u = (np.clip((x - net.centre) / net.scale, -8, 8) for x in (positive, unlabelled))
    names, decay = ("w1", "b1", "w2", "b2"), 1e-4
    first, second = ({k: np.zeros_like(np.asarray(getattr(net, k), float)) for k in names} for _ in range(2))
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for step in range(1, steps + 1):
        h_p, h_u = np.tanh(z_p @ net.w1 + net.b1), np.tanh(z_u @ net.w1 + net.b1)
        g_p, g_u = h_p @ net.w2 + net.b2, h_u @ net.w2 + net.b2
        if prior is None:
            d_p, d_u = -sigmoid(-g_p) / len(g_p), sigmoid(g_u) / len(g_u)
        else:
            rest = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
            if rest >= 0:
                d_p, d_u = -prior * (sigmoid(-g_p) + sigmoid(g_p)) / len(g_p), sigmoid(g_u) / len(g_u)
            else:
                d_p, d_u = prior * sigmoid(g_p) / len(g_p), -sigmoid(g_u) / len(g_u)
        back = [(z, h, d[:, None] * net.w2 * (1 - h * h), d) for z, h, d in ((z_p, h_p, d_p), (z_u, h_u, d_u))]
        slopes = {
            "w1": sum(z.T @ e for z, _, e, _ in back) + decay * net.w1, "b1": sum(e.sum(0) for _, _, e, _ in back),
            "w2": sum(h.T @ d for _, h, _, d in back) + decay * net.w2, "b2": sum(d.sum() for *_, d in back),
        }
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * slopes[k]
            second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
            move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(net, k, getattr(net, k) - move)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from their scores: the smallest ratio of the two
    masses above a threshold, with an allowance for the sample sizes."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 89))
    above_p = np.array([(positive >= c).mean() for c in cuts])
    above_u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = math.sqrt(math.log(40) / 2) * (1 / math.sqrt(len(positive)) + 1 / math.sqrt(len(unlabelled)))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, hidden: int = 16, steps: int = 400, seed: int = 7) -> Network | None:
    """The classifier, or None where there is no trusted positive or no unlabelled text to learn from."""
    if not len(positive) or not len(unlabelled):
        return None
    both = np.concatenate([positive, unlabelled])
    draw, d = np.random.default_rng(seed), both.shape[1]
    fresh = lambda: Network(
        both.mean(0), both.std(0) + 1e-3, draw.normal(0, 1 / math.sqrt(d), (d, hidden)), np.zeros(hidden),
        draw.normal(0, 1 / math.sqrt(hidden), hidden), 0.0, 0.5,
    )
    turn = np.arange(len(positive)) % 2 == 0
    rough = fresh()
    _descend(rough, positive[turn], unlabelled, None, steps, 0.01)
    held = positive[~turn] if (~turn).any() else positive
    prior = estimate_prior(rough.logits(held), rough.logits(unlabelled))
    net = fresh()
    net.prior = prior
    _descend(net, positive, unlabelled, prior, 2 * steps, 0.01)
    return net


def _sample(rows: DataFrame) -> np.ndarray:
    """At most MAX_SAMPLE feature rows: those with the smallest id hashes, in that order."""
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_SAMPLE).select("x").toArrow()
    return few["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))


def train(rows: DataFrame, labels: DataFrame) -> Network | None:
    """Fit on the feature rows whose fold is not held out.  A document with any bad label is not trusted."""
    known = rows.where("doc_id is not null").where(crc_fold("doc_id", FOLDS) != HELD_OUT)
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        crc_fold("doc_id", FOLDS) != HELD_OUT
    ).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return fit(_sample(known.join(trusted, "doc_id", "left_semi")), _sample(known))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    NULL and empty texts are scored like any other.  Without trusted positives nothing can be
    told apart and every score is 0.5.  NULL ids count as fold 0.  Repeated rows get equal scores.
    """
    rows = features(docs)
    net = train(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)
            scores = net.scores(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are predicted good, with all their columns.

    Rows that share an id stay or go together (all are kept if one is good); rows without an id stay.
    """
    bad = score(docs, labels).where("doc_id is not null").groupBy("doc_id").agg(F.max("predicted").alias("p")).where("p = 0")
    return without_ids(docs, bad.select("doc_id"))
