"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of

* the likelihood of the text: hashed byte trigrams, counted per language over all labelled
  documents outside the held-out fold, tempered because neighbouring trigrams overlap;
* the likelihood of the declared markup language and of the address suffix given the
  language, from grouped counts over all pages;
* a prior of the host, smoothed towards its domain, which is smoothed towards all rows.
  Counts are votes of the text alone; a row's own vote is taken out of its host's.

Votes are counted by grouped aggregation and stay tables with a row per key; the text model
has a fixed size per language.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_fold, cut, slices, written

BINS, BLOCK = 1 << 15, 64
FOLDS, HELD_OUT = 5, 0
TEMPER, HOST_WEIGHT, DOMAIN_WEIGHT, EVIDENCE_WEIGHT = 0.25, 10.0, 50.0, 5.0
MIN_CONFIDENCE = 0.5
_CHUNK = 1 << 20

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(
    r"<html\b[^>]*?(?<![\w:-])(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})|<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I
)
# Second labels under which countries register names.
SHARED = "ac|co|com|edu|gob|gov|go|govt|gouv|ltd|mil|ne|net|nom|or|org|sch"
_FIELDS = "kind string, id long, held_out boolean, host string, domain string, suffix string, declared string"


def trigram_bins(text: bytes) -> np.ndarray:
    """Bins of the byte trigrams of a text with ASCII capitals lowered."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _pieces(text: bytes) -> Iterator[bytes]:
    for at in range(0, max(len(text) - 2, 0), _CHUNK):
        yield text[at : at + _CHUNK + 2]


def visible_text(source: str | None) -> str:
    """Text of a page without scripts, styles, comments and tags."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", source or "")))


def declared_language(source: str | None) -> str | None:
    """Lower-case code of the markup's language, None where none is declared."""
    found = _DECLARED.search(source or "")
    return (found.group(1) or found.group(2)).lower() if found else None


def train(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """Languages in order, and the table ``lang, bins`` of their trigram counts (``bin, n``)."""
    labelled = docs.where("lang is not null and text is not null").where(crc_fold("doc_id", FOLDS) != HELD_OUT).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                    own = counts.setdefault(lang, np.zeros(BINS, np.int64))
                    for piece in _pieces(text.as_py()):
                        own += np.bincount(trigram_bins(piece), minlength=BINS)
                    # Counts add up, so a task with many languages gives out what it has.
                    if len(counts) > BLOCK:
                        yield from _given(counts)
                        counts.clear()
        yield from _given(counts)

    found = labelled.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    # A language has BINS entries at most.
    table = written(found.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")), "trigrams")
    return [r.lang for r in table.select("lang").orderBy("lang").collect()], table


def _given(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        bins = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(own[bins])], ["lang", "bin", "n"]
        )


def log_table(table: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Log probabilities of the bins for each of at most ``BLOCK`` languages, in their order."""
    place, counts = {x: i for i, x in enumerate(languages)}, np.full((len(languages), BINS), 0.5)
    for r in table.where(F.col("lang").isin(list(languages))).select("lang", "bins.bin", "bins.n").toLocalIterator():
        counts[place[r.lang], r.bin] += r.n
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _likelihoods(rows: DataFrame, models: Sequence, is_html: bool) -> DataFrame:
    """Turn ``text`` into ``loglik`` (per language, against the best) and, for pages, fill ``declared``.

    There is one pass over the texts for each block of languages, so no task holds more than one block.
    """
    read = rows.withColumn("loglik", F.array().cast("array<double>"))
    for k, model in enumerate(models or [None]):
        read = _scored(read, model, is_html, k + 1 < len(models))
        # Passes of one stage run at the same time; four of them hold four blocks.
        read = cut(read) if k % 4 == 3 else read
    top = F.array_max("loglik")
    return read.drop("text").withColumn("loglik", F.transform("loglik", lambda x: x - top))


def _scored(rows: DataFrame, model, is_html: bool, more: bool) -> DataFrame:
    """Append the log likelihoods of one block of languages to ``loglik``; the text goes on only if there are ``more`` blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value if model else np.zeros((0, BINS), np.float32)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(7)
                out, declared = [], part.column(6)
                if is_html:
                    pages = texts.to_pylist()
                    declared = pa.array([declared_language(p) for p in pages], pa.string())
                    raw = [visible_text(p).encode("utf-8", "surrogatepass") for p in pages]
                else:
                    raw = [t.as_py() or b"" for t in texts.cast(pa.binary())]
                for text, earlier in zip(raw, part.column(8).to_pylist()):
                    total = np.zeros(len(table))
                    for piece in _pieces(text):
                        total += table[:, trigram_bins(piece)].sum(1, dtype=np.float64)
                    out.append(np.concatenate([earlier, total]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:6], declared, texts if more else pa.nulls(len(texts), pa.string()), pa.array(out, pa.list_(pa.float64()))],
                    ["kind", "id", "held_out", "host", "domain", "suffix", "declared", "text", "loglik"],
                )

    return rows.mapInArrow(run, f"{_FIELDS}, text string, loglik array<double>")


def _document_rows(docs: DataFrame) -> DataFrame:
    """Documents have no address: their source stands for the host, below all rows."""
    source = F.concat(F.lit("source:"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    return docs.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        source.alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"), F.lit(None).cast("string").alias("declared"),
        F.col("text").cast("string").alias("text"),
    )


def _page_rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    # Two labels, three under a country's shared suffix (co.uk); an address of numbers stays whole.
    domain = F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(
        F.regexp_extract(host, rf"((?:[^.]+\.(?:{SHARED})\.[a-z]{{2}}|[^.]+\.[^.]+))$", 1)
    )
    suffix = F.when(host.rlike(r"^[0-9.]+$"), F.lit("")).otherwise(F.regexp_extract(host, r"\.([^.]+)$", 1))
    return pages.select(
        F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.lit(True).alias("held_out"), host.alias("host"),
        domain.alias("domain"), suffix.alias("suffix"),
        F.lit(None).cast("string").alias("declared"), F.col("html").cast("string").alias("text"),
    )


def _counts(rows: DataFrame, key: str, languages: Sequence[str]) -> DataFrame:
    """Votes per language of every value of ``key``."""
    counted = rows.where(F.col(key).isNotNull() & F.col("vote").isNotNull()).groupBy(key, "vote").agg(F.count(F.lit(1)).alias("n"))
    # A key has one entry a language at most.
    found = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("_m"))
    votes = F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)))
    return found.select(key, votes.cast("array<bigint>").alias(f"{key}_votes"))


def _posterior(languages: int, overall: np.ndarray, by_suffix: np.ndarray, by_declared: np.ndarray):
    """Fuse record batches of log likelihoods and vote counts."""
    base = (overall + 1) / (overall.sum() + languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            n = batch.num_rows
            table = lambda k: np.array([x or [0] * languages for x in batch.column(k).to_pylist()], np.float64).reshape(n, languages)  # noqa: E731,B023
            loglik, host, domain, suffix, declared = (table(k) for k in range(4, 9))
            vote = np.array([-1 if v is None else v for v in batch.column(3).to_pylist()])
            own = np.zeros((n, languages))
            own[np.arange(n)[vote >= 0], vote[vote >= 0]] = 1
            less = lambda c: np.maximum(c - own, 0)
            d = (less(domain) + DOMAIN_WEIGHT * base) / (less(domain).sum(1, keepdims=True) + DOMAIN_WEIGHT)
            h = (less(host) + HOST_WEIGHT * d) / (less(host).sum(1, keepdims=True) + HOST_WEIGHT)
            score = TEMPER * loglik + np.log(h)
            for counts, totals in ((suffix, by_suffix), (declared, by_declared)):
                # P(value | language) against P(value); no value is no evidence.
                has = counts.sum(1, keepdims=True) > 0
                share = counts.sum(1, keepdims=True) / max(totals.sum(), 1)
                given = (less(counts) + EVIDENCE_WEIGHT * share) / (totals + EVIDENCE_WEIGHT)
                score += np.where(has, np.log(np.maximum(given, 1e-9)), 0)
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(3), pa.array(p.argmax(1), pa.int32()), pa.array(p.max(1)), batch.column(9)],
                ["kind", "id", "held_out", "vote", "best", "confidence", "declared"],
            )

    return run


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document and page: ``kind, doc_id, page_id, lang, confidence, text_lang, declared, held_out, kept``.

    ``text_lang`` is the verdict of the text alone (NULL for texts under three bytes, which
    get their language from the other evidence).  ``kept`` is false where no language has a
    posterior of MIN_CONFIDENCE.  Without any labelled document ``lang`` is NULL, the
    confidence 0 and every row is kept.  Repeated rows repeat, and each counts as a vote.
    """
    languages, trigrams = train(docs)
    # One broadcast a block: at most BLOCK times BINS numbers (8 MB).
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(log_table(trigrams, languages[k : k + BLOCK])) for k in range(0, len(languages), BLOCK)]
    read = _likelihoods(_document_rows(docs), shared, False).unionByName(_likelihoods(_page_rows(pages), shared, True))
    informed = F.exists("loglik", lambda x: x < 0)
    best = (F.array_position("loglik", F.array_max("loglik")) - 1).cast("int")
    rows = cut(read.withColumn("vote", F.when(informed, best)))
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    ids = [F.when(F.col("kind") == k, F.col("id")).alias(c) for k, c in (("document", "doc_id"), ("page", "page_id"))]
    if not languages:
        nothing = F.lit(None).cast("string")
        return rows.select(
            "kind", *ids, nothing.alias("lang"), F.lit(0.0).alias("confidence"), nothing.alias("text_lang"), "declared", "held_out", F.lit(True).alias("kept")
        )
    joined = rows
    for key in ("host", "domain", "suffix", "declared"):
        usable = rows.where(F.col(key) != "") if key != "host" else rows
        joined = joined.join(_counts(usable, key, languages), key, "left")

    def totals(part: DataFrame) -> np.ndarray:
        found = np.zeros(len(languages))
        for r in part.where("vote is not null").groupBy("vote").agg(F.count(F.lit(1)).alias("n")).collect():
            found[r.vote] = r.n
        return found

    fuse = _posterior(len(languages), totals(rows), totals(rows.where("suffix <> ''")), totals(rows.where("declared is not null")))
    ready = joined.select("kind", "id", "held_out", "vote", "loglik", "host_votes", "domain_votes", "suffix_votes", "declared_votes", "declared")
    out = ready.mapInArrow(fuse, "kind string, id long, held_out boolean, vote int, best int, confidence double, declared string")
    return out.select(
        "kind", *ids, F.get(names, "best").alias("lang"), "confidence", F.get(names, "vote").alias("text_lang"), "declared", "held_out",
        (F.col("confidence") >= MIN_CONFIDENCE).alias("kept"),
    )
