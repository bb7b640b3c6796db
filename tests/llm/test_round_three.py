"""Licence scan, vector codes and Merkle manifest beside brute force, and on nulls, empty and odd input."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from cellmosaic.llm import license_rules, license_scan, merkle_manifest, vector_codes
from tests.llm.test_operators import CLASHING, DOCS, prose, some_docs

BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in BETWEEN.split(low) if w]


# 11 ------------------------------------------------------------------------------------------

LINES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT license", "All Rights Reserved.", "GNU General Public License v3",
    "SPDX-License-Identifier: BSD-3-Clause", "CC BY-NC-SA 4.0", "licensed under CC BY 4.0 CC BY", "all rights all rights reserved reserved",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "published under the terms of the Mozilla Public License 2.0", "(c) Copyright 2020", "tous droits réservés", "the mit of licenses", "GPL",
]


def scanned(text):
    """Detections pair by pair: base labels and places, and the labels that stay."""
    words = words_of(text)
    found = []
    for r in license_rules.rules():
        for p, w in enumerate(words):
            if w == r.keyword:
                around = words[max(0, p - 24) : p] + ["\x01" + w + "\x02"] + words[p + 1 : p + 25]
                m = re.search(r.pattern, " ".join(around))
                if m:
                    x = m.group().strip(" ").split(" ")
                    a = p - next(i for i, y in enumerate(x) if "\x01" in y)
                    found.append((a, a + len(x), r))
    base = [f for f in found if f[2].base]
    rest = [f for f in found if not f[2].base]
    def gone(f):
        a, b, r = f
        for c, d, q in rest:
            if (c, d, q) == (a, b, r):
                continue
            if c <= a and d >= b and (q.priority > r.priority or q.priority == r.priority and (c < a or d > b or q.rule < r.rule)):
                return True
            if c >= a and d <= b and q.priority > r.priority:
                return True
        return False
    stay = [f for f in rest if not gone(f)]
    labels = lambda fs: ",".join(sorted({f[2].label for f in fs}))
    starts = [f[0] for f in base]
    score = max([license_rules.WEIGHTS[f[2].priority] for f in base + stay], default=0.0)
    return len(words), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(base + stay), score


def phrase_places(text):
    words, phrases = words_of(text), [["cc", "by"], ["general", "public", "license"], ["all", "rights", "reserved"]]
    return sorted(i for p in phrases for i in range(len(words)) if words[i : i + len(p)] == p)


def test_license_scan_against_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(40):
        parts = [prose(rnd, rnd.randint(0, 6)) for _ in range(rnd.randint(0, 4))] + [rnd.choice(LINES) for _ in range(rnd.randint(0, 5))]
        rnd.shuffle(parts)
        rows.append((i, rnd.choice([" ", "\n", ". "]).join(parts), "en", "s"))
    want = {i: scanned(t) for i, t, *_ in rows}
    got = {
        r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        for r in license_scan.scan(spark.createDataFrame(rows, DOCS)).collect()
    }
    assert got == want
    for i, t, *_ in rows:
        places = phrase_places(t)
        assert (want[i][1], want[i][2], want[i][3]) == (len(places), min(places, default=None), max(places, default=None))


def test_every_rule_is_bounded_and_has_one_keyword():
    rules = license_rules.rules()
    assert len(rules) >= 300 and len({r.rule for r in rules}) == len(rules)
    for r in rules:
        assert not re.search(r"(?<!\\)[*+]|\{\d+,\}", r.pattern.replace(r"\S+", "")), r
        assert r.pattern.count("\x01") == 1 and words_of(r.keyword) == [r.keyword]


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
    ("released under the mit license", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ("under the Expat license", "mit"),
    ("nothing of the kind", ""),
])
def test_license_signatures(spark, text, labels):
    assert license_scan.scan(spark.createDataFrame([(1, text, "en", "s")], DOCS)).first().labels == labels


def test_license_scan_on_odd_input(spark):
    long = "all rights reserved license " * 4000
    rows = some_docs()[-8:] + [(7, long, "en", "s"), (7, long, "en", "s"), (8, None, None, None), (9, "", "en", "s")]
    odd = spark.createDataFrame([(*r, 1, 2, "a", 3, "b", 4, 0.5, 5, "c", 6) for r in rows], CLASHING)
    got = license_scan.scan(odd).collect()
    assert len(got) == len(rows)
    assert [(r.n_words, r.n_base, r.first_word, r.last_word) for r in got if r.doc_id == 7] == [(16000, 4000, 0, 15996)] * 2
    assert [(r.n_words, r.n_base, r.labels, r.score) for r in got if r.doc_id in (8, 9)] == [(0, 0, "", 0.0)] * 2
    assert license_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


# 12 ------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def coded(rows):
    """Every distance evaluated, in Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[r[1][q * w : (q + 1) * w] for q in range(4)] for r in kept]
    books = [[p[q] for p in parts[:256]] for q in range(4)]
    def near(p, book):
        return min((sum((x - y) ** 2 for x, y in zip(p, e)), n) for n, e in enumerate(book))
    for _ in range(4):
        for q in range(4):
            groups = {}
            for p in parts:
                groups.setdefault(near(p[q], books[q])[1], []).append(p[q])
            for n, members in groups.items():
                books[q][n] = [sum(c) // len(members) for c in zip(*members)]
    found = [[near(p[q], books[q]) for q in range(4)] for p in parts]
    flat = ",".join(str(x) for book in books for e in book for x in e)
    out = [(r[0], r[2], "".join("%02x" % n for _, n in f), sum(d for d, _ in f)) for r, f in zip(kept, found)]
    by_label = {}
    for _, label, _, error in out:
        by_label[label] = by_label.get(label, 0) + error
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    return sorted(((i, l, c, e, by_label[l]) for i, l, c, e in out), key=key), hashlib.sha256(flat.encode()).hexdigest(), key


def some_vectors(n, width=8, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(width)], rnd.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(n + k, rows[k % 3][1], 1) for k in range(60)]  # many equal vectors
    rows += [(1000, None, 1), (1001, [None] + [0.5] * (width - 1), 1), (1002, [float("nan")] * width, 0), (1003, [float("inf")] * width, 0), (None, [0.25] * width, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,width", [(330, 8), (40, 4)])
def test_vector_codes_against_all_distances(spark, n, width):
    rows = some_vectors(n, width)
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want, digest, key = coded(rows)
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got), key=key) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_pivot_bounds_lose_no_nearest_entry():
    rnd = np.random.default_rng(3)
    for scale in (2, 500, 1 << 26):
        book = rnd.integers(-scale, scale, (256, 16))
        part = np.concatenate([rnd.integers(-scale, scale, (300, 16)), book[:50], np.repeat(book[:1], 30, 0)])
        book[200] = book[7]
        pivots = vector_codes.choose_pivots(book[None])[0]
        index, squared = vector_codes.nearest(part, vector_codes._distances(part, pivots), book, vector_codes._distances(book, pivots))
        every = ((part[:, None] - book[None]) ** 2).sum(-1)
        assert (index == every.argmin(1)).all() and (squared == every.min(1)).all()


def test_vector_codes_on_odd_input(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(empty).count() == 0
    rows = [(1, [1e30, -1e30, 0.5, 0.1], 0, 5), (2, [0.1] * 4, 0, 6), (3, [0.1] * 5, 0, 7), (4, [], None, 8), (5, [0.2] * 4, None, 9)]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code long")
    got = {r.vec_id: r for r in vector_codes.compress(odd).collect()}
    assert set(got) == {1, 2, 5} and all(r.error == 0 for r in got.values())


# 13 ------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows):
    """The tree built list by list; every proof is folded on its own."""
    def leaf(doc_id, source, lang, n_chars, text):
        return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def steps(levels, p):
        for level in levels[:-1]:
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            yield run[: p % 8], run[p % 8 + 1 :]
            p //= 8

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:3])
        trees[lang] = tree([x[2] for x in by_lang[lang]])
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for n, lang in enumerate(langs):
        for p, (_, _, h, r) in enumerate(by_lang[lang]):
            way = [*steps(trees[lang], p), *steps(top, n)]
            cur = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                cur = leaf(*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in way:
                cur = sha(*left, cur, *right)
            root = top[-1][0]
            out.append((r[0], h, trees[lang][-1][0], root, sha(*[x for a, b in way for x in a + b]), cur, cur == root))
    return out


FULL = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("n,langs", [(0, 1), (1, 1), (9, 1), (65, 2), (700, 3), (120, 40)])
def test_merkle_manifest_against_lists(spark, n, langs):
    rnd = random.Random(n)
    names = [None, "", "en", "é", "z"] + [f"l{i}" for i in range(40)]
    rows = [(rnd.randint(0, 10**9), rnd.choice(["a", None, "ü"]), names[(i % 7 > 0) * i % langs], rnd.choice([None, 3]), rnd.choice(["Text", "straße Ä", None, "", "ABC É"])) for i in range(n)]
    if n > 20:
        rows += [rows[0], rows[0], (None, None, None, None, None), (None, None, None, None, None), (rows[1][0], "other", rows[1][2], 1, "X" * 50_000)]
    frame = spark.createDataFrame(rows, FULL).repartition(5) if rows else spark.createDataFrame([], FULL)
    assert sorted_rows(merkle_manifest.manifest(frame).select(*COLUMNS).collect()) == sorted_rows(manifest(rows))


def test_merkle_manifest_with_clashing_columns(spark):
    rows = [(i, "s", "en", 1, f"T{i}", 1, "x", 2, "y", 3) for i in range(10)]
    frame = spark.createDataFrame(rows, FULL + ", key long, leaf string, pos long, h string, rank long")
    assert sorted_rows(merkle_manifest.manifest(frame).select(*COLUMNS).collect()) == sorted_rows(manifest([r[:5] for r in rows]))


# Near-dedup stage and edges of disguised words ---------------------------------------------------


def test_one_of_each_group_by_jaccard(spark):
    """The stage against all pairs of five-word shingle sets at 0.8."""
    from cellmosaic.llm import shingle_dedup

    rnd, rows = random.Random(9), []
    for i in range(40):
        words = prose(rnd, rnd.choice([1, 3, 8, 30, 60, 200])).split()
        rows.append((2 * i, " ".join(words), "en", "s"))
        if i % 2:
            words = list(words)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(["x", "y", "z"])
            rows.append((2 * i + 1, " ".join(words), "en", "s"))
    passage = prose(rnd, 60)
    rows += [(200 + i, prose(rnd, 100) + " " + passage, "en", "s") for i in range(6)] + [(300, None, "en", "s"), (301, "", "en", "s"), (302, rows[0][1], "en", "s")]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = {i: grams(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id for r in shingle_dedup.keep_one(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == {i for i in root if find(i) == i} and len(got) < len(rows)


def test_signs_at_word_edges_are_stripped_in_one_scan():
    import time

    from cellmosaic.llm import toxicity

    started = time.time()
    for n in (50, 10_000):
        assert toxicity.stripped("x" + "$" * n + "a") == "x" + "$" * n + "a"
        assert toxicity.stripped("x" + "$" * n) == "x" and toxicity.stripped("$" * n + "!") == ""
    assert time.time() - started < 5
    assert [toxicity.stripped(w) for w in ("(word)!", "a$!", "$a", "_x_", "$$a@@", "a!!$")] == ["word", "a$", "$a", "_x_", "a", "a!!$"]
