"""Every corpus operator beside a brute-force version, and on nulls, empty and odd input."""

import hashlib
import random
import re
import time

import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from cellmosaic.llm import (
    decontamination, html_extraction, language_id, line_dedup, quality_classifier, quality_rules, sentencepiece_codec, simhash, suffix_dedup, toxicity,
)
from cellmosaic.llm.queries import TOKENIZERS

DOCS = "doc_id long, text string, lang string, source string"
# Names that the operators use inside, as extra columns of the input.
CLASHING = "doc_id long, text string, lang string, source string, row long, _id long, _all string, fp long, line string, key long, score double, uid long, words string, core long"
WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta river stone cloud paper green table window garden silver winter".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "ed", "er"]) for _ in range(n))


def some_docs(seed=3, n=24):
    rnd = random.Random(seed)
    rows = [(i, "\n".join(prose(rnd, 30) for _ in range(3)), "en", "s0") for i in range(n)]
    rows += [
        (100, rows[0][1], "en", "s0"), (101, rows[0][1].replace("river", "rivet", 1), "en", "s1"), (102, None, "en", None), (103, "", None, "s1"),
        (104, "  \n\t\n ", "de", "s1"), (105, "one", "en", "s1"), (106, "x " * 3000, "en", "s1"), (107, prose(rnd, 20_000), "en", "s1"),
        (3, rows[3][1], "en", "s0"), (None, rows[4][1], "en", "s0"), (None, None, None, None), (108, "ÄÖ É\x00 \x0b end\r\nline\nline", "fr", "s1"),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, 2, "a", 3, "b", 4, 0.5, 5, "c", 6) for r in some_docs()[:6] + some_docs()[-8:]]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1 -------------------------------------------------------------------------------------------


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(words, words[1:], words[2:]))
    seen, covered = {}, set()
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_rules_count_as_brute_force(docs):
    got = sorted(tuple(r)[:6] for r in quality_rules.judge(docs).where("doc_id is not null").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted((r[0], *base(r[1])) for r in some_docs() if r[0] is not None)


def test_quality_rules_reject_foreign_shapes_and_spare_short_ones(spark, odd, empty):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, 120), "en", "s") for i in range(30)]
    rows += [(50, " ".join(w.upper() + "###" for w in prose(rnd, 120).split()), "en", "s"), (51, prose(rnd, 120), None, "s"), (52, "ZZ## " * 3, "en", "s")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].kept for i in range(30)) and not got[50].kept and not got[50].base_failed
    assert got[52].class_distance is None and got[52].base_failed
    assert quality_rules.judge(odd).count() == 14 and quality_rules.judge(empty).count() == 0


def test_quality_rules_know_every_language_and_long_words(spark, tmp_path):
    import duckdb

    from cellmosaic.llm.oracles import QUALITY_RULES

    rnd = random.Random(31)
    rows = [(i, prose(rnd, 65) + f" {'q' * 50}{i % 600} " * 9, f"l{i % 600}", "s") for i in range(1200)]
    rows += [(2000, prose(rnd, 90), "*", "s"), (2001, prose(rnd, 90), None, "s"), (2002, prose(rnd, 90), "", "s")]
    frame = spark.createDataFrame(rows, DOCS)
    assert quality_rules.references(frame).count() == 603
    frame.write.parquet(f"{tmp_path}/documents")
    want = duckdb.sql(QUALITY_RULES.replace("FROM documents", f"FROM '{tmp_path}/documents/*.parquet'"))
    got = quality_rules.judge(frame).select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_quality_rules_count_common_words_in_what_is_left_of_the_others(docs):
    plan = quality_rules.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join(filter(" in plan


# 2 -------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_edit_distance(spark, t):
    from pyspark.sql import functions as F

    rnd, pairs = random.Random(t), []
    for _ in range(150):
        a = "".join(rnd.choice("abcé𝒳") for _ in range(rnd.randint(0, 14)))
        b = list(a)
        for _ in range(rnd.randint(0, t + 1)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 1)] = [rnd.choice("abcé")] * rnd.randint(0, 1)
        if abs(len(a) - len(b)) <= t:
            pairs.append((list(a), b))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = [r.x for r in df.select(line_dedup.within_edits(F.col("a"), F.col("b"), t).alias("x")).collect()]
    assert got == [edits(a, b) <= t for a, b in pairs]


def test_line_dedup_against_brute_force(spark, odd, empty):
    rnd = random.Random(5)
    stock = [prose(rnd, 6) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            line = list(rnd.choice(stock))
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randint(0, len(line) - 1)
                line[k : k + rnd.randint(0, 2)] = rnd.choice(["", "q", "zz"])
            lines.append("".join(line) if rnd.random() < 0.9 else rnd.choice(["", " ", "ab", "abc"]))
        rows.append((i, "\n".join(lines), "en", "s"))
    first = {}
    for i, text, *_ in rows:
        for n, line in enumerate(text.split("\n")):
            if line.strip() and line not in first:
                first[line] = (i, n)
    order = sorted(first, key=first.get)
    gone = {b for k, b in enumerate(order) for a in order[:k] if min(len(a), len(b)) >= 24 and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    assert gone
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (i, n) and x not in gone)) for i, t, *_ in rows}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_nulls_and_repeats(docs):
    out = [tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "text").collect()]
    rows = some_docs()
    assert len(out) == len(rows)
    assert (None, rows[4][1]) in out and out.count((3, rows[3][1])) == 2 and (102, None) in out and (100, "") in out


# 3 -------------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark, docs, odd, empty):
    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    library, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.load(path)
    rnd = random.Random(2)
    texts = ["", " ", "  a  b ", "日本語 and é🙂", "a\nb\tc\x00", "<s>x</s>", "=" * 40, "def f(x):\n        return x\n"]
    texts += ["".join(rnd.choice("abcdeinrt .,\n  THé1230-_=日") for _ in range(rnd.randint(0, 50))) for _ in range(300)]
    assert [vocabulary.encode(t) for t in texts] == [library.encode(t) for t in texts]
    got = sentencepiece_codec.round_trip(docs, vocabulary).collect()
    assert all(r.same for r in got) and len(got) == len(some_docs())
    assert {r.n_tokens for r in got if r.doc_id == 102} == {0} and [r.ids for r in got if r.doc_id == 103] == [[]]
    assert sentencepiece_codec.round_trip(odd, vocabulary).count() == 14 and sentencepiece_codec.round_trip(empty, vocabulary).count() == 0


def test_viterbi_of_a_unigram_model_is_the_best_path():
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "cab"]
    scores = [0, -3.0, -4.0, -4.1, -4.2, -6.0, -5.5, -9.0, -4.5, -8.0]
    v = sentencepiece_codec.Vocabulary(pieces, scores, [2] + [1] * 9, False, True)

    def best(word):
        if not word:
            return 0.0
        return max((scores[i] + best(word[len(p):]) for p, i in v.id_of.items() if word.startswith(p)), default=float("-inf"))

    rnd = random.Random(4)
    for _ in range(100):
        word = "▁" + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8)))
        ids = v.viterbi(word)
        assert "".join(pieces[i] for i in ids) == word and abs(sum(scores[i] for i in ids) - best(word)) < 1e-9
    assert v.encode("a?") == [8, 0]


# 4 and 5 ---------------------------------------------------------------------------------------


def judged_docs(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        junk, toxic = i % 5 == 0, i % 4 == 1
        words = prose(rnd, 80).split()
        if toxic:
            words[7] = words[30] = rnd.choice(["moron", "scumbag"])
        text = " ".join(w.upper() + "!!##" for w in words) if junk else " ".join(words)
        rows.append((i, text, "en", "s"))
        if i % 2 or rnd.random() < 0.7:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, DOCS), labels_of(spark, labels), {i: (int(not j), int(t)) for i, j, t in [(i, i % 5 == 0, i % 4 == 1) for i in range(400)]}


def test_quality_classifier_on_held_out_rows(spark, odd, empty):
    rows, labels, truth = judged_docs(spark)
    got = quality_classifier.score(rows, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == truth[r.doc_id][0] for r in held) >= 0.95 * len(held)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    none = quality_classifier.score(odd, labels_of(spark, [])).collect()
    assert {r.score for r in none} == {0.5} and len(none) == 14
    assert quality_classifier.score(empty, labels).count() == 0
    kept = quality_classifier.keep_good(rows, labels)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_prior_is_estimated():
    import numpy as np
    draw = np.random.default_rng(0)
    good, bad = draw.normal(2, 1, 4000), draw.normal(-3, 1, 1000)
    assert abs(quality_classifier.estimate_prior(draw.normal(2, 1, 4000), np.concatenate([good, bad])) - 0.8) < 0.06


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rows, labels, truth = judged_docs(spark)
    got = [r for r in toxicity.score(rows, labels).collect() if truth[r.doc_id][0]]
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == truth[r.doc_id][1] for r in held)
    assert {r.score for r in toxicity.score(odd, labels_of(spark, [(0, 1, 0)])).collect()} == {0.0}
    assert toxicity.score(empty, labels).count() == 0


def test_disguised_words_are_restored(spark):
    text = " ".join(["the moron and the loser met an idiot in the trash at noon for a stupid game"] * 50)
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, None, "en", "s")], DOCS)
    model = toxicity.language_model((r.gram, r.n) for r in toxicity.character_counts(docs).collect())
    plain = {"m0r0n": "moron", "l0$er": "loser", "1diot": "idiot", "moooooron": "moron", "tr4sh": "trash", "s.t.u.p.i.d": "stupid", "game!!": "game", "12:30": ""}
    assert {k: toxicity.restored(k, model) for k in plain} == plain
    assert "moron" in toxicity.words_of("you M O R O N there", model, {})
    # every reading scored one by one
    import itertools
    for token in ("l0$er", "1d10t"):
        best = max(itertools.product(*toxicity.readings(token)), key=lambda path: _reading_score(path, model))
        assert toxicity.restore(token, model) == "".join(x for x, _ in best)


def _reading_score(path, model):
    codes = [0, 0, *[toxicity._CODE[c] for x, _ in path for c in x], 0]
    return sum(model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:])) - sum(c for _, c in path)


# 6 -------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Top</header><nav><a href=/>Home</a></nav>
<div class="ad-banner">Buy</div><div class="post-{n}"><h1>Head &amp; {n}</h1><p>First  <b>bold</b>
text<p>Second &lt;x&gt;<br>line<script>var a="</p>";</script><!-- no --><ul><li>one<li>two</ul></div>
<div class="comments">rude words {n} and more rude words in a long comment that goes on and on and on</div><form>f</form><footer>&copy; me</footer>"""


def test_html_extraction(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(n=i)) for i in range(4)]
    rows += [(10, None, None), (11, "https://h.example/e", ""), (12, "x", "plain &eacute; text"), (13, "https://h.example/w", "<html><body><p>lost</p></body></html>"), (0, "https://h.example/0", PAGE.format(n=0))]
    got = html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(texts[i] == f"Head & {i} First bold text Second <x> line one two" for i in range(4))
    assert (texts[10], texts[11], texts[12], texts[13]) == ("", "", "plain é text", "lost")
    assert {r.path for r in got if r.page_id == 13} == {"/html/body/div.post-#"}
    assert html_extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string, host string, path string")).count() == 0


def test_optional_head_and_body_tags_may_be_left_out():
    inner = "<div class=post><p>First words of it.<p>Second words.</div>"
    whole = f"<!DOCTYPE html><html><head><title>t</title></head><body>{inner}</body></html>"
    pages = [
        whole, whole.replace("</head>", ""), whole.replace("</head><body>", ""), whole.replace("<body>", "").replace("</body>", ""),
        f"\ufeff<title>t</title><meta charset=utf-8>{inner}", whole.replace("</head><body>", "</head>\n<body><head>"),
    ]
    for page in pages:
        assert html_extraction.vote(page) == "/html/body/div.post"
        assert html_extraction.extract(page, []) == "First words of it. Second words."
    assert html_extraction.extract("<head><title>t</title>Loose text<div>x</div><p>and more of it", []) == "Loose text x and more of it"


def test_text_in_several_blocks_is_kept_whole():
    words = "Running words of the page that say something. "
    page = "<html><body><nav>Menu</nav><div class=wrap>{}</div><div class=more>{}</div><footer>f</footer></body></html>"
    links = "<a href=/x>Another page</a> " * 30
    lead, body, quote = words * 3, words * 9, words * 12
    assert html_extraction.extract(page.format(f"<div class=lead><p>{lead}</div><div class=body><p>{body}</div>", links), []) == " ".join([*lead.split(), *body.split()])
    nested = page.format(f"<div class=lead><p>{lead}</div><div class=body><p>{body}<blockquote><p>{quote}</blockquote></div>", links)
    assert html_extraction.vote(nested) == "/html/body/div.wrap"
    assert html_extraction.extract(nested, []) == " ".join([*lead.split(), *body.split(), *quote.split()])
    figure = f"<article><p>{body}<figure><img src=x><figcaption>A caption</figcaption></figure><p>Sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> here</article>"
    assert html_extraction.extract(page.format(figure, words), []) == " ".join([*body.split(), "A caption Sum x+y here"])


@pytest.mark.parametrize("inside", [
    '<p class="a"">Hello</p><p>there and "so" on</p>', "<p class='a''>Hello</p><p title='>'>there and \"so\" on</p>",
    '<p "x>Hello</p><p a="1>2" b=3"4>there and "so" on</p>', '<h1 class="entry-header">Hello</h1><p id="tags">there and "so" on</p>',
    '<h2 class="banner">Hello</h2><p class="lead share-price">there and "so" on</p><p class="advert">Buy</p><h3 class="related">More</h3>',
])
def test_markup_as_browsers_read_it(inside):
    page = f"<html><body><div class=nav>Menu words</div><article>{inside}</article><div class='ads'>Buy this</div></body></html>"
    assert html_extraction.extract(page, []) == 'Hello there and "so" on'


def test_deep_pages_take_time_in_proportion_and_keep_their_paths():
    words = "Running words of the page that say something. "

    def page(depth, last):
        return "<html><body>" + "".join(f"<div class=level>x<i><a href=x>y</a>" for _ in range(depth)) + f"<div class={last}>" + words * 900

    start = time.perf_counter()
    votes = [html_extraction.vote(page(10_000, last)) for last in ("one", "two")]
    assert time.perf_counter() - start < 30
    assert all(v.endswith(f"/div.{n}") and len(v) < 3000 for v, n in zip(votes, ("one", "two")))
    assert html_extraction.extract(page(10_000, "one"), votes[:1]) == " ".join((words * 900).split())
    assert html_extraction.extract("<article>" + "<a b='" * 2000 + ">x", []) is not None


def test_ties_of_votes_go_to_the_shorter_and_then_the_first_path(spark):
    rows = [("h", p, 3) for p in ("/b/long", "/z", "/c", "/d")] + [("g", "/q", 2)]
    got = {r.host: r.path for r in html_extraction.consensus(spark.createDataFrame(rows, "host string, path string, n long")).collect()}
    assert got == {"h": "/c", "*": "/c"}


# 7 -------------------------------------------------------------------------------------------


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(docs, odd, empty):
    rows = [(i, fingerprint(t)) for i, t, *_ in some_docs()]
    part = {f: f for _, f in rows}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for _, a in rows:
        for _, b in rows:
            if (a ^ b).bit_count() <= 3:
                part[find(a)] = find(b)
    want = sorted(((i, f, min(j for j, g in rows if j is not None and find(g) == find(f))) for i, f in rows), key=str)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted({c for i, _, c in want if i is not None and i == c})
    assert simhash.keep_one(odd).columns == odd.columns and simhash.near_duplicates(empty).count() == 0


def test_links_of_many_close_fingerprints(spark):
    rnd = random.Random(6)
    centres = [rnd.getrandbits(64) for _ in range(20)]
    fps = list({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for c in centres for _ in range(15)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= 3}
    links = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert {(r.a, r.b) for r in links.collect()} == want


# 8 -------------------------------------------------------------------------------------------


def test_language_evidence_is_fused(spark, empty):
    rnd = random.Random(9)
    german = "und der die das nicht ein schön über straße kind haus wald grün".split()
    rows = [(i, prose(rnd, 30) if i % 2 else " ".join(rnd.choice(german) for _ in range(30)), "en" if i % 2 else "de", f"s{i % 2}") for i in range(80)]
    rows += [(200, None, None, "s0"), (201, "", None, "s1"), (202, "zz", "en", None)]
    pages = [(i, f"http://a{i % 2}.example.{'com' if i % 2 else 'de'}/x", f"<html lang={'en' if i % 2 else 'de'}><p>{rows[i][1]}</p></html>") for i in range(40)]
    pages += [(90, "http://a0.example.de/", "<html lang='de'></html>"), (91, None, None), (92, "http://a0.example.de/", "")]
    got = language_id.identify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) + len(pages)
    docs = {r.doc_id: r for r in got if r.kind == "document"}
    assert all(docs[i].lang == rows[i][2] and docs[i].kept for i in range(80)) and any(docs[i].held_out for i in range(80))
    assert docs[200].lang == "de" and docs[201].lang == "en" and docs[200].text_lang is None
    found = {r.page_id: r for r in got if r.kind == "page"}
    assert all(found[i].lang == rows[i][2] for i in range(40))
    assert found[90].lang == "de" and found[90].declared == "de" and found[92].lang == "de"
    nothing = language_id.identify(empty, spark.createDataFrame(pages[:2], "page_id long, url string, html string")).collect()
    assert [r.lang for r in nothing] == [None, None] and all(r.kept for r in nothing)


def test_any_number_of_languages_and_whole_domains(spark):
    rnd = random.Random(32)
    words = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(words[i % 300]) for _ in range(40)), f"l{i % 300:03}", f"s{i % 300}") for i in range(3000)]
    urls = ["http://a.x.co.uk/1", "http://b.y.co.uk/", "http://www.z.de/", "http://1.2.3.4/x", "http://z.com/"]
    pages = spark.createDataFrame([(i, u, f"<html data-lang=xx lang=l><p>{rows[i][1]}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert [(r.domain, r.suffix) for r in language_id._page_rows(pages).orderBy("id").collect()] == [
        ("x.co.uk", "uk"), ("y.co.uk", "uk"), ("z.de", "de"), ("1.2.3.4", ""), ("z.com", "com")
    ]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, DOCS), pages).collect() if r.kind == "document"}
    assert all(got[i].lang == rows[i][2] for i in got) and len(got) == 3000
    assert language_id.declared_language('<html data-lang="xx" lang="de">') == "de" and language_id.declared_language('<html data-lang="xx">') is None


# 9 -------------------------------------------------------------------------------------------


def hits(text, items, width=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_blocks_of_items_name_the_same_documents_however_rows_are_dealt(spark, monkeypatch):
    """Two blocks read the corpus anew, and the rows come to other tasks in another order each time."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 40)
    phrase = lambda n: " ".join(f"w{n}x{k}" for k in range(12))
    rows = [(n % 20 if n % 7 else None, f"start {n} {phrase(n)} and {phrase(n + 1)} end") for n in range(40)] * 2
    items = spark.createDataFrame([(n, phrase(n)) for n in range(0, 40, 5)], "item_id long, text string")
    anywhere = F.udf(lambda: random.randrange(1000), "int").asNondeterministic()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("to", anywhere()).repartition(5, "to").drop("to")
    got = sorted(((r.doc_id, r.n_items, r.n_hit, r.n_words) for r in decontamination.contamination(docs, items).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        hits = [n for n in range(0, 40, 5) if phrase(n) in text]
        want.append((doc_id, len(hits), 12 * len(hits), len(text.split())))
    assert got == sorted(want, key=repr)


def test_decontamination_against_brute_force(spark, odd, empty, monkeypatch):
    rnd = random.Random(7)
    items = [(i, prose(rnd, rnd.choice([3, 9, 10, 11, 25]))) for i in range(20)] + [(3, prose(rnd, 14)), (30, None), (31, "..."), (32, "the"), (33, "a a a a a a a a a a a a")]
    rows = [(i, prose(rnd, 40), "en", "s") for i in range(15)] + [
        (40, "X " + items[4][1].upper() + "; y", "en", "s"), (41, " ".join(items[8][1].split()[:10]), "en", "s"), (42, items[2][1] + " " + items[2][1], "en", "s"),
        (43, None, "en", "s"), (44, "", "en", "s"), (45, "a " * 200, "en", "s"), (46, "the end", "en", "s"), (46, "an end", "en", "s"),
    ]
    rows += [(50 + k, prose(rnd, 5) + " " + t, "en", "s") for k, (_, t) in enumerate(items) if t]
    known = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *hits(t, items)) for i, t, *_ in rows)
    for words in (decontamination.BLOCK_WORDS, 60):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", words)
        got = decontamination.contamination(spark.createDataFrame(rows, DOCS), known)
        assert sorted(tuple(r)[:6] for r in got.collect()) == want
    kept = decontamination.clean(spark.createDataFrame(rows, DOCS), known)
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in want} - {w[0] for w in want if w[-1]}
    assert decontamination.contamination(odd, known.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(empty, known).count() == 0


def test_words_near_the_anchor_match_in_any_order(spark):
    item = "one two three four five six seven eight nine ten"
    words = item.split()
    docs = spark.createDataFrame([(1, " ".join(reversed(words)), "en", "s"), (2, " ".join(words[:6]), "en", "s")], DOCS)
    got = {r.doc_id: r for r in decontamination.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1].n_near_items == 1 and not got[1].contaminated and got[2].n_near_items == 0


# 10 ------------------------------------------------------------------------------------------


def test_repeated_passages_against_all_windows(spark, odd, empty):
    rnd = random.Random(11)
    passage, other = prose(rnd, 70), prose(rnd, 49)
    rows = [(i, prose(rnd, 90), "en", "s") for i in range(12)]
    rows += [(20 + i, f"{prose(rnd, 15 + i)} {passage} {prose(rnd, 20)}", "en", "s") for i in range(5)]
    rows += [(30 + i, f"{prose(rnd, 15)} {' '.join(passage.split()[10 - i : 62 + i])} {prose(rnd, 9)}", "en", "s") for i in range(3)]
    rows += [(40 + i, f"{prose(rnd, 15)} {other} {prose(rnd, 20)}", "en", "s") for i in range(2)]
    rows += [(50, None, "en", "s"), (51, "", "en", "s"), (52, "of " * 200, "en", "s"), (53, rows[0][1], "en", "s"), (None, rows[1][1], "en", "s")]
    tokens = {i: (t or "").lower().split() for i, t, *_ in rows if i is not None}

    def cover(n):
        where = {}
        for i, w in tokens.items():
            for s in range(len(w) - n + 1):
                where.setdefault(tuple(w[s : s + n]), set()).add(i)
        return {i: {p for s in range(len(w) - n + 1) if len(where[tuple(w[s : s + n])]) > 1 for p in range(s, s + n)} for i, w in tokens.items()}

    must, may = cover(50), cover(27)
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = {p for s in r.spans for p in range(s.start, s.end + 1)}
        assert r.n_repeated == len(words)
        if r.doc_id is None:
            assert not words
        else:
            assert must[r.doc_id] <= words <= may[r.doc_id]
    assert {r.doc_id for r in got if r.spans} == {i for i, c in must.items() if c}
    assert suffix_dedup.repeated_spans(odd).count() == 14 and suffix_dedup.repeated_spans(empty).count() == 0


def test_fragments_that_touch_are_no_repeat(spark):
    rnd = random.Random(12)
    rows, fresh = [], lambda n: [f"w{rnd.getrandbits(40)}" for _ in range(n)]
    for i in range(0, 120, 3):
        # two fragments that touch or overlap, each shared with another document; some passages of 50 and more among them
        text = fresh(130)
        a, n, m = rnd.randint(0, 40), rnd.choice([27, 30, 40, 49, 49, 50, 60]), rnd.choice([27, 35, 40, 49, 49, 51])
        b = a + n - rnd.choice([0, 0, 5, 20])
        rows += [(i, text), (i + 1, fresh(9) + text[a : a + n] + fresh(30)), (i + 2, fresh(30) + text[b : b + m] + fresh(9))]
    inner = fresh(55)
    rows += [(300, fresh(5) + inner + fresh(5) + inner + fresh(5)), (301, fresh(20)), (302, fresh(30)), (303, rows[0][1][:30])]  # repeats within one document only
    rows += [(301, inner[:40] + fresh(9)), (304, inner[:49])]
    boiler = fresh(60)
    rows += [(400 + i, fresh(24) + boiler + fresh(24)) for i in range(40)]
    where = {}
    for i, w in rows:
        for s in range(len(w) - 49):
            where.setdefault(tuple(w[s : s + 50]), set()).add(i)
    cover = lambda w: {p for s in range(len(w) - 49) if len(where[tuple(w[s : s + 50])]) > 1 for p in range(s, s + 50)}
    got = suffix_dedup.repeated_spans(spark.createDataFrame([(i, " ".join(w), "en", "s") for i, w in rows], DOCS)).collect()
    found = sorted((r.doc_id, r.n_words, sorted({p for s in r.spans for p in range(s.start, s.end + 1)})) for r in got)
    assert found == sorted((i, len(w), sorted(cover(w))) for i, w in rows)
    assert {i for i, _, c in found if c and i < 300} and [i for i, _, c in found if not c and i < 300 and i % 3 == 0]


def test_sorted_right_sides_fall_into_intervals(spark):
    rnd = random.Random(13)
    # Few words, so that most rows agree with others; one core holds most rows; equal cores with other proofs stay apart.
    rows = {(rnd.choice([5, 5, 5, 6]), rnd.choice([7, 7, 8]), tuple(rnd.choice([-3, 1, 2]) for _ in range(6))) for _ in range(900)}
    rows |= {(c, p, w[:k] + (0,) * (6 - k)) for c, p, w in list(rows)[:60] for k in (2, 4)}
    rows = sorted(rows)
    rights = spark.createDataFrame([(c, p, i, list(w)) for i, (c, p, w) in enumerate(rows)], "core long, proof long, side long, after array<long>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.side: r for r in suffix_dedup.intervals(rights.repartition(8), 6).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    heads = lambda w, d: (*w[:2], w[2][:d]) if 0 not in w[2][:d] else (*w[:2], w[2])
    for d in range(7):
        by_id, by_words = {}, {}
        for i, w in enumerate(rows):
            by_id.setdefault(got[i].ids[d], []).append(i)
            by_words.setdefault(heads(w, d), []).append(i)
        assert sorted(by_id.values()) == sorted(by_words.values())
    for i, w in enumerate(rows):
        most = max(d for d in range(-1, 7) if d < 0 or any(j != i and heads(x, d) == heads(w, d) and 0 not in w[2][:d] for j, x in enumerate(rows) if x[:2] == w[:2]))
        assert got[i].reach == most
    assert suffix_dedup.intervals(rights.limit(0), 6).count() == 0


def test_no_core_is_sorted_in_one_task(docs):
    plan = suffix_dedup.repeated_spans(docs)._jdf.queryExecution().toString()
    assert "Window" not in plan
