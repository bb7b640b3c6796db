"""DuckDB SQL of the corpus queries that SQL can express; written apart from the operators."""

from __future__ import annotations

from .license_rules import REACH, WEIGHTS, rules

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS ref, coalesce(text, '') AS text FROM documents),
a1 AS (SELECT *, regexp_replace(text, '[a-z]+', '', 'g') AS s1 FROM d),
a2 AS (SELECT *, regexp_replace(s1, '[\x20\x09-\x0D]+', '', 'g') AS s2 FROM a1),
a3 AS (SELECT *, regexp_replace(s2, '[A-Z]+', '', 'g') AS s3 FROM a2),
a4 AS (SELECT *, regexp_replace(s3, '[0-9]+', '', 'g') AS s4 FROM a3),
a5 AS (SELECT *, regexp_replace(s4, '[#*$%&|<>]+', '', 'g') AS s5 FROM a4),
a6 AS (SELECT *, regexp_replace(s5, '[\x00-\x7F]+', '', 'g') AS s6 FROM a5),
c AS (
  SELECT rid, doc_id, ref, length(text) AS n_chars, length(s1) - length(s2) AS n_space, length(s4) - length(s5) AS n_symbols,
    [length(text) - length(s1), length(s1) - length(s2), length(s2) - length(s3), length(s3) - length(s4),
     length(s4) - length(s5), length(s5) - length(s6), length(s6)] AS cs
  FROM a6
),
ws AS (SELECT rid, ref, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
w AS (SELECT rid, ref, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM ws),
nw AS (SELECT rid, ref, len(ws) AS n FROM ws),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
),
grams AS (
  SELECT rid, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM w
  WINDOW o AS (PARTITION BY rid ORDER BY p)
),
twice AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM grams WHERE g IS NOT NULL) WHERE k > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
both_refs AS (SELECT rid, ref FROM d WHERE ref <> '' UNION ALL SELECT rid, '' FROM d),
class_sums AS (
  SELECT b.ref, k, sum(cs[k]) AS s FROM both_refs b JOIN c USING (rid), (SELECT unnest(range(1, 8)) AS k) GROUP BY b.ref, k
),
class_refs AS (SELECT ref, k, s / greatest(sum(s) OVER (PARTITION BY ref), 1) AS q FROM class_sums),
word_sums AS (SELECT b.ref, sum(n) AS n FROM both_refs b JOIN nw USING (rid) GROUP BY b.ref),
counted AS (
  SELECT b.ref, lower(word) AS word, count(*) AS k FROM both_refs b JOIN w USING (rid) GROUP BY 1, 2
),
top AS (
  SELECT ref, word, r, k / n AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY k DESC, word) AS r FROM counted) JOIN word_sums USING (ref)
  WHERE r <= 20
),
own_words AS (
  SELECT rid, r, count(*) AS k FROM w JOIN top ON w.ref = top.ref AND lower(w.word) = top.word GROUP BY rid, r
),
shares AS (
  SELECT nw.rid, top.r, top.q, coalesce(k, 0) / nw.n AS p
  FROM nw JOIN top ON nw.ref = top.ref LEFT JOIN own_words o ON o.rid = nw.rid AND o.r = top.r WHERE nw.n > 0
),
with_rest AS (
  SELECT rid, p, q FROM shares UNION ALL
  SELECT rid, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM shares GROUP BY rid
),
word_distance AS (
  SELECT rid, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS x
  FROM with_rest GROUP BY rid
),
class_distance AS (
  SELECT rid, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS x
  FROM (SELECT rid, cs[k] / n_chars AS p, q FROM c JOIN class_refs USING (ref) WHERE n_chars > 0) GROUP BY rid
),
judged AS (
  SELECT c.doc_id, nw.n AS n_words, c.n_chars - c.n_space AS word_chars, c.n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    CASE WHEN c.n_chars >= 300 THEN cd.x END AS cdx, CASE WHEN nw.n >= 60 THEN wd.x END AS wdx
  FROM c JOIN nw USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid)
  LEFT JOIN class_distance cd USING (rid) LEFT JOIN word_distance wd USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(cdx, 0) <= 0.32 AND coalesce(wdx, 0) <= 0.5 AS kept,
  round(cdx, 6) AS class_distance, round(wdx, 6) AS word_distance
FROM judged
"""

DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, array_to_string(ws[s + 1 : s + least(10, len(ws))], ' ') AS g, least(10, len(ws)) AS k
  FROM iw, range(0, 1000000) t(s) WHERE len(ws) > 0 AND s <= len(ws) - least(10, len(ws))
),
sizes AS (SELECT DISTINCT k FROM windows),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM dw),
grams AS (SELECT doc_id, p, k, array_to_string(ws[p : p + k - 1], ' ') AS g FROM starts, sizes WHERE p + k - 1 <= len(ws)),
found AS (SELECT doc_id, p, g.k, item_id FROM grams g JOIN windows w ON g.g = w.g AND g.k = w.k),
hit AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM found, range(0, 10) t(o) WHERE o < k GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def license_scan() -> str:
    """The licence scan with the same table of rules; nested detections are compared pair by pair."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    mark = lambda s: quoted(s.replace("\x01", "<").replace("\x02", ">"))
    values = ",\n".join(
        f"({r.rule},{quoted(r.label)},{r.priority},{str(r.base).lower()},{quoted(r.keyword)},{mark(r.pattern)})" for r in rules()
    )
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in WEIGHTS.items())
    return rf"""
WITH r(rule, label, priority, base, keyword, pattern) AS (VALUES {values}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda x: x <> '') AS ws FROM documents
),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT * FROM w WHERE word IN (SELECT keyword FROM r)),
around AS (
  SELECT k.rid, k.p, k.word, array_to_string(list_concat(ws[greatest(k.p - {REACH}, 1) : k.p - 1], ['<' || word || '>'], ws[k.p + 1 : k.p + {REACH}]), ' ') AS s
  FROM k JOIN d USING (rid)
),
m AS (
  SELECT rid, p, rule, label, priority, base, trim(regexp_extract(s, pattern, 0)) AS x FROM around JOIN r ON word = keyword
),
f AS (
  SELECT *, p - 1 - len(string_split(split_part(x, '<', 1), ' ')) + 1 AS a, p - 1 - len(string_split(split_part(x, '<', 1), ' ')) + 1 + len(string_split(x, ' ')) AS b
  FROM m WHERE x <> ''
),
kept AS (
  SELECT * FROM f WHERE NOT base AND NOT EXISTS (
    SELECT 1 FROM f g WHERE g.rid = f.rid AND NOT g.base AND (g.rule <> f.rule OR g.a <> f.a OR g.b <> f.b) AND (
      (g.a <= f.a AND g.b >= f.b AND (g.priority > f.priority OR g.priority = f.priority AND (g.a < f.a OR g.b > f.b OR g.rule < f.rule)))
      OR (g.a >= f.a AND g.b <= f.b AND g.priority > f.priority)))
),
b AS (
  SELECT rid, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM f WHERE base GROUP BY rid
),
l AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE priority {weights} END) AS score
  FROM (SELECT * FROM kept UNION ALL SELECT * FROM f WHERE base) GROUP BY rid
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)
"""

MERKLE_MANIFEST = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
),
langs AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS k FROM (SELECT DISTINCT lang FROM documents)
),
d AS (
  SELECT documents.*, langs.k, CAST(doc_id AS VARCHAR) AS id,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))),
      lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])) AS crc
  FROM documents JOIN langs ON documents.lang IS NOT DISTINCT FROM langs.lang, crc_table
),
head AS (
  SELECT k, doc_id, crc, text, low, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS x FROM d
),
digest AS (
  SELECT k, doc_id, sha256(x || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(x || CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN coalesce(strlen(low) || ':' || low, '-')
      ELSE coalesce(strlen(text) || ':' || text, '-') END) AS tampered
  FROM head
),
leaf AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY k) AS n
  FROM digest
),
low_tree(level, k, p, n, h) AS (
  SELECT 0, k, p, n, leaf FROM leaf
  UNION ALL
  SELECT level + 1, k, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM low_tree WHERE n > 1 GROUP BY level, k, p // 8, n
),
subroot AS (SELECT k, h, level FROM low_tree WHERE n = 1),
high_tree(level, p, n, h) AS (
  SELECT 0, k - 1, (SELECT count(*) FROM langs), h FROM subroot
  UNION ALL
  SELECT level + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM high_tree WHERE n > 1 GROUP BY level, p // 8, n
),
own_step AS (
  SELECT rid, t.level AS step, t.p, t.h, leaf.p // CAST(pow(8, t.level) AS BIGINT) AS mine
  FROM leaf JOIN low_tree t ON t.k = leaf.k AND t.n > 1 AND t.p // 8 = leaf.p // CAST(pow(8, t.level + 1) AS BIGINT)
),
top_step AS (
  SELECT rid, 100 + t.level AS step, t.p, t.h, (k - 1) // CAST(pow(8, t.level) AS BIGINT) AS mine
  FROM leaf JOIN high_tree t ON t.n > 1 AND t.p // 8 = (k - 1) // CAST(pow(8, t.level + 1) AS BIGINT)
),
step AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) AS s, coalesce(string_agg(h, '' ORDER BY p) FILTER (WHERE p < mine), '') AS l,
    coalesce(string_agg(h, '' ORDER BY p) FILTER (WHERE p > mine), '') AS r
  FROM (SELECT * FROM own_step UNION ALL SELECT * FROM top_step) GROUP BY rid, step
),
fold(rid, s, h) AS (
  SELECT rid, 0, tampered FROM leaf
  UNION ALL
  SELECT fold.rid, fold.s + 1, sha256(l || h || r) FROM fold JOIN step ON step.rid = fold.rid AND step.s = fold.s + 1
),
proof AS (SELECT rid, string_agg(l || r, '' ORDER BY s) AS proof, max(s) AS s FROM step GROUP BY rid),
root AS (SELECT h FROM high_tree WHERE n = 1)
SELECT doc_id, leaf, subroot.h AS subroot, root.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, fold.h AS folded_root, fold.h = root.h AS verified
FROM leaf JOIN subroot USING (k) LEFT JOIN proof USING (rid) JOIN fold ON fold.rid = leaf.rid AND fold.s = coalesce(proof.s, 0), root
"""


def vector_codes() -> str:
    """The vector codes with every distance evaluated."""
    rounds = "".join(f"""
a{r} AS (
  SELECT rid, part, min(list_sum(list_transform(range(1, len(v) + 1), lambda k: (v[k] - c[k]) * (v[k] - c[k]))) * 256 + e) AS x
  FROM parts JOIN b{r} USING (part) GROUP BY rid, part
),""" + (f"""
m{r} AS (
  SELECT part, e, list(CAST(m AS BIGINT) ORDER BY k) AS c FROM (
    SELECT part, x % 256 AS e, k, floor(sum(v[k]) / count(*)) AS m
    FROM a{r} JOIN parts USING (rid, part), (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM parts))) AS k) GROUP BY part, x % 256, k
  ) GROUP BY part, e
),
b{r + 1} AS (SELECT b{r}.part, b{r}.e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, e)),""" if r < 4 else "") for r in range(5))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
  SELECT rid, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM kept, (SELECT unnest(range(4)) AS part)
),
b0 AS (SELECT part, rid AS e, v AS c FROM parts WHERE rid < 256),{rounds}
coded AS (
  SELECT rid, string_agg(printf('%02x', x % 256), '' ORDER BY part) AS code, CAST(sum(x // 256) AS BIGINT) AS error FROM a4 GROUP BY rid
),
labels AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN coded USING (rid) GROUP BY label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM kept JOIN coded USING (rid) JOIN labels ON kept.label IS NOT DISTINCT FROM labels.label, books
"""
