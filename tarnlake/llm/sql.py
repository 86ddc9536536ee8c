"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .quality import GRIDS

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"CASE WHEN trim(t, {_BLANK}) = '' THEN [] ELSE regexp_split_to_array(trim(t, {_BLANK}), '[\\x20\\x09-\\x0D]+') END"

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) payload_bytes, sha1(h) payload_digest, max(page_id) OVER (PARTITION BY h) AS "first" FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND "first" <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND "first" <> page_id THEN "first" END AS refers_to FROM d"""

OP6 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_split_to_array(trim(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), BLANK), '[\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) i FROM d WHERE w <> [''])),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
o AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT r.doc_id, coalesce(max(n.n), 0) n_shingles, min(reached) component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1""".replace("BLANK", _BLANK)

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank" FROM s)
SELECT query_id, CAST("rank" AS INTEGER) AS "rank", vec_id, score FROM r WHERE "rank" <= 20"""

# CRC-32 bit by bit: a byte goes in, then eight shifts (-1); reflected polynomial 0xEDB88320.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"""

OP11 = f"""
WITH t AS (SELECT conv_id c, turn, coalesce("role", '') "role", coalesce("text", '') "text" FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, md5(length("role") || ':' || "role" || "text") g, len(regexp_extract_all("text", '[^\\x20\\x09-\\x0D]+')) words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length("role") || ':' || "role" || "text")) i FROM t),
k AS (SELECT c, c - c % 20 base, {_CRC} % 4 h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT c, g, words, row_number() OVER (PARTITION BY c ORDER BY own, i) d FROM (SELECT k.c, g, words, 0 own, i FROM k JOIN o ON o.c = k.base AND i <= h UNION ALL SELECT k.c, g, words, 1, i FROM k JOIN o ON o.c = k.c AND i > h)),
m AS (SELECT c, d, words, string_agg(g, '') OVER (PARTITION BY c ORDER BY d) p FROM r UNION ALL SELECT c, 0, 0, '' FROM k),
e AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) sha FROM (SELECT c, arg_max(p, d) p FROM m GROUP BY c) GROUP BY p),
n AS (SELECT p, d, left(p, length(p) - 32) up, min(c) conv_id, count(*) n_convs, (count(*) - 1) * max(words) saved FROM m GROUP BY p, d),
ch AS (SELECT up, count(*) n_children FROM n WHERE d > 0 GROUP BY up),
s AS (SELECT left(p, 32 * j) p, sum(saved) saved_tokens, count(*) FILTER (WHERE n_children = 0) n_leaves FROM (SELECT n.p, saved, coalesce(n_children, 0) n_children, unnest(range(0, d + 1)) j FROM n LEFT JOIN ch ON ch.up = n.p) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS "depth", a.conv_id parent_conv_id, n.n_convs, coalesce(n_children, 0) n_children, n_leaves, CAST(saved_tokens AS BIGINT) saved_tokens, coalesce(sha, sha256('')) ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN n a ON n.d > 0 AND a.p = n.up LEFT JOIN ch ON ch.up = n.p LEFT JOIN e ON e.p = n.p"""

OP13 = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) size FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) source_size, sum(sum(size)) OVER () total FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] w FROM s),
c AS (SELECT a.source, sum(b.source_size) FILTER (WHERE b.source_size * a.w < a.source_size * b.w) below, sum(b.w) FILTER (WHERE b.source_size * a.w >= a.source_size * b.w) beside FROM w a JOIN w b ON true GROUP BY 1),
f AS (SELECT w.*, w * (3 * total - 4 * coalesce(below, 0)) > 4 * source_size * beside AS is_full FROM w JOIN c ON c.source IS NOT DISTINCT FROM w.source),
l AS (SELECT 3 * any_value(total) - 4 * coalesce(sum(source_size) FILTER (WHERE is_full), 0) remaining, sum(w) FILTER (WHERE NOT is_full) open_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(w * remaining AS DOUBLE) / CAST(2 * open_weight AS DOUBLE) END target, CAST('0x' || left(md5('0:' || CAST(source IS NULL AS INTEGER) || ':' || coalesce(source, '')), 7) AS BIGINT) * 4 shift FROM f JOIN l ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, shift, CASE WHEN source_size > 0 THEN CAST(floor(target / CAST(source_size AS DOUBLE) * 1073741824.0::DOUBLE) AS HUGEINT) ELSE 0 END step, CAST(row_number() OVER (PARTITION BY d.source ORDER BY size, md5(CAST(doc_id AS VARCHAR)) NULLS FIRST, doc_id) AS HUGEINT) k FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
x AS (SELECT *, CAST((k * step + shift) // 1073741824 - ((k - 1) * step + shift) // 1073741824 AS BIGINT) copies FROM p)
SELECT doc_id, size, CAST(source_size AS BIGINT) source_size, target, copies * size AS taken, copies FROM x"""


def op12(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings WHERE {fine}),
x AS MATERIALIZED (SELECT id, p, q[p * {width} + 1:p * {width} + {width}] x FROM (SELECT id, q, unnest(range(0, {parts})) p FROM v)),
b0 AS MATERIALIZED (SELECT p, e, x FROM x JOIN (SELECT id, row_number() OVER (ORDER BY vec_id, q) - 1 e FROM v WHERE vec_id IS NOT NULL) f ON f.id = x.id WHERE e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, p, min(list_sum(list_transform(range(1, {width + 1}), lambda i: (x.x[i] - b.x[i]) * (x.x[i] - b.x[i]))) * {entries} + e) k FROM x JOIN b{r} b USING (p) GROUP BY id, p)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) x FROM (SELECT p, k % {entries} e, i, sum(x.x[i]) s, count(*) n FROM a{r} JOIN x USING (id, p), (SELECT unnest(range(1, {width + 1})) i) GROUP BY 1, 2, 3) GROUP BY p, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) x FROM b{r} b LEFT JOIN m{r} m USING (p, e))")
    return f"""
WITH {", ".join(steps)},
c AS (SELECT id, string_agg(printf('%02x', CAST(k % {entries} AS INTEGER)), '' ORDER BY p) code, CAST(sum(k // {entries}) AS BIGINT) error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) codebooks_sha256 FROM c JOIN v USING (id)"""


def op2(alpha: float = 0.05, delta: float = 0.05, min_gain: float = 0.05) -> str:
    share = alpha / len(GRIDS)
    rules = {r: k for k, r in enumerate(GRIDS)}
    grid = ", ".join(f"('{r}', {j}, {float(c)!r}::DOUBLE)" for r, cs in GRIDS.items() for j, c in enumerate(cs))
    ratios = " UNION ALL ".join(f"SELECT rid, stratum, doc_id, '{r}' AS rule, {r} AS x FROM f WHERE NOT base_failed" for r in GRIDS)
    fired = " || ".join(f"(CASE WHEN {r} > coalesce(max(cutoff) FILTER (WHERE rule = '{r}'), 'inf'::DOUBLE) THEN ['{r}'] ELSE [] END)" for r in rules)
    cols = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    return f"""
WITH docs AS (SELECT row_number() OVER () rid, doc_id, coalesce(lang, '') stratum, coalesce("text", '') t FROM documents),
w AS (SELECT *, {_WORDS} w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANK}) <> '') ls FROM docs),
g AS (SELECT rid, i, w[i:i + 2] g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) i FROM w)),
rep AS (SELECT rid, count(DISTINCT j) n FROM (SELECT rid, unnest([i, i + 1, i + 2]) j FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) c FROM g) WHERE c > 1) GROUP BY 1),
b AS (SELECT w.rid, doc_id, stratum, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) n_symbols,
  CAST(len(ls) AS BIGINT) n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) n_repeat_words FROM w LEFT JOIN rep ON rep.rid = w.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN CAST(n_symbols AS DOUBLE) / word_chars ELSE 0 END symbol_ratio, CASE WHEN n_lines > 0 THEN CAST(n_dup_lines AS DOUBLE) / n_lines ELSE 0 END duplicate_line_ratio,
  CASE WHEN n_words > 0 THEN CAST(n_repeat_words AS DOUBLE) / n_words ELSE 0 END repeated_word_ratio, CASE WHEN n_words > 0 THEN CAST(word_chars AS DOUBLE) / n_words ELSE 0 END mean_word_length FROM b),
lab AS (SELECT doc_id, min(quality) good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY 1),
x AS ({ratios}), grid(rule, lvl, cutoff) AS (VALUES {grid}),
k AS (SELECT stratum, x.rule, lvl, cutoff, count(*) FILTER (WHERE good = 1) n1, count(*) FILTER (WHERE good = 0) n0, count(*) FILTER (WHERE good = 1 AND x > cutoff) k1, count(*) FILTER (WHERE good = 0 AND x > cutoff) k0
  FROM x JOIN lab ON lab.doc_id = x.doc_id JOIN grid ON grid.rule = x.rule GROUP BY ALL),
p AS (SELECT *, CASE WHEN k1 > n1 * {share} THEN 1.0 ELSE list_sum(list_transform(range(0, k1 + 1), lambda i: exp(lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1) + i * ln({share}) + (n1 - i) * ln(1 - {share})))) END p, (SELECT count(DISTINCT stratum) FROM k) strata FROM (SELECT * FROM k WHERE n1 > 0)),
ok AS (SELECT *, bool_and(p <= {delta} / ({len(GRIDS)} * strata)) OVER (PARTITION BY stratum, rule ORDER BY lvl ROWS UNBOUNDED PRECEDING) ok, coalesce(CAST(k0 AS DOUBLE) / nullif(n0, 0), 0) - coalesce(CAST(k1 AS DOUBLE) / nullif(n1, 0), 0) gain FROM p),
best AS (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, lvl) q FROM ok WHERE ok AND gain > {min_gain} - 1e-12),
cut AS (SELECT stratum, rule, cutoff FROM best WHERE q = 1),
j AS (SELECT f.rid, f.doc_id, {", ".join("f." + c.strip() for c in cols.split(","))}, {fired} AS fired FROM f LEFT JOIN cut ON cut.stratum = f.stratum GROUP BY f.rid, f.doc_id, {", ".join("f." + c.strip() for c in cols.split(","))}, {", ".join("f." + r for r in rules)})
SELECT doc_id, {cols}, NOT base_failed AND len(fired) = 0 AS kept, array_to_string(fired, ',') AS fired FROM j"""
