"""DuckDB SQL for the operators that it can express, written from their definitions."""

from __future__ import annotations

from . import mixing, passages, quantize, sharding, suffix_dedup
from .secret_scan import RULES


def _sharding() -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
lv AS (SELECT doc_id, n_bytes, h, k, h >> CAST(60 - k AS INT) AS prefix FROM d, range(0, 25) t(k)),
nodes AS (SELECT k, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM lv GROUP BY 1, 2),
fit AS (SELECT lv.*, shard_bytes, shard_rows FROM lv JOIN nodes USING (k, prefix) WHERE shard_bytes <= {sharding.LIMIT} OR shard_rows = 1),
leaf AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rn FROM fit)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN k = 0 THEN '' ELSE lpad(bin(prefix), CAST(k AS INT), '0') END AS shard, CAST(k AS INT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows,
 shard_bytes > {sharding.LIMIT} AS oversize FROM leaf WHERE rn = 1"""


def _secrets() -> str:
    found = []
    for n, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        found.append(f"""SELECT doc_id, {n} AS rule, '{r.kind}' AS kind, i, length(whole[i]) AS size, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i], lambda x: length(x))), 0) AS stop, length(own[i]) >= {r.least} AS ok
 FROM (SELECT doc_id, gap, whole, own, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gap, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {r.group}) AS own FROM documents WHERE regexp_matches(text, '{p}')))""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    return f"""WITH m AS ({" UNION ALL ".join(found)}), s AS (SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - size, rule) AS spans FROM m WHERE ok GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN s USING (doc_id)"""


def _mixing() -> str:
    pick = lambda xs, kind: "CASE (rank - 1) % 3 " + " ".join(f"WHEN {i} THEN {x!r}::{kind}" for i, x in enumerate(xs)) + " END"
    return f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source), s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s0),
s2 AS (SELECT *, {pick(mixing.WEIGHTS, 'BIGINT')} AS w, {pick(mixing.SLOPES, 'DOUBLE')} AS slope, {mixing.REPEATS} * source_size AS most FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY most / w, rank) AS o FROM s2),
s4 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words, sum(w) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS units FROM s3),
first AS (SELECT min(o) AS o FROM s4 WHERE NOT (most::HUGEINT * units <= w * words)), open AS (SELECT words AS fw, units AS fu FROM s4 WHERE o = (SELECT o FROM first)),
s5 AS (SELECT source, source_size, slope, CASE WHEN o >= (SELECT o FROM first) THEN least(CAST(w * (SELECT fw FROM open) AS DOUBLE) / CAST((SELECT fu FROM open) AS DOUBLE), CAST(most AS DOUBLE)) ELSE CAST(most AS DOUBLE) END AS target FROM s4),
r AS (SELECT doc_id, size, source_size, slope, target, CAST(floor(target) AS BIGINT) AS quota, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS begin_ FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
c AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS copies FROM r), t AS (SELECT *, greatest(0, least(size, quota - copies * source_size - begin_)) AS part FROM c),
u AS (SELECT *, CAST(copies * size + part AS BIGINT) AS taken, CAST(CASE WHEN copies * size + part > 0 THEN copies + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS passes FROM t),
due AS (SELECT *, CASE WHEN passes > 0 THEN CAST(begin_ AS DOUBLE) / target END AS y, CASE WHEN passes > 0 THEN CAST(begin_ + (passes - 1) * source_size AS DOUBLE) / target END AS z FROM u)
SELECT doc_id, size, source_size, target, taken, passes, (2 * y) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * y)) AS position, (2 * z) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * z)) AS last_position FROM due"""


def _passages() -> str:
    n = passages.WINDOW
    return f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {n - 1}], ' ')) AS k FROM i), least_ AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, {n})) AS i FROM k JOIN least_ USING (k) WHERE doc_id > first), g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, d.i, d.word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) d ANTI JOIN gone USING (doc_id, i)), j AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(j.text, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN j USING (doc_id)"""


def _suffixes() -> str:
    n = suffix_dedup.WINDOW
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, coalesce(strlen(text), 0) AS n FROM documents),
k AS (SELECT doc_id, n, i, md5(substr(x, 2 * i + 1, {2 * n})) AS k FROM (SELECT doc_id, n, x, unnest(range(0, n - {n - 1})) AS i FROM d)),
twice AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1), hit AS (SELECT doc_id, i FROM k SEMI JOIN twice USING (k)),
cut AS (SELECT doc_id, i, coalesce(i - lag(i) OVER w > {n}, true) AS opens FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + {n} AS hi FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cut) GROUP BY 1, 2),
gaps AS (SELECT doc_id, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_ FROM runs),
s AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, string_agg(substr(x, 2 * from_ + 1, 2 * (lo - from_)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""


def _infill() -> str:
    draw = lambda n: f"CAST('0x' || substr(h, {8 * n - 7}, 8) AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {draw(1)} AS h1, {draw(2)} AS h2, {draw(3)} AS h3, {draw(4)} AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, '<P>' || substr(t, 1, a) AS x, '<S>' || substr(t, b + 1) AS z, '<M>' || substr(t, a + 1, b - a) AS y FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN x || z || y ELSE z || x || y END AS out FROM p),
r AS (SELECT *, strpos(out, '<P>') AS i, strpos(out, '<S>') AS j, strpos(out, '<M>') AS m FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(out) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN substr(out, i + 3, j - i - 3) || substr(out, m + 3) || substr(out, j + 3, m - j - 3)
  ELSE substr(out, i + 3, m - i - 3) || substr(out, m + 3) || substr(out, j + 3, i - j - 3) END) AS restored_sha256 FROM r"""


def _codes() -> str:
    """Every round as a table of its entries; assignments by all distances."""
    parts, k = quantize.PARTS, quantize.ENTRIES
    near = lambda n: f"""SELECT r, p, x, e, d FROM (SELECT v.r, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda q: CAST((q[1] - q[2]) * (q[1] - q[2]) AS HUGEINT))) AS d,
 row_number() OVER (PARTITION BY v.r, v.p ORDER BY d, b.e) AS nth FROM v JOIN b{n} b USING (p)) WHERE nth = 1"""  # noqa: E731
    rounds = []
    for n in range(quantize.ROUNDS):
        rounds.append(f"""a{n} AS MATERIALIZED ({near(n)}),
m{n} AS (SELECT p, e, list(CAST(CASE WHEN s >= 0 THEN s // c ELSE -((-s + c - 1) // c) END AS BIGINT) ORDER BY j) AS x FROM (SELECT p, e, j, sum(x[j]) AS s, count(*) AS c FROM a{n}, range(1, 65) t(j) WHERE j <= len(x) GROUP BY ALL) GROUP BY p, e),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (p, e))""")
    last = quantize.ROUNDS
    return f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {quantize.SCALE}) AS BIGINT)) AS x, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM k, range(0, {parts}) t(p)), b0 AS (SELECT p, r - 1 AS e, x FROM v WHERE r <= {k}),
{", ".join(rounds)}, f AS MATERIALIZED ({near(last)}),
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r), books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN c USING (r), books"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _sharding(), "op2_secret_scans": _secrets(), "op7_suffix_dedup": _suffixes(), "op8_mixing": _mixing(), "op9_passage_dedup": _passages(), "op11_fill_in_middle": _infill(), "op13_vector_codes": _codes()}
