"""DuckDB SQL for the queries of sources, sinks and streams, from their definitions."""

from __future__ import annotations

from ..operators.features import FINAL, NAMES, kind, origin
from ..sources.tables import SMALL
from .files import FIRST_WEIGHTS, STREAM_INPUTS
from .oracle import _DAILY, _HIST, _HOST, _NODE, _PART, _U, decoded, split_sql
from .queries import LAYERS

_CRLF = "chr(13) || chr(10)"
_BODY = f"'id=' || page_id || '&x=%20y' || {_CRLF} || {_CRLF} || 'z'"
_METHODS = "CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END"
_FORM = "CASE WHEN page_id % 3 = 0 THEN '' ELSE 'id=' || page_id || '&name=page+one&empty=' END"
_REC = (
    f"sha256(encode('csic-experimento-2') || '\\x00'::BLOB || encode('anomalo') || '\\x00'::BLOB || unhex(lpad(to_hex(page_id), 16, '0')) || '\\x00'::BLOB || encode({_METHODS} || ' ' || url || chr(10) || chr(10) || {_FORM}))"
)


def _network(xs: list[str]) -> str:
    sig = lambda z: f"(1.0::DOUBLE / (1.0 + exp(-({z}))))"
    fold = lambda w, given: f"(-1.0 * {w[0]!r}::DOUBLE + " + " + ".join(f"{x} * {v!r}::DOUBLE" for x, v in zip(given, w[1:], strict=True)) + ")"
    return sig(fold(LAYERS[1][0], [sig(fold(w, xs)) for w in LAYERS[0]]))


def _decisions() -> str:
    score = _network([f"({x.replace('D', '::DOUBLE')})" for x in STREAM_INPUTS])
    say = lambda t: f"CASE WHEN s > {t} THEN 'BLOQUEIA' ELSE 'LIBERA' END"
    return f"""n AS (SELECT event_id, event_type, {score} AS s FROM events), x AS (SELECT event_id, event_type, s AS e1_score, {say(0.55)} AS e1_decision, {say(0.6)} AS e2_decision, {say(0.6)} AS operational_decision FROM n)"""


def _steps() -> str:
    (b, x, q), v = FIRST_WEIGHTS[0], FIRST_WEIGHTS[1]
    first = [*b, *x, *q, *(w for row in v for w in row)]  # g[1..6]: bias, score, quality of two neurons; g[7..9]: the output
    sig = lambda z: f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({z})))"
    slope = "rate * o * (1.0::DOUBLE - o) * e"
    hidden = lambda n: f"rate * h{n} * (1.0::DOUBLE - h{n}) * (e * g[{7 + n}])"
    new = [f"g[{n}] - {hidden(n)}" for n in (1, 2)] + [f"g[{2 + n}] + score * {hidden(n)}" for n in (1, 2)] + [f"g[{4 + n}] + quality * {hidden(n)}" for n in (1, 2)] + [f"g[7] - {slope}", f"g[8] + h1 * {slope}", f"g[9] + h2 * {slope}"]
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, toxic AS label, quality, ((n_chars * 37 + doc_id * 11) % 101 + toxic * 60 + (1 - quality) * 20) / 181.0 AS score FROM labels JOIN documents USING (doc_id)),
 r AS (SELECT 0::BIGINT AS i, {first!r}::DOUBLE[] AS g UNION ALL SELECT i, [{", ".join(new)}] AS g FROM (SELECT *, label - o AS e FROM (SELECT *, {sig("h1 * g[8] + h2 * g[9] - g[7]")} AS o
  FROM (SELECT d.i, d.label, d.score, d.quality, r.g, 0.25::DOUBLE AS rate, {sig("d.score * r.g[3] + d.quality * r.g[5] - r.g[1]")} AS h1, {sig("d.score * r.g[4] + d.quality * r.g[6] - r.g[2]")} AS h2 FROM r JOIN d ON d.i = r.i + 1))))
 SELECT CAST(k - 1 AS INT) AS gene, round(g[k], 7) AS weight FROM (SELECT arg_max(g, i) AS g FROM r), range(1, 10) t(k)"""


def _variety() -> str:
    n = "event_id"
    flag = lambda c: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    told = lambda when, x: f"CASE WHEN {when} THEN CAST({x} AS DOUBLE) END"
    agent = f"CASE {n} % 3 WHEN 0 THEN 'Mozilla/5.0 (X11; (a) b)' WHEN 1 THEN 'curl/8.' || {n} END"
    size = f"CASE WHEN {n} % 2 = 0 THEN 0 ELSE length('id=' || {n}) END"
    length = f"CASE {n} % 7 WHEN 0 THEN {size} WHEN 1 THEN 999 WHEN 4 THEN 5 END"
    has = {"host": f"{n} % 4 < 3", "content_type": f"{n} % 5 < 3", "content_length": f"{n} % 7 < 5", "user_agent": f"{n} % 3 < 2", "cookie": f"{n} % 5 >= 3", "accept": f"{n} % 2 = 1"}
    unique = " + ".join(f"CAST({c} AS INT)" for c in has.values())
    twice = f"CAST({n} % 5 = 3 AS INT) + CAST({n} % 2 = 1 AS INT)"
    out = {
        **{f"method_is_{m}": flag(f"{n} % 4 = {i}") for i, m in enumerate(("get", "post", "put", "other"))},
        **{f"http_version_is_{v}": flag(f"{n} % 6 IN ({i})") for v, i in (("1_0", "0"), ("1_1", "4, 5"), ("2", "1, 3"), ("other", "2"))},
        **{f"header_has_{h}": flag(has.get(h, "false")) for h in ("accept", "accept_charset", "accept_encoding", "accept_language", "cache_control", "connection", "content_length", "content_type", "cookie", "host", "pragma", "user_agent")},
        "header_unique_count": f"CAST({unique} AS DOUBLE)", "header_value_count": f"CAST({unique} + {twice} AS DOUBLE)", "header_duplicate_count": f"CAST({twice} AS DOUBLE)",
        "content_type_is_form_urlencoded": told(has["content_type"], f"CAST({n} % 5 = 1 AS INT)"), "content_length_valid": told(has["content_length"], f"CAST({n} % 7 IN (0, 1, 4) AS INT)"), "content_length_declared": f"CAST({length} AS DOUBLE)",
        "body_length_bytes": f"CAST({size} AS DOUBLE)", "content_length_delta": f"CAST({size} - {length} AS DOUBLE)", "content_length_matches_body": f"CAST(CAST({size} = {length} AS INT) AS DOUBLE)",
        "user_agent_length": f"CAST(length({agent}) AS DOUBLE)", "user_agent_token_count": f"CASE {n} % 3 WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE END", "user_agent_parenthesis_count": f"CASE {n} % 3 WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END",
        "host_header_length": f"CASE {n} % 4 WHEN 0 THEN 14.0::DOUBLE WHEN 1 THEN 15.0::DOUBLE WHEN 2 THEN 17.0::DOUBLE END", "host_header_port_present": told(has["host"], f"CAST({n} % 4 IN (0, 2) AS INT)"), "host_header_port_valid": f"CASE {n} % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE END",
        "host_matches_url_host": told(f"{has['host']} AND {n} % 3 < 2", f"CAST(({n} % 4 = 1 AND {n} % 3 = 0) OR ({n} % 4 = 0 AND {n} % 3 = 1) AS INT)"),
        "cookie_length": f"CASE {n} % 5 WHEN 3 THEN 12.0::DOUBLE WHEN 4 THEN 3.0::DOUBLE END", "cookie_pair_count": f"CASE {n} % 5 WHEN 3 THEN 3.0::DOUBLE WHEN 4 THEN 0.0::DOUBLE END",
    }
    return f"SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in out.items())} FROM events"


def _observed() -> str:
    """Fields of pages as requests: single ones, and parameters by their decoded name."""
    always = ("request.method", "request.target", "request.http_version", "url.path", "headers", "header:host", "header:content-type", "header:content-length", "header:user-agent")
    some = {"url.scheme": "scheme <> ''", "url.host": "hostname <> ''", "url.query": "query <> ''", "query.parameters": "query <> ''", "body": "body <> ''", "body.parameters": "body <> ''"}
    single = " UNION ALL ".join([f"SELECT '{f}' AS field, count(*) AS requests, count(*) AS values FROM x" for f in always] + [f"SELECT '{f}', count(*), count(*) FROM x WHERE {c}" for f, c in some.items()])
    name = decoded("split_part(p, chr(61), 1)", True)
    pairs = " UNION ALL ".join(f"SELECT page_id, '{k}_param:' AS kind, {name} AS name FROM (SELECT page_id, unnest(list_filter(string_split({k}, '&'), lambda p: p <> '')) AS p FROM x)" for k in ("query", "body"))
    return f"""WITH u AS ({_U}), x AS (SELECT *, {_HOST} AS hostname, {_FORM} AS body FROM u), p AS ({pairs}), f AS ({single} UNION ALL SELECT kind || CASE WHEN name = '' THEN '<nome-vazio>' ELSE name END, count(DISTINCT page_id), count(*) FROM p GROUP BY 1)
 SELECT 'pages' AS corpus, field, requests, CAST(values AS BIGINT) AS values FROM f WHERE requests > 0"""


_PEOPLE = "p AS (SELECT vec_id AS individual, embedding::DOUBLE[] AS g, CAST(vec_id * 37 % 101 AS DOUBLE) AS cost FROM embeddings)"


def _summed(x: str) -> str:
    return f"round(list_sum(list_transform({x}, lambda v, i: v * i)), 6)"


def _drawn(k: int) -> str:
    return f"list_transform(range(1, len(g) + 1), lambda j: ((individual * {k} + j * 31) % 97) / 97.0::DOUBLE)"


def _crossover() -> str:
    cut = "CAST(individual % 63 + 1 AS INT)"
    half = "list_transform(range(1, len(g) + 1), lambda j: pow(CASE WHEN u[j] <= 0.5 THEN 2 * u[j] ELSE 1 / (2 * (1 - u[j])) END, 0.5) * (g[j] - o[j]) / 2)"
    blend = lambda sign: f"list_transform(range(1, len(g) + 1), lambda j: (g[j] + o[j]) / 2 {sign} h[j])"
    return f"""WITH {_PEOPLE}, x AS (SELECT p.individual, p.g, q.g AS o FROM p JOIN p q ON q.individual = p.individual + 1), y AS (SELECT *, {_drawn(13)} AS u FROM x), z AS (SELECT *, {half} AS h FROM y)
 SELECT individual, {_summed(f"list_concat(g[1:{cut}], o[{cut} + 1:])")} AS one_first, {_summed(f"list_concat(o[1:{cut}], g[{cut} + 1:])")} AS one_second, {_summed(blend("+"))} AS two_first, {_summed(blend("-"))} AS two_second FROM z"""


def _mutation() -> str:
    anew = {1: "-1 + 2 * u[j]", 2: "g[j] + 0.2::DOUBLE * u[j]", 3: "g[j] + 2 * CASE WHEN u[j] < 0.5 THEN pow(2 * u[j], 1.0::DOUBLE / 21) - 1 ELSE 1 - pow(2 * (1 - u[j]), 1.0::DOUBLE / 21) END"}
    kinds = ", ".join(f"{_summed(f'list_transform(range(1, len(g) + 1), lambda j: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN (individual + j) % 5 = 0 THEN {x} ELSE g[j] END)))')} AS kind_{k}" for k, x in anew.items())
    return f"WITH {_PEOPLE}, y AS (SELECT *, {_drawn(17)} AS u FROM p) SELECT individual, {kinds} FROM y"


#: Loads by recursion, an arrival at a time.
_LOADS_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id % 3 + 1 AS n, event_id * 0.125::DOUBLE AS t0, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS i FROM events),
 r AS (SELECT DISTINCT 0::BIGINT AS event_id, n, NULL::DOUBLE AS t0, 0::BIGINT AS i, 50.0::DOUBLE AS load FROM e UNION ALL SELECT e.event_id, e.n, e.t0, e.i, least(100.0::DOUBLE, greatest(0.0::DOUBLE, r.load - 6.0::DOUBLE * greatest(0.0::DOUBLE, coalesce(e.t0 - r.t0, 0.0::DOUBLE))) + 1.5::DOUBLE / sqrt([1.0, 0.25, 0.05][e.n]::DOUBLE))
  FROM r JOIN e ON e.n = r.n AND e.i = r.i + 1) SELECT event_id, 'node' || n AS node, round(load, 6) AS load FROM r WHERE i > 0"""


def files_sql() -> dict[str, str]:
    final = set(FINAL)
    schema = ", ".join(f"('{'final' if n in final else 'removed'}', '{origin(n)}', '{kind(n)}', '{n}')" for n in NAMES)
    nine = ", ".join(f"round((event_id % {n + 2}) / {n + 1.0!r}::DOUBLE, 9) AS {c}" for n, c in enumerate(list(SMALL)[:-1]))
    pages_ = f"SELECT page_id, {_REC} AS record_id, url, {_METHODS} AS method, {_FORM} AS body FROM pages"
    limit = " + ".join(
        f"coalesce(list_min(list_filter(range(1, {most + 1}), lambda a: a >= {most} OR least(100.0::DOUBLE, (event_id * {k + 1} % 101) + a * (10.0::DOUBLE / {cap}::DOUBLE)) >= 90)), {most})" for k, (cap, most) in enumerate(((1.0, 8), (0.25, 2), (0.05, 1)))
    )
    return {
        "header_variety": _variety(), "observed_request_fields": _observed(),
        "bucketed_digests": """WITH b AS (SELECT o_orderstatus, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 3) AS b, sha256(string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR)) || chr(10)) AS d FROM orders GROUP BY 1, 2)
 SELECT o_orderstatus, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS digest FROM b GROUP BY 1""",
        "ga_tournament": f"WITH {_PEOPLE}, d AS (SELECT individual AS slot, unnest([0, 1, 2]) AS turn, CAST(floor(individual * unnest([1, 3, 5]) / 7.0) AS BIGINT) AS individual FROM p) SELECT slot, arg_min(individual, cost * 10 + turn) AS individual FROM d JOIN p USING (individual) GROUP BY 1",
        "ga_roulette": f"""WITH {_PEOPLE}, c AS (SELECT individual, sum(1.0::DOUBLE / (cost + 1.0::DOUBLE + 1e-12::DOUBLE)) OVER (ORDER BY individual) AS upto, row_number() OVER (ORDER BY individual) AS number FROM p),
 t AS (SELECT max(upto) AS whole, max(number) AS most FROM c), d AS (SELECT individual AS slot, (individual * 29 % 97) / 97.0::DOUBLE AS drawn FROM p), n AS (SELECT slot, count(*) FILTER (WHERE upto <= drawn * whole) AS passed, any_value(most) AS most FROM d, c, t GROUP BY slot)
 SELECT slot, individual FROM n JOIN c ON c.number = least(passed + 1, most)""",
        "chromosomes": f"""WITH {_PEOPLE} SELECT individual, round(list_sum(list_transform(range(0, 56), lambda k: g[k + 1] * (k // 7 + 1) * (k % 7 + 1))), 6) AS hidden, round(list_sum(list_transform(range(0, 8), lambda k: g[k + 57] * (k + 1))), 6) AS output, true AS same FROM p""",
        "ga_crossover": _crossover(), "ga_mutation": _mutation(),
        "live_requests": f"SELECT page_id AS id, CASE WHEN page_id % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS method_is_post, CAST(length({_FORM}) AS DOUBLE) AS body_length_bytes, 1.0::DOUBLE AS content_length_matches_body, 4.0::DOUBLE AS header_unique_count FROM pages",
        "raw_requests": f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, url AS target, '1.1' AS version, 'a b' AS x_folded, '1|2' AS x_twice, CASE WHEN page_id % 2 = 0 THEN '0' ELSE CAST(length({_BODY}) AS VARCHAR) END AS content_length, CASE WHEN page_id % 2 = 0 THEN '' ELSE {_BODY} END AS body FROM pages",
        "raw_sequences": f"""SELECT count(*) AS messages, 0::BIGINT AS with_gaps, CAST(sum(CASE WHEN page_id % 2 = 0 THEN 4 ELSE 5 END + strlen(url) + length(' HTTP/1.1Host: localhost:8080X-Page: ' || page_id || 'X-Folded: a  bX-Twice: 1x-twice: 2Content-Length: ') + 2 * 9
 + CASE WHEN page_id % 2 = 0 THEN 1 ELSE length(CAST(length({_BODY}) AS VARCHAR)) + length({_BODY}) END) AS BIGINT) AS bytes FROM pages""",
        "lenient_requests": f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, url AS target, '1.1' AS version, 'a b' AS folded_value, CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS malformed, CASE WHEN page_id % 2 = 0 OR page_id % 5 = 0 THEN '' ELSE {_BODY} END AS body FROM pages""",
        "parser_counters": "SELECT 'pages' AS corpus, count(*) FILTER (WHERE page_id % 4 = 0) AS outside, 0::BIGINT AS header_end, count(*) AS folded, count(*) FILTER (WHERE page_id % 5 = 0) AS bad_length, 0::BIGINT AS truncated, count(*) AS messages FROM pages",
        "file_digests": "SELECT CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS sha256 FROM (SELECT string_agg(r_name || chr(10), '' ORDER BY r_regionkey) AS t FROM region)",
        "dataset_file": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS label FROM lineitem",
        "small_dataset_file": f"SELECT event_id, {nine}, CAST(event_id % 2 AS INT) AS label FROM events",
        "reserved_file": f"WITH u AS ({_U}), r AS ({pages_}) SELECT page_id AS source_sequence, record_id, CAST(page_id % 2 AS INT) AS label, method, r.url AS target, 'HTTP/1.1' AS http_version, path, query, body FROM r JOIN u USING (page_id)",
        "control_file": f'WITH {_PART} SELECT record_id, content_sha256, CAST(dataset = \'F\' AS INT) AS label, "partition", sequence AS source_sequence FROM p JOIN r USING (dataset, sequence, record_id)',
        "partition_summary": f"""WITH {_PART} SELECT (SELECT count(*) FROM p) AS records, true AS disjoint, "partition", count(*) AS own, count(*) FILTER (WHERE dataset = 'F') AS attacks, sha256(string_agg(record_id, chr(10) ORDER BY record_id) || chr(10)) AS ids_sha256 FROM p GROUP BY "partition\"""",
        "history_file": f"WITH {_HIST} SELECT method, CASE WHEN e1_decision = 'BLOQUEIA' THEN 403 ELSE 200 END AS status_http, e2_decision, count(*) AS n, min('/' || event_id) AS first, sum(CASE WHEN e1_decision = 'BLOQUEIA' THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END) AS scores FROM h GROUP BY 1, 2, 3",
        "cleared_history": "SELECT count(*) AS before, 0::BIGINT AS after FROM events",
        "archived_versions": "SELECT CASE event_type WHEN 'view' THEN 'b' ELSE 'a' END AS version, event_type, count(*) AS n, max(event_id) AS last FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2",
        "version_stamps": "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events",
        "artifact_file": "SELECT o_orderpriority AS id, count(*) AS n, max(o_totalprice) AS top, 1::BIGINT AS last FROM orders GROUP BY 1",
        "version_folders": "SELECT count(*) AS n, max(value) AS threshold, CASE event_type WHEN 'click' THEN '20240101-bp' ELSE '20240102-bp' END AS version FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type",
        "split_file": f"WITH {split_sql('toxic')} SELECT doc_id, split FROM t",
        "sniffed_cells": """WITH p AS (SELECT 'p_size' AS name, CAST(p_size AS DOUBLE) AS v, '' AS t FROM part UNION ALL SELECT 'p_retailprice', p_retailprice, '' FROM part UNION ALL SELECT 'p_brand', NULL, p_brand FROM part UNION ALL SELECT 'gap', CASE WHEN p_size > 20 THEN p_size END, '' FROM part)
 SELECT name, count(*) FILTER (WHERE v = floor(v)) AS integers, count(*) FILTER (WHERE v <> floor(v)) AS numbers, count(*) FILTER (WHERE t <> '') AS texts, CAST(sum(CASE WHEN v = floor(v) THEN v END) AS BIGINT) AS total FROM p GROUP BY 1""",
        "schema_files": f"SELECT file, origin, kind, count(*) AS n, min(name) AS first FROM (VALUES {schema}) t(file, origin, kind, name) GROUP BY 1, 2, 3",
        "contract_difference": f"SELECT 'sarcasm' AS missing, 'quality' AS unexpected, sha256({' || '.join(repr(n) + ' || chr(10)' for n in FINAL)}) AS contract",
        "replayed_headers": """SELECT event_id, 'Accept=*/*' || CASE WHEN event_id % 2 = 0 THEN ';User-Agent=agent, ' || event_type ELSE '' END AS replayed, 'Accept' || CASE WHEN event_id % 3 = 0 THEN ';Cookie' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ';User-Agent' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN ';X-Other' ELSE '' END AS without_proxy FROM events""",
        "record_by_id": f"WITH r AS ({pages_}) SELECT record_id, page_id AS source_sequence, method FROM r ORDER BY record_id LIMIT 1",
        "shown_texts": "SELECT conv_id, turn, substr(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), ' '), 1, 60) AS shown FROM conversations",
        "result_payload": f"""WITH {_DAILY} SELECT event_type AS experiment, 'bp' AS algorithm, count(*) AS days, string_agg(strftime(day, '%Y%m%d') || ':' || n, '|' ORDER BY day) AS series, '1:a:' || max(n) || '|2:b:' || 2 * max(n) AS normalization FROM daily GROUP BY 1""",
        "hidden_layers": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '-32' WHEN 2 THEN p_size || '-16-8' END AS layers FROM part",
        "training_environments": f"""WITH c AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _NODE.items())}), x AS (SELECT *, least(100.0::DOUBLE, least(100.0::DOUBLE, l + 1.5::DOUBLE / sqrt(cap[n])) + 10.0::DOUBLE / cap[n]) AS cpu
 FROM c, (VALUES ('carga_baixa', 20.0::DOUBLE), ('carga_media', 50.0), ('carga_alta', 70.0)) s(state, l), range(1, 4) t(n)) SELECT state, 'node' || n AS node, round(cpu, 9) AS cpu, round(base[n] + cpu * factor[n] + CASE WHEN cpu >= 90 OR most[n] <= 1 THEN 180.0 ELSE 0.0 END, 9) AS wait FROM x""",
        "concurrency_limits": f"SELECT event_id, CAST({limit} AS BIGINT) AS \"limit\" FROM events",
        "q_table_problems": """WITH want AS (SELECT * FROM (VALUES ('carga_baixa'), ('carga_media'), ('carga_alta')) s(state), (VALUES ('node1'), ('node2'), ('node3')) n(action)), l AS (SELECT least(100.0, greatest(0.0, floor(value)))::DOUBLE AS load, 'node' || (user_id % 3 + 1) AS action FROM events),
 have AS (SELECT DISTINCT CASE WHEN load < 34 THEN 'carga_baixa' ELSE 'carga_media' END AS state, action FROM l WHERE load < 67 UNION ALL SELECT 'carga_nula', 'node9') (SELECT * FROM want EXCEPT SELECT * FROM have) UNION ALL (SELECT * FROM have EXCEPT SELECT * FROM want)""",
        "checked_loads": "SELECT event_id, CAST(event_id * 3 % 101 + event_id * 4 % 101 + event_id * 5 % 101 AS DOUBLE) AS total FROM events",
        "training_steps": _steps(),
        "streamed_rates": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS request_rate FROM events",
        "streamed_loads": _LOADS_SQL,
        "residual_loads": _LOADS_SQL,
        "streamed_decisions": f"WITH {_decisions()} SELECT event_id, round(e1_score, 9) AS e1_score, e1_decision, e2_decision, operational_decision FROM x",
        "streamed_history": f"WITH {_decisions()} SELECT event_type, e1_decision, operational_decision, count(*) AS n FROM x GROUP BY 1, 2, 3",
        "client_sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR, true) AS opens FROM events), s AS (SELECT user_id, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
 n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS requests, max(n) AS longest FROM n GROUP BY 1""",
        "decoded_bodies": f"WITH r AS ({pages_}) SELECT page_id AS source_sequence, replace(body, '+', ' ') AS body, CAST(length(to_base64(encode(body))) AS INT) AS size FROM r",
    }
