"""DuckDB SQL for the trace engine's queries, written from their definitions and not from their plans."""

from __future__ import annotations

from spanforge.plans.queries import EVENT_MODELS, ORDER_MODELS

#: Codes of the symbols, by name in order.
_EVENT_CODES = {n: 19968 + i for i, n in enumerate(("click", "error", "purchase", "signup", "view"))}
_FLAG_CODES = {n: 19968 + i for i, n in enumerate(("AF", "AO", "NF", "NO", "RF", "RO"))}


def _values(models: list[tuple[str, str]], codes: dict[str, int]) -> str:
    """Rows (api, model, flat) of models; flat is whether they have no group."""
    rows = []
    for api, words in models:
        parts = []
        for w in words.split():
            name = w.rstrip("+?*")
            parts.append(f"chr({codes[name]})" if name in codes else f"'{name}'")
            if w[len(name) :]:
                parts.append(f"'{w[len(name) :]}'")
        rows.append(f"('{api}', {' || '.join(parts)}, {str('(' not in words).lower()})")
    return "(VALUES " + ", ".join(rows) + ")"


_EV = """ev AS (SELECT user_id AS tid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS name, event_id FROM events),
sy AS (SELECT name, chr(CAST(19967 + row_number() OVER (ORDER BY name) AS INT)) AS sym FROM (SELECT DISTINCT event_type AS name FROM events)),
en AS (SELECT tid, string_agg(sym, '' ORDER BY pos) AS enc FROM ev JOIN sy USING (name) GROUP BY tid)"""
_EM = f"em AS (SELECT * FROM {_values(EVENT_MODELS, _EVENT_CODES)} v(api, model, flat))"
_OM = f"om AS (SELECT * FROM {_values(ORDER_MODELS, _FLAG_CODES)} v(api, model, flat))"
_OR = """ln AS (SELECT l_orderkey AS ok, l_returnflag || l_linestatus AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag || l_linestatus) AS i FROM lineitem),
od AS (SELECT o_custkey AS tid, o_orderkey AS ok, o_orderdate AS atp, year(o_orderdate) AS yr, 'pkg.Order.' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g') || '()' AS api,
  coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT ok, count(*) AS n FROM ln GROUP BY ok) c ON c.ok = o_orderkey)"""
_FS = """fs AS (SELECT name, chr(CAST(19967 + row_number() OVER (ORDER BY name) AS INT)) AS sym FROM (SELECT DISTINCT flag AS name FROM ln)),
oe AS (SELECT od.api, od.ok AS rid, coalesce(string_agg(fs.sym, '' ORDER BY ln.i), '') AS enc FROM od LEFT JOIN ln ON ln.ok = od.ok LEFT JOIN fs ON fs.name = ln.flag GROUP BY od.api, od.ok)"""
_SP = """so AS (SELECT *, sum(n) OVER (PARTITION BY tid ORDER BY yr, atp, ok) - n AS s FROM od),
sp AS (SELECT tid, s, s + n AS e, api, yr, 1 AS part, atp, ok FROM so
  UNION ALL SELECT tid, min(s), min(s) + sum(n), 'pkg.Year.y' || yr || '()', yr, 2, NULL, 0 FROM so GROUP BY tid, yr)"""


def _graph(acyclic: bool = False) -> str:
    more = " AND s_suppkey * 7 % 47 > s_suppkey % 41" if acyclic else ""
    return f"""kg AS (SELECT 'api' || (s_suppkey % 41) AS api, s_suppkey AS rid,
  CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0{more} THEN 'api' || (s_suppkey * 7 % 47) END AS callee,
  CASE WHEN s_suppkey % 5 < 2 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'read' ELSE 'write' END END AS event FROM supplier),
fl AS (SELECT api, bool_and(callee IS NULL) AS leaf, count(DISTINCT coalesce(callee, '') || '|' || coalesce(event, '')) > 1 AS polymorph,
  bool_and(callee IS NULL AND event IS NULL) AS empty, bool_or(event IS NOT NULL) AS direct_sys, count(*) AS n FROM kg GROUP BY api)"""


_REACH = """rs AS (SELECT api FROM fl WHERE direct_sys UNION SELECT kg.api FROM rs JOIN kg ON kg.callee = rs.api),
wp AS (SELECT api FROM fl WHERE polymorph UNION SELECT kg.api FROM wp JOIN kg ON kg.callee = wp.api)"""
_MUNCH = f"""ps AS (SELECT tid, enc, unnest(range(length(enc))) AS s FROM en),
ca AS (SELECT tid, s, s + length(regexp_extract(substr(enc, s + 1), '^(?:' || model || ')')) AS e, api FROM ps, em),
be AS (SELECT tid, s, max(e) AS e FROM ca WHERE e > s GROUP BY tid, s),
wa AS (SELECT tid, 0::BIGINT AS atp, length(enc) AS n FROM en UNION ALL SELECT wa.tid, coalesce(be.e, wa.atp + 1), n FROM wa LEFT JOIN be ON be.tid = wa.tid AND be.s = wa.atp WHERE wa.atp < n),
mu AS (SELECT be.tid, be.s, be.e FROM wa JOIN be ON be.tid = wa.tid AND be.s = wa.atp),
ml AS (SELECT DISTINCT mu.tid, mu.s, mu.e, ca.api FROM mu JOIN ca USING (tid, s, e))"""
_TRUE = """ru AS (SELECT tid, pos, name, pos - row_number() OVER (PARTITION BY tid, name ORDER BY pos) AS k FROM ev),
ts AS (SELECT tid, min(pos) AS s, max(pos) + 1 AS e, CASE name WHEN 'error' THEN 'pkg.B.error()' WHEN 'view' THEN 'pkg.B.view()' WHEN 'click' THEN 'org.C.click()' WHEN 'signup' THEN 'org.D.signs()' ELSE 'pkg.X.none()' END AS api FROM ru GROUP BY tid, name, k)"""
_GRAMS = """g1 AS (SELECT sym AS g FROM sy), g2 AS (SELECT a.g || b.g AS g FROM g1 a, g1 b), g3 AS (SELECT a.g || b.g AS g FROM g2 a, g1 b),
g4 AS (SELECT a.g || b.g AS g FROM g3 a, g1 b), g5 AS (SELECT a.g || b.g AS g FROM g4 a, g1 b),
gr AS (SELECT g FROM g1 UNION ALL SELECT g FROM g2 UNION ALL SELECT g FROM g3 UNION ALL SELECT g FROM g4 UNION ALL SELECT g FROM g5),
lb AS (SELECT DISTINCT g AS ngram, api FROM gr, em WHERE flat AND regexp_full_match(g, model)),
fr AS (SELECT ngram, sum((length(enc) - length(replace(enc, ngram, ''))) // length(ngram)) AS freq FROM (SELECT DISTINCT ngram FROM lb), en GROUP BY ngram),
am AS (SELECT lb.ngram, length(lb.ngram) AS n, count(DISTINCT api) AS n_apis, CAST(any_value(freq) AS BIGINT) AS freq FROM lb JOIN fr USING (ngram) GROUP BY lb.ngram)"""
_ROLL = {"full": "api", "method": "regexp_extract(split_part(api, '(', 1), '[^.]*$')", "class": "regexp_replace(split_part(api, '(', 1), '[.]?[^.]*$', '')", "package": "regexp_replace(regexp_replace(split_part(api, '(', 1), '[.]?[^.]*$', ''), '[.]?[^.]*$', '')"}
_HIST = """hi AS (SELECT t.n, t.k, count(am.ngram) AS c FROM (SELECT n, unnest(range(0, max(n_apis) + 1)) AS k FROM am GROUP BY n) t LEFT JOIN am ON am.n = t.n AND am.n_apis = t.k GROUP BY t.n, t.k)"""
_SYS_LINE = "CAST(event_id AS VARCHAR) || '.500000 SYSCALL ' || user_id || ' ' || event_type || '(' || event_id || ', 0) = 0'"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


_BRACKETS = """yb AS (SELECT DISTINCT tid, yr FROM od),
br AS (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY yr, part, atp, ok, phase, i) - 1 AS pos, state, name FROM (
  SELECT tid, yr, 0 AS part, NULL AS atp, 0 AS ok, 0 AS phase, 0 AS i, 'S' AS state, 'pkg.Year.y' || yr || '()' AS name FROM yb
  UNION ALL SELECT tid, yr, 2, NULL, 0, 0, 0, 'E', 'pkg.Year.y' || yr || '()' FROM yb
  UNION ALL SELECT tid, yr, 1, atp, ok, 1, 0, 'S', api FROM od UNION ALL SELECT tid, yr, 1, atp, ok, 3, 0, 'E', api FROM od
  UNION ALL SELECT tid, yr, 1, atp, ok, 2, i, NULL, flag FROM od JOIN ln USING (ok)))"""


def _fold(source: str, p: str) -> str:
    """CTEs that fold the strings (x) of source once, into {p}w (x, folded)."""
    at = lambda pos, size: f"substr(x, CAST({pos} AS INT), CAST({size} AS INT))"
    return f"""{p}r AS (SELECT x, s, min(k) AS k FROM (SELECT x, unnest(range(1, length(x))) AS s FROM {source}), (SELECT unnest(range(1, (SELECT max(length(x)) // 2 + 1 FROM {source}))) AS k)
  WHERE s + 2 * k <= length(x) + 1 AND {at('s', 'k')} = {at('s + k', 'k')} GROUP BY x, s),
{p}c AS (SELECT x, s, k, {at('s', 'k')} AS unit, list_max(list_filter(range(2, (length(x) + 1 - s) // k + 1), lambda c: {at('s', 'k * c')} = repeat({at('s', 'k')}, c))) AS c FROM {p}r),
{p}s AS (SELECT x, 1::BIGINT AS atp, '' AS folded FROM {source}
  UNION ALL SELECT w.x, atp + coalesce(k * c, 1), folded || CASE WHEN k IS NULL THEN substr(w.x, CAST(atp AS INT), 1) WHEN k = 1 THEN unit || '+' ELSE '(' || unit || ')+' END FROM {p}s w LEFT JOIN {p}c c ON c.x = w.x AND c.s = w.atp WHERE atp <= length(w.x)),
{p}w AS (SELECT x, folded FROM {p}s WHERE atp > length(x))"""


def _passes(n: int) -> str:
    """CTEs that fold the strings of oe in at most n passes, into fd (enc, pattern): a pass counts if its text is a pattern that matches."""
    parts = ["p0 AS (SELECT DISTINCT enc, enc AS x, enc AS pattern FROM oe WHERE enc <> '')"]
    for i in range(n):
        parts += [f"i{i} AS (SELECT DISTINCT x FROM p{i} WHERE x IS NOT NULL)", _fold(f"i{i}", f"f{i}")]
        text = "folded" if i == 0 else "regexp_replace(folded, '^[(](.*)[)]$', '\\1')"
        parts.append(f"t{i} AS (SELECT p{i}.*, {text} AS text, folded <> p{i}.x AND coalesce(TRY(regexp_full_match(enc, folded)), false) AS good, folded = p{i}.x AS same FROM p{i} LEFT JOIN f{i}w w ON w.x = p{i}.x)")
        lost = "CASE WHEN same THEN pattern END" if i == 0 else "pattern"
        parts.append(f"p{i + 1} AS (SELECT enc, CASE WHEN good THEN '(' || text || ')' END AS x, CASE WHEN good THEN text ELSE {lost} END AS pattern FROM t{i})")
    return ",\n".join(parts) + f",\nfd AS (SELECT enc, pattern FROM p{n})"


#: Learners as a walk over the realizations that differ, in the order of their first; k models at most.
_LEARN = """sq AS (SELECT api, rid, enc, pattern, row_number() OVER (PARTITION BY api ORDER BY rid) AS i, least({cap}, ceil(count(*) OVER (PARTITION BY api) / 2)) AS cap FROM oe JOIN fd USING (enc)),
fo AS (SELECT api, enc, any_value(pattern) AS pattern, any_value(cap) AS cap, min(i) AS i, row_number() OVER (PARTITION BY api ORDER BY min(i)) AS k FROM sq GROUP BY api, enc),
le AS (SELECT DISTINCT api, 0::BIGINT AS k, 0::BIGINT AS i, 0::BIGINT AS train, CAST([] AS STRUCT(model VARCHAR, generalized BOOLEAN, original VARCHAR, fold VARCHAR)[]) AS ms FROM fo
  UNION ALL SELECT api, k, i, CASE WHEN adds THEN train + 1 ELSE train END, CASE WHEN adds THEN {add} ELSE ms END
  FROM (SELECT fo.api, fo.k, fo.i, enc, pattern, train, ms, len(list_filter(ms, lambda x: regexp_full_match(enc, x.model))) = 0 AND {new} AS adds FROM le JOIN fo ON fo.api = le.api AND fo.k = le.k + 1 WHERE train < cap)),
ld AS (SELECT api, arg_max(ms, k) AS ms, max(train) AS train, arg_max(i, k) AS last FROM le GROUP BY api),
mo AS (SELECT api, unnest(ms, recursive := true) FROM ld)"""
_GENERIC = _LEARN.format(cap=50, new="pattern IS NOT NULL", add="list_append(ms, {'model': pattern, 'generalized': true, 'original': enc, 'fold': pattern})")
_LESS = _LEARN.format(
    cap=100,
    new="NOT coalesce(list_bool_or(list_transform(ms, lambda x: coalesce(x.generalized AND x.model = pattern, false))), false)",
    add="""CASE WHEN coalesce(list_bool_or(list_transform(ms, lambda x: coalesce(NOT x.generalized AND x.fold = pattern, false))), false)
    THEN list_append(list_filter(ms, lambda x: x.generalized OR x.fold IS NULL OR x.fold <> pattern), {'model': pattern, 'generalized': pattern <> enc, 'original': enc, 'fold': pattern})
    ELSE list_append(ms, {'model': enc, 'generalized': false, 'original': enc, 'fold': pattern}) END""",
)
_MODEL_ROWS = "SELECT api, model, generalized, original, regexp_extract(model, '[^()+]') AS first_sym, CAST(CASE WHEN contains(model, '+') THEN 0 ELSE length(model) END AS INT) AS max_len FROM mo"
#: Alignment as a walk over cells: a row of scores a step, then a place of the way back a step.
_ALIGN = """sq AS (SELECT api, enc, row_number() OVER (PARTITION BY api ORDER BY rid) AS k, count(*) OVER (PARTITION BY api) AS n FROM oe WHERE enc <> ''),
ta AS (SELECT *, CASE WHEN n <= 10 THEN n ELSE least(50, n // 2) END AS cap FROM sq),
al AS (SELECT a.api, 2::BIGINT AS k, a.cap, false AS back, 0::BIGINT AS i, 0::BIGINT AS j, list_transform(range(1, length(a.enc) + 1), lambda c: {'s': substr(a.enc, CAST(c AS INT), 1), 'o': false}) AS pat,
    CAST([] AS STRUCT(s VARCHAR, o BOOLEAN)[]) AS made, CAST([] AS BIGINT[][]) AS rws FROM ta a WHERE a.k = 1
  UNION ALL SELECT api, CASE WHEN over THEN k + 1 ELSE k END, cap, CASE WHEN over THEN false ELSE back OR i = len(pat) AND NOT empty END,
    CASE WHEN over OR empty THEN 0 WHEN NOT back THEN CASE WHEN i = len(pat) THEN i ELSE i + 1 END WHEN how < 2 THEN i - 1 ELSE i END,
    CASE WHEN over THEN 0 WHEN NOT back THEN length(y) WHEN how = 1 THEN j ELSE j - 1 END,
    CASE WHEN over THEN made ELSE pat END,
    CASE WHEN over OR NOT back THEN [] ELSE list_prepend(CASE how WHEN 0 THEN {'s': CASE WHEN contains(pat[i].s, c) THEN pat[i].s ELSE pat[i].s || c END, 'o': pat[i].o} WHEN 1 THEN {'s': pat[i].s, 'o': true} ELSE {'s': c, 'o': true} END, made) END,
    CASE WHEN over THEN [] WHEN empty THEN [list_transform(range(0, length(y) + 1), lambda b: -b)] WHEN back OR i = len(pat) THEN rws
      ELSE list_append(rws, list_transform(range(0, length(y) + 1), lambda b: list_max(list_transform(range(0, b + 1), lambda q: q - b + greatest(rws[i + 1][q + 1] - 1, CASE WHEN q = 0 THEN -i - 1 ELSE rws[i + 1][q] + CASE WHEN contains(pat[i + 1].s, substr(y, CAST(q AS INT), 1)) THEN 1 ELSE -1 END END))))) END
  FROM (SELECT al.*, y, back AND i = 0 AND j = 0 AS over, len(rws) = 0 AS empty, substr(y, CAST(j AS INT), 1) AS c,
    CASE WHEN i > 0 AND j > 0 AND rws[i + 1][j + 1] = rws[i][j] + CASE WHEN contains(pat[i].s, substr(y, CAST(j AS INT), 1)) THEN 1 ELSE -1 END THEN 0 WHEN i > 0 AND rws[i + 1][j + 1] = rws[i][j + 1] - 1 THEN 1 ELSE 2 END AS how
    FROM al JOIN (SELECT api, k, enc AS y FROM ta) t USING (api, k) WHERE k <= cap)),
ap AS (SELECT api, cap, array_to_string(list_transform(pat, lambda p: CASE WHEN length(p.s) = 1 THEN p.s ELSE '(' || array_to_string(list_sort(string_split(p.s, '')), '|') || ')' END || CASE WHEN p.o THEN '?' ELSE '' END), '') AS model FROM al WHERE k > cap)"""

#: Whole runs over the bracketed orders: each customer's flags as one string, the order models, the calls that hold events.
_WHOLE = (_OR, _FS, _OM, _SP, "em AS (SELECT * FROM om)", "en AS (SELECT tid, string_agg(sym, '' ORDER BY yr, atp, ok, i) AS enc FROM od JOIN ln USING (ok) JOIN fs ON fs.name = flag GROUP BY tid)", _MUNCH)
_AMB = _with(_EV, _EM, _GRAMS)

ORACLES: dict[str, str] = {
    "trace_encode": _with(_EV) + "SELECT tid, enc, length(enc) AS n FROM en",
    "trace_decode_roundtrip": _with(_EV) + "SELECT tid, pos, name FROM ev",
    "fold_single_runs": _with(_EV, """rn AS (SELECT tid, pos, sym, pos - row_number() OVER (PARTITION BY tid, sym ORDER BY pos) AS k FROM ev JOIN sy USING (name)),
rl AS (SELECT tid, sym, k, min(pos) AS p, count(*) AS c FROM rn GROUP BY tid, sym, k)""") + "SELECT tid, string_agg(sym || CASE WHEN c > 1 THEN '+' ELSE '' END, '' ORDER BY p) AS pattern FROM rl GROUP BY tid",
    "log_parse_events": """SELECT event_id + 0.5 AS ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'API' ELSE 'SYS' END AS kind, user_id AS tid,
CASE event_type WHEN 'purchase' THEN 'S' WHEN 'signup' THEN 'E' END AS state,
CASE WHEN event_type IN ('purchase', 'signup') THEN 'pkg.User.u' || (user_id % 10) || '(java.lang.String, int)' ELSE event_type || '(' || event_id || ', 0) = 0' END AS name FROM events""",
    "strace_parse": """SELECT event_id + 0.25 AS ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'JAVA' ELSE 'SYSCALL' END AS kind, user_id AS tid,
CASE event_type WHEN 'purchase' THEN 'S' WHEN 'signup' THEN 'E' END AS state,
CASE WHEN event_type IN ('purchase', 'signup') THEN 'pkg.A.m()' ELSE event_type || '(' || event_id || ') = 0' END AS payload FROM events WHERE event_type <> 'error'""",
    "log_sorted": f"""SELECT event_id + 0.5 AS ts, CASE WHEN event_type IN ('purchase', 'signup') THEN event_id || '.500000 JAVA ' || user_id || CASE event_type WHEN 'purchase' THEN ' S ' ELSE ' E ' END || 'pkg.User.u' || (user_id % 10) || '(java.lang.String, int)'
ELSE {_SYS_LINE} END AS line FROM events""",
    "syscall_histogram": "SELECT event_type AS name, count(*) AS n, count(DISTINCT user_id) AS threads FROM events WHERE event_type NOT IN ('purchase', 'signup') GROUP BY 1",
    "api_rollups": """WITH a AS (SELECT DISTINCT replace(p_brand, '#', '') AS b, p_size % 5 AS m, p_partkey % 2 = 0 AS args FROM part)
SELECT 'pkg.' || b || '.m' || m || CASE WHEN args THEN '(java.lang.String, int)' ELSE '()' END AS api, 'm' || m AS method, 'pkg.' || b AS "class", 'pkg' AS package,
'pkg.' || b || CASE WHEN args THEN '.m' || m || '(java.lang' ELSE '' END AS class_compat FROM a""",
    "trace_length_stats": _with(_OR) + "SELECT api, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, avg(n) > 100 AS too_long FROM od GROUP BY api",
    "straighten_pairs": """SELECT CAST(event_id AS DOUBLE) AS ts, lpad(CAST(user_id AS VARCHAR), 6, '0') || ' ' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.0 ' || event_type || '(3,' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' END || '"x", 1) = 1' AS value FROM events""",
    "asof_replace": _with(_EV, """pu AS (SELECT tid, pos, 'service' || (pos % 7) AS service FROM ev WHERE name = 'purchase'),
ls AS (SELECT tid, max(pos) AS last FROM ev WHERE name <> 'purchase' GROUP BY tid),
hit AS (SELECT pu.tid, v.pos AS atp, pu.pos, pu.service FROM pu ASOF JOIN (SELECT tid, pos FROM ev WHERE name = 'view') v ON v.tid = pu.tid AND pu.pos >= v.pos JOIN ls ON ls.tid = pu.tid AND ls.last > pu.pos),
win AS (SELECT tid, atp, arg_max(service, pos) AS service FROM hit GROUP BY tid, atp)""") + "SELECT ev.tid, ev.pos, coalesce(win.service, ev.name) AS name FROM ev LEFT JOIN win ON win.tid = ev.tid AND win.atp = ev.pos WHERE ev.name <> 'purchase'",
    "drop_noise": _with(_EV) + "SELECT tid, pos, name FROM ev WHERE name NOT IN ('error', 'signup')",
    "drop_allocator_idiom": _with(_EV, """w AS (SELECT *, pos // 3 % 2 AS a, lead(name) OVER q AS n1, lead(name, 2) OVER q AS n2, lead(name, 3) OVER q AS n3, lead(pos // 3 % 2) OVER q AS a1, lead(pos // 3 % 2, 2) OVER q AS a2 FROM ev WINDOW q AS (PARTITION BY tid ORDER BY pos)),
z AS (SELECT tid, pos, name, CASE WHEN name = 'click' AND n1 = 'view' AND a1 = a THEN CASE WHEN n2 IN ('purchase', 'signup') AND a2 = a THEN CASE WHEN n3 IN ('purchase', 'signup') THEN 4 ELSE 3 END ELSE 2 END ELSE 0 END AS k FROM w)""") + "SELECT z.tid, z.pos, z.name FROM z ANTI JOIN z d ON d.tid = z.tid AND z.pos >= d.pos AND z.pos < d.pos + d.k",
    "drop_signal_blocks": _with(_EV, """m AS (SELECT tid, pos, CASE WHEN name = 'signup' THEN 'rt_sigreturn' ELSE name END AS name, CASE WHEN name = 'error' AND pos % 3 <> 0 THEN 1 WHEN name = 'signup' THEN 0 END AS mark FROM ev),
b AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY tid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)""") + "SELECT tid, pos, name FROM b WHERE coalesce(before, 0) = 0 AND coalesce(mark, 0) = 0",
    "trim_noise": _with(_OR, """m AS (SELECT ok, i, CASE flag WHEN 'NO' THEN 'rt_sigreturn' ELSE flag END AS name, CASE flag WHEN 'NF' THEN 1 WHEN 'NO' THEN 0 END AS mark FROM ln),
b AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY ok ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
k AS (SELECT ok, string_agg('SYS:' || name, '|' ORDER BY i) AS seq FROM b WHERE coalesce(before, 0) = 0 AND coalesce(mark, 0) = 0 AND name <> 'AF' GROUP BY ok)""") + "SELECT od.api, od.ok AS rid, coalesce(k.seq, '') AS seq FROM od LEFT JOIN k USING (ok)",
    "first_api_index": "SELECT DISTINCT o_custkey AS tid, 0::BIGINT AS first FROM orders",
    "drop_empty_callees": _with(_graph()) + """SELECT kg.api, kg.rid, concat_ws('|', CASE WHEN callee IN (SELECT api FROM fl WHERE empty) THEN NULL ELSE 'API:' || callee END, 'SYS:' || event) AS seq FROM kg""",
    "drop_hanging_callees": _with(_graph()) + """SELECT kg.api, kg.rid, concat_ws('|', CASE WHEN callee IN (SELECT api FROM fl) THEN 'API:' || callee END, 'SYS:' || event) AS seq FROM kg""",
    "bracket_spans_lifo": _with(_OR, _SP) + "SELECT tid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, api FROM sp WHERE s <> e",
    "bracket_spans_first_end": _with(_OR, _SP) + "SELECT tid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, api FROM sp",
    "outermost_spans": _with(_OR, _SP) + "SELECT tid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM sp WHERE part = 2 AND e > s",
    "leaf_spans": _with(_OR, _SP) + "SELECT tid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, api FROM sp WHERE part = 1 AND e > s",
    "innermost_listed": _with(_OR, _SP, "li AS (SELECT *, lag(s) OVER (PARTITION BY tid ORDER BY yr, part, atp, ok) AS p FROM sp WHERE s <> e)") + "SELECT tid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, api FROM li WHERE p IS NULL OR NOT (p >= s AND p < e)",
    "kb_exclusive": _with(_OR, """r AS (SELECT od.api, coalesce(string_agg('SYS:' || flag, '|' ORDER BY i), '') AS seq FROM od LEFT JOIN ln ON ln.ok = od.ok GROUP BY od.api, od.ok
UNION ALL SELECT 'pkg.Year.y' || yr || '()', string_agg('API:' || api, '|' ORDER BY atp, ok) FROM od GROUP BY tid, yr UNION ALL SELECT 'START', '' FROM (SELECT DISTINCT tid FROM od))""") + "SELECT api, seq, count(*) AS n FROM r GROUP BY api, seq",
    "kb_inclusive": _with(_OR, """r AS (SELECT od.api, coalesce(string_agg('SYS:' || flag, '|' ORDER BY i), '') AS seq FROM od LEFT JOIN ln ON ln.ok = od.ok GROUP BY od.api, od.ok
UNION ALL SELECT 'pkg.Year.y' || yr || '()', coalesce(string_agg('SYS:' || flag, '|' ORDER BY atp, od.ok, i), '') FROM od LEFT JOIN ln ON ln.ok = od.ok GROUP BY tid, yr UNION ALL SELECT 'START', '' FROM (SELECT DISTINCT tid FROM od))""") + "SELECT api, seq, count(*) AS n FROM r GROUP BY api, seq",
    "syscall_to_apis": _with(_OR) + "SELECT flag AS name, string_agg(DISTINCT api, ',' ORDER BY api) AS apis FROM ln JOIN od ON od.ok = ln.ok GROUP BY flag",
    "api_flags": _with(_OR, _graph(), "q AS (SELECT od.api, od.ok, coalesce(string_agg(flag, '|' ORDER BY i), '') AS seq, count(flag) AS c FROM od LEFT JOIN ln ON ln.ok = od.ok GROUP BY od.api, od.ok)") + "SELECT api, true AS leaf, count(DISTINCT seq) > 1 AS polymorph, max(c) = 0 AS empty, max(c) > 0 AS direct_sys, count(*) AS n FROM q GROUP BY api UNION ALL SELECT api, leaf, polymorph, empty, direct_sys, n FROM fl",
    "reachable_syscalls": _with(_graph(), _REACH, recursive=True) + "SELECT api FROM rs",
    "weak_polymorph": _with(_graph(), _REACH, recursive=True) + "SELECT api FROM wp",
    "api_contingency": _with(_graph(), _REACH, recursive=True) + """SELECT 'direct_sys' AS measure, direct_sys AS has, leaf, polymorph, count(*) AS n FROM fl GROUP BY GROUPING SETS ((direct_sys, leaf, polymorph), (direct_sys, leaf), (direct_sys, polymorph), (direct_sys))
UNION ALL SELECT 'indirect_sys', has, leaf, polymorph, count(*) FROM (SELECT *, api IN (SELECT api FROM rs) AS has FROM fl) GROUP BY GROUPING SETS ((has, leaf, polymorph), (has, leaf), (has, polymorph), (has))""",
    "precise_models": _with(_graph(True), _REACH, """f AS (SELECT api, arg_min(coalesce(callee, ''), rid) AS callee, arg_min(coalesce(event, ''), rid) AS event FROM kg WHERE api NOT IN (SELECT api FROM wp) GROUP BY api),
k AS (SELECT api AS root, callee, event AS flat FROM f UNION ALL SELECT k.root, f.callee, trim(f.event || ' ' || k.flat) FROM k JOIN f ON f.api = k.callee)""", recursive=True) + "SELECT root AS api, flat FROM k WHERE callee = ''",
    "implicit_models": _with(_graph(True), """g AS (SELECT * FROM kg WHERE callee IS NULL OR callee IN (SELECT api FROM fl)),
k AS (SELECT api AS root, callee, coalesce(event, '') AS flat FROM g UNION SELECT k.root, g.callee, CASE WHEN g.api IS NULL THEN '?' ELSE trim(coalesce(g.event, '') || ' ' || k.flat) END FROM k LEFT JOIN g ON g.api = k.callee WHERE k.callee IS NOT NULL),
u AS (SELECT root, flat FROM k WHERE callee IS NULL)""", recursive=True) + "SELECT root AS api, any_value(flat) AS flat FROM u GROUP BY root HAVING count(DISTINCT flat) = 1 AND any_value(flat) <> '?'",
    "invariant_violations": "SELECT '' AS rule, '' AS api WHERE false",
    "model_cycles": _with(_graph(), "e AS (SELECT DISTINCT api, callee FROM kg WHERE callee IS NOT NULL)", "w AS (SELECT api, callee AS atp, 1 AS k FROM e UNION SELECT w.api, e.callee, w.k + 1 FROM w JOIN e ON e.api = w.atp WHERE w.k < (SELECT count(DISTINCT api) FROM e))", recursive=True) + "SELECT api, CAST(min(k) AS BIGINT) AS length FROM w WHERE atp = api GROUP BY api",
    "model_eval": _with(_OR, _FS, _OM, """h AS (SELECT oe.api, oe.rid, bool_or(regexp_full_match(enc, model)) AS ok FROM oe JOIN om ON om.api = oe.api WHERE enc <> '' GROUP BY oe.api, oe.rid),
t AS (SELECT api, count_if(ok) AS successes, count_if(NOT ok) AS fails, count_if(NOT ok) / count(*) AS r FROM h GROUP BY api)""") + "SELECT api, CAST(successes AS BIGINT) AS successes, CAST(fails AS BIGINT) AS fails, CASE WHEN r BETWEEN 0.15 AND 1 THEN round(r, 6) END AS fail_ratio, r BETWEEN 0.15 AND 1 AS troublesome FROM t",
    "corpus_success": _with(_OR, _FS, _OM, "h AS (SELECT oe.rid, bool_or(regexp_full_match(enc, model)) AS ok FROM oe JOIN om ON om.api = oe.api WHERE enc <> '' GROUP BY oe.api, oe.rid)") + "SELECT round(count_if(ok) / count(*), 6) AS success, round(count_if(NOT ok) / count(*), 6) AS fail FROM h",
    "model_counts": _with(_OR, _FS, _OM) + "SELECT om.api, om.model, CAST(count_if(regexp_full_match(enc, model)) AS BIGINT) AS n, count(*) AS total FROM om JOIN oe ON oe.api = om.api WHERE enc <> '' GROUP BY om.api, om.model",
    "local_rare": _with(_OR, _FS, _OM) + "SELECT om.api, om.model, CAST(count_if(regexp_full_match(enc, model)) AS BIGINT) AS n, count(*) AS total FROM om JOIN oe ON oe.api = om.api WHERE enc <> '' GROUP BY om.api, om.model HAVING count_if(regexp_full_match(enc, model)) < 0.02 * count(*)",
    "global_rare": _with(_OR, _FS, _OM, "c AS (SELECT om.api, om.model, count_if(regexp_full_match(enc, model)) < 0.02 * count(*) AS rare FROM om JOIN oe ON oe.api = om.api WHERE enc <> '' GROUP BY om.api, om.model)") + "SELECT model, count(*) AS n_apis FROM c GROUP BY model HAVING bool_and(rare)",
    "same_model_pairs": _with(_OM) + "SELECT a.api, min(b.api) AS other FROM om a JOIN om b ON a.model = b.model AND a.api < b.api GROUP BY a.api",
    "noise_removed": _with(_EV, "l AS (SELECT * FROM ev WHERE name <> 'error')") + "SELECT tid, pos, name FROM l UNION ALL SELECT tid, min(pos) - 1, arg_min(name, pos) FROM l GROUP BY tid",
    "java_lines_dropped": "SELECT event_id || '.500000 SYSCALL ' || user_id || ' ' || event_type || '(' || event_id || ', 0) = 0' AS value FROM events WHERE event_type NOT IN ('purchase', 'signup')",
    "signal_lines_dropped": _with(_OR) + "SELECT od.api, od.ok AS rid, coalesce(string_agg('SYS:' || flag, '|' ORDER BY i) FILTER (flag <> 'NF'), '') AS seq FROM od LEFT JOIN ln ON ln.ok = od.ok GROUP BY od.api, od.ok",
    "events_only": _with(_OR) + "SELECT tid, CAST(sum(n) AS BIGINT) AS n, CAST(min(p) AS BIGINT) AS first FROM (SELECT *, 1 + dense_rank() OVER (PARTITION BY tid ORDER BY yr) * 2 - 2 + 2 * row_number() OVER (PARTITION BY tid ORDER BY yr, atp, ok) - 1 + sum(n) OVER (PARTITION BY tid ORDER BY yr, atp, ok) - n AS p FROM od) WHERE n > 0 GROUP BY tid",
    "modelless_dropped": _with(_OR) + "SELECT tid, CAST(2 * count_if(api IN ('pkg.Order.1URGENT()', 'pkg.Order.5LOW()')) AS BIGINT) AS n_calls, CAST(sum(n) AS BIGINT) AS n_events FROM od GROUP BY tid HAVING sum(n) > 0 OR count_if(api IN ('pkg.Order.1URGENT()', 'pkg.Order.5LOW()')) > 0",
    "api_call_names": _with(_OR) + "SELECT DISTINCT od.api, flag AS name FROM od JOIN ln USING (ok)",
    "sharing_apis": _with(_OM) + "SELECT DISTINCT api FROM om WHERE api <> 'pkg.Order.1URGENT()' AND model IN (SELECT model FROM om WHERE api = 'pkg.Order.1URGENT()')",
    "model_owner_apis": _with(_OM) + f"SELECT DISTINCT api FROM om WHERE model = chr({_FLAG_CODES['NO']})",
    "models_numbered": _with(_OM) + "SELECT api, model, row_number() OVER (ORDER BY api, model) AS model_id FROM om",
    "model_eval_timed": _with(_OR, _FS, _OM) + "SELECT api, CAST(count_if(ok) AS BIGINT) AS successes, CAST(count_if(NOT ok) AS BIGINT) AS fails, 0::BIGINT AS timeouts, false AS expensive FROM (SELECT oe.api, oe.rid, bool_or(regexp_full_match(enc, model)) AS ok FROM oe JOIN om ON om.api = oe.api WHERE enc <> '' GROUP BY ALL) GROUP BY api",
    "full_match_threads": _with(_OR, _FS, _OM) + "SELECT rid AS tid, om.api, model FROM oe JOIN om ON regexp_full_match(enc, model)",
    "first_occurrences": _with(_EV, _EM) + "SELECT tid, api, model, length(regexp_extract(enc, '^(.*?)(' || model || ')', 1)) AS s, length(regexp_extract(enc, '^(.*?)(' || model || ')', 1)) + length(regexp_extract(enc, '^(.*?)(' || model || ')', 2)) AS e FROM en JOIN em ON regexp_matches(enc, model)",
    "all_occurrences": _with(_EV, _EM) + "SELECT tid, api, model, CAST(len(regexp_extract_all(enc, model)) AS BIGINT) AS n FROM en JOIN em ON regexp_matches(enc, model)",
    "occurrence_totals": _with(_EV, _EM) + "SELECT tid, api, model, CAST(len(regexp_extract_all(enc, model)) AS BIGINT) AS n, length(regexp_extract(enc, '^(.*?)(' || model || ')', 1)) AS first, CAST(length(array_to_string(regexp_extract_all(enc, model), '')) AS BIGINT) AS covered FROM en JOIN em ON regexp_matches(enc, model)",
    "overlapping_traces": _with(_OR, "q AS (SELECT od.api, od.ok, string_agg(flag, '|' ORDER BY i) AS seq FROM od JOIN ln ON ln.ok = od.ok GROUP BY od.api, od.ok)") + "SELECT a.api, b.api AS other, count(*) AS n FROM (SELECT DISTINCT api, seq FROM q) a JOIN q b ON a.seq = b.seq AND a.api <> b.api GROUP BY a.api, b.api",
    "model_properties": _with(_EM) + "SELECT api, model, regexp_extract(model, '[^()]') AS first_sym, CASE WHEN contains(model, '+') THEN 0 ELSE length(regexp_replace(model, '[()?*|]', '', 'g')) END AS max_len, true AS leaf FROM em",
    "matchable_ngrams": _AMB + "SELECT ngram, api FROM lb",
    "prefix_match_counts": _with(_EV, _EM, "pr AS (SELECT tid, k, substr(enc, 1, k) AS enc FROM en, (SELECT unnest(range(1, 101)) AS k) WHERE length(enc) >= k)") + "SELECT k, CAST(count_if(regexp_full_match(enc, model)) AS BIGINT) AS n_full, CAST(count_if(regexp_matches(enc, model)) AS BIGINT) AS n_search, CAST(sum(len(regexp_extract_all(enc, model))) AS BIGINT) AS n_all FROM pr, em GROUP BY k",
    "maximal_munch": _with(_EV, _EM, _MUNCH, recursive=True) + "SELECT tid, s, e, string_agg(api, ',' ORDER BY api) AS apis FROM ml GROUP BY tid, s, e",
    "hit_miss": _with(_EV, _EM, _MUNCH, _TRUE, """j AS (SELECT ts.tid, mu.s IS NOT NULL AS found, ml.api IS NOT NULL AS hit, ts.api IN (SELECT api FROM em) AS leaf FROM ts LEFT JOIN mu USING (tid, s, e) LEFT JOIN ml USING (tid, s, e, api))""", recursive=True) + "SELECT tid, count_if(hit) AS hits, count_if(NOT hit) AS misses, count_if(hit) AS good, count_if(found AND NOT hit AND leaf) AS bad, count_if(NOT found AND leaf) AS not_found, count_if(NOT hit AND NOT leaf) AS not_bad FROM j GROUP BY tid",
    "span_coverage": _with(_EV, _EM, _MUNCH, _TRUE, "c AS (SELECT tid, sum(e - s) AS covered FROM ts SEMI JOIN ml USING (tid, s, e, api) GROUP BY tid)", recursive=True) + "SELECT ts.tid, CAST(coalesce(any_value(covered), 0) AS BIGINT) AS covered, CAST(sum(e - s) AS BIGINT) AS total, round(coalesce(any_value(covered), 0) / sum(e - s), 6) AS ratio FROM ts LEFT JOIN c USING (tid) GROUP BY ts.tid",
    "match_length": _with(_EV, _EM, _MUNCH, recursive=True) + "SELECT tid, round(avg(e - s), 6) AS mean FROM mu GROUP BY tid",
    "corpus_averages": _with(_EV, _EM, _MUNCH, _TRUE, """x AS (SELECT ts.*, ml.api IS NOT NULL AS hit FROM ts LEFT JOIN ml USING (tid, s, e, api)),
y AS (SELECT tid, coalesce(sum(e - s) FILTER (hit), 0) / sum(e - s) AS r FROM x GROUP BY tid)""", recursive=True) + "SELECT round((SELECT avg(r) FROM y), 6) AS coverage, round((SELECT count_if(hit) / count(*) FROM x), 6) AS correct",
    "coverage_steps": _with(_OR, _SP, "t AS (SELECT tid, s, e FROM sp WHERE part = 2 AND e > s)") + "SELECT tid, CAST(s AS BIGINT) AS x, 1::BIGINT AS y FROM t UNION SELECT tid, CAST(e AS BIGINT), 0 FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.tid = t.tid AND u.s = t.e)",
    "trace_ambiguity": _with(_EV, _EM, _MUNCH, *[f"k{i} AS (SELECT tid, s, count(DISTINCT {e}) AS k FROM ml GROUP BY tid, s)" for i, e in enumerate(_ROLL.values())], recursive=True) + " UNION ALL ".join(f"SELECT tid, '{scope}' AS scope, round(sum(log10(k)), 6) AS log10 FROM k{i} GROUP BY tid" for i, scope in enumerate(_ROLL)),
    "ngram_ambiguity": _AMB + "SELECT ngram, n, n_apis, freq, (n_apis - 1) * freq AS effective FROM am",
    "ambiguity_scope": _AMB + " UNION ALL ".join(f"SELECT '{scope}' AS scope, lb.ngram, count(DISTINCT {e}) AS n_apis, CAST((count(DISTINCT {e}) - 1) * any_value(freq) AS BIGINT) AS effective FROM lb JOIN fr USING (ngram) GROUP BY lb.ngram" for scope, e in _ROLL.items()),
    "ambiguity_hist": _with(_EV, _EM, _GRAMS, _HIST) + 'SELECT n, k, c AS "count" FROM hi',
    "ambiguity_cdf": _with(_EV, _EM, _GRAMS, _HIST) + "SELECT n, k, CAST(sum(c) OVER (PARTITION BY n ORDER BY k) AS BIGINT) AS cum, round(100.0 * sum(c) OVER (PARTITION BY n ORDER BY k) / sum(c) OVER (PARTITION BY n), 6) AS scaled FROM hi",
    "ambiguity_fullcdf": _with(_EV, _EM, _GRAMS, """po AS (SELECT n, substr(enc, CAST(i AS INT), n) AS g FROM en, (SELECT unnest([1, 2, 3, 4, 5]) AS n), unnest(range(1, length(enc) + 1)) u(i) WHERE i + n - 1 <= length(enc)),
un AS (SELECT n, 0::BIGINT AS k, count_if(g NOT IN (SELECT ngram FROM lb)) AS freq FROM po GROUP BY n),
fu AS (SELECT n, k, sum(freq) AS freq FROM (SELECT n, n_apis AS k, freq FROM am UNION ALL SELECT n, k, freq FROM un) GROUP BY n, k)""") + "SELECT n, k, CAST(sum(freq) OVER (PARTITION BY n ORDER BY k) AS BIGINT) AS cum, round(100.0 * sum(freq) OVER (PARTITION BY n ORDER BY k) / sum(freq) OVER (PARTITION BY n), 6) AS scaled FROM fu",
    "permission_filter": "SELECT c_custkey AS app FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_nationkey % 4 = 3",
    "fold_patterns": _with(_EV, """ru AS (SELECT tid, s, min(k) AS k FROM (SELECT tid, enc, unnest(range(1, length(enc))) AS s FROM en), (SELECT unnest(range(1, (SELECT max(length(enc)) // 2 + 1 FROM en))) AS k)
  WHERE s + 2 * k <= length(enc) + 1 AND substr(enc, CAST(s AS INT), CAST(k AS INT)) = substr(enc, CAST(s + k AS INT), CAST(k AS INT)) GROUP BY tid, s),
rc AS (SELECT tid, s, k, substr(enc, CAST(s AS INT), CAST(k AS INT)) AS unit, list_max(list_filter(range(2, (length(enc) + 1 - s) // k + 1), lambda c: substr(enc, CAST(s AS INT), CAST(k * c AS INT)) = repeat(substr(enc, CAST(s AS INT), CAST(k AS INT)), c))) AS c FROM ru JOIN en USING (tid)),
wa AS (SELECT tid, enc, 1::BIGINT AS atp, '' AS pattern, 0::BIGINT AS n_folds FROM en
  UNION ALL SELECT wa.tid, enc, atp + coalesce(k * c, 1), pattern || CASE WHEN k IS NULL THEN substr(enc, CAST(atp AS INT), 1) WHEN k = 1 THEN unit || '+' ELSE '(' || unit || ')+' END, n_folds + CAST(k IS NOT NULL AS INT) FROM wa LEFT JOIN rc ON rc.tid = wa.tid AND rc.s = wa.atp WHERE atp <= length(enc))""", recursive=True) + "SELECT tid, length(enc) AS n, pattern, n_folds FROM wa WHERE atp > length(enc)",
    "straighten_exact": """WITH l AS (SELECT user_id AS pid, event_id, event_type AS name, event_id % 3 AS what, lpad(CAST(user_id AS VARCHAR), 6, '0') || ' ' || lpad(CAST(event_id AS VARCHAR), 9, '0') || ' ' || event_type AS head FROM events),
s AS (SELECT *, coalesce(sum(CAST(what = 1 AS INT)) OVER (PARTITION BY pid ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM l),
f AS (SELECT *, min(event_id) FILTER (what = 0) OVER q AS cut, arg_min(head, event_id) FILTER (what = 0) OVER q AS pending FROM s WINDOW q AS (PARTITION BY pid, part))
SELECT CAST(event_id AS DOUBLE) AS ts, head || '() = 0' AS value FROM f WHERE what = 2 AND (cut IS NULL OR cut > event_id)
UNION ALL SELECT CAST(cut AS DOUBLE), pending || '(3,) = 1' FROM f WHERE what = 1 AND cut < event_id AND contains(pending || '(3,', name)""",
    "kb_unwind": _with(_OR, _BRACKETS, """tr AS (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY pos) AS i, state, name FROM br WHERE NOT (coalesce(state, '') = 'E' AND (tid * 31 + pos) % 11 = 0)),
st AS (SELECT DISTINCT tid, 0::BIGINT AS i, ['START'] AS apis, [''] AS seqs, CAST([] AS STRUCT(api VARCHAR, seq VARCHAR)[]) AS done FROM tr
UNION ALL SELECT tid, i,
  CASE WHEN state IS NULL THEN apis WHEN state = 'S' THEN list_append(CASE WHEN idle THEN list_append(apis[:n - 1], 'NOAPI') ELSE apis END, name) WHEN n = 1 OR stop <= 1 THEN ['NOAPI'] ELSE apis[:stop - 1] END,
  CASE WHEN state IS NULL THEN list_append(seqs[:n - 1], concat_ws('|', nullif(seqs[n], ''), 'SYS:' || name))
    WHEN state = 'S' THEN list_append(CASE WHEN idle THEN list_append(seqs[:n - 1], '') ELSE list_append(seqs[:n - 1], concat_ws('|', nullif(seqs[n], ''), 'API:' || name)) END, '')
    WHEN n = 1 OR stop <= 1 THEN [''] ELSE seqs[:stop - 1] END,
  CASE WHEN state = 'S' AND (apis[n] = 'START' OR idle AND seqs[n] <> '') THEN [{'api': apis[n], 'seq': seqs[n]}]
    WHEN state = 'E' THEN list_transform(range(CASE WHEN apis[n] = name THEN n ELSE stop + 1 END, n + 1), lambda x: {'api': apis[x], 'seq': seqs[x]}) ELSE [] END
FROM (SELECT tr.*, apis, seqs, len(apis) AS n, apis[len(apis)] IN ('START', 'NOAPI') AS idle,
  CASE WHEN apis[len(apis)] = name THEN len(apis) ELSE coalesce(list_max(list_filter(range(1, len(apis)), lambda x: apis[x] = name)), 0) END AS stop
  FROM st JOIN tr ON tr.tid = st.tid AND tr.i = st.i + 1)),
ou AS (SELECT unnest(done, recursive := true) FROM st)""", recursive=True) + "SELECT api, seq, count(*) AS n FROM ou GROUP BY api, seq",
    "align_pair": _with(_OR, _FS, """nx AS (SELECT api, rid, enc AS x, lead(enc) OVER (PARTITION BY api ORDER BY rid) AS y FROM oe),
dp AS (SELECT DISTINCT x, y, 0 AS i, [list_transform(range(0, length(y) + 1), lambda j: -j)] AS rws FROM nx WHERE y IS NOT NULL
  UNION ALL SELECT x, y, i + 1, list_append(rws, list_transform(range(0, length(y) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: k - j + greatest(rws[i + 1][k + 1] - 1, CASE WHEN k = 0 THEN -i - 1 ELSE rws[i + 1][k] + CASE WHEN substr(x, i + 1, 1) = substr(y, CAST(k AS INT), 1) THEN 1 ELSE -1 END END)))))
  FROM dp WHERE i < length(x)),
tb AS (SELECT x, y, rws, length(x) AS i, length(y) AS j, '' AS a, '' AS b FROM dp WHERE i = length(x)
  UNION ALL SELECT x, y, rws, CASE WHEN how < 2 THEN i - 1 ELSE i END, CASE WHEN how = 1 THEN j ELSE j - 1 END, CASE WHEN how < 2 THEN substr(x, i, 1) ELSE '-' END || a, CASE WHEN how = 1 THEN '-' ELSE substr(y, j, 1) END || b
  FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND rws[i + 1][j + 1] = rws[i][j] + CASE WHEN substr(x, i, 1) = substr(y, j, 1) THEN 1 ELSE -1 END THEN 0 WHEN i > 0 AND rws[i + 1][j + 1] = rws[i][j + 1] - 1 THEN 1 ELSE 2 END AS how FROM tb WHERE i > 0 OR j > 0))""", recursive=True) + "SELECT api, rid, a, b FROM nx JOIN tb USING (x, y) WHERE i = 0 AND j = 0",
    "fold_multi_pass": _with(_OR, _FS, _passes(4), recursive=True) + "SELECT DISTINCT oe.enc, pattern FROM oe LEFT JOIN fd USING (enc)",
    "models_generic": _with(_OR, _FS, _passes(4), _GENERIC, recursive=True) + _MODEL_ROWS,
    "models_less_generic": _with(_OR, _FS, _passes(4), _LESS, recursive=True) + _MODEL_ROWS,
    "model_stats": _with(_OR, _FS, _passes(4), _LESS, """z AS (SELECT sq.api, train, cap, sq.i > last AND train >= cap AS tested, len(list_filter(ms, lambda x: regexp_full_match(enc, x.model))) > 0 AS ok FROM sq JOIN ld USING (api)),
e AS (SELECT api, bool_or(enc = '') AS empty_allowed FROM oe GROUP BY api)""", recursive=True) + """SELECT api, empty_allowed, CAST(any_value(train) AS INT) AS n_train, CAST(count_if(NOT tested) - any_value(train) AS INT) AS n_redundant, CAST(count_if(tested) AS INT) AS n_test,
CAST(count_if(NOT tested) - any_value(train) + count_if(tested AND ok) AS INT) AS successes, CAST(count_if(tested AND NOT ok) AS INT) AS fails FROM z JOIN e USING (api) GROUP BY api, empty_allowed""",
    "align_learn": _with(_OR, _FS, _ALIGN, recursive=True) + "SELECT api, 'ok' AS status, model, CAST(count_if(k > ta.cap AND regexp_full_match(enc, model)) AS INT) AS successes, CAST(count_if(k > ta.cap AND NOT regexp_full_match(enc, model)) AS INT) AS fails FROM ap JOIN ta USING (api) GROUP BY api, model",
    "whole_analysis": _with(*_WHOLE, """j AS (SELECT sp.*, ml.api IS NOT NULL AS hit FROM sp LEFT JOIN ml USING (tid, s, e, api) WHERE sp.s <> sp.e),
h AS (SELECT tid, CAST(count_if(hit) AS BIGINT) AS hits, CAST(count_if(NOT hit) AS BIGINT) AS misses, coalesce(sum(e - s) FILTER (hit), 0) AS covered, sum(e - s) FILTER (part = 2) AS total FROM j GROUP BY tid)""", recursive=True) + "SELECT tid, hits, misses, CAST(covered AS BIGINT) AS covered, CAST(total AS BIGINT) AS total, round(covered / total, 6) AS ratio, mean FROM h LEFT JOIN (SELECT tid, round(avg(e - s), 6) AS mean FROM mu GROUP BY tid) USING (tid)",
    "whole_ambiguity": _with(*_WHOLE, *[f"k{i} AS (SELECT tid, s, count(DISTINCT {e}) AS k FROM ml GROUP BY tid, s)" for i, e in enumerate(_ROLL.values())], recursive=True) + " UNION ALL ".join(f"SELECT tid, '{scope}' AS scope, round(sum(log10(k)), 6) AS log10 FROM k{i} GROUP BY tid" for i, scope in enumerate(_ROLL)),
}
