"""Queries over the driver's tables for each operator, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import chat, html, iblt, jaccard, langid, mixing, packing, pii, quality, warc
from spanforge.llm.common import fresh_path, table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from all formatted conversations, and from one whose texts hold control strings."""
    extra = spark.sql(r"SELECT bigint(-7) AS conv_id, bigint(t) AS turn, r AS role, '\\### Assistant: </turn> ok' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, and number of links, of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to archives and read back."""
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).selectExpr("page_id", "payload_bytes", "payload_digest", "type AS record_type", "refers_to")


def op4_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and decision for every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_jaccard": op2_jaccard,
    "op3_warc": op3_warc,
    "op4_iblt": op4_iblt,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_html": op7_html,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
}

#: Turns in order; lengths of the template's strings are counted here.
OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS rn,
    row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role AS head
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) + sum(CASE WHEN head THEN rn + 24 ELSE 8 END) - 1 AS BIGINT) AS formatted_chars,
  count(*) FILTER (head) AS n_blocks
FROM e GROUP BY conv_id
"""

#: All pairs of texts that share a shingle, counted exactly; classes by recursion over the links.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT text, min(doc_id) AS rep, count(*) AS copies FROM d GROUP BY text),
w AS (SELECT rep, copies, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT rep, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.rep <> b.rep GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.rep = p.a JOIN n y ON y.rep = p.b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
c AS (SELECT rep AS node, rep AS label FROM t UNION SELECT l.b, c.label FROM c JOIN l ON l.a = c.node),
k AS (SELECT node, min(label) AS class_id FROM c GROUP BY node),
m AS (SELECT l.a, sum(t.copies) AS links, count(*) AS texts FROM l JOIN t ON t.rep = l.b GROUP BY l.a)
SELECT d.doc_id, t.rep AS text_id, k.class_id, CAST(coalesce(m.links, 0) + t.copies - 1 AS BIGINT) AS n_links, CAST(coalesce(m.texts, 0) AS BIGINT) AS n_text_links
FROM d JOIN t ON t.text = d.text JOIN k ON k.node = t.rep LEFT JOIN m ON m.a = t.rep
"""

OP3_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN m.last IS NULL OR m.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.last <> p.page_id THEN m.last END AS refers_to
FROM p LEFT JOIN m ON m.payload_digest = p.payload_digest AND p.payload_bytes >= 1000
"""

_WORD_COUNTS = ", ".join(f"len(list_filter(ws, lambda x: x = '{w}'))" for w in quality.COMMON_WORDS)
_BLANK = r"[ \t\n\x0b\x0c\r]"


def _distance(counts: str, reference: str) -> str:
    """Jensen-Shannon distance of two lists in SQL."""
    p, q = f"({counts}[i] / list_sum({counts}))", f"({reference}[i] / list_sum({reference}))"
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * ln(2 * {a} / ({a} + {b})) ELSE 0 END"
    return f"CASE WHEN list_sum({counts}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {half(p, q)} + {half(q, p)})) / (2 * ln(2)), 0)) END"


def _bins() -> str:
    """Counts of the character classes: what each removal in turn takes from the text."""
    classes = [r"\p{Ll}", r"\p{Lu}", _BLANK[1:-1], r".,\x{060C}\x{06D4}\x{0964}\x{0965}\x{3001}\x{3002}\x{FF0C}\x{FF0E}",
        r";:!?''\x22()\x{061B}\x{061F}\x{05BE}\x{05F3}\x{05F4}\x{3008}-\x{300F}\x{30FB}\x{FF01}\x{FF08}\x{FF09}\x{FF1A}\x{FF1B}\x{FF1F}-", r"\p{Nd}", r"\p{L}\p{M}\x{200C}\x{200D}"]
    left = ["t"]
    for c in classes:
        left.append(f"regexp_replace({left[-1]}, '[{c}]+', '', 'g')")
    sizes = [f"length({x})" for x in left]
    return "[" + ", ".join([f"{a} - {b}" for a, b in zip(sizes, sizes[1:], strict=False)] + [sizes[-1]]) + "]"


#: Counts by lists and joins; references and distances from the counts. Digits count with small letters in distances.
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w),
v AS (SELECT r, count(DISTINCT i + k) AS n FROM g SEMI JOIN (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1) USING (r, g), (VALUES (0), (1), (2)) x(k) GROUP BY r),
k AS (SELECT w.r, doc_id, lang, length(t) AS n, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, {_bins()} AS ks, [{_WORD_COUNTS}] AS fs FROM w LEFT JOIN v USING (r)),
c AS (SELECT *, [ks[1] + ks[6], ks[2], ks[3], ks[4], ks[5], ks[7], ks[8]] AS cs, list_append(fs, n_words - list_sum(fs)) AS wc FROM k),
s AS (SELECT lang, i, sum(cs[i]) AS x FROM c, range(1, 8) t(i) WHERE ks[8] * 100 <= list_sum(ks) AND ks[2] * 5 <= list_sum(ks) GROUP BY lang, i),
u AS (SELECT lang, i, sum(wc[i]) AS x FROM c, range(1, {len(quality.COMMON_WORDS) + 2}) t(i) WHERE ks[8] * 100 <= list_sum(ks) AND ks[2] * 5 <= list_sum(ks) GROUP BY lang, i),
a AS (SELECT b.lang, rc, rw, rw[-1] / list_sum(rw) AS rest FROM (SELECT lang, list(x ORDER BY i) AS rc FROM s GROUP BY lang) b JOIN (SELECT lang, list(x ORDER BY i) AS rw FROM u GROUP BY lang) e ON b.lang IS NOT DISTINCT FROM e.lang WHERE list_sum(rc) > 0 AND list_sum(rw) > 0),
f AS (SELECT *, 1 - rest >= {quality.COMMON_SHARE} AS telling, bool_or(1 - rest >= {quality.COMMON_SHARE}) OVER () AS any_telling,
    CASE WHEN 1 - rest < {quality.COMMON_SHARE} THEN {quality.WORD_DISTANCE} ELSE least({quality.WORD_DISTANCE}, {quality.WORD_MARGIN} * sqrt(((1 - rest) + log2(2 / (1 + rest)) + CASE WHEN rest > 0 THEN rest * log2(2 * rest / (1 + rest)) ELSE 0 END) / 2)) END AS word_limit FROM a),
n AS (SELECT r, bool_or(coalesce({_distance("cs", "rc")}, 0) <= {quality.CLASS_DISTANCE} AND coalesce({_distance("wc", "rw")}, 0) <= word_limit AND (telling OR NOT any_telling OR c.lang IS NOT DISTINCT FROM f.lang)) AS near FROM c, f GROUP BY r),
o AS (SELECT c.*, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_SHARE} * n_words AS base_failed, coalesce(near, true) AND ks[6] * 100 <= {quality.DIGIT_SHARE} * list_sum(ks) AS near FROM c LEFT JOIN n USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {quality.GUARD_WORDS} OR n < {quality.GUARD_CHARS} OR near) AS kept
FROM o
"""

ORACLES: dict[str, str] = {
    "op1_chat": OP1_SQL,
    "op2_jaccard": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op9_quality": OP9_SQL,
}
