"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

import math

from taxaspark.llm import chat, quality, repeats

OP8_REPEATS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT rid, 1000 * b AS base, substr(h, 2000 * b + 1, 2000 + {2 * repeats.LENGTH - 2}) AS c FROM (SELECT rid, h, unnest(range(0, CAST(ceil(length(h) / 2000.0) AS BIGINT))) AS b FROM d)),
windows AS (SELECT rid, base + i AS p, md5(substr(c, 2 * i + 1, {2 * repeats.LENGTH})) AS w FROM (SELECT rid, base, c, unnest(range(0, least(1000, length(c) // 2 - {repeats.LENGTH - 1}))) AS i FROM pieces)),
hits AS (SELECT rid, p, p > coalesce(lag(p) OVER o, -1000) + {repeats.LENGTH} AS fresh FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w) WINDOW o AS (PARTITION BY rid ORDER BY p)),
numbered AS (SELECT rid, p, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY rid ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM hits),
runs AS (SELECT rid, min(p) AS a, max(p) + {repeats.LENGTH} AS b FROM numbered GROUP BY rid, run),
gaps AS (SELECT rid, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0))) AS g FROM runs JOIN d USING (rid)),
cut AS (SELECT rid, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(g, '' ORDER BY a) AS before FROM gaps GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (rid)"""

WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def _edge(above: bool) -> str:
    return f"CASE WHEN bucket IS NULL THEN 0.0 ELSE pow({quality.GAMMA!r}, bucket - {0 if above else 1}) * {1 + 1e-6 if above else 1 - 1e-6!r} END"


def _fences(keys: list[str]) -> str:
    """SQL for the fences of the groups ``keys``, one column for each."""
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {by}ratio"

    def at(q: float, above: bool) -> str:
        return f"min(CASE WHEN upto >= ceil({q!r} * size) THEN {_edge(above)} END)"

    each = f"""SELECT {by}ratio, max(size) AS size, {at(quality.HIGH, True)} AS high, {at(1 - quality.HIGH, False)} AS low, {at(0.5, False)} AS mid_below, {at(0.5, True)} AS mid_above FROM
(SELECT *, sum(n) OVER ({part}) AS size, sum(n) OVER ({part} ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT {by}ratio, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {by}ratio"""
    bounds = ", ".join(f"max(CASE WHEN ratio = '{b[:-3]}' THEN {'high + ' + repr(quality.SPREAD) + ' * (high - mid_below)' if b.endswith('_hi') else 'low - ' + repr(quality.SPREAD) + ' * (mid_above - low)'} END) AS {b}" for b in quality.BOUNDS)
    return f"(SELECT {by}CAST(max(size) AS DOUBLE) AS size, {bounds} FROM ({each}) {'GROUP BY ' + ', '.join(keys) if keys else ''})"


def _quality() -> str:
    ratio = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, CAST({e.replace('/', '/ nullif(') + ', 0)'} AS DOUBLE) AS v FROM base WHERE n_words > 0" for k, (e, _) in quality.RATIOS.items())
    drawn = ", ".join(f"(g.size * g.{b} + {quality.PRIOR} * ((l.size * l.{b} + {quality.PRIOR} * a.{b}) / (l.size + {quality.PRIOR}))) / (g.size + {quality.PRIOR}) AS {b}" for b in quality.BOUNDS)
    fine = " AND ".join(f"{e.replace('/', '/ nullif(') + ', 0)'} <= {k}_hi" + (f" AND {e.replace('/', '/ nullif(') + ', 0)'} >= {k}_lo" if below else "") for k, (e, below) in quality.RATIOS.items())
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, lang, source, t, list_filter(string_split_regex(t, '{WS}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOT_WS}')) AS l FROM t),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS j FROM win JOIN (SELECT rid, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (rid, g)) GROUP BY rid),
base AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{WS}+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM s LEFT JOIN rep USING (rid)),
sketch AS (SELECT lang, source, ratio, CASE WHEN v > 0 THEN CAST(ceil(round(ln(v) / {math.log(quality.GAMMA)!r}, 9)) AS BIGINT) END AS bucket, count(*) AS n FROM ({ratio}) WHERE v IS NOT NULL GROUP BY ALL),
groups AS (SELECT g.lang, g.source, {drawn} FROM {_fences(['lang', 'source'])} g JOIN {_fences(['lang'])} l ON l.lang IS NOT DISTINCT FROM g.lang CROSS JOIN {_fences([])} a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
CASE WHEN n_words < 50 OR 100 * n_repeat_words > 50 * n_words THEN false ELSE coalesce({fine}, true) END AS kept, b.lang, b.source
FROM base b LEFT JOIN groups q ON q.lang IS NOT DISTINCT FROM b.lang AND q.source IS NOT DISTINCT FROM b.source"""


OP9_QUALITY = _quality()


def _escaped(x: str) -> str:
    return f"replace(replace({x}, '<|', '< |'), '|>', '| >')"


OP10_CHAT = rf"""WITH t AS (SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{chat.SYSTEM}'),
v AS (SELECT t.conv_id, perspective, turn, speaker, text, CASE WHEN speaker = '{chat.SYSTEM}' THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
h AS (SELECT *, '{chat.START}' || role || CASE WHEN role = 'user' THEN ' name=' || {_escaped(r"regexp_replace(speaker, '\s', '_', 'g')")} ELSE '' END || chr(10) AS head FROM v),
s AS (SELECT *, head || {_escaped('text')} || '{chat.STOP.strip()}' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(length(segment) AS BIGINT) AS size, CAST(row_number() OVER (PARTITION BY conv_id, perspective, turn ORDER BY speaker, text) - 1 AS INTEGER) AS place,
CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)
SELECT conv_id, perspective, turn, place, speaker, role, segment, start, start + size AS stop, CAST(CASE WHEN role = 'assistant' THEN start + length(head) ELSE start END AS BIGINT) AS learn_start, CAST(CASE WHEN role = 'assistant' THEN start + size ELSE start END AS BIGINT) AS learn_stop FROM o"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS t FROM benchmark),
total AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
asked AS (SELECT iid, term, count(*) AS q FROM (SELECT iid, unnest(t) AS term FROM i) GROUP BY ALL),
tf AS (SELECT rid, n, term, count(*) AS tf FROM (SELECT rid, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
scored AS (SELECT iid, rid, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN weight USING (term), total GROUP BY ALL),
ranked AS (SELECT iid, doc_id, score, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scored JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (iid) WHERE rank <= 10"""

ORACLE = {"op8_repeats": OP8_REPEATS, "op9_quality": OP9_QUALITY, "op10_chat": OP10_CHAT, "op12_search": OP12_SEARCH}
