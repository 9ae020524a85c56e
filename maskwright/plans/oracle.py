"""SQL texts that compute the same results in DuckDB, for checking.

They are written relationally (one row per match, window functions), unlike the
array expressions of the jobs.  Not all of it is independent: patterns and word
lists come from the same fixed values, offsets are sums over a split text on both
sides, and ``fake_label`` repeats the formula of the fake values.  The tests
compare these with plain Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from maskwright.plans.seed import DUCKDB_SQL
from maskwright.rules import BUILT_IN, HINTS, RESPONSE_TYPES, Rule, score

SEEDED = f"seeded AS ({DUCKDB_SQL})"
CORPUS = (
    f"{SEEDED}, corpus AS (SELECT 'document' AS src, doc_id AS id, CAST(0 AS BIGINT) AS sub, text FROM documents "
    "UNION ALL SELECT 'turn', conv_id, turn, text FROM seeded)"
)
CORPUS_KEYS = ("src", "id", "sub")
TURN_KEYS = ("conv_id", "turn")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(keys: Sequence[str], prefix: str = "") -> str:
    return ", ".join(prefix + k for k in keys)


def _matches(source: str, keys: Sequence[str], rule: Rule, order: int) -> str:
    p = quote(rule.re2)
    return f"""
    SELECT {listed(keys)}, {order} AS ord, {quote(rule.type)} AS type, {score(rule.confidence)} AS confidence,
      {quote(rule.reason)} AS reason, i, m[i] AS value,
      CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start
    FROM (SELECT {listed(keys)}, m, g, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT {listed(keys)}, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g
        FROM {source} WHERE regexp_matches(text, {p})))"""


def matches(source: str, keys: Sequence[str], rules: Sequence[Rule], name: str = "matches") -> str:
    """CTE with every match of every rule."""
    union = "\nUNION ALL".join(_matches(source, keys, r, o) for o, r in enumerate(rules))
    return f'{name} AS (SELECT *, start + length(value) AS "end" FROM ({union}))'


def detections(source: str, keys: Sequence[str], rules: Sequence[Rule] = BUILT_IN) -> str:
    """CTEs ending in ``dets``: first hit per (type, value), numbered by start and rule order."""
    k = listed(keys)
    return f"""{matches(source, keys, rules)},
    dets AS (SELECT {k}, CAST(row_number() OVER (PARTITION BY {k} ORDER BY start, ord) - 1 AS INTEGER) AS seq,
        type, value, start, CAST("end" AS INTEGER) AS "end", CAST(confidence AS DOUBLE) AS confidence, 'regex' AS source
      FROM (SELECT *, row_number() OVER (PARTITION BY {k}, type, value ORDER BY ord, i) AS nth FROM matches)
      WHERE nth = 1)"""


def covers(source: str, keys: Sequence[str], rules: Sequence[Rule] = BUILT_IN, also: str = "") -> str:
    """CTEs ending in ``dets``: all hits, overlapping ones merged.

    ``also`` names a CTE of further hits; they come after the rules.
    """
    k = listed(keys)
    more = f' UNION ALL SELECT {k}, 1000 AS ord, type, start, "end" FROM {also}' if also else ""
    return f"""{matches(source, keys, rules)},
    all_hits AS (SELECT {k}, ord, type, start, "end" FROM matches{more}),
    reached AS (SELECT *, max("end") OVER (PARTITION BY {k} ORDER BY start, "end" DESC, ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM all_hits),
    grouped AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END)
        OVER (PARTITION BY {k} ORDER BY start, "end" DESC, ord ROWS UNBOUNDED PRECEDING) AS grp FROM reached),
    merged AS (SELECT {k}, grp, first(type ORDER BY start, "end" DESC, ord) AS type,
        min(start) AS start, max("end") AS "end" FROM grouped GROUP BY {k}, grp),
    dets AS (SELECT {listed(keys, 'm.')}, CAST(row_number() OVER (PARTITION BY {listed(keys, 'm.')} ORDER BY m.start) - 1 AS INTEGER) AS seq,
        m.type, substring(s.text, m.start + 1, m."end" - m.start) AS value, m.start, m."end"
      FROM merged m JOIN {source} s ON {' AND '.join(f'm.{x} = s.{x}' for x in keys)})"""


def numbered(
    keys: Sequence[str], label: str = "printf('[%s_%02d]', type, n)", source: str = "", group: Sequence[str] = ()
) -> str:
    """CTE ``labelled``: every detection with its token; equal values of a text share a number.

    With ``source``, numbers start behind the tokens its texts hold.  ``group`` names those of the keys (which then are
    a conversation and its turns) over which numbers run.
    """
    k, g = listed(keys), listed(group or keys)
    place = "turn * 1000000 + seq" if group else "seq"
    if not source:
        source_cte, more, join = "", "", ""
    else:
        pattern = quote(r"\[([^\[\]]+)_([0-9]{2,9})\]")
        source_cte = (
            f"tokens_held AS (SELECT {g}, unnest(regexp_extract_all(text, {pattern}, 1)) AS type, "
            f"CAST(unnest(regexp_extract_all(text, {pattern}, 2)) AS BIGINT) AS held_n FROM {source}), "
            f"held_last AS (SELECT {g}, type, max(held_n) AS largest FROM tokens_held GROUP BY ALL), "
        )
        more, join = " + coalesce(largest, 0)", f" LEFT JOIN held_last USING ({g}, type)"
    texts = f"SELECT counted.*, text FROM counted JOIN (SELECT {k}, text FROM {source}) AS texts USING ({k})" if source else "SELECT *, '' AS text FROM counted"
    return f"""{source_cte}firsts AS (SELECT *, min({place}) OVER (PARTITION BY {g}, type, value) AS first_seq FROM dets),
    counted AS (SELECT firsts.*, dense_rank() OVER (PARTITION BY {g}, type ORDER BY first_seq){more} AS n FROM firsts{join}),
    labelled AS (SELECT * EXCLUDE (text), {label} AS token FROM ({texts}))"""


def rewritten(source: str, keys: Sequence[str]) -> str:
    """CTE ``rewritten``: the text with its labels, for every text of the source."""
    k = listed(keys)
    on = " AND ".join(f"s.{x} = r.{x}" for x in keys)
    return f"""pieces AS (SELECT l.*, s.text, coalesce(lag(l."end") OVER (PARTITION BY {listed(keys, 'l.')} ORDER BY l.seq), 0) AS cursor
      FROM labelled l JOIN {source} s ON {' AND '.join(f'l.{x} = s.{x}' for x in keys)}),
    joined AS (SELECT {k}, count(*) AS n_spans, count(DISTINCT token || chr(1) || value) AS n_values,
        string_agg(substring(text, cursor + 1, greatest(start - cursor, 0)) || token, '' ORDER BY seq)
        || substring(first(text), CAST(arg_max("end", seq) AS INTEGER) + 1) AS sanitized
      FROM pieces GROUP BY {k}),
    rewritten AS (SELECT s.*, coalesce(r.sanitized, s.text) AS sanitized, coalesce(r.n_spans, 0) AS n_spans,
        coalesce(r.n_values, 0) AS n_values
      FROM {source} s LEFT JOIN joined r ON {on})"""


def hint_hits(source: str, keys: Sequence[str], rules: Sequence[Rule] = HINTS) -> str:
    """CTE ``hits``: indirect identifiers, numbered by rule and position."""
    k = listed(keys)
    return f"""{matches(source, keys, rules, 'hint_matches')},
    hits AS (SELECT {k}, CAST(row_number() OVER (PARTITION BY {k} ORDER BY ord, i) - 1 AS INTEGER) AS seq,
      type, value AS "match", reason, start AS "index" FROM hint_matches)"""


def fake_label(keys: Sequence[str], seed: int, mode: str) -> str:
    """SQL for the fake value of a detection; see ``operators.synthesize``."""
    from maskwright.operators.synthesize import (
        AREA_CODES, CITIES, EMAIL_DOMAINS, FIRST_NAMES, LAST_NAMES, ORGANIZATIONS, SECOND, STEP,
    )

    key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    h = f"CAST('0x' || substr(md5('{seed}|' || {key} || '|' || type), 1, 8) AS BIGINT)"

    def words(ws: Sequence[str], index: str) -> str:
        return f"[{', '.join(quote(w) for w in ws)}][CAST(({index}) AS INTEGER) + 1]"

    def part(x: str, below: int, size: int) -> str:
        return f"(({x}) // {below} % {size})"

    x = "x"
    values = {
        "EMAIL": (99000, f"lower({words(FIRST_NAMES, part(x, 1, 20))}) || CAST({part(x, 20, 990)} + 10 AS VARCHAR) || '@' || {words(EMAIL_DOMAINS, part(x, 19800, 5))}"),
        "PHONE": (50000000, f"printf('(%s) %03d-%04d', {words(AREA_CODES, part(x, 1, 5))}, {part(x, 5, 1000)}, {part(x, 5000, 10000)})"),
        "SSN": (648000000, f"printf('%03d-%02d-%04d', {part(x, 1, 800)} + 100, {part(x, 800, 90)} + 10, {part(x, 72000, 9000)} + 1000)"),
        "IP_ADDRESS": (254, "'192.0.2.' || CAST(x + 1 AS VARCHAR)"),
        "IP_ADDRESS_V6": (9999, "'2001:db8::' || lower(to_hex(x + 1))"),
        "IBAN": (8100000000, f"printf('GB%02dTEST%08d', {part(x, 1, 90)} + 10, {part(x, 90, 90000000)} + 10000000)"),
        "PASSPORT": (9000000, "printf('X%07d', x + 1000000)"),
        "PERSON": (400, f"{words(FIRST_NAMES, part(x, 1, 20))} || ' ' || {words(LAST_NAMES, part(x, 20, 20))}"),
        "ORGANIZATION": (5, words(ORGANIZATIONS, x)),
        "LOCATION": (5, words(CITIES, x)),
        "DATE_OF_BIRTH": (868, f"printf('01/%02d/%d', {part(x, 1, 28)} + 1, {part(x, 28, 31)} + 1970)"),
    }
    cases = []
    for kind, (size, sql) in values.items():
        index = f"(({h} + (n - 1) * {STEP}) % {size})"
        value = re.sub(r"\bx\b", lambda _: index, sql)
        suffix = f" || CASE WHEN n - 1 < {size} THEN '' ELSE '#' || CAST((n - 1) // {size} AS VARCHAR) END" if mode == "safe" else ""
        cases.append(f"WHEN {quote(kind)} THEN ({value}){suffix}")
    card = "'4111 1111 1111 1111'"
    if mode == "safe":
        body = "('41111111' || printf('%07d', n - 1))"
        check = (
            f"(SELECT CAST((10 - sum(CASE WHEN p % 2 = 1 THEN (2 * d) // 10 + (2 * d) % 10 ELSE d END) % 10) % 10 AS VARCHAR) "
            f"FROM (SELECT p, CAST(substr({body}, CAST(p AS INTEGER), 1) AS INTEGER) AS d FROM (SELECT unnest(range(1, 16)) AS p)))"
        )
        full = f"({body} || {check})"
        card = f"CASE WHEN n = 1 THEN {card} ELSE {' || chr(32) || '.join(f'substr({full}, {1 + 4 * i}, 4)' for i in range(4))} END"
    other = "'[' || type || ']'" if mode != "safe" else "CASE WHEN n = 1 THEN '[' || type || ']' ELSE printf('[%s#%d]', type, n - 1) END"
    usual = (
        f"CASE type {' '.join(cases)} WHEN 'CREDIT_CARD' THEN {card} "
        f"WHEN 'API_KEY' THEN 'sk-test' || substr(md5('{seed}|' || {key} || '|API_KEY|' || CAST(n - 1 AS VARCHAR)), 1, 20) "
        f"ELSE {other} END"
    )
    if mode != "safe":
        return usual
    second = re.sub(r"\bn\b", f"(n + {SECOND})", usual)
    fits = lambda f: f"NOT contains(text, {f}) AND (value = '' OR NOT contains({f}, value))"
    last = f"printf('[%s#%d#%s]', type, n, substr(md5('{seed}|' || {key} || '|' || text), 1, 8))"
    return f"CASE WHEN {fits(usual)} THEN {usual} WHEN {fits(second)} THEN {second} ELSE {last} END"


def response_hits(source: str) -> str:
    """CTE ``hits``: matches of the five response rules."""
    return matches(source, TURN_KEYS, [r for r in BUILT_IN if r.type in RESPONSE_TYPES], "hits")
