"""SQL (DuckDB) for the queries that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

_BITS = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT)"


def mixing_sql(temperature: float = 0.5, seed: int = 0) -> str:
    """Every document as often as the Poisson quantile of its hash says."""
    who = "coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))"
    return f"""
WITH sources AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {temperature}) AS share FROM documents GROUP BY source),
rates AS (SELECT source, share * (SELECT CAST(sum(n) AS DOUBLE) / sum(share) FROM sources) / n AS rate FROM sources),
terms AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rates),
logs AS (SELECT source, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate / k) END) OVER (PARTITION BY source ORDER BY k) AS l FROM terms),
sums AS (SELECT source, sum(exp(l)) OVER (PARTITION BY source ORDER BY k) AS c FROM logs),
drawn AS (SELECT *, {who} AS who, {_BITS.format(f"concat('{seed}:n:', {who})")} / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT d.*, (SELECT count(*) FROM sums WHERE sums.source IS NOT DISTINCT FROM d.source AND sums.c <= d.u) AS n_copies FROM drawn d),
copies AS (SELECT *, unnest(range(0, n_copies)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, {_BITS.format(f"concat('{seed}:o:', who, ':', copy)")} AS order_key FROM copies
"""


def url_sql(rules: Iterable[tuple[str, str, str]]) -> str:
    """The longest rule that fits, tried one after the other."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [
        (f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, action) for action, h, p in ordered
    ]
    rule = " ".join(f"WHEN {test} THEN '{key}'" for test, key, _ in fits)
    verdict = " ".join(f"WHEN {test} THEN '{action}'" for test, _, action in fits)
    return f"""
WITH tails AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM tails)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM parts
"""


_POLYNOMIAL = 0xEDB88320  # of CRC-32, as its bits are shifted
_ALL = 0xFFFFFFFF
_PIECE = 64  # bytes


def _crc_sql(hexa: str, bits: str, start: str) -> str:
    """The CRC register after some bits of a text in hexadecimal digits."""
    bit = f"(CAST('0x' || substr({hexa}, 1 + 2 * (i // 8), 2) AS BIGINT) >> (i % 8)) & 1"
    step = f"CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END"
    return f"list_reduce(list_transform(range({bits}), lambda i: {bit}), lambda c, b: {step}, CAST({start} AS BIGINT))"


def _crc_ctes() -> str:
    """CTE ``checked``: CRC-32 of every text.

    The register after two pieces follows from the registers of both, as all steps are linear over single bits: the first
    is moved on by as many zeros as the second has bits.  Texts are cut into pieces of 64 bytes, with zeros in front.
    """

    def moved(register: int) -> int:
        for _ in range(8 * _PIECE):
            register = register >> 1 ^ (_POLYNOMIAL if register & 1 else 0)
        return register

    terms = "CAST(0 AS BIGINT)"
    for j in range(32):
        terms = f"xor({terms}, ((s >> {j}) & 1) * {moved(1 << j)})"
    digits = 2 * _PIECE
    return f"""numbered AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
started AS (SELECT r, printf('%08X', {_ALL} - CAST('0x' || substr(h, 1, 8) AS BIGINT)) || substr(h, 9) AS h FROM numbered WHERE n >= 4),
filled AS (SELECT r, repeat('0', ({digits} - length(h) % {digits}) % {digits}) || h AS h FROM started),
cut AS (SELECT r, k, substr(h, 1 + {digits} * k, {digits}) AS p FROM (SELECT r, h, unnest(range(0, length(h) // {digits})) AS k FROM filled)),
pieces AS (SELECT r, list({_crc_sql('p', str(8 * _PIECE), '0')} ORDER BY k) AS registers FROM cut GROUP BY r),
whole AS (SELECT r, list_reduce(registers, lambda s, c: xor(c, {terms})) AS register FROM pieces),
checked AS (SELECT doc_id, n + 1 AS size, xor(coalesce(register, {_crc_sql('h', 'CASE WHEN n < 4 THEN 8 * n ELSE 0 END', str(_ALL))}), {_ALL}) AS text_crc32
  FROM numbered LEFT JOIN whole USING (r))"""


def _named(name: str, key: str) -> str:
    return f"concat('{name}:', {key})"


def _tree_sql(node: Mapping | float, path: str = "") -> str:
    """The shard of ``doc_id`` in a tree: the least waiting time decides at each level."""

    def weight(x: Mapping | float) -> float:
        return sum(map(weight, x.values())) if isinstance(x, Mapping) else x

    children = [(f"{path}/{name}", child, _tree_sql(child, f"{path}/{name}") if isinstance(child, Mapping) else str(name)) for name, child in node.items()]
    if len(children) == 1:
        return children[0][2]
    key = "coalesce(CAST(doc_id AS VARCHAR), '')"
    waits = [f"-ln(1.0 - {_BITS.format(_named(here, key))} / 4503599627370496.0) / {float(weight(child))}" for here, child, _ in children]
    cases = " ".join(f"WHEN {w} = least({', '.join(waits)}) THEN {then}" for w, (_, _, then) in zip(waits, children))
    return f"(CASE {cases} END)"


def shard_sql(tree: Mapping, grown: Mapping) -> str:
    place = f"{_BITS.format(_named('slot', "coalesce(CAST(doc_id AS VARCHAR), '')"))}"
    return f"""
WITH {_crc_ctes()},
placed AS (SELECT *, CAST({_tree_sql(tree)} AS INTEGER) AS shard, CAST({_tree_sql(grown)} AS INTEGER) AS grown_shard, {place} AS place FROM checked)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot FROM placed
"""


def manifest_sql(levels: int = 24) -> str:
    """A tree for each source and one over their roots, level by level; enough levels for ``3**levels`` rows of a source."""
    fields = "concat({})".format(
        ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}"))
    )
    bits = "8 * strlen(CAST(doc_id AS VARCHAR))"
    even = f"xor({_crc_sql('hex(encode(CAST(doc_id AS VARCHAR)))', bits, str(_ALL))}, {_ALL}) % 2 = 0"
    tampered = f"CASE WHEN doc_id IS NOT NULL AND {even} THEN replace(text, chr(10), '') ELSE text END"
    ctes = [
        f"hashed AS (SELECT doc_id, source, sha256({fields.format('text')}) AS leaf, sha256({fields.format(tampered)}) AS found FROM documents)",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed)""",
        "s0 AS (SELECT coalesce('1' || source, '') AS t, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM placed)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            ctes.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT t, i // 3 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, "
                f"(n + 2) // 3 AS n FROM {name}{k} GROUP BY t, i // 3, n)"
            )

    def way(name: str, start: str, place: str, carried: str) -> None:
        ctes.append(f"{name}w0 AS (SELECT {carried}, t, {place} AS i, CAST([] AS VARCHAR[]) AS l, CAST([] AS VARCHAR[]) AS r FROM {start})")
        for k in range(levels):
            ctes.append(
                f"{name}g{k} AS MATERIALIZED (SELECT t, i // 3 AS p, n, list(h ORDER BY i) AS run FROM {name}{k} GROUP BY t, i // 3, n)"
            )
            left, right = "array_to_string(run[:w.i % 3], '')", "array_to_string(run[w.i % 3 + 2:], '')"
            ctes.append(
                f"{name}w{k + 1} AS MATERIALIZED (SELECT {', '.join('w.' + c.strip() for c in carried.split(','))}, w.t, w.i // 3 AS i, "
                f"CASE WHEN n > 1 THEN list_append(w.l, {left}) ELSE w.l END AS l, CASE WHEN n > 1 THEN list_append(w.r, {right}) ELSE w.r END AS r "
                f"FROM {name}w{k} w JOIN {name}g{k} g ON w.t = g.t AND w.i // 3 = g.p)"
            )

    climb("s")
    ctes.append(f"subroots AS (SELECT t, h FROM s{levels})")
    ctes.append("r0 AS (SELECT 0 AS t, row_number() OVER (ORDER BY encode(t)) - 1 AS i, h, count(*) OVER () AS n FROM subroots)")
    ctes.append("grouped AS (SELECT 0 AS t, t AS name, h AS subroot, row_number() OVER (ORDER BY encode(t)) - 1 AS i FROM subroots)")
    climb("r")
    way("s", "(SELECT *, coalesce('1' || source, '') AS t FROM placed)", "i", "doc_id, leaf, found")
    way("r", "grouped", "i", "name, subroot")
    ctes.append(
        f"paths AS (SELECT doc_id, leaf, found, subroot, list_concat(a.l, b.l) AS l, list_concat(a.r, b.r) AS r "
        f"FROM sw{levels} a JOIN rw{levels} b ON a.t = b.name)"
    )
    folded = "list_reduce(list_transform(range(1, len(l) + 1), lambda k: [l[k], r[k]]), lambda h, p: [sha256(p[1] || h[1] || p[2]), ''], [found, ''])[1]"
    proof = "sha256(array_to_string(list_transform(range(1, len(l) + 1), lambda k: l[k] || r[k]), ''))"
    return f"""
WITH {", ".join(ctes)}, folded AS (SELECT *, {folded} AS folded_root, {proof} AS proof_sha256 FROM paths)
SELECT doc_id, leaf, subroot, root.h AS root, proof_sha256, folded_root, folded_root = root.h AS verified FROM folded, (SELECT h FROM r{levels}) root
"""
