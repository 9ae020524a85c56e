"""Queries of sources, gates and the prompt pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import host_of
from maskwright.operators.recognise import recognise
from maskwright.operators.vault import restore, vault_rows
from maskwright.operators.gates import (
    classify_platform, drop_allowlisted, mark_allowlisted, non_blank, normalise_allowlist, snippet_scan, supported_host,
)
from maskwright.plans import oracle
from maskwright.plans.catalog import LINES_SQL, lines, pages, register
from maskwright.plans.detection import dictionary, entities_sql
from maskwright.plans.sanitize import sanitize
from maskwright.plans.seed import seeded_turns
from maskwright.policy import Policy
from maskwright.sources.tables import prompts_of, read_responses

TURN = list(oracle.TURN_KEYS)
_PROMPTS = f"{oracle.SEEDED}, prompts AS (SELECT * FROM seeded WHERE role = 'user' AND trim(text) <> '')"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
ALLOWED = "internal.example.com"


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts_of(seeded_turns(spark, sf))


def allowlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ALLOWED,)], "domain string")


register(
    "read_turns",
    lambda spark, sf: prompts(spark, sf).select(*TURN, "domain", "text"),
    f"WITH {_PROMPTS} SELECT conv_id, turn, domain, text FROM prompts",
)
register(
    "read_responses",
    lambda spark, sf: read_responses(
        seeded_turns(spark, sf).withColumn("text", F.concat(F.lit(" \n"), "text", F.lit("\t ")))
    ).select(*TURN, "text"),
    f"WITH {oracle.SEEDED} SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text "
    "FROM seeded WHERE role = 'assistant'",
)
register(
    "enabled_gate",
    lambda spark, sf: sanitize(prompts(spark, sf), Policy(enabled=False)).select(
        *TURN, "scanned", "sanitized", F.size("tokens").alias("tokens"), "pii_count"
    ),
    f"WITH {_PROMPTS} SELECT conv_id, turn, false AS scanned, text AS sanitized, CAST(0 AS INTEGER) AS tokens, "
    "CAST(0 AS INTEGER) AS pii_count FROM prompts",
)
register(
    "host",
    lambda spark, sf: pages(spark, sf).select("page_id", host_of(F.col("url")).alias("host")),
    f"SELECT page_id, {_HOST} AS host FROM pages",
)
register(
    "non_blank",
    lambda spark, sf: non_blank(lines(spark, sf)),
    f"WITH {LINES_SQL} SELECT doc_id, line, text FROM lines WHERE regexp_matches(text, '\\S')",
)


def _noisy_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select(
        F.when(F.contains("url", F.lit("?")), F.lit("  ")).otherwise(
            F.concat(F.lit(" "), F.upper(host_of(F.col("url"))), F.lit("\n "))
        ).alias("domain")
    )


register(
    "allowlist_norm",
    lambda spark, sf: normalise_allowlist(_noisy_hosts(spark, sf)),
    f"SELECT DISTINCT {_HOST} AS domain FROM pages WHERE NOT contains(url, '?') AND {_HOST} <> ''",
)
register(
    "allowlist_gate",
    lambda spark, sf: drop_allowlisted(prompts(spark, sf), allowlist(spark)).select(*TURN, "domain"),
    f"WITH {_PROMPTS} SELECT conv_id, turn, domain FROM prompts WHERE NOT contains(domain, '{ALLOWED}')",
)


def _allowlist_pages(spark: SparkSession, sf: str) -> DataFrame:
    """An allowlist that grows with the data: the hosts of all pages with a query string, without their first label."""
    hosts = pages(spark, sf).withColumn("domain", host_of(F.col("url")))
    listed = normalise_allowlist(
        hosts.where(F.contains("url", F.lit("?"))).select(F.regexp_replace("domain", r"^[^.]*\.", "").alias("domain"))
    )
    return mark_allowlisted(hosts, listed).select("page_id", "allowlisted")


register(
    "allowlist_pages",
    _allowlist_pages,
    f"WITH hosts AS (SELECT page_id, url, {_HOST} AS host FROM pages), "
    "listed AS (SELECT DISTINCT regexp_replace(host, '^[^.]*\\.', '') AS domain FROM hosts WHERE contains(url, '?')) "
    "SELECT page_id, EXISTS (SELECT 1 FROM listed WHERE domain <> '' AND contains(host, domain)) AS allowlisted FROM hosts",
)
# Hosts with a label in front of some pages, and all of a second kind: more entries than pages.
_LONG_LIST = (
    "SELECT concat('p', page_id % 40, '.', host) AS domain FROM {hosts} WHERE page_id % 3 <> 0 "
    "UNION SELECT concat('x', page_id, '.') FROM {hosts} UNION SELECT concat(page_id, '.', host) FROM {hosts}"
)


def _long_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    hosts = pages(spark, sf).select("page_id", host_of(F.col("url")).alias("host"))
    listed = normalise_allowlist(spark.sql(_LONG_LIST, hosts=hosts))
    asked = hosts.withColumn("domain", F.concat(F.lit("www.p"), F.col("page_id") % 47, F.lit("."), "host"))
    return mark_allowlisted(asked, listed).select("page_id", "allowlisted")


register(
    "allowlist_long",
    _long_allowlist,
    f"WITH hosts AS (SELECT page_id, {_HOST} AS host FROM pages), listed AS ({_LONG_LIST.format(hosts='hosts')}) "
    "SELECT page_id, EXISTS (SELECT 1 FROM listed WHERE contains(concat('www.p', page_id % 47, '.', host), domain)) AS allowlisted "
    "FROM hosts",
)


def _host_forms(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_HOST_FORMS, pages=pages(spark, sf)).select("page_id", host_of(F.col("url")).alias("host"))


# Urls with a user part, a port, an underscore, and characters behind the host that strict parsers refuse.
_HOST_FORMS = (
    "SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, '://', '://us er:p@ss@') WHEN 1 THEN concat(url, '|a b') "
    "WHEN 2 THEN replace(url, '://', '://A_b.') WHEN 3 THEN replace(url, '.example', '.EXAMPLE') "
    "WHEN 4 THEN replace(replace(url, '.net/', '.net:8080/'), '.org/', '.org:/') ELSE replace(url, '://', ':/') END AS url FROM {pages}"
)
register(
    "host_forms",
    _host_forms,
    f"SELECT page_id, CASE page_id % 6 WHEN 2 THEN 'a_b.' || {_HOST} WHEN 5 THEN '' ELSE {_HOST} END AS host FROM pages",
)
register(
    "platform",
    lambda spark, sf: seeded_turns(spark, sf).select(*TURN, classify_platform(F.col("domain")).alias("platform")),
    f"WITH {oracle.SEEDED} SELECT conv_id, turn, CASE WHEN contains(domain, 'claude.ai') THEN 'claude' "
    "WHEN contains(domain, 'chat.openai.com') THEN 'chatgpt' WHEN contains(domain, 'gemini.google.com') THEN 'gemini' END AS platform "
    "FROM seeded",
)


def _supported(spark: SparkSession, sf: str) -> DataFrame:
    urls = seeded_turns(spark, sf).select(F.concat(F.lit("https://"), "domain", F.lit("/c/"), "conv_id").alias("url"))
    both = urls.unionByName(pages(spark, sf).select("url"))
    return both.groupBy(supported_host(F.col("url")).alias("supported")).agg(F.count("*").alias("n"))


register(
    "supported_host",
    _supported,
    f"WITH {oracle.SEEDED}, urls AS (SELECT 'https://' || domain || '/c/' || CAST(conv_id AS VARCHAR) AS url FROM seeded "
    "UNION ALL SELECT url FROM pages) SELECT regexp_matches(url, 'claude\\.ai|chat\\.openai\\.com|gemini\\.google\\.com') AS supported, "
    "count(*) AS n FROM urls GROUP BY 1",
)


def _snippets(spark: SparkSession, sf: str) -> DataFrame:
    found = snippet_scan(lines(spark, sf))
    return found.select("doc_id", "line", "pii_count", F.array_join("pii_types", ",").alias("pii_types"))


register(
    "snippet_scan",
    _snippets,
    f"WITH {LINES_SQL}, long_lines AS (SELECT * FROM lines WHERE length(text) >= 6), "
    f"{oracle.detections('long_lines', ('doc_id', 'line'))}, "
    "firsts AS (SELECT doc_id, line, type, min(seq) AS seq, count(*) AS n FROM dets GROUP BY ALL) "
    "SELECT doc_id, line, CAST(sum(n) AS INTEGER) AS pii_count, string_agg(type, ',' ORDER BY seq) AS pii_types "
    "FROM firsts GROUP BY doc_id, line",
)


def _sanitize(mode: str, with_entities: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        done = sanitize(
            prompts(spark, sf),
            allowlist=allowlist(spark),
            entities=dictionary(spark, sf) if with_entities else None,
            mode=mode,
        )
        return done.select(
            *TURN, "scanned", "sanitized", F.col("pii_count").cast("long").alias("pii_count"),
            F.size("semantic_hits").cast("long").alias("hints"),
        )

    return run


def scanned_sql(spans, count: str, numbers: str = oracle.numbered(oracle.TURN_KEYS)) -> str:
    """CTEs ending in ``rewritten``: every prompt, redacted unless its host is allowlisted."""
    return (
        f"{_PROMPTS}, open AS (SELECT * FROM prompts WHERE NOT contains(domain, '{ALLOWED}')), "
        f"{spans('open', oracle.TURN_KEYS)}, {numbers}, {oracle.rewritten('prompts', oracle.TURN_KEYS)}, "
        f"{oracle.hint_hits('open', oracle.TURN_KEYS)}, hint_count AS (SELECT conv_id, turn, count(*) AS hints FROM hits GROUP BY ALL), "
        f"sanitized AS (SELECT r.conv_id, r.turn, r.ts, r.domain, r.text, NOT contains(r.domain, '{ALLOWED}') AS scanned, r.sanitized, "
        f"r.{count} AS pii_count, coalesce(h.hints, 0) AS hints FROM rewritten r LEFT JOIN hint_count h "
        "ON r.conv_id = h.conv_id AND r.turn = h.turn)"
    )


_RESULT = "SELECT conv_id, turn, scanned, sanitized, pii_count, hints FROM sanitized"
SANITIZED_REF = scanned_sql(oracle.detections, "n_spans")
_BY_CONVERSATION = oracle.numbered(oracle.TURN_KEYS, source="prompts", group=("conv_id",))
SANITIZED_SAFE = scanned_sql(oracle.covers, "n_values", _BY_CONVERSATION)
# On a stream the scan keeps no state: numbers start again in every text.
SANITIZED_STREAM = scanned_sql(oracle.covers, "n_values", oracle.numbered(oracle.TURN_KEYS, source="prompts"))
register("sanitize_ref", _sanitize("reference", False), f"WITH {SANITIZED_REF} {_RESULT}")
register("sanitize", _sanitize("safe", False), f"WITH {SANITIZED_SAFE} {_RESULT}")


def _covers_with_entities(source: str, keys) -> str:
    k = oracle.listed(keys)
    on = " AND ".join(f"t.{x} = s.{x}" for x in keys)
    word = oracle.quote(r"[\p{L}\p{N}_]")
    return (
        f"{entities_sql(source, keys)}, cut AS (SELECT {oracle.listed(keys, 't.')}, t.type, t.value, s.text, string_split(s.text, t.value) AS g "
        f"FROM tagged t JOIN {source} s ON {on}), "
        f"places AS (SELECT *, unnest(range(1, len(g))) AS i FROM cut), "
        f"spots_all AS (SELECT {k}, text, type, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(value) AS INTEGER) AS start, "
        f"CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + i * length(value) AS INTEGER) AS \"end\" FROM places), "
        f"spots AS (SELECT {k}, type, start, \"end\" FROM spots_all WHERE NOT regexp_matches(substring(text, start, CASE WHEN start = 0 THEN 0 ELSE 1 END), {word}) "
        f"AND NOT regexp_matches(substring(text, \"end\" + 1, 1), {word})), "
        f"{oracle.covers(source, keys, also='spots')}"
    )


register(
    "sanitize_with_entities",
    _sanitize("safe", True),
    f"WITH {scanned_sql(_covers_with_entities, 'n_values', _BY_CONVERSATION)} {_RESULT}",
)


def _with_recogniser(spark: SparkSession, sf: str) -> DataFrame:
    """Another recogniser's hits come in a column: here it takes the first word of every prompt for a person."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    start = (F.position(word, F.col("text")) - 1).cast("int")
    hit = F.struct(
        F.lit("PERSON").alias("type"), word.alias("value"), start.alias("start"), (start + F.length(word)).alias("end"),
        F.lit(0.9).alias("confidence"), F.lit("other").alias("source"),
    )
    turns = prompts(spark, sf).withColumn("mine", F.when(word != "", F.array(hit)))
    done = sanitize(turns, allowlist=allowlist(spark), entities_col="mine")
    return done.select(*TURN, "scanned", "sanitized", F.col("pii_count").cast("long").alias("pii_count"))


def _covers_with_first_word(source: str, keys) -> str:
    k = oracle.listed(keys)
    return (
        f"first_words AS (SELECT {k}, text, regexp_extract(text, '[A-Za-z]+') AS w FROM {source}), "
        f"spots AS (SELECT {k}, 'PERSON' AS type, CAST(strpos(text, w) - 1 AS INTEGER) AS start, "
        f"CAST(strpos(text, w) - 1 + length(w) AS INTEGER) AS \"end\" FROM first_words WHERE w <> ''), "
        f"{oracle.covers(source, keys, also='spots')}"
    )


register(
    "sanitize_with_recogniser",
    _with_recogniser,
    f"WITH {scanned_sql(_covers_with_first_word, 'n_values', _BY_CONVERSATION)} SELECT conv_id, turn, scanned, sanitized, pii_count FROM sanitized",
)


def _first_words():
    """A recogniser that takes the first word of a text for a person, and also gives a span that is wrong."""
    import re

    def tag(texts):
        first = [re.search("[A-Za-z]+", t) for t in texts]
        return [[] if m is None else [("PERSON", *m.span(), m.group(), 0.9), ("PERSON", m.start() + 1, m.end() + 1, m.group(), 0.9)] for m in first]

    return tag


def _with_tagger(spark: SparkSession, sf: str) -> DataFrame:
    """A recogniser that runs in the job, and whose wrong spans are counted instead of taken."""
    turns = recognise(prompts(spark, sf), _first_words)
    done = sanitize(turns, allowlist=allowlist(spark), entities_col="recognised")
    return done.select(*TURN, "scanned", "sanitized", F.col("pii_count").cast("long").alias("pii_count"), F.col("rejected").cast("long").alias("rejected"))


register(
    "sanitize_with_tagger",
    _with_tagger,
    f"WITH {scanned_sql(_covers_with_first_word, 'n_values', _BY_CONVERSATION)} SELECT s.conv_id, s.turn, scanned, sanitized, pii_count, "
    "CAST(p.text <> regexp_replace(p.text, '[A-Za-z]', '') AS BIGINT) AS rejected FROM sanitized s JOIN prompts p ON p.conv_id = s.conv_id AND p.turn = s.turn",
)


def _restored(synthetic: bool):
    """Every prompt is sanitized, and its result sent back at the end of the conversation: all of it must come back."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        done = sanitize(prompts(spark, sf), Policy(synthetic_mode=synthetic), allowlist=allowlist(spark))
        quoted = done.select("conv_id", (F.col("turn") + 1_000_000).alias("turn"), F.col("sanitized").alias("text"))
        back = restore(quoted, vault_rows(done), synthetic=synthetic)
        return back.select("conv_id", (F.col("turn") - 1_000_000).alias("turn"), "restored")

    return run


for _name, _synthetic in (("sanitize_restore", False), ("synthesize_restore", True)):
    register(_name, _restored(_synthetic), f"WITH {_PROMPTS} SELECT conv_id, turn, text AS restored FROM prompts")
