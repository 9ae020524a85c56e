"""Queries of the detection jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.detect import detect, detect_type, explode_detections
from maskwright.operators.entities import entity_tag, merge_entities
from maskwright.operators.hints import hint_type, semantic_hits
from maskwright.operators.review import findings
from maskwright.plans import oracle
from maskwright.plans.catalog import corpus, register
from maskwright.plans.seed import seeded_turns
from maskwright.policy import Policy
from maskwright.rules import BUILT_IN, HINTS, Rule, active_rules
from maskwright.sources.config import normalise_rules, rules_from

KEYS = list(oracle.CORPUS_KEYS)
TURN = list(oracle.TURN_KEYS)
_COLUMNS = 'src, id, sub, seq, type, value, start, "end", confidence, source'


def _detections_sql(rules: Sequence[Rule]) -> str:
    return (
        f"WITH {oracle.CORPUS}, {oracle.detections('corpus', oracle.CORPUS_KEYS, rules)} "
        f"SELECT {_COLUMNS} FROM dets"
    )


def _register_detector(rule: Rule) -> None:
    register(
        f"detect_{rule.type.lower()}",
        lambda spark, sf: explode_detections(detect_type(corpus(spark, sf), rule.type), KEYS),
        _detections_sql([rule]),
    )


def _register_policy(name: str, policy: Policy) -> None:
    register(
        name,
        lambda spark, sf: explode_detections(detect(corpus(spark, sf), policy=policy), KEYS),
        _detections_sql(active_rules(policy)),
    )


def _register_hint(rule: Rule) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = hint_type(corpus(spark, sf), rule.type)
        rows = found.select(*KEYS, F.posexplode_outer("semantic_hits").alias("seq", "h"))
        return rows.where(F.col("h").isNotNull()).select(*KEYS, "seq", "h.*")

    register(
        f"hint_{rule.type.split('_')[0].lower()}",
        run,
        f"WITH {oracle.CORPUS}, {oracle.hint_hits('corpus', oracle.CORPUS_KEYS, [rule])} "
        'SELECT src, id, sub, seq, type, "match", reason, "index" FROM hits',
    )


for _rule in BUILT_IN:
    _register_detector(_rule)
for _rule in HINTS:
    _register_hint(_rule)
_register_policy("detect_all", Policy())
_register_policy("sensitivity_light", Policy(sensitivity="light"))
_register_policy("detector_toggle", Policy(detectors={"PHONE": False, "SSN": False, "IBAN": True}))
_register_policy("profile_work", Policy().with_profile("work"))
_register_policy("profile_personal", Policy().with_profile("personal"))
_register_policy("profile_medical", Policy().with_profile("medical"))

# A rule table as users write it: to be trimmed, upper-cased and completed.
CUSTOM_ROWS = (
    (" ticket ", r"\b[A-Z][a-z]{2}\d{3,}\b", "medium"),
    ("greeting", r" \bÉt[a-z]+\b|\bOf[a-z]{3}\b ", None),
    ("email", r"\buser\d+\b", ""),
    ("", r"\d+", "high"),
    ("nopattern", "  ", "high"),
    # What only the browser dialect says this way: a name with "_", braces that count nothing, matches of nothing.
    ("named", r"(?<first_name>\bOn[a-z]{4}\b)|{id}", "high"),
    ("optional", r"(?:\bThe[a-z]{5}\b)?", "medium"),
    ("ahead", r"(?=q)", "high"),
)
CUSTOM_RULES = (
    Rule("TICKET", r"\b[A-Z][a-z]{2}\d{3,}\b", "medium", custom=True),
    Rule("GREETING", r"\bÉt[a-z]+\b|\bOf[a-z]{3}\b", custom=True),
    Rule("EMAIL", r"\buser\d+\b", custom=True),
    Rule("NAMED", r"\bOn[a-z]{4}\b", custom=True),
    Rule("OPTIONAL", r"\bThe[a-z]{5}\b", "medium", custom=True),
)


def _detect_custom(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(*row, i) for i, row in reversed(list(enumerate(CUSTOM_ROWS)))]
    table = spark.createDataFrame(rows, "type string, pattern string, confidence string, ord long")
    return explode_detections(detect(corpus(spark, sf), custom=rules_from(table)), KEYS)


register("detect_custom", _detect_custom, _detections_sql((*BUILT_IN, *CUSTOM_RULES)))

# Rule rows made of the items of the benchmark table, with gaps to be cleaned up.
_RAW_RULES = (
    "SELECT CASE WHEN item_id % 5 = 0 THEN '  ' ELSE concat(' type_', cast(item_id as {text}), ' ') END AS type, "
    "CASE WHEN item_id % 7 = 0 THEN NULL ELSE concat(' ', text, ' ') END AS pattern, "
    "CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN 'medium' ELSE '' END AS confidence FROM {source}"
)


def _custom_rule_rows(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return normalise_rules(spark.sql(_RAW_RULES.replace("{text}", "string"), source=items))


register(
    "load_custom_rules",
    _custom_rule_rows,
    "SELECT upper(trim(type)) AS type, trim(pattern, chr(32) || chr(10)) AS pattern, "
    "coalesce(nullif(confidence, ''), 'high') AS confidence "
    f"FROM ({_RAW_RULES.format(text='varchar', source='benchmark')}) "
    "WHERE trim(type) <> '' AND trim(pattern, chr(32) || chr(10)) <> ''",
)


def _confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = explode_detections(detect(corpus(spark, sf)), KEYS)
    return rows.groupBy("type", "confidence").agg(F.count("*").alias("hits"))


register(
    "confidence_score",
    _confidence,
    f"WITH {oracle.CORPUS}, {oracle.detections('corpus', oracle.CORPUS_KEYS)} "
    "SELECT type, confidence, count(*) AS hits FROM dets GROUP BY type, confidence",
)


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    turns = seeded_turns(spark, sf).where(F.col("role") == "user")
    return findings(semantic_hits(detect(turns)), TURN)


register(
    "findings",
    _findings,
    f"WITH {oracle.SEEDED}, prompts AS (SELECT * FROM seeded WHERE role = 'user'), "
    f"{oracle.detections('prompts', oracle.TURN_KEYS)}, {oracle.hint_hits('prompts', oracle.TURN_KEYS)} "
    "SELECT conv_id, turn, 'detection' AS kind, seq, type, "
    "CASE WHEN length(value) > 40 THEN left(value, 40) || '…' ELSE value END AS value, CAST(NULL AS VARCHAR) AS reason FROM dets "
    'UNION ALL SELECT conv_id, turn, \'hint\', seq, type, "match", reason FROM hits',
)

# A dictionary made of the first words of the benchmark items, which occur in
# documents that quote them, and two places named in seeded prompts.
_DICTIONARY = (
    "SELECT DISTINCT name, label FROM (SELECT regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+', 0) AS name, "
    "CASE item_id % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'LOC' WHEN 3 THEN 'GPE' ELSE 'DATE' END AS label "
    "FROM {items} UNION ALL SELECT 'Austin', 'GPE' UNION ALL SELECT 'Ohio', 'LOC' UNION ALL SELECT 'My', 'ORG') AS names "
    "WHERE name <> ''"
)


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_DICTIONARY, items=spark.read.parquet(f"{sf}/benchmark.parquet"))


# Every two words that stand side by side in a benchmark item.
_PAIRS = (
    "SELECT DISTINCT concat({one}, ' ', {two}) AS name, CASE length({one}) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'GPE' END AS label "
    "FROM {source}"
)


def word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    words = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("regexp_extract_all(text, '[A-Za-z]+', 0) AS w")
    pairs = words.selectExpr("w", "explode(sequence(1, greatest(size(w) - 1, 1))) AS i").where("i < size(w)")
    return spark.sql(_PAIRS.format(one="w[i - 1]", two="w[i]", source="{pairs}"), pairs=pairs)


_PAIRS_SQL = _PAIRS.format(
    one="w[i]", two="w[i + 1]",
    source="(SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)) AS p",
)


def entities_sql(source: str, keys: Sequence[str], dictionary_sql: str = _DICTIONARY.format(items="benchmark")) -> str:
    """CTE ``tagged`` for the balanced policy."""
    k = oracle.listed(keys)
    return f"""names AS (SELECT name AS value, array_to_string(regexp_extract_all(name, '[\\p{{L}}\\p{{N}}_]+'), ' ') AS "key",
        CASE label WHEN 'PERSON' THEN 'PERSON' WHEN 'ORG' THEN 'ORGANIZATION' ELSE 'LOCATION' END AS type
      FROM ({dictionary_sql}) WHERE label IN ('PERSON', 'ORG', 'LOC', 'GPE') AND length(name) > 3),
    padded AS (SELECT {k}, text, ' ' || array_to_string(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' ' AS flat
      FROM {source}),
    tagged AS (SELECT DISTINCT {k}, type, value, CAST(strpos(text, value) - 1 AS INTEGER) AS start
      FROM padded JOIN names ON contains(flat, ' ' || "key" || ' ') WHERE strpos(text, value) > 0)"""


def _entity_tag(spark: SparkSession, sf: str) -> DataFrame:
    tagged = entity_tag(corpus(spark, sf), dictionary(spark, sf))
    return explode_detections(tagged, KEYS, "entities").drop("seq")


register(
    "entity_tag",
    _entity_tag,
    f"WITH {oracle.CORPUS}, {entities_sql('corpus', oracle.CORPUS_KEYS)} "
    "SELECT src, id, sub, type, value, start, CAST(start + length(value) AS INTEGER) AS \"end\", "
    "CAST(0.82 AS DOUBLE) AS confidence, 'ner' AS source FROM tagged",
)


register(
    "entity_tag_long",
    lambda spark, sf: explode_detections(entity_tag(corpus(spark, sf), word_pairs(spark, sf)), KEYS, "entities").drop("seq"),
    f"WITH {oracle.CORPUS}, {entities_sql('corpus', oracle.CORPUS_KEYS, _PAIRS_SQL)} "
    "SELECT src, id, sub, type, value, start, CAST(start + length(value) AS INTEGER) AS \"end\", "
    "CAST(0.82 AS DOUBLE) AS confidence, 'ner' AS source FROM tagged",
)


def _merge_entities(spark: SparkSession, sf: str) -> DataFrame:
    tagged = entity_tag(detect(corpus(spark, sf)), dictionary(spark, sf))
    merged = tagged.withColumn("merged", merge_entities(F.col("detections"), F.col("entities")))
    rows = explode_detections(merged, KEYS, "merged")
    return rows.select(*KEYS, "seq", "type", "value", "start", "source")


register(
    "merge_entities",
    _merge_entities,
    f"WITH {oracle.CORPUS}, {oracle.detections('corpus', oracle.CORPUS_KEYS)}, {entities_sql('corpus', oracle.CORPUS_KEYS)}, "
    "merged AS (SELECT src, id, sub, type, value, start, source, 0 AS part, seq AS pos FROM dets UNION ALL "
    "SELECT src, id, sub, type, value, start, 'ner', 1, row_number() OVER (PARTITION BY src, id, sub ORDER BY start, type, value) "
    "FROM tagged t WHERE NOT EXISTS (SELECT 1 FROM dets d WHERE d.src = t.src AND d.id = t.id AND d.sub = t.sub "
    "AND d.type = t.type AND d.value = t.value)) "
    "SELECT src, id, sub, CAST(row_number() OVER (PARTITION BY src, id, sub ORDER BY start, part, pos) - 1 AS INTEGER) AS seq, "
    "type, value, start, source FROM merged",
)
