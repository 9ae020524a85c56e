"""Hints, entities, sources, audit and fingerprints."""

import json
import re
import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from maskwright import session
from maskwright.functions.hashing import prompt_hash
from maskwright.functions.text import host_of, is_blank, preview, strip, utf16_length
from maskwright.operators import entities as ent
from maskwright.operators.audit import audit_entries, audit_json, audit_report, detector_quality, recent, retained, session_stats
from maskwright.dialect import InvalidPattern, translate
from maskwright.operators.detect import detect
from maskwright.operators.gates import classify_platform, supported_host
from maskwright.operators.hints import semantic_hits
from maskwright.operators.redact import redact
from maskwright.operators.responses import pii_warnings, scan_with_map
from maskwright.operators.review import findings, high_risk_flag, high_risk_types
from maskwright.plans.sanitize import sanitize
from maskwright.policy import Policy
from maskwright.rules import Rule
from maskwright.session import work_dir
from maskwright.sources.config import load_allowlist, load_custom_rules, load_entities, rules_from
from maskwright.sources.tables import append_audit, export_audit_json, purge_audit, read_audit, read_token_vault, read_turns, write_token_vault

HINTS = {
    "FAMILY_RELATION": ["My daughter's school is nearby", "MY IN-LAW", "my  kids"],
    "WORK_RELATION": ["My boss told me", "my direct report", "my team member"],
    "LOCATION_HINT": ["I live downtown", "my flat is small", "I reside here"],
    "EMPLOYER_HINT": ["I work at a bank", "I'm employed by them", "my startup"],
    "SCHOOL_HINT": ["I study at a college", "my campus", "I go to class"],
    "ORIGIN_HINT": ["I'm from Ohio", "I was born in May", "I grew up in Bonn", "my hometown"],
    "MEDICAL_HINT": ["My doctor agrees", "I have been diagnosed", "I have a condition"],
}


@pytest.mark.parametrize("kind", HINTS)
def test_hints(texts, kind):
    for row in semantic_hits(texts(*HINTS[kind])).collect():
        assert kind in {h.type for h in row.semantic_hits}, row.text


def test_hint_fields_and_order(texts):
    (row,) = semantic_hits(texts("I live in Austin; my boss and my son know my boss")).collect()
    assert [(h.type, h.match, h["index"]) for h in row.semantic_hits] == [
        ("FAMILY_RELATION", "my son", 30), ("WORK_RELATION", "my boss", 18), ("WORK_RELATION", "my boss", 42),
        ("LOCATION_HINT", "I live", 0),
    ]
    assert row.semantic_hits[0].reason.startswith("Mentions a family member")
    rows = semantic_hits(texts("The weather is nice", None, "army boss", "thai live")).orderBy("id").collect()
    assert [r.semantic_hits for r in rows] == [[], None, [], []]
    assert semantic_hits(texts("my boss"), policy=Policy(semantic_scrubbing=False)).first().semantic_hits == []


def test_white_space_of_the_browser(texts):
    nbsp = "\u00a0"
    assert semantic_hits(texts(f"my{nbsp}boss")).first().semantic_hits[0].type == "WORK_RELATION"
    row = texts(f"{nbsp} \t x y{nbsp}\n").select(strip(F.col("text")).alias("s")).first()
    assert row.s == "x y"
    blanks = texts("", f" {nbsp}\n", "x").orderBy("id").select(is_blank(F.col("text")).alias("b")).collect()
    assert [r.b for r in blanks] == [True, True, False]


NAMES = [
    ("New York", "GPE"), ("Ann", "PERSON"), ("Anna Lee", "PERSON"), ("Acme", "ORG"), ("Rhine", "LOC"), ("Monday", "DATE"),
    ("Bank of the Far East", "ORG"), ("AT&T", "ORG"),
]


@pytest.mark.parametrize("lookup", ent.LOOKUPS)
def test_entities(spark, texts, lookup):
    names = spark.createDataFrame(NAMES, "name string, label string")
    df = texts(
        "Anna Lee of Acme left New York; Acme stayed", "New\nYork", "Ann saw the Bank of the Far East", "Acmes", "", None,
        "AT&T Monday Rhine",
    )

    def tagged(policy, occurrences="first"):
        rows = ent.entity_tag(df, names, policy=policy, occurrences=occurrences, lookup=lookup).orderBy("id").collect()
        return [[(e.type, e.value, e.start) for e in r.entities or []] for r in rows]

    balanced = tagged(Policy())
    assert balanced[0] == [("PERSON", "Anna Lee", 0), ("ORGANIZATION", "Acme", 12), ("LOCATION", "New York", 22)]
    # Spelled differently: the words match, the name itself does not occur.
    assert balanced[1] == [] and balanced[3] == [] and balanced[4] == [] and balanced[5] == []
    assert balanced[2] == [("ORGANIZATION", "Bank of the Far East", 12)]
    assert balanced[6] == [("ORGANIZATION", "AT&T", 0), ("LOCATION", "Rhine", 12)]
    assert tagged(Policy(sensitivity="light")) == [[]] * 7
    assert ("PERSON", "Ann", 0) in tagged(Policy(sensitivity="strict"))[2]
    assert all(t != "LOCATION" for r in tagged(Policy(detectors={"LOCATION": False})) for t, _, _ in r)
    assert tagged(Policy(), "all")[0][-1] == ("ORGANIZATION", "Acme", 32)


@pytest.mark.parametrize("lookup", ent.LOOKUPS)
def test_what_a_text_holds_depends_on_the_text_alone(spark, lookup):
    names = spark.createDataFrame([(f"Name{i} z", "PERSON") for i in range(700)] + [("E\\E+ x", "ORG")], "name string, label string")
    rows = [(None, "Name1 z"), (None, None), (1, "no xName2 zx here, Name2 z!"), (1, "Name3 z"), (1, "Name3 z"), (2, "E\\E+ x, E\\E+ xx \x01")]
    df = spark.createDataFrame(rows, "conv_id long, text string")
    got = ent.entity_tag(df, names, occurrences="all", lookup=lookup).collect()
    assert sorted((str(r.conv_id), str(r.text), [(e.value, e.start) for e in r.entities]) for r in got) == sorted([
        ("None", "Name1 z", [("Name1 z", 0)]), ("None", "None", []), ("1", rows[2][1], [("Name2 z", 19)]),
        ("1", "Name3 z", [("Name3 z", 0)]), ("1", "Name3 z", [("Name3 z", 0)]), ("2", rows[5][1], [("E\\E+ x", 0)]),
    ])


def test_entity_confidence_and_merge(spark, texts):
    names = spark.createDataFrame([("Ann", "PERSON"), ("Acme", "ORG")], "name string, label string")
    row = ent.entity_tag(detect(texts("Ann a@b.com Acme")), names, policy=Policy(sensitivity="strict")).withColumn(
        "merged", ent.merge_entities(F.col("detections"), F.col("entities"))
    ).first()
    assert [(d.type, d.confidence, d.source) for d in row.merged] == [
        ("PERSON", 0.55, "ner"), ("EMAIL", 0.95, "regex"), ("ORGANIZATION", 0.82, "ner"),
    ]


def write_text(spark, name, *lines):
    path = work_dir(spark, name)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_custom_rules(spark):
    def load(*rows):
        return load_custom_rules(spark, write_text(spark, "rules", *[json.dumps(r) for r in rows]))

    rules = load(
        {"type": " ticket ", "pattern": " T-\\d+ "}, {"type": "", "pattern": "x"}, {"type": "x"},
        {"type": "low", "pattern": "lo+w", "confidence": "medium"},
    )
    assert [(r.type, r.pattern, r.confidence, r.custom) for r in rules] == [
        ("TICKET", "T-\\d+", "high", True), ("LOW", "lo+w", "medium", True),
    ]
    # One invalid pattern switches all of them off; a valid one that the JVM cannot run is an error.
    assert load({"type": "a", "pattern": "a"}, {"type": "b", "pattern": "(b"}) == []
    assert load({"type": "a", "pattern": "a"}, {"type": "b", "pattern": "a++"}) == []
    with pytest.raises(ValueError):
        load({"type": "a", "pattern": "a"}, {"type": "b", "pattern": r"\k<later>(?<later>a)"})
    assert [r.type for r in load({"type": "b", "pattern": "b", "ord": 2}, {"type": "c", "pattern": "c"}, {"type": "a", "pattern": "a", "ord": 1})] == ["A", "B", "C"]
    assert load_custom_rules(spark, "/nonexistent/rules.json") == []
    assert rules_from(spark.createDataFrame([], "type string, pattern string, confidence string")) == []


BROWSER_RULES = [
    (r"(?<first_name>Bob)", "x Bob Bobby", [("Bob", 2), ("Bob", 6)]), ("{id}", "a {id} {id}", [("{id}", 2), ("{id}", 7)]),
    ("a{,3}b", "aab a{,3}b", [("a{,3}b", 4)]), (r"[\b]x", "\bx bx", [("\bx", 0)]), (r"\p{L}", "Lp{L}", [("p{L}", 1)]),
    (r"\Ax", "yAx", [("Ax", 1)]), ("(?=q)", "aq q", []), ("x*", "axxbx", [("xx", 1), ("x", 4)]), (r"(a)\1|", "aa b aa", [("aa", 0), ("aa", 5)]),
    (r"\v|\cJ", "a\x0bb\nc", [("\x0b", 1), ("\n", 3)]), ("[a&&b]+", "a&b|c", [("a&b", 0)]), ("y*", "\U0001f600\U0001f600 yy\U0001f600y", [("yy", 3), ("y", 6)]), (r"\bé", "é aé", [("é", 3)]),
]


@pytest.mark.parametrize("pattern, text, want", BROWSER_RULES)
def test_browser_dialect(texts, pattern, text, want):
    found = detect(texts(text), policy=Policy().with_profile("none"), custom=[Rule("R", pattern, custom=True)], occurrences="all").first()
    assert [(d.value, d.start) for d in found.detections if d.type == "R"] == want


@pytest.mark.parametrize("pattern", ["(", "a)", "*a", "a++", "(?>a)", "(?i)a", "[a", "a{3,2}", "\\", "a**", "(?<1>x)", "(?<=a)*"])
def test_invalid_patterns(pattern):
    with pytest.raises(InvalidPattern):
        translate(pattern)


def test_allowlist_and_dictionary_files(spark):
    path = write_text(spark, "allow", '{"domain": " Intra.Example.org "}', '{"domain": "intra.example.org"}', '{"domain": " "}')
    assert [r.domain for r in load_allowlist(spark, path).collect()] == ["intra.example.org"]
    assert load_allowlist(spark, "/nonexistent/allow.json").count() == 0
    out = work_dir(spark, "names")
    spark.createDataFrame(NAMES, "name string, label string").write.parquet(out)
    assert load_entities(spark, out).count() == len(NAMES)


def test_hosts(spark):
    rows = spark.createDataFrame(
        [("https://Claude.AI/chat",), ("http://chat.openai.com:80/x",), ("https://x.gemini.google.com",), ("nonsense",), ("http://[bad",), (None,),
         ("https://a_b.Example.com/x",), ("https://a.example.com/x?q=a|b",), ("https://a.example.com/a b",), ("https://user:p@w@h.org:8080?x",),
         ("http://[2001:db8::1]:80/",), ("https://bücher.example/",), ("ftp:///x",)],
        "url string",
    ).select(host_of(F.col("url")).alias("h"), classify_platform(host_of(F.col("url"))).alias("p"), supported_host(F.col("url")).alias("s"))
    assert [(r.h, r.p) for r in rows.collect()][:6] == [
        ("claude.ai", "claude"), ("chat.openai.com", "chatgpt"), ("x.gemini.google.com", "gemini"), ("", None), ("", None), ("", None),
    ]
    assert [r.h for r in rows.collect()][6:] == ["a_b.example.com", "a.example.com", "a.example.com", "h.org", "[2001:db8::1]", "bücher.example", ""]
    assert [r.s for r in rows.collect()][1:4] == [True, True, False]


def plain_hash(text):
    h = 5381
    data = text.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = (h * 33 + data[i] + 256 * data[i + 1]) & 0xFFFFFFFF
    return f"{h:x}"


def test_fingerprints(texts):
    values = ["", "a", "é 😀", "x" * 4096, "yz" * 5000, None]
    rows = texts(*values).select("id", prompt_hash(F.col("text")).alias("h"), utf16_length(F.col("text")).alias("n")).orderBy("id").collect()
    assert [r.h for r in rows] == [plain_hash(v) if v is not None else None for v in values]
    assert [r.n for r in rows] == [0, 1, 4, 4096, 10000, None]


def test_the_log_is_purged_by_day(spark):
    path = work_dir(spark, "purge")
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    df = spark.createDataFrame([(d, d) for d in days], "day string, id string").withColumn("day", F.to_date("day"))
    append_audit(df, path)
    now = 1704067200000 + 4 * 86_400_000 + 3_600_000  # 5 January, 01:00
    assert purge_audit(spark, path, Policy(audit_retention_days=2), now) == days[:2]
    assert sorted(r.id for r in read_audit(spark, path).collect()) == days[2:]
    assert purge_audit(spark, path, Policy(audit_retention_days=2), now) == []


def test_work_folders(spark, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    table = session.staged(spark.range(3), "some")
    path = session._MADE[0]
    assert table.count() == 3 and Path(path.removeprefix("file:")).exists()
    session.clear_work(spark)
    assert not Path(path.removeprefix("file:")).exists() and session._MADE == []


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        conf = {}
        sparkContext = SimpleNamespace(master="spark://host:7077")

    with pytest.raises(ValueError):
        session.work_dir(Unset, "x")


def test_vault_folders(spark):
    path = work_dir(spark, "vault")
    rows = spark.range(300).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("[A_01]").alias("token"))
    write_token_vault(rows, path)
    some = read_token_vault(spark, path, [7, 9])
    assert sorted(r.conv_id for r in some.collect()) == [7, 9] and read_token_vault(spark, path).count() == 300
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", some._jdf.queryExecution().executedPlan().toString())


def test_many_matches_in_one_text_take_linear_time(texts):
    def seconds(n):
        df = texts(" ".join(f"u{i}@x.org" for i in range(n))).cache()
        df.count()
        job = redact(detect(df, occurrences="all")).select(F.size("tokens").alias("n"))
        best = []
        for _ in range(2):
            started = time.perf_counter()
            assert job.first().n == n
            best.append(time.perf_counter() - started)
        return min(best)

    assert seconds(160_000) <= 3 * seconds(80_000) + 1


def test_preview(texts):
    rows = texts("x" * 40, "x" * 41).orderBy("id").select(preview(F.col("text"), 40).alias("p")).collect()
    assert [r.p for r in rows] == ["x" * 40, "x" * 40 + "…"]


def test_high_risk_and_findings(texts):
    df = semantic_hits(detect(texts("a@b.com AB1234567 123-45-6789 my boss")))
    row = df.select(high_risk_flag(F.col("detections")).alias("f"), high_risk_types(F.col("detections")).alias("t")).first()
    assert row.f and row.t == ["IBAN", "PASSPORT", "SSN"]
    assert [r.kind for r in findings(df, ["id"]).collect()] == ["detection"] * 4 + ["hint"]


def test_response_warnings(texts, spark):
    clean = [
        "The deadline is next Friday at 5pm.", "Please review the document and reply.", "The server listens on port 8080.",
        "Revenue grew by 12.5% in Q3.", "Use static types for safety.",
    ]
    assert texts(*clean).where(F.size(pii_warnings(F.col("text"))) > 0).count() == 0
    row = texts("x@y.org, 123-45-6789, x@y.org, 10.0.0.1").select(pii_warnings(F.col("text")).alias("w")).first()
    assert [w.value for w in row.w] == ["x@y.org", "x@y.org", "123-45-6789"]
    row = texts("say [A_01]").select(
        scan_with_map(F.col("text"), F.create_map(F.lit("[A_01]"), F.lit("v"), F.lit("[B_01]"), F.lit("w"))).alias("w")
    ).first()
    assert [(w.type, w.value) for w in row.w] == [("TOKEN_ECHO", "[A_01]")]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, t, f"user{t}@x.org {t}", d) for t, d in enumerate(["a.org", "a.org", "", "b.org"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string, domain string").withColumn(
        "ts", F.timestamp_millis(F.lit(1704067200000) + F.col("turn") * 86_400_000)
    )
    allow = spark.createDataFrame([("b.org",)], "domain string")
    return sanitize(turns, allowlist=allow, mode="reference")


def test_audit(spark, log):
    entries = audit_entries(log, ["conv_id", "turn"])
    rows = entries.orderBy("ts").collect()
    assert [r.domain for r in rows] == ["a.org", "a.org", "unknown"]
    assert rows[0].id.startswith("lqu5m2o0") and len(rows[0].id) == 12
    assert rows[0].pii_types == ["EMAIL"] and rows[0].pii_count == 1 and rows[0].elapsed_ms is None
    entry = json.loads(audit_json(entries).where(F.col("id") == rows[0].id).first().json)
    assert entry["timestamp"] == 1704067200000 and entry["promptHash"] == plain_hash("user0@x.org 0") and entry["elapsedMs"] is None
    assert [r.domain for r in recent(entries, 2).collect()] == ["unknown", "a.org"]
    kept = retained(entries, 1704067200000 + 31 * 86_400_000, days=30)
    assert sorted(r.day.day for r in kept.collect()) == [2, 3]
    stats = session_stats(log).first()
    assert (stats.prompts_processed, stats.pii_caught) == (3, 3)
    totals = {(r.domain, r.type, r.day): r.entries for r in audit_report(entries).collect()}
    assert totals[None, None, None] == 3 and totals["a.org", "EMAIL", None] == 2


def test_sinks(spark, log):
    out = work_dir(spark, "out")
    entries = audit_entries(log, ["conv_id", "turn"])
    append_audit(entries, f"{out}/audit")
    append_audit(entries, f"{out}/audit")
    assert read_audit(spark, f"{out}/audit").count() == 6
    plan = retained(read_audit(spark, f"{out}/audit"), 1704067200000 + 31 * 86_400_000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    export_audit_json(entries, f"{out}/json")
    assert all(json.loads(r.value)["piiTypes"] == ["EMAIL"] for r in spark.read.text(f"{out}/json").collect())
    write_token_vault(log.selectExpr("conv_id", "turn", "inline(tokens)"), f"{out}/vault")
    assert spark.read.parquet(f"{out}/vault").count() == 3


def test_read_turns(spark):
    out = work_dir(spark, "turns")
    rows = [(1, 0, "user", " "), (1, 1, "user", "x"), (1, 2, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(out)
    assert [r.text for r in read_turns(spark, out).collect()] == ["x"]
    assert read_turns(spark, out, stream=True).isStreaming


def test_quality(texts):
    df = detect(texts("a@b.com", "a@b.com 10.0.0.1", "none")).withColumn(
        "want", F.when(F.col("id") == 2, F.array(F.lit("EMAIL"))).otherwise(F.array(F.lit("EMAIL")))
    )
    rows = {r.type: r for r in detector_quality(df, F.expr("transform(detections, d -> d.type)"), F.col("want"), ["EMAIL", "IP_ADDRESS"]).collect()}
    assert (rows["EMAIL"].precision, round(rows["EMAIL"].recall, 3)) == (1.0, 0.667)
    assert rows["IP_ADDRESS"].false_positives == 1 and rows["IP_ADDRESS"].recall is None
