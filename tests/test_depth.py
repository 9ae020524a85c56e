"""Tables and operators at the edges that a retry, a long text or another recogniser brings."""

import re

import pytest
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.operators.entities import entity_tag
from maskwright.operators.recognise import recognise
from maskwright.operators.responses import scan_responses
from maskwright.operators.vault import contained_tokens, restore, token_history, value_before
from maskwright.plans.sanitize import sanitize
from maskwright.policy import Policy
from maskwright.session import work_dir
from maskwright.sources.tables import append_and_purge, append_audit, read_audit, read_token_vault, write_token_vault, write_vault_table

DAY_MS = 86_400_000


def entries(spark, *rows):
    return spark.createDataFrame(rows, "id string, day string").withColumn("day", F.col("day").cast("date"))


def test_a_repeated_commit_replaces_its_rows(spark):
    out = work_dir(spark, "log")
    append_audit(entries(spark, ("a", "2024-01-01"), ("b", "2024-01-02")), out, "job-1")
    append_audit(entries(spark, ("c", "2024-01-02")), out, "job-2")
    append_audit(entries(spark, ("a", "2024-01-01"), ("b2", "2024-01-02")), out, "job-1")
    assert sorted(r.id for r in read_audit(spark, out).collect()) == ["a", "b2", "c"]
    assert read_audit(spark, out).columns == ["id", "day"]
    append_audit(entries(spark, ("d", "2024-01-02")), out)
    append_audit(entries(spark, ("d", "2024-01-02")), out)
    assert read_audit(spark, out).count() == 5

    vault = spark.createDataFrame([(i, 0, 0, "[A_01]", "v") for i in range(50)], schemas.VAULT)
    path = work_dir(spark, "vault")
    for _ in range(2):
        write_token_vault(vault, path, "batch-7")
    assert read_token_vault(spark, path).count() == 50 and sorted(read_token_vault(spark, path, [3]).columns) == sorted(vault.columns)


def test_append_and_purge_can_be_repeated(spark):
    out, now = work_dir(spark, "log"), 1704067200000 + 40 * DAY_MS  # 10 February 2024
    append_audit(entries(spark, ("old", "2024-01-01"), ("new", "2024-02-01")), out, "first")
    for _ in range(2):
        gone = append_and_purge(entries(spark, ("today", "2024-02-10")), out, Policy(audit_retention_days=30), now, "second")
        assert sorted(r.id for r in read_audit(spark, out).collect()) == ["new", "today"]
    assert gone == []


def writes_of(spark, *rows):
    return spark.createDataFrame(rows, schemas.VAULT)


def test_history_keeps_changes_only(spark):
    vault = writes_of(spark, (1, 0, 0, "t", "a"), (1, 1, 0, "t", "a"), (1, 2, 0, "t", "b"), (1, 2, 1, "t", "a"), (1, 4, 0, "t", None), (1, 5, 0, "t", None))
    (row,) = token_history(vault).collect()
    assert [(w.turn, w.seq, w.value) for w in row.writes] == [(0, 0, "a"), (2, 0, "b"), (2, 1, "a"), (4, 0, None)]
    asked = spark.createDataFrame([(1, t, "t") for t in range(7)] + [(2, 3, "t"), (1, 3, "u")], "conv_id long, turn long, token string")
    got = {(r.conv_id, r.turn): r.value for r in value_before(asked, token_history(vault)).collect()}
    assert got == {(1, 0): None, (1, 1): "a", (1, 2): "a", (1, 3): "a", (1, 4): "a", (1, 5): None, (1, 6): None}


def test_a_vault_table_is_not_shuffled(spark):
    vault = writes_of(spark, *[(i % 40, i // 40, 0, f"[EMAIL_{i // 40:02d}]", f"v{i}") for i in range(400)])
    table = write_vault_table(vault, "vault_for_plan", work_dir(spark, "vault"), buckets=8)
    answers = spark.createDataFrame([(i % 40, 5 + i % 7, f"[EMAIL_0{i % 9}] and [EMAIL_99]") for i in range(280)], "conv_id long, turn long, text string").distinct()
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = restore(answers, table)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
        indent = [m.end() if (m := re.match(r"[ :]*[+:]- ", line)) else 0 for line in lines]
        depth, above = indent[at], []
        for line, mine in zip(reversed(lines[:at]), reversed(indent[:at])):
            if mine < depth:  # the node that this one belongs to
                depth = mine
                above.append(line)
        # From the scan up to its join there is no Exchange.
        join = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in above[:join])
        got = sorted(tuple(r) for r in found.select("conv_id", "turn", "restored").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(tuple(r) for r in restore(answers, vault).select("conv_id", "turn", "restored").collect())


def test_tokens_of_many_lengths(spark):
    tokens = [f"{'ab' * (n // 2)}{n:03d}" for n in range(1, 51)] + ["x", "yz", "[A_01]", ""]
    vault = writes_of(spark, *[(c, 0, i, t, "v") for c in (1, 2) for i, t in enumerate(tokens)], (3, 0, 0, "only here", "v"))
    texts = {(1, 1): " ".join(tokens[::2]), (1, 2): "xx yy zz", (2, 1): "".join(tokens), (2, 2): "", (2, 3): None, (3, 1): tokens[7] + " only here", (4, 1): tokens[3]}
    answers = spark.createDataFrame([(*k, t) for k, t in texts.items()], "conv_id long, turn long, text string")
    got = {}
    for r in contained_tokens(answers, vault).collect():
        got.setdefault((r.conv_id, r.turn), set()).add(r.token)
    held = {1: tokens, 2: tokens, 3: ["only here"], 4: []}
    want = {k: {t for t in held[k[0]] if t and not re.fullmatch(r"\[[^\[\]]+\]", t) and t in (text or "")} for k, text in texts.items()}
    assert got == {k: v for k, v in want.items() if v}
    # Rows go with the characters of the answers, not with the number of lengths.
    long_text = "".join(chr(0x4E00 + i) for i in range(3000))
    plan_rows = spark.createDataFrame([(1, 1, long_text)], "conv_id long, turn long, text string")
    assert contained_tokens(plan_rows, vault).count() == 0
    assert {w.value for r in scan_responses(answers.where("conv_id = 3"), vault, any_shape=True).collect() for w in r.warnings} == {"only here"}
    assert contained_tokens(answers, vault.where("token = ''")).count() == 0


def test_names_in_a_very_long_text(spark):
    """200,000 different words: rows in proportion to them."""
    words = [f"w{i}" for i in range(200_000)]
    words[150_000:150_002] = ["Jane", "Doe"]
    df = spark.createDataFrame([(0, " ".join(words)), (1, "Jane Doe and Doe"), (2, None)], "id int, text string")
    names = spark.createDataFrame([("Jane Doe", "PERSON"), ("Doe Jane", "PERSON"), ("w7 w8 w9", "ORG")], "name string, label string")
    got = {r.id: [(e.type, e.value) for e in r.entities or []] for r in entity_tag(df, names).collect()}
    assert got == {0: [("ORGANIZATION", "w7 w8 w9"), ("PERSON", "Jane Doe")], 1: [("PERSON", "Jane Doe")], 2: []}


def test_spans_of_a_recogniser_are_checked(texts):
    def bad_and_good():
        """A recogniser whose spans are right, wrong, outside, of unknown labels, repeated."""

        def tag(texts):
            assert all(isinstance(t, str) for t in texts) and len(texts) <= 2
            out = []
            for t in texts:
                at = t.find("Ann")
                spans = [("PERSON", at, at + 3, "Ann", 0.9), ("PERSON", at, at + 3, "Ann", 0.9), ("LOC", 0, 1, t[:1], 0.5)] if at >= 0 else []
                spans += [("PERSON", 0, len(t) + 5, t, 0.9), ("PERSON", 2, 1, "", 0.9), ("DOG", 0, 1, t[:1], 0.9), ("PERSON", 0, 1, "?", 0.9), ("PERSON", 0, 1, t[:1], 1.5)]
                out.append(spans)
            return out

        return tag

    df = recognise(texts("mail Ann at a@b.com", None, "é😀 Ann", "", "nobody"), bad_and_good, batch=2)
    rows = {r.id: r for r in df.collect()}
    assert [(e.type, e.value, e.start, e.end) for e in rows[0].recognised] == [("LOCATION", "m", 0, 1), ("PERSON", "Ann", 5, 8)]
    assert [(e.type, e.value, e.start) for e in rows[2].recognised] == [("LOCATION", "é", 0), ("PERSON", "Ann", 3)]
    assert rows[1].recognised == [] and rows[1].rejected == 0 and rows[4].recognised == [] and rows[4].rejected == 5
    done = sanitize(df.withColumns({"conv_id": F.col("id").cast("long"), "turn": F.lit(0).cast("long")}), entities_col="recognised")
    assert {r.id: r.sanitized for r in done.collect()}[0] == "[LOCATION_01]ail [PERSON_01] at [EMAIL_01]"


def test_a_recogniser_that_loses_texts_stops_the_job(texts):
    with pytest.raises(Exception, match="lists for"):
        recognise(texts("a", "b"), lambda: lambda ts: [[]] * (len(ts) - 1)).collect()


def test_texts_of_conversations_are_detected_once(spark):
    """The plan that gives the result reads what was found instead of searching the texts again."""
    rows = [(i % 5, i, "user", f"mail a{i % 7}@b.com", "x.org") for i in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, domain string")
    plan = sanitize(turns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Scan ExistingRDD" in plan or "LogicalRDD" in plan
    assert "a-zA-Z0-9._%+" not in plan
    done = sanitize(turns)
    assert done.columns == [*turns.columns, "scanned", "detections", "sanitized", "tokens", "pii_count", "semantic_hits", "elapsed_ms", "timing_jitter"]
    assert {(r.conv_id, len(r.detections)) for r in done.collect()} == {(c, 1) for c in range(5)}
