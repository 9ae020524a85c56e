import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import gates
from maskwright.operators.detect import detect
from maskwright.operators.gates import mark_allowlisted, snippet_scan
from maskwright.operators.ordered import last_write_before, next_within, previous_value, running_number
from maskwright.operators.responses import debounce_responses, latest_response, response_gate, scan_responses
from maskwright.operators.vault import (
    drop_session_tokens, merge_token_map, plain_token_lengths, redact_conversations, restore, token_candidates, vault_rows,
)
from maskwright.plans.sanitize import sanitize
from maskwright.policy import Policy


def skewed(n, seed=1):
    """Rows (key, place, value) of which key 0 holds half, with gaps between places."""
    rng = random.Random(seed)
    rows, places = [], {}
    for _ in range(n):
        key = 0 if rng.random() < 0.5 else rng.randint(1, 9)
        places[key] = places.get(key, -1) + rng.choice((1, 1, 1, 2, 7))
        rows.append((key, places[key], rng.choice("abc")))
    return rows


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_previous_value(spark, width):
    rows = skewed(300)
    df = spark.createDataFrame(rows, "k long, o long, v string")
    got = {(r.k, r.o): r.p for r in previous_value(df, ["k"], "o", "v", "p", width).collect()}
    want, last = {}, {}
    for k, o, v in sorted(rows):
        want[k, o] = last.get(k)
        last[k] = v
    assert got == want


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_last_write_before(spark, width):
    rng = random.Random(2)
    rows = skewed(300, seed=2)
    is_write = [rng.random() < 0.3 for _ in rows]
    writes = [(*r, s) for r, w in zip(rows, is_write) if w for s in (0, 1)]
    writes = [(k, o, v + str(s), s) for k, o, v, s in writes]
    reads = [(k, o) for k, o, _ in rows]
    got = last_write_before(
        spark.createDataFrame(reads, "k long, o long"),
        spark.createDataFrame(writes, "k long, o long, v string, s int"),
        ["k"], "o", "v", tie="s", width=width,
    ).collect()
    want = {}
    for k, o in reads:
        earlier = [(wo, s, v) for wk, wo, v, s in writes if wk == k and wo < o]
        want[k, o] = max(earlier)[2] if earlier else None
    assert {(r.k, r.o): r.v for r in got} == want and len(got) == len(reads)


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_running_number(spark, width):
    rows = skewed(300, seed=3)
    got = running_number(spark.createDataFrame(rows, "k long, o long, v string"), ["k"], ["o"], "n", width).collect()
    seen, want = {}, {}
    for k, o, _ in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        want[k, o] = seen[k]
    assert {(r.k, r.o): r.n for r in got} == want


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_next_within(spark, width):
    rows = [(k, o, i) for i, (k, o, _) in enumerate(skewed(300, seed=4))]
    rows += [(k, o, i + 1000) for k, o, i in rows[:20]]
    got = next_within(spark.createDataFrame(rows, "k long, o long, i long"), ["k"], "o", 3, "f", width).collect()
    ordered = sorted(rows)
    want = {}
    for (k, o, i), after in zip(ordered, [*ordered[1:], (None, 0, 0)]):
        want[i] = after[0] == k and after[1] - o < 3
    assert {r.i: r.f for r in got} == want
    with pytest.raises(ValueError):
        next_within(spark.createDataFrame(rows, "k long, o long, i long"), ["k"], "o", 5, "f", 4)


TURNS = [
    (1, 0, "user", "mail a@b.com"), (1, 1, "assistant", "So [EMAIL_01] it is, [SSN_01] is not"),
    (1, 2, "user", "now c@d.com and a@b.com"), (1, 3, "assistant", "[EMAIL_01] and [EMAIL_02], or x@y.org"),
    (2, 0, "user", "123-45-6789"), (2, 1, "assistant", "short"), (2, 3, "assistant", "[SSN_01] 987-65-4321 [EMAIL_01]"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns(
        {"domain": F.lit("chat.example.org"), "ts": F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn"))}
    )


@pytest.fixture(scope="module")
def vault(turns):
    return vault_rows(sanitize(turns.where("role = 'user'"), mode="reference"))


def test_vault_keeps_the_newest_value(vault):
    rows = {(r.conv_id, r.token): r.value for r in merge_token_map(vault).collect()}
    assert rows == {(1, "[EMAIL_01]"): "c@d.com", (1, "[EMAIL_02]"): "a@b.com", (2, "[SSN_01]"): "123-45-6789"}


def test_closing(spark, vault):
    left = drop_session_tokens(vault, spark.createDataFrame([(1,), (1,)], "conv_id long"))
    assert {r.conv_id for r in left.collect()} == {2}


def test_restore_uses_the_value_held_at_that_moment(turns, vault):
    rows = restore(turns.where("role = 'assistant'"), vault).collect()
    assert {(r.conv_id, r.turn): r.restored for r in rows} == {
        (1, 1): "So a@b.com it is, [SSN_01] is not",
        (1, 3): "c@d.com and a@b.com, or x@y.org",
        (2, 1): "short",
        (2, 3): "123-45-6789 987-65-4321 [EMAIL_01]",
    }


def test_scan_responses(turns, vault):
    rows = {(r.conv_id, r.turn): r for r in scan_responses(turns.where("role = 'assistant'"), vault).collect()}
    shown = {k: [(w.type, w.value) for w in r.warnings] for k, r in rows.items()}
    assert shown == {
        (1, 1): [("TOKEN_ECHO", "[EMAIL_01]")],
        (1, 3): [("TOKEN_ECHO", "[EMAIL_01]"), ("TOKEN_ECHO", "[EMAIL_02]"), ("PII_IN_RESPONSE", "x@y.org")],
        (2, 1): [],
        (2, 3): [("TOKEN_ECHO", "[SSN_01]"), ("PII_IN_RESPONSE", "987-65-4321")],
    }
    assert [(k, r.echo_detected, r.token_echo) for k, r in sorted(rows.items())] == [
        ((1, 1), True, True), ((1, 3), True, True), ((2, 1), False, False), ((2, 3), True, True),
    ]
    assert rows[1, 1].warnings[0].reason == "AI echoed the redaction token [EMAIL_01] in its response"


def test_synthetic_values_are_found_and_restored(turns):
    done = sanitize(turns.where("role = 'user'"), Policy(synthetic_mode=True), seed=3)
    vault = vault_rows(done)
    assert plain_token_lengths(vault)
    answers = done.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(F.lit("x"), "sanitized", F.lit("y")).alias("text"))
    restored = {(r.conv_id, r.turn): r.restored for r in restore(answers, vault, any_shape=True).collect()}
    assert restored == {(c, t + 1): f"x{text}y" for c, t, role, text in TURNS if role == "user"}
    assert all(r.token_echo for r in scan_responses(answers, vault, any_shape=True).collect())


def test_token_candidates_find_every_contained_token(spark):
    row = spark.createDataFrame([("a [[X_01]] [B C_02] [] xyzxyz",)], "t string").select(
        token_candidates(F.col("t"), [2, 100]).alias("c")
    ).first()
    assert {"[X_01]", "[B C_02]", "xy", "zx"} <= set(row.c) and all(len(c) in (2, 6, 8) for c in row.c)


def test_conversation_numbers_never_collide(spark, turns):
    done = redact_conversations(detect(turns, occurrences="all"))
    rows = {(r.conv_id, r.turn): r for r in done.collect()}
    # Turn 1 of conversation 1 speaks of [EMAIL_02], so numbers start behind it.
    assert rows[1, 0].sanitized == "mail [EMAIL_03]" and rows[1, 2].sanitized == "now [EMAIL_04] and [EMAIL_03]"
    assert rows[1, 3].sanitized.endswith("or [EMAIL_05]")
    assert rows[2, 0].sanitized == "[SSN_02]" and rows[2, 3].sanitized.split()[:2] == ["[SSN_01]", "[SSN_03]"]  # the first stood there
    merged = merge_token_map(vault_rows(done)).count()
    assert merged == vault_rows(done).select("conv_id", "token", "value").distinct().count()


def test_latest_and_gate(spark, turns):
    assert {r.conv_id: r.turn for r in latest_response(turns).collect()} == {1: 3, 2: 3}
    long_one, other = "a text of some length", "another text of length"
    texts = [long_one, "short", f" {long_one}\n", other, long_one]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    assert [r.turn for r in response_gate(df).orderBy("turn").collect()] == [0, 3, 4]


def test_debounce(spark):
    ms = [0, 1000, 2499, 3999, 4000, 60_000, 61_499, 119_999, 120_000]
    df = spark.createDataFrame([(1, m, str(m)) for m in ms], "conv_id long, ms long, text string").select(
        "conv_id", F.timestamp_millis("ms").alias("ts"), "text"
    )
    kept = sorted(int(r.text) for r in debounce_responses(df).collect())
    assert kept == [2499, 4000, 61_499, 120_000]


def test_allowlist_both_ways(spark):
    hosts = ["a.internal.org", "internal.org", "x.com", "", None, "internal.or"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, domain string")
    for entries, want in ((["internal.org", "y."], [True, True, False, False, False, False]), ([""], [True] * 6), ([], [False] * 6)):
        allow = spark.createDataFrame([(e,) for e in entries], "domain string")
        for lookup in gates.LOOKUPS:
            assert [r.allowlisted for r in mark_allowlisted(df, allow, lookup=lookup).orderBy("i").collect()] == want


def test_gates_of_the_pipeline(spark, turns):
    prompts = turns.where("role = 'user'")
    off = sanitize(prompts, Policy(enabled=False)).collect()
    assert all(r.sanitized == r.text and not r.scanned and r.tokens == [] and r.pii_count == 0 for r in off)
    allow = spark.createDataFrame([("example.org",)], "domain string")
    skipped = sanitize(prompts, allowlist=allow).collect()
    assert all(r.sanitized == r.text and not r.scanned and r.semantic_hits == [] for r in skipped)
    jitter = sanitize(prompts, Policy(timing_jitter=True)).first()
    assert jitter.timing_jitter and jitter.elapsed_ms is None
    assert sorted(sanitize(prompts).columns) == sorted(sanitize(prompts, Policy(enabled=False)).columns)


def test_hits_of_another_recogniser_are_merged(turns):
    prompts = turns.where("conv_id = 1 AND turn = 0").withColumn(
        "mine",
        F.expr(
            "array(named_struct('type','PERSON','value','mail','start',0,'end',4,'confidence',0.5D,'source','x'),"
            "named_struct('type','EMAIL','value','a@b.com','start',5,'end',12,'confidence',0.5D,'source','x'))"
        ),
    )
    for mode in ("reference", "safe"):
        row = sanitize(prompts, entities_col="mine", mode=mode).first()
        assert row.sanitized == "[PERSON_01] [EMAIL_01]"
        assert [d.source for d in row.detections] == ["x", "regex"]


def test_snippets(texts):
    rows = snippet_scan(texts("::1:2", "a@b.com 10.0.0.1 c@d.com", "nothing here", None)).collect()
    assert [(r.id, r.pii_count, r.pii_types) for r in rows] == [(1, 3, ["EMAIL", "IP_ADDRESS"])]
    assert snippet_scan(texts("a@b.com"), Policy(enabled=False)).count() == 0
