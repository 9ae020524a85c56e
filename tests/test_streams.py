"""Streams over files, one file per micro-batch."""

import pytest
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.plans.sanitize import sanitize
from maskwright.session import work_dir
from maskwright.sources.tables import read_responses
from maskwright.streaming import flow
from maskwright.streaming.state import Files, State


def files(spark, name, *batches, schema=schemas.TURNS):
    """One file per batch, in order."""
    path = work_dir(spark, name)
    for rows in batches:
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts double"))
        df.withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000)).coalesce(1).write.mode("append").parquet(path)
    return path


def turn(conv, n, role, text, ts):
    return (conv, n, role, text, "chat.example.org", float(ts))


def output(spark, result, name):
    out = work_dir(spark, name)
    flow.run_available(result, f"{out}/data", f"{out}/checkpoint")
    return spark.read.schema(result.schema).parquet(f"{out}/data")


BATCHES = (
    [turn(1, 0, "user", "mail a@b.com", 0), turn(2, 0, "user", "key 123-45-6789", 0), turn(1, 1, "assistant", "[EMAIL_01] ok", 5)],
    [turn(1, 2, "user", "c@d.com now", 20), turn(1, 3, "assistant", "[EMAIL_01] again", 25)],
    [turn(2, 1, "assistant", "[SSN_01] [EMAIL_01] 111-22-3333", 40), turn(1, 5, "assistant", "[EMAIL_01] at last", 45)],
)


@pytest.fixture(scope="module")
def path(spark):
    return files(spark, "turns", *BATCHES)


def conversations(spark, turns, **options):
    out = work_dir(spark, "conversations")
    flow.conversation_stream(turns, f"{out}/tables", f"{out}/checkpoint", **options).awaitTermination()
    return flow.Tables(f"{out}/tables")


def one_by_one(spark, path):
    return flow.read_stream(spark, path, schemas.TURNS, files_per_batch=1)


def test_stream_equals_batch(spark, path):
    got = output(spark, flow.sanitize_stream(one_by_one(spark, path)).select("conv_id", "turn", "sanitized", "pii_count"), "sanitized")
    batch = sanitize(spark.read.parquet(path).where("role = 'user'"), numbering="text").select("conv_id", "turn", "sanitized", "pii_count")
    assert sorted(got.collect()) == sorted(batch.collect()) and got.count() == 3


def test_tables_carry_over_batches(spark, path):
    tables = conversations(spark, one_by_one(spark, path))
    assert {(r.conv_id, r.turn, r.token): r.value for r in flow.held_tokens(spark, tables.root).collect()} == {
        (1, 1, "[EMAIL_01]"): "a@b.com", (1, 3, "[EMAIL_01]"): "a@b.com", (1, 5, "[EMAIL_01]"): "a@b.com", (2, 1, "[SSN_01]"): "123-45-6789",
    }
    done = {(r.conv_id, r.turn): r.sanitized for r in tables.read(spark, "sanitized", "conv_id long, turn long, sanitized string").collect()}
    assert done == {(1, 0): "mail [EMAIL_01]", (2, 0): "key [SSN_01]", (1, 2): "[EMAIL_02] now"}
    warnings = tables.read(spark, "warnings", flow.WARNINGS).where("conv_id = 2").collect()
    assert sorted((r.type, r.value) for r in warnings) == [("PII_IN_RESPONSE", "111-22-3333"), ("TOKEN_ECHO", "[SSN_01]")]
    assert tables.read(spark, "late", flow.LATE).count() == 0


def test_late_prompts_reach_the_vault_and_their_answers(spark):
    batches = (
        [turn(1, 1, "assistant", "[EMAIL_01] ok", 100)],
        [turn(1, 2, "user", "c@d.com", 150)],
        [turn(1, 0, "user", "a@b.com", 0)],
    )
    tables = conversations(spark, one_by_one(spark, files(spark, "late", *batches)))
    vault = {(r.turn, r.token): r.value for r in flow.stream_vault(spark, tables.root).collect()}
    # Numbers follow arrival; no value is lost and none shares a token.
    assert vault == {(2, "[EMAIL_01]"): "c@d.com", (0, "[EMAIL_02]"): "a@b.com"}
    assert [(r.conv_id, r.turn, r.role) for r in tables.read(spark, "late", flow.LATE).collect()] == [(1, 0, "user")]

    batches = ([turn(1, 1, "assistant", "[EMAIL_01] ok", 100)], [turn(1, 0, "user", "a@b.com", 0)])
    tables = conversations(spark, one_by_one(spark, files(spark, "late", *batches)))
    assert [(r.turn, r.token, r.value, r.late) for r in tables.read(spark, "held", flow.HELD).collect()] == [(1, "[EMAIL_01]", "a@b.com", True)]


def test_only_a_close_forgets(spark):
    batches = (
        [turn(n, 0, "user", "a@b.com", 0) for n in (1, 2, 3)],
        [turn(2, 1, "assistant", "[EMAIL_01]", 100), turn(2, 1, "close", None, 101)],
        [turn(n, 2, "assistant", "[EMAIL_01]", 10**8) for n in (1, 2, 3)],
        [turn(2, 3, "user", "x@y.org", 10**8 + 1), turn(2, 4, "assistant", "[EMAIL_02] [EMAIL_01]", 10**8 + 2)],
    )
    held = flow.held_tokens(spark, conversations(spark, one_by_one(spark, files(spark, "closed", *batches))).root)
    assert sorted((r.conv_id, r.turn, r.value) for r in held.collect()) == [
        (1, 2, "a@b.com"), (2, 1, "a@b.com"), (2, 4, "x@y.org"), (3, 2, "a@b.com"),
    ]


def test_long_lists_on_a_stream(spark, path):
    names = spark.createDataFrame([(f"Name{i} z", "PERSON") for i in range(600)], "name string, label string")
    hosts = spark.createDataFrame([(f"h{i}.org",) for i in range(300)], "domain string")
    stream = one_by_one(spark, path).withColumn("text", F.concat(F.lit("Name7 z "), "text"))
    got = output(spark, flow.sanitize_stream(stream, entities=names, allowlist=hosts).select("conv_id", "turn", "scanned", "sanitized"), "lists")
    assert sorted(r.sanitized for r in got.collect()) == ["[PERSON_01] [EMAIL_01] now", "[PERSON_01] key [SSN_01]", "[PERSON_01] mail [EMAIL_01]"]


def test_unchanged_answers_are_skipped(spark):
    text, other = "a text that is long enough", "another text that is long"
    batches = (
        [turn(1, 0, "assistant", text, 0), turn(1, 1, "assistant", text, 1), turn(2, 0, "assistant", "short", 1)],
        [turn(1, 2, "assistant", f" {text} ", 2), turn(1, 3, "assistant", other, 3), turn(1, 4, "assistant", text, 4)],
    )
    out = work_dir(spark, "changed")
    answers = read_responses(one_by_one(spark, files(spark, "same", *batches)))
    flow.changed_answers(answers, f"{out}/tables", f"{out}/checkpoint").awaitTermination()
    assert sorted(r.turn for r in flow.Tables(f"{out}/tables").read(spark, "changed", "conv_id long, turn long").collect()) == [0, 3, 4]


def test_debounce_and_late_rows(spark):
    schema = "conv_id long, ts timestamp, text string"
    batches = (
        [(1, 0.0, "a"), (1, 1.0, "ab"), (1, 2.4, "abc"), (1, 3.9, "abcd")],
        [(1, 100.0, "x"), (2, 100.0, "y")],
        [(2, 100.5, "yz")],
        # Far behind the watermark, which takes effect one batch later: dropped.
        [(1, 50.0, "late"), (3, 101.0, "z")],
        [(9, 1000.0, "end")],
        [(9, 2000.0, "end")],
    )
    stream = flow.read_stream(spark, files(spark, "changes", *batches, schema=schema), schema, files_per_batch=1, lateness="10 seconds")
    rows = output(spark, flow.debounce_stream(stream), "quiet").where("conv_id < 9").collect()
    assert sorted((r.conv_id, r.text) for r in rows) == [(1, "abc"), (1, "abcd"), (1, "x"), (2, "yz"), (3, "z")]


def test_counters_and_audit(spark, path):
    sanitized = flow.sanitize_stream(flow.read_stream(spark, path, schemas.TURNS, files_per_batch=1))
    out = work_dir(spark, "counters")
    flow.write_counters(flow.running_stats(sanitized), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    assert flow.latest_counters(spark, f"{out}/data").first() == (3, 3)
    entries = output(spark, flow.audit_stream(sanitized), "entries")
    assert sorted(r.pii_types[0] for r in entries.collect()) == ["EMAIL", "EMAIL", "SSN"]


def rows_in(spark, root, name):
    """What the files of a state's table hold, seen or not."""
    state = State.latest(spark, root)
    return state.read(name, flow.STATE[name])


def test_idle_conversations_end_and_their_rows_go(spark):
    batches = (
        [turn(n, 0, "user", "a@b.com", 0) for n in (1, 2, 3)],
        [turn(2, 1, "assistant", "[EMAIL_01]", 50), turn(9, 0, "user", "nothing", 150)],
        # Conversation 1 was idle for more than 100 seconds; 2 was not; 3 is not heard of again.
        [turn(1, 2, "assistant", "[EMAIL_01]", 151), turn(1, 3, "user", "x@y.org", 152), turn(2, 2, "assistant", "[EMAIL_01]", 149)],
        [turn(1, 4, "assistant", "[EMAIL_01]", 153), turn(9, 1, "user", "nothing", 160)],
    )
    for merge in (1, 2, 100):
        path = files(spark, "idle", *batches)
        tables = conversations(spark, one_by_one(spark, path), timeout="100 seconds", merge=merge)
        held = {(r.conv_id, r.turn): r.value for r in flow.held_tokens(spark, tables.root).collect()}
        assert held == {(2, 1): "a@b.com", (2, 2): "a@b.com", (1, 4): "x@y.org"}
        vault = {(r.conv_id, r.turn, r.token) for r in flow.stream_vault(spark, tables.root).collect()}
        assert {v for v in vault if v[0] != 3} >= {(1, 3, "[EMAIL_01]"), (2, 0, "[EMAIL_01]")}
        if merge == 1:
            assert vault == {(1, 3, "[EMAIL_01]"), (2, 0, "[EMAIL_01]")}
            assert {r.conv_id for r in rows_in(spark, tables.root, "seen").collect()} == {1, 2, 9}


def test_rows_beyond_the_bound_are_listed_and_closed_tokens_go(spark):
    batches = (
        [turn(1, 0, "user", "a@b.com", 0), turn(1, 1, "close", None, 10), turn(2, 0, "user", "c@d.com", 10)],
        [turn(3, 0, "user", "nothing", 200)],
        [turn(2, 1, "assistant", "[EMAIL_01]", 99), turn(2, 2, "assistant", "[EMAIL_01]", 100), turn(4, 0, "user", "late@x.org", 50)],
        [turn(1, 5, "user", "n@m.org", 250), turn(1, 6, "assistant", "[EMAIL_01]", 251)],
    )
    for merge in (1, 100):
        tables = conversations(spark, one_by_one(spark, files(spark, "bound", *batches)), lateness="100 seconds", merge=merge)
        assert sorted((r.conv_id, r.turn) for r in tables.read(spark, "too_late", flow.TOO_LATE).collect()) == [(2, 1), (4, 0)]
        assert {(r.conv_id, r.turn): r.value for r in flow.held_tokens(spark, tables.root).collect()} == {(2, 2): "c@d.com", (1, 6): "n@m.org"}
    tables = conversations(spark, one_by_one(spark, files(spark, "bound", *batches)), lateness="100 seconds", merge=1)
    assert {(r.conv_id, r.turn) for r in flow.stream_vault(spark, tables.root).collect()} == {(2, 0), (1, 5)}
    with pytest.raises(ValueError):
        conversations(spark, one_by_one(spark, files(spark, "bound", *batches)), lateness="100 seconds", timeout="10 seconds")


def test_what_a_batch_reads_does_not_grow(spark):
    """New conversations in every batch, idle after two: the state is as large after 11 batches as after 6."""
    merge, sizes = 2, {}
    batches = [
        [turn(100 * k + i, 0, "user", f"mail a{100 * k + i}@b.com", 60 * k) for i in range(20)]
        + [turn(100 * (k - 1) + i, 1, "assistant", "[EMAIL_01]", 60 * k) for i in range(20) if k]
        for k in range(11)
    ]
    path, out = files(spark, "steady", *batches), work_dir(spark, "steady")
    stream = one_by_one(spark, path)
    commit = State.commit

    def measured(self, *args, **kwargs):
        sizes[self.batch_id] = self.bytes()
        commit(self, *args, **kwargs)

    State.commit = measured
    try:
        flow.conversation_stream(stream, f"{out}/tables", f"{out}/checkpoint", timeout="100 seconds", merge=merge).awaitTermination()
    finally:
        State.commit = commit
    assert flow.held_tokens(spark, f"{out}/tables").count() == 20 * 10
    cycles = [[sizes[b] for b in range(s, s + 4)] for s in (3, 7)]
    assert len(sizes) == 11 and max(cycles[1]) <= 1.1 * max(cycles[0])
    # Three batches live on, and those since the last merge; nothing older is left in any file.
    assert rows_in(spark, f"{out}/tables", "vault").count() <= 20 * (3 + merge)
    for name in ("vault", "seen", "asked"):
        found = Files(spark, f"{out}/tables").names(name)
        assert len(found) <= 2 * merge + 2, found


def test_a_repeated_batch_changes_nothing(spark):
    out = work_dir(spark, "repeated")
    schemas_, rows = {"vault": flow.STATE["vault"]}, lambda k: spark.createDataFrame([(k, 0, 0, "EMAIL", "[EMAIL_01]", f"v{k}")], flow.STATE["vault"])
    for k in (0, 1, 1, 2, 2, 3, 3):
        state = State.before(spark, out, k)
        assert sorted(r.conv_id for r in state.read("vault", flow.STATE["vault"]).collect()) == list(range(k))
        state.commit({"vault": rows(k)}, schemas_, k, 2, lambda name: state.read(name, flow.STATE[name]))
    assert State.latest(spark, out).clock == 3
    assert sorted(r.conv_id for r in State.latest(spark, out).read("vault", flow.STATE["vault"]).collect()) == [0, 1, 2, 3]


def test_answers_through_one_query(spark):
    schema = "conv_id long, ts timestamp, text string"
    text, other = "mail [EMAIL_01] to 111-22-3333 now", "nothing to be found in here"
    batches = (
        [(1, 0.0, text[:10]), (1, 1.0, text), (2, 0.0, other)],
        [(1, 100.0, text), (2, 100.0, other + "!"), (3, 100.0, "short")],
        [(1, 200.0, other), (1, 200.5, text), (4, 200.0, text)],
        [(9, 5000.0, "end")], [(9, 9000.0, "end")],
    )
    path, out = files(spark, "live", *batches, schema=schema), work_dir(spark, "live")
    changed = flow.read_stream(spark, path, schema, files_per_batch=1, lateness="10 seconds")
    written = spark.createDataFrame([(1, 1_700_000_000 - 5.0, 0, "[EMAIL_01]")], "conv_id long, ts double, seq int, token string").withColumn("ts", F.timestamp_seconds("ts"))
    flow.answer_stream(changed, lambda: written, f"{out}/tables", f"{out}/checkpoint", merge=1).awaitTermination()
    got = flow.Tables(f"{out}/tables").read(spark, "scanned", flow.SCANNED).collect()
    found = sorted((r.conv_id, r.ts.timestamp() - 1_700_000_000, r.token_echo, [w.value for w in r.warnings]) for r in got)
    ssn = "111-22-3333"
    # The second and the last text of 1 are the one scanned before: only the first is scanned.
    assert found == [(1, 1.0, True, ["[EMAIL_01]", ssn]), (2, 0.0, False, []), (2, 100.0, False, []), (4, 200.0, False, [ssn])]
