"""Cases of the third round of findings."""

import re

import pytest

from pyspark.sql import functions as F

from maskwright.dialect import BOUNDARY, translate
from maskwright.functions.text import word_count
from maskwright.operators import vault
from maskwright.operators.detect import detect
from maskwright.operators.padding import pad_texts
from maskwright.operators.vault import contained_tokens
from maskwright.policy import Policy
from maskwright.rules import BUILT_IN, Rule
from maskwright.schemas import TURNS
from maskwright.sources.tables import write_token_vault
from maskwright.streaming import flow

OFF = Policy(detectors={r.type: False for r in BUILT_IN})
TEXTS = (
    "", "a", "aab b\x01\x02a \x01\x02\x02\x03a\x02\x01", "The quick fox. Theabcde Thexyzuv, Theabcde", "\x01\x02", "x" * 70 + "ab " * 90,
    "😀a😀😀ab a\n Étab", "É Ét aÉtab xÉt", "a.b .a a. _a 1a a1", "ab\x04ba\x03",
)
PATTERNS = (
    r"a*", r"a?", r"a{0,2}", r"a*?", r"(?:\bThe[a-z]{5}\b)?", r"(?=a)", r"a?b*", r"(?:a|b)?|\.", r"\ba?", r"^|b", r"[\x01\x02]*x?", r"a{0}",
    r"\ba\b", r"\b[ab]+\b", r"\bÉt[a-z]+\b", r"\b\.a", r"a\b\.", r"\b(?:a|b)\b", r"a?\bb", r"\b\w{1,3}\b",
)


def visible(pattern, text):
    at, found = 0, []
    while at <= len(text):
        m = re.compile(pattern, re.ASCII).match(text, at)
        if m and m.end() > at:
            found.append((at, m.group(0)))
        at = m.end() if m and m.end() > at else at + 1
    return found


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_that_can_be_seen(texts, pattern):
    rows = detect(texts(*TEXTS), policy=OFF, custom=[Rule("R", pattern, custom=True)], occurrences="all").orderBy("id").collect()
    for text, row in zip(TEXTS, rows, strict=True):
        assert [(d.start, d.value) for d in row.detections] == visible(pattern, text), (pattern, text)


def test_optional_patterns_are_searched_for_what_can_be_seen():
    assert [translate(p).visible for p in (r"(?:x\d)?", r"x*", r"x{0,7}", r"(?=q)", r"x*?", r"a?b?")] == [r"(?:x\d)", "x+", "x{1,7}", "", "", None]
    assert all(BOUNDARY not in translate(p).regex for p in (r"\b[A-Z]\d+\b", r"\buser\d+\b", r"\bÉt[a-z]+\b"))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_once_and_without_an_array(texts):
    values = ("", " ", "\t\u2003\n", "a", " a\u00a0b\ufeff", "é\x00 \x85ü  😀 z\n" * 40, "x " * 256, "x " * 257, "\u3000" * 5000 + "q")
    df = pad_texts(texts(*values, None)).orderBy("id")
    rows = df.collect()
    space = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
    counted = [max(1, len([w for w in re.split(f"{space}+", v) if w])) for v in values]
    assert [r.words for r in rows] == [*counted, None]
    assert [r.padded for r in rows] == [*[v + " " * (-n % 256) for v, n in zip(values, counted)], None]
    assert plan_of(df).count("regexp_replace") == 1 and "split(" not in plan_of(df)
    assert texts("a b").select(word_count(F.col("text")).alias("n")).first().n == 2


def test_few_tokens_are_looked_for_without_pieces(spark, monkeypatch):
    tokens = [(c, f"tok{i}ß😀{'x' * (i % 9)}") for c, n in ((1, 3), (2, vault.FEW), (3, vault.FEW + 9)) for i in range(n)] + [(1, "a"), (1, "[A_01]"), (None, "tok1")]
    answers = [(c, t, " ".join(x for d, x in tokens[t::5] if d == c) + " a😀b") for c in (1, 2, 3) for t in range(5)] + [(1, None, "tok1"), (1, 9, None)]
    held = spark.createDataFrame(tokens, "conv_id long, token string")
    asked = spark.createDataFrame(answers, "conv_id long, turn long, text string")
    want = {(c, t, x) for c, t, text in answers if text and t is not None for d, x in tokens if d == c and x in text and not x.startswith("[")}
    for few in (64, 0, 10_000):
        monkeypatch.setattr(vault, "FEW", few)
        rows = [tuple(r) for r in contained_tokens(asked, held).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    # Where all conversations have few tokens, an answer does not become a row for each of its characters.
    assert "regexp_extract_all" not in plan_of(contained_tokens(asked, held)) and "sequence" not in plan_of(contained_tokens(asked, held))


def test_a_folder_is_written_by_few_tasks(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 50).alias("conv_id"), F.col("id").alias("turn"), F.lit("[A_01]").alias("token"))
    path = str(tmp_path / "vault")
    write_token_vault(rows.repartition(8), path)
    folders = {f.parent for f in (tmp_path / "vault").rglob("*.parquet")}
    assert len(list((tmp_path / "vault").rglob("*.parquet"))) == len(folders)
    assert spark.read.parquet(path).count() == 4000


def test_a_batch_of_one_file_is_spread_over_the_cores(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"mail u{c}@x.org", "claude.ai", None) for c in range(5) for t in range(4)]
    spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(str(tmp_path / "turns"))
    plans, cut = [], flow.cut_lineage
    monkeypatch.setattr(flow, "cut_lineage", lambda df: (plans.append(plan_of(df)), cut(df))[1])
    flow.conversation_stream(flow.read_stream(spark, str(tmp_path / "turns"), TURNS), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert "RepartitionByExpression" in plans[0]
    assert flow.stream_vault(spark, str(tmp_path / "t")).count() == 10
