"""The physical plans are the intended ones."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators.audit import audit_entries, audit_json, audit_report, session_stats
from maskwright.operators.detect import detect, explode_detections
from maskwright.operators.gates import drop_allowlisted, snippet_scan
from maskwright.operators.redact import redact
from maskwright.operators.responses import debounce_responses, response_gate, scan_responses
from maskwright.operators.vault import merge_token_map, restore, vault_rows
from maskwright.plans.sanitize import sanitize
from maskwright.session import input_bytes, spread
from maskwright.rules import BUILT_IN
from maskwright.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet").withColumns(
        {"domain": F.lit("x.org"), "ts": F.timestamp_seconds("turn")}
    )


def searches(text):
    return text.count("regexp_extract_all(")


def test_detection_is_one_narrow_projection(docs):
    text = plan(explode_detections(detect(docs), ["doc_id"]))
    assert "Exchange" not in text and "Python" not in text
    # Every pattern is searched once: no copy of the expression in a filter.
    assert searches(text) == len(BUILT_IN)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_redaction_is_one_narrow_projection(docs):
    for mode, occurrences in (("reference", "first"), ("safe", "all")):
        text = plan(redact(detect(docs, occurrences=occurrences), mode=mode).select("doc_id", "sanitized"))
        assert "Exchange" not in text and "Python" not in text
        # The chunks of long texts are cut by one more search each; safe mode looks for tokens that are there already.
        assert searches(text) <= len(BUILT_IN) + (3 if mode == "safe" else 2)


def test_the_pipeline_does_not_shuffle(spark, turns):
    allow = spark.createDataFrame([("internal.org",)], "domain string")
    names = spark.createDataFrame([("New York", "GPE")], "name string, label string")
    text = plan(sanitize(turns, allowlist=allow, entities=names, lookup="literal", numbering="text").select("conv_id", "turn", "sanitized", "semantic_hits"))
    assert "Exchange" not in text and "Join" not in text and "Python" not in text


def test_side_outputs_scan_once(turns):
    done = sanitize(turns, mode="reference")
    entries = audit_entries(done, ["conv_id", "turn"])
    for df in (vault_rows(done), session_stats(done), entries, audit_json(entries), audit_report(entries)):
        # The rules once, and the search that cuts long texts.
        assert searches(plan(df)) <= len(BUILT_IN) + 1


def test_filters_reach_the_scan(docs):
    text = plan(detect(docs.where("lang = 'de'")).select("doc_id", "detections"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in text
    text = plan(snippet_scan(docs.select("doc_id", "text")))
    assert searches(text) == len(BUILT_IN)


def test_no_pairwise_joins_and_no_whole_group_windows(turns):
    vault = vault_rows(sanitize(turns.where("role = 'user'")))
    answers = turns.where("role = 'assistant'")
    for df in (restore(answers, vault), scan_responses(answers, vault), response_gate(answers), merge_token_map(vault),
               debounce_responses(answers)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text
    # Windows over raw rows are partitioned by range; those over summaries see one row per range.
    text = plan(response_gate(answers))
    assert "lag(text" in text and "_range" in text


def test_the_queries_scan_as_the_library_does(spark):
    text = plan(detect(read_table(spark, f"{SF}/documents.parquet", "doc_id")).select("doc_id", "detections"))
    # One file for all cores: dealt out once, in front of the projection.
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text and searches(text) == len(BUILT_IN)


def test_conversations_are_numbered_without_pairs(turns):
    text = plan(sanitize(turns.where("role = 'user'")).select("conv_id", "turn", "sanitized"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text
    # What is numbered in one window is a range of turns of one conversation and type.
    assert all("_range" in line for line in text.split("\n") if "Window [" in line)


def test_small_inputs_are_spread_and_large_ones_left_alone(spark, docs, monkeypatch):
    assert spread(docs, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr("maskwright.session.input_bytes", lambda df: 1 << 50)
    assert spread(docs, "doc_id") is docs
    assert input_bytes(docs) > 0


def test_allowlist_prunes_before_detection(spark, turns):
    allow = spark.createDataFrame([("internal.org",)], "domain string")
    text = plan(detect(drop_allowlisted(turns, allow)).select("conv_id", "detections"))
    assert searches(text) == len(BUILT_IN)
