"""The named queries of this package and the SQL they are checked with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, hnsw, langid, licenses, manifest, mixing, paragraphs, periodic, quality, sharding, simhash, tokencount, urlfilter
from maskwright.llm.common import documents, setup
from maskwright.llm.sql import manifest_sql, mixing_sql, shard_sql, url_sql

#: Eight shards in two regions of two racks; a ninth comes as a region of its own, so that rows move only into it.
TREE = {"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0, 3: 1.0}}, "r1": {"k2": {4: 1.0, 5: 1.0}, "k3": {6: 1.0, 7: 1.0}}}
GROWN = {**TREE, "r2": {"k4": {8: 1.0}}}

URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.judge(documents(spark, sf_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = setup(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return hnsw.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir), every_place=True)


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.repeated_passages(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), F.col("start").alias("start_word"), "n_words", "n_paragraphs",
        F.col("first_id").alias("first_doc_id"), "removed",
    )


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir), TREE, GROWN)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_verdicts(setup(spark).read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.bpe_round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokencount.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def _crc32(col: str) -> Column:
    """Unsigned CRC-32 of a number's decimal digits; null for null."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.when(_crc32("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    later = manifest.encoded([*[F.col(v) for v in values[:-1]], tampered])
    done = manifest.merkle_manifest(docs, values, "source", "doc_id", later)
    return done.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )


def looped_text() -> Column:
    """The words of a tenth of the texts repeated with a period from some word on, joined by spaces; other texts as they are.

    With h the CRC-32 of the id and g = h // 10, that is where 10 divides h: from word g % n of n on, with a period of the
    words behind it divided by 3 + g % 8, plus one.
    """
    h = _crc32("doc_id")
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), looped).otherwise(F.col("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic.periodic_runs(documents(spark, sf_dir), ("doc_id",), looped_text())
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # Runs come by start, then period: the first of the greatest exact ratios.
    greater = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), greater)
    found = done.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_quality_rules, op3_mixing, op4_hnsw, op5_licenses, op6_paragraphs, op7_hash_tree, op8_url_filter,
        op9_byte_bpe, op10_language, op11_token_counts, op12_merkle, op13_periodic,
    )
}

SQL = {"op3_mixing": mixing_sql(), "op7_hash_tree": shard_sql(TREE, GROWN), "op8_url_filter": url_sql(URL_RULES), "op12_merkle": manifest_sql()}
