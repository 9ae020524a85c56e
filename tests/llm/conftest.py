import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASHING = (
    "id hash start n digest shingles fp key component_id root fingerprint text_hash n_copies copy order_key rank shard law slot size "
    "_rank _hash _id _said _spans n_words kept posterior score lang_pred held_out license coverage ids decoded n_tokens"
).split()


@pytest.fixture(scope="session")
def llm_spark(spark):
    from maskwright.llm.common import setup

    return setup(spark)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(llm_spark, sf):
    return llm_spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    long_text = " ".join(f"wort{i % 977} und{i % 31}" for i in range(60_000)) + "."
    return [
        (1, None, None, None, None), (None, "Some text without an id stands here.", "en", "a", 1), (None, None, None, None, None),
        (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 7), (4, "one", "en", None, 3), (4, "one", "en", None, 3),
        (4, "one", "en", None, 3), (5, "!!! ??? 123", "en", "b", 11), (6, "Ünïcödé ТЕКСТ 文字 \U0001f600 a\u00a0b", None, "b", 20),
        (7, long_text, "de", "c", len(long_text)), (8, long_text, "de", "c", len(long_text)), (8, "another text of the same id", "en", "c", 3),
        (9, "x" * 300_000, "en", "c", 300_000), (10, "\x00 nul \x1c\x1d sep \x85 nel", "en", "c", 9),
    ]


@pytest.fixture(scope="session")
def odd(llm_spark, odd_rows):
    """The odd rows with many extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = llm_spark.createDataFrame(odd_rows, SCHEMA)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(llm_spark):
    return llm_spark.createDataFrame([], SCHEMA)
