"""Hiding length and send time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import padded_by, word_count

JITTER_MIN_MS = 50
JITTER_MAX_MS = 250


def pad_texts(df: DataFrame, text_col: str = "text", out: str = "padded") -> DataFrame:
    """Pad texts to the next multiple of 256 words with trailing spaces."""
    # The words are counted once, for both columns.
    counted = df.withColumn("_words", word_count(F.col(text_col)))
    return counted.withColumns({"words": F.col("_words"), out: padded_by(F.col(text_col), F.col("_words"))}).drop("_words")


def jitter_timestamps(
    df: DataFrame, key_cols: Sequence[str], seed: int = 0, ts_col: str = "ts", out: str = "ts_jittered"
) -> DataFrame:
    """Delay every time stamp by 50 to 250 ms, by a hash of seed and key, so retries agree."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols])
    bits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    delay_us = JITTER_MIN_MS * 1000 + bits % ((JITTER_MAX_MS - JITTER_MIN_MS) * 1000)
    return df.withColumn(
        out, F.timestamp_micros(F.unix_micros(F.col(ts_col).cast("timestamp")) + delay_us)
    )
