"""Scalar text functions as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.dialect import SPACE, SPACE_SET
from maskwright.functions.arrays import let

_LONG = 8192
_CHUNK = 4096
BUCKET_WORDS = 256


def cutter(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """Give ``body`` a function ``cut(start, length)`` that slices ``text``.

    Finding a character position scans the text from its beginning, so many
    cuts of a long text would be quadratic.  Long texts are therefore first
    split into chunks of 4096 characters, and a cut touches only its chunks.
    """
    short = F.char_length(text) <= _LONG
    parts = F.struct(
        F.when(short, F.char_length(text) + 1).otherwise(_CHUNK).alias("width"),
        F.when(short, F.array(text))
        .otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)))
        .alias("chunks"),
    )

    def with_parts(p: Column) -> Column:
        def cut(start: Column, length: Column) -> Column:
            first = F.floor(start / p["width"]).cast("int")
            last = F.floor((start + length - 1) / p["width"]).cast("int")
            return F.when(
                length > 0,
                F.substring(
                    F.array_join(F.slice(p["chunks"], first + 1, last - first + 1), ""),
                    start % p["width"] + 1,
                    length,
                ),
            ).otherwise("")

        return body(cut)

    return let(parts, with_parts)


def strip(text: Column) -> Column:
    """Trim white space, including line ends and Unicode spaces, at both ends."""
    return F.regexp_replace(
        F.regexp_replace(text, rf"\A{SPACE}+", ""), rf"(?<!{SPACE}){SPACE}+\z", ""
    )


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(f"[^{SPACE_SET}]"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def at_least(text: Column, units: int) -> Column:
    """Length in UTF-16 units reaches ``units``; the encoding is only tried on short texts."""
    return (F.length(text) >= units) | (utf16_length(text) >= units)


# Scheme, user part, host (a name or an address in brackets), port; then the path, a query, a fragment or the end.
_URL = (
    r"\A\s*[A-Za-z][A-Za-z0-9+.\-]*:[/\\]{2}(?:[^/\\?#]*@)?"
    r"(\[[0-9A-Fa-f:.]+\]|[^/\\?#@:\s\[\]<>^|%]+)(?::[0-9]*)?(?=[/\\?#]|\s*\z)"
)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, ``''`` when there is none.  What follows the host may hold any characters."""
    return F.coalesce(F.lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def word_count(text: Column) -> Column:
    """Words separated by white space; an empty text counts as one.

    Every word with the space around it becomes one character, so there is no array of words.
    """
    # Most characters are told by one range.
    word = f"{SPACE}*+(?:[!-~]++|[^{SPACE_SET}!-~]++)++{SPACE}*+"
    return F.when(is_blank(text), 1).otherwise(F.char_length(F.regexp_replace(text, word, "x")))


def pad_to_bucket(text: Column) -> Column:
    """Append spaces up to the next multiple of 256 words."""
    return let(word_count(text), lambda words: padded_by(text, words))


def padded_by(text: Column, words: Column) -> Column:
    """Append spaces to a text whose words have been counted."""
    return F.concat(text, F.repeat(F.lit(" "), F.pmod(-words, F.lit(BUCKET_WORDS)).cast("int")))


def preview(value: Column, limit: int) -> Column:
    """The first ``limit`` characters, with an ellipsis if something was cut."""
    return F.when(
        F.char_length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("…"))
    ).otherwise(value)
