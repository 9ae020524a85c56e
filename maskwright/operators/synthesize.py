"""Replacing detected spans by plausible fake values."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import let, number_per_type
from maskwright.operators.redact import rewrite, rewritten

# The word lists fake values are drawn from.
FIRST_NAMES = (
    "Alex", "Jordan", "Taylor", "Morgan", "Casey", "Riley", "Avery", "Quinn", "Blake", "Drew",
    "Parker", "Reese", "Logan", "Skyler", "Cameron", "Peyton", "Hayden", "Emerson", "Finley", "Rowan",
)
LAST_NAMES = (
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Wilson", "Anderson",
    "Taylor", "Thomas", "Moore", "Jackson", "Martin", "Lee", "Thompson", "White", "Harris", "Clark",
)
EMAIL_DOMAINS = ("example.com", "mailtest.net", "sample.org", "testmail.dev", "placeholder.io")
AREA_CODES = ("555", "800", "888", "877", "866")
ORGANIZATIONS = ("Acme Corp", "Sample Inc", "Test Ltd", "Placeholder LLC", "Demo Systems")
CITIES = ("Springfield", "Shelbyville", "Riverdale", "Lakewood", "Fairview")
TEST_CARD = "4111 1111 1111 1111"

# Consecutive values of one type lie this far apart in their value space.  The
# step has no factor in common with any space below, so a space is used up
# completely before a value comes back.
STEP = 7919


def _pick(words: Sequence[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def _part(index: Column, below: int, size: int) -> Column:
    """One digit of a mixed-radix number: ``index / below % size``."""
    return F.floor(index / below) % size


def _card(index: Column) -> Column:
    """Test-range card numbers: the well-known one first, then others with a valid check digit."""

    def digits(n: Column) -> Column:
        body = F.concat(F.lit("41111111"), F.format_string("%07d", n))
        # Luhn: double every second digit from the right of the 15-digit body.
        summed = F.aggregate(
            F.sequence(F.lit(1), F.lit(15)),
            F.lit(0),
            lambda acc, p: acc
            + let(
                F.substring(body, p, F.lit(1)).cast("int"),
                lambda d: F.when(p % 2 == 1, F.floor(d * 2 / 10).cast("int") + d * 2 % 10).otherwise(d),
            ),
        )
        number = F.concat(body, F.pmod(-summed, F.lit(10)).cast("string"))
        return F.concat_ws(" ", *[F.substring(number, 1 + 4 * i, 4) for i in range(4)])

    return F.when(index == 0, F.lit(TEST_CARD)).otherwise(digits(index))


# Type -> (size of its value space, index -> value).
GENERATORS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "EMAIL": (
        20 * 990 * 5,
        lambda i: F.concat(
            F.lower(_pick(FIRST_NAMES, _part(i, 1, 20))),
            (_part(i, 20, 990) + 10).cast("string"),
            F.lit("@"),
            _pick(EMAIL_DOMAINS, _part(i, 19800, 5)),
        ),
    ),
    "PHONE": (
        5 * 1000 * 10000,
        lambda i: F.format_string(
            "(%s) %03d-%04d", _pick(AREA_CODES, _part(i, 1, 5)), _part(i, 5, 1000), _part(i, 5000, 10000)
        ),
    ),
    "SSN": (
        800 * 90 * 9000,
        lambda i: F.format_string(
            "%03d-%02d-%04d", _part(i, 1, 800) + 100, _part(i, 800, 90) + 10, _part(i, 72000, 9000) + 1000
        ),
    ),
    "IP_ADDRESS": (254, lambda i: F.format_string("192.0.2.%d", i + 1)),
    "IP_ADDRESS_V6": (9999, lambda i: F.concat(F.lit("2001:db8::"), F.lower(F.hex(i + 1)))),
    "IBAN": (
        90 * 90_000_000,
        lambda i: F.format_string("GB%02dTEST%08d", _part(i, 1, 90) + 10, _part(i, 90, 90_000_000) + 10_000_000),
    ),
    "PASSPORT": (9_000_000, lambda i: F.format_string("X%07d", i + 1_000_000)),
    "PERSON": (
        400,
        lambda i: F.concat_ws(" ", _pick(FIRST_NAMES, _part(i, 1, 20)), _pick(LAST_NAMES, _part(i, 20, 20))),
    ),
    "ORGANIZATION": (5, lambda i: _pick(ORGANIZATIONS, i)),
    "LOCATION": (5, lambda i: _pick(CITIES, i)),
    "DATE_OF_BIRTH": (
        28 * 31,
        lambda i: F.format_string("01/%02d/%d", _part(i, 1, 28) + 1, _part(i, 28, 31) + 1970),
    ),
}


def shapes() -> list[str]:
    """Patterns of all fake values, each of a fixed number of characters after its words, so that what stands beside a
    fake value in a text cannot become part of it.  A number behind ``#`` may follow."""
    def one_of(words: Sequence[str]) -> str:
        return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"

    usual = [
        *[one_of([n.lower() for n in FIRST_NAMES]) + rf"\d{{{d}}}@" + one_of(EMAIL_DOMAINS) for d in (2, 3)],
        rf"\({one_of(AREA_CODES)}\) \d{{3}}-\d{{4}}", r"\d{3}-\d{2}-\d{4}", r"01/\d{2}/\d{4}", r"GB\d{2}TEST\d{8}", r"X\d{7}",
        r"4111 1111 \d{4} \d{4}", "sk-test[0-9a-f]{20}", one_of(FIRST_NAMES) + " " + one_of(LAST_NAMES), one_of(ORGANIZATIONS), one_of(CITIES),
        *[rf"192\.0\.2\.\d{{{d}}}" for d in (1, 2, 3)], *[rf"2001:db8::[0-9a-f]{{{d}}}" for d in (1, 2, 3, 4)],
    ]
    return [*usual, *[u + r"#\d+" for u in usual]]


def start_of(seed: int, key: Column, kind: Column) -> Column:
    """Where a text starts in the value space of a type: 32 hash bits."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key, kind))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def fake(kind: Column, number: Column, seed: int, key: Column, mode: str) -> Column:
    """The ``number``-th (from 1) fake value of a type in one text.

    In reference mode constant types repeat their constant.  In safe mode a
    repeated value gets a suffix, so that every fake value of a text can be
    traced back to one original.
    """
    n = (number - 1).cast("long")
    result = None
    for name, (size, value) in GENERATORS.items():
        index = (start_of(seed, key, kind) + n * STEP) % size
        text = let(index, value)
        if mode == "safe":
            text = F.when(n < size, text).otherwise(F.concat(text, F.lit("#"), F.floor(n / size)))
        condition = kind == name
        result = F.when(condition, text) if result is None else result.when(condition, text)
    cards = _card(n) if mode == "safe" else F.lit(TEST_CARD)
    plain = F.concat(F.lit("["), kind, F.lit("]"))
    other = F.when(n > 0, F.format_string("[%s#%d]", kind, n)).otherwise(plain) if mode == "safe" else plain
    key_text = F.concat(
        F.lit("sk-test"),
        F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key, kind, n.cast("string"))), 1, 20),
    )
    return result.when(kind == "CREDIT_CARD", cards).when(kind == "API_KEY", key_text).otherwise(other)


#: Numbers of second choices start here, beyond what a conversation uses.
SECOND = 5_000_011


def safe_fake(kind: Column, number: Column, seed: int, key: Column, value: Column, text: Column) -> Column:
    """The first of some fake values that the text does not hold and that does not hold the value itself.

    Else the original could stay in place, or could not be told from the fake when the text is restored.  Two usual
    values are tried, then a placeholder that no text holds.
    """
    usual = F.transform(F.array(F.lit(0), F.lit(SECOND)), lambda more: fake(kind, number + more, seed, key, "safe"))
    last = F.format_string("[%s#%d#%s]", kind, number, F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key, text)), 1, 8))
    fits = F.filter(usual, lambda f: ~F.contains(text, f) & ((value == "") | ~F.contains(f, value)))
    return F.coalesce(F.get(fits, F.lit(0)), last)


def synthesize(
    df: DataFrame,
    key_cols: Sequence[str],
    seed: int = 0,
    text_col: str = "text",
    detections_col: str = "detections",
    mode: str = "safe",
) -> DataFrame:
    """As ``redact``, with fake values in place of tokens.

    Values depend on the seed, the key of the text, the type and the running
    number only, so a retried task writes the same text again; in safe mode a
    value that the text holds already is passed over.
    """
    return rewrite(df, mode, _synthesized, text_col, detections_col, mode, tuple(key_cols), seed)


def _synthesized(text_col: str, detections_col: str, mode: str, key_cols: tuple[str, ...], seed: int) -> Column:
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols])

    def label(spans: Column) -> Column:
        def one(kind: Column, n: Column, value: Column) -> Column:
            return safe_fake(kind, n, seed, key, value, F.col(text_col)) if mode == "safe" else fake(kind, n, seed, key, mode)

        return let(
            number_per_type(spans), lambda ns: F.transform(spans, lambda s, i: one(s["type"], F.get(ns, i), s["value"]))
        )

    return rewritten(text_col, detections_col, mode, label)
