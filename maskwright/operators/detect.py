"""Rule-based detection: text -> array of detections, in one narrow projection."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.functions.arrays import first_per_key, let, sums_before
from maskwright.functions.reuse import built_once
from maskwright.functions.text import cutter
from maskwright.policy import Policy
from maskwright.rules import BUILT_IN, DIGIT, Rule, active_rules, score

HAS_DIGIT = "[0-9]"


def _guard(text: Column, rule: Rule, has_digit: Column) -> Column:
    """Cheap necessary condition for a match."""
    if rule.needs == DIGIT:
        return has_digit
    if not rule.needs:
        return text.isNotNull()
    # Several byte searches are cheaper than one search for alternatives.
    return reduce(operator.or_, [F.contains(text, F.lit(part)) for part in rule.needs])


def _marks(text: Column) -> tuple[Column, Column]:
    """Two strings that do not occur in a text, nor where it and they meet."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("\x02+"), F.lit(0)), F.char_length)
    # Longer than any such run of the text.
    frame = F.concat(F.lit("\x01"), F.repeat(F.lit("\x02"), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    used = F.rlike(text, F.lit("[\x01\x02]"))
    return (
        F.when(used, F.concat(frame, F.lit("\x03"))).otherwise("\x01"),
        F.when(used, F.concat(frame, F.lit("\x04"))).otherwise("\x02"),
    )


def _visible_hits(text: Column, rule: Rule) -> Column:
    """Matches of a rule that can match nothing, without the empty ones, each with blanks as long as the gap before it.

    Such a rule matches wherever it is tried, and after an empty match the search moves on by one character.  All matches are
    put between marks in one pass, and marks around nothing taken out again, so arrays only get as long as there are
    matches to be seen.  Characters of two units would be tried twice; one of a single unit stands in for each while
    searching.
    """
    wide = r"[\x{10000}-\x{10FFFF}]"
    searched = F.when(F.rlike(text, F.lit(wide)), F.regexp_replace(text, wide, "\ue000")).otherwise(text)

    def parts(t: Column) -> Column:
        """The text in front of the first match; then every match with its closing mark and the text behind it."""

        def split_at(marks: Column) -> Column:
            begin, end = marks["begin"], marks["end"]
            marked = F.regexp_replace(t, F.lit(rule.regex), F.concat(begin, F.lit("$0"), end))
            pieces = F.split(F.replace(marked, F.concat(begin, end), F.lit("")), begin, -1)
            return F.transform(
                pieces,
                lambda p, i: F.struct(
                    F.when(i == 0, 0).otherwise(F.char_length(F.split_part(p, end, F.lit(1)))).alias("size"),
                    (F.char_length(p) - F.when(i == 0, 0).otherwise(F.char_length(end))).alias("step"),
                ),
            )

        begin, end = _marks(t)
        return let(F.struct(begin.alias("begin"), end.alias("end")), split_at)

    def visible(ps: Column) -> Column:
        return let(
            sums_before(F.transform(ps, lambda p: p["step"])),
            lambda starts: F.filter(
                F.transform(ps, lambda p, i: F.struct(F.get(starts, i).alias("start"), p["size"].alias("size"))),
                lambda s: s["size"] > 0,
            ),
        )

    def placed(spots: Column) -> Column:
        return cutter(
            text,
            lambda cut: F.transform(
                spots,
                lambda s, i: F.struct(
                    cut(s["start"], s["size"]).alias("value"),
                    F.repeat(
                        F.lit(" "),
                        s["start"] - F.when(i == 0, 0).otherwise(F.get(spots, i - 1)["start"] + F.get(spots, i - 1)["size"]),
                    ).alias("gap"),
                ),
            ),
        )

    none = F.array().cast("array<struct<value:string,gap:string>>")
    return F.when(text.isNotNull(), let(let(let(searched, parts), visible), placed)).otherwise(none)


def rule_hits(text: Column, rules: Sequence[Rule], may_match: Column) -> Column:
    """Per rule with at least one match: its fields, all whole matches, and the text around them.

    Patterns stay literals, so each is compiled once per task.  Splitting by
    the same pattern, which gives the text around the matches, is only done
    where there are any.
    """
    none = F.array().cast("array<string>")

    def fields(order: int, rule: Rule, values: Column, gaps: Column) -> Column:
        return F.struct(
            F.lit(order).alias("ord"),
            F.lit(rule.type).alias("type"),
            F.lit(score(rule.confidence)).alias("confidence"),
            F.lit(rule.reason).alias("reason"),
            values.alias("values"),
            gaps.alias("gaps"),
        )

    def hit(order: int, rule: Rule) -> Column:
        if rule.visible == "":
            return fields(order, rule, none, none)
        if rule.visible is None:
            return let(
                _visible_hits(text, rule),
                lambda h: fields(order, rule, F.transform(h, lambda x: x["value"]), F.transform(h, lambda x: x["gap"])),
            )
        regex = rule.visible
        found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        return let(
            F.when(_guard(text, rule, may_match), found).otherwise(none),
            lambda m: fields(order, rule, m, F.when(F.size(m) > 0, F.split(text, regex, -1))),
        )

    hits = F.array(*[hit(i, r) for i, r in enumerate(rules)])
    return F.filter(hits, lambda h: F.size(h["values"]) > 0)


def starts(values: Column, gaps: Column) -> Column:
    """Where each match starts: the length of everything in front of it."""
    steps = F.transform(values, lambda v, i: F.char_length(F.get(gaps, i)) + F.char_length(v))
    return let(
        sums_before(steps),
        lambda before: F.transform(before, lambda b, i: b + F.char_length(F.get(gaps, i))),
    )


def spans_of(hits: Column) -> Column:
    """Hits of rules as sortable spans, in rule order and then text order."""

    def of_rule(h: Column) -> Column:
        return let(
            starts(h["values"], h["gaps"]),
            lambda ss: F.transform(
                h["values"],
                lambda v, i: F.struct(
                    F.get(ss, i).alias("start"),
                    h["ord"].alias("ord"),
                    h["type"].alias("type"),
                    v.alias("value"),
                    h["confidence"].alias("confidence"),
                    h["reason"].alias("reason"),
                ),
            ),
        )

    return F.flatten(F.transform(hits, of_rule))


def _public(spans: Column) -> Column:
    return F.transform(
        F.array_sort(spans),
        lambda s: F.struct(
            s["type"].alias("type"),
            s["value"].alias("value"),
            s["start"].alias("start"),
            (s["start"] + F.char_length(s["value"])).alias("end"),
            s["confidence"].alias("confidence"),
            F.lit("regex").alias("source"),
        ),
    ).cast(schemas.DETECTIONS)


def detections(text: Column, rules: Sequence[Rule], occurrences: str = "first") -> Column:
    """Detections of ``rules`` in ``text``, sorted by start, ties in rule order.

    ``occurrences="first"`` keeps the first hit of every (type, value), in rule
    order and then text order; ``"all"`` keeps every hit.
    """
    none = F.array().cast(schemas.DETECTIONS)
    if not rules:
        return F.when(text.isNotNull(), none)

    def place(hits: Column) -> Column:
        spans = spans_of(hits)
        if occurrences == "first":
            spans = let(spans, lambda xs: first_per_key(xs, lambda x: F.struct(x["type"], x["value"])))
        return F.when(F.size(hits) == 0, none).otherwise(_public(spans))

    found = let(F.rlike(text, F.lit(HAS_DIGIT)), lambda has_digit: rule_hits(text, rules, has_digit))
    return F.when(text.isNotNull(), let(found, place))


def column_detections(df: DataFrame, text_col: str, rules: tuple[Rule, ...], occurrences: str) -> Column:
    """The detections of a column of ``df``."""
    return built_once(df, _of_column, text_col, rules, occurrences)


def _of_column(text_col: str, rules: tuple[Rule, ...], occurrences: str) -> Column:
    return detections(F.col(text_col), rules, occurrences)


def detect(
    df: DataFrame,
    text_col: str = "text",
    policy: Policy = Policy(),
    custom: Iterable[Rule] = (),
    occurrences: str = "first",
    out: str = "detections",
) -> DataFrame:
    """Add the detections of every rule the policy leaves on."""
    return df.withColumn(out, column_detections(df, text_col, active_rules(policy, custom), occurrences))


def detect_type(df: DataFrame, kind: str, text_col: str = "text", occurrences: str = "first") -> DataFrame:
    """Add the detections of the built-in rules of one type."""
    rules = tuple(r for r in BUILT_IN if r.type == kind)
    return df.withColumn("detections", column_detections(df, text_col, rules, occurrences))


def explode_detections(df: DataFrame, keys: Sequence[str], column: str = "detections") -> DataFrame:
    """One row per detection: the keys, its position ``seq`` and its fields.

    Filtering after an outer explode keeps the optimizer from copying the whole
    detection expression into a filter in front of it.
    """
    exploded = df.select(*keys, F.posexplode_outer(column).alias("seq", "d"))
    return exploded.where(F.col("d").isNotNull()).select(*keys, "seq", "d.*")
