"""Dictionary tagging of people, organisations and places, and merging with rule hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.functions.arrays import first_per_key, let, sums_before
from maskwright.policy import Policy

# Recogniser labels and the detection types they stand for.
LABELS = {"PERSON": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION", "GPE": "LOCATION"}
SURE, UNSURE = 0.82, 0.55
BALANCED_FROM = 0.7

WORD = r"[\p{L}\p{N}_]+"
LOOKUPS = ("join", "literal")

FOUND = "array<struct<type:string,value:string>>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def usable_entities(entities: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Dictionary rows a policy lets through: ``key, size, type, value``.

    ``key`` is the name as words joined by single spaces, ``size`` the number of words.
    """
    kind = F.get(
        F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), lambda k, _: k == F.col("label"))),
        F.lit(0),
    )
    rows = entities.select(
        F.array_join(words(F.col("name")), " ").alias("key"),
        F.size(words(F.col("name"))).alias("size"),
        kind.alias("type"),
        F.col("name").alias("value"),
    ).where(F.col("type").isNotNull() & (F.col("size") > 0))
    off = [t for t in set(LABELS.values()) if not policy.allows(t)]
    if off:
        rows = rows.where(~F.col("type").isin(*off))
    if policy.sensitivity == "light":
        rows = rows.where(F.lit(False))
    elif policy.sensitivity == "balanced":
        rows = rows.where(confidence(F.col("value")) >= BALANCED_FROM)
    return rows.distinct()


def confidence(value: Column) -> Column:
    return F.when(F.length(value) > 3, SURE).otherwise(UNSURE)


def grams(text: Column, sizes: Sequence[int], starts: Sequence[str] = ()) -> Column:
    """Distinct word sequences of the given sizes; ``starts`` limits their first word."""

    def of_words(ws: Column) -> Column:
        def begins(i: Column) -> Column:
            return F.get(ws, i).isin(*starts) if starts else F.lit(True)

        def of_size(indexes: Column, n: int) -> Column:
            return F.transform(
                F.filter(indexes, lambda i: i + n <= F.size(ws)),
                lambda i: F.array_join(F.slice(ws, i + 1, n), " "),
            )

        return let(
            F.filter(F.sequence(F.lit(0), F.size(ws) - 1), begins),
            lambda indexes: F.array_distinct(F.concat(*[of_size(indexes, n) for n in sizes])),
        )

    none = F.array().cast("array<string>")
    return let(words(text), lambda ws: F.when(F.size(ws) > 0, of_words(ws)).otherwise(none))


def find_entities(
    df: DataFrame, entities: DataFrame, text_col: str = "text", policy: Policy = Policy(), lookup: str | None = None
) -> DataFrame:
    """Add ``found``: the distinct (type, value) pairs of the dictionary that occur in a text.

    What is found depends on the text and the dictionary only.  ``lookup="join"``,
    the default for tables, looks every distinct text up once, by its digest: its
    word sequences are joined with the dictionary, and only hits come back.
    ``lookup="literal"``, the default for streams, writes the dictionary into the
    row expression: no join and no shuffle, but the names come to the driver and
    into the plan, so it suits dictionaries of some hundred names.  Both give the
    same result at any size.
    """
    lookup = lookup or ("literal" if df.isStreaming else "join")
    if lookup not in LOOKUPS:
        raise ValueError(f"lookup must be one of {LOOKUPS}, not {lookup!r}")
    usable = usable_entities(entities, policy)
    text, none = F.col(text_col), F.array().cast(FOUND)
    return _found_literally(df, usable, text, none) if lookup == "literal" else _found_by_join(df, usable, text, none)


def _found_literally(df: DataFrame, usable: DataFrame, text: Column, none: Column) -> DataFrame:
    rows = sorted(usable.collect())
    if not rows:
        return df.withColumn("found", none)
    names = F.array(
        *[F.struct(F.lit(r.key).alias("key"), F.lit(r.type).alias("type"), F.lit(r.value).alias("value")) for r in rows]
    )
    all_keys = sorted({r.key for r in rows})
    hits = F.filter(
        grams(text, sorted({r.size for r in rows}), sorted({k.split(" ")[0] for k in all_keys})),
        lambda g: g.isin(*all_keys),
    )
    found = let(
        hits,
        lambda hs: F.when(
            F.size(hs) > 0,
            F.array_sort(
                F.transform(
                    F.filter(names, lambda e: F.array_contains(hs, e["key"])),
                    lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value")),
                )
            ),
        ).otherwise(none),
    )
    return df.withColumn("found", F.coalesce(found, none))


def _found_by_join(df: DataFrame, usable: DataFrame, text: Column, none: Column) -> DataFrame:
    sizes = sorted(r.size for r in usable.select("size").distinct().collect())
    if not sizes:
        return df.withColumn("found", none)
    keyed = df.withColumn("_digest", F.md5(text.cast("binary")))
    texts = keyed.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.first(text).alias("_text"))
    # Words a name begins with are far fewer than word sequences: only sequences behind one of them are joined.  Words
    # travel with their place and without their text, so rows are in proportion to the words.
    openings = usable.select(F.split_part("key", F.lit(" "), F.lit(1)).alias("_word")).distinct()
    split = texts.select("_digest", words(F.col("_text")).alias("_words"))
    placed = split.select("_digest", F.posexplode("_words").alias("_i", "_word"))
    opened = placed.join(openings, "_word", "left_semi").groupBy("_digest").agg(F.collect_list("_i").alias("_at"))
    candidates = split.join(opened, "_digest").select("_digest", F.explode(_grams_at(F.col("_words"), sizes, F.col("_at"))).alias("key"))
    hits = (
        candidates.join(usable.select("key", "type", "value"), "key")
        .groupBy("_digest")
        .agg(F.sort_array(F.collect_set(F.struct("type", "value"))).alias("found"))
    )
    return keyed.join(hits, "_digest", "left").withColumn("found", F.coalesce("found", none)).drop("_digest")


def _grams_at(ws: Column, sizes: Sequence[int], places: Column) -> Column:
    """Distinct word sequences of the given sizes that begin at some places."""

    def of_size(n: int) -> Column:
        return F.transform(
            F.filter(places, lambda i: i + n <= F.size(ws)), lambda i: F.array_join(F.slice(ws, i + 1, n), " ")
        )

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


def locate(text: Column, found: Column, occurrences: str = "first") -> Column:
    """Turn found names into detections: at the first index of the name, or at all that are no part of a longer word."""

    def span(e: Column, start: Column) -> Column:
        return F.struct(
            start.alias("start"),
            e["type"].alias("type"),
            e["value"].alias("value"),
            (start + F.char_length(e["value"])).alias("end"),
        )

    if occurrences == "first":
        placed = F.filter(
            F.transform(found, lambda e: span(e, F.position(e["value"], text) - 1)),
            lambda s: s["start"] >= 0,
        )
    else:

        # A character that no name holds stands for the name; where the text holds it, another of the same width does.
        mark, clean = "\x01", F.translate(text, "\x01", "\x02")

        def all_of(e: Column) -> Column:
            gaps = F.split(F.replace(clean, e["value"], F.lit(mark)), mark, -1)
            size = F.char_length(e["value"])

            def spans(gs: Column) -> Column:
                def beside(i: Column, before: bool) -> Column:
                    """The character beside the i-th hit; of an empty gap it is the end of the hit next to it."""
                    gap = F.get(gs, i if before else i + 1)
                    edge, twin = (F.right, i == 0) if before else (F.left, i + 2 == F.size(gs))
                    near = (F.right if before else F.left)(e["value"], F.lit(1))
                    return F.when(gap != "", edge(gap, F.lit(1))).when(twin, F.lit("")).otherwise(near)

                inside = lambda i: F.rlike(beside(i, True), F.lit(WORD)) | F.rlike(beside(i, False), F.lit(WORD))
                steps = F.transform(gs, lambda g: F.char_length(g) + size)
                # The sums behind the first gap, behind the second, ... are the ends of the hits.
                return let(
                    sums_before(steps),
                    lambda ends: F.filter(
                        F.transform(
                            F.slice(ends, 2, F.size(ends)),
                            lambda end, i: F.when(~inside(i), span(e, end - size)),
                        ),
                        lambda s: s.isNotNull(),
                    ),
                )

            return let(gaps, spans)

        placed = F.flatten(F.transform(found, all_of))
    return F.transform(
        F.array_sort(placed),
        lambda s: F.struct(
            s["type"].alias("type"),
            s["value"].alias("value"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            confidence(s["value"]).alias("confidence"),
            F.lit("ner").alias("source"),
        ),
    ).cast(schemas.DETECTIONS)


def entity_tag(
    df: DataFrame,
    entities: DataFrame,
    text_col: str = "text",
    policy: Policy = Policy(),
    occurrences: str = "first",
    out: str = "entities",
    lookup: str | None = None,
) -> DataFrame:
    """Add the dictionary hits of every text as detections.

    One hit per (type, value), at the first index of the value in the text
    (``occurrences="first"``) or at every index (``"all"``); names whose exact
    spelling does not occur are dropped.  ``lookup`` as in ``find_entities``.
    """
    found = find_entities(df, entities, text_col, policy, lookup)
    return found.withColumn(out, locate(F.col(text_col), F.col("found"), occurrences)).drop("found")


def merge_entities(detections: Column, entities: Column, occurrences: str = "first") -> Column:
    """Append entity hits the rules have not found, and sort by start, rules first on ties."""

    def key(d: Column) -> Column:
        parts = [d["type"], d["value"]]
        return F.struct(*parts) if occurrences == "first" else F.struct(*parts, d["start"])

    merged = let(F.concat(detections, entities), lambda xs: first_per_key(xs, key))
    return F.transform(
        F.array_sort(
            F.transform(merged, lambda d, i: F.struct(d["start"].alias("start"), i.alias("i"), d.alias("d")))
        ),
        lambda x: x["d"],
    ).cast(schemas.DETECTIONS)
