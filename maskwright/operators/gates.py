"""Row gates in front of a scan, and what is derived from a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.functions.text import at_least, is_blank, strip
from maskwright.operators.detect import detect
from maskwright.policy import Policy

# Supported chat hosts, in the order they are tried.
PLATFORMS = (("claude.ai", "claude"), ("chat.openai.com", "chatgpt"), ("gemini.google.com", "gemini"))
MIN_SNIPPET = 6
MIN_RESPONSE = 20

LOOKUPS = ("join", "literal")


def non_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop rows whose text is empty after trimming."""
    return df.where(F.col(text_col).isNotNull() & ~is_blank(F.col(text_col)))


def kill_switch(df: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame | None:
    """The pass-through result of a switched-off scanner, or nothing when it is on."""
    return None if policy.enabled else pass_through(df, text_col)


def pass_through(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Result columns of a text that is not scanned."""
    return df.withColumns(
        {
            "scanned": F.lit(False),
            "detections": F.array().cast(schemas.DETECTIONS),
            "sanitized": F.col(text_col),
            "tokens": F.array().cast(schemas.TOKENS),
            "semantic_hits": F.array().cast(schemas.HINTS),
            "pii_count": F.lit(0),
        }
    )


def normalise_allowlist(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case, non-empty, distinct entries."""
    domain = F.lower(strip(F.col("domain")))
    return df.select(domain.alias("domain")).where(F.length("domain") > 0).distinct()


def _contains_any(host: Column, domains: list[str]) -> Column:
    hit = F.lit(False)
    for d in domains:
        hit = hit | F.contains(host, F.lit(d))
    return hit


def mark_allowlisted(df: DataFrame, allowlist: DataFrame, host_col: str = "domain", lookup: str | None = None) -> DataFrame:
    """Add ``allowlisted``: the host contains an entry of the list.

    ``lookup="join"``, the default for tables, matches the distinct hosts: every
    piece of a host with the length of some entry is looked up by an equi-join,
    and the hosts found are joined back.  ``lookup="literal"``, the default for
    streams, writes the list into the row expression: nothing is joined, but the
    entries come to the driver and into the plan.  Neither way compares all hosts
    with all entries, and both give the same result at any size.
    """
    lookup = lookup or ("literal" if df.isStreaming else "join")
    if lookup not in LOOKUPS:
        raise ValueError(f"lookup must be one of {LOOKUPS}, not {lookup!r}")
    host = F.coalesce(F.col(host_col), F.lit(""))
    listed = allowlist.where(F.col("domain").isNotNull()).select("domain").distinct()
    if lookup == "literal":
        entries = F.array(*[F.lit(r.domain) for r in sorted(listed.collect())]).cast("array<string>")
        return df.withColumn("allowlisted", F.exists(entries, lambda d: F.contains(host, d)))

    # Host names are at most 253 characters, so there are few distinct lengths.
    sizes = [r.n for r in listed.select(F.length("domain").alias("n")).distinct().collect()]
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>"), lambda n: n <= F.length("_host")),
                lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(
                    F.transform(
                        F.sequence(F.lit(1), F.length("_host") - n + 1),
                        lambda p: F.substring(F.col("_host"), p, n),
                    )
                ),
            )
        )
    )
    hosts = df.select(host.alias("_host")).distinct()
    found = (
        hosts.select("_host", F.explode(pieces).alias("domain"))
        .join(listed, "domain", "left_semi")
        .select("_host", F.lit(True).alias("_hit"))
        .distinct()
    )
    return (
        df.withColumn("_host", host)
        .join(found, "_host", "left")
        .withColumn("allowlisted", F.coalesce("_hit", F.lit(False)))
        .drop("_host", "_hit")
    )


def drop_allowlisted(df: DataFrame, allowlist: DataFrame, host_col: str = "domain") -> DataFrame:
    """Keep the rows whose host is not allowlisted."""
    return mark_allowlisted(df, allowlist, host_col).where(~F.col("allowlisted")).drop("allowlisted")


def classify_platform(host: Column) -> Column:
    """Name of the first platform whose host name is contained, else null."""
    name = F.lit(None).cast("string")
    for known, platform in reversed(PLATFORMS):
        name = F.when(F.contains(host, F.lit(known)), F.lit(platform)).otherwise(name)
    return name


def supported_host(url: Column) -> Column:
    """The URL contains a supported host."""
    return _contains_any(url, [known for known, _ in PLATFORMS])


def snippet_scan(df: DataFrame, policy: Policy = Policy(), text_col: str = "text", custom=()) -> DataFrame:
    """Pasted snippets with personal data: count and distinct types, in order of appearance.

    Texts under six characters are ignored; only the rule layer runs.
    """
    if not policy.enabled:
        return df.where(F.lit(False)).withColumns(
            {"pii_count": F.lit(0), "pii_types": F.array().cast("array<string>")}
        )
    long_enough = df.where(at_least(F.col(text_col), MIN_SNIPPET))
    # The outer explode stands between the scan and the filter, which would
    # otherwise be pushed below it together with a second copy of the scan.
    scanned = detect(long_enough, text_col, policy, custom).withColumn(
        "_d", F.explode_outer(F.array("detections"))
    )
    return (
        scanned.where(F.size("_d") > 0)
        .withColumns(
            {
                "pii_count": F.size("_d"),
                "pii_types": F.array_distinct(F.transform("_d", lambda d: d["type"])),
            }
        )
        .drop("_d", "detections")
    )
