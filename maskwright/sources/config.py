"""Loading rule tables, allowlists and dictionaries."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.dialect import InvalidPattern, Untranslatable, to_jvm
from maskwright.functions.text import strip
from maskwright.operators.gates import normalise_allowlist
from maskwright.rules import HIGH, Rule

def normalise_rules(raw: DataFrame, *also: Column) -> DataFrame:
    """Trim, drop rules without type or pattern, upper-case the type, default the confidence."""
    return raw.select(
        *also,
        F.upper(strip(F.col("type"))).alias("type"),
        strip(F.col("pattern")).alias("pattern"),
        F.coalesce(F.when(F.col("confidence") != "", F.col("confidence")), F.lit(HIGH)).alias("confidence"),
    ).where((F.length("type") > 0) & (F.length("pattern") > 0))


def _compiles(spark: SparkSession, regex: str) -> bool:
    """Spark folds the constant expression on the driver; no task runs."""
    try:
        spark.range(1).select(F.rlike(F.lit(""), F.lit(regex))).first()
    except PySparkException:
        return False
    return True


def rules_from(raw: DataFrame) -> list[Rule]:
    """Custom rules of a table, in the order of its column ``ord`` (rows without one come last, as they are read).

    Order decides ties, and which of two equal hits is kept.  If any pattern is invalid there are no custom rules at
    all.  A valid pattern that the JVM cannot run raises: leaving it out would let texts pass unredacted.  Rules are part
    of the query plan and so come to the driver; they are a configuration.
    """
    spark = raw.sparkSession
    position = F.col("ord").cast("long") if "ord" in raw.columns else F.lit(None).cast("long")
    rows = normalise_rules(raw, position.alias("ord")).collect()
    rules = []
    for row in sorted(rows, key=lambda r: (r.ord is None, r.ord or 0)):
        try:
            regex = to_jvm(row.pattern)
        except InvalidPattern:
            return []
        if not _compiles(spark, regex):
            raise Untranslatable(f"rule {row.type}: {row.pattern}")
        rules.append(Rule(row.type, row.pattern, row.confidence, custom=True))
    return rules


def load_custom_rules(spark: SparkSession, path: str) -> list[Rule]:
    """User rules from JSON ``{type, pattern, confidence}``; an unreadable file means none."""
    try:
        return rules_from(spark.read.schema(schemas.CUSTOM_RULES).option("mode", "FAILFAST").json(path))
    except PySparkException:
        return []


def load_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Allowlisted host parts, from JSON or (by the ending) CSV; empty when there is no file."""
    reader = spark.read.schema(schemas.ALLOWLIST)
    try:
        raw = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.json(path)
    except PySparkException:
        raw = spark.createDataFrame([], schemas.ALLOWLIST)
    return normalise_allowlist(raw)


def load_entities(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary of names and labels, from parquet."""
    return spark.read.schema(schemas.ENTITIES).parquet(path)
