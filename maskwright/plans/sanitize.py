"""The prompt pipeline: gates, detection, merging, rewriting, hints, side outputs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.operators.detect import column_detections
from maskwright.operators.entities import entity_tag, merge_entities
from maskwright.operators.gates import kill_switch, mark_allowlisted
from maskwright.operators.hints import column_hints
from maskwright.operators.redact import redact
from maskwright.operators.synthesize import synthesize
from maskwright.operators.vault import redact_conversations, synthesize_conversations
from maskwright.policy import Policy
from maskwright.rules import Rule, active_rules


def sanitize(
    turns: DataFrame,
    policy: Policy = Policy(),
    allowlist: DataFrame | None = None,
    custom: Iterable[Rule] = (),
    entities: DataFrame | None = None,
    entities_col: str | None = None,
    keys: Sequence[str] = ("conv_id", "turn"),
    text_col: str = "text",
    mode: str = "safe",
    seed: int = 0,
    lookup: str | None = None,
    numbering: str | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Scan prompts and add the result columns.

    ``scanned``, ``detections``, ``sanitized``, ``tokens``, ``pii_count``,
    ``semantic_hits``, ``elapsed_ms`` (null), ``timing_jitter``.

    ``entities`` is a dictionary to tag with; ``entities_col`` names a column with
    hits of any other recogniser (an array of detections); ``lookup`` says how
    allowlist and dictionary are matched (``"join"`` or ``"literal"``, see there).
    ``numbering="conversation"``, the default in safe mode, numbers values through
    the whole conversation, the first of ``keys``: only then can an answer that
    quotes an earlier turn be restored.  ``numbering="text"`` starts again in every
    text; it is the default in reference mode and on streams, where it keeps the
    scan a narrow projection without state (``streaming.flow.conversation_stream``
    numbers conversations of a stream).  ``known`` (``conv_id, type, value, n``)
    has values that were numbered before.
    """
    side = {"elapsed_ms": F.lit(None).cast("long"), "timing_jitter": F.lit(policy.timing_jitter)}
    off = kill_switch(turns, policy, text_col)
    if off is not None:
        return off.withColumns({**side, "timing_jitter": F.lit(False)})

    occurrences = "all" if mode == "safe" else "first"
    df = turns
    if allowlist is None:
        df = df.withColumn("scanned", F.lit(True))
    else:
        df = mark_allowlisted(df, allowlist, lookup=lookup).withColumn("scanned", ~F.col("allowlisted")).drop("allowlisted")
    # Texts behind the gate are null to the detectors, which then do nothing.
    df = df.withColumn("_seen", F.when(F.col("scanned"), F.col(text_col)))
    found = F.coalesce(
        column_detections(df, "_seen", active_rules(policy, custom), occurrences),
        F.array().cast(schemas.DETECTIONS),
    )
    if entities is not None:
        df = entity_tag(df, entities, "_seen", policy, occurrences, "_entities", lookup)
        found = merge_entities(found, F.coalesce("_entities", F.array().cast(schemas.DETECTIONS)), occurrences)
    if entities_col is not None:
        extra = F.when(F.col("scanned"), F.col(entities_col).cast(schemas.DETECTIONS))
        found = merge_entities(found, F.coalesce(extra, F.array().cast(schemas.DETECTIONS)), occurrences)
    df = df.withColumn("detections", found).drop("_entities")
    numbering = numbering or ("conversation" if mode == "safe" and not turns.isStreaming else "text")
    if numbering == "conversation":
        if mode != "safe":
            raise ValueError("conversations are numbered in safe mode only")
        if policy.synthetic_mode:
            df = synthesize_conversations(df, seed, text_col, keys=keys, known=known)
        else:
            df = redact_conversations(df, text_col, keys=keys, known=known)
    elif policy.synthetic_mode:
        df = synthesize(df, keys, seed, text_col, mode=mode)
    else:
        df = redact(df, text_col, mode=mode)
    none = F.array().cast(schemas.HINTS)
    return df.withColumns(
        {
            # Distinct (type, value) pairs in either mode.
            "pii_count": F.size("detections") if mode == "reference" else F.size("tokens"),
            "semantic_hits": F.coalesce(column_hints(df, "_seen"), none) if policy.semantic_scrubbing else none,
            **side,
        }
    ).drop("_seen")
