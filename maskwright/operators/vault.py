"""The token vault: which token stands for which value, per conversation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.functions.arrays import let
from maskwright.operators.ordered import last_write_before, running_number
from maskwright.operators.redact import cover, explode_tokens, substitute, token, tokens_in, tokens_of
from maskwright.operators.synthesize import safe_fake, shapes
from maskwright.session import cut_lineage

# A token in brackets, whatever its type is called.
BRACKETED = r"\[[^\[\]]+\]"


def vault_rows(sanitized: DataFrame) -> DataFrame:
    """One row per token of every scanned turn."""
    return explode_tokens(sanitized, ["conv_id", "turn"]).select("conv_id", "turn", "seq", "token", "value")


def merge_token_map(vault: DataFrame) -> DataFrame:
    """The map of every conversation, one row per token; the newest value wins."""
    return vault.groupBy("conv_id", "token").agg(
        F.max_by("value", F.struct("turn", "seq")).alias("value")
    )


def drop_session_tokens(vault: DataFrame, closed: DataFrame) -> DataFrame:
    """Remove the tokens of closed conversations."""
    return vault.join(closed.select("conv_id").distinct(), "conv_id", "left_anti")


def plain_token_lengths(vault: DataFrame) -> list[int]:
    """Distinct lengths of tokens that are not in brackets, such as synthetic values."""
    plain = vault.where(~F.rlike("token", F.lit(rf"\A{BRACKETED}\z")))
    return sorted(r.n for r in plain.select(F.length("token").alias("n")).distinct().collect())


def token_candidates(text: Column, lengths: Sequence[int] = ()) -> Column:
    """Every distinct piece of a text that could be a token.

    Pieces in brackets, and for tokens of another shape all pieces of the given
    lengths; looking them up by equality finds exactly the tokens contained.
    """
    bracketed = F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(0))
    if not lengths:
        return F.array_distinct(bracketed)
    pieces = F.flatten(
        F.transform(
            F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(text)),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length(text) - n + 1), lambda p: F.substring(text, p, n)
            ),
        )
    )
    return F.array_distinct(F.concat(bracketed, pieces))


def synthetic_candidates(text: Column) -> Column:
    """Every distinct piece of a text that looks like a fake value, or stands in brackets."""
    # Looked for at every place: the shapes of two values may overlap.
    found = [F.regexp_extract_all(text, F.lit(f"(?=({s}))"), F.lit(1)) for s in shapes()]
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(0)), *found))


#: Characters of the piece of a token by which answers look it up; shorter tokens are looked up whole.
ANCHOR = 4


def _pieces(text: Column, size: Column) -> Column:
    """All pieces of a text with a number of characters."""
    return F.when(
        size <= F.length(text), F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda p: F.substring(text, p, size))
    ).otherwise(F.array().cast("array<string>"))


def _all_pieces(text: Column, size: int) -> Column:
    """All pieces of a text with a number of characters, and maybe some that begin within a character of two units."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


#: Tokens of a conversation that are looked for one by one.
FEW = 64


def contained_tokens(responses: DataFrame, vault: DataFrame, text_col: str = "text") -> DataFrame:
    """``conv_id, turn, token``: the tokens of any shape that an answer of their conversation contains.

    Where a conversation has up to ``FEW`` tokens, each of them is looked for in its answers.  With more of them, each has
    an anchor, the one of its pieces of ``ANCHOR`` characters that the fewest tokens have (the first by
    spelling of these).  An answer gives a row for each of its pieces of that size, whatever the lengths of the tokens;
    where a piece is an anchor, the whole token is looked for in the answer.
    """
    # Read for both ways; its rows are short.
    tokens = cut_lineage(vault.where((F.length("token") > 0) & ~F.rlike("token", F.lit(rf"\A{BRACKETED}\z"))).select("conv_id", "token").distinct())
    counts = tokens.groupBy("conv_id").agg(F.count("*").alias("n"))
    few = tokens.join(counts.where(F.col("n") <= FEW), "conv_id", "left_semi").groupBy("conv_id").agg(F.collect_list("token").alias("_tokens"))
    direct = (
        responses.where(F.col("turn").isNotNull()).select("conv_id", "turn", F.col(text_col).alias("_text")).join(few, "conv_id")
        .select("conv_id", "turn", F.explode(F.filter("_tokens", lambda t: F.contains("_text", t))).alias("token")).distinct()
    )
    held = tokens.join(counts.where(F.col("n") > FEW), "conv_id", "left_semi")
    size = F.least(F.length("token"), F.lit(ANCHOR))
    cut = held.select("token").distinct().select("token", F.explode(F.array_distinct(_pieces(F.col("token"), size))).alias("anchor"))
    often = cut.groupBy("anchor").agg(F.count("*").alias("n"))
    anchors = cut.join(often, "anchor").groupBy("token").agg(F.min_by("anchor", F.struct("n", "anchor")).alias("anchor"))
    # Read twice: for its sizes, of which there are at most ANCHOR, and for the join.
    keyed = cut_lineage(held.join(anchors, "token"))
    sizes = sorted(r.n for r in keyed.select(F.length("anchor").alias("n")).distinct().collect())
    if not sizes:
        return direct
    text = F.col(text_col)
    asked = responses.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(*[_all_pieces(text, n) for n in sizes]))).alias("anchor"))
    hits = asked.join(keyed, ["conv_id", "anchor"]).select("conv_id", "turn", "token").distinct()
    found = hits.join(responses.select("conv_id", "turn", text.alias("_text")), ["conv_id", "turn"]).where(F.contains("_text", "token"))
    return direct.unionByName(found.select("conv_id", "turn", "token").distinct())


def candidate_rows(
    responses: DataFrame, vault: DataFrame | None, text_col: str = "text", synthetic: bool = False
) -> DataFrame:
    """One row per (answer, possible token); with a vault also those of its tokens that are not in brackets."""
    pieces = synthetic_candidates(F.col(text_col)) if synthetic else token_candidates(F.col(text_col))
    rows = responses.select("conv_id", "turn", F.explode_outer(pieces).alias("token")).where(F.col("token").isNotNull())
    if synthetic or vault is None:
        return rows
    return rows.unionByName(contained_tokens(responses, vault, text_col)).distinct()


def token_history(vault: DataFrame) -> DataFrame:
    """``conv_id, token, writes``: what every token has stood for, in order (``turn, seq, value``), without writes that change
    nothing.  Numbered through a conversation a token has one."""
    return vault.groupBy("conv_id", "token").agg(F.array_sort(F.collect_list(F.struct("turn", "seq", "value"))).alias("writes")).withColumn(
        "writes", F.filter("writes", lambda w, i: (i == 0) | ~w["value"].eqNullSafe(F.get(F.col("writes"), i - 1)["value"]))
    )


def value_before(asked: DataFrame, history: DataFrame) -> DataFrame:
    """``conv_id, turn, token, value`` as of the turn of each asked row, by one equi-join with a history.

    A history that is stored in buckets by its keys (``sources.tables.write_vault_table``) is not shuffled.
    """
    last = F.try_element_at(F.filter("writes", lambda w: w["turn"] < F.col("turn")), F.lit(-1))
    return asked.join(history, ["conv_id", "token"]).select("conv_id", "turn", "token", last["value"].alias("value"))


def _replaced(text: Column, entries: Column) -> Column:
    """The text with tokens (``struct<token, value>``) replaced, all in one pass: values are not searched again.

    Tokens in brackets are cut out by one pattern and looked up in a map.  Tokens of another shape are replaced first,
    the longest first, by a mark that stands for their place in the list, then the marks by their values.
    """
    bracketed = lambda e: F.rlike(e["token"], F.lit(rf"\A{BRACKETED}\z"))

    def in_brackets(source: Column, known: Column, values: Callable[[Column, Column], Column]) -> Column:
        parts = F.struct(
            F.regexp_extract_all(source, F.lit(BRACKETED), F.lit(0)).alias("found"), F.split(source, BRACKETED, -1).alias("gaps")
        )
        return let(
            parts,
            lambda p: F.array_join(
                F.transform(p["gaps"], lambda g, i: F.concat(g, F.when(i < F.size(p["found"]), values(F.get(p["found"], i), known)).otherwise(""))), ""
            ),
        )

    def looked_up(token: Column, known: Column) -> Column:
        return F.coalesce(F.try_element_at(known, token), token)

    def with_shapes(plain: Column) -> Column:
        marked = F.aggregate(
            F.transform(plain, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
            F.translate(text, "\x01\x02", "\x03\x04"),
            lambda acc, x: F.replace(acc, x["e"]["token"], F.concat(F.lit("\x01"), x["i"].cast("string"), F.lit("\x02"))),
        )
        return let(
            F.split(in_brackets(marked, F.map_from_entries(F.filter(entries, bracketed)), looked_up), "\x01", -1),
            lambda parts: F.array_join(
                F.transform(
                    parts,
                    lambda q, i: F.when(i == 0, q).otherwise(
                        F.concat(
                            F.get(plain, F.split_part(q, F.lit("\x02"), F.lit(1)).cast("int"))["value"],
                            F.substring(q, F.position(F.lit("\x02"), q) + 1, F.length(q)),
                        )
                    ),
                ),
                "",
            ),
        )

    plain = F.transform(
        F.reverse(F.array_sort(F.transform(F.filter(entries, lambda e: ~bracketed(e)), lambda e: F.struct(F.length(e["token"]).alias("n"), e.alias("e"))))),
        lambda x: x["e"],
    )
    only_brackets = let(F.map_from_entries(entries), lambda known: in_brackets(text, known, looked_up))
    return let(plain, lambda ps: F.when(F.size(ps) == 0, only_brackets).otherwise(with_shapes(ps)))


def restore(
    responses: DataFrame, vault: DataFrame, text_col: str = "text", any_shape: bool = False, synthetic: bool = False
) -> DataFrame:
    """Add ``restored``: tokens replaced by the values they had when the answer came.

    Only tokens that occur in an answer are looked up, as of its turn; unknown
    tokens stay.  All are replaced at once, where tokens overlap the longer one.
    Set ``synthetic`` for vaults with the values of ``synthesize``, and
    ``any_shape`` for tokens of any other shape: then all pieces of an answer that
    have the length of an anchor are looked up (``contained_tokens``).  The vault may
    also be a history (``token_history``), which is joined where it lies.
    """
    asked = candidate_rows(responses, vault if any_shape else None, text_col, synthetic)
    if "writes" in vault.columns:
        known = value_before(asked, vault)
    else:
        # Read twice below; the texts are searched once.
        known = last_write_before(cut_lineage(asked), vault, ["conv_id", "token"], "turn", "value", tie="seq")
    entries = (
        known.where(F.col("value").isNotNull())
        .groupBy("conv_id", "turn")
        .agg(F.collect_set(F.struct("token", "value")).alias("_entries"))
    )
    return (
        responses.join(entries, ["conv_id", "turn"], "left")
        .withColumn("restored", F.when(F.col("_entries").isNull(), F.col(text_col)).otherwise(_replaced(F.col(text_col), F.col("_entries"))))
        .drop("_entries")
    )


def restore_with_map(text: Column, token_map: Column) -> Column:
    """Replace the tokens of a map held in the same row."""
    entries = F.transform(F.map_entries(token_map), lambda e: F.struct(e["key"].alias("token"), e["value"].alias("value")))
    return F.when(F.size(token_map) > 0, let(entries, lambda es: _replaced(text, es))).otherwise(text)


def redact_conversations(
    turns: DataFrame, text_col: str = "text", detections_col: str = "detections", keys: Sequence[str] = ("conv_id", "turn"),
    known: DataFrame | None = None,
) -> DataFrame:
    """Redact with token numbers that run through the whole conversation (the first of ``keys``).

    Equal values of a conversation share one token and different values never
    do, so merging the maps of its turns loses nothing.  ``detections`` must
    list every occurrence.  Numbers follow the first appearance, and start behind
    the tokens that the texts hold already.  ``known`` (``conv_id, type, value,
    n``) has values that were numbered before; they keep their numbers.
    """
    return rewrite_conversations(turns, text_col, detections_col, keys, lambda s: token(s["type"], s["n"]), known)


def synthesize_conversations(
    turns: DataFrame, seed: int = 0, text_col: str = "text", detections_col: str = "detections",
    keys: Sequence[str] = ("conv_id", "turn"), known: DataFrame | None = None,
) -> DataFrame:
    """As ``redact_conversations`` with fake values: within a conversation each stands for one original."""
    conv, text = F.coalesce(F.col(keys[0]).cast("string"), F.lit("")), F.col(text_col)
    return rewrite_conversations(
        turns, text_col, detections_col, keys, lambda s: safe_fake(s["type"], s["n"], seed, conv, s["value"], text), known
    )


def rewrite_conversations(
    turns: DataFrame, text_col: str, detections_col: str, keys: Sequence[str], label: Callable[[Column], Column],
    known: DataFrame | None = None,
) -> DataFrame:
    """Add ``sanitized`` and ``tokens``; ``label`` gives the replacement of a span with ``type``, ``value`` and its
    number ``n`` in the conversation.

    Rows are told apart by their keys and text, null or not; equal rows are rewritten alike, with the detections of one of
    them.  Rows without a conversation make up one of their own.
    """
    conv, order = keys[0], keys[1]
    key = F.md5(F.to_json(F.struct(*keys, F.md5(F.col(text_col).cast("binary")).alias("_text"))).cast("binary"))
    whose = F.to_json(F.struct(F.col(conv).alias("c")))
    rows = turns.select(
        key.alias("_row"), whose.alias("_conv"), F.coalesce(F.col(order).cast("long"), F.lit(-1)).alias("_turn"),
        F.col(detections_col).alias("_detections"), cover(F.col(text_col), F.col(detections_col)).alias("_spans"),
        tokens_in(F.col(text_col)).alias("_held"),
    )
    # Detection runs here only: what was found is kept beside the rows, without their texts, and joined back below.
    rows = cut_lineage(rows.where((F.size("_detections") > 0) | (F.size("_held") > 0)))
    found = (
        rows.select("_row", "_conv", "_turn", F.posexplode_outer("_spans").alias("_i", "_s"))
        .where(F.col("_s").isNotNull()).select("_row", "_conv", "_turn", "_i", "_s.type", "_s.value", "_s.start", "_s.end").distinct()
    )
    value_keys = ["_conv", "type", "value"]
    held = rows.select("_conv", F.explode("_held").alias("t")).select("_conv", "t.type", "t.n")
    new = found.groupBy(*value_keys).agg(F.min(F.struct("_turn", "_i")).alias("f")).select(
        *value_keys, F.col("f._turn").alias("_turn"), F.col("f._i").alias("_i")
    )
    if known is not None:
        known = known.select(F.to_json(F.struct(F.col("conv_id").cast(turns.schema[conv].dataType).alias("c"))).alias("_conv"), "type", "value", F.col("n").cast("long"))
        held = held.unionByName(known.select("_conv", "type", "n"))
        new = new.join(known, value_keys, "left_anti")
    largest = held.groupBy("_conv", "type").agg(F.max("n").alias("_largest"))
    numbered = (
        running_number(new, ["_conv", "type"], ["_turn", "_i"], "n").join(largest, ["_conv", "type"], "left")
        .select(*value_keys, (F.col("n") + F.coalesce("_largest", F.lit(0))).cast("long").alias("n"))
    )
    if known is not None:
        numbered = numbered.unionByName(known.groupBy(*value_keys).agg(F.min("n").alias("n")))
    per_row = (
        found.join(numbered, value_keys).groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "type", "value", "n"))).alias("_numbered"))
    )
    kept = rows.where(F.size("_detections") > 0).groupBy("_row").agg(F.first("_detections").alias("_detections"))
    per_row = kept.join(per_row, "_row", "left")
    spans, text = F.col("_numbered"), F.col(text_col)
    done = let(
        F.transform(spans, label),
        lambda labels: F.struct(substitute(text, spans, labels).alias("sanitized"), tokens_of(spans, labels).alias("tokens")),
    )
    untouched = F.struct(text.alias("sanitized"), F.array().cast(schemas.TOKENS).alias("tokens"))
    done_type = f"struct<sanitized:string,tokens:{schemas.TOKENS}>"
    # Better no result than a text that goes out as it came.
    lost = F.raise_error(F.lit("a detected value has no number")).cast(done_type)
    nothing = F.array().cast(turns.schema[detections_col].dataType)
    columns = [F.coalesce("_detections", nothing).alias(c) if c == detections_col else F.col(c) for c in turns.columns]
    return (
        turns.drop(detections_col).withColumn("_row", key).join(per_row, "_row", "left")
        .withColumn("_done", F.when(spans.isNotNull(), done).when(F.size("_detections") > 0, lost).otherwise(untouched))
        .select(*columns, F.col("_done.sanitized").alias("sanitized"), F.col("_done.tokens").alias("tokens"))
    )
