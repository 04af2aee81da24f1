"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all turns before it as
context, only its own text under the loss mask. A conversation that does not
end with an assistant turn also gives one record without a target, so that
reading the output back recovers every turn.

Template: ``<|turn|>role\\n`` text ``<|end|>``. In texts and roles ``&``,
``<`` and ``[`` are written as character references (roles also escape the
line break), so neither these marks nor other templates' control strings can
arise from a text, and unescaping restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"


def escape(text: Column) -> Column:
    for raw, mark in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for raw, mark in (("\n", "&#10;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, lone, example, n_turns, formatted, loss_start, loss_chars).

    ``example`` counts from 0; offsets are code points of ``formatted``. The
    record without a target has ``loss_chars`` null. Turns that share a number
    are ordered by role, then text, and repeated rows are turns of their own; a
    null role or text is empty; a null turn number comes first. A row without
    ``conv_id`` can't be told to belong to any other: it is a conversation of
    its own, which ``lone`` numbers (null for all others). An empty table gives
    no example; texts of any length stay whole; other columns are left out.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    listed = turns.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n"))
    marked = listed.select(
        "conv_id",
        "lone",
        F.transform("ts", lambda t: F.struct((t["role"] == "assistant").alias("target"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("ts"),
    )
    numbered = marked.select("conv_id", "lone", F.size("ts").alias("total"), F.posexplode("ts").alias("at", "t"), "ts")
    chosen = numbered.filter(F.col("t.target") | (F.col("at") == F.col("total") - 1))
    prefix = F.array_join(F.transform(F.slice("ts", 1, F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    start = F.concat(prefix, F.col("t.head"))
    return chosen.select(
        "conv_id",
        "lone",
        F.col("at").alias("example"),
        (F.col("at") + 1).alias("n_turns"),
        F.concat(start, F.col("t.body"), F.lit(CLOSE)).alias("formatted"),
        F.length(start).cast("long").alias("loss_start"),
        F.when(F.col("t.target"), F.length("t.body").cast("long")).alias("loss_chars"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted example as array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda x: x != "")
    inner = lambda x: F.substring(x, len(OPEN) + 1, F.length(x))
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring_index(inner(x), "\n", 1)).alias("role"),
            unescape(F.substring(inner(x), F.length(F.substring_index(inner(x), "\n", 1)) + 2, F.length(x))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation (and row without one), from the examples as read back: turns, loss text and size."""
    loss = F.when(F.col("loss_chars").isNotNull(), F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss")))
    per = examples.groupBy("conv_id", "lone").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = parse_turns(F.col("longest"))
    said = per.select("conv_id", "formatted_chars", turns.alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
