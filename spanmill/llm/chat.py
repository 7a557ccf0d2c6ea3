"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of
one role are merged into a block by array functions, and the pieces are
concatenated:

    <s>[INST]role[/INST]text[NEXT]text of the next turn, same role</s>

Control strings inside roles and texts get a backslash after their first
character (one more where some are there already), which reading back removes,
so any text survives.  ``loss_spans`` gives the code points of the formatted
text that are trained on: the (escaped) texts of the trained roles.

Turns are ordered by turn (nulls first), then role, then text; so repeated
turns keep each row and ties have one result.  A null role or text counts as
empty, and rows with a null conv_id form one conversation with a null id.  A
conversation of n turns takes about n * sqrt(n) small steps, and no copy of its
text for every turn.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SAID, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[NEXT]", "</s>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\]|NEXT\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST\]|NEXT\])", r"[$1$2")


def format_conversations(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) -> (conv_id, n_blocks, formatted, loss_spans array<struct<start, stop>>)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))

    # a block begins where the role changes; it holds the turns up to the next beginning
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    found = collected.select("conv_id", "turns", begins.alias("begins"))
    turns_of = F.transform(
        "begins", lambda b, k: F.slice("turns", b + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - b)
    )
    blocks = found.select("conv_id", F.transform(turns_of, lambda ts: F.struct(F.get(ts, 0)["role"].alias("role"), F.transform(ts, lambda t: escape(t["text"])).alias("texts"))).alias("blocks"))

    # each block as pieces: marks, and texts with their loss
    def pieces(b: Column) -> Column:
        loss = b["role"].isin(*trained)
        head = F.struct(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(SAID)).alias("piece"), F.lit(False).alias("loss"))
        said = F.transform(b["texts"], lambda t, i: F.array(F.struct(F.when(i > 0, NEXT).otherwise("").alias("piece"), F.lit(False).alias("loss")), F.struct(t.alias("piece"), loss.alias("loss"))))
        tail = F.struct(F.lit(CLOSE).alias("piece"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), F.flatten(said), F.array(tail))

    laid = blocks.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    measured = laid.withColumn("starts", running_starts(F.transform("pieces", lambda p: F.length(p["piece"]))))
    spans = F.filter(
        F.zip_with("pieces", "starts", lambda p, s: F.when(p["loss"], F.struct(s.alias("start"), (s + F.length(p["piece"])).alias("stop")))), lambda x: x.isNotNull()
    )
    return measured.select("conv_id", "n_blocks", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _runs(n: Column) -> Column:
    """Starts of runs of about sqrt(n) elements."""
    return _let(F.ceil(F.sqrt(n)).cast("int"), lambda w: F.transform(F.sequence(F.lit(0), n - 1, w), lambda s: F.struct(s.alias("s"), w.alias("w"))))


def running_starts(lengths: Column) -> Column:
    """Where each element begins when they lie one after another.  Sums are taken within
    runs of about sqrt(n) elements and over the runs, so no array is copied for every element."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def inside(part: Column, base: Column) -> Column:
        return F.transform(part, lambda x, i: base + total(F.slice(part, F.lit(1), i)))

    def made(xs: Column) -> Column:
        parts = F.transform(_runs(F.size(xs)), lambda r: F.slice(xs, r["s"] + 1, r["w"]))

        def placed(ps: Column) -> Column:
            sums = F.transform(ps, total)
            return _let(sums, lambda t: F.flatten(F.transform(ps, lambda p, k: inside(p, total(F.slice(t, F.lit(1), k))))))

        return F.when(F.size(xs) > 0, _let(parts, placed)).otherwise(F.array().cast("array<int>"))

    return _let(lengths, made)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, each turn apart again."""

    def block(b: Column) -> Column:
        said = F.instr(b, SAID)
        role = unescape(F.substring(b, F.lit(1), said - 1))
        body = F.substring(b, said + len(SAID), F.length(b) - said - len(SAID) - len(CLOSE) + 1)
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.slice(F.split(formatted, r"<s>\[INST\]", -1), F.lit(2), F.length(formatted) + 1)
    return F.flatten(F.transform(blocks, block))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped.  The text is first cut around runs of
    spans, so that a span is looked up in its part only."""

    def cut(part: Column) -> Column:
        first, last = F.get(part, 0)["start"], F.element_at(part, -1)["stop"]
        around = F.substring(formatted, first + 1, last - first)
        return _let(around, lambda text: F.array_join(F.transform(part, lambda s: unescape(F.substring(text, s["start"] - first + 1, s["stop"] - s["start"]))), ""))

    def made(xs: Column) -> Column:
        return F.array_join(F.transform(F.transform(_runs(F.size(xs)), lambda r: F.slice(xs, r["s"] + 1, r["w"])), cut), "")

    return F.when(F.size(spans) > 0, _let(spans, made)).otherwise("")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and the mask say when they are read back."""
    read = formatted.withColumns({"_turns": read_turns(F.col("formatted")), "_loss": read_loss(F.col("formatted"), F.col("loss_spans"))})
    spoken = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
