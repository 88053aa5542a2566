"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, and rendered in one pass over the
array: a header where the role changes, the escaped text, a separator between turns that share a
role (they are merged into one block), an end mark where the block ends. Control strings inside
texts and roles are escaped reversibly, so the formatted string can be read back turn by turn. The
loss mask is a run-length code over the whole string.

A conversation becomes one string, so its turns have to meet in one row; its size is bounded by
what one string can hold (2 GB; half a billion characters to read it back under the mask), not by the
number of conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\s`` and ``<|`` becomes ``<\p``: no control string is left, and both can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chat(rows: DataFrame, loss_role: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask_runs.

    mask_runs is array<struct<chars int, loss boolean>>, three runs for each turn (what stands
    before its text, its text, what stands after it), which together cover formatted. Rows with
    equal turn numbers are ordered by role, then text; a null turn comes first. A null text or role
    counts as empty, null conversation ids form one conversation. An empty table gives no rows.
    """
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))))
    each = rows.groupBy(F.col(conv).alias("conv_id")).agg(turns.alias("turns")).withColumn("n", F.size("turns"))

    def render(x: Column, i: Column) -> Column:
        first = (i == 0) | (F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"] != x["role"])
        last = (i == F.col("n") - 1) | (F.col("turns")[F.least(i + 1, F.col("n") - 1)]["role"] != x["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))).otherwise("").alias("before"),
            escape(x["text"]).alias("body"),
            F.when(last, F.lit(END)).otherwise(F.lit(NEXT)).alias("after"),
            (x["role"] == F.lit(loss_role)).alias("loss"),
        )

    parts = each.select("conv_id", F.transform("turns", render).alias("parts"))
    runs = F.flatten(
        F.transform(
            "parts",
            lambda p: F.array(
                F.struct(F.length(p["before"]).alias("chars"), F.lit(False).alias("loss")),
                F.struct(F.length(p["body"]).alias("chars"), p["loss"].alias("loss")),
                F.struct(F.length(p["after"]).alias("chars"), F.lit(False).alias("loss")),
            ),
        )
    )
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        runs.alias("mask_runs"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted string, as array<struct<role string, text string>>, unescaped."""
    quoted = {x: x.replace("|", r"\|") for x in (END, NEXT)}
    blocks = F.filter(F.split(formatted, quoted[END]), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape_role(F.substr(head, F.lit(len(START) + 1)))
        texts = F.split(F.substr(block, F.length(head) + 2), quoted[NEXT])
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_ZERO = "cast(0 as bigint)"


def _running(xs: Column, of: Callable[[Column], Column]) -> Column:
    """Sums of all elements up to each one."""
    step = lambda s, x: F.struct((s["sum"] + of(x)).alias("sum"), F.array_append(s["all"], s["sum"] + of(x)).alias("all"))
    return F.aggregate(xs, F.struct(F.expr(_ZERO).alias("sum"), F.expr("cast(array() as array<bigint>)").alias("all")), step, lambda s: s["all"])


def _starts(chars: Column) -> Column:
    """Where each of the lengths begins, if they stand side by side: sums in blocks of about the square root of their number, so that the work is not quadratic."""
    width = F.greatest(F.ceil(F.sqrt(F.size(chars))), F.lit(1)).cast("int")
    blocks = F.when(F.size(chars) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / width).cast("int")), lambda b: F.slice(chars, b * width + 1, width)))
    blocks = F.coalesce(blocks, F.expr("cast(array() as array<array<int>>)"))
    sums = lambda bs: _running(bs, lambda b: F.aggregate(b, F.expr(_ZERO), lambda s, x: s + x))
    within = lambda b, before: F.zip_with(_running(b, lambda x: x), b, lambda end, x: before + end - x)
    placed = lambda bs, ends: F.flatten(F.transform(bs, lambda b, i: within(b, F.coalesce(F.get(ends, i - 1), F.expr(_ZERO)))))
    return _let(blocks, lambda bs: _let(sums(bs), lambda ends: placed(bs, ends)))


def under_mask(formatted: Column, mask_runs: Column) -> Column:
    """The pieces of a formatted string that the loss mask covers, as array<string>, still escaped.

    The string is cut in UTF-32, where a character's place follows from its number; in UTF-8 every cut
    would count from the start.
    """
    starts = _let(F.transform(mask_runs, lambda r: r["chars"]), _starts)
    placed = F.zip_with(mask_runs, starts, lambda r, at: F.struct(at.alias("at"), r["chars"].alias("chars"), r["loss"].alias("loss")))
    cut = lambda wide, p: F.decode(F.substr(wide, (4 * p["at"] + 1).cast("int"), 4 * p["chars"]), "UTF-32")
    return _let(F.encode(formatted, "UTF-32"), lambda wide: F.transform(F.filter(placed, lambda p: p["loss"]), lambda p: cut(wide, p)))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of format_chat's output finds: its turns, and the text that the mask's runs cover."""
    back = formatted.select(
        "conv_id",
        read_chat(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(under_mask(F.col("formatted"), F.col("mask_runs")), unescape), "").alias("under"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        "formatted_chars",
    )
