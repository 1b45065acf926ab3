r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context and only its text is trainable.
A turn is `<|im_start|>role\ntext<|im_end|>\n`. Inside texts and roles each `<` followed by backslashes
(or none) and `|` gets one more backslash, and in roles backslash and newline are escaped too, so no
text can hold a control string and all of it can be read back. A conversation that doesn't end in an
assistant turn has one more example, all context, so that no turn is lost.

A conversation lies in one row of the output anyway (its last example), so its turns are gathered in one
task; conversations are never mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    parts = F.transform(F.split(unescaped(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): loss is the half-open range of characters that train,
    empty (-1, -1) for an example of context only.

    Turns go by turn, then role, then text; null roles and texts are empty, a null turn comes first, rows
    of a null conv_id make up one conversation. Repeated rows are turns of their own, an empty table gives
    no rows, other columns are ignored.
    """
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    convs = rows.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = convs.withColumn("said", F.transform("turns", lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))))
    trained = F.transform(F.col("turns"), lambda t, i: F.when((t["role"] == target) | (i == F.size("turns") - 1), i))
    ends = convs.select("conv_id", "turns", "said", F.posexplode(F.filter(trained, lambda i: i.isNotNull())).alias("example", "at"))
    text = F.array_join(F.slice("said", F.lit(1), F.col("at") + 1), "")
    trains = F.get("turns", F.col("at"))["role"] == target
    stop = F.char_length(text) - len(END + "\n")
    begin = stop - F.char_length(escaped(F.get("turns", F.col("at"))["text"]))
    return ends.select("conv_id", "example", text.alias("text"), F.when(trains, begin).otherwise(-1).alias("loss_start"), F.when(trains, stop).otherwise(-1).alias("loss_end"))


def turns_of(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.slice(F.split(text, r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split(text, r"<\|im_start\|>", -1)) - 1, F.lit(0)))

    def turn(p):
        body = F.substring(p, F.lit(1), F.char_length(p) - len(END + "\n"))
        cut = F.instr(body, "\n")
        return F.struct(_role_back(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(body, cut + 1, F.char_length(body))).alias("text"))

    return F.transform(parts, turn)


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, read back from them: a row per conversation with its number of turns,
    the digest of all turns (from the last example), of all text under the loss masks, and its characters."""
    loss = F.when(F.col("loss_start") >= 0, unescaped(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    each = examples.select("conv_id", "example", "text", loss.alias("loss"))
    whole = each.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"), F.array_sort(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))).alias("losses"),
        F.sum(F.char_length("text")).cast("long").alias("formatted_chars"),
    )
    whole = whole.select("conv_id", turns_of(F.col("last")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
