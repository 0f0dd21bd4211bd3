"""Chat formatting in budgeted windows of whole turns.

Prefix sums of turn tokens choose spans of turns; every window repeats the system turn and a limited number of earlier
turns, and only answers that are new in a window are under the loss mask. Everything is windows and array functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>\n"
#: Tokens that a turn's marks cost besides its text.
MARKS = 4


def escape(c):
    """Reversible: afterwards <| does not occur."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c):
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def tokens(c):
    """A bound that no byte-level tokenizer exceeds: the bytes of the text, and its marks."""
    return F.octet_length(c).cast("long") + MARKS


def format_windows(conversations: DataFrame, budget: int = 4096, history_tokens: int = 1024, history_turns: int = 4) -> DataFrame:
    """conv_id, window (from 1), formatted, n_context and loss spans (start, length; code points) of all conversations.

    Budgets are in tokens by their upper bound (tokens), so a window has no more of them whatever the tokenizer.
    A window has the system turn (if the first turn is one), at most history_turns earlier turns of at most
    history_tokens, and new turns, together within budget; a single turn beyond it stands whole in a window of its own.
    A system turn that leaves less than 64 tokens is kept whole all the same, and new turns get 64.
    The first n_context turns of a window are repeated ones. Turns are ordered by turn, ties by role and text; repeated
    rows are turns of their own; null texts and roles are empty, null conv_ids are one conversation. No rows give none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"i": F.row_number().over(order), "tok": tokens(F.col("text"))})
    rows = rows.withColumns({"sys": (F.col("i") == 1) & (F.col("role") == "system"), "first_role": F.first("role").over(upto), "first_text": F.first("text").over(upto), "first_tok": F.first("tok").over(upto)})
    has_sys = F.col("first_role") == "system"
    room = F.greatest(F.lit(budget - history_tokens) - F.when(has_sys, F.col("first_tok")).otherwise(0), F.lit(64))
    rows = rows.withColumns({"half": F.floor(room / 2), "own": F.when(F.col("sys"), 0).otherwise(F.col("tok"))})
    rows = rows.withColumn("upto", F.sum("own").over(upto)).withColumn("before", F.col("upto") - F.col("own"))
    rows = rows.withColumns({"bin": F.floor(F.col("upto") / F.col("half")), "long": F.col("own") > F.col("half")})
    turned = (F.lag("bin").over(order) != F.col("bin")) | F.col("long") | F.lag("long").over(order) | F.lag("sys").over(order)
    alone = F.col("sys") & F.lead("i").over(order).isNull()
    rows = rows.withColumns({"alone": alone, "opens": F.when(F.col("sys"), alone).otherwise(F.coalesce(turned, F.lit(True)))})
    rows = rows.withColumn("window", F.sum(F.col("opens").cast("int")).over(upto))
    for d in range(1, history_turns + 1):
        near = F.lead("opens", d).over(order) & (F.lead("before", d).over(order) - F.col("before") <= history_tokens) & ~F.col("sys")
        rows = rows.withColumn(f"again{d}", F.when(near, F.lead("window", d).over(order)))
    entry = lambda window, i, new, r, t: F.struct(window.alias("window"), i.cast("int").alias("i"), new.alias("new"), r.alias("role"), t.alias("text"))
    this = lambda window, new: entry(window, F.col("i"), F.lit(new), F.col("role"), F.col("text"))
    entries = F.array_compact(F.array(
        F.when(~F.col("sys") | F.col("alone"), this(F.col("window"), True)),
        F.when(F.col("opens") & has_sys & ~F.col("sys"), entry(F.col("window"), F.lit(1), F.col("window") == 1, F.col("first_role"), F.col("first_text"))),
        *(F.when(F.col(f"again{d}").isNotNull(), this(F.col(f"again{d}"), False)) for d in range(1, history_turns + 1)),
    ))
    turns = rows.select("conv_id", F.explode(entries).alias("e")).select("conv_id", "e.*")
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turns = turns.select("conv_id", "window", "i", "new", (F.col("new") & (F.col("role") == "assistant")).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    grouped = turns.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("i", "new", "loss", "head", "body"))).alias("t"))
    at = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(STOP)).alias("at"),
            F.when(x["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(STOP))), "")
    return grouped.select("conv_id", "window", formatted.alias("formatted"), F.size(F.filter("t", lambda x: ~x["new"])).alias("n_context"), at.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text) that are new in the window, and the text under its loss mask, unescaped."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), F.col("n_context") + 2, F.size(F.split("formatted", r"<\|im_start\|>")))

    def turn(p):
        body = F.substring(p, F.lit(1), F.length(p) - len(STOP))
        role = F.regexp_replace(F.substring_index(body, "\n", 1), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.instr(body, "\n") + 1, F.length(body))).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", "formatted", F.transform(parts, turn).alias("turns"), masked.alias("masked"))


def digest(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted windows."""
    read = read_back(windows)
    each = read.select(
        "conv_id", "window", F.size("turns").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("masked", "").alias("masked"),
    )
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "said", "masked"))).alias("w"))
    joined = whole.select("conv_id", "n_turns", "formatted_chars", F.array_join("w.said", "").alias("said"), F.array_join("w.masked", "").alias("masked"))
    return joined.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")
