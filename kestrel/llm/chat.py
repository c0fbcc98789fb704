"""Chat formatting from an event log (operator 5). DataFrame functions only.

A turn is written ``<s>ROLE[INST]TEXT[/INST]</s>`` and a line feed. Inside roles and texts a backslash is doubled and
each control string gets a backslash after its first character, so no control string of the template can occur in
them and the text comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SPLIT, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>\n"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: Events that discard what their turn said before.
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold (conv_id, turn, part, seq, event, role, text) into (conv_id, messages ARRAY<role, text>).

    Events of a turn apply in order of seq: `message` and `edit` set its text, `regenerate` clears it, `delta` appends.
    ``part`` separates messages that share a turn number. The log is dealt by conversation once; both groupings below
    use that. The last role named in a turn holds, null text and null roles are empty, and events that tie in all
    columns apply in the order of (event, role, text). Other columns are ignored. A conversation is one output string, so it is the unit
    that must fit a task.
    """
    log = events.select("conv_id", "turn", "part", "seq", "event", "role", "text").repartition("conv_id")
    turns = log.groupBy("conv_id", "turn", "part").agg(
        F.sort_array(F.collect_list(F.struct("seq", "event", "role", "text"))).alias("log")
    )
    last_reset = F.array_max(F.transform("log", lambda e, i: F.when(e["event"].isin(*RESETS), i).otherwise(F.lit(0))))
    said = F.filter("log", lambda e, i: (i >= F.col("from")) & (e["event"] != "regenerate"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    messages = turns.withColumn("from", last_reset).select(
        "conv_id",
        F.struct(
            "turn",
            "part",
            F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(F.transform(said, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
        ).alias("m"),
    )
    return messages.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("m")), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias(
            "messages"
        )
    )


def render(conversations: DataFrame) -> DataFrame:
    """Append ``formatted`` and ``loss_spans`` (start from 0 and length, in code points of ``formatted``; they cover the
    escaped text of assistant turns) to (conv_id, messages)."""
    parts = conversations.withColumn(
        "parts",
        F.transform("messages", lambda m: F.struct(escape(m["role"]).alias("role"), escape(m["text"]).alias("text"))),
    )
    turn = lambda p: F.concat(F.lit(OPEN), p["role"], F.lit(SPLIT), p["text"], F.lit(CLOSE + END))
    around = len(OPEN) + len(SPLIT) + len(CLOSE) + len(END)
    empty = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + around + F.length(p["role"]) + F.length(p["text"])).alias("at"),
            F.when(
                p["role"] == "assistant",
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + len(OPEN) + len(SPLIT) + F.length(p["role"])).alias("start"),
                            F.length(p["text"]).alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return parts.select(
        "conv_id", "messages", F.array_join(F.transform("parts", turn), "").alias("formatted"), spans.alias("loss_spans")
    )


def read_back(formatted: Column) -> Column:
    """ARRAY<role, text> parsed from a formatted conversation alone."""
    pieces = F.filter(F.split(formatted, "</s>\n", -1), lambda p: p != "")
    fields = lambda p: F.split(F.substr(p, F.lit(len(OPEN) + 1)), r"\[INST\]", 2)
    body = lambda x: F.substr(x, F.lit(1), F.length(x) - len(CLOSE))
    return F.transform(
        F.transform(pieces, fields),
        lambda f: F.struct(unescape(f[0]).alias("role"), unescape(body(f[1])).alias("text")),
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped, in order with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), ""
    )
