r"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is partitioned by conversation and sorted by sequence. For each turn a ``message`` starts a new
message, ``delta`` adds to the end of the turn's latest message, ``edit`` replaces its text and ``regenerate``
drops what was streamed and starts anew. The final messages, in order of turns, are rendered:

    <|im_start|>role\n text <|im_end|>\n

Control strings inside texts and roles are broken by a backslash after their first character and backslashes are
doubled, so every text is read back exactly. The loss mask holds the code-point spans of assistant texts.

Defined results: null text is empty, a null role is an empty role; null conversation ids form one conversation and
null turns come first; a turn that starts with another event than ``message`` starts a message with it; unknown kinds
count as ``message``; equal sequence numbers are ordered by role, then text; repeated rows are kept; a conversation
without messages has no row; an empty table gives an empty result; other columns are ignored. One conversation is one
training text, so it is put together by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import offsets

START, STOP = "<|im_start|>", "<|im_end|>"
#: Beginnings of control strings: of this template's and of other common ones. Fixed values.
CONTROL = r"(?i)<(?=\||/?s>|</?sys>>)|\[(?=/?inst\])"
ASSISTANT = "assistant"
MESSAGES = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role's line ends can't end its line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def log(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of events that a table of whole messages could have come from: conv_id, turn, seq, kind, role, text.

    By the CRC of its text a message is streamed in two parts, written as a draft and edited, written as a draft and
    regenerated in two parts, or whole. Messages of one turn follow each other by role, then text."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    held = rows.select(F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), name(role).alias("role"), name(text).alias("text"))
    numbered = held.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.lit(2147483647))
    event = lambda part, kind, said: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), said.alias("text"))
    draft = F.lit("...")
    way = F.crc32(F.col("text").cast("binary")) % 4
    events = (
        F.when(way == 0, F.array(event(0, "message", first), event(1, "delta", rest)))
        .when(way == 1, F.array(event(0, "message", draft), event(1, "edit", F.col("text"))))
        .when(way == 2, F.array(event(0, "message", draft), event(1, "regenerate", first), event(2, "delta", rest)))
        .otherwise(F.array(event(0, "message", F.col("text"))))
    )
    each = numbered.select("conv_id", "turn", "role", "at", F.explode(events).alias("e"))
    return each.select("conv_id", "turn", F.struct("at", "e.part").alias("seq"), "e.kind", "role", "e.text")


def fold(events: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", sequence: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """conversation and its final messages, in order."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = events.select(
        F.col(f"`{conversation}`").alias("conversation"), F.col(f"`{turn}`").alias("turn"),
        F.struct(F.col(f"`{sequence}`").alias("seq"), name(role).alias("role"), name(text).alias("text"), F.lower(name(kind)).alias("kind")).alias("event"),
    )
    turns = rows.groupBy("conversation", "turn").agg(F.array_sort(F.collect_list("event")).alias("events"))
    at = F.sequence(F.lit(1), F.size("events"))
    starts = F.filter(at, lambda i: (i == 1) | ~F.element_at("events", i)["kind"].isin("delta", "edit", "regenerate"))
    bounds = F.arrays_zip(F.col("starts").alias("first"), F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("events") + 1)).alias("next"))

    def message(bound: Column) -> Column:
        part = F.slice("events", bound["first"], bound["next"] - bound["first"])
        reset = F.array_max(F.transform(part, lambda e, i: F.when((i == 0) | (e["kind"] != "delta"), i).otherwise(0)))
        return F.struct(F.element_at("events", bound["first"])["role"].alias("role"), F.array_join(F.transform(F.slice(part, reset + 1, F.size(part)), lambda e: e["text"]), "").alias("text"))

    folded = turns.withColumn("starts", starts).select("conversation", F.struct("turn", F.transform(bounds, message).alias("messages")).alias("turn"))
    return folded.groupBy("conversation").agg(F.flatten(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["messages"])).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """conversation, formatted text and loss: code-point spans of the assistants' texts in it."""
    parts = folded.select("conversation", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), escape_role(m["role"]).alias("head"), escape(m["text"]).alias("body"))).alias("parts"))

    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(START) + len(STOP) + 2

    def span(at: Column, part: Column) -> Column:
        first = at + F.length(part["head"]) + len(START) + 1
        return F.when(part["role"] == ASSISTANT, F.struct(first.alias("start"), (first + F.length(part["body"])).alias("stop")))

    spans = F.array_compact(F.zip_with(offsets(F.transform("parts", size)), "parts", span))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(F.lit(START), p["head"], F.lit("\n"), p["body"], F.lit(STOP + "\n"))), "")
    return parts.select("conversation", whole.alias("formatted"), spans.alias("loss"))


def parse(rendered: DataFrame) -> DataFrame:
    """conversation, the messages read back from the formatted text, and the unescaped texts under the loss mask."""
    pieces = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), 1, 1 << 30)
    split = rendered.select("conversation", "formatted", "loss", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))
    starts = offsets(F.transform("pieces", lambda p: F.length(p) + len(STOP) + 1))
    ends = F.zip_with(starts, "pieces", lambda at, p: F.struct(at.alias("at"), p.alias("piece")))
    head = lambda p: F.substring_index(F.substring(p, len(START) + 1, 2147483647), "\n", 1)
    placed = split.withColumn("placed", ends).withColumn(
        "messages", F.transform("pieces", lambda p: F.struct(unescape_role(head(p)).alias("role"), unescape(F.substring(p, F.length(head(p)) + len(START) + 2, 2147483647)).alias("text")))
    )
    # each span of the mask lies in one piece: the pieces of assistants, in order
    theirs = F.filter("placed", lambda p: unescape_role(head(p["piece"])) == ASSISTANT)
    cut = F.zip_with("loss", theirs, lambda s, p: unescape(F.substring(p["piece"], s["start"] - p["at"] + 1, s["stop"] - s["start"])))
    return placed.select("conversation", "formatted", "messages", cut.alias("masked"))


def digest(parsed: DataFrame) -> DataFrame:
    masked = F.array_join("masked", "")
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return parsed.select(
        F.col("conversation").alias("conv_id"), F.size("messages").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
