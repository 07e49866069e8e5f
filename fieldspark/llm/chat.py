"""Chat formatting of typed content parts, with DataFrame functions only.

A visitor goes over the parts of a turn in order: text is escaped, and an image, audio or document part
becomes one placeholder. What a placeholder stands for is kept beside the formatted text: its place, the
reference, and the number of tokens that it expands to. Turns are marked, and a loss mask tells which code
points of a conversation are to be learned. :func:`read_chats` gets turns and parts back from the output alone.

A conversation is one row, as trainers take it, so that its turns meet in one task; a conversation
has to fit a row. What is done per turn is done before turns meet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import columns_apart

#: One content part. ``units``: patches of an image, seconds of audio or pages of a document.
PART = "struct<type:string,text:string,ref:string,units:double>"
OTHER = "other"


@dataclass(frozen=True)
class Template:
    """Marks of turns, the roles that are learned from, and tokens per unit of each kind of attachment."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    tokens: dict[str, float] = field(default_factory=lambda: {"image": 1.0, "audio": 25.0, "document": 600.0})

    def __post_init__(self) -> None:
        # Only what begins so is escaped in texts.
        if not (self.start.startswith("<|") and self.end.startswith("<|")) or any(not k.isalnum() or k in ("text", OTHER) for k in self.tokens):
            raise ValueError("marks begin with '<|', kinds of attachments are names")


def escaped(text: Column) -> Column:
    """Text in which no control string and no line end of a header can be: every escape is a backslash and a letter.

    Control strings begin with ``<|``. A backslash becomes ``\\b``, and ``\\p`` parts the two signs.
    """
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p|"))


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`: no escape can begin inside another, so that the order does not matter but for the backslash."""
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A turn's plain text as its only part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _visit(parts: Column, template: Template) -> Column:
    """Every part as ``struct<type, ref, tokens, shown>``; a part of no known type is of type ``other``."""

    def one(part: Column) -> Column:
        kind = F.when(part["type"].isin("text", *template.tokens), part["type"]).otherwise(F.lit(OTHER))
        per_unit = F.create_map(*[F.lit(x) for pair in template.tokens.items() for x in pair])
        tokens = F.when(kind.isin(*template.tokens), F.greatest(F.lit(1), F.ceil(F.coalesce(part["units"], F.lit(1.0)) * per_unit[kind])).cast("long"))
        shown = F.when(kind == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))
        return F.struct(kind.alias("type"), part["ref"].alias("ref"), F.coalesce(tokens, F.lit(0).cast("long")).alias("tokens"), shown.alias("shown"))

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, turns, attachments, attachment_tokens``.

    ``turns``: ``conv_id, turn, role, parts`` (array of :data:`PART`), or ``text`` in place of ``parts``; other columns are
    ignored. Turns go by ``turn``, nulls first, repeated ones by role and content. A null role or text counts as
    empty, null parts as none; a row without a conv_id is a conversation by itself. An empty table gives an empty
    result.

    ``turns`` of the result has per turn, in code points of ``formatted``: ``start``, ``body``, ``stop`` (the content is from
    body to stop) and ``learned``: the loss mask covers the contents of learned turns, without placeholders.
    ``attachments``: ``turn`` (place from 0), ``part`` (place among the turn's parts), ``type``, ``ref``, ``at`` (of the
    placeholder), ``tokens``.
    """
    own = "parts" if "parts" in turns.columns else "text"
    rows = columns_apart(turns, ["conv_id", "turn", "role", own])
    parts = F.col("parts") if own == "parts" else text_parts(F.col("text"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = rows.select("conv_id", lone.alias("lone"), "turn", role.alias("role"), _visit(parts, template).alias("parts"))
    head = F.concat(F.lit(template.start), _escaped_role(F.col("role")), F.lit("\n"))
    body = F.array_join(F.transform("parts", lambda p: p["shown"]), "")
    rows = rows.withColumns({"head": F.length(head), "body": F.length(body), "piece": F.concat(head, body, F.lit(template.end + "\n"))})
    learned = F.col("role").isin(*template.learned) if template.learned else F.lit(False)
    key = ["conv_id", "lone"]
    # Places by a running sum; the rows meet once, for it and for the conversation.
    order = W.partitionBy(*key).orderBy("turn", "role", "piece")
    rows = rows.withColumn("learned", learned).withColumn("i", F.row_number().over(order) - 1)
    length = F.length("piece")
    rows = rows.withColumn("start", (F.sum(length).over(order.rowsBetween(W.unboundedPreceding, 0)) - length).cast("long"))
    at = F.col("start") + F.col("head")
    span = F.struct("start", at.alias("body"), (at + F.col("body")).alias("stop"), "learned")
    # Attachments with the length of what stands before them in the turn.
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda n, p: n + F.length(p["shown"]))
    placed = F.transform("parts", lambda p, i: F.struct(F.col("i").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), F.when(p["type"] != "text", at + before(i)).alias("at"), p["tokens"].alias("tokens")))
    # A turn of one text part, which most are, has none.
    attached = F.when(F.exists("parts", lambda p: p["type"] != "text"), F.filter(placed, lambda p: p["type"] != "text")).otherwise(F.array().cast("array<struct<turn:int,part:int,type:string,ref:string,at:bigint,tokens:bigint>>"))
    whole = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "piece", span.alias("span"), attached.alias("attached")))).alias("t"))
    out = whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("t", lambda t: t["span"]).alias("turns"),
        F.flatten(F.transform("t", lambda t: t["attached"])).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]))


def read_chats(chats: DataFrame, template: Template = Template(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``conv_id, turns, loss``, and columns to keep: what :func:`format_chats` has written, from ``formatted`` and its mask alone.

    ``turns``: per turn ``role, text, parts, loss``: the unescaped text of the text parts, the parts in order (texts without
    an attachment between them are one, empty ones gone; an attachment has its type, its ``ref`` is in
    ``attachments``), and the unescaped text under the mask. ``loss``: that of all turns, one after another.
    """
    marks = "|".join([*template.tokens, OTHER])
    quoted = "".join("\\" + c if c in "|<>[](){}.*+?^$\\" else c for c in template.start)
    pieces = F.filter(F.split("formatted", f"(?={quoted})"), lambda p: p != "")
    paired = F.zip_with(pieces, "turns", lambda p, s: F.struct(p.alias("piece"), s.alias("span")))

    def one(x: Column) -> Column:
        piece, span = x["piece"], x["span"]
        role = F.substring_index(F.substr(piece, F.lit(len(template.start) + 1)), "\n", 1)
        inner = F.substr(piece, (span["body"] - span["start"] + 1).cast("int"), (span["stop"] - span["body"]).cast("int"))
        cut = F.filter(F.split(inner, f"(?=<\\|(?:{marks})\\|>)|(?<=<\\|(?:{marks})\\|>)"), lambda p: p != "")
        is_mark = lambda p: p.rlike(f"^<\\|(?:{marks})\\|>$")
        parts = F.transform(cut, lambda p: F.when(is_mark(p), F.struct(F.substr(p, F.lit(3), F.length(p) - 4).alias("type"), F.lit(None).cast("string").alias("text"))).otherwise(F.struct(F.lit("text").alias("type"), unescaped(p).alias("text"))))
        text = unescaped(F.array_join(F.filter(cut, lambda p: ~is_mark(p)), ""))
        return F.struct(_unescaped_role(role).alias("role"), text.alias("text"), parts.alias("parts"), F.when(span["learned"], text).otherwise(F.lit("")).alias("loss"))

    read = chats.select("conv_id", *keep, F.transform(paired, one).alias("turns"))
    return read.withColumn("loss", F.array_join(F.transform("turns", lambda t: t["loss"]), ""))
