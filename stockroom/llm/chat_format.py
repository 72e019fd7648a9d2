"""Conversations of typed content parts as one training text each.

A visitor walks over the parts of a turn in order: text is escaped, any other
part becomes a placeholder that says its kind and its number within the
conversation. Attachments are recorded beside the text, with their reference
and the number of tokens that the placeholder will be expanded to.

The template, in which every control string begins with ``<`` or ``[``::

    <s>[TURN]role[TEXT]body[/TURN][TURN]role[TEXT]body[/TURN]</s>

In roles and texts ``\\`` is written ``\\\\``, ``[`` is ``\\b`` and ``<`` is
``\\l``, so no control string of this or of another template that begins with
these signs can stand in a text, and reading back is exact.

The loss mask holds, for every turn of the assistant, the turn's number and
where its body lies in the turn, in code points.

Everything is DataFrame functions. A conversation is one row and so in one
task, like a document. Turns go by ``turn``, then by role and text; a NULL role
or text is empty; rows given twice are two turns; a NULL id is a conversation
of its own; parts that are NULL or have no kind count as text; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
TURN, TEXT, TURN_END = "[TURN]", "[TEXT]", "[/TURN]"
TRAINED_ROLE = "assistant"
#: What a part becomes in tokens when it does not say so itself.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}

PART = "struct<kind: string, text: string, ref: string, tokens: int>"


def escape(text: Column) -> Column:
    """A text without ``<`` and ``[``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("["), F.lit("\\b"))
    return F.replace(out, F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The text that was escaped: pairs of backslashes are taken from the left, the rest lies between them."""
    between = F.split(text, r"\\\\", -1)
    plain = F.transform(
        between, lambda p: F.replace(F.replace(p, F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    )
    return F.array_join(plain, "\\")


def text_part(text: Column) -> Column:
    """A turn's content with the text as its only part."""
    none = F.lit(None).cast("string")
    part = F.struct(
        F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), F.lit(None).cast("int").alias("tokens")
    )
    return F.array(part).cast(f"array<{PART}>")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _kind(part: Column) -> Column:
    known = F.lower(part["kind"])
    return F.when(known.isin(*EXPANDED), known).otherwise("document")


def _size(part: Column) -> Column:
    size = F
    for kind, tokens in EXPANDED.items():
        size = size.when(_kind(part) == kind, F.lit(tokens))
    return F.coalesce(part["tokens"], size)


def format_conversations(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, content)`` with ``content`` an array of parts, as one row per conversation.

    Returns ``conv_id, n_turns, formatted, loss, attachments, expanded_tokens``.
    """
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("content"), F.array().cast(f"array<{PART}>")).alias("content"),
        ).alias("t"),
    )
    every = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # attachments in order; each placeholder carries its number in the conversation
    others = lambda t: F.filter(t["content"], lambda p: ~_is_text(p))
    counted = every.select(
        "conv_id",
        "turns",
        F.flatten(
            F.transform(
                "turns",
                lambda t, k: F.transform(
                    others(t),
                    lambda p: F.struct(
                        k.alias("turn_no"), _kind(p).alias("kind"), p["ref"].alias("ref"), _size(p).alias("tokens")
                    ),
                ),
            )
        ).alias("attachments"),
    )
    written = counted.select(
        "conv_id",
        "turns",
        "attachments",
        F.when(F.size("attachments") > 0, _numbered_bodies()).otherwise(_plain_bodies()).alias("bodies"),
    )
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    pieces = F.zip_with("turns", "bodies", lambda t, b: F.concat(head(t), b, F.lit(TURN_END)))
    loss = F.zip_with(
        F.transform("turns", lambda t, k: F.struct(t["role"].alias("role"), head(t).alias("head"), k.alias("k"))),
        "bodies",
        lambda t, b: F.struct(
            t["role"].alias("role"), t["k"].alias("turn_no"), F.length(t["head"]).alias("start"), F.length(b).alias("length")
        ),
    )
    return written.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(pieces, ""), F.lit(END)).alias("formatted"),
        F.transform(
            F.filter(loss, lambda x: x["role"] == TRAINED_ROLE),
            lambda x: F.struct(x["turn_no"].alias("turn_no"), x["start"].alias("start"), x["length"].alias("length")),
        ).alias("loss"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def _plain_bodies() -> Column:
    text = lambda p: escape(F.coalesce(p["text"], F.lit("")))
    return F.transform("turns", lambda t: F.array_join(F.transform(t["content"], text), ""))


def _numbered_bodies() -> Column:
    """Bodies whose placeholders are numbered through the conversation."""
    before = lambda k: F.size(F.filter("attachments", lambda a: a["turn_no"] < k))

    def visit(t: Column, k: Column) -> Column:
        earlier = lambda i: F.size(
            F.filter(F.slice(t["content"], F.lit(1), i), lambda p: ~_is_text(p))
        )
        shown = lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("["), F.upper(_kind(p)), F.lit(" "), (before(k) + earlier(i)).cast("string"), F.lit("]"))
        )
        return F.array_join(F.transform(t["content"], shown), "")

    return F.transform("turns", visit)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, loss_texts`` from the text and its mask; texts keep their placeholders.

    ``turns`` are (role, text) in order; ``loss_texts`` is what lies under the mask, unescaped.
    """
    inner = F.substring(
        F.col("formatted"), F.lit(len(BEGIN) + 1), F.length("formatted") - len(BEGIN) - len(END)
    )
    pieces = F.split(inner, r"\[/TURN\]", -1)
    split = formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    role_and_body = lambda p: F.split(p, r"\[TEXT\]", 2)
    return split.select(
        "conv_id",
        "formatted",
        F.transform(
            "pieces",
            lambda p: F.struct(
                unescape(F.replace(role_and_body(p)[0], F.lit(TURN), F.lit(""))).alias("role"),
                unescape(role_and_body(p)[1]).alias("text"),
            ),
        ).alias("turns"),
        F.transform(
            "loss",
            lambda m: unescape(F.substring(F.element_at("pieces", m["turn_no"] + 1), m["start"] + 1, m["length"])),
        ).alias("loss_texts"),
    )
