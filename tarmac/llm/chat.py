"""Chat formatting: turns of typed content parts flattened into one marked text, with columns' own functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of the template. ``<`` opens every control string; texts hold it, and the escape character, in escaped form only.
OPEN, BODY, CLOSE = "<turn ", ">\n", "</turn>\n"

#: Tokens that a part of each kind expands to: a fixed number, and a number for each of its units (patches, seconds, pages).
EXPANSION = {"image": (2, 1), "audio": (2, 25), "document": (2, 600)}


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\b`` and ``<`` becomes ``\l``, so that no text can hold a control string."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as content parts."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content", learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted``, ``turns``, ``attachments`` and ``n_expanded``.

    ``content`` is an array of parts (type, text, ref, units). Parts are visited in order: texts are escaped, images,
    audio and documents leave a placeholder such as ``<image/>`` and are listed in ``attachments`` (turn, part, type,
    ref, tokens) in the order of the placeholders; ``n_expanded`` sums their tokens. ``turns`` has for each turn the
    number of characters it takes in ``formatted``, and where in them the loss mask starts and how many it covers (0
    unless the role is ``learn_from``). Null texts, parts and contents count as empty, a null role as the empty role,
    parts of other types as their text. Rows of a conversation with equal turns are ordered by role, then by content;
    rows with a null conversation id form one conversation. A conversation is one value, so it must fit into a row
    (2 GB); all work on texts happens by message, before the messages of a conversation meet.
    """
    content = F.coalesce(F.col(f"`{content_col}`"), F.array().cast(messages.schema[content_col].dataType))

    def shown(p):
        kind = F.when(p["type"].isin(*EXPANSION), F.concat(F.lit("<"), p["type"], F.lit("/>")))
        return F.coalesce(kind, escape(F.coalesce(p["text"], F.lit(""))))

    def tokens(p):
        n = F.lit(0).cast("long")
        for kind, (fixed, per_unit) in EXPANSION.items():
            n = F.when(p["type"] == kind, fixed + per_unit * F.coalesce(p["units"].cast("long"), F.lit(0))).otherwise(n)
        return n

    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    inner = F.array_join(F.transform(content, shown), "")
    head = F.concat(F.lit(OPEN), escape(F.replace(F.replace(role, F.lit("&"), F.lit("&a")), F.lit(">"), F.lit("&g"))), F.lit(BODY))
    listed = F.filter(F.transform(content, lambda p, i: F.struct((i + 1).alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens"))), lambda a: a["type"].isin(*EXPANSION))
    rows = messages.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), inner.alias("inner"), head.alias("head"), listed.alias("listed")).alias("m"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["inner"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(
            "ms",
            lambda m: F.struct(
                (F.char_length(m["head"]) + F.char_length(m["inner"]) + len(CLOSE)).alias("chars"),
                F.char_length(m["head"]).alias("loss_from"),
                F.when(m["role"] == learn_from, F.char_length(m["inner"])).otherwise(0).alias("loss_chars"),
            ),
        ).alias("turns"),
        F.flatten(F.transform("ms", lambda m: F.transform(m["listed"], lambda a: F.struct(m["turn"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("ms", F.lit(0).cast("long"), lambda s, m: s + F.aggregate(m["listed"], F.lit(0).cast("long"), lambda t, a: t + a["tokens"])).alias("n_expanded"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read from its text alone: an array of (role, text), in order."""
    pieces = F.filter(F.split(formatted, "(?=" + OPEN + ")"), lambda p: p != "")

    def turn(p):
        head = F.instr(p, BODY)
        role = F.replace(F.replace(unescape(F.substring(p, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)), F.lit("&g"), F.lit(">")), F.lit("&a"), F.lit("&"))
        start = head + len(BODY)
        return F.struct(role.alias("role"), unescape(F.substring(p, start, F.char_length(p) - len(CLOSE) - start + 1)).alias("text"))

    return F.transform(pieces, turn)


def masked_texts(formatted: Column, turns: Column) -> Column:
    """The texts under the loss mask, unescaped: each turn's own span is cut from its own piece of the text."""
    pieces = F.filter(F.split(formatted, "(?=" + OPEN + ")"), lambda p: p != "")
    cut = F.zip_with(pieces, turns, lambda p, t: F.when(t["loss_chars"] > 0, unescape(F.substring(p, t["loss_from"] + 1, t["loss_chars"]))).otherwise(""))
    return cut
