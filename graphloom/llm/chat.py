"""Chat formatting of typed content parts.

A turn is an array of parts (text, image, audio, document). A visitor flattens the parts in order:
text is escaped, every other part becomes a placeholder ``<|kind:n|>``, n its place in the turn, and
an attachment reference with the number of tokens it expands to. Turns are marked, and control strings
inside texts are escaped by replacing the two characters every marker begins with (and the escape's own
lead), so undoing it is exact: a ``<`` that is left is a marker's. SQL functions only.

A formatted conversation is ``<s>[role]R[/role]P...</s>`` per turn: R the escaped role, P a part, which is
escaped text or a placeholder. Two texts in a row are parted by ``<|text|>``, and texts alone are learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</s>"
TEXT_MARK = "<|text|>"
#: What is escaped, in the order of escaping.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: Tokens that one attachment expands to, where its part doesn't say.
EXPANDED = {"image": 576, "audio": 375, "document": 1024}
LEARNED_ROLE = "assistant"

PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A turn of one text part."""
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))
    return F.array(part).cast(f"array<{PART}>")


def _visit(part: Column, i: Column) -> Column:
    """Of a part: its escaped text or its kind, and its reference and tokens (null for text)."""
    is_text = F.coalesce(part["type"], F.lit("text")) == "text"
    default = F.coalesce(*[F.when(part["type"] == kind, n) for kind, n in EXPANDED.items()], F.lit(0))
    return F.struct(
        F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).alias("text"),
        F.when(~is_text, part["type"]).alias("type"),
        F.when(~is_text, F.coalesce(part["ref"], F.lit(""))).alias("ref"),
        F.when(~is_text, F.coalesce(part["tokens"], default)).alias("tokens"),
        i.alias("at"),
    )


def _shown(p: Column) -> Column:
    """What stands in the output for a visited part: an attachment's number is its place in the turn."""
    number = p["at"] + 1
    after_text = (p["at"] > 0) & F.get(F.col("seen"), p["at"] - 1)["text"].isNotNull()
    placeholder = F.concat(F.lit("<|"), escape(F.replace(p["type"], F.lit("|"), F.lit("/"))), F.lit(":"), number.cast("string"), F.lit("|>"))
    return F.when(p["type"].isNotNull(), placeholder).otherwise(F.concat(F.when(after_text, TEXT_MARK).otherwise(""), p["text"]))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """Per conversation: ``conv_id, formatted, loss`` (ranges of learned text, one for each text part of
    the assistant's, in code points from the turn's start), ``attachments`` (turn, number, type, ref,
    tokens in order) and ``expanded_tokens``.

    Turns go by ``turn_col``, nulls first; equal turns by role, then by their texts as given, so repeated
    rows all stay. Null parts, a null part or null texts are empty texts; a part without a type is text;
    a null role is an empty one; a null conv_id is a conversation; an empty table gives no rows; other
    columns play no part. A conversation is one row of output, so it is also one row here: its turns are
    sorted in place, each is visited in the map stage before, and what is grouped is what is written."""
    source = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(parts_col).alias("parts"))
    seen = source.select(
        "conv_id",
        "turn",
        "role",
        F.array_join(F.transform(F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)")), lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("said"),
        F.transform(F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)")), _visit).alias("seen"),
    )
    head = F.concat(F.lit("<s>[role]"), escape(F.col("role")), F.lit("[/role]"))
    shown = seen.select("conv_id", "turn", "role", "said", "seen", head.alias("head"), F.transform("seen", _shown).alias("shown"))
    # Where each part begins, from the turn's start, in one pass.
    ends = F.aggregate("shown", F.array(F.length("head")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x)))
    placed = shown.withColumn("ends", ends)
    text_range = lambda p, i: F.when(
        p["type"].isNull(), F.struct((F.get(F.col("ends"), i + 1) - F.length(p["text"])).alias("from"), F.get(F.col("ends"), i + 1).alias("to"))
    )
    learned = F.when(F.col("role") == LEARNED_ROLE, F.filter(F.transform("seen", text_range), lambda r: r.isNotNull())).otherwise(F.expr("cast(array() as array<struct<from:int,to:int>>)"))
    attached = F.transform(F.filter("seen", lambda p: p["type"].isNotNull()), lambda p: F.struct((p["at"] + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    made = placed.select("conv_id", "turn", "role", "said", F.concat("head", F.array_join("shown", ""), F.lit(TURN_END)).alias("whole"), learned.alias("learned"), attached.alias("attached"))
    grouped = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "said", "whole", "learned", "attached"))).alias("turns"))
    loss = F.flatten(F.transform("turns", lambda t, i: F.transform(t["learned"], lambda r: F.struct(i.alias("turn"), r["from"].alias("from"), r["to"].alias("to")))))
    attachments = F.flatten(
        F.transform("turns", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("turn"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    )
    out = grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), loss.alias("loss"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def parse(formatted: DataFrame) -> DataFrame:
    """Read ``format_chats``'s rows back: ``conv_id, turns`` (array of ``role, parts``; a part has ``type``
    (``text`` or an attachment's), ``text``, and ``ref, tokens`` of attachments), ``learned`` (the unescaped
    texts under the loss mask, in order), ``attachments``, ``expanded_tokens`` and ``chars``."""
    pieces = F.filter(F.split("formatted", TURN_END, -1), lambda t: t != "")
    split = formatted.select("conv_id", pieces.alias("pieces"), "loss", "attachments", "expanded_tokens", F.length("formatted").cast("long").alias("chars"))
    mark = len("<s>[role]")
    nothing = F.lit(None)

    def part(shown: Column, turn: Column) -> Column:
        """A marker ``|kind:n|`` or ``|text|`` and the text after it; the first piece is a text without one."""
        kind, rest = F.substring_index(F.substring(shown, 2, 1 << 30), "|>", 1), F.substring(shown, F.locate("|>", shown) + 2, F.length(shown))
        number = F.substring_index(kind, ":", -1).try_cast("int")
        held = F.get(F.filter(F.col("attachments"), lambda a: (a["turn"] == turn) & (a["number"] == number)), F.lit(0))
        text = F.struct(F.lit("text").alias("type"), unescape(rest).alias("text"), nothing.cast("string").alias("ref"), nothing.cast("int").alias("tokens"))
        attachment = F.struct(held["type"].alias("type"), nothing.cast("string").alias("text"), held["ref"].alias("ref"), held["tokens"].cast("int").alias("tokens"))
        return F.when(kind == "text", F.array(text)).otherwise(F.concat(F.array(attachment), F.when(rest != "", F.array(text)).otherwise(F.expr(f"cast(array() as array<{PART}>)"))))

    def turn(piece: Column, i: Column) -> Column:
        role = F.substring_index(F.substring(piece, mark + 1, 1 << 30), "[/role]", 1)
        body = F.substring(piece, F.length(role) + F.lit(mark + len("[/role]") + 1), F.length(piece))
        shown = F.split(F.when(F.startswith(body, F.lit("<|")), body).otherwise(F.concat(F.lit(TEXT_MARK), body)), "<", -1)
        parts = F.flatten(F.transform(F.filter(shown, lambda x: x != ""), lambda x: part(x, i)))
        return F.struct(unescape(role).alias("role"), parts.alias("parts"))

    learned = F.transform("loss", lambda r: unescape(F.substring(F.get(F.col("pieces"), r["turn"]), r["from"] + 1, r["to"] - r["from"])))
    return split.select("conv_id", F.transform("pieces", turn).alias("turns"), learned.alias("learned"), "attachments", "expanded_tokens", "chars")


def digest(parsed: DataFrame) -> DataFrame:
    said = lambda t: F.array_join(F.transform(t["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), said(t), F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.aggregate("learned", F.lit(0).cast("long"), lambda n, t: n + F.length(t)).alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )
