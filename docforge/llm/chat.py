"""Chat formatting: typed parts are flattened into text, turns are marked, control strings are escaped.

Native column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks that open and close a turn, by role; any other role is written into its own opening mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[RESP] ", " </s>")}
OTHER = ("[TURN ", "] ", " [/TURN]")
LEARNED = "assistant"
#: What no text may contain unescaped: the marks, the usual sequence marks, and placeholders.
CONTROL = r"\[/?(?:INST|SYS|RESP|TURN)|</?s>|<(?:image|audio|document|file):"
#: A reader for each kind of part: placeholder name, and tokens that the part expands to if it doesn't say.
EXPANDED = {"image": 256, "audio": 128, "document": 512}

# Possessive throughout, so that a long role takes no stack and is read once.
_TURN = r"(?s)(\[INST\] |\[SYS\] |\[RESP\] |\[TURN [^\]\\]*+(?:\\.[^\]\\]*+)*+\] )(.*?)( \[/INST\]| \[/SYS\]| </s>| \[/TURN\])"

PARTS = "array<struct<type:string,text:string,uri:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    """Each backslash is doubled, and one is put behind the first character of a control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?=(?:{CONTROL}))(.)", "$1\\\\")


def unescape(text: Column) -> Column:
    """Undoes ``escape``: a backslash goes, and what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), r"\]", r"\\]")


def text_parts(text: Column) -> Column:
    """One text part from a plain text; null is an empty text."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("bigint").alias("tokens"))
    return F.array(part).cast(PARTS)


def _visit(done: Column, part: Column) -> Column:
    """One step of the visitor: a text part is escaped, any other becomes a numbered placeholder."""
    kind = F.coalesce(part["type"], F.lit("text"))
    is_text = kind == "text"
    name = F.when(kind.isin(*EXPANDED), kind).otherwise("file")
    expands = F.coalesce(part["tokens"], *[F.when(kind == of, F.lit(count)) for of, count in EXPANDED.items()], F.lit(0)).cast("bigint")
    number = F.size(done["attachments"])
    attachment = F.struct(number.alias("number"), kind.alias("type"), part["uri"].alias("uri"), expands.alias("tokens"))
    text = F.coalesce(part["text"], F.lit(""))
    return F.struct(
        F.concat(done["body"], F.when(is_text, escape(text)).otherwise(F.concat(F.lit("<"), name, F.lit(":"), number.cast("string"), F.lit(">")))).alias("body"),
        F.when(is_text, done["attachments"]).otherwise(F.array_append(done["attachments"], attachment)).alias("attachments"),
    )


_ATTACHMENTS = "array<struct<number:int,type:string,uri:string,tokens:bigint>>"


def flatten_parts(parts: Column) -> Column:
    """``body``: texts and placeholders in their order; ``attachments``: ``number, type, uri, tokens``.

    Numbers count from 0 within the turn. A null list or a null part adds nothing.
    """
    start = F.struct(F.lit("").alias("body"), F.array().cast(_ATTACHMENTS).alias("attachments"))
    real = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda part: part.isNotNull())
    return F.aggregate(real, start, _visit)


def format_conversations(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_mask, attachments, expanded_tokens`` from rows ``conv_id, turn, role, text``.

    With ``parts`` that column (``array<struct<type,text,uri,tokens>>``) is read in place of ``text``.
    Turns stand in the order of ``turn`` (null first), ties and repeated rows by role and content;
    each row is a turn. A null text is an empty turn, a null role an empty role; a null ``conv_id``
    is a conversation of its own. ``loss_mask`` holds ``start, length`` of assistant contents in code
    points. Attachments carry the turn's position. No turns give no rows. Texts and roles of any length are
    read whole; other columns are not read, so any names do.

    The turns of one conversation end in one string, so they meet in one row: a conversation is
    the unit that is trained on. Nothing else is gathered, and no other key is shuffled by.
    """
    content = F.col(parts).cast(PARTS) if parts else text_parts(F.col("text"))
    role = F.coalesce(F.col("role"), F.lit(""))
    pick = lambda side, other: F.coalesce(*[F.when(role == name, F.lit(marks[side])) for name, marks in MARKS.items()], other)
    flat = turns.select("conv_id", "turn", role.alias("role"), flatten_parts(content).alias("flat"))
    marked = flat.select(
        "conv_id",
        "turn",
        "role",
        pick(0, F.concat(F.lit(OTHER[0]), _escape_role(F.col("role")), F.lit(OTHER[1]))).alias("open"),
        F.col("flat.body").alias("body"),
        pick(1, F.lit(OTHER[2])).alias("close"),
        F.col("flat.attachments").alias("attachments"),
    )
    # Where a turn starts is a running sum in the order of the turns, so the mask needs no pass over what was gathered.
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "open", "body", "close", "attachments").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("open") + F.length("body") + F.length("close")
    placed = marked.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    joined = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "open", "body", "close", "attachments"))).alias("turns"))
    learned = F.filter("turns", lambda turn: turn["role"] == LEARNED)
    span = lambda turn: F.struct((turn["at"] + F.length(turn["open"])).alias("start"), F.length(turn["body"]).alias("length"))
    attachments = F.flatten(
        F.transform("turns", lambda turn, i: F.transform(turn["attachments"], lambda a: F.struct(i.alias("turn"), a["number"].alias("number"), a["type"].alias("type"), a["uri"].alias("uri"), a["tokens"].alias("tokens"))))
    )
    return joined.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda turn: F.concat(turn["open"], turn["body"], turn["close"])), "").alias("formatted"),
        F.transform(learned, span).alias("loss_mask"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda total, a: total + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """``role, text`` of each turn, read from the formatted string alone."""
    opened = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))

    def turn(pair):
        mark = pair["0"]
        named = F.coalesce(*[F.when(mark == marks[0], F.lit(name)) for name, marks in MARKS.items()])
        own = F.substring(mark, F.lit(len(OTHER[0]) + 1), F.length(mark) - len(OTHER[0]) - len(OTHER[1]))
        return F.struct(F.coalesce(named, unescape(own)).alias("role"), unescape(pair["1"]).alias("text"))

    return F.transform(F.arrays_zip(opened.alias("0"), bodies.alias("1")), turn)


#: Code points of a piece of formatted text; a span is cut from the few pieces that it lies in.
PIECE = 4096


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order.

    A substring counts code points from the start of its text, so long texts are cut into pieces once.
    """
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(held):
        def one(span):
            first, at = F.floor(span["start"] / PIECE).cast("int"), span["start"] % PIECE
            near = F.array_join(F.slice(held, first + 1, F.floor((at + span["length"]) / PIECE).cast("int") + 1), "")
            return unescape(F.substring(near, at + 1, span["length"]))

        return F.transform(mask, one)

    return F.transform(F.array(pieces), cut)[0]
