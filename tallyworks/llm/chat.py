r"""Chat formatting of typed content parts; built-in functions only.

A turn is a role and a list of parts: text, or an attachment of kind image, audio or document. A
visitor flattens the parts in order: text is escaped, an attachment becomes a placeholder with its number
in the conversation's list of attachments, which records what it refers to and how many tokens it expands to.
Turns are marked as

    <|turn|>role<|text|>content<|end|>

and a placeholder is ``<|image|>``, ``<|audio|>`` or ``<|document|>``. All marks begin with ``<|``,
which no escaped text holds: a backslash is doubled and ``<|`` is written as ``\l|``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.llm.lines import let

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Tokens for one unit of an attachment: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 400}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\l|"))


def unescaped(text: Column) -> Column:
    """The text that was escaped. Doubled backslashes are cut out first, so that no single one is taken for half of them."""
    between = F.transform(F.split(text, r"\\\\"), lambda part: F.replace(part, F.lit("\\l|"), F.lit("<|")))
    return F.array_join(between, "\\")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is only text; null is empty."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")
    )
    return F.array(part.cast(PART))


def visited(parts: Column) -> Column:
    """The content of a turn: every part by its kind. Null parts and null text are empty; another kind of part fails."""

    def visit(part: Column) -> Column:
        found = F.when(part["kind"] == "text", escaped(F.coalesce(part["text"], F.lit(""))))
        for kind in TOKENS_PER_UNIT:
            found = found.when(part["kind"] == kind, F.lit(f"<|{kind}|>"))
        unknown = F.raise_error(F.concat(F.lit("unknown kind of part: "), F.coalesce(part["kind"], F.lit("null"))))
        return F.when(part.isNull(), F.lit("")).otherwise(found.otherwise(unknown.cast("string")))

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit), "")


def attached(parts: Column) -> Column:
    """The attachments of a turn in order, each with the tokens it expands to; one unit where none are given."""
    tokens = F.lit(0)
    held = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda part: part["kind"] != "text")

    def record(part: Column) -> Column:
        found = tokens
        for kind, count in TOKENS_PER_UNIT.items():
            found = F.when(part["kind"] == kind, count * F.coalesce(part["units"], F.lit(1))).otherwise(found)
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), found.cast("bigint").alias("tokens"))

    return F.transform(held, record)


def format_chats(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row per conversation from rows ``conv_id, turn, role, parts``.

    Columns: ``conv_id``; ``formatted``; ``contents``, the place of each turn's content in it by code
    points, with ``loss`` true for the turns of the ``learned`` role; ``attachments`` in order with their
    ``turn`` number; ``attached_tokens``. Turns are ordered by ``turn`` with null first; turns of
    the same number, by role and content. Null role is empty, null ``conv_id`` is a conversation, repeated
    rows are repeated turns. Other columns are dropped. An empty table gives an empty one.

    A conversation becomes one string, so all its turns, also those of the null one, have to fit into a row, and so into a task: up to
    2 GiB by Spark's limit for a value. A table of more turns without an id than that has to be given ids first.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visited(F.col("parts")).alias("content"), attached(F.col("parts")).alias("held")
    )
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    whole = F.length("head") + F.length("content") + len(END)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("at", F.row_number().over(order)).withColumn("end", F.sum(whole).over(so_far))
    turn = F.struct(
        "at",
        F.concat("head", "content", F.lit(END)).alias("text"),
        F.struct(
            (F.col("end") - len(END) - F.length("content")).cast("bigint").alias("start"),
            F.length("content").cast("bigint").alias("length"),
            (F.col("role") == learned).alias("loss"),
        ).alias("place"),
        F.transform("held", lambda one: F.struct((F.col("at") - 1).alias("turn"), one["kind"].alias("kind"), one["ref"].alias("ref"), one["tokens"].alias("tokens"))).alias("held"),
    )
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    attachments = F.flatten("turns.held")
    return gathered.select(
        "conv_id",
        F.array_join("turns.text", "").alias("formatted"),
        F.col("turns.place").alias("contents"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda total, one: total + one["tokens"]).alias("attached_tokens"),
    )


def read_turns(formatted: Column, contents: Column) -> Column:
    """The turns of a formatted conversation: ``role``, ``text`` and ``loss``, placeholders left out.

    Roles are found by cutting the string at its marks. The text of a turn is the part of the string that ``contents`` gives by start and
    length, unescaped. Where every place is the one after the marks that were found, which is compared turn by turn, that
    part is at hand; else each is cut out of the whole string.
    """
    chunks = F.slice(F.split(formatted, r"<\|end\|>"), F.lit(1), F.size(contents))

    def head_of(chunk: Column) -> Column:
        return F.substring_index(chunk, TEXT, 1)

    def follows(chunk: Column, at: Column) -> Column:
        place, before = F.get(contents, at), F.get(contents, at - 1)
        begin = F.when(at == 0, F.lit(0)).otherwise(before["start"] + before["length"] + len(END))
        begin = begin + F.length(head_of(chunk)) + len(TEXT)
        return (place["start"] == begin) & (place["length"] == F.length(chunk) - F.length(head_of(chunk)) - len(TEXT))

    def plain(content: Column) -> Column:
        return unescaped(F.regexp_replace(content, r"<\|(image|audio|document)\|>", ""))

    def read(cut: bool) -> Column:
        def turn(chunk: Column, place: Column) -> Column:
            role = unescaped(F.replace(head_of(chunk), F.lit(TURN), F.lit("")))
            own = F.substring_index(chunk, TEXT, -1)
            content = own if not cut else F.substring(formatted, (place["start"] + 1).cast("int"), place["length"].cast("int"))
            return F.struct(role.alias("role"), plain(content).alias("text"), place["loss"].alias("loss"))

        return F.zip_with(chunks, contents, turn)

    in_place = F.forall(F.transform(chunks, follows), lambda found: F.coalesce(found, F.lit(False)))
    return F.when(in_place & (F.size(chunks) == F.size(contents)), read(False)).otherwise(read(True))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id`` and what its formatted string says: turns, digests of them and of the text under the loss mask, and its attachments."""
    turns = formatted.select("conv_id", "formatted", "attachments", "attached_tokens", read_turns(F.col("formatted"), F.col("contents")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda turn: turn["loss"]), lambda turn: turn["text"]), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").cast("bigint").alias("n_attachments"),
        "attached_tokens",
    )
