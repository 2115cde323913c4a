"""Chat formatting with typed content parts, in DataFrame operations only.

A message has a role and an ordered list of parts ``(kind, text, ref, amount)``. A visitor over the parts writes texts as
they are (escaped) and every image, audio or document part as a placeholder ``<|kind:i|>``, i counting the attachments
of the conversation, and records an attachment: its number, turn, kind, reference and the tokens its placeholder
expands to (``TOKENS``: per image tile, second of audio, document page; ``amount`` of them, at least one). The template is

    <|im_start|>role \\n body <|im_end|> \\n        (without the spaces)

and inside texts, roles and references a backslash is doubled and ``<|`` becomes ``<\\|``, so that no text can hold a
control string; a newline in a role becomes ``<\\n``. Unescaping is exact: only an escaped control string has one single
backslash between ``<`` and ``|``.

Messages are gathered per conversation, which is one output string; ties in ``turn`` are settled by role, then text.
Nulls: null texts and roles are empty, null turns come first, a null conversation id is a conversation of its own. Repeated
rows are repeated turns. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that one unit of an attachment expands to.
TOKENS = {"image": 256, "audio": 25, "document": 1024}
PARTS = "array<struct<kind:string,text:string,ref:string,amount:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("amount")
    ))


def _is_text(part: Column) -> Column:
    return ~F.coalesce(part["kind"], F.lit("text")).isin(*TOKENS)


def _expanded(part: Column) -> Column:
    units = F.greatest(F.coalesce(part["amount"], F.lit(1)), F.lit(1))
    rate = F.create_map(*(F.lit(x) for pair in TOKENS.items() for x in pair))
    return units * F.element_at(rate, part["kind"])


def visit(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv, formatted, attachments): a row per conversation of ``messages`` with typed ``parts``."""
    message = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(parts, F.array().cast(PARTS)).alias("parts"))
    gathered = messages.groupBy(F.col(conversation).alias("conv")).agg(F.sort_array(F.collect_list(message)).alias("turns"))
    # attachments of the conversation in order; a turn's own begin after those of the turns before it
    flat = F.flatten(F.transform("turns", lambda m: F.transform(
        F.filter(m["parts"], lambda p: ~_is_text(p)),
        lambda p: F.struct(m["turn"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).cast("bigint").alias("tokens")),
    )))
    numbered = F.transform(flat, lambda a, i: F.struct(i.cast("bigint").alias("number"), a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))

    def body(m: Column, done: Column) -> Column:
        folded = F.aggregate(
            m["parts"], F.struct(F.lit("").alias("text"), done.alias("n")),
            lambda s, p: F.struct(
                F.concat(s["text"], F.when(_is_text(p), escape(p["text"])).otherwise(
                    F.concat(F.lit("<|"), p["kind"], F.lit(":"), s["n"].cast("string"), F.lit("|>")))).alias("text"),
                (s["n"] + F.when(_is_text(p), 0).otherwise(1)).alias("n"),
            ),
        )
        return folded

    def add(s: Column, m: Column) -> Column:
        done = body(m, s["n"])
        return F.struct(
            F.concat(s["out"], F.array(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"), done["text"], F.lit(END)))).alias("out"),
            done["n"].alias("n"),
        )

    # a conversation without attachments needs no running number: its turns are written side by side
    plain = F.transform("turns", lambda m: F.concat(
        F.lit(START), escape_role(m["role"]), F.lit("\n"),
        F.array_join(F.transform(m["parts"], lambda p: escape(p["text"])), ""), F.lit(END)))
    counted = F.aggregate("turns", F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n")), add, lambda s: s["out"])
    return gathered.select(
        F.col("conv"), F.array_join(F.when(F.size(flat) == 0, plain).otherwise(counted), "").alias("formatted"), numbered.alias("attachments")
    )


def turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda piece, i: i > 0)

    def read(piece: Column) -> Column:
        cut = F.locate("\n", piece)
        return F.struct(
            unescape_role(F.substring(piece, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(piece, cut + 1, F.length(piece) - cut - F.lit(len(END)))).alias("text"),
        )

    return F.transform(pieces, read)


def digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from ``formatted``."""
    read = chats.select("conv", "formatted", turns(F.col("formatted")).alias("turns"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
