"""Chat formatting with Spark expressions only: turns to one marked text per conversation, and back.

Output looks like ``<|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>``: adjacent turns of one
role share a block, with a mark between their texts, so nothing is lost.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``; a mark can therefore not occur there.

Null roles and texts are empty.  Turns go by number, null first, then by role and text, so ties have
one order.  Rows are never dropped, repeated ones included.  A null conversation id is a conversation.
One conversation becomes one row, whatever its length: that is what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _literal(mark: str) -> str:
    return mark.replace("|", "\\|")


def part(text: Column, loss: Column | bool = False) -> Column:
    return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learned: str = "assistant",
) -> DataFrame:
    """One row per conversation: (conv_id, parts, formatted).

    ``parts`` are pieces of the output with a flag, true for text that counts in the loss: every text
    of the learned role and nothing else.  ``formatted`` is the parts joined.
    """
    said = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    grouped = turns.select(F.col(conv).alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("said")).alias("turns")
    )
    # Where a block begins: the first turn, and every turn whose role differs from the one before.
    begins = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    blocks = grouped.withColumn("begins", begins).withColumn(
        "blocks",
        F.transform(
            "begins",
            lambda at, k: F.slice(
                "turns", at, F.coalesce(F.get("begins", k + 1), F.size("turns") + 1) - at
            ),
        ),
    )

    def block_parts(block: Column) -> Column:
        head = F.concat(F.lit(START), escape(block[0]["role"]), F.lit(SEP))
        loss = block[0]["role"] == learned
        inner = F.flatten(
            F.transform(
                block,
                lambda t, k: F.array(
                    part(F.when(k == 0, head).otherwise(F.lit(NEXT))), part(escape(t["text"]), loss)
                ),
            )
        )
        return F.concat(inner, F.array(part(F.lit(END))))

    parts = F.flatten(F.transform("blocks", block_parts))
    return blocks.select("conv_id", parts.alias("parts")).withColumn(
        "formatted", F.array_join(F.transform("parts", lambda p: p["text"]), "")
    )


def read_turns(formatted: Column) -> Column:
    """The turns back from the formatted text: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, _literal(START), -1), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, SEP, 1))
        body = F.substring_index(F.substring_index(block, SEP, -1), END, 1)
        return F.transform(
            F.split(body, _literal(NEXT), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(parts: Column) -> Column:
    """All text under the loss mask, in order, unescaped, with nothing between."""
    learned = F.transform(F.filter(parts, lambda p: p["loss"]), lambda p: unescape(p["text"]))
    return F.array_join(learned, "")


def digest(chats: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them: counts and digests per conversation."""
    back = chats.select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("parts")).alias("loss"), "formatted"
    )
    plain = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
