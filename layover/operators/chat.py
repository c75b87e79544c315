"""Chat as data: constraints per message, how they change over turns, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.functions import text as tx
from layover.functions import wording
from layover.operators.keys import attach, newest_rank

NO_LIMIT = -1
CHUNK_TURNS = 65_536


def message_flags(messages: DataFrame) -> DataFrame:
    """What each message asks for; rows keep their order and place, nothing moves."""
    said = F.col("message_text")
    return messages.select(
        "signal_id",
        tx.limit_hour(said).alias("limit_hour"),
        tx.wants_quiet(said).alias("wants_quiet"),
        tx.wants_lounge(said).alias("wants_lounge"),
        tx.changes_mind(said).alias("changes_mind"),
        tx.claims_cancellation(said).alias("claims_cancellation"),
    )


def limit_marker(said: Column) -> Column:
    """What a message does to the landing limit: drop it (-1), set it (hour) or nothing (NULL)."""
    return F.when(tx.changes_mind(said), F.lit(NO_LIMIT)).otherwise(tx.limit_hour(said))


def quiet_marker(said: Column) -> Column:
    """What a message does to the wish for a quiet place: drop, set or nothing."""
    return F.when(tx.changes_mind(said), F.lit(False)).when(tx.wants_quiet(said), F.lit(True))


def _state(limit: Column, quiet: Column) -> list[Column]:
    return [
        F.nullif(limit, F.lit(NO_LIMIT)).alias("limit_hour"),
        F.coalesce(limit == NO_LIMIT, F.lit(False)).alias("prefers_later"),
        F.coalesce(quiet, F.lit(False)).alias("wants_quiet"),
    ]


def constraint_timeline(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    chunk_turns: int = CHUNK_TURNS,
) -> DataFrame:
    """Constraints in force after each passenger turn; a later turn replaces or revokes earlier ones.

    Needs (conversation, turn) to be a key.  A conversation is cut into chunks of ``chunk_turns``
    turn numbers: the running state is taken inside each chunk, and the last state of the
    earlier chunks is carried in.  No task ever orders more than one chunk, or one row per chunk
    of a conversation, however long a single conversation is.
    """
    said = F.col("message_text")
    marked = messages.select(
        conversation,
        turn,
        F.floor(F.col(turn) / chunk_turns).alias("chunk"),
        limit_marker(said).alias("limit"),
        quiet_marker(said).alias("quiet"),
    )
    placed = F.col(conversation).isNotNull() & F.col(turn).isNotNull()
    inside = (
        W.partitionBy(conversation, "chunk")
        .orderBy(turn)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    # Used twice below; as both uses ask for the same rows, the shuffle is shared.
    running = marked.filter(placed).select(
        conversation,
        turn,
        "chunk",
        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in ("limit", "quiet")],
    )
    chunk_end = running.groupBy(conversation, "chunk").agg(
        F.max_by("limit", turn).alias("limit"), F.max_by("quiet", turn).alias("quiet")
    )
    earlier = (
        W.partitionBy(conversation).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    )
    carried = chunk_end.select(
        conversation,
        "chunk",
        F.last("limit", ignorenulls=True).over(earlier).alias("limit_before"),
        F.last("quiet", ignorenulls=True).over(earlier).alias("quiet_before"),
    ).filter("limit_before IS NOT NULL OR quiet_before IS NOT NULL")
    known = running.join(carried, [conversation, "chunk"], "left").select(
        conversation,
        turn,
        *_state(F.coalesce("limit", "limit_before"), F.coalesce("quiet", "quiet_before")),
    )
    # A message outside any conversation or order has only itself to go by.
    loose = marked.filter(~placed).select(
        conversation, turn, *_state(F.col("limit"), F.col("quiet"))
    )
    return known.unionByName(loose)


def intent(messages: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """Constraints in force after the last message, one row per key, by partial aggregation."""
    said = F.col("message_text")
    order = newest_rank(F.col("signal_timestamp"), F.col("signal_id")) if order is None else order
    marked = messages.select(
        *keys, order.alias("at"), limit_marker(said).alias("limit"), quiet_marker(said).alias("quiet")
    )

    def last_of(marker: str) -> Column:
        return F.max_by(marker, F.when(F.col(marker).isNotNull(), F.col("at")))

    return (
        marked.groupBy(*keys)
        .agg(last_of("limit").alias("limit"), last_of("quiet").alias("quiet"))
        .select(*keys, *_state(F.col("limit"), F.col("quiet")))
    )


def latest_message(turns: DataFrame, role: str = "user") -> DataFrame:
    """Last message of the passenger in each conversation."""
    return (
        turns.filter(F.col("role") == F.lit(role))
        .groupBy("conv_id")
        .agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    )


def chat_turns(turns: DataFrame) -> DataFrame:
    """Turns per conversation, and the follow-up number its last message had.

    With ``h`` turns before the last message the count is ``h + 1`` and the follow-up number
    ``h // 2 + 1``.
    """
    n = F.count(F.lit(1))
    return turns.groupBy("conv_id").agg(
        n.alias("chat_turns"), (F.floor((n - 1) / 2) + 1).alias("follow_up_number")
    )


def prior_turns(turns: DataFrame, role: str = "user") -> DataFrame:
    """Turns before the last passenger message of their conversation."""
    last = latest_turn(turns, role)
    return attach(turns, last, "conv_id", "inner").filter("turn < last_turn").drop("last_turn")


def latest_turn(turns: DataFrame, role: str = "user") -> DataFrame:
    return (
        turns.filter(F.col("role") == F.lit(role))
        .groupBy("conv_id")
        .agg(F.max("turn").alias("last_turn"))
    )


def transcript_lines(turns: DataFrame) -> DataFrame:
    """One ``[ROLE]: text`` line per turn."""
    return turns.select(
        "conv_id", "turn", tx.transcript_line(F.col("role"), F.col("text")).alias("line")
    )


def transcripts(turns: DataFrame, page_turns: int, conversations: DataFrame | None = None) -> DataFrame:
    """Transcript text, in pages of ``page_turns`` turn numbers; ``transcript_lines`` are the whole of it.

    Needs (conv_id, turn) to be a key, which bounds a page.  Joining a conversation's pages with
    line breaks in page order gives its whole transcript; a usual conversation is one page.
    Conversations listed without turns get the fixed notice.
    """
    page = F.floor(F.col("turn") / page_turns)
    lines = transcript_lines(turns).select("conv_id", page.alias("page"), F.struct("turn", "line").alias("l"))
    ordered = F.array_sort(F.collect_list("l"))
    pages = lines.groupBy("conv_id", "page").agg(
        F.count(F.lit(1)).alias("turns"),
        F.array_join(F.transform(ordered, lambda l: l["line"]), "\n").alias("transcript"),
    )
    if conversations is None:
        return pages
    silent = conversations.select("conv_id").distinct().join(
        turns.select("conv_id").distinct(), "conv_id", "left_anti"
    )
    notice = silent.select(
        "conv_id",
        F.lit(0).cast("bigint").alias("page"),
        F.lit(0).cast("bigint").alias("turns"),
        F.lit(wording.NO_TURNS).alias("transcript"),
    )
    return pages.unionByName(notice)
