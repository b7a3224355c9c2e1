"""Chat formatting from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Message numbers that one task orders at a time within a conversation.
BLOCK = 1024
#: Room for rows that repeat a turn, bound for turns, and room for the events of a message.
REPEATS, TURNS, EVENTS = 1 << 32, 1 << 28, 8


def escape(text: Column) -> Column:
    """A backslash more in every ``<``, backslashes, ``|``: no control string is left, and nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def live_events(events: DataFrame) -> DataFrame:
    """Events that no later regeneration of an earlier message has made void.

    The latest regeneration before each message is a running maximum in message order. It is
    taken over blocks of messages and then within them, so a long conversation is spread out.
    """
    place = ["conv_id", "_block"]
    placed = events.withColumn("_block", F.floor(F.col("message") / BLOCK))
    redone = placed.where("kind = 'regenerate'").groupBy(*place, "message").agg(F.max("seq").alias("_redone"))
    touched = placed.join(redone.select("conv_id").distinct(), "conv_id", "left_semi").select(*place, "message").distinct()
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = touched.select(*place).distinct().join(redone.groupBy(*place).agg(F.max("_redone").alias("_most")), place, "left")
    blocks = blocks.select(*place, F.max("_most").over(earlier).alias("_far"))
    before = Window.partitionBy(*place).orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    messages = touched.join(blocks, place).join(redone, [*place, "message"], "left")
    void = messages.select("conv_id", "message", F.greatest("_far", F.max("_redone").over(before)).alias("_void")).where("_void IS NOT NULL")
    joined = events.join(void, ["conv_id", "message"], "left")
    return joined.where("_void IS NULL OR seq > _void").drop("_void")


def fold(log: DataFrame) -> DataFrame:
    """The final messages ``conv_id, message, role, text`` of an event log.

    ``log`` holds ``conv_id, seq, message, kind, role, text``. In the order of ``seq``, a
    ``delta`` appends to a message, an ``edit`` replaces what it held, and a ``regenerate``
    replaces it and makes void what later messages held until then. A message that is left
    without events is gone. Its role is that of its first event that names one.

    An event that is delivered again counts once. Null text is empty, a null kind is a delta,
    null ids form a conversation of their own, and events without seq or message are skipped.
    Other columns are ignored.
    """
    events = log.select(
        "conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).where("seq IS NOT NULL AND message IS NOT NULL")
    keyed = events.withColumn("conv_id", F.struct("conv_id"))  # a struct of null is equal to itself in joins
    parts = F.array_sort(F.collect_set(F.struct("seq", "kind", "text")))
    reset = F.max(F.when(F.col("kind") != "delta", F.col("seq")))
    folded = live_events(keyed).groupBy("conv_id", "message").agg(parts.alias("_parts"), reset.alias("_reset"), F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"))
    valid = F.filter("_parts", lambda e: F.col("_reset").isNull() | (e["seq"] >= F.col("_reset")))
    text = F.array_join(F.transform(valid, lambda e: e["text"]), "")
    return folded.select("conv_id.conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, segments``: each conversation as consecutive text segments with a ``loss`` flag.

    The joined segments are the formatted text: per message the start mark, the role, a line
    feed, the text, the end mark and a line feed. Control strings inside roles and texts are
    escaped; a line feed in a role has a mark of its own. The loss mask covers the texts of
    ``loss_role`` only.
    """
    role = F.regexp_replace(escape(F.col("role")), "\n", NEWLINE)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    three = F.array(
        segment(F.concat(F.lit(START), role, F.lit("\n")), F.lit(False)),
        segment(escape(F.col("text")), F.col("role") == loss_role),
        segment(F.lit(END + "\n"), F.lit(False)),
    )
    turns = F.array_sort(F.collect_list(F.struct("message", three.alias("segments"))))
    return messages.groupBy("conv_id").agg(F.flatten(turns["segments"]).alias("segments"))


def format_log(log: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted conversations of an event log: ``fold`` and ``render``."""
    return render(fold(log), loss_role)


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of ``role, text``."""
    ended = F.split(text, END.replace("|", r"\|") + "\n")
    body = lambda x: F.substr(x, F.lit(len(START) + 1))
    head = lambda x: F.substring_index(body(x), "\n", 1)
    return F.transform(
        F.slice(ended, 1, F.size(ended) - 1),
        lambda x: F.struct(
            unescape(F.replace(head(x), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substr(body(x), F.length(head(x)) + 2)).alias("text"),
        ),
    )


def turn_events(turns: DataFrame) -> DataFrame:
    """An event log whose fold is the stored turns ``conv_id, turn, role, text``, each row a message of its own.

    A message begins with a wrong draft. An answer is then regenerated, after an early event of
    the message behind it, which goes with that; any other message is edited. Its text comes in
    two parts, and the second one is delivered twice. Events come in no order.

    Rows that repeat a turn are ordered by role and text; rows without a turn come first. Turns
    lie between -2 to the 28 and 2 to the 28, and a turn has at most 2 to the 32 rows.
    """
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    number = F.coalesce(F.col("turn").cast("long"), F.lit(-TURNS)) * F.lit(REPEATS) + place
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    numbered = turns.select("conv_id", "role", number.alias("message"), F.substr(text, F.lit(1), half).alias("one"), F.substr(text, half + 1).alias("two"))
    own, answer = F.col("message"), F.col("role").eqNullSafe("assistant")

    def event(step: int, kind: Column, said: Column, message: Column = own, role: Column | None = None) -> Column:
        return F.struct((own * EVENTS + step).alias("seq"), message.alias("message"), kind.alias("kind"), (F.col("role") if role is None else role).alias("role"), said.alias("text"))

    delta = F.lit("delta")
    second = event(3, delta, F.col("two"))
    early = event(1, delta, F.lit("too early"), own + 1, F.lit("user"))
    settled = event(2, F.when(answer, "regenerate").otherwise("edit"), F.col("one"))
    events = F.filter(F.array(second, settled, F.when(answer, early), event(0, delta, F.lit("a wrong draft")), second), lambda e: e.isNotNull())
    return numbered.select("conv_id", F.inline(events))


def digest(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, loss text and sizes, as digests."""
    read = chats.withColumn("_text", formatted(F.col("segments"))).withColumn("_turns", read_turns(F.col("_text")))
    said = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = read.withColumn("_loss", F.array_join(said, ""))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("_text").cast("long").alias("formatted_chars"),
    )
