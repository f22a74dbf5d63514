"""Chat formatting: logs of conversations folded into final messages, then rendered with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_max

ASSISTANT = "assistant"
#: Strings with a meaning in the format. Inside a text each gets one backslash more in front.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_ANY_CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\])"
_END = r" (?:\[/INST\]|</s>)\n"


def events(conversations: DataFrame, delta_chars: int = 512, learn_from: str = ASSISTANT) -> DataFrame:
    """The log that streaming a table of finished messages (conv_id, turn, role, text) leaves behind.

    Columns: conv_id, turn, part (tells rows of one turn apart), seq, kind, role, text. A text arrives as deltas of
    up to ``delta_chars`` code points; null and empty texts are one empty delta. A message of the role that
    is learnt from was begun once before: the start of that attempt, 32 code points at most, is a delta that a
    ``regenerate`` supersedes. ``seq`` is a struct ordered by turn, attempt and place, so :func:`fold` makes every text anew.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    pieces = F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces)

    def event(attempt: int, place: Column, kind: str, said: Column) -> Column:
        return F.struct(F.lit(attempt).alias("attempt"), place.alias("place"), F.lit(kind).alias("kind"), said.alias("text"))

    none = F.lit(0)
    begun = F.array(event(0, none, "delta", F.left(text, F.lit(32))), event(1, none, "regenerate", F.lit("")))
    again = F.coalesce(F.col("role") == learn_from, F.lit(False))
    before = F.filter(begun, lambda e: again)
    streamed = F.transform(pieces, lambda piece, i: event(2, i, "delta", piece))
    log = conversations.withColumn("part", F.monotonically_increasing_id())
    return log.select("conv_id", "turn", "part", "role", F.explode(F.concat(before, streamed)).alias("e")).select(
        "conv_id", "turn", "part", F.struct("turn", "e.attempt", "e.place").alias("seq"), "e.kind", "role", "e.text"
    )


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of a log of events.

    ``part`` may be absent where a turn has one message at a time. ``kind`` is ``message`` or ``delta`` (text added to its turn), ``edit`` (the text of its turn is
    replaced) or ``regenerate`` (its turn starts again, empty). An edit or regeneration also takes
    back every later turn written before it, as that branch of the conversation is left. So an
    event counts if its seq is not below the last edit or regeneration of its own or any earlier
    turn. ``seq`` may be of any ordered type. The role is that of the last event with one, counted or not. Events of equal seq are added in the
    order of their texts; null text is empty, a null seq comes first, an unknown kind is a delta.

    A conversation of any length is folded turn by turn: only one row per turn takes part in the
    running maximum, which works in slices, and no conversation is gathered here.
    """
    if "part" not in log.columns:
        log = log.withColumn("part", F.lit(0))
    resets = log.where("kind in ('edit', 'regenerate')").groupBy("conv_id", "turn").agg(F.max("seq").alias("last"))
    if not resets.isEmpty():
        turns = log.select("conv_id", "turn").distinct().join(
            resets.withColumnsRenamed({"conv_id": "_c", "turn": "_t"}),
            F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")),
            "left",
        ).drop("_c", "_t")
        since = running_max(turns, ["conv_id"], [F.col("turn")], "last", "since")
        since = since.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "since")
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t"))
        counts = F.col("since").isNull() | F.coalesce(F.col("seq") >= F.col("since"), F.lit(False))
        log = log.join(since, same).withColumn("_counts", counts).drop("_c", "_t", "since")
    else:
        log = log.withColumn("_counts", F.lit(True))
    said = F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.when(F.col("_counts"), F.struct(F.col("seq"), said.alias("said")))))
    folded = log.groupBy("conv_id", "turn", "part").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["said"]), "").alias("text"),
        F.bool_or("_counts").alias("_counts"),
    )
    return folded.where("_counts").drop("_counts")


def escape(text: Column) -> Column:
    """A text in which no control string stands without a backslash; :func:`unescape` takes it back.

    No control string overlaps another or ends like one begins, so each is found alone, and one
    backslash more or less in front of each is all that differs.
    """
    return F.regexp_replace(text, _ANY_CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + _ANY_CONTROL, "$1")


def _role_out(role: Column) -> Column:
    role = F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(role, F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    plain = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(plain, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render(messages: DataFrame, learn_from: str = ASSISTANT) -> DataFrame:
    """One row per conversation: conv_id, n_messages, segments (array of text and loss flag).

    A turn is ``<s> role\\ntext </s>\\n`` for the role that is learnt from and
    ``[INST] role\\ntext [/INST]\\n`` for every other; texts joined give the formatted
    conversation, and the segments flagged are the loss mask: the learnt texts and nothing else.
    Turns are in the order of turn, then role and text; every row is a turn, repeated ones too. A
    null role is written as empty, a null conv_id is a conversation of its own.

    Each turn is rendered before its conversation is put together, so that what gathers is the
    output itself.
    """
    learnt = F.coalesce(F.col("role") == learn_from, F.lit(False))
    text = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.when(learnt, "<s> ").otherwise("[INST] "), _role_out(F.col("role")), F.lit("\n"))
    tail = F.when(learnt, " </s>\n").otherwise(" [/INST]\n")
    turn = F.struct("turn", "role", F.col("text"), "part", head.alias("head"), text.alias("body"), learnt.alias("loss"), tail.alias("tail"))
    whole = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, on: Column) -> Column:
        return F.struct(x.alias("text"), on.alias("loss"))

    cut = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                piece(t["head"], F.lit(False)), piece(t["body"], t["loss"]), piece(t["tail"], F.lit(False))
            ),
        )
    )
    return whole.select("conv_id", F.size("turns").cast("bigint").alias("n_messages"), cut.alias("segments"))


def formatted(segments: str = "segments") -> Column:
    """The whole formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped, in order."""
    learnt = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learnt, lambda s: unescape(s["text"])), "")


def turns(formatted_text: Column) -> Column:
    """Roles and texts read back from a formatted conversation."""
    pieces = F.split(formatted_text, _END)
    turns_only = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def read(piece: Column) -> Column:
        inner = F.substring_index(piece, "\n", 1)
        return F.struct(
            _role_in(F.regexp_replace(inner, r"^(?:<s>|\[INST\]) ", "")).alias("role"),
            unescape(F.substring(piece, F.length(inner) + 2, F.length(piece))).alias("text"),
        )

    return F.transform(turns_only, read)


def digest(rendered: DataFrame) -> DataFrame:
    """The output of :func:`render` read back: counts and digests per conversation."""
    read = rendered.select("conv_id", formatted().alias("formatted"), loss_text().alias("learnt"))
    read = read.withColumn("turns", turns(F.col("formatted")))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
