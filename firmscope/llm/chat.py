"""Chat formatting from an event log, with DataFrame operations only.

Logs hold one event a row: ``start`` opens a turn with a role, ``delta`` adds
text to it, ``edit`` replaces its text, ``regenerate`` drops its text so that
later deltas fill it anew. Each turn's events are sorted by sequence number and
folded into its final text; turns are then rendered conversation by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """No ``<|`` is left; ``unescape`` gives the text back exactly."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final state of every turn that was started.

    events: conv_id, turn, seq, kind, role, text. Events of a turn apply in the
    order of seq (then kind and text, so that repeats give one result); null texts
    are empty, unknown kinds do nothing, the last start names the role. Only the
    events from the last edit or regeneration on are joined.
    """
    e = events.select("conv_id", "turn", F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).alias("e"))
    folded = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("e")).alias("log"))
    resets = F.transform("log", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i + 1))
    last = F.coalesce(F.array_max(resets), F.lit(1))
    after = F.slice("log", last, F.size("log") - last + 1)
    pieces = F.transform(F.filter(after, lambda x: x["kind"].isin("delta", "edit")), lambda x: x["text"])
    starts = F.filter("log", lambda x: x["kind"] == "start")
    return folded.where(F.size(starts) > 0).select("conv_id", "turn", F.element_at(starts, -1)["role"].alias("role"), F.array_join(pieces, "").alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, segments.

    ``segments`` are the pieces whose concatenation is ``formatted``, each with
    its loss flag: only assistant texts are learned. Turns come in turn order,
    null first; rows without conv_id are one conversation. A conversation is one
    row in the end, so it must fit a row (2 GB); other columns don't travel.
    """
    t = turns.select("conv_id", F.struct("turn", escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"))
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    none = F.lit(False)

    def pieces(x: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(OPEN), x["role"], F.lit("\n")).alias("text"), none.alias("loss")),
            F.struct(x["text"].alias("text"), (x["role"] == ASSISTANT).alias("loss")),
            F.struct(F.lit(CLOSE).alias("text"), none.alias("loss")),
        )

    segments = F.flatten(F.transform("turns", pieces))
    out = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"))
    return out.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def format_chats(events: DataFrame) -> DataFrame:
    """Fold an event log and render it; see ``fold_events`` and ``render``."""
    return render(fold_events(events))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substring(x, len(OPEN) + 1, 1 << 30)
        at = F.instr(body, "\n")
        return F.struct(unescape(F.substring_index(body, "\n", 1)).alias("role"), unescape(body.substr(at + 1, F.lit(1 << 30))).alias("text"))

    return F.transform(blocks, turn)


def as_events(messages: DataFrame) -> DataFrame:
    """Replay finished messages (conv_id, turn, role, text) as the log that a chat
    service would have written: streamed in two deltas; every other turn was first
    generated otherwise and then regenerated, every third one edited at the end.
    Rows are numbered by turn, role and text, so that repeats stay apart: each is a
    turn of its own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(order).cast("long"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    text = F.col("text")
    event = lambda k, kind, value, when=None: F.when(F.lit(True) if when is None else when, F.struct((F.col("n") * 16 + k).alias("seq"), F.lit(kind).alias("kind"), value.alias("text")))
    again, edited = F.col("n") % 2 == 0, F.col("n") % 3 == 0
    log = F.array(
        event(0, "start", F.lit("")),
        event(1, "delta", F.lit("draft <|im_end|>"), again),
        event(2, "regenerate", F.lit(""), again),
        event(3, "delta", text.substr(F.lit(1), half)),
        event(4, "delta", text.substr(half + 1, F.char_length("text"))),
        event(5, "edit", text, edited),
    )
    return m.select("conv_id", F.col("n").alias("turn"), "role", F.explode(F.filter(log, lambda x: x.isNotNull())).alias("e")).select("conv_id", "turn", "role", "e.seq", "e.kind", "e.text")
