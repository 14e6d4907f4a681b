"""Chat formatting in token-budgeted, turn-aligned windows.  DataFrame functions only.

A turn is written ``### role: text</turn>`` and a line feed.  Inside roles and
texts the escapes below keep the control strings from appearing, so the output
can be split and read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
#: (plain, escaped), applied in this order and undone in the reverse order; every backslash of an escaped text starts one of them.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
UNESCAPES = [("\\h", "#"), ("\\l", "<"), ("\\b", "\\")]
ROLE_COLON = (":", "\\c")
#: A token is a run of up to four characters that are not white space; a turn's marks count as three more.
TOKEN, MARKS = "[^ \\n\\t\\r]{1,4}", 3
#: Tokens that a window has for new turns, however long its system turn is.
ROOM = 64


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _replaced(text, UNESCAPES)


def _header(role: Column) -> Column:
    return F.concat(F.lit("### "), _replaced(escape(role), [ROLE_COLON]), F.lit(": "))


def format_chat(conversations: DataFrame, budget: int = 512, history: int = 96, history_turns: int = 4) -> DataFrame:
    """Windows ``(conv_id, window_id, n_turns, n_repeated, n_tokens, formatted, loss)`` of conversations given as (conv_id, turn, role, text) rows.

    Turns go by ``turn``, then role and text; null roles and texts are empty,
    equal rows are turns of their own, a null conv_id is a conversation, an empty
    table has no windows, and other columns are left aside.

    The budget less the system turn and the history is the room for new turns;
    the history gives way first, then the room is ``ROOM`` at least.  The prefix
    sum of the turns' tokens says into which half of the room a turn ends; the
    turns of one half form a window, and a turn of over half the room stands
    alone, so the new turns of a window fit the room.  A window passes the budget
    only if a single new turn is longer than the room, as turns are never cut, or
    if the system turn, which is never dropped, leaves less than ``ROOM``; then
    it has ``ROOM`` tokens beside it.  Each later window repeats a system turn
    that opens the conversation, then up to ``history_turns`` turns of at most
    ``history`` tokens.  ``loss`` holds the spans (code points, end exclusive) of
    the assistant texts that are new in the window; repeated ones are masked, so
    each is learned once.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + MARKS)
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(turns))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("is_system", system).withColumn("cost", F.when(system, 0).otherwise(F.col("tokens")))
    whole = turns.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("system_tokens", F.first(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(whole))
    rows = rows.withColumn("system_text", F.first(F.when(F.col("is_system"), F.col("text"))).over(whole))
    rows = rows.withColumn("prefix", F.sum("cost").over(whole))
    rows = rows.withColumn("allowed", F.greatest(F.least(F.lit(history), F.lit(budget - ROOM) - F.col("system_tokens")), F.lit(0)))
    half = F.greatest(F.lit(budget) - F.col("allowed") - F.col("system_tokens"), F.lit(ROOM)) / 2
    rows = rows.withColumn("big", F.col("cost") > half).withColumn("bucket", F.floor((F.col("prefix") - 1) / half))
    rows = rows.withColumn("bucket", F.greatest("bucket", F.lit(0)))
    opens = (F.col("pos") == 1) | (F.col("bucket") != F.lag("bucket").over(turns)) | F.col("big") | F.lag("big").over(turns)
    rows = rows.withColumn("opens", opens & ~F.coalesce((F.col("pos") == 2) & F.lag("is_system").over(turns), F.lit(False)))
    rows = rows.withColumn("window_id", F.sum(F.col("opens").cast("int")).over(whole) - 1)
    # where else a row shows: as history of the next windows, and a system turn at the head of each
    uses = [F.struct(F.col("window_id").alias("window_id"), F.lit(2).alias("kind"), F.col("pos").alias("pos"), F.col("role").alias("role"), F.col("text").alias("text"))]
    for k in range(1, history_turns + 1):
        between = F.lead("prefix", k).over(turns) - F.lead("cost", k).over(turns) - F.col("prefix") + F.col("cost")
        near = F.lead("opens", k).over(turns) & (between <= F.col("allowed")) & ~F.col("is_system")
        uses.append(F.when(near, F.struct(F.lead("window_id", k).over(turns).alias("window_id"), F.lit(1).alias("kind"), F.col("pos"), F.col("role"), F.col("text"))))
    head = F.struct(F.col("window_id"), F.lit(0).alias("kind"), F.lit(0).alias("pos"), F.lit("system").alias("role"), F.col("system_text").alias("text"))
    uses.append(F.when(F.col("opens") & (F.col("window_id") > 0) & F.col("system_text").isNotNull(), head))
    rows = rows.select("conv_id", F.array(*uses).alias("uses")).select("conv_id", F.explode(F.array_compact("uses")).alias("u"))
    parts = rows.groupBy("conv_id", F.col("u.window_id").alias("window_id")).agg(F.array_sort(F.collect_list(F.struct("u.kind", "u.pos", "u.role", "u.text"))).alias("parts"))
    piece = F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), p["role"].alias("role"), _header(p["role"]).alias("header"), escape(p["text"]).alias("body"), (F.regexp_count(p["text"], F.lit(TOKEN)) + MARKS).alias("tokens")))
    parts = parts.withColumn("parts", piece)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        low = state["at"] + F.char_length(p["header"])
        high = low + F.char_length(p["body"])
        learned = (p["kind"] == 2) & (p["role"] == "assistant")
        spans = F.when(learned, F.concat(state["spans"], F.array(F.struct(low.alias("start"), high.alias("end"))))).otherwise(state["spans"])
        return F.struct((high + len(END)).alias("at"), spans.alias("spans"))

    return parts.select(
        "conv_id",
        "window_id",
        F.size(F.filter("parts", lambda p: p["kind"] == 2)).alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("n_repeated"),
        F.aggregate("parts", F.lit(0), lambda n, p: n + p["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["header"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", start, step, lambda state: state["spans"]).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a window; an empty window has none."""

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, ": ")
        role = F.substring(piece, F.lit(5), cut - 5)
        return F.struct(unescape(_replaced(role, [ROLE_COLON[::-1]])).alias("role"), unescape(F.substring(piece, cut + 2, F.char_length(piece))).alias("text"))

    return F.transform(F.filter(F.split(formatted, END), lambda p: p != ""), turn)


def chat_digest(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say when read back: all new turns in order, and the text under the loss mask; a row for each conversation, also one without an id."""
    turns = F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.greatest("n_turns", F.lit(1)))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    read = windows.select("conv_id", "window_id", F.size(turns).alias("n"), said.alias("said"), learned.alias("learned"), F.char_length("formatted").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window_id", "said", "learned"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    text = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(text("said"), 256).alias("turns_sha256"),
        F.char_length(text("learned")).cast("long").alias("loss_chars"),
        F.sha2(text("learned"), 256).alias("loss_sha256"),
        F.col("formatted_chars"),
    )
