r"""Chat formatting into budgeted windows, in DataFrame functions only.

A conversation's turns are rendered as ``<turn ROLE>\nTEXT</turn>\n``. Inside a text every ``<turn`` and ``</turn``, with
any backslashes between, gains one backslash after ``<``; unescaping takes one away, so any text comes back exactly. In
a role, ``\``, ``>``, line ends are written as two characters.

Windows are chosen by prefix sums: a turn costs its words, or one for every CHARS_A_TOKEN characters if that is more, and one
for its marks; it belongs to the window in whose stretch of ``stride`` tokens it starts. Sums run within blocks of
``block_turns`` turn numbers, and a window ends with its block. Every window begins with the conversation's system turn (its
first one, if that is one and its number lies in the first block), and repeats the turns of the window before that start
within its last ``history`` tokens. The loss mask covers the texts of assistant turns where they are new: a repeated turn is
context and is not a target again. Windows stay within system + history + 2 * stride tokens, so within as many turns and
CHARS_A_TOKEN times as many characters, unless a single turn is longer than the stride; no turn is cut or left out.

Texts cross one shuffle, by conversation and block, so a conversation that holds a large share of all rows is spread over
tasks. What windows of a later block need of an earlier one is fetched for the conversations that have later blocks only.

Defined cases: a null text is empty; a null role is empty and comes back empty; a null conversation id is one conversation;
a null turn number comes first; rows of one turn number are ordered by role and text, in one block; a very long text is a
window of its own; repeated rows are turns each; an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.llm._common import WORD

END = "</turn>\n"
#: Characters of a turn that count as a token at least, and turn numbers whose turns are placed together.
CHARS_A_TOKEN, BLOCK_TURNS = 8, 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def escape_role(role: Column) -> Column:
    out = role
    for plain, coded in (("\\", "\\\\"), (">", "\\g"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape_role(role: Column) -> Column:
    """Two-character codes back, left to right: the escaped backslash is set aside first."""
    out = F.replace(role, F.lit("\\\\"), F.lit("\\>"))  # no raw '>' is in an escaped role
    for coded, plain in (("\\g", ">"), ("\\n", "\n"), ("\\r", "\r"), ("\\>", "\\")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, block, place (of the turn in its block, from 0), role, text, tokens and before (tokens of the block's turns before it)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), text.alias("text"))
    tokens = F.greatest(F.regexp_count("text", F.lit(WORD)).cast("bigint"), F.ceil(F.length("text") / CHARS_A_TOKEN)) + 1
    block = F.greatest(F.lit(0), F.floor(F.coalesce("turn", F.lit(0)) / block_turns))
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.coalesce(F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumns({"tokens": tokens, "block": block})
    return turns.select("conv_id", "block", (F.row_number().over(within) - 1).alias("place"), "role", "text", "tokens", before.alias("before"))


def _windows(turns: DataFrame, stride: int, history: int) -> DataFrame:
    """conv_id, block, cut, turns, recent (those that the next window repeats), context (recent ones of the window before, in this block) and system."""
    head = F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">\n"))
    drawn = turns.select("conv_id", "block", F.floor(F.col("before") / stride).alias("cut"), "place", "role", "before", "tokens", head.alias("head"), escape(F.col("text")).alias("body"))
    turn = F.struct("place", "before", "tokens", (F.col("role") == "assistant").alias("target"), ((F.col("role") == "system") & (F.col("place") == 0) & (F.col("block") == 0)).alias("system"), "head", "body")
    packed = drawn.groupBy("conv_id", "block", "cut").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    last = F.element_at("turns", -1)
    recent = F.filter("turns", lambda t: (t["before"] >= last["before"] + last["tokens"] - history) & ~t["system"])
    system = F.filter(F.slice("turns", 1, 1), lambda t: t["system"])
    order = Window.partitionBy("conv_id", "block").orderBy("cut")
    packed = packed.withColumn("recent", recent)
    none = F.slice("turns", 1, 0)
    return packed.withColumns({"context": F.coalesce(F.lag("recent").over(order), none), "system": F.first(system).over(order), "nth": F.row_number().over(order)})


#: Conversations of more than one block that are sent to every task at most; more of them meet their turns in a shuffle.
SENT_CONVERSATIONS = 100_000


def _from_earlier_blocks(turns: DataFrame, long: DataFrame, stride: int, history: int) -> DataFrame:
    """c, b, early (the recent turns of the last window of the block before) and lead (the system turn) for the later blocks of long conversations."""
    own = _windows(turns.join(long, turns.conv_id.eqNullSafe(long.c), "left_semi"), stride, history)
    ends = own.groupBy("conv_id", "block").agg(F.max_by("recent", "cut").alias("recent"), F.first("system").alias("system"))
    order = Window.partitionBy("conv_id").orderBy("block")
    told = ends.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.lag("recent").over(order).alias("early"), F.first("system").over(order).alias("lead"))
    return told.where("b > 0")


def long_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """c: the conversations that have later blocks. All others are whole in their first block, where their windows lie together."""
    return rows.where(F.col(turn_col) >= block_turns).select(F.col(conv_col).alias("c")).distinct()


def format_windows(rows: DataFrame, stride: int = 512, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per window: conv_id, block, window (ascending over blocks, with gaps), formatted, n_context (leading turns that earlier windows
    have as new), n_turns and loss (spans of code points: start, length)."""
    turns = ordered_turns(rows, conv_col, turn_col, role_col, text_col, block_turns)
    windows = _windows(turns, stride, history)
    long = long_conversations(rows, conv_col, turn_col, block_turns)
    n_long = long.count()
    if n_long:
        long = F.broadcast(long) if n_long <= SENT_CONVERSATIONS else long
        earlier = _from_earlier_blocks(turns, long, stride, history)
        later = windows.where("block > 0")
        later = later.join(earlier, later.conv_id.eqNullSafe(earlier.c) & (later.block == earlier.b), "left")
        none = F.slice("turns", 1, 0)
        later = later.withColumns({"context": F.when(F.col("nth") == 1, F.coalesce("early", none)).otherwise(F.col("context")), "system": F.coalesce("lead", none), "nth": F.col("nth") + 1}).drop("c", "b", "early", "lead")
        windows = windows.where("block = 0").unionByName(later)
    lead = F.when(F.col("nth") > 1, F.col("system")).otherwise(F.slice("turns", 1, 0))
    marked = lambda turns, new: F.transform(turns, lambda t: F.struct(F.lit(new).alias("new"), t["target"].alias("target"), t["head"].alias("head"), t["body"].alias("body")))
    every = F.concat(marked(F.concat(lead, "context"), False), marked(F.col("turns"), True))
    windows = windows.select("conv_id", "block", F.shiftleft(F.col("block"), 32).bitwiseOR(F.col("cut")).alias("window"), every.alias("turns"))
    sizes = F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END))
    state = F.aggregate(
        F.arrays_zip("turns", sizes.alias("size")),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["size"]).cast("int").alias("at"),
            F.when(x["turns"]["new"] & x["turns"]["target"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(x["turns"]["head"])).cast("int").alias("start"), F.length(x["turns"]["body"]).cast("int").alias("length"))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return windows.select(
        "conv_id",
        "block",
        "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_context"),
        F.size("turns").alias("n_turns"),
        state.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """From formatted windows alone: conv_id, block, window, turns (role and text of the turns that are new there, in order) and loss_text (unescaped text under the mask)."""
    parts = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)
    mine = F.filter(parts, lambda p, i: i >= F.col("n_context"))
    turn = lambda p: F.struct(unescape_role(F.substring(p, F.lit(7), cut_at(p) - 7)).alias("role"), unescape(F.substring(p, cut_at(p) + 2, F.length(p))).alias("text"))
    cut_at = lambda p: F.instr(p, ">")
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    return windows.select("conv_id", "block", "window", "n_turns", "n_context", F.length("formatted").alias("chars"), F.transform(mine, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))
