r"""Conversation structure repair: the cheapest edits that give every conversation the role pattern ``(s?(ua)+)?``.

Turns stand in the order of their numbers (nulls first), turns of one number by role and the SHA-256 of their text. A turn has
one fault at most, the first that holds: blank (no character but TAB..CR and space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that is not blank is none of ``.!?``). Edits, by their initials: Delete 3, Insert of
an empty user or assistant turn 2, Keep 0, Rerole to user or assistant 2. Blank and duplicate turns have to go; a truncated
turn that stays costs 1 more. The pattern is judged on the initials of the roles.

Costs to go run backward over turns and the four states of the pattern (START, S, U, A); a forward walk then takes the edit
with the ASCII-least initial among those on a cheapest way. From a state, an initial leads to one next state only, so the
walk's letters are the ASCII-least audit of all cheapest ones, and they decide the repaired turns.

Distribution: equal turns (conversation, number, role, text) are one row with a count before anything meets. Rows are then dealt out
by range over (conversation, number, role, digest) and sorted, so a conversation of any size is cut over as many tasks as it
needs. A conversation that lies whole inside a task and a block is repaired where it lies. The others, those at the ends of a task's
range and very long ones, become blocks of BLOCK_ROWS turns or BLOCK_CHARS characters, each with the least costs from each
state to each state. Those small tables are read from the end of a conversation to its start, one after the other, which gives every block the
costs to go behind it; then blocks are read from the start, and the walk goes on from block to block. Both readings stream over sorted
rows and hold one block.

Defined cases: a null role, text or id is one space in what is read (a null id stays null in the result and is one conversation); an empty
role has no initial; turns with all numbers null have their order by role and digest; a very long text is a block of its own; an
empty table gives an empty result; other columns are not read, whatever their names. Ids of any type that can be sorted will do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.llm._common import materialize, partitions

BLANKS = "\t\n\x0b\x0c\r "
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
START, S, U, A = range(4)
INF = 1 << 60
#: The state behind a turn whose role has the initial, and the state and role behind an inserted or reroled turn.
STEP = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
MADE = ((U, "user"), (U, "user"), (A, "assistant"), (U, "user"))
#: Costs at the end of a conversation: what is missing is inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: Kinds of a turn: its fault's letter, or '-' without one.
GONE, CUT = "bd", "t"

TURN = "struct<role:string,text:string>"
COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, first_turn bigint, low_turn bigint, last_turn bigint, turns bigint"
FIELDS = f"part int, seq bigint, whole boolean, {COUNTS}, cost bigint, audit string, repaired array<{TURN}>, costs array<bigint>, kinds string, said array<{TURN}>"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_COUNT_NAMES = [f.split()[0] for f in COUNTS.split(", ")]
_SAID = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TYPES = {"part": pa.int32(), "whole": pa.bool_(), "first_role": pa.string(), "last_role": pa.string(), "audit": pa.string(), "kinds": pa.string(), "repaired": _SAID, "said": _SAID, "costs": pa.list_(pa.int64())}


def row_costs(initial: str, kind: str, behind: list[int]) -> list[int]:
    """Costs to go before a turn, from those behind it."""
    out = [DELETE + x for x in behind]
    if kind not in GONE:
        extra = TRUNCATED if kind == CUT else 0
        for q in range(4):
            best = REROLE + extra + behind[MADE[q][0]]
            if initial in STEP[q]:
                best = min(best, extra + behind[STEP[q][initial]])
            out[q] = min(out[q], best)
    u, a = out[U], out[A]
    return [min(out[START], INSERT + min(u, INSERT + a)), min(out[S], INSERT + min(u, INSERT + a)), min(u, INSERT + a), min(a, INSERT + u)]


def costs_to_go(initials: list[str], kinds: str, end: Iterable[int]) -> list[list[int]]:
    """For each turn, and for the end: the least cost from each state."""
    out = [list(end)]
    for initial, kind in zip(reversed(initials), reversed(kinds), strict=True):
        out.append(row_costs(initial, kind, out[-1]))
    return out[::-1]


def least_costs(initials: list[str], kinds: str) -> list[int]:
    """The least cost from each state (rows) to each state (columns) over some turns, sixteen numbers."""
    to = [costs_to_go(initials, kinds, [0 if q == e else INF for q in range(4)])[0] for e in range(4)]
    return [min(to[e][q], INF) for q in range(4) for e in range(4)]


def before(costs: list[int], end: list[int]) -> list[int]:
    """Costs to go before some turns, from their least costs and the costs to go behind them."""
    return [min(costs[4 * q + e] + end[e] for e in range(4)) for q in range(4)]


def walk(said: list, kinds: str, end: list[int], state: int, last: bool) -> tuple[str, list[dict], int, int]:
    """The edits over some turns from a state, the turns that they give, the state behind and the edits' cost."""
    initials = [t["role"][:1] for t in said]
    go = costs_to_go(initials, kinds, end)
    edits, out, i = [], [], 0
    start = go[0][state]
    while i < len(said) or last and state in (S, U):
        made, role = MADE[state]
        extra, left = 0, go[i][state]
        if i < len(said):
            kind, after = kinds[i], go[i + 1]
            if DELETE + after[state] == left:
                edits.append("D")
                i += 1
                continue
            extra = TRUNCATED if kind == CUT else 0
        if INSERT + go[i][made] == left:
            edits.append("I")
            out.append({"role": role, "text": ""})
            state = made
        elif initials[i] in STEP[state] and extra + after[STEP[state][initials[i]]] == left:
            edits.append("K")
            out.append({"role": said[i]["role"], "text": said[i]["text"]})
            state = STEP[state][initials[i]]
            i += 1
        else:
            edits.append("R")
            out.append({"role": role, "text": said[i]["text"]})
            state = made
            i += 1
    return "".join(edits), out, state, start - go[len(said)][state] if not last else start


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role and text with known faults, dealt by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2
    takes its ``.!?`` away, 3 says it twice, 4 makes its role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col))) % 20
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), deal.alias("deal")).where("deal <> 0")
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("deal") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def _marked(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct turns with their digest, copies and said (whether an earlier turn number says the same in the same role)."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(" "))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"))
    turns = turns.withColumn("digest", F.unhex(F.sha2("text", 256)))
    number = F.coalesce("turn", F.lit(-(1 << 63)))
    firsts = turns.groupBy("conv_id", "role", "digest").agg(F.min(number).alias("first_number"), F.max(number).alias("last_number")).where("first_number < last_number")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first_number")
    turns = turns.groupBy("conv_id", "turn", "role", "digest").agg(F.max("text").alias("text"), F.count("*").alias("copies"))
    met = turns.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return met.select("conv_id", "turn", "role", "digest", "text", "copies", F.coalesce(number > F.col("first_number"), F.lit(False)).alias("said"))


class _Piece:
    """Turns of one conversation that lie together, and what is counted over them."""

    def __init__(self, conv, part: int, seq: int, before: _Piece | None = None):
        self.conv, self.part, self.seq, self.said, self.kinds, self.chars = conv, part, seq, [], [], 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | dict.fromkeys(("first_role", "last_role", "first_turn", "low_turn", "last_turn"))
        if before is not None:
            self.counts["last_role"], self.counts["last_turn"] = before.counts["last_role"], before.counts["last_turn"]

    def add(self, turn, role: str, text: str, kind: str) -> None:
        c = self.counts
        initial = role[:1]
        if c["last_role"] is not None:
            c["illegal"] += c["last_role"] + initial not in ("su", "ua", "au")
        if c["first_role"] is None and not self.said:
            c["first_role"], c["first_turn"] = initial, turn
        c["turns"] += turn is not None and turn != c["last_turn"]
        c["low_turn"] = turn if c["low_turn"] is None else c["low_turn"]
        c["last_role"], c["last_turn"] = initial, turn
        if kind != "-":
            c[{"b": "blank", "d": "duplicate", "t": "truncated"}[kind]] += 1
        self.said.append({"role": role, "text": "" if kind in GONE else text})  # texts of turns that have to go are not carried on
        self.kinds.append(kind)
        self.chars += len(text)

    def row(self, whole: bool) -> dict:
        out = {"conv_id": self.conv, "part": self.part, "seq": self.seq, "whole": whole} | self.counts
        kinds = "".join(self.kinds)
        if whole:
            audit, turns, _, cost = walk(self.said, kinds, list(END), START, True)
            return out | {"cost": cost, "audit": audit, "repaired": turns}
        return out | {"costs": least_costs([t["role"][:1] for t in self.said], kinds), "kinds": kinds, "said": self.said}


def _kind(text: str, said: bool) -> str:
    bare = text.rstrip(BLANKS)
    return "b" if not bare else "d" if said else "-" if bare[-1] in ".!?" else "t"


def _pieces(batches: Iterable[pa.RecordBatch], block_rows: int, block_chars: int) -> Iterator[dict]:
    """The sorted turns of one task as pieces: whole conversations repaired, others in blocks."""
    now: _Piece | None = None
    first = True  # whether the conversation may have begun in another task
    seq = 0
    for b in batches:
        for conv, part, turn, role, text, copies, said in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "copies", "said")), strict=True):
            if now is not None and now.conv != conv:
                yield now.row(whole=not first and now.seq == 0)
                now, first, seq = None, False, 0
            for i in range(copies):
                if now is not None and (len(now.said) >= block_rows or now.chars >= block_chars):
                    yield now.row(whole=False)
                    seq += 1
                    now = _Piece(conv, part, seq, now)
                elif now is None:
                    now = _Piece(conv, part, 0)
                now.add(turn, role, text, _kind(text, said or i > 0))
    if now is not None:
        yield now.row(whole=False)  # it may go on in the next task


def _batches(rows: Iterable[dict], names: list[str], types: dict, conv_type: pa.DataType, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of some MB of characters."""
    held, size = [], 0

    def told() -> pa.RecordBatch:
        return pa.record_batch([pa.array([r.get(n) for r in held], conv_type if n == "conv_id" else types.get(n, pa.int64())) for n in names], names=names)

    for r in rows:
        held.append(r)
        size += 64 + sum(len(t["text"]) + 16 for t in (r.get("said") or r.get("repaired") or ()))
        if size >= most:
            yield told()
            held, size = [], 0
    if held:
        yield told()


def _packed(marked: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """One row for each piece of a conversation (FIELDS)."""
    conv_type = marked.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    dealt = marked.repartitionByRange(partitions(marked.sparkSession), *order).sortWithinPartitions(*order)
    rows = dealt.select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "copies", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = iter(batches)
        first = next(held, None)
        if first is not None:
            yield from _batches(_pieces(_chain(first, held), block_rows, block_chars), ["conv_id", *_NAMES], _TYPES, first.schema.field("conv_id").type)

    return rows.mapInArrow(run, f"conv_id {conv_type}, {FIELDS}")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _ends(blocks: DataFrame) -> DataFrame:
    """conv_id, part, seq, behind (costs to go behind the block) and last, from the blocks' least costs read backward."""
    light = blocks.select("conv_id", "part", "seq", "costs").repartition("conv_id")
    light = light.sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, end, begun = None, list(END), False
        for b in batches:
            behind, last = [], []
            for c, costs in zip(b.column("conv_id").to_pylist(), b.column("costs").to_pylist(), strict=True):
                new = not begun or c != conv
                conv, begun = c, True
                end = list(END) if new else end
                behind.append(end)
                last.append(new)
                end = before(costs, end)
            yield pa.record_batch([b.column("conv_id"), b.column("part"), b.column("seq"), pa.array(behind, pa.list_(pa.int64())), pa.array(last, pa.bool_())], names=["conv_id", "part", "seq", "behind", "last"])

    kind = blocks.schema["conv_id"].dataType.simpleString()
    return light.mapInArrow(run, f"conv_id {kind}, part int, seq bigint, behind array<bigint>, last boolean")


def _joined(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    ends = ends.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s"), "behind", "last")
    met = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))
    return blocks.join(ends, met).drop("c", "p", "s")


def _walked(blocks: DataFrame) -> DataFrame:
    """The blocks repaired: read forward, the state goes on from block to block; counts are put right where blocks meet."""
    names = ["conv_id", "part", "seq", *_COUNT_NAMES, "cost", "audit", "repaired"]
    rows = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        conv, begun, state, held = None, False, START, {}
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                new = not begun or r["conv_id"] != conv
                conv, begun = r["conv_id"], True
                state = START if new else state
                if not new and r["seq"] == 0:  # the first block of a task has not seen the turn before it
                    r["illegal"] += held["last_role"] + r["first_role"] not in ("su", "ua", "au")
                    r["turns"] -= r["first_turn"] is not None and r["first_turn"] == held["last_turn"]
                r["audit"], r["repaired"], state, r["cost"] = walk(r.pop("said"), r["kinds"], r["behind"], state, r["last"])
                held = r
                yield r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = iter(batches)
        first = next(held, None)
        if first is not None:
            yield from _batches(pieces(_chain(first, held)), names, _TYPES, first.schema.field("conv_id").type)

    kind = blocks.schema["conv_id"].dataType.simpleString()
    types = dict(f.split(" ", 1) for f in FIELDS.split(", "))
    return rows.mapInArrow(run, ", ".join([f"conv_id {kind}", *(f"{n} {types[n]}" for n in names[1:])]))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Repaired conversations, in pieces: conv_id, whole (the conversation is this piece), part and seq (the order of its pieces),
    repaired (the turns that stay or are made: role and text), audit (the edits' initials), cost, blank, duplicate, truncated and
    illegal (counts before the repair), low_turn, last_turn (null if there is none) and turns (distinct turn numbers that no earlier piece has)."""
    packed = materialize(_packed(_marked(rows, conv_col, turn_col, role_col, text_col), block_rows, block_chars), "pieces")
    names = ["conv_id", "whole", "part", "seq", *_COUNT_NAMES, "cost", "audit", "repaired"]
    split = packed.where("not whole")
    walked = _walked(_joined(split.select("conv_id", "part", "seq", *_COUNT_NAMES, "kinds", "said"), _ends(split)))
    return packed.where("whole").select(*names).unionByName(walked.withColumn("whole", F.lit(False)).select(*names))


def line(turn: Column) -> Column:
    return F.concat(turn["role"], F.lit(":"), turn["text"])


_REPORT = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
REPORT = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, gaps bigint, audit string, repaired_sha256 string"


def reports(pieces: DataFrame) -> DataFrame:
    """One row per conversation of repair(): conv_id and REPORT. Of a conversation in several pieces, the digest is carried on from piece to piece,
    so that a worker holds one piece and the audit; all others are read where they lie."""
    gaps = F.coalesce(F.col("last_turn") - F.col("low_turn") + 1 - F.col("turns"), F.lit(0))
    whole = pieces.where("whole").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", gaps.alias("gaps"), "audit", F.sha2(F.array_join(F.transform("repaired", line), "\n"), 256).alias("repaired_sha256"))
    split = pieces.where("not whole").select("conv_id", "part", "seq", *_REPORT, "low_turn", "last_turn", "audit", F.transform("repaired", line).alias("lines"))
    split = split.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    names = ["conv_id", *(f.split()[0] for f in REPORT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None

        def told() -> pa.RecordBatch:
            gaps = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
            out = now | {"gaps": gaps, "audit": "".join(now["audits"]), "repaired_sha256": now["digest"].hexdigest()}
            return pa.record_batch([pa.array([out[n]], kind if n == "conv_id" else pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names], names=names)

        for b in batches:
            kind = b.schema.field("conv_id").type
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield told()
                    now = {"conv_id": r["conv_id"], "digest": hashlib.sha256(), "lines": 0, "audits": [], "low": None, "high": None} | dict.fromkeys(_REPORT, 0)
                for x in _REPORT:
                    now[x] += r[x]
                now["audits"].append(r["audit"])
                now["low"] = r["low_turn"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if r["last_turn"] is None else r["last_turn"]
                for x in r["lines"]:
                    now["digest"].update((("\n" if now["lines"] else "") + x).encode())
                    now["lines"] += 1
        if now is not None:
            yield told()

    return whole.unionByName(split.mapInArrow(run, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, {REPORT}"))
