"""Conversation repair against an exhaustive search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from trestle.llm import conversation_repair as R
from trestle.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq string, part string, c string, kinds string, costs int"
NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain(rows):
    """Everything that the query reports of one conversation's rows, in their order: (turn, role, text)."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip("\t\n\x0b\x0c\r ")
        kinds.append("b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserted):
        """Least (cost, audit) from here, and the lines."""
        ways = [(0, "", ())] if i == len(rows) and state in "0a" else []
        if inserted < 3:
            for r in ("user", "assistant"):
                if to := NEXT.get((state, r[0])):
                    c, a, t = best(i, to, inserted + 1)
                    ways.append((c + 2, "I" + a, (r + ":",) + t))
        if i < len(rows):
            c, a, t = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, t))
            _, role, text = rows[i]
            if kinds[i] not in "bd":
                extra = int(kinds[i] == "t")
                for letter, r, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if to := NEXT.get((state, r[:1])):
                        c, a, t = best(i + 1, to, 0)
                        ways.append((c + price + extra, letter + a, (r + ":" + text,) + t))
        return min(ways) if ways else (1 << 40, "", ())

    for i in range(len(rows), 0, -1):  # keeps the recursion shallow
        for state in "0sua":
            best(i, state, 0)
    cost, audit, lines = best(0, "0", 0)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": kinds.count("b"), "duplicate": kinds.count("d"), "truncated": kinds.count("t"), "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def by_conversation(rows):
    """Turns after the damage, conversation by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        deal, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        out[conv]
        if deal:
            text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
            out[conv] += [(turn, "user" if deal == 4 else role, text)] * (2 if deal == 3 else 1)
    return out


def some_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "  \t\n", "", "Why?", "well then", "So!", "x" * 3000 + ".", None, "Σ日😀."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "User"]
    out = []
    for c in [*range(conversations), None]:
        n = rng.randint(1, most)
        for t in range(n):
            out.append((c, rng.choice([t, t, t, t + rng.randint(0, 3), None]), rng.choice(roles), rng.choice(texts) or f"text {rng.randint(0, 9)}." if rng.random() < 0.7 else rng.choice(texts)))
    return out + out[:3]


@pytest.fixture
def make(spark, tmp_path):
    def run(rows):
        full = [(*r, "x", "y", "z", "k", 1) for r in rows]
        spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
        return {r["conv_id"]: r.asDict() for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}

    return run


def test_query_equals_the_search(make):
    rows = some_rows(1, 60, 9)
    got = make(rows)
    expected = by_conversation(rows)
    assert got.keys() == expected.keys()
    for conv, turns in expected.items():
        assert got[conv] == {"conv_id": conv} | plain(ordered(turns)), conv


def test_damage(spark):
    rows = [r for r in some_rows(4, 40, 8)]
    got = sorted(map(tuple, R.damaged(spark.createDataFrame([(*r, "x", "y", "z", "k", 1) for r in rows], SCHEMA)).collect()), key=str)
    assert got == sorted(((c, *t) for c, turns in by_conversation(rows).items() for t in turns), key=str)


@pytest.mark.parametrize("block_rows, block_chars", [(1, 10**6), (3, 10**6), (1000, 50), (1000, 10**6)])
def test_one_conversation_over_many_blocks(spark, block_rows, block_chars):
    """A hot conversation is cut by range and by block; the pieces fit together."""
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"t{t}.", "again.", "cut", ""])) for t in range(300)] + [(0, 0, "user", "a."), (2, 5, "system", "b.")]
    rows += [(1, 400, "user", "same.")] * 50
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    pieces = R.repair(frame, block_rows=block_rows, block_chars=block_chars)
    assert pieces.where("conv_id = 1").count() > (20 if block_rows < 4 or block_chars < 100 else 1)
    got = {r["conv_id"]: r.asDict() for r in R.reports(pieces).collect()}
    for conv in (0, 1, 2):
        assert got[conv] == {"conv_id": conv} | plain(ordered([r[1:] for r in rows if r[0] == conv])), conv


def test_repaired_turns_fit_the_pattern(spark):
    rows = some_rows(3, 30, 8)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    by = defaultdict(list)
    for r in R.repair(frame, block_rows=2).orderBy("part", "seq").collect():
        by[r["conv_id"]] += [t["role"][:1] for t in r["repaired"]]
    assert by.keys() == {r[0] for r in rows} and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


def test_nothing(spark, make):
    assert make([]) == {}


def test_conversations_without_rows_after_damage(make):
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = make(gone)
    assert len(got) == len(gone) > 0
    for r in got.values():
        assert (r["cost"], r["audit"], r["gaps"], r["repaired_sha256"]) == (0, "", 0, hashlib.sha256(b"").hexdigest())
