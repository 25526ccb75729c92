"""Material register: revisions, archive and the append-only history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.functions import lexicon as L
from trestle.functions.parse import mapping

#: Actions, the state that they lead to, and the states from which they are allowed (None: no row yet).
TRANSITIONS = {"create": ("active", (None,)), "update": ("active", ("active",)), "archive": ("archived", ("active",)), "restore": ("active", ("archived",))}
RETAINED, SHOWN = 1000, 100


def revisions(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds revision: 1, 2, ... for the changes of a key in order."""
    return changes.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def current(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The latest change of each key, with its revision: one aggregate, so a busy key is summed where its rows are."""
    names = [c for c in changes.columns if c != key]
    latest = changes.groupBy(key).agg(F.max(F.struct(*order, *[c for c in names if c not in order])).alias("last"), F.count("*").cast("int").alias("revision"))
    return latest.select(key, *[F.col(f"last.{c}").alias(c) for c in names], "revision")


def with_before(changes: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Adds before_<field>: the field's value in the change before, null in the first."""
    w = Window.partitionBy(key).orderBy(*order)
    return changes.withColumns({f"before_{f}": F.lag(f).over(w) for f in fields})


def shown(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.when(text != "", text), F.lit("—"))


def describe_changes(fields: Sequence[tuple[str, str]]) -> Column:
    """'label: before → after' of the fields that changed, in order, joined by '; '. Needs with_before()."""
    parts = [F.when(~F.col(f).eqNullSafe(F.col(f"before_{f}")), F.concat(F.lit(f"{label}: "), shown(F.col(f"before_{f}")), F.lit(" → "), shown(F.col(f)))) for f, label in fields]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "; ")


def describe_event(action: Column, fields: Sequence[tuple[str, str]] = tuple(L.HISTORY_FIELDS)) -> Column:
    """What a change did, as a sentence: made with its need and unit, taken out, brought back, or the fields that changed. Needs with_before()."""
    changed = describe_changes(fields)
    made = F.concat(F.lit(L.HISTORY_CREATED), shown(F.col("need")), F.lit(" "), shown(F.col("unit")), F.lit("."))
    told = F.when(action == "create", made).when(action == "archive", L.HISTORY_ARCHIVED).when(action == "restore", L.HISTORY_RESTORED)
    return told.otherwise(F.when(changed != "", changed).otherwise(L.HISTORY_UNCHANGED))


def action_label(action: Column) -> Column:
    return F.coalesce(mapping(L.HISTORY_ACTIONS)[action], F.lit(L.HISTORY_ACTIONS["update"]))


def retained(history: DataFrame, order: Sequence[Column], n: int = RETAINED) -> DataFrame:
    """The latest n events."""
    return history.orderBy(*order).limit(n)


def apply_actions(state: Column, action: Column) -> Column:
    """The state after an action, or null if it is not allowed from that state."""
    out = F.lit(None).cast("string")
    for name, (to, allowed) in TRANSITIONS.items():
        from_ok = F.lit(False)
        for s in allowed:
            from_ok = from_ok | (state.isNull() if s is None else F.coalesce(state == s, F.lit(False)))
        out = F.when((action == name) & from_ok, to).otherwise(out)
    return out


#: Changes of a key that are folded into one map.
BLOCK = 10_000
#: The states that a key can be in; a map tells for each of them where some changes lead.
STATES = (None, *dict.fromkeys(to for to, _ in TRANSITIONS.values()))


def _starts() -> Column:
    return F.array(*[F.struct(F.lit(s).cast("string").alias("status"), F.lit(0).cast("bigint").alias("accepted")) for s in STATES])


def _index(status: Column) -> Column:
    out = F.lit(0)
    for i, s in enumerate(STATES[1:], 1):
        out = F.when(status == s, i).otherwise(out)
    return out


def transition_maps(changes: DataFrame, key: str, order: Sequence[str], action: str = "action", block: int = BLOCK) -> DataFrame:
    """key, part, block, n and map (status and accepted changes for each start of STATES): what each block of a key's ordered changes does.

    Rows are dealt out by ranges of key and order, so a busy key is cut over tasks; a block is ``block`` rows that lie together in one.
    """
    names = [key, *order, action]
    dealt = changes.select(*names).repartitionByRange(*names).sortWithinPartitions(*names).withColumn("at_", F.monotonically_increasing_id())
    where = dealt.withColumn("part", F.shiftright("at_", 33)).withColumn("block", F.floor(F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) / block))
    held = where.groupBy(key, "part", "block").agg(F.array_sort(F.collect_list(F.struct("at_", F.col(action).alias("a")))).alias("acts"))

    def step(acc: Column, x: Column) -> Column:
        def move(s: Column) -> Column:
            to = apply_actions(s["status"], x["a"])
            return F.struct(F.coalesce(to, s["status"]).alias("status"), (s["accepted"] + to.isNotNull().cast("bigint")).alias("accepted"))

        return F.transform(acc, move)

    return held.select(key, "part", "block", F.size("acts").cast("bigint").alias("n"), F.aggregate("acts", _starts(), step).alias("map"))


def compose(maps: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by..., n and map: the maps of each group, one after the other in order, as one."""
    held = maps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "map"))).alias("maps"), F.sum("n").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        def move(s: Column) -> Column:
            to = F.get(x["map"], _index(s["status"]))
            return F.struct(to["status"].alias("status"), (s["accepted"] + to["accepted"]).alias("accepted"))

        return F.transform(acc, move)

    return held.select(*by, "n", F.aggregate("maps", _starts(), step).alias("map"))


def replay(changes: DataFrame, key: str, order: Sequence[str], action: str = "action", block: int = BLOCK) -> DataFrame:
    """The lifecycle of each key from its ordered changes: status, revision (accepted ones) and rejected ones.

    Each block of changes becomes a map from the state before it to the state behind it, and maps are composed, within a task's
    range first and then over ranges. No row holds a key's changes: an array has a block, the blocks of one range, or one map for each range.
    """
    maps = transition_maps(changes, key, order, action, block)
    whole = compose(compose(maps, [key, "part"], ["block"]), [key], ["part"])
    end = F.get("map", F.lit(0))
    return whole.select(key, end["status"].alias("status"), end["accepted"].cast("int").alias("revision"), (F.col("n") - end["accepted"]).cast("int").alias("rejected"))
