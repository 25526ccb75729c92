"""Mixing sources to target weights.

Words of each source are laid end to end and packed into blocks of ``block_words``. Targets are shared out by weight and
stop at ``max_repeats`` times a source's size, the excess being shared again. The mix is a row of slots, cut into output
shards. For each shard, source counts are drawn from a multinomial distribution over what is left of the sources' slot
quotas, so every shard is a random mix and all shards together meet the quotas. The j-th slot of a source takes the block
that a keyed permutation of its block numbers gives for j: every block once, in pseudorandom order, before any block again.
Slots and blocks are joined by source and block number.

Word offsets are prefix sums in two levels, over and within hash buckets of a source, so a source that holds most rows is
spread out. Draws depend on the seed and the sources' sizes alone: reruns agree whatever the partitioning.

Sources and their weights are a driver-side list, as they are a setting of the mix; their number is checked against
``max_sources``. Everything that grows with documents stays in tables.

Defined cases: null texts have no words, are never taken and keep their row; a null source is a source of its own, last in
order; a source without words has target zero; repeated rows count each and have each their own words in the mix; a very long
text is many blocks and is cut where it is read; an empty table gives empty results; other columns are not read, whatever
their names. More than ``max_sources`` sources are an error, as they could not be a setting of a mix. A mix of more than
``max_shards`` times ``shard_blocks`` blocks has larger shards instead of more of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.llm._common import WORD, materialize, partitions

BUCKETS = 4096
#: Slots of a source in a shard that are laid out together.
SLOTS = 1024


def cyclic_weights(sources: Sequence[str | None], cycle: Sequence[float] = (3, 1, 2)) -> list[float]:
    """Weights 3, 1, 2 and again, for sources in their order."""
    return [cycle[i % len(cycle)] for i in range(len(sources))]


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, max_repeats: float) -> np.ndarray:
    """Words of each source in the mix: share times all words by weight, none above max_repeats times its size."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = share * sizes.sum()
    while open_.any() and weights[open_].sum() > 0:
        give = left * weights / weights[open_].sum()
        over = open_ & (give > max_repeats * sizes)
        if not over.any():
            out[open_] = give[open_]
            break
        out[over] = max_repeats * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def draw_shards(quotas: np.ndarray, shard_blocks: int, seed: int) -> np.ndarray:
    """Source counts of each shard: multinomial over what is left of the quotas, which are met in the end."""
    rng, left, out = np.random.default_rng(seed), np.array(quotas, np.int64), []
    while (total := int(left.sum())) > 0:
        take = min(shard_blocks, total)
        counts = np.minimum(rng.multinomial(take, left / total), left)
        while (short := take - int(counts.sum())) > 0:
            room = left - counts
            counts += np.minimum(rng.multinomial(short, room / room.sum()), room)
        out.append(counts)
        left -= counts
    return np.array(out, np.int64).reshape(len(out), len(quotas))


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mix of x and key (the finaliser of splitmix64)."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of range(n), at index: a Feistel network on the next even number of bits, walked until it lands below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            x = out[todo]
            left, right = x >> shift, x & mask
            for r in range(rounds):
                left, right = right, left ^ (_scramble(right, (key + 0x9E3779B97F4A7C15 * (r + 1)) % (1 << 64)) & mask)
            out[todo] = (left << shift) | right
            todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, text_key, source, nth (of the rows that agree in those), size (words) and start, the number of words before it in its source."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"))
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(BUCKETS)).cast("int")), "sized")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    again = Window.partitionBy("source", "bucket", "doc_id", "text_key").orderBy("size")
    offset = rows.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("nth", F.row_number().over(again.orderBy("offset", "size")))
    same = offset.source.eqNullSafe(bases.source) & (offset.bucket == bases.bucket)
    return offset.join(bases, same).select("doc_id", "text_key", offset.source, "nth", "size", (F.col("base") + F.col("offset")).alias("start"))


class Mix:
    """A drawn mix: ``plan`` (a row per source), ``docs`` (see sized()) and ``blocks()``."""

    def __init__(self, docs: DataFrame, plan: pd.DataFrame, shards: np.ndarray, block_words: int, seed: int):
        self.docs, self.plan, self.shards, self.block_words, self.seed = docs, plan, shards, block_words, seed

    def slots(self) -> DataFrame:
        """shard, slot (its place in the shard), source_no and block."""
        spark, seed = self.docs.sparkSession, self.seed
        first = np.cumsum(self.shards, axis=0) - self.shards
        shard, source = np.nonzero(self.shards)
        counts = pd.DataFrame({"shard": shard, "source_no": source, "first": first[shard, source], "n": self.shards[shard, source]}, dtype="int64")
        blocks = self.plan["blocks"].to_numpy(np.int64)

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                f["block"] = 0
                for s, part in f.groupby("source_no"):
                    n, j = int(blocks[s]), part["j"].to_numpy(np.int64)
                    for again in np.unique(j // n):
                        at = part.index[j // n == again]
                        f.loc[at, "block"] = permute(f.loc[at, "j"].to_numpy() % n, n, seed * 1_000_003 + int(s) * 1009 + int(again))
                yield f[["shard", "source_no", "block", "j"]]

        if not len(counts):
            return spark.createDataFrame([], "shard bigint, source_no bigint, block bigint, slot int")
        stop = F.col("first") + F.col("n")
        parts = spark.createDataFrame(counts).select("shard", "source_no", stop.alias("stop"), F.explode(F.sequence("first", stop - 1, F.lit(SLOTS))).alias("at"))
        spread = parts.repartition(partitions(spark), "source_no", "at")  # a few bytes for every SLOTS slots
        each = spread.select("shard", "source_no", F.explode(F.sequence("at", F.least(F.col("at") + SLOTS, "stop") - 1)).alias("j"))
        placed = each.mapInPandas(place, "shard bigint, source_no bigint, block bigint, j bigint")
        order = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "source_no", "j", F.lit(seed)), "source_no", "j")
        return placed.withColumn("slot", F.row_number().over(order) - 1).drop("j")

    def numbers(self) -> DataFrame:
        """name and source_no of every source: a row for each of at most max_sources."""
        return self.docs.sparkSession.createDataFrame(self.plan[["source", "source_no"]].astype({"source": object}).values.tolist(), "name string, source_no bigint")

    def pieces(self) -> DataFrame:
        """source_no, block, and the piece of a document that lies in it: doc_id, text_key, nth, doc_start, first (word of the document) and n."""
        b = self.block_words
        numbers = self.numbers()
        rows = self.docs.where("size > 0").withColumn("source", F.col("source").cast("string"))
        rows = rows.join(F.broadcast(numbers), rows.source.eqNullSafe(numbers.name)).drop("source", "name")
        each = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        first = F.greatest(F.lit(0), F.col("block") * b - F.col("start"))
        last = F.least("size", (F.col("block") + 1) * b - F.col("start"))
        return each.select("source_no", "block", "doc_id", "text_key", "nth", F.col("start").alias("doc_start"), first.alias("first"), (last - first).alias("n"))

    def blocks(self) -> DataFrame:
        """The mix: shard, slot, source_no, block and pieces (array of doc_start, first, n, doc_id, text_key, nth), at most block_words pieces."""
        piece = F.struct("doc_start", "first", "n", "doc_id", "text_key", "nth")
        packed = self.pieces().groupBy("source_no", "block").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
        # slots are made of a few rows that are small enough to be sent to all, so Spark has to be told to deal both sides out
        return self.slots().hint("merge").join(packed, ["source_no", "block"])


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    max_repeats: int = 2,
    block_words: int = 2048,
    shard_blocks: int = 1024,
    seed: int = 42,
    weights: Callable[[Sequence[str | None]], Sequence[float]] = cyclic_weights,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_sources: int = 100_000,
    max_shards: int = 10_000,
) -> Mix:
    """Draw a mix of all documents. weights gets the sources in code point order, null last, and returns a weight for each."""
    rows = materialize(sized(docs, id_col, text_col, source_col), "offsets")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).toPandas()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources: group them first")
    sums["source"] = sums["source"].astype(object).where(sums["source"].notna(), None)
    order = sorted(range(len(sums)), key=lambda i: (sums["source"][i] is None, str(sums["source"][i])))
    plan = sums.iloc[order].reset_index(drop=True)
    plan["source_no"] = range(len(plan))
    plan["source"] = [None if s is None else str(s) for s in plan["source"]]
    plan["weight"] = list(weights(plan["source"].tolist()))
    plan["target"] = targets(plan["size"], plan["weight"], share, max_repeats)
    plan["blocks"] = -(-plan["size"] // block_words)
    per_block = plan["size"] / plan["blocks"].clip(lower=1)
    quotas = np.minimum(np.rint(plan["target"] / per_block.where(per_block > 0, 1)), max_repeats * plan["blocks"]).astype(np.int64)
    shard_blocks = max(shard_blocks, -(-int(quotas.sum()) // max_shards))
    return Mix(rows, plan, draw_shards(quotas.to_numpy(), shard_blocks, seed), block_words, seed)


def taken_words(mix: Mix) -> DataFrame:
    """A row per document: doc_id, text_key, source, size, source_size, target and taken, the words that the mix takes of it, repeats counted."""
    spark = mix.docs.sparkSession
    each = mix.blocks().select("source_no", F.inline("pieces"))
    used = each.groupBy("source_no", "doc_start").agg(F.sum("n").alias("taken"))
    facts = spark.createDataFrame(mix.plan[["source", "source_no", "size", "target"]].astype({"source": object}).values.tolist() or [], "name string, source_no bigint, source_size bigint, target double")
    rows = mix.docs.join(F.broadcast(facts), mix.docs.source.cast("string").eqNullSafe(facts.name)).drop("name")
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    joined = rows.join(used.withColumnRenamed("doc_start", "start"), ["source_no", "start"], "left")
    return joined.select("doc_id", "text_key", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix by document: a row for each time that words of a document are taken, with those words' stretches of the text and the document's columns.

    Of rows that agree in id, text and source each has its own words in the mix. A document whose blocks are all taken comes
    back unchanged. Row n of a document holds the blocks drawn n times or more;
    stretches that do not touch are joined by a line end. The length column, if there is one, is counted anew.
    """
    import re

    import pyarrow as pa

    each = mix.blocks().select("source_no", F.inline("pieces"))
    times = each.groupBy("source_no", "doc_id", "text_key", "nth", "first", "n").agg(F.count("*").alias("times"))
    turns = times.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    span = F.struct(F.col("first").cast("int").alias("first"), F.col("n").cast("int").alias("n"))
    taken = turns.groupBy("source_no", "doc_id", "text_key", "nth", "turn").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    named = taken.join(F.broadcast(mix.numbers()), "source_no")
    named = named.select(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key"), F.col("name").alias("mix_source"), F.col("nth").alias("mix_nth"), "spans")
    # a document is one struct until its columns come back, so no name of theirs meets one of these
    own = {"id": F.col(id_col), "key": F.xxhash64(text_col), "source": F.col(source_col).cast("string")}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in own.items()])
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0))))
    same = F.col("id").eqNullSafe(F.col("mix_id")) & (F.col("key") == F.col("mix_key")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("nth") == F.col("mix_nth"))
    stretches = next(n for n in ("spans", *(f"spans{i}" for i in range(len(docs.columns)))) if n not in docs.columns)
    joined = rows.join(named, same).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.col("spans").alias(stretches))
    word, names = re.compile(WORD), docs.columns

    def cut(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(text_col).to_pylist(), b.column(stretches).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s in spans:
                    if runs and runs[-1][1] == s["first"]:
                        runs[-1][1] += s["n"]
                    else:
                        runs.append([s["first"], s["first"] + s["n"]])
                where = [m.span() for m in word.finditer(text)]
                whole = len(runs) == 1 and runs[0] == [0, len(where)]
                out.append(text if whole else "\n".join(text[where[i][0] : where[j - 1][1]] for i, j in runs))
            columns = {c: b.column(c) for c in names} | {text_col: pa.array(out, pa.string())}
            if length_col in columns:
                columns[length_col] = pa.array([len(x) for x in out], pa.int64()).cast(b.column(length_col).type)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return joined.mapInArrow(cut, docs.schema)
