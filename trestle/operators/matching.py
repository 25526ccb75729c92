"""Meetings of short texts: by containment over their rarest piece, and by roots over an inverted index.

Nothing is compared all with all. A contained text meets the longer ones by the piece of three characters that the fewest of
them have; roots meet by vocabulary, once for each distinct root. Keys that many texts share are dealt into cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.functions import text as T

#: Characters of a piece, texts of a key that one task meets, and index entries from which a root is hot.
PIECE, CELL, HOT = 3, 4096, 64


def pieces(text: Column, length: int = PIECE) -> Column:
    """The distinct pieces of a length, none in a shorter text."""
    last = F.length(text) - length + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def _own_pieces(text: Column) -> Column:
    """What a longer text must have to contain this one: its pieces, or itself if it is shorter than one."""
    return F.when(F.length(text) >= PIECE, pieces(text)).otherwise(F.array(text))


def contained(short: DataFrame, long: DataFrame, by: Sequence[str] = (), cell: int = CELL) -> DataFrame:
    """by..., short and long: every pair of equal by in which long contains short. Both tables are distinct; empty texts meet nothing."""
    by = list(by)
    asked = short.where("short <> ''").select(*by, "short", F.explode(_own_pieces(F.col("short"))).alias("piece"))
    wanted = asked.select(*by, "piece").distinct()
    every = F.concat(pieces(F.col("long"), 1), pieces(F.col("long"), 2), pieces(F.col("long")))
    there = long.select(*by, "long", F.explode(every).alias("piece")).join(wanted, [*by, "piece"], "left_semi")
    count = there.groupBy(*by, "piece").agg(F.count("*").alias("n"))
    rare = asked.join(count, [*by, "piece"], "left").groupBy(*by, "short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p"))
    rare = rare.where("p.n > 0").select(*by, "short", "p.piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("p.n") / cell).cast("int") - 1)).alias("cell"))
    dealt = there.join(count, [*by, "piece"]).withColumn("cell", F.pmod(F.xxhash64("long"), F.ceil(F.col("n") / cell).cast("bigint")).cast("int"))
    return rare.join(dealt, [*by, "piece", "cell"]).where(F.contains("long", F.col("short"))).select(*by, "short", "long")


def _start(root: Column) -> Column:
    """What matching roots have in common: four letters, or all of a shorter root."""
    return F.substring(root, 1, 4)


def linked_roots(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b: the pairs of matching roots of two vocabularies (columns a and b, distinct)."""
    met = a.withColumn("start", _start(F.col("a"))).join(b.withColumn("start", _start(F.col("b"))), "start")
    return met.where(T.roots_match(F.col("a"), F.col("b"))).select("a", "b")


def sharing_roots(asks: DataFrame, entries: DataFrame, first: int, hot: int = HOT) -> DataFrame:
    """ask and entry: pairs that share a root, as far as they can be among the best ``first`` works of an ask.

    asks: ask and roots. entries: entry, roots (distinct), size and ord (of its first work). The score of a pair must depend on the
    number of the entry's roots that the ask matches, on the entry's size and on nothing else of the entry, must not fall
    as that number rises, and equal scores must go by ord. Then of the entries that share a set of roots, and of one size, the
    first ``first`` by ord stand for all those that share no more than the set. So a root, or a set of them, that more
    than ``hot`` entries have gives these champions only, and is met again in larger sets: of two roots, of three, until none
    is hot. Rare roots give all their entries. Pairs do not grow with the entries of a root that half the index has.
    """
    vocabulary = entries.select(F.explode("roots").alias("b")).distinct()
    asked = asks.select("ask", F.explode("roots").alias("a")).distinct()
    links = linked_roots(asked.select("a").distinct(), vocabulary)
    ask = asked.join(links, "a").select("ask", F.col("b").alias("last"), F.array("b").alias("key")).distinct()
    post = entries.select("entry", "size", "ord", F.explode("roots").alias("last")).withColumn("key", F.array("last"))
    ask_hot = post_hot = out = None
    while True:
        heavy = post.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
        rare = ask.join(post.join(heavy, "key", "left_anti").select("key", "entry"), "key").select("ask", "entry")
        out = rare if out is None else out.unionByName(rare)
        if heavy.isEmpty():
            return out.distinct()
        place = F.dense_rank().over(Window.partitionBy("key", "size").orderBy("ord"))
        champions = post.join(heavy, "key", "left_semi").withColumn("place", place).where(F.col("place") <= first).select("key", "entry")
        out = out.unionByName(ask.join(champions, "key").select("ask", "entry"))
        ask, post = ask.join(heavy, "key", "left_semi"), post.join(heavy, "key", "left_semi")
        if ask_hot is None:  # hot roots of every ask and entry
            ask_hot, post_hot = ask.select("ask", F.col("last").alias("next")), post.select("entry", F.col("last").alias("next"))
        longer = lambda rows, name, more: rows.join(more, name).where("next > last").withColumn("key", F.array_append("key", F.col("next"))).withColumn("last", F.col("next")).drop("next")
        ask, post = longer(ask, "ask", ask_hot), longer(post, "entry", post_hot)


def first_sharing(asks: DataFrame, there: DataFrame, by: Sequence[str] = (), cell: int = CELL) -> DataFrame:
    """by..., ask and first: the least first of the texts of equal by with which an ask shares enough roots, at least half of the smaller one's.

    asks: by..., ask, roots. there: by..., text, roots, first (any type that can be ordered). Repeated roots of an ask count each time.

    Where one shared root is enough (a side of one or two roots), the least first of a root is summed up before anything
    meets. Otherwise the ask's roots are put in order of rarity, and a root serves as a meeting point only while enough roots are
    left behind it: the commonest roots of long texts meet nobody.
    """
    by = list(by)
    asks = asks.where(F.size("roots") > 0).withColumn("size", F.size("roots"))
    there = there.where(F.size("roots") > 0).withColumn("width", F.size("roots"))
    posted = there.select(*by, "text", "width", "first", F.explode(F.array_distinct("roots")).alias("b"))
    places = asks.select(*by, "ask", "size", F.posexplode("roots").alias("at", "a"))
    links = linked_roots(places.select("a").distinct(), posted.select("b").distinct())
    placed = places.join(links, "a")
    sums = posted.groupBy(*by, "b").agg(F.min("first").alias("any"), F.min(F.when(F.col("width") <= 2, F.col("first"))).alias("narrow"), F.count_if(F.col("width") > 2).alias("n"))
    met = placed.join(sums, [*by, "b"])
    one = met.select(*by, "ask", F.when(F.col("size") <= 2, F.col("any")).otherwise(F.col("narrow")).alias("first"))
    wide = met.where("size > 2")
    weight = wide.groupBy(*by, "ask", "at").agg(F.sum("n").alias("weight"))
    order = Window.partitionBy(*by, "ask").orderBy("weight", "at")
    ranked = wide.join(weight.withColumn("rank", F.row_number().over(order)), [*by, "ask", "at"]).where("n > 0")
    # roots of the ask that match nothing here come first in order of rarity, and take no part
    known = Window.partitionBy(*by, "ask")
    ranked = ranked.withColumn("absent", F.col("size") - F.max("rank").over(known))
    asked = ranked.select(*by, "ask", "size", "b", (F.col("rank") + F.col("absent")).alias("rank"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / cell).cast("int") - 1)).alias("cell"))
    dealt = posted.where("width > 2").join(sums.select(*by, "b", "n"), [*by, "b"])
    dealt = dealt.select(*by, "b", "text", "width", "first", F.pmod(F.xxhash64("text"), F.ceil(F.col("n") / cell).cast("bigint")).cast("int").alias("cell"))
    need = F.ceil(F.least("size", "width") / 2)
    pairs = asked.join(dealt, [*by, "b", "cell"]).where(F.col("rank") <= F.col("size") - need + 1).select(*by, "ask", "text", "first").distinct()
    pairs = pairs.join(asks.select(*by, "ask", "roots"), [*by, "ask"]).join(there.select(*by, "text", F.col("roots").alias("there")), [*by, "text"])
    enough = F.size(T.matched_roots(F.col("roots"), F.col("there"))) >= F.ceil(F.least(F.size("roots"), F.size("there")) / 2)
    many = pairs.where(enough).select(*by, "ask", "first")
    return one.where("first is not null").unionByName(many).groupBy(*by, "ask").agg(F.min("first").alias("first"))
