"""SimHash near-dedup with deletion-variant signatures.

Fingerprints are 64 bits, by bitwise majority over the XXH64 values of a document's word shingles. For links at up to
``max_distance`` bits the fingerprint is cut into max_distance // 2 + 1 segments (two at least), so at least one segment
differs by at most one bit. Every distinct fingerprint is indexed under each segment with each bit of it wiped in turn; two
segments that differ by at most one bit share such a variant. An equality join on variants gives candidates, which are
verified. Variants are first counted, by partial sums; a Bloom filter of those that occur twice or more goes to the
fingerprints, so the many that are alone are not shuffled again.

A variant that more than ``hot_limit`` distinct fingerprints share is not paired up. Fingerprints under such a variant
are linked through hubs instead: at up to 2 bits, two fingerprints link exactly if they share a point within one bit of
each, so each names its 65 points and every point ties its at most 65 fingerprints to the least of them. No cap and no
loss. For other distances all variants are paired.

near_copy_groups() uses the same signatures on a longer fingerprint, for links by the similarity of the texts themselves.

Copies share a fingerprint and are one node, so no group of copies is ever expanded.

Defined cases: null and wordless texts have fingerprint zero, linked like any other; a null id never names a component
unless a component has no other id; repeated rows are each returned; a very long text is read whole, in one task, in time
linear in its words; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.llm._common import LOWER_TABLE, ascii_lower, materialize, partitions
from trestle.llm.bloom import bloom_filter, passes
from trestle.llm.components import connected_components

HOT_LIMIT = 64
#: The same for near_copy_groups(), where a pair costs two shingle sets.
HOT_TEXTS = 16


def shingle_hashes(text: bytes, shingle_words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a UTF-8 text with A-Z lower-cased, repeats included; none for a text without words."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(n - shingle_words + 1, 1)
    stops = ends[min(shingle_words, n) - 1 :][:last]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], 42) for i, j in zip(starts[:last].tolist(), stops.tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def lanes_of(text: bytes, shingle_words: int, lanes: int) -> list[int]:
    """A fingerprint of ``lanes`` times 64 bits: the first lane is fingerprint(), further ones are majorities over hashes mixed anew."""
    hashes, out = shingle_hashes(text, shingle_words), []
    for lane in range(lanes):
        x = hashes
        if lane:
            with np.errstate(over="ignore"):
                x = hashes + np.uint64(0x9E3779B97F4A7C15 * lane % (1 << 64))
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
        out.append(majority(x) if len(x) else 0)
    return out


def fingerprint(text: bytes, shingle_words: int) -> int:
    """The 64-bit fingerprint of one UTF-8 text, as a signed integer."""
    return lanes_of(text, shingle_words, 1)[0]


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the whole text, which tells rows of one id apart) and fp (bigint), one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, shingle_words) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), pa.array(fps, pa.int64())], names=["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key bigint, fp bigint")


def _signed(x: int) -> int:
    """A 64-bit pattern as Spark's signed bigint."""
    return x - (1 << 64) if x >> 63 else x


def _cuts(max_distance: int) -> list[tuple[int, int, int]]:
    """Of each variant of a fingerprint: the shift and mask that leave its segment less one bit, and the number of the two, from bit 32 on."""
    parts = max(max_distance // 2 + 1, 2)
    width = 64 // parts
    segments = [(p * width, width if p < parts - 1 else 64 - p * width) for p in range(parts)]
    return [(shift, ((1 << w) - 1) & ~(1 << bit), (shift + bit) << 32) for shift, w in segments for bit in range(w)]


def _shared(fps: DataFrame, max_distance: int) -> DataFrame:
    """variant, node and n for nodes (node, lane, fp): every variant of a lane that n > 1 nodes share. A variant is lane, slot and rest in one number.

    Variants are counted by partial sums, so no task gathers a hot one.
    """
    cuts = _cuts(max_distance)
    lane = F.shiftleft(F.col("lane").cast("bigint"), 38)
    keys = [F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask)).bitwiseOR(lane).bitwiseOR(F.lit(slot)) for shift, mask, slot in cuts]
    counts = materialize(fps.select(F.explode(F.array(*keys)).alias("variant")).groupBy("variant").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    told = fps.sparkSession.sparkContext.broadcast(bloom_filter(counts.select("variant"), counts.count(), lambda b: b.column("variant").to_numpy(zero_copy_only=False).view(np.uint64)))
    shifts, masks, slots = (np.array(x, np.uint64) for x in zip(*cuts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, lanes, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "lane", "fp"))
            above = (lanes.astype(np.uint64) << np.uint64(38))[:, None] | slots
            found = ((fp.view(np.uint64)[:, None] >> shifts & masks) | above).ravel()
            at = np.flatnonzero(passes(told.value, found))
            yield pa.record_batch([pa.array(found[at].view(np.int64)), pa.array(node[at // len(slots)])], names=["variant", "node"])

    return fps.select("node", "lane", "fp").mapInArrow(run, "variant bigint, node bigint").join(counts, "variant")


def links(fps: DataFrame, max_distance: int = 2, hot_limit: int = HOT_LIMIT) -> DataFrame:
    """Links between distinct fingerprints (column fp) at up to max_distance bits: a and b.

    Below hot variants a link may be given through a third fingerprint that is linked to both ends, so components are exact.
    """
    key = ["variant"]
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_distance
    hubs = max_distance <= 2
    nodes = fps.select(F.col("fp").alias("node"), F.lit(0).alias("lane"), "fp")
    kept = materialize(_shared(nodes, max_distance).withColumnRenamed("node", "fp"), "variants")
    cold = kept.where(F.col("n") <= hot_limit) if hubs else kept
    other = cold.select(*key, F.col("fp").alias("b"))
    pairs = cold.select(*key, F.col("fp").alias("a")).join(other, key).where("a < b").where(close("a", "b")).select("a", "b")
    if hubs:
        hot = kept.where(F.col("n") > hot_limit).select("fp").distinct()
        if max_distance == 2:
            points = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
            near = hot.select("fp", F.explode(F.array(*points)).alias("point"))
            tied = near.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n").join(near, "point").select(F.col("fp").alias("a"), "b")
        else:  # at one bit, or none, a variant of the whole fingerprint ties its two
            wiped = [F.struct(F.lit(i).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed((1 << 64) - 1 - (1 << i)))).alias("point")) for i in range(64)]
            near = hot.select("fp", F.inline(F.array(*wiped)))
            tied = near.groupBy("bit", "point").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where(close("a", "b")).select("a", "b")
        pairs = pairs.union(tied)
    return pairs.where("a <> b")


def simhash_groups(docs: DataFrame, shingle_words: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links; one row per input row."""
    rows = materialize(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")  # written, so that they are dealt out anew before each becomes many variants
    roots = connected_components(links(nodes.select("fp").repartition(partitions(docs.sparkSession), "fp"), max_distance))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.select("root", "least_id").groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialize(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _lanes(docs: DataFrame, id_col: str, text_col: str, feature_words: int, lanes: int) -> DataFrame:
    """doc_id, text_key, digest (128 bits of SHA-256 of the text with A-Z lower-cased: copies are one node) and lanes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(ascii_lower(text), 256), 1, 32))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), digest.alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lanes_of(x, feature_words, lanes) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), b.column("digest"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_key", "digest", "lanes"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key bigint, digest binary, lanes array<bigint>")


#: Nodes under a hot variant or shingle that all others there meet: the least one of each of so many classes.
LEADERS = 4


def _leaders(rows: DataFrame, key: list[str], names: tuple[str, ...] = ("node",)) -> DataFrame:
    """key and the leaders' columns, as o_ + name: in each class the row with the least names, in their order."""
    least = rows.groupBy(*key, F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("class")).agg(F.min(F.struct(*names)).alias("o"))
    return least.select(*key, *(F.col(f"o.{c}").alias(f"o_{c}") for c in names))


def lane_candidates(nodes: DataFrame, hot_limit: int = HOT_TEXTS) -> DataFrame:
    """Pairs a < b of nodes (node, lanes) that share a one-bit-wiped segment of a lane, and a row a = b for each hot node.

    Under a variant of up to hot_limit nodes all are paired. Nodes under a larger one are hot: here they only meet a few
    leaders, which settles groups of near copies; hot_links() compares what is left.
    """
    key = ["variant"]
    lane = nodes.select("node", F.posexplode("lanes").alias("lane", "fp"))
    shared = materialize(_shared(lane, 2), "variants")
    cold, hot = shared.where(F.col("n") <= hot_limit), shared.where(F.col("n") > hot_limit)
    met = cold.select(*key, F.col("node").alias("a")).join(cold.select(*key, F.col("node").alias("b")), key).where("a < b").select("a", "b")
    few = hot.groupBy("node", F.pmod("variant", F.lit(LEADERS)).alias("class")).agg(F.min("variant").alias("variant")).drop("class")  # equal segments share all their variants: a few stand for them
    led = few.join(_leaders(few, key), key).where("o_node < node").select(F.col("o_node").alias("a"), F.col("node").alias("b"))
    return met.union(led).union(hot.select(F.col("node").alias("a"), F.col("node").alias("b"))).distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with a node, and the root of its component so far."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(shared >= similarity * (F.size("a_set") + F.size("b_set") - shared)).select("a", "b")


def hot_links(hot: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Components (node, root) of roots and of all links between hot nodes, exactly.

    Shingles are ordered from rare to frequent. Two sets that are similar enough share one within the prefix of each, and
    at its first such place there is enough left of both. Each set first meets a few leaders under its shingles: the sets
    with the fewest rarer shingles of their own, so the text that a group's members were made from is among them, and to it
    they are closest. Then sets that are still in different components are paired. Members of one component never are.
    """
    filled = F.when(F.size("shingles") > 0, F.col("shingles")).otherwise(F.array(F.lit(0).cast("bigint")))  # texts without words are alike
    words = hot.join(sets, "node").select("node", F.size(filled).alias("size"), F.explode(filled).alias("s"))
    ranked = words.join(words.groupBy("s").agg(F.count("*").alias("n")), "s").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("n", "s")) - 1)
    left, slack = F.col("size") - F.col("place"), 1e-9
    prefix = materialize(ranked.where("n > 1").where(left >= similarity * F.col("size") - slack).select("node", "size", "s", "place"), "prefix")
    both = similarity / (1 + similarity)

    rows = materialize(_rooted(prefix.select("node", "s", "place"), roots), "rooted")
    met = rows.join(_leaders(rows, ["s"], ("place", "node", "root")), "s").where("o_root <> root").select(F.least("o_node", "node").alias("a"), F.greatest("o_node", "node").alias("b")).distinct()
    star = lambda r: r.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = connected_components(star(roots).union(_verified(met, sets, similarity)))

    # two sets may be similar if each has room for its share of the other; a component has room if one of its sets has
    room = F.col("size") - F.col("place") - both * F.col("size")
    probe = _rooted(prefix, roots).withColumn("room", room)
    index = probe.where(left >= 2 * both * F.col("size") - slack)  # the smaller set of a pair
    fits = lambda x, y: (F.col(f"{x}_room") >= both * F.col(f"{y}_least") - slack) & (F.col(f"{y}_most") >= both * F.col(f"{x}_size") - slack)
    named = lambda rows, x: rows.select("s", *[F.col(c).alias(f"{x}_{c}") for c in ("root", "node", "size", "room")])
    parts = lambda rows, x: rows.groupBy("s", F.col("root").alias(f"{x}_root")).agg(F.max("room").alias(f"{x}_most"), F.min("size").alias(f"{x}_least"))
    may = (F.col("a_most") >= both * F.col("b_least") - slack) & (F.col("b_most") >= both * F.col("a_least") - slack)
    apart = parts(index, "a").join(parts(probe, "b"), "s").where("a_root <> b_root").where(may)
    enough = (F.col("a_room") >= both * F.col("b_size") - slack) & (F.col("b_room") >= both * F.col("a_size") - slack)
    smaller = F.struct("a_size", "a_node") < F.struct("b_size", "b_node")
    near = apart.join(named(index, "a"), ["s", "a_root"]).where(fits("a", "b"))
    pairs = near.join(named(probe, "b"), ["s", "b_root"]).where(smaller & enough)
    return connected_components(star(roots).union(_verified(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), sets, similarity)))


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """node and shingles (distinct 64-bit hashes) of the documents named in wanted (node, doc_id, text_key)."""
    named = wanted.select("node", F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(named, rows.doc_id.eqNullSafe(named.d) & (rows.text_key == named.k)).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x, shingle_words)).view(np.int64) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def near_copy_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, feature_words: int = 2, lanes: int = 8, hot_limit: int = HOT_TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and component_id, the smallest id of the near copies' group; one row per input row.

    A longer fingerprint of ``lanes`` times 64 bits over shingles of ``feature_words`` words stands in for max_distance: two
    texts are candidates if one of its 32-bit segments differs by at most one bit, found through the same deletion variants.
    Candidates are verified: they are linked if the Jaccard similarity of their sets of ``shingle_words``-word shingles is
    ``similarity`` or more. Texts under a variant that more than ``hot_limit`` share are compared by their shingles instead,
    all with all. Copies (A-Z lower-cased) are always one group.
    """
    rows = materialize(_lanes(docs, id_col, text_col, feature_words, lanes), "lanes")
    nodes = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "lanes")).alias("first"), F.min("doc_id").alias("least_id"))
    nodes = materialize(nodes.select("digest", F.monotonically_increasing_id().alias("node"), "least_id", "first.doc_id", "first.text_key", "first.lanes"), "nodes")
    found = materialize(lane_candidates(nodes.select("node", "lanes").repartition(partitions(docs.sparkSession), "node"), hot_limit), "candidates")
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    sets = materialize(_shingle_sets(docs, nodes.join(ends, "node"), id_col, text_col, shingle_words), "shingles")
    roots = connected_components(_verified(found.where("a < b"), sets, similarity))
    hot = found.where("a = b").select(F.col("a").alias("node"))
    if not hot.isEmpty():
        roots = hot_links(hot, sets, roots, similarity)
    rooted = nodes.select("digest", "node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialize(rooted.select("digest", "root").join(named, "root").select("digest", "component_id"), "classes")
    return rows.select("doc_id", "text_key", "digest").join(classes, "digest").select("doc_id", "text_key", "component_id")


def simhash_dedup(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents without near copies, columns unchanged: of each group of near_copy_groups() the row with the smallest id stays.

    Rows without an id are left alone; of repeated rows of one id and text, one stays.
    """
    groups = near_copy_groups(docs, shingle_words, similarity, id_col=id_col, text_col=text_col, **settings)
    dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    # a document is one struct until its columns come back, so no name of theirs meets one of these
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    left = keyed.where("id is not null").join(dropped, ["id", "key"], "left_anti")
    once = left.withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("id"))).where("nth = 1")
    return once.select("row").unionByName(keyed.where("id is null").select("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
