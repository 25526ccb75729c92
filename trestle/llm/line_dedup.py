"""Line dedup by an exact set-similarity join.

A line is the set of its words (runs without white space, unchanged). A line is removed if a line that comes before it, in
order of document id and line number, has a Jaccard similarity of ``threshold`` or more; lines are judged on the input.

1. Word counts of all lines go into a count-min row of ``2**count_bits`` counters, summed over tasks. Ordering words by
   estimated count, then by digest, is one total order for all lines, rarest first, whatever the estimates' errors.
2. Lines of one word set are one set, kept with its first line; the others are removed and go no further. Sets are told
   apart by a cryptographic digest of their words. Copies within a task are found before the shuffle.
3. Each set is indexed under the words of its prefix: two sets of the wanted similarity share one. Words that occur once
   are left out. Pairs that meet under a word are held to the length filter, the positional filter and a bound on the
   symmetric difference by parity bitmaps that are as wide as the sets are large, all of which only turn away pairs that
   cannot be similar. Of the partners that pass, a set takes the few closest of each bucket of words.
4. The lines of these pairs are fetched, by a Bloom filter that goes to the texts, and their words are compared: the closest
   partner first, the others only if that does not settle the set. Sets that are not settled and had more partners than
   they took ask the index again, for eight times as many at least, until no partner is left. A group of near copies is settled by
   a few partners of each member, so its pairs leave no task.

Defined cases: null texts have no lines; lines without words are always kept; ids are integers, and a null id counts as the
least 64-bit integer in the order and comes back null; rows of one id are told apart by a hash of their text, and the lines
of identical rows count as the same line, so they keep or lose it together; a very long text or line is worked on whole; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.llm._common import discard, materialize, partitions
from trestle.llm.bloom import BLOCKS, added_up, bloom_filter, in_blocks, passes
from trestle.llm.words import Words, chunks, digest_pairs, mix

NULL_ID, _ODD = -(1 << 63), 0xD6E8FEB86659FD93
#: What tells a line from others, in order.
PLACE = ("id", "text_key", "line_no")


class LineSets:
    """The distinct words of every line that has words, by line, and within a line by rising count and hash."""

    def __init__(self, words: Words, counts: np.ndarray):
        first, line = words.lines()
        n = len(first)
        self.text, self.line_no = words.text[first], words.line_no[first]
        h = words.hash
        rank = np.minimum(counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)], (1 << 20) - 1).astype(np.int64)
        order = None
        if n <= 1 << 20:
            packed = (line.astype(np.uint64) << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(24)) | (h >> np.uint64(40))
            order = np.argsort(packed)
            p, g = packed[order], h[order]
            if ((p[1:] == p[:-1]) & (g[1:] != g[:-1])).any():  # two words with equal leading bits: all bits have to decide
                order = None
        if order is None:
            order = np.lexsort((h, rank, line))
        h, line, rank = h[order], line[order], rank[order]
        kept = np.ones(len(h), bool)
        kept[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.hash, self.line, self.rank = h[kept], line[kept], rank[kept]
        self.size = np.bincount(self.line, minlength=n) if n else np.zeros(0, np.int64)
        self.start = np.cumsum(self.size) - self.size
        text, at = words.spelled(order[kept])
        cuts = at[np.append(self.start, len(self.hash))].tolist()
        #: Of every line, the digest of its words.
        self.digest = digest_pairs(text[i:j] for i, j in zip(cuts, cuts[1:], strict=False))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (never null), text_key and text (bytes)."""
    number = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID))
    return docs.select(number.alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))


def _counters(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], count_bits: int) -> np.ndarray:
    """Counters of hashes: the place of one is its low bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mask = np.zeros(1 << count_bits, np.int64), np.uint64((1 << count_bits) - 1)
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=len(total))
                held.clear()

        for b in batches:
            for hashes in hashes_of(b):
                held.append((hashes & mask).astype(np.uint32))
                if sum(map(len, held)) > len(total):
                    flush()
        flush()
        yield in_blocks([x.tobytes() for x in np.minimum(total, (1 << 32) - 1).astype("<u4").reshape(BLOCKS, -1)])

    def add(parts: Iterator[bytes]) -> np.ndarray:
        total = np.zeros((1 << count_bits) // BLOCKS, np.int64)
        for x in parts:
            total += np.frombuffer(x, "<u4")
        return np.minimum(total, (1 << 32) - 1).astype("<u4")

    found = added_up(rows.mapInArrow(count, "block int, data binary"), add)  # 4 * 2**count_bits bytes in all
    return np.concatenate([np.frombuffer(found[i], "<u4") for i in range(BLOCKS)]) if found else np.zeros(1 << count_bits, "<u4")


def word_counts(rows: DataFrame, count_bits: int, key: int) -> np.ndarray:
    """Counters of words over all texts."""
    return _counters(rows.select("text"), lambda b: (words.hash for _, words in chunks(b.column("text"), key)), count_bits)


def prefix_counts(sets: DataFrame, count_bits: int) -> np.ndarray:
    """Counters of words over the prefixes of sets."""
    return _counters(sets.select("prefix"), lambda b: iter([_words_of(b.column("prefix")).astype(np.uint64)]), count_bits)


def _words_of(prefix: pa.ListArray) -> np.ndarray:
    return prefix.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32)


#: A set that so many lines of a batch share is remembered by the task, which then holds back its later copies; so many sets at most.
MANY, HELD_SETS = 16, 65_536


class _Copies:
    """Finds lines of a task that repeat the word set of a line before them. What it does not notice, the shuffle finds."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], tuple] = {}

    def roles(self, s1: np.ndarray, s2: np.ndarray, place: list[np.ndarray]) -> np.ndarray:
        """0: may be the first line of its set, 1: a copy of an earlier line, 2: the same line again."""
        order = np.lexsort((*reversed(place), s2, s1))
        a, b = s1[order], s2[order]
        first = np.ones(len(order), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        same = np.logical_and.reduce([p[order] == p[order][starts][group] for p in place])
        out = np.where(first, 0, np.where(same, 2, 1))
        if self.known:
            for g in np.flatnonzero(np.isin(a[starts], np.fromiter((k[0] for k in self.known), np.uint64, len(self.known)))).tolist():
                i = starts[g]
                told = self.known.get((int(a[i]), int(b[i])))
                if told and told < tuple(int(p[order[i]]) for p in place):
                    out[i] = 1
        sizes = np.diff(np.append(starts, len(order)))
        for i in starts[sizes >= MANY].tolist():
            key, here = (int(a[i]), int(b[i])), tuple(int(p[order[i]]) for p in place)
            if len(self.known) >= HELD_SETS:
                self.known.clear()
            self.known[key] = min(self.known.get(key, here), here)
        roles = np.empty(len(order), np.int8)
        roles[order] = out
        return roles


#: The bitmap of a set has 64 bits, and twice as many each time that the set has more than so many words.
WIDER = (64, 160, 360, 720)


def parity_bitmaps(s: LineSets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bitmap of each line folded to 64 bits, all words (64 bits) of the bitmaps but each one's last, and how many these are.

    A bit is the parity of the words at its place. The last word is the fold xor the others.
    """
    width = np.int64(1) << np.searchsorted(WIDER, s.size)
    upto = np.cumsum(width)
    place = (s.hash >> np.uint64(54)).astype(np.int64) & (64 * width - 1)[s.line]
    odd = np.bincount(64 * (upto - width)[s.line] + place, minlength=64 * int(upto[-1])) & 1
    words = np.packbits(odd.astype(bool), bitorder="little").view("<u8")
    kept = np.ones(len(words), bool)
    kept[upto - 1] = False
    return np.bitwise_xor.reduceat(words, upto - width), words[kept], width - 1


def lines_of(rows: DataFrame, counts: np.ndarray, threshold: float, key: int) -> DataFrame:
    """One row per line with words: id, text_key, line_no, copy (is it known to repeat an earlier one), s1 and s2 (digest of the word set), size, bitmap (64 bits) and wide (its other words), and prefix, less the ``skip`` words at its start that occur once."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    names = ("id", "text_key", "line_no", "copy", "s1", "s2", "size", "bitmap", "wide", "skip", "prefix")

    def of_texts(words: Words) -> dict[str, np.ndarray]:
        s = LineSets(words, shared.value)
        length = s.size - np.ceil(threshold * s.size - 1e-9).astype(np.int64) + 1
        within = np.arange(len(s.hash)) - s.start[s.line] < length[s.line]
        once = within & (s.rank <= 1)
        listed = within & ~once
        bitmap, wide, widths = parity_bitmaps(s)
        return {
            "text": s.text, "line_no": s.line_no.astype(np.int32), "s1": s.digest[:, 0], "s2": s.digest[:, 1], "size": s.size.astype(np.int32),
            "bitmap": bitmap.view(np.int64), "wide": wide, "widths": widths, "skip": np.bincount(s.line[once], minlength=len(s.size)).astype(np.int32),
            "listed": np.bincount(s.line[listed], minlength=len(s.size)), "words": (s.hash[listed] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = _Copies()
        for b in batches:
            found = []
            for row, words in chunks(b.column("text"), key):
                if len(words.hash):
                    found.append(of_texts(words))
                    found[-1]["text"] += row
            if not found:
                continue
            x = {k: np.concatenate([p[k] for p in found]) for k in found[0]}
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False)[x["text"]] for c in ("id", "text_key"))
            roles = copies.roles(x["s1"], x["s2"], [ids, keys, x["line_no"]])
            alone = roles == 1  # copies need no group: they are spread by a digest of their place
            x["s1"][alone] = _line_keys(ids, keys, x["line_no"])[alone]
            x["listed"] = np.where(alone, 0, x["listed"])
            wide = x["wide"][np.repeat(~alone, x["widths"])]
            x["widths"] = np.where(alone, 0, x["widths"])
            listed = x["words"][np.repeat(~alone, np.concatenate([p["listed"] for p in found]))]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(x["listed"]))).astype(np.int32)), pa.array(listed))
            wide = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.concatenate(([0], 8 * np.cumsum(x["widths"]))).astype(np.int32)), pa.py_buffer(wide)])
            columns = [pa.array(ids), pa.array(keys), pa.array(x["line_no"]), pa.array(alone), pa.array(x["s1"].view(np.int64)), pa.array(x["s2"].view(np.int64)), pa.array(x["size"]), pa.array(x["bitmap"]), wide, pa.array(x["skip"]), prefix]
            yield pa.record_batch(columns, names=list(names)).filter(pa.array(roles < 2))

    return rows.mapInArrow(run, "id bigint, text_key bigint, line_no int, copy boolean, s1 bigint, s2 bigint, size int, bitmap bigint, wide binary, skip int, prefix array<int>")


def numbered_sets(lines: DataFrame) -> DataFrame:
    """Lines with their place: copy, or else the first line of a set, which has a number ``set`` with no meaning, size, bitmap, skip and prefix."""
    place = F.struct(*PLACE)
    upto = Window.partitionBy("s1", "s2").orderBy(*PLACE)
    told = lines.withColumns({"nth": F.row_number().over(upto), "first": F.first(place).over(upto)})
    told = told.withColumn("copy", F.col("copy") | (place > F.col("first"))).where("copy or nth = 1")
    return told.select(*PLACE, "copy", "size", "bitmap", "wide", "skip", F.when(~F.col("copy"), F.col("prefix")).alias("prefix"), F.monotonically_increasing_id().alias("set"))


#: Index entries of a bucket, about; entries of a word in one cell of a bucket; pairs that are held against the filters at once.
BUCKET, CELL, AT_ONCE = 1 << 20, 1 << 17, 1 << 21
_ENTRY = (("key", "<u8"), ("set", "<i8"), ("id", "<i8"), ("bitmap", "<u8"), ("size", "<i4"), ("at", "<i4"), ("asks", "?"))


def _in_cells(x: dict[str, np.ndarray], common: np.ndarray) -> dict[str, np.ndarray]:
    """Index entries, keyed by word and cell. A common word's entries are dealt into blocks, and each goes to the cells of its block with every block."""
    blocks = common[(x["word"] & np.uint32(len(common) - 1)).astype(np.int64)].astype(np.int64) // CELL + 1
    row = np.repeat(np.arange(len(blocks)), blocks)
    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = x["set"][row] % blocks[row]
    cell = np.minimum(own, other) * blocks[row] + np.maximum(own, other)
    return {"key": (x["word"][row].astype(np.uint64) << np.uint64(32)) | cell.astype(np.uint64)} | {k: v[row] for k, v in x.items() if k != "word"}


def _packed(data: dict[str, np.ndarray], which: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(data[k][which].astype(t, copy=False).tobytes() for k, t in _ENTRY), 1)


def _unpacked(parts: list[bytes]) -> dict[str, np.ndarray]:
    width, found = sum(np.dtype(t).itemsize for _, t in _ENTRY), []
    for part in map(zstandard.decompress, parts):
        n, at, columns = len(part) // width, 0, {}
        for k, t in _ENTRY:
            columns[k] = np.frombuffer(part, t, n, at)
            at += columns[k].nbytes
        found.append(columns)
    return {k: np.concatenate([c[k] for c in found]) for k, _ in _ENTRY}


def _met(x: dict[str, np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in x) of entries of one key that pass the length, positional and bitmap filters, some at a time; the keys are sorted, and the sizes within a key."""
    group = np.cumsum(np.append(False, x["key"][1:] != x["key"][:-1])).astype(np.int64) << 32
    size, left = x["size"].astype(np.int64), (x["size"] - x["at"]).astype(np.int64)
    low = np.searchsorted(group | size, group | np.ceil(threshold * size - 1e-9).astype(np.int64))
    n = np.arange(len(low)) - low
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, "right")))
        a = np.repeat(np.arange(i, j), n[i:j])
        b = np.repeat(low[i:j] - (np.cumsum(n[i:j]) - n[i:j]), n[i:j]) + np.arange(len(a))
        both = size[a] + size[b]
        near = np.flatnonzero(np.minimum(left[a], left[b]) >= threshold / (1 + threshold) * both - 1e-9)
        a, b, both = a[near], b[near], both[near]
        near = np.bitwise_count(x["bitmap"][a] ^ x["bitmap"][b]) <= (1 - threshold) / (1 + threshold) * both + 1e-9
        yield a[near], b[near]
        i = j


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0] .. starts[0] + lengths[0] - 1, starts[1] .., end to end."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _runs(x: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def _wide_packed(sets: np.ndarray, row: np.ndarray, wide: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The wide bitmaps (words, their start and number for each row) of the entries' sets, each set once."""
    words, starts, lengths = wide
    own = row[_runs(sets)]
    return np.int64(len(own)).tobytes() + lengths[own].astype(np.uint8).tobytes() + words[_ragged(starts[own], lengths[own])].tobytes()


def _bitmaps(parts: list[bytes], x: dict[str, np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries that were unpacked from parts of so many entries, all bitmaps end to end, where each entry's begins and its number of words."""
    words, width, at, i = [np.zeros(0, "<u8")], np.zeros(len(x["set"]), np.int64), np.zeros(len(x["set"]), np.int64), 0
    total = 0
    for part, n in zip(parts, sizes, strict=True):
        first = _runs(x["set"][i : i + n])
        m = int(np.frombuffer(part, "<i8", 1)[0])
        lengths = np.frombuffer(part, np.uint8, m, 8).astype(np.int64)
        told = np.frombuffer(part[8 + m :], "<u8")
        ends = np.cumsum(lengths + 1)
        full = np.zeros(int(ends[-1]) if m else 0, np.uint64)
        full[_ragged(ends - lengths - 1, lengths)] = told
        full[ends - 1] = x["bitmap"][i + first] ^ (np.bitwise_xor.reduceat(full, ends - lengths - 1) if m else full)
        each = np.diff(np.append(first, n))
        width[i : i + n], at[i : i + n] = np.repeat(lengths + 1, each), np.repeat(total + ends - lengths - 1, each)
        words.append(full)
        total += len(full)
        i += n
    return np.concatenate(words), at, width


def _apart(words: np.ndarray, at: np.ndarray, width: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places where the bitmaps of entries a and b differ, the wider one folded: no more than the words that one set has and the other has not."""
    out, kinds = np.zeros(len(a), np.int64), 256 * width[a] + width[b]
    for kind in np.unique(kinds).tolist():
        some = np.flatnonzero(kinds == kind)
        n, folded = min(divmod(kind, 256)), []
        for i, w in zip((a[some], b[some]), divmod(kind, 256), strict=True):
            folded.append(np.bitwise_xor.reduce(words[at[i][:, None] + np.arange(w)].reshape(-1, w // n, n), axis=1))
        out[some] = np.bitwise_count(folded[0] ^ folded[1]).sum(1, dtype=np.int64)
    return out


def _closest(x: np.ndarray, y: np.ndarray, apart: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct pairs (x, y), the places of those with the ``keep`` closest y of each x, and of those left out."""
    order = np.lexsort((y, apart, x))
    a, b = x[order], y[order]
    order = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]]
    first = _runs(x[order])
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[nth < keep], order[nth >= keep]


#: Pairs that a bucket holds before it drops all but the closest.
HELD_PAIRS = 1 << 21


def close_partners(sets: DataFrame, asking: DataFrame | None, counts: np.ndarray, threshold: float, keep: int) -> DataFrame:
    """x, ys and more: for the sets x that ask (all, or those of ``asking``), the closest sets y under a shared prefix word that pass the filters, closest first, and whether there are others.

    No y is in a document behind x's. The index is shuffled once, in buckets of words whose entries lie in packed arrays (``counts``
    tell the words that are too common for one cell of a bucket); a bucket names ``keep`` partners of a set.
    """
    spark = sets.sparkSession
    if asking is None:
        told = sets.withColumn("asks", F.lit(True))
        entries = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    else:
        told = sets.join(asking.withColumn("told", F.lit(True)), "set", "left").withColumn("asks", F.col("told").isNotNull())
        asked = prefix_counts(told.where("asks"), len(counts).bit_length() - 1) > 0
        counts = np.where(asked, counts, np.uint32(0))
        entries = int(counts.sum(dtype=np.int64))
    shared, mask = spark.sparkContext.broadcast(counts), np.uint32(len(counts) - 1)
    n = max(partitions(spark), entries // BUCKET)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        bitmaps: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if any(len(h["key"]) for h in held):
                shift = np.cumsum([0, *(len(lengths) for _, lengths in bitmaps)]).tolist()
                data = {k: np.concatenate([h[k] + i if k == "row" else h[k] for h, i in zip(held, shift, strict=False)]) for k in held[0]}
                lengths = np.concatenate([x for _, x in bitmaps])
                wide = np.concatenate([x for x, _ in bitmaps]), np.cumsum(lengths) - lengths, lengths
                bucket = (mix(data["key"]) % np.uint64(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                cut = [order[i:j] for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True)]
                columns = [pa.array(bucket[order[cuts]]), pa.array([len(c) for c in cut]), pa.array([_packed(data, c) for c in cut], pa.binary())]
                columns.append(pa.array([_wide_packed(data["set"][c], data["row"][c], wide) for c in cut], pa.binary()))
                yield pa.record_batch(columns, names=["bucket", "n", "data", "wide"])
            held.clear()
            bitmaps.clear()

        for b in batches:
            lengths = np.diff(b.column("prefix").offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("set", "id", "size", "bitmap", "skip", "asks")}
            at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + x["skip"][row]
            word = _words_of(b.column("prefix"))
            met = np.flatnonzero(shared.value[word & mask] > 0)  # a word that nobody asks for brings nothing
            row = row[met]
            held.append(_in_cells({"word": word[met], "at": at[met], "row": row, **{k: x[k][row] for k in ("set", "id", "size", "bitmap", "asks")}}, shared.value))
            wide = b.column("wide")
            bitmaps.append((np.frombuffer(b"".join(wide.to_pylist()), "<u8"), pc.binary_length(wide).to_numpy(zero_copy_only=False).astype(np.int64) // 8))
            if sum(len(h["key"]) for h in held) >= BUCKET:
                yield from flush()
        yield from flush()

    def meet(bucket: pa.Table) -> pa.Table:
        x = _unpacked(bucket.column("data").to_pylist())
        words, at, width = _bitmaps(bucket.column("wide").to_pylist(), x, bucket.column("n").to_pylist())
        order = np.lexsort((x["size"], x["key"]))
        x, at, width = {k: v[order] for k, v in x.items()}, at[order], width[order]
        size, found, more = x["size"].astype(np.int64), np.zeros((0, 3), np.int64), [np.zeros(0, np.int64)]
        held, n_held = [found], 0

        def closest() -> np.ndarray:
            pairs = np.concatenate(held)
            kept, others = _closest(pairs[:, 0], pairs[:, 1], pairs[:, 2], keep)
            more.append(np.unique(pairs[others, 0]))
            return pairs[kept]

        for a, b in _met(x, threshold):
            both = size[a] + size[b]
            apart = _apart(words, at, width, a, b)
            near = np.flatnonzero((apart <= (1 - threshold) / (1 + threshold) * both + 1e-9) & (x["set"][a] != x["set"][b]))
            a, b, share = a[near], b[near], (apart[near] << 20) // both[near]
            for p, q in ((a, b), (b, a)):
                told = x["asks"][p] & (x["id"][p] >= x["id"][q])
                held.append(np.stack([x["set"][p[told]], x["set"][q[told]], share[told]], 1))
                n_held += len(held[-1])
            if n_held >= HELD_PAIRS + len(found):
                found = closest()
                held, n_held = [found], len(found)
        pairs = closest()
        first = _runs(pairs[:, 0])
        ys = pa.ListArray.from_arrays(pa.array(np.append(first, len(pairs)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(pairs[:, 2]), pa.array(pairs[:, 1])], ["apart", "y"]))
        return pa.table({"x": pairs[first, 0], "ys": ys, "more": np.isin(pairs[first, 0], np.concatenate(more))})

    packed = told.select("set", "id", "size", "bitmap", "wide", "skip", "prefix", "asks").mapInArrow(pack, "bucket bigint, n bigint, data binary, wide binary")
    met = packed.groupBy("bucket").applyInArrow(meet, "x bigint, ys array<struct<apart: bigint, y: bigint>>, more boolean")
    met = met.groupBy("x").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ys")))).alias("ys"), F.max("more").alias("more"))
    return met.select("x", F.transform("ys", lambda p: p["y"]).alias("ys"), "more")


def _line_keys(ids: np.ndarray, text_keys: np.ndarray, line_no: np.ndarray | int) -> np.ndarray:
    """64 bits of a line's place, or of a document's with line -1."""
    with np.errstate(over="ignore"):
        lines = np.broadcast_to(np.asarray(line_no, np.int64), ids.shape).view(np.uint64)
        return mix(mix(ids.astype(np.int64).view(np.uint64)) + text_keys.astype(np.int64).view(np.uint64) * np.uint64(_ODD) + lines)


def line_filter(lines: DataFrame) -> np.ndarray:
    """A Bloom filter of lines (id, text_key, line_no) and of their documents."""

    def keys_of(b: pa.RecordBatch) -> np.ndarray:
        ids, keys, line_no = (b.column(c).to_numpy(zero_copy_only=False) for c in PLACE)
        return np.concatenate([_line_keys(ids, keys, line_no), _line_keys(ids, keys, -1)])

    return bloom_filter(lines.select(*PLACE), 2 * lines.count(), keys_of)


#: Bits of a line's sketch, and lines that are sketched at once.
SKETCH, SKETCHED = 1024, 4096


def sketches(lines: list[bytes], key: int) -> tuple[np.ndarray, list[bytes]]:
    """Of each line, the number of its distinct words and a bitmap of the parity of words by place.

    The places where two bitmaps differ are no more than the words that one line has and the other has not.
    """
    sizes, found = np.zeros(len(lines), np.int64), []
    for k in range(0, len(lines), SKETCHED):
        some = lines[k : k + SKETCHED]
        line, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for row, words in chunks(pa.array(some, pa.binary()), key):
            line.append(words.text + row)
            hashes.append(words.hash)
        line, hashes = np.concatenate(line), np.concatenate(hashes)
        order = np.lexsort((hashes, line))
        line, hashes = line[order], hashes[order]
        own = np.append(True, (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1]))[: len(line)]
        line, places = line[own], (hashes[own] % np.uint64(SKETCH)).astype(np.int64)
        sizes[k : k + len(some)] = np.bincount(line, minlength=len(some))
        odd = np.bincount(line * SKETCH + places, minlength=len(some) * SKETCH) & 1
        found += [x.tobytes() for x in np.packbits(odd.astype(bool).reshape(len(some), SKETCH), axis=1)]
    return sizes, found


def _close_enough(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) whose sketches do not rule out that they are similar."""
    side = lambda n: lines.select(F.col("set").alias(n), F.col("size").alias(f"{n}_size"), F.col("sketch").alias(f"{n}_sketch"))
    met = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", (F.col("x_size") + F.col("y_size")).alias("both"), "x_sketch", "y_sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u8").reshape(b.num_rows, -1) for c in ("x_sketch", "y_sketch"))
            near = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (1 - threshold) / (1 + threshold) * b.column("both").to_numpy() + 1e-9
            yield b.select(["x", "y"]).filter(pa.array(near))

    return met.mapInArrow(run, "x bigint, y bigint")


def _texts_of_lines(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text_key, line_no, line (bytes), size and sketch of the lines wanted (id, text_key, line_no) and of a few others.

    Texts stay where they are: a filter of the documents and lines wanted goes to them.
    """
    shared, key = rows.sparkSession.sparkContext.broadcast(line_filter(wanted)), secrets.randbits(62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        for b in batches:
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_key"))
            hit = np.flatnonzero(passes(told, _line_keys(ids, keys, -1)))
            if not len(hit):
                continue
            lists = [(b.column("text")[i].as_py() or b"").split(b"\n") for i in hit.tolist()]
            sizes = np.array([len(x) for x in lists])
            at = np.repeat(hit, sizes)
            line_no = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            mine = np.flatnonzero(passes(told, _line_keys(ids[at], keys[at], line_no)))
            flat = [x for lines in lists for x in lines]
            told_lines = [flat[i] for i in mine.tolist()]
            size, sketch = sketches(told_lines, key)
            columns = [pa.array(ids[at[mine]]), pa.array(keys[at[mine]]), pa.array(line_no[mine].astype(np.int32)), pa.array(told_lines, pa.binary()), pa.array(size), pa.array(sketch, pa.binary())]
            yield pa.record_batch(columns, names=[*PLACE, "line", "size", "sketch"])

    return rows.mapInArrow(run, "id bigint, text_key bigint, line_no int, line binary, size bigint, sketch binary")


def _later_of_similar(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (x, y) whose lines have words of the wanted similarity, the set of the later line."""
    place = F.struct(*PLACE)
    side = lambda n: lines.select(F.col("set").alias(n), place.alias(f"{n}_place"), F.col("line").alias(f"{n}_line"))
    met = pairs.join(side("x"), "x").join(side("y"), "y").where("x_place <> y_place")
    met = met.select(F.when(F.col("x_place") > F.col("y_place"), F.col("x")).otherwise(F.col("y")).alias("set"), "x_line", "y_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([set(t.split()) for t in b.column(c).to_pylist()] for c in ("x_line", "y_line"))
            shared = [len(a & o) for a, o in zip(x, y, strict=True)]
            close = [n >= threshold * (len(a) + len(o) - n) - 1e-9 for n, a, o in zip(shared, x, y, strict=True)]
            yield pa.record_batch([b.column("set").filter(pa.array(close, pa.bool_()))], names=["set"])

    return met.mapInArrow(run, "set bigint").distinct()


#: Partners of a set that a bucket names in the first round, and how many times as many at least in each further round.
FEW, MORE = 8, 8


def _verified(rows: DataFrame, sets: DataFrame, partners: DataFrame, threshold: float) -> DataFrame:
    """Sets (set) of the pairs of x with ys whose line is similar to the other's, which is before it.

    Each x is compared with its closest partner first, and with the others only if that does not settle it. Sketches turn
    most of the others away.
    """
    ends = partners.select(F.col("x").alias("set")).union(partners.select(F.explode("ys"))).distinct()
    involved = materialize(sets.select("set", *PLACE).join(ends, "set"), "involved")
    lines = materialize(involved.join(_texts_of_lines(rows, involved), list(PLACE)).dropDuplicates(["set"]), "words")  # a repeated row gives its lines again
    first = materialize(_later_of_similar(partners.select("x", F.col("ys")[0].alias("y")), lines, threshold), "late")
    others = partners.where(F.size("ys") > 1).join(first.withColumnRenamed("set", "x"), "x", "left_anti")
    others = materialize(others.select("x", F.explode(F.slice("ys", 2, 1 << 30)).alias("y")), "others")
    second = materialize(_later_of_similar(_close_enough(others, lines, threshold), lines, threshold), "late")
    for table in (involved, lines, others):
        discard(table)
    return first.union(second).distinct()


def late_sets(rows: DataFrame, sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """The sets (set) that are similar to one before them."""
    late, asking, keep = None, None, FEW
    while True:
        partners = materialize(close_partners(sets, asking, counts, threshold, keep), "partners")
        found = _verified(rows, sets, partners, threshold)
        late = found if late is None else late.union(found)
        asking = materialize(partners.where("more").select(F.col("x").alias("set")).join(late, "set", "left_anti"), "asking")
        discard(partners)
        left = asking.count()
        if not left:
            return late.distinct()
        keep = max(keep * MORE, sets.count() // left)  # few that ask may take as many as there are sets in all


def removed_lines(docs: DataFrame, threshold: float = 0.8, count_bits: int = 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (a null one as the least integer), text_key and line_no of every line that resembles an earlier one."""
    rows, key = _rows(docs, id_col, text_col), secrets.randbits(62)  # the key of the words' hashes
    counts = word_counts(rows, count_bits, key)
    lines = materialize(numbered_sets(lines_of(rows, counts, threshold, key)), "lines")
    sets = lines.where("not copy")
    late = sets.join(late_sets(rows, sets, counts, threshold), "set")
    return lines.where("copy").select(*PLACE).union(late.select(*PLACE))


def line_dedup(docs: DataFrame, threshold: float = 0.8, count_bits: int = 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed and kept_text (the other lines, unchanged)."""
    gone = removed_lines(docs, threshold, count_bits, id_col, text_col).groupBy("id", "text_key").agg(F.collect_set("line_no").alias("gone"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumns({"id": F.coalesce("doc_id", F.lit(NULL_ID)), "text_key": F.xxhash64("text")})
    joined = texts.join(gone.hint("shuffle_hash"), ["id", "text_key"], "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                out = set(gone or ())
                n.append(len(lines))
                removed.append(len(out))
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text or "")
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, "doc_id bigint, n_lines bigint, n_removed bigint, kept_text string")
