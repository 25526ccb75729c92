"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one document. Every word covered by a window that also starts in a document
with a smaller id is removed; windows are judged on the input, not on what is left.

Documents are dealt into chunks by a hash of their id and text, one shuffle that all passes share:

1. Every chunk sketches its windows: ``depth`` rows of counters, cut into slices by window hash. Only counters in use are
   sent, sorted and delta-coded, one packed array for each chunk and slice, so a sketch is as wide as the corpus needs
   while nothing of that width is broadcast.
2. A task per slice adds the chunks' sketches up and answers each chunk, one bit for each of its counters: is the count
   two or more? Counts only overestimate, so no repeated window is lost.
3. Every chunk sends the distinct windows whose counters all say two or more, each with the least document id in the
   chunk: frequent passages are aggregated before the shuffle and no key has more than one entry for each chunk.
4. A task per range of window hashes groups them exactly and answers each chunk, one bit for each entry: does a document
   with a smaller id, in another chunk, have this window?
5. Every chunk marks and removes words.

Within a chunk windows are told apart by their words, between chunks by a cryptographic digest (128 bits of BLAKE2b) of
their words; the hashes of the sketch only choose which windows get that far.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; ids are integers, and a null
id counts as the least 64-bit integer in comparisons and comes back null; rows of one id, repeated rows too, never remove
each other's words; a very long text is one document of its chunk and costs a few dozen bytes a word there; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.llm._common import partitions
from trestle.llm.words import chunks, digest_pairs

NULL_ID = -(1 << 63)
DEPTH, COUNTERS_A_WINDOW = 2, 4
#: Odd multipliers of the two window hashes.
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _planes(values: np.ndarray) -> bytes:
    """An integer array by byte planes: the high bytes, which hardly vary, lie together for the compressor."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(dtype).reshape(n)


def _pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts))


def _unpack(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = 8 * n + np.cumsum(np.frombuffer(raw, "<i8", n))
    return [raw[i:j] for i, j in zip(np.concatenate(([8 * n], ends[:-1])).tolist(), ends.tolist(), strict=True)]


class _Chunk:
    """The windows of a chunk's documents."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        ids = table.column("id").combine_chunks()
        self.null, self.ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.texts = table.column("text").combine_chunks().fill_null(b"")
        hashes, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for row, words in chunks(self.texts):
            hashes.append(words.hash)
            doc.append(words.text + row)
        hashes, self.doc = np.concatenate(hashes), np.concatenate(doc)
        self.sizes = np.bincount(self.doc, minlength=len(self.ids))
        #: Of every document, the place of its first word.
        self.first = np.cumsum(self.sizes) - self.sizes
        total = len(hashes)
        n = max(0, total - window + 1)
        #: Places of the words at which a window starts.
        self.at = np.flatnonzero(np.arange(n) + window <= (self.first + self.sizes)[self.doc[:n]]) if n else np.zeros(0, np.int64)
        h1, h2, other = np.zeros(n, np.uint64), np.zeros(n, np.uint64), hashes ^ (hashes >> np.uint64(29))
        for j in range(window):
            h1 = h1 * np.uint64(_M1) + hashes[j : j + n]
            h2 = h2 * np.uint64(_M2) + other[j : j + n] * np.uint64(_M1)
        self.h1, self.h2 = (h1 ^ (h1 >> np.uint64(32)))[self.at], (h2 ^ (h2 >> np.uint64(31)))[self.at]

    def counters(self, slices: int, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each row of the sketch: distinct counters in use (slice * width + place), each window's index in them, windows at each."""
        part = self.h2 % np.uint64(slices)
        rows = [(self.h1 >> np.uint64(7 + 16 * i)) % np.uint64(width) for i in range(DEPTH)]
        return [np.unique(part * np.uint64(width) + r, return_inverse=True, return_counts=True) for r in rows]

    def _spelled(self, at: np.ndarray) -> Iterator[bytes]:
        """The words of the windows at some ascending places, joined by one space."""
        docs = self.doc[at]
        for d, i, j in _bounds(docs, np.unique(docs)):
            words = self.texts[int(docs[i])].as_py().split()
            text, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            last = at[i:j] - self.first[docs[i]] + self.window - 1
            starts = np.concatenate(([0], ends + 1))[last - self.window + 1]
            yield from (text[a:z] for a, z in zip(starts.tolist(), ends[last].tolist(), strict=True))

    def candidates(self, flags: list[np.ndarray], counters: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose counters are all flagged: the digests of the distinct ones in order, their least id, and of every window its index (-1: none)."""
        kept = np.flatnonzero(np.logical_and.reduce([f[inverse] for f, (_, inverse, _) in zip(flags, counters, strict=True)]))
        index, numbers = np.full(len(self.at), -1), {}
        if not len(kept):
            return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), index
        group = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self._spelled(self.at[kept])), np.int64, len(kept))
        found = digest_pairs(numbers)
        order = np.lexsort((found[:, 1], found[:, 0]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        index[kept] = place[group]
        least = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(least, index[kept], self.ids[self.doc[self.at[kept]]])
        return found[order], least, index


def _bounds(values: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, start, stop) of the non-empty parts of sorted values between edges."""
    cuts = np.searchsorted(values, edges).tolist()
    return [(i, a, b) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(values)], strict=True)) if b > a]


def _edges(n: int, top: int) -> np.ndarray:
    return np.array([top * i // n for i in range(n)], np.uint64)


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, removed (word spans, merged and ascending), n_removed and kept_text (kept words, joined by one space)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    counters = max(1024, COUNTERS_A_WINDOW * size // 6)  # a word and its space take about six bytes
    width = min(max(1 << 22, counters // 4096), 1 << 28)
    slices = -(-counters // width)
    n_chunks = max(1, min(size >> 20, 4 * partitions(spark)), size >> 25)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks)).cast("int")).repartition(partitions(spark), "chunk")
    edges = np.arange(slices, dtype=np.uint64) * np.uint64(width)

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        found = _Chunk(table, window).counters(slices, width)
        parts = [{s: (a, b) for s, a, b in _bounds(used, edges)} for used, _, _ in found]
        out: dict[str, list] = {"part": [], "chunk": [], "n": [], "data": []}
        for s in parts[0]:
            n, data = [], []
            for (used, _, times), where in zip(found, parts, strict=True):
                a, b = where[s]
                deltas = np.diff(used[a:b], prepend=edges[s]).astype("<u4")
                n.append(b - a)
                data += [_planes(deltas), np.packbits(times[a:b] > 1).tobytes()]
            out["part"].append(s)
            out["chunk"].append(key[0].as_py())
            out["n"].append(n)
            out["data"].append(_pack(*data))
        return pa.table({"part": pa.array(out["part"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int32()), "n": pa.array(out["n"], pa.list_(pa.int32())), "data": pa.array(out["data"], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        counts = [np.zeros(width, np.uint8) for _ in range(DEPTH)]
        sent = []
        for n, data in zip(table.column("n").to_pylist(), table.column("data").to_pylist(), strict=True):
            pieces, places = _unpack(data, 2 * DEPTH), []
            for i in range(DEPTH):
                at = np.cumsum(_from_planes(pieces[2 * i], "<u4", n[i]), dtype=np.int64).astype(np.uint32)
                more = 1 + np.unpackbits(np.frombuffer(pieces[2 * i + 1], np.uint8), count=n[i])
                counts[i][at] = np.minimum(counts[i][at] + more, 2)
                places.append(at)
            sent.append(places)
        data = [_pack(*(np.packbits(c[at] > 1).tobytes() for c, at in zip(counts, places, strict=True))) for places in sent]
        return pa.table({"chunk": table.column("chunk"), "kind": pa.array([0] * len(data), pa.int32()), "part": table.column("part"), "data": pa.array(data, pa.binary())})

    def _flagged(chunk: _Chunk, answers: dict[tuple[int, int], bytes]):
        found = chunk.counters(slices, width)
        flags = [np.zeros(len(used), bool) for used, _, _ in found]
        parts = [_bounds(used, edges) for used, _, _ in found]
        for i, where in enumerate(parts):
            for s, a, b in where:
                bits = _unpack(answers[0, s], DEPTH)[i]
                flags[i][a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return chunk.candidates(flags, found)

    def _answers(table: pa.Table) -> dict[tuple[int, int], bytes]:
        return {(k, p): d for k, p, d in zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True)}

    hash_edges = _edges(slices, 1 << 64)

    def candidates(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        found, least, _ = _flagged(_Chunk(table, window), _answers(answers))
        h1, h2 = found[:, 0].copy(), found[:, 1].copy()
        where = _bounds(h1, hash_edges)
        data = [_pack(h1[a:b].tobytes(), h2[a:b].tobytes(), _planes(least[a:b].astype("<i8"))) for _, a, b in where]
        return pa.table({"part": pa.array([p for p, _, _ in where], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(where), pa.int32()), "n": pa.array([b - a for _, a, b in where], pa.int32()), "data": pa.array(data, pa.binary())})

    def group(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        parts = [_unpack(d, 3) for d in table.column("data").to_pylist()]
        h1, h2 = (np.concatenate([np.frombuffer(p[i], "<u8") for p in parts]) for i in (0, 1))
        least = np.concatenate([_from_planes(p[2], "<i8", n) for p, n in zip(parts, sizes, strict=True)])
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        first = np.ones(len(order), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lowest = np.minimum.reduceat(least[order], np.nonzero(first)[0])[np.cumsum(first) - 1]
        beaten = np.empty(len(order), bool)
        beaten[order] = least[order] > lowest
        ends = np.cumsum(sizes)
        data = [_pack(np.packbits(beaten[e - n : e]).tobytes()) for e, n in zip(ends.tolist(), sizes, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "kind": pa.array([1] * len(data), pa.int32()), "part": table.column("part"), "data": pa.array(data, pa.binary())})

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, told = _Chunk(table, window), _answers(answers)
        found, least, index = _flagged(chunk, told)
        beaten = np.zeros(len(found), bool)
        for p, a, b in _bounds(found[:, 0].copy(), hash_edges):
            beaten[a:b] = np.unpackbits(np.frombuffer(_unpack(told[1, p], 1)[0], np.uint8), count=b - a).astype(bool)
        some = np.nonzero(index >= 0)[0]
        own = chunk.ids[chunk.doc[chunk.at[some]]]
        repeated = chunk.at[some[beaten[index[some]] | (own > least[index[some]])]]
        change = np.zeros(len(chunk.doc) + 1, np.int32)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans, removed, kept, at = [], [], [], 0
        for text in chunk.texts:
            words = text.as_py().split()
            mine = gone[at : at + len(words)]
            at += len(words)
            cuts = np.nonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))[0].tolist()
            spans.append([{"start": i, "stop": j} for i, j in zip(cuts[::2], cuts[1::2], strict=True)])
            removed.append(int(mine.sum()))
            left, last = [], 0
            for i, j in zip(cuts[::2], cuts[1::2], strict=True):
                left += words[last:i]
                last = j
            kept.append(b" ".join(left + words[last:] if cuts else words))
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.null),
            "n_words": pa.array(chunk.sizes, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    answer = "chunk int, kind int, part int, data binary"
    sketches = dealt.groupBy("chunk").applyInArrow(sketch, "part int, chunk int, n array<int>, data binary")
    first = sketches.groupBy("part").applyInArrow(merge, answer)
    sent = dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(candidates, "part int, chunk int, n int, data binary")
    second = sent.groupBy("part").applyInArrow(group, answer)
    result = "doc_id bigint, n_words bigint, removed array<struct<start:int,stop:int>>, n_removed bigint, kept_text string"
    return dealt.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(remove, result)
