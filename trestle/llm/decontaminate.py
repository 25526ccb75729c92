"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of every benchmark item; an item of fewer words is one pattern.
For each pattern length a matcher has a shift table over blocks of two words, which tells how far the search can jump,
buckets of patterns by the hash of their last block, and a direct comparison of words that confirms an occurrence.

Documents are streamed through the matchers where they are read: no shuffle, and no group of any kind. The benchmark is
a stated query set. Its tables are sent to every task only up to ``block_bytes`` of text; a larger one is dealt into as
many blocks of at most about that size as needed, and documents pass through one block after the other, written between.

Defined cases: null and wordless texts have no words and no hits; benchmark rows without words match nothing; a null
item id is written as an empty string; rows that share an item id are one item; an empty benchmark hits nothing; an
empty table gives an empty result; repeated rows are each searched; a very long text is searched whole, in one task, in time
linear in its words; carried columns of find_contamination() whose names clash with a result column give way to it, while
decontaminate() gives all columns back as they were.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.llm._common import materialize

#: Bytes that are part of a word keep their value, A-Z becomes a-z, and all other ASCII becomes a space.
_WORD_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20) for c in range(256))
BLOCK_BYTES = 32 << 20
RESULT = {"n_words": "bigint", "spans": "array<struct<start:int,stop:int>>", "items": "array<string>"}
#: The same columns while documents pass through, under names of their own.
_INNER = {f"__decontaminate_{k}": v for k, v in RESULT.items()}
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def words_of(text: bytes) -> list[bytes]:
    """Runs of [0-9a-z] and non-ASCII characters of the text with A-Z lower-cased."""
    return text.translate(_WORD_TABLE).split()


class Matcher:
    """Wu-Manber search for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.jump), length - end)
            self.buckets.setdefault(pattern[-self.block :], []).append((list(pattern), items))
        self.last = {p[-1] for p in patterns}

    def find(self, words: list[bytes], seen: set[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of every occurrence, in ascending order."""
        if self.last.isdisjoint(seen):
            return
        length, block, jump, shift = self.length, self.block, self.jump, self.shift
        end, n = length, len(words)
        while end <= n:
            tail = tuple(words[end - block : end])
            step = shift.get(tail, jump)
            if step == 0:
                window = words[end - length : end]
                for pattern, items in self.buckets[tail]:
                    if pattern == window:
                        yield end - length, items
                step = 1
            end += step


def matchers(items: Iterable[tuple[str, bytes]], window: int) -> list[Matcher]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
    return [Matcher(n, p) for n, p in sorted(by_length.items())]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _searched(docs: DataFrame, text_col: str, patterns: list[tuple[str, bytes]], window: int) -> tuple[DataFrame, Broadcast]:
    """docs with the inner columns, and the broadcast that they need; what is there already from earlier blocks is added to."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    kept, (_, spans_col, items_col) = [c for c in docs.columns if c not in _INNER], _INNER
    before = spans_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = matchers(shared.value, window)
        for b in batches:
            texts = b.column(text_col).cast(pa.binary()).to_pylist()
            olds = zip(b.column(spans_col).to_pylist(), b.column(items_col).to_pylist(), strict=True) if before else [([], [])] * len(texts)
            sizes, spans, names = [], [], []
            for text, (old_spans, old_items) in zip(texts, olds, strict=True):
                words = words_of(text or b"")
                hit, seen = set(old_items), set(words)
                where = [(s["start"], s["stop"]) for s in old_spans]
                for m in found:
                    for start, items in m.find(words, seen):
                        where.append((start, start + m.length))
                        hit |= items
                sizes.append(len(words))
                spans.append([{"start": s, "stop": e} for s, e in merged(where)])
                names.append(sorted(hit))
            columns = [b.column(c) for c in kept] + [pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=[*kept, *_INNER])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"`{k}` {v}" for k, v in _INNER.items()]
    return docs.mapInArrow(run, ", ".join(fields)), shared


def _found(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_id_col: str, item_text_col: str, block_bytes: int) -> DataFrame:
    """docs with the inner columns. Beyond one block of the benchmark, documents are written after each block, so a worker holds one block at a time."""
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i)
        docs, shared = _searched(docs, text_col, [(r[0], bytes(r[1])) for r in part.collect()], window)
        if blocks > 1:
            docs = materialize(docs, "searched")
            shared.unpersist()
    return docs


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    carry: Sequence[str] = (),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: its id, carried columns, n_words, spans (word ranges covered by occurrences, merged and ascending) and items (ids found)."""
    names = dict.fromkeys([id_col, text_col, *(c for c in carry if c not in RESULT)])
    out = _found(docs.select(*names), benchmark, window, text_col, item_id_col, item_text_col, block_bytes)
    out = out if text_col in carry else out.drop(text_col)
    return out.withColumnsRenamed(dict(zip(_INNER, RESULT, strict=True)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns unchanged, whatever their names."""
    found = _found(docs, benchmark, window, text_col, "item_id", "text", block_bytes)
    return found.where(F.size(list(_INNER)[1]) == 0).select(*docs.columns)
