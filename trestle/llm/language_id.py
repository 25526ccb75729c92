"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A run of three symbols (letters folded to lower
case, everything else one blank) is the product of its letters' vectors, the first rotated by two places, the second by one:
bound, permuted, and unlike the vector of any other run. Texts and languages are bundles, the sums of the vectors of their
runs; a document gets the language whose prototype has the largest cosine with it.

1. Training: each task counts the runs of a chunk of texts by language, multiplies the counts with the runs' vectors and adds
   that to one vector for each language; vectors meet place by place in an ordinary sum, so a language that holds most rows is
   no larger group than any other. Sums are whole numbers and do not depend on the order of addition.
2. Prototypes reach the tasks in blocks of BLOCK languages (8 MB for each block); a document's best language is carried from
   block to block. The usual table has one block.
3. Scoring: the same bundles by document, in the pass that reads the texts. Nothing is shuffled.

A task works on CHUNK code points at a time, counts them by VOCABULARY runs at a time, and holds no table of runs.

Defined cases: a text without letters (null and empty ones too) is ``und`` with score 0, as is every text if nothing was learned;
languages whose texts have no letter are not learned; of equal cosines the least language by code point wins; cosines below
0 score 0; a null id is never learned from and counts as held out; repeated rows count each time; a very long text is read
chunk by chunk; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, NOT_COMPARED = "und", -2.0
#: Places of a vector, languages that are sent to tasks at once, code points worked on at once, distinct runs whose vectors are made at once, languages whose sums a task holds at once.
DIMENSION, BLOCK, CHUNK, VOCABULARY, HELD = 1024, 2048, 1 << 18, 1 << 13, 1 << 10
_folded: list[np.ndarray] = []
_letters: dict[tuple[int, int], dict[int, np.ndarray]] = {}


def _fold() -> np.ndarray:
    """For every code point: itself in lower case if it is a letter, else 0."""
    if not _folded:
        lower = lambda c: ord(x) if len(x := c.lower()) == 1 else ord(c)
        _folded.append(np.array([lower(c) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)], np.uint64))
    return _folded[0]


def letter_vectors(symbols: np.ndarray, seed: int, dimension: int) -> np.ndarray:
    """A row of +1 and -1 for each symbol, drawn from seed and code point."""
    known = _letters.setdefault((seed, dimension), {})
    if len(known) > 1 << 14:
        known.clear()
    for s in symbols.tolist():
        if s not in known:
            known[s] = np.random.Generator(np.random.PCG64([seed, s])).integers(0, 2, dimension, np.int8) * 2 - 1
    return np.stack([known[s] for s in symbols.tolist()])


def run_vectors(runs: np.ndarray, seed: int, dimension: int) -> np.ndarray:
    """The bound vectors of runs, each packed into 63 bits."""
    packed = np.stack([runs >> np.uint64(42), runs >> np.uint64(21) & np.uint64(0x1FFFFF), runs & np.uint64(0x1FFFFF)])
    symbols, place = np.unique(packed, return_inverse=True)
    vectors, place = letter_vectors(symbols, seed, dimension), place.reshape(packed.shape)
    bound = np.roll(vectors, 2, axis=1)[place[0]]
    bound *= np.roll(vectors, 1, axis=1)[place[1]]
    bound *= vectors[place[2]]
    return bound


def runs_of(text: str) -> Iterator[np.ndarray]:
    """The runs of a text, one around each letter, in pieces of CHUNK code points at most."""
    for at in range(0, len(text), CHUNK):
        piece = (" " if at == 0 else text[at - 1]) + text[at : at + CHUNK] + (text[at + CHUNK] if at + CHUNK < len(text) else " ")
        symbols = _fold()[np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)]
        centre = np.flatnonzero(symbols[1:-1]) + 1
        yield symbols[centre - 1] << np.uint64(42) | symbols[centre] << np.uint64(21) | symbols[centre + 1]


def bundle(groups: list[tuple[int, np.ndarray]], n: int, seed: int, dimension: int) -> np.ndarray:
    """n sums of run vectors, whole numbers: those of the runs that are given for each group."""
    out = np.zeros((n, dimension))
    if not groups:
        return out
    runs, inverse = np.unique(np.concatenate([r for _, r in groups]), return_inverse=True)
    owner = np.repeat(np.array([g for g, _ in groups]), [len(r) for _, r in groups])
    pairs, counts = np.unique(inverse.astype(np.int64) * n + owner, return_counts=True)
    for at in range(0, len(runs), VOCABULARY):
        some = slice(*np.searchsorted(pairs, [at * n, (at + VOCABULARY) * n]))
        weights = np.zeros((n, min(VOCABULARY, len(runs) - at)), np.float32)
        weights[pairs[some] % n, pairs[some] // n - at] = counts[some]
        out += weights @ run_vectors(runs[at : at + VOCABULARY], seed, dimension).astype(np.float32)  # below 2**24, so exact
    return out


def _chunks(texts: list, group_of: list[int], n: int, seed: int, dimension: int, most: int = 256) -> Iterator[tuple[list[int], np.ndarray]]:
    """Bundles of texts by group, CHUNK code points (or a piece of one text) at a time: the groups met and a sum for each."""
    waiting: list[tuple[int, np.ndarray]] = []
    met: dict[int, int] = {}
    size = 0
    for g, t in zip(group_of, texts, strict=True):
        for runs in runs_of(t or ""):
            if waiting and (size + len(runs) > CHUNK or len(met) >= most and g not in met):
                yield list(met), bundle(waiting, len(met), seed, dimension)
                waiting, met, size = [], {}, 0
            waiting.append((met.setdefault(g, len(met)), runs))
            size += len(runs)
    if waiting:
        yield list(met), bundle(waiting, len(met), seed, dimension)


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimension: int = DIMENSION, seed: int = 42) -> DataFrame:
    """lang, place and value: the bundle of all texts of each non-null language, without zeros."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            places = pa.array(np.arange(dimension, dtype=np.int32))
            for lang, v in sums.items():
                yield pa.record_batch([pa.array([lang] * dimension, pa.string()), places, pa.array(v.astype(np.int64))], names=["lang", "place", "value"])
            sums.clear()

        for b in batches:
            langs = b.column("lang").to_pylist()
            names = list(dict.fromkeys(langs))
            index = {x: i for i, x in enumerate(names)}
            for met, vectors in _chunks(b.column("text").to_pylist(), [index[x] for x in langs], len(names), seed, dimension):
                for g, v in zip(met, vectors, strict=True):
                    if names[g] in sums:
                        sums[names[g]] += v
                    else:
                        sums[names[g]] = v.copy()
                if len(sums) > HELD:
                    yield from told()
        yield from told()

    parts = rows.mapInArrow(partial, "lang string, place int, value bigint")
    return parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).where("value <> 0")


def _blocks(learned: DataFrame, dimension: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages, ascending, and their prototypes of length 1, BLOCK at a time."""
    names = learned.select("lang").distinct().orderBy("lang")
    last = None
    while True:
        some = [r["lang"] for r in (names if last is None else names.where(F.col("lang") > last)).limit(BLOCK).collect()]
        if not some:
            return
        last, index = some[-1], {x: i for i, x in enumerate(some)}
        vectors = np.zeros((len(some), dimension))
        for lang, place, value in learned.where(F.col("lang").between(some[0], last)).collect():  # BLOCK * dimension at most
            vectors[index[lang], place] = value
        yield some, (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        if len(some) < BLOCK:
            return


def identify(docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimension: int = DIMENSION, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, lang_pred and score (the cosine with its language's prototype, 0 at least)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(NOT_COMPARED).alias("score"))
    fields = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, lang_pred string, score double"
    for names, vectors in _blocks(learned, dimension):
        shared = spark.sparkContext.broadcast((names, vectors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors = shared.value
            for b in batches:
                best, pred, spare = b.column("score").to_pylist(), b.column("lang_pred").to_pylist(), None
                found: dict[int, tuple[float, int]] = {}
                for met, sums in _chunks(b.column("text").to_pylist(), list(range(b.num_rows)), b.num_rows, seed, dimension):
                    if spare is not None and spare[0] == met[0]:  # a text that an earlier chunk began
                        sums[0] += spare[1]
                    spare = (met[-1], sums[-1])
                    length = np.linalg.norm(sums, axis=1)
                    cosines = (sums @ vectors.T) / np.where(length > 0, length, 1)[:, None]
                    top = cosines.argmax(axis=1)
                    for row, some, t, c in zip(met, length > 0, top.tolist(), cosines[np.arange(len(met)), top].tolist(), strict=True):
                        if some:
                            found[row] = c, t
                for row, (c, t) in found.items():
                    if c > best[row]:
                        best[row], pred[row] = c, names[t]
                yield pa.record_batch([b.column("doc_id"), b.column("text"), pa.array(pred, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "text", "lang_pred", "score"])

        rows = rows.mapInArrow(run, fields)
    score = F.when(F.col("score") == NOT_COMPARED, 0.0).otherwise(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))
    return rows.select("doc_id", "lang_pred", score.alias("score"))
