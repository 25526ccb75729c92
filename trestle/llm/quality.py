"""Quality classifier: Gaussian-kernel ridge scores from random Fourier features, with isotonic calibration.

1. Every whole text gives DOC_STATS statistics (shares of letter cases, symbols, repeats, line and word shapes). One
   pass; the table of statistics is written, so training and scoring do not read texts again.
2. Standardised statistics go through ``cos(x W + b)``, random Fourier features of a Gaussian kernel.
3. Each task sums the normal equations of its labelled rows, row block by row block; blocks are added up by key, so what
   reaches the driver is one matrix whose size depends on the number of features alone. Ridge weights solve it.
4. On a fold that the fit did not see, scores are counted in bins and the pool-adjacent-violators rule makes the observed
   share of label 1 a rising step function of the score: the calibrated probability.

All labelled rows of the training folds are used. Language, source and id are never inputs.

Defined cases: null and empty texts have zero statistics and are scored like any other; documents or labels with null ids
join nothing; a label that repeats for an id counts each time; without labels of both classes the score is the share of
label 1 (one half without any); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.llm._common import crc32_mod4, materialize

DOC_STATS = (
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "high", "space", "newline", "full_stop", "comma", "mark", "quote", "symbol", "pipe",
    "word_length", "word_length_spread", "distinct_words", "commonest_word", "distinct_pairs", "line_words", "distinct_lines", "short_lines", "capital_words", "odd_words", "upper_words", "entropy", "glyph_top", "ended_lines", "long_words",
)
_KIND = {"upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "high": range(0x80, 0x100), "space": (0x20,), "newline": (0x0A,), "full_stop": (0x2E,), "comma": (0x2C,), "mark": b"!?;:", "quote": b"\"'`", "symbol": b"#$%&*+/<=>@\\^_~[](){}-", "pipe": (0x7C,)}
_SHARES = np.zeros((256, len(_KIND)))
for _i, _k in enumerate(_KIND.values()):
    _SHARES[list(_k), _i] = 1
_LETTERS = bytes(c for c in range(256) if 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80)


def statistics(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text, in the order of DOC_STATS."""
    n, words, lines = len(text), text.split(), [x for x in text.split(b"\n") if x.strip()]
    if not words:
        return [0.0] * len(DOC_STATS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts / n
    some = shares[shares > 0]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    uses = Counter(words)
    heads = Counter(w[:1] for w in words)
    capital = sum(c for h, c in heads.items() if h.isupper())
    odd = sum(1 for w in words if w.strip(b".,;:!?\"'()").translate(None, _LETTERS))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    line_words = [len(x.split()) for x in lines]
    symbols = counts[list(b"#$%&*|!")].sum()
    nw, nl = len(words), len(lines)
    return [
        math.log1p(n), math.log1p(nw), math.log1p(nl), *(shares @ _SHARES).tolist(),
        float(lengths.mean()), float(lengths.std()), len(uses) / nw, max(uses.values()) / nw, len(set(zip(words, words[1:], strict=False))) / nw, math.log1p(nw / nl),
        len(set(lines)) / nl, sum(k < 4 for k in line_words) / nl, capital / nw, odd / nw, upper / nw, float(-(some * np.log(some)).sum()), float(symbols / nw),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / nl, float((lengths > 14).mean()),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and stats (array<double>), one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(x) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "text_key", "stats"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key bigint, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # lower ends of the calibration steps, ascending
    levels: np.ndarray  # probability from that score on

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = (stats - self.mean) / self.scale
        return np.hstack([np.ones((len(x), 1)), x, math.sqrt(2 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps, self.levels), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to values by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOC_STATS))


def normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over rows (stats, label), summed by task and then by row block."""
    width = len(model.mean) + len(model.phases) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for b in batches:
            if b.num_rows:
                x = model.features(_stacked(b.column("stats")))
                total += x.T @ np.column_stack([x, b.column("label").to_numpy(zero_copy_only=False)])
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "values"])

    def add(frame):
        import pandas as pd

        return pd.DataFrame({"i": frame["i"].iloc[:1], "values": [np.sum(np.stack(frame["values"].to_numpy()), axis=0)]})

    sums = rows.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(partial, "i int, values array<double>").groupBy("i").applyInPandas(add, "i int, values array<double>")
    total = np.zeros((width, width + 1))
    for i, values in sums.collect():  # one row for each feature
        total[i] = values
    return total[:, :width], total[:, width]


def fit_quality(stats: DataFrame, labels: DataFrame, fit_folds=(0, 1), calibration_folds=(3,), n_features: int = 256, gamma: float = 0.005, ridge: float = 1.0, bins: int = 2000, seed: int = 42) -> QualityModel:
    """Fit on rows of stats (see document_statistics) whose fold, crc32 of the id mod 4, is in fit_folds; calibrate on calibration_folds.

    labels: doc_id, label (0 or 1). Both tables are joined by id; each side has few bytes a row.
    """
    joined = materialize(stats.join(labels.where("label is not null"), "doc_id").select("stats", "label", crc32_mod4(F.col("doc_id")).alias("fold")), "labelled")
    fit, calibrate = joined.where(F.col("fold").isin(list(fit_folds))), joined.where(F.col("fold").isin(list(calibration_folds)))
    k = len(DOC_STATS)
    moments = fit.agg(*[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(k)], F.avg("label").alias("share")).first()
    share = moments["share"] if moments["share"] is not None else 0.5
    rng = np.random.default_rng(seed)
    mean, scale = (np.array([moments[f"{f}{i}"] or 0.0 for i in range(k)]) for f in ("avg", "stddev_pop"))
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, math.sqrt(2 * gamma), (k, n_features)), rng.uniform(0, 2 * math.pi, n_features), np.zeros(n_features + k + 1), np.array([0.0]), np.array([share]))
    if moments["share"] is None or not 0 < share < 1:
        return model
    a, b = normal_equations(fit, model)
    penalty = np.full(len(b), ridge)
    penalty[0] = 0
    model.weights = np.linalg.solve(a + np.diag(penalty), b)
    counted = scored(calibrate, model, raw=True).select("label", F.least(F.greatest(F.floor((F.col("score") + 0.5) / 2 * bins), F.lit(0)), F.lit(bins - 1)).alias("bin"))
    table = sorted(counted.groupBy("bin").agg(F.avg("label"), F.count("*")).collect())  # at most one row for each bin
    if table:
        bin_, rate, n = (np.array(x, float) for x in zip(*table, strict=True))
        model.steps, model.levels = (bin_ + 0.5) / bins * 2 - 0.5, isotonic(rate, n)
    return model


def scored(rows: DataFrame, model: QualityModel, raw: bool = False) -> DataFrame:
    """rows (with stats) and their score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c not in ("stats", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = _stacked(b.column("stats"))
            score = (m.raw(x) if raw else m.score(x)) if len(x) else np.zeros(0)
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(score, pa.float64())], names=[*kept, "score"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(run, ", ".join([*fields, "score double"]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, text_key and score, the calibrated probability of label 1."""
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    model = fit_quality(stats, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")))
    return scored(stats, model)


def is_good(score: Column, threshold: float = 0.7) -> Column:
    return score >= threshold


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that the classifier accepts, columns unchanged. Statistics are joined to the texts by the model alone: each text is scored where it is read."""
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    model = fit_quality(stats, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).cast(pa.binary()).fill_null(b"").to_pylist()
            good = shared.value.score(np.array([statistics(x) for x in texts]).reshape(-1, len(DOC_STATS))) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
