"""Language identification: bundles against plain loops, cosines over all languages, held-out accuracy."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import ROWS, table, words
from trestle.llm import language_id as L
from trestle.llm import queries

SF = "/root/testdata/sf0.01"


def plain_bundle(text, dimension=L.DIMENSION, seed=42):
    symbols = [0] + [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text or ""] + [0]
    v = lambda s: L.letter_vectors(np.array([s], np.uint64), seed, dimension)[0].astype(int)
    known = {s: v(s) for s in set(symbols)}
    out = np.zeros(dimension)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        if b:
            out += np.roll(known[a], 2) * np.roll(known[b], 1) * known[c]
    return out


LANGS = [(i, t, lang) for lang, alphabet in (("aa", "abcd"), ("bb", "cdef"), (None, "xyz")) for i, t in ((ord(alphabet[0]) * 100 + k, " ".join(alphabet[k % 4 - 1 :] * 3 for _ in range(5))) for k in range(12))]
EDGES = [(1, None, "aa"), (2, "", "bb"), (3, "12 34 --- 5", "cc"), (None, "abcd", "dd"), (5, "Straße ÀÉ İ ǅ 日本 ªb ͅ", "bb"), (6, "abc" * 120_000 + " d", "aa"), (6, "abcd", "aa"), (6, "abcd", "aa"), (7, "q", "aa")]


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1.0, 2, 3, "x") for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, score double, place int, value int, lang_pred string")


@pytest.mark.parametrize("block", [1, 2, 2048])
def test_query_equals_plain_loops(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = LANGS + EDGES
    make(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_language_id(spark, str(tmp_path)).collect()), key=str)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    sums = defaultdict(lambda: np.zeros(L.DIMENSION))
    for i, t, lang in rows:
        if lang is not None and not held(i):
            sums[lang] += plain_bundle(t)
    sums = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if v.any()}
    expected = []
    for i, t, _ in rows:
        v = plain_bundle(t)
        cosines = {k: float(v @ p / np.linalg.norm(v)) for k, p in sums.items()} if v.any() else {}
        best = max(cosines, key=cosines.get, default="und")
        expected.append((i, held(i), best, max(cosines.get(best, 0.0), 0.0)))
    expected.sort(key=str)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in got], [r[3] for r in expected], atol=1e-5)


def test_prototypes_are_whole_sums(spark):
    got = {(r["lang"], r["place"]): r["value"] for r in L.prototypes(make(spark, LANGS + EDGES).repartition(4)).collect()}
    for lang in ("aa", "bb", "dd"):
        whole = sum(plain_bundle(t) for _, t, x in LANGS + EDGES if x == lang)
        assert [got.get((lang, i), 0) for i in range(L.DIMENSION)] == whole.tolist()
    assert not any(k[0] == "cc" for k in got)


def test_a_text_of_many_chunks(spark, monkeypatch):
    text = words(3000, 5)
    whole = plain_bundle(text)
    monkeypatch.setattr(L, "CHUNK", 100)
    assert (sum(sums[0] for _, sums in L._chunks([text], [0], 1, 42, L.DIMENSION)) == whole).all()
    monkeypatch.setattr(L, "VOCABULARY", 50)
    assert (L.bundle([(0, r) for r in L.runs_of(text)], 1, 42, L.DIMENSION)[0] == whole).all()


def test_nothing_learned_and_nothing_read(spark, tmp_path):
    none = spark.createDataFrame([], "lang string, place int, value bigint")
    assert {tuple(r) for r in L.identify(table(spark, ROWS), none).select("lang_pred", "score").collect()} == {("und", 0.0)}
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_language_id(spark, str(tmp_path)).collect() == []


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").collect()}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in queries.op11_language_id(spark, SF).where("held_out").collect() if r["doc_id"] in truth]
    assert len(right) > 100 and np.mean(right) >= 0.97
