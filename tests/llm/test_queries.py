"""The registered queries over a small folder of awkward rows, each against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import ROWS, table, words
from tests.llm.test_corpus import WORD, plain_mix
from tests.llm.test_dedup import norm, plain_components, plain_fingerprint, plain_lines, plain_substring
from trestle.llm import mixing as M
from trestle.llm import quality as Q
from trestle.llm import queries

DOCS = [r for r in ROWS if r[0] not in (None, 8)] + [(8, words(60, 3) + "\n" + words(30, 5), "c"), (11, "x " * 20000 + words(400, 7), "b"), (12, "A <|endoftext|> B", "a")] + [(20 + i, words(40 + i, i % 5), "abc"[i % 3]) for i in range(40)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    table(spark, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i, _, _ in DOCS if i % 2], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    rng = random.Random(1)
    chats = [(c, t, ("user", "assistant")[t % 2], words(rng.randint(0, 40), c * 100 + t)) for c in range(3) for t in range(20)] + [(9, 2000 + t, "assistant", words(5, t)) for t in range(4)] + [(9, 0, "system", "be kind")]
    spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path, chats


def test_op1(spark, folder):
    got = {r["doc_id"]: r for r in queries.op1_mix_sources(spark, folder[0]).collect()}
    mix = M.mix_sources(spark.read.parquet(f"{folder[0]}/documents.parquet"), share=1.5, max_repeats=2, block_words=64)
    rows = mix.docs.collect()
    expected = plain_mix(rows, 64)
    assert {r["doc_id"]: expected[r["source"], r["start"]] if r["size"] else 0 for r in rows} == {i: r["taken"] for i, r in got.items()}
    sizes = Counter()
    for i, t, s in DOCS:
        assert got[i]["size"] == len(WORD.findall(t or ""))
        sizes[s] += got[i]["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, M.targets([sizes[s] for s in names], M.cyclic_weights(names), 1.5, 2), strict=True))
    assert all((got[i]["source_size"], got[i]["target"]) == (sizes[s], goals[s]) for i, _, s in DOCS)


def test_op2(spark, folder):
    got = {r["conv_id"]: r for r in queries.op2_chat_format(spark, folder[0]).collect()}
    by = defaultdict(list)
    for c, t, r, x in [*folder[1], (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        by[c].append((t, r, x))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(x for _, r, x in sorted(turns) if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in sorted(turns))))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_op3(spark, folder):
    from tokenizers import Tokenizer

    plain, at = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = queries.op3_token_files(spark, folder[0]).orderBy("start").collect()
    for r, (i, t, _) in zip(got, sorted(DOCS), strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op4(spark, folder):
    got = sorted(tuple(r) for r in queries.op4_substring_dedup(spark, folder[0]).collect())
    assert got == sorted((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in plain_substring([(i, t) for i, t, _ in DOCS], 13))


def test_op5(spark, folder):
    """Scores by plain formulas: normal equations in one matrix, isotonic steps over the same bins."""
    got = {r["doc_id"]: r for r in queries.op5_quality_classifier(spark, folder[0]).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    labels = {i: int(i % 3 > 0) for i, _, _ in DOCS if i % 2}
    stats = {i: np.array(Q.statistics((t or "").encode())) for i, t, _ in DOCS}
    fit, cal = ([i for i in labels if fold(i) in folds] for folds in ((0, 1), (3,)))
    x = np.array([stats[i] for i in fit])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(42)
    w, b = rng.normal(0, np.sqrt(2 * 0.005), (x.shape[1], 256)), rng.uniform(0, 2 * np.pi, 256)
    features = lambda s: np.concatenate([[1.0], (s - mean) / scale, np.sqrt(2 / 256) * np.cos((s - mean) / scale @ w + b)])
    a = np.array([features(stats[i]) for i in fit])
    penalty = np.eye(a.shape[1])
    penalty[0, 0] = 0
    weights = np.linalg.solve(a.T @ a + penalty, a.T @ np.array([labels[i] for i in fit], float))
    raw = {i: float(features(s) @ weights) for i, s in stats.items()}
    bins = defaultdict(list)
    for i in cal:
        bins[min(max(int(np.floor((raw[i] + 0.5) / 2 * 2000)), 0), 1999)].append(labels[i])
    steps = sorted(bins)
    rates, sizes = np.array([np.mean(bins[k]) for k in steps]), np.array([len(bins[k]) for k in steps], float)
    # the plain isotonic fit: the largest over starts of the least over ends of the mean between
    level = [max(min(np.average(rates[j : k + 1], weights=sizes[j : k + 1]) for k in range(i, len(steps))) for j in range(i + 1)) for i in range(len(steps))]
    at = [(k + 0.5) / 2000 * 2 - 0.5 for k in steps]
    for i, _, _ in DOCS:
        score = float(np.clip(np.interp(raw[i], at, level), 0, 1))
        assert abs(got[i]["score"] - score) < 1e-6 and got[i]["held_out"] == (fold(i) == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_op7(spark, folder):
    groups = defaultdict(list)
    for i, t, _ in DOCS:
        groups[norm(t)].append(i)
    expected = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted(tuple(r) for r in queries.op7_exact_dedup(spark, folder[0]).collect()) == expected


def test_op8(spark, folder):
    got = sorted((tuple(r) for r in queries.op8_line_dedup(spark, folder[0]).collect()), key=str)
    plain = plain_lines(sorted((i, t) for i, t, _ in DOCS), 0.8)
    assert got == sorted(((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in plain), key=str)


def test_op9(spark, folder):
    prints = {i: plain_fingerprint(t, 3) for i, t, _ in DOCS}
    ids = sorted(prints)
    roots = plain_components(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least.setdefault(r, i)
    got = {tuple(r) for r in queries.op9_simhash_dedup(spark, folder[0]).collect()}
    assert got == {(i, f"{prints[i]:016x}", least[r]) for i, r in zip(ids, roots, strict=True)}
