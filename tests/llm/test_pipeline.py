"""The pipeline and the registered queries over the small driver tables, against brute force."""

import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from trestle.llm import oracles, queries
from trestle.llm import quality as Q
from trestle.llm._common import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    got.write.parquet(str(tmp_path / "out"))
    columns = ", ".join(sorted(got.columns))
    con.execute(f"CREATE TABLE expected AS {oracles.oracle_sql()[name]}")
    mine, theirs = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'", f"SELECT {columns} FROM expected"
    assert con.sql(f"{mine} EXCEPT ALL {theirs}").fetchall() == con.sql(f"{theirs} EXCEPT ALL {mine}").fetchall() == []


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, seen = {}, {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes[name], seen[name] = docs.count(), docs.toPandas()
    before = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    # quality: what goes is what the classifier scores below the threshold
    full = spark.read.parquet(f"{SF}/documents.parquet")
    scores = Q.quality_scores(full, spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert set(seen["quality"]["doc_id"]) == set(scores[scores["score"] >= 0.7]["doc_id"])
    # near copies: one text of each kind stays, and it has the smallest id
    lower = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    texts = seen["near_dedup"]["text"].map(lower)
    assert not texts.duplicated().any()
    firsts = seen["quality"].assign(k=seen["quality"]["text"].map(lower)).groupby("k")["doc_id"].min()
    assert set(seen["near_dedup"]["doc_id"]) <= set(firsts)
    # decontamination: no window of ten benchmark words is left, and clean documents stay
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]:
        w = find(t)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    dirty = {i for i, t in zip(seen["near_dedup"]["doc_id"], seen["near_dedup"]["text"], strict=True) for w in [find(t)] if any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))}
    assert set(seen["decontamination"]["doc_id"]) == set(seen["near_dedup"]["doc_id"]) - dirty
    # mixing: no document more than twice, words from its own text
    count = lambda t: len(t.split())
    own = dict(zip(before["doc_id"], before["text"].map(count), strict=True))
    taken = seen["mixing"].assign(n=seen["mixing"]["text"].map(count)).groupby("doc_id")["n"].sum()
    assert all(taken[i] <= 2 * own[i] for i in taken.index)
    # tokens: ids of the mixed texts, in id order
    from trestle.llm.token_files import Encoder

    enc = Encoder(open(queries.tokenizer_path(), encoding="utf-8").read()).tokenizer
    got = P.tokens(spark, docs, SF).orderBy("start").toPandas()
    assert got["doc_id"].is_monotonic_increasing and len(got) == sizes["mixing"]
    crc = sorted((i, zlib.crc32(np.array(enc.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in zip(seen["mixing"]["doc_id"], seen["mixing"]["text"], strict=True))
    assert sorted(zip(got["doc_id"], got["ids_crc32"], strict=True)) == crc


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_with_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties and clashing extra columns pass every stage."""
    from tests.llm.conftest import ROWS, table, words

    rows = [*ROWS, (None, None, None), (None, None, None), (21, "x " * 200_000 + "end.", "a"), (22, "y" * 1_500_000, "b"), *((30 + i, words(80, i) + ".", "abc"[i % 3]) for i in range(30))]
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(30, 60)] + [(None, 1), (1, None)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, words(12, 20))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[1:-1]:  # the first one's decisions hang on what it learned
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == table(spark, []).columns
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "near_dedup":
            assert ids.count(8) == 1 and ids.count(None) == 3 and 1 in ids and 2 not in ids and (3 in ids) and not {4, 5} & set(ids)
        if name == "decontamination":
            assert 50 not in ids and 36 in ids and 21 in ids and 22 in ids
        if name == "mixing":
            assert 3 not in ids and {21, 22} & set(ids)
    got = P.tokens(spark, docs, str(tmp_path))
    assert got.count() == docs.count()
    kept = P.quality(spark, table(spark, rows), str(tmp_path))
    assert kept.columns == table(spark, []).columns and kept.count() <= len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, table(spark, []), str(tmp_path)).count() == 0
