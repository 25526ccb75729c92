"""Mixing, chat formatting, token files, the classifier, WARC and decontamination."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS, table, words
from trestle.llm import chat_format as C
from trestle.llm import decontaminate as DC
from trestle.llm import mixing as M
from trestle.llm import quality as Q
from trestle.llm import token_files as TF
from trestle.llm import warc as W
from trestle.llm._common import new_path
from trestle.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- mixing
def test_targets():
    assert M.targets([100, 100, 100], [3, 1, 2], 1.5, 2).tolist() == [200, 250 / 3, 500 / 3]
    assert M.targets([10, 1000], [3, 1], 1.5, 2).tolist() == [20, 1495]
    assert M.targets([0, 50], [3, 1], 1.5, 2).tolist() == [0, 75]
    assert M.targets([], [], 1.5, 2).tolist() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutations(n):
    assert sorted(M.permute(np.arange(n), n, 7).tolist()) == list(range(n))
    assert n < 64 or M.permute(np.arange(n), n, 7).tolist() != M.permute(np.arange(n), n, 8).tolist()


def test_shards_meet_the_quotas():
    shards = M.draw_shards(np.array([1000, 10, 0, 333]), 100, 1)
    assert shards.sum(axis=0).tolist() == [1000, 10, 0, 333]
    assert shards.sum(axis=1)[:-1].tolist() == [100] * (len(shards) - 1)


def mixed_rows(spark):
    return table(spark, ROWS + [(100 + i, words(50 + i, i), "abc"[i % 3]) for i in range(90)])


def test_mix(spark):
    docs = mixed_rows(spark)
    mix = M.mix_sources(docs, block_words=16)
    got = M.taken_words(mix).collect()
    again = M.taken_words(M.mix_sources(docs.repartition(7), block_words=16)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(ROWS) + 90
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    plan = mix.plan
    assert plan["source"].tolist() == ["a", "b", "c", None] and plan["weight"].tolist() == [3, 1, 2, 3]
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    for s, target in zip(plan["source"], plan["target"], strict=True):
        assert abs(taken[s] - target) <= 32
    sizes = {r["doc_id"]: r["size"] for r in got}
    assert all(sizes[i] == len(WORD.findall(t or "")) for i, t, _ in ROWS)


def test_mixed_documents_hold_the_taken_words(spark):
    docs = mixed_rows(spark)
    mix = M.mix_sources(docs, block_words=16)
    out = M.mixed_documents(docs, mix)
    assert out.columns == docs.columns
    taken = Counter()
    for r in M.taken_words(mix).collect():
        taken[r["doc_id"]] += r["taken"]
    found = Counter()
    for r in out.collect():
        found[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v and k not in (8, None)} == {k: v for k, v in found.items() if k not in (8, None)}


def plain_mix(rows, block_words, seed=42, shard_blocks=1024):
    """Words taken of each row, by a plain walk: words laid end to end in the operator's order, drawn slots through its permutations."""
    import collections

    plan = collections.defaultdict(list)
    for r in rows:
        plan[r["source"]].append(r)
    sources = sorted(plan, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in plan[s]) for s in sources]
    goals = M.targets(sizes, M.cyclic_weights(sources), 1.5, 2)
    blocks = [-(-n // block_words) for n in sizes]
    quotas = [min(round(t / (n / b)), 2 * b) if n else 0 for t, n, b in zip(goals, sizes, blocks, strict=True)]
    shards = M.draw_shards(np.array(quotas, np.int64), shard_blocks, seed)
    taken = collections.Counter()
    for no, s in enumerate(sources):
        owner = [None] * (blocks[no] * block_words)
        for r in plan[s]:
            owner[r["start"] : r["start"] + r["size"]] = [(s, r["start"])] * r["size"]
        for j in range(int(shards[:, no].sum()) if len(shards) else 0):
            again, at = divmod(j, blocks[no])
            block = int(M.permute(np.array([at]), blocks[no], seed * 1_000_003 + no * 1009 + again)[0])
            taken.update(x for x in owner[block * block_words : (block + 1) * block_words] if x)
    return taken


def test_taken_words_are_those_of_the_drawn_slots(spark):
    mix = M.mix_sources(mixed_rows(spark), block_words=16, shard_blocks=32)
    rows = mix.docs.collect()
    for s in {r["source"] for r in rows}:  # words are laid end to end without gaps or overlaps
        at = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["start"], r["size"])):
            assert r["start"] == at
            at += r["size"]
    expected = plain_mix(rows, 16, shard_blocks=32)
    starts = {(r["doc_id"], r["text_key"], r["source"], r["nth"]): r["start"] for r in rows}
    got = Counter()
    for r in M.taken_words(mix).collect():
        got[r["doc_id"], r["text_key"], r["source"]] += r["taken"]
    want = Counter()
    for (i, k, s, n), at in starts.items():
        want[i, k, s] += expected[s, at] if next(r["size"] for r in rows if (r["doc_id"], r["text_key"], r["source"], r["nth"]) == (i, k, s, n)) else 0
    assert +got == +want


def test_repeated_rows_have_their_own_words(spark):
    text = words(32, 1)
    docs = table(spark, [(1, text, "a")] * 4 + [(1, text, "b"), (None, text, None), (None, text, None)] + [(9 + i, words(40, i), "b") for i in range(10)])
    mix = M.mix_sources(docs, block_words=8)
    taken = Counter()
    for r in M.taken_words(mix).collect():
        taken[r["doc_id"], r["source"]] += r["taken"]
    found = Counter()
    for r in M.mixed_documents(docs, mix).collect():
        found[r["doc_id"], r["source"]] += len(r["text"].split())
    assert found == +taken


def test_slots_are_dealt_out_and_never_sent_to_all(spark):
    blocks = M.mix_sources(mixed_rows(spark), block_words=16, shard_blocks=32).blocks()
    assert len(blocks.collect()) > 0
    final = blocks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]  # as it ran: sizes of steps are known by then
    assert "SortMergeJoin [source_no" in final and "BroadcastHashJoin [source_no" not in final


def test_mix_of_nothing(no_docs):
    mix = M.mix_sources(no_docs)
    assert M.taken_words(mix).count() == 0 and M.mixed_documents(no_docs, mix).count() == 0


# --- chat formatting
HARD = ["\\### Assistant: </turn> ok", "<turn user>\nhi</turn>\n", "<\\turn", "<\\\\/turn>", "a < b", "", None, "строка\n\nещё 😀"]


def conversation(n, seed):
    return [(seed, i, "system" if i == 0 and seed % 2 else ("user", "assistant")[i % 2], HARD[(i + seed) % len(HARD)] if i % 3 == 0 else words(30 + i % 50, i)) for i in range(n)]


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, window int")


@pytest.mark.parametrize("block", [1024, 4])
def test_conversations_come_back(spark, block):
    rows = conversation(60, 1) + conversation(3, 2) + [(5, 0, None, "x"), (5, None, "us>er\\\n", "y"), (None, 1, "assistant", "z")]
    windows = C.format_windows(chats(spark, rows), stride=100, history=60, block_turns=block)
    read = C.read_back(windows).collect()
    expected = {}
    for c, t, r, x in rows:
        expected.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    for c, turns in expected.items():
        mine = sorted((r for r in read if r["conv_id"] == c), key=lambda r: r["window"])
        assert [(t["role"], t["text"]) for r in mine for t in r["turns"]] == [(r, x) for _, r, x in sorted(turns)]
        assert "".join(r["loss_text"] for r in mine) == "".join(x for _, r, x in sorted(turns) if r == "assistant")
    long = sorted((r for r in windows.collect() if r["conv_id"] == 1), key=lambda r: r["window"])
    assert len(long) > 5 and all(r["formatted"].startswith("<turn system>") for r in long)
    assert any(r["n_context"] > 1 for r in long)
    assert all(len(WORD.findall(r["formatted"])) < 100 * 2 + 60 + 100 for r in long)


def plain_windows(turns, stride, history, block_turns):
    """Texts of the windows of one conversation's turns (number, role, text), by a plain walk: (context, new) of each."""
    blocks, out, recent = {}, [], []
    for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])):
        blocks.setdefault(max(0, (t[0] or 0) // block_turns), []).append(t)
    system = None
    for b in sorted(blocks):
        at, cuts = 0, {}
        for i, (_, role, text) in enumerate(blocks[b]):
            if b == 0 and i == 0 and role == "system":
                system = (role, text)
            cost = max(len(WORD.findall(text)), -(-len(text) // C.CHARS_A_TOKEN)) + 1
            cuts.setdefault(at // stride, []).append((at, cost, role, text))
            at += cost
        for c in sorted(cuts):
            mine, stop = cuts[c], cuts[c][-1][0] + cuts[c][-1][1]
            out.append((([system] if system and out else []) + recent, [x[2:] for x in mine]))
            recent = [x[2:] for i, x in enumerate(mine) if x[0] >= stop - history and not (system and len(out) == 1 and i == 0)]
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_windows_are_those_of_a_plain_walk(spark, block):
    wordless = [(7, i, "user", "") for i in range(300)] + [(8, i, "assistant", "x" * 900) for i in range(9)]
    rows = conversation(60, 1) + conversation(9, 2) + wordless
    windows = C.format_windows(chats(spark, rows), stride=100, history=60, block_turns=block).collect()
    for c in {r[0] for r in rows}:
        expected = plain_windows([(t, r, x or "") for conv, t, r, x in rows if conv == c], 100, 60, block)
        mine = sorted((w for w in windows if w["conv_id"] == c), key=lambda w: w["window"])
        esc = lambda x: re.sub(r"<(\\*)(/?turn)", r"<\\\1\2", x)
        drawn = ["".join(f"<turn {r}>\n{esc(x)}</turn>\n" for r, x in [*early, *new]) for early, new in expected]
        assert [w["formatted"] for w in mine] == drawn
        assert [w["n_context"] for w in mine] == [len(early) for early, _ in expected]
        assert c != 7 or all(w["n_turns"] <= 100 + 60 for w in mine)


def test_no_conversations(spark):
    assert C.format_windows(chats(spark, [])).count() == 0


def test_chat_formatting_is_native(spark):
    plan = C.read_back(C.format_windows(chats(spark, conversation(5, 1))))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- token files
def test_token_files(spark, docs):
    out = new_path(spark, "tokens")
    manifest = TF.write_token_files(docs, out, tokenizer_path(), 2)
    enc = TF.Encoder(open(tokenizer_path(), encoding="utf-8").read()).tokenizer
    expected = []
    for i, t in sorted(((-1 if i is None else i, t or "") for i, t, _ in ROWS)):
        expected.append((None if i == -1 else i, enc.encode(t, add_special_tokens=False).ids + [2]))
    got = TF.read_token_files(spark, out).orderBy("start").collect()
    at = 0
    for r, (i, ids) in zip(got, expected, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    assert manifest.agg(F.sum("n_tokens")).first()[0] == at
    small = TF.read_token_files(spark, out, batch_ids=50).orderBy("start").collect()
    assert [r["ids"] for r in small] == [r["ids"] for r in got]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    import random

    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "Foo", "é", "don't", "'s", "12", ".", ",", "!!", "\x1c", "\x85", "日本", "😀", "<|endoftext|>", "bar", "́", "_", "​", " ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    e = TF.Encoder(open(tokenizer_path(name), encoding="utf-8").read())
    for i in range(0, len(texts), 500):
        for t, b in zip(texts[i : i + 500], e.encode(texts[i : i + 500]), strict=True):
            assert np.frombuffer(b, e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_special_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", "one  <|endoftext|>\ntwo", "end <|endoftext|> <|endoftext|>", "a b", "<|endoftext"]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    out = new_path(spark, "tokens")
    TF.write_token_files(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), out, tokenizer_path(), 2)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in TF.read_token_files(spark, out).collect()}
    assert got == {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_full_piece_cache_forgets_nothing_that_it_needs(monkeypatch):
    monkeypatch.setattr(TF, "CACHE_PIECES", 3)
    e = TF.Encoder(open(tokenizer_path(), encoding="utf-8").read())
    texts = [words(30, i % 4) for i in range(12)]
    for _ in range(2):
        assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts)] == [e.tokenizer.encode(t).ids for t in texts]


def test_no_token_files(spark, no_docs):
    out = new_path(spark, "tokens")
    assert TF.write_token_files(no_docs, out, tokenizer_path(), 2).count() == 0
    assert TF.read_token_files(spark, out).count() == 0


# --- quality classifier
def test_isotonic():
    assert Q.isotonic(np.array([0.0, 0.6, 0.4, 1.0]), np.array([1, 1, 1, 1.0])).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = Q.quality_scores(docs, labels).join(labels, "doc_id").select("doc_id", "score", "quality").collect()
    held = [(r["score"], r["quality"]) for r in scores if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.98
    assert np.mean([a > b for a in good[:300] for b in bad]) > 0.98


def test_classifier_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (6, None), (None, 0)], "doc_id bigint, quality int")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert Q.quality_scores(no_docs, labels.limit(0)).count() == 0
    assert Q.filter_quality(docs, labels, threshold=2.0).count() == 0
    assert Q.filter_quality(docs, labels, threshold=0.0).columns == docs.columns


# --- WARC
PAGES = [(i, f"http://x/{i} é", "<p>" + words(60, i % 4) + "</p>") for i in range(40)] + [(40, None, None), (41, "u", ""), (42, "u", "short"), (43, "u", "short"), (None, "u", "<p>" + words(60, 0) + "</p>"), (44, "u", "\x1f\x8b\x08" * 50 + "\r\n\r\n"), (0, "http://x/0 é", "<p>" + words(60, 0) + "</p>")]


@pytest.mark.parametrize("split", [1 << 23, 97])
def test_warc_round_trip(spark, split):
    frame = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id bigint, url string, html string, digest string")
    out = new_path(spark, "warc")
    W.write_warc(frame, out)
    got = W.read_warc(spark, out, split_bytes=split).collect()
    assert len(got) == len(PAGES)
    firsts = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            firsts[h] = min(firsts.get(h, i), i)
    for r in got:
        options = [h or "" for i, _, h in PAGES if i == r["page_id"]]
        assert r["payload_digest"] in {hashlib.sha256(h.encode()).hexdigest() for h in options}
        html = next(h for h in options if hashlib.sha256(h.encode()).hexdigest() == r["payload_digest"])
        assert r["payload_bytes"] == len(html.encode())
        first = firsts.get(html, r["page_id"])
        if r["page_id"] is None or first == r["page_id"]:
            assert (r["record_type"], r["refers_to"]) == ("response", None) and bytes(r["payload"]).decode() == html
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", first, None)


def test_no_pages(spark):
    out = new_path(spark, "warc")
    W.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), out)
    assert W.read_warc(spark, out).count() == 0


# --- decontamination
def plain_hits(text, items, n):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    w, hit, names = find(text), set(), set()
    for name, item in items:
        v = find(item)
        m = min(n, len(v))
        for k in range(len(v) - m + 1 if v else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[k : k + m]:
                    hit |= set(range(j, j + m))
                    names.add(name)
    return len(w), sorted(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_decontamination(spark, docs, block_bytes):
    items = [(1, words(60, 3)), (2, "QUICK brown fox"), (3, "one"), (4, None), (5, " ... "), (None, words(25, 6)), (7, "ab " * 30), (1, "STRASSE double space next")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    extra = [(50, "ab " * 14 + "x", "s"), (51, words(8, 9) + " " + " ".join(words(60, 3).split()[20:31]).upper(), "s")]
    rows = ROWS + extra
    got = DC.find_contamination(table(spark, rows), bench, 10, block_bytes=block_bytes).collect()
    expected = sorted(((i, *plain_hits(t, [("" if n is None else str(n), x) for n, x in items], 10)) for i, t, _ in rows), key=str)
    mine = sorted(((r["doc_id"], r["n_words"], [k for s in r["spans"] for k in range(s["start"], s["stop"])], sorted(r["items"])) for r in got), key=str)
    assert mine == expected
    clean = DC.decontaminate(table(spark, rows), bench)
    assert clean.columns == table(spark, rows).columns
    assert clean.count() == sum(1 for e in expected if not e[2])


@pytest.mark.parametrize("block_bytes", [1 << 25, 40])
def test_decontamination_leaves_columns_alone(spark, block_bytes):
    bench = spark.createDataFrame([(1, words(12, 1)), (2, words(12, 2)), (3, words(12, 3))], "item_id bigint, text string")
    rows = [(1, words(12, 1), 77, "mine", ["a"]), (2, "clean text", 78, None, None), (3, None, 79, "x", []), (4, words(12, 3).upper() * 2, 80, "y", ["b"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, spans string, items array<string>")
    clean = DC.decontaminate(docs, bench, block_bytes=block_bytes)
    assert clean.schema == docs.schema and sorted(map(tuple, clean.collect())) == [(2, "clean text", 78, None, None), (3, None, 79, "x", [])]


def test_decontamination_of_nothing(spark, docs, no_docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert DC.find_contamination(no_docs, bench).count() == 0
    assert DC.decontaminate(docs, bench).count() == len(ROWS)


CLASHES = ["__id", "__key", "__source", "__nth", "__mix_spans", "spans0", "row", "id", "key", "nth", "mix_id", "__simhash_id", "__simhash_n", "taken"]


def test_clashing_columns(spark, docs):
    """Stages give back every column of theirs, whatever its name."""
    from trestle.llm.simhash import simhash_dedup

    odd = docs.select("*", *[F.lit(c).alias(c) for c in CLASHES])
    mixed = M.mixed_documents(odd, M.mix_sources(odd, share=1.5, max_repeats=2, block_words=64))
    plain = M.mixed_documents(docs, M.mix_sources(docs, share=1.5, max_repeats=2, block_words=64))
    assert mixed.columns == odd.columns and simhash_dedup(odd).columns == odd.columns
    assert sorted(map(str, mixed.select("doc_id", "text").collect())) == sorted(map(str, plain.select("doc_id", "text").collect()))
    assert all(r[c] == c for r in [*mixed.collect(), *simhash_dedup(odd).collect()] for c in CLASHES)


@pytest.mark.parametrize("split", [700, 1 << 23])
def test_damaged_archives_are_errors(spark, split):
    import random

    import pyarrow as pa
    import pyarrow.fs as pafs

    rng = random.Random(2)
    frame = spark.createDataFrame([(i, f"http://x/{i}", "".join(rng.choice("abcdef \n") for _ in range(400))) for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    out = new_path(spark, "warc")
    W.write_warc(frame, out)
    name = W.read_manifest(spark, out).first()["name"]
    fs, root = pafs.FileSystem.from_uri(out)
    with fs.open_input_file(f"{root}/{name}") as f:
        whole = f.read()

    def read(data, strict):
        found = []
        for start in range(0, len(whole), split):
            found += [r for r in map(W._parsed, W.records(pa.BufferReader(data), start, min(start + split, len(whole)), strict)) if r]
        return len(found)

    assert read(whole, True) == read(whole, False) == W.read_warc(spark, out, split_bytes=split).count() == 20
    starts = [i for i in range(len(whole)) if whole.startswith(W.MAGIC, i)]
    for at in (*(s + 40 for s in starts[1:]), *starts[1:], starts[-1] + 1):
        broken = bytearray(whole)
        broken[at] ^= 0xFF
        assert read(bytes(broken), False) < 20
        with pytest.raises(ValueError, match="record at byte"):
            read(bytes(broken), True)
    with pytest.raises(ValueError, match="record at byte"):
        read(whole[:-9], True)
