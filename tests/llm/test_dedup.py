"""Exact, near, substring and line dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS, table, words
from trestle.llm import exact_dedup as E
from trestle.llm import line_dedup as LD
from trestle.llm import simhash as S
from trestle.llm import substring_dedup as SD
from trestle.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(t):
    return (t or "").translate(LOWER)


def test_exact_dedup(docs):
    got = E.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[norm(t)].append(i)
    assert len(got) == len(ROWS)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_heavy_and_light_groups_agree(spark):
    rows = [(i, "copy" if i % 3 else f"text {i // 6}", "s") for i in range(300)]
    frame = table(spark, rows)
    heavy = E.heavy_digests(E.digests(frame), max_heavy=4)
    assert heavy.where("group_size = 200").count() == 1
    few = sorted(tuple(r) for r in E.exact_dedup(frame, max_heavy=1).collect())
    many = sorted(tuple(r) for r in E.exact_dedup(frame, max_heavy=200).collect())
    assert few == many


def test_exact_dedup_of_nothing(no_docs):
    assert E.exact_dedup(no_docs).count() == 0


def plain_fingerprint(text, k):
    w = WORD.findall(norm(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if linked(items[a], items[b]):
                parent[find(a)] = find(b)
    return [find(i) for i in range(len(items))]


@pytest.mark.parametrize("k", [3, 5])
def test_fingerprints(docs, k):
    got = {(r["doc_id"], r["fp"] % (1 << 64)) for r in S.fingerprints(docs, k).collect()}
    assert got == {(i, plain_fingerprint(t, k)) for i, t, _ in ROWS}


@pytest.mark.parametrize(("distance", "hot"), [(2, 64), (2, 2), (1, 64), (1, 2), (0, 2), (3, 64), (4, 64)])
def test_links_give_exact_components(spark, distance, hot):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set()
    for f in base:
        for _ in range(14):
            g = f
            for _ in range(rng.randint(0, 3)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    roots = {r["node"]: r["root"] for r in connected_components(S.links(frame, distance, hot)).collect()}
    roots = [roots.get(f, f) for f in signed]
    expected = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= distance)
    assert len(set(zip(roots, expected, strict=True))) == len(set(roots)) == len(set(expected))


def test_simhash_groups_and_dedup(docs):
    got = S.simhash_groups(docs).collect()
    assert len(got) == len(ROWS)
    empties = {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)}
    assert empties == {3}
    kept = S.simhash_dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 6, 7, 8, 9, 10]
    assert kept.where("doc_id is null").count() == 1


def test_near_copies_are_verified(spark):
    base = words(200, 300)
    edited = lambda n, seed: " ".join("zz" + str(seed) if i % (200 // n) == 1 else w for i, w in enumerate(base.split()))
    rows = [(1, base, "s"), (2, edited(2, 1), "s"), (3, edited(50, 2), "s"), (4, base.upper(), "s"), (5, words(200, 301), "s")]
    got = {r["doc_id"]: r["component_id"] for r in S.near_copy_groups(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}  # two edits leave 0.9 of the shingles, fifty hardly any


def test_many_near_copies_are_one_group(spark):
    base = words(300, 400).split()
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :]), "s") for i, k in enumerate(range(0, 300, 2))]
    got = {r["component_id"] for r in S.near_copy_groups(table(spark, rows)).collect()}
    assert got == {0}


def boilerplate_family(n, seed, shared=264, own=36):
    """n pages that share most words (pairwise just under 0.8) and, with ids from n, a true near copy of each."""
    base, rng = words(shared, seed), random.Random(seed)
    rows = []
    for i in range(n):
        page = (base + " " + words(own, seed * 10_000 + i)).split()
        copy = list(page)
        copy[rng.randrange(len(page))] = f"new{i}"
        rows += [(i, " ".join(page), "s"), (n + i, " ".join(copy), "s")]
    return rows


def share_a_variant(a, b):
    return any(((x ^ y) >> shift & 0xFFFFFFFF).bit_count() <= 1 for x, y in zip(a, b, strict=True) for shift in (0, 32))


def test_copies_among_boilerplate_are_found(spark):
    n = 150
    rows = boilerplate_family(n, 8)
    got = {r["doc_id"]: r["component_id"] for r in S.near_copy_groups(table(spark, rows), lanes=1).collect()}
    prints = {i: S.lanes_of(t.encode(), 2, 1) for i, t, _ in rows}
    candidates = [i for i in range(n) if share_a_variant(prints[i], prints[n + i])]
    assert len(candidates) > 100 and [i for i in candidates if got[n + i] != i] == []  # every pair that the signatures give
    assert all(c == i % n or c == i for i, c in got.items())  # and none between pages


def similar_pairs(texts, k=5, similarity=0.8):
    """All pairs of texts (by id) whose sets of k-word shingles have the similarity, by an index of shingles."""
    sets, by = {}, defaultdict(list)
    for i, t in texts.items():
        w = WORD.findall(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        for x in sets[i]:
            by[x].append(i)
    seen = {p for v in by.values() for p in itertools.combinations(v, 2)}
    return {(a, b) for a, b in seen if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_near_copies(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = {r["doc_id"]: norm(r["text"]) for r in docs.select("doc_id", "text").collect()}
    firsts = {}
    for i in sorted(rows):
        firsts.setdefault(rows[i], i)
    expected = similar_pairs({i: t for t, i in firsts.items()})
    got = {r["doc_id"]: r["component_id"] for r in S.near_copy_groups(docs).collect()}
    found = sum(got[a] == got[b] for a, b in expected)
    assert found >= 0.9 * len(expected)
    # nothing is grouped that no chain of similar pairs and copies links
    parent = {i: firsts[t] for i, t in rows.items()}
    root = dict(zip(firsts.values(), plain_roots(list(firsts.values()), expected), strict=True))
    assert all(root[parent[i]] == root[parent[c]] for i, c in got.items())


def test_recall_just_above_the_similarity(spark):
    """Pairs of texts with a similarity of 0.8 to 0.85, short and long ones."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "eru", "ito", "ol", "une", "ast", "ire", "omu", "ep", "ay")]
    rows = []
    for k in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([60, 150, 400, 1000]))]
        other = text[:]
        for j in rng.sample(range(len(text)), max(1, int(len(text) * 0.021))):
            other[j] = rng.choice(vocabulary)
        rows += [(2 * k, " ".join(text), "a"), (2 * k + 1, " ".join(other), "b")]
    expected = similar_pairs({i: t for i, t, _ in rows})
    got = {r["doc_id"]: r["component_id"] for r in S.near_copy_groups(table(spark, rows)).collect()}
    assert len(expected) > 100 and sum(got[a] == got[b] for a, b in expected) >= 0.9 * len(expected)


def plain_roots(items, pairs):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in items]


def test_simhash_of_nothing(no_docs):
    assert S.simhash_groups(no_docs).count() == 0
    assert S.simhash_dedup(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100 and 7 in got


def plain_substring(rows, n):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            key, me = tuple(w[k : k + n]), float("-inf") if i is None else i
            first[key] = min(first.get(key, me), me)
    out = []
    for i, t in rows:
        w, me = WORD.findall(t or ""), float("-inf") if i is None else i
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < me for j in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def test_substring_dedup(spark, docs):
    shared = words(40, 50)
    rows = ROWS + [(20 + i, words(30, 60 + i) + " " + shared + " " + words(20, 90 + i), "s") for i in range(30)]
    frame = table(spark, rows)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in SD.remove_repeats(frame, 13).collect()), key=str)
    assert got == plain_substring([(i, t) for i, t, _ in rows], 13)


def test_substring_dedup_of_nothing(no_docs):
    assert SD.remove_repeats(no_docs).count() == 0


def plain_lines(rows, threshold):
    seen, out = [], []
    for i, t in rows:
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            s = frozenset(line.encode().split())
            if s:
                if any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                    gone.append(n)
                seen.append(s)
        lines = (t or "").split("\n")
        out.append((i, 0 if t is None else len(lines), len(gone), "\n".join(x for n, x in enumerate(lines) if n not in gone)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [words(n, 200 + n) for n in (1, 2, 4, 5, 9, 10, 20, 40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(5):
            w = rng.choice(pool).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = words(1, rng.randrange(10**6))
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "\n \n", "s")]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_text"]) for r in LD.line_dedup(table(spark, rows), 0.8).collect()), key=str)
    assert got == plain_lines([(i, t) for i, t, _ in rows], 0.8)


def test_line_dedup_takes_any_rows(docs, no_docs):
    assert LD.line_dedup(docs).count() == len(ROWS)
    assert LD.line_dedup(no_docs).count() == 0
    assert LD.removed_lines(docs).where(F.col("id") == 8).distinct().count() == 1


def complementary_words(n=1024):
    """Two words that every polynomial sum modulo 2**64 hashes alike."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_look_alike_to_sums_are_told_apart(spark):
    one, other = complementary_words()
    rows = [(1, " ".join([one, *words(12, 1).split()]), "s"), (2, " ".join([other, *words(12, 1).split()]), "s"), (3, one, "s"), (4, other, "s")]
    assert [r["n_removed"] for r in SD.remove_repeats(table(spark, rows), 13).collect()] == [0] * 4
    assert [r["n_removed"] for r in LD.line_dedup(table(spark, rows[2:]), 0.8).collect()] == [0] * 2


def test_windows_of_one_hash_are_told_apart_by_their_words():
    import numpy as np
    import pyarrow as pa

    texts = [words(40, 1) + "  \n" + words(20, 2), words(20, 3) + "\t" + words(40, 1)]
    chunk = SD._Chunk(pa.table({"id": pa.array([2, 1]), "text": pa.array([t.encode() for t in texts], pa.binary())}), 13)
    chunk.h1[:], chunk.h2[:] = 7, 7
    counters = chunk.counters(1, 16)
    found, least, index = chunk.candidates([n > 1 for _, _, n in counters], counters)
    windows = [tuple(texts[d].split()[i : i + 13]) for d in (0, 1) for i in range(48)]
    assert len(found) == len(set(windows)) == len({(g, w) for g, w in zip(index.tolist(), windows, strict=True)})
    assert [int(least[i]) for i in index] == [1 if i >= 48 or windows[i] in windows[48:] else 2 for i in range(96)] and np.unique(index).tolist() == list(range(len(found)))


@pytest.mark.parametrize("long", [1 << 20, 64])
def test_words_and_hashes(monkeypatch, long):
    import numpy as np
    import pyarrow as pa

    from trestle.llm import words as WD

    monkeypatch.setattr(WD, "LONG", long)
    texts = [words(50, 1), "", " a\n\n b a ", "x" * 200 + " y", "é\x1c ü\r\na", None, words(50, 1), "x" * 200]
    column = pa.array([t and t.encode() for t in texts], pa.binary())
    known, places = {}, []
    for row, w in WD.chunks(column, key=12345):
        for h, t, n, i, j in zip(w.hash.tolist(), (w.text + row).tolist(), w.line_no.tolist(), w.starts.tolist(), w.ends.tolist(), strict=True):
            assert known.setdefault(w.data[i:j].tobytes(), h) == h
            places.append((t, n, w.data[i:j].tobytes()))
        text, at = w.spelled(np.arange(len(w.hash)))
        assert text.split() == [p[2] for p in places] and len(at) == len(places) + 1
    assert places == [(t, n, x) for t, text in enumerate(texts) for n, line in enumerate((text or "").encode().split(b"\n")) for x in line.split()]
    assert len(set(known.values())) == len(known)


def test_copies_that_a_task_remembers(spark):
    rows = [(i, "one two three\n" + words(6, i), "s") for i in range(200)] + [(500 + i, "one two three", "s") for i in range(50)]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_text"]) for r in LD.line_dedup(table(spark, rows[::-1]).coalesce(1), 0.8).collect()), key=str)
    assert got == plain_lines([(i, t) for i, t, _ in rows], 0.8)


def test_repeated_rows_and_null_ids_in_line_dedup(spark):
    rows = [(None, "a b c d\ne f g h", "s"), (5, "a b c d\nx", "s"), (5, "a b c d\nx", "s"), (5, "x\nother text", "s"), (-(1 << 63), "e f g h", "s")]
    got = sorted((str(r["doc_id"]), r["n_removed"], r["kept_text"]) for r in LD.line_dedup(table(spark, rows), 0.8).collect())
    lows = [r for r in got if r[0] in ("None", str(-(1 << 63)))]
    assert sum(r[1] for r in lows) == 1  # one of the two lowest loses the line that both have
    fives = [r for r in got if r[0] == "5"]
    assert sorted(r[1] for r in fives if r[2] != "x\nother text" and r[2] != "other text") in ([1, 1], [2, 2]) and sum("x" in r[2].split("\n") for r in fives) in (1, 2)


def test_variants_that_nodes_share_are_found_all_and_counted(spark):
    rng = random.Random(5)
    fps = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)]
    fps += [x ^ 1 << rng.randrange(63) for x in fps[:100]] + [-1, 0, -(1 << 63)]
    nodes = [(i, i % 2, x) for i, x in enumerate(fps)] + [(i + 1000, i % 2, x) for i, x in enumerate(fps[:7])]
    for distance in (0, 1, 2, 3, 5):
        at = {}
        for node, lane, fp in nodes:
            for shift, mask, slot in S._cuts(distance):
                at.setdefault(((fp & (1 << 64) - 1) >> shift & mask) | lane << 38 | slot, []).append(node)
        expected = sorted((v, n, len(ns)) for v, ns in at.items() if len(ns) > 1 for n in ns)
        frame = spark.createDataFrame(nodes, "node bigint, lane int, fp bigint")
        assert sorted(tuple(r) for r in S._shared(frame, distance).select("variant", "node", "n").collect()) == expected
    assert S._shared(spark.createDataFrame([], "node bigint, lane int, fp bigint"), 2).isEmpty()


def test_entries_of_a_common_word_meet_in_cells():
    import numpy as np

    rng = np.random.default_rng(3)
    n, common = 400, np.zeros(1 << 10, np.uint32)
    common[7] = 3 * LD.CELL  # the word 7 is taken to be common: four blocks
    x = {"word": rng.choice(np.array([7, 8, 9], np.uint32), n), "set": np.arange(n) * 3 + rng.integers(0, 3, n), "id": rng.integers(0, 50, n), "bitmap": rng.integers(0, 1 << 10, n)}
    x |= {"size": rng.integers(4, 30, n), "at": rng.integers(0, 5, n), "asks": rng.random(n) < 0.5}
    cells = LD._in_cells(x, common)
    assert len(cells["key"]) == 4 * (x["word"] == 7).sum() + (x["word"] != 7).sum()
    half = np.arange(len(cells["key"])) % 2 == 0
    cells = LD._unpacked([LD._packed(cells, np.flatnonzero(half)), LD._packed(cells, np.flatnonzero(~half))])
    order = np.lexsort((cells["size"], cells["key"]))
    cells = {k: v[order] for k, v in cells.items()}
    got = {frozenset((int(cells["set"][i]), int(cells["set"][j]))) for a, b in LD._met(cells, 0.8) for i, j in zip(a, b, strict=True)}
    plain = set()
    for i, j in itertools.combinations(range(n), 2):
        (s, t), (u, v) = ((int(x["size"][k]), int(x["size"][k] - x["at"][k])) for k in (i, j))
        apart = (int(x["bitmap"][i]) ^ int(x["bitmap"][j])).bit_count()
        if x["word"][i] == x["word"][j] and min(s, u) >= 0.8 * max(s, u) - 1e-9 and min(t, v) >= 0.8 / 1.8 * (s + u) - 1e-9 and apart <= 0.2 / 1.8 * (s + u) + 1e-9:
            plain.add(frozenset((int(x["set"][i]), int(x["set"][j]))))
    assert plain and got - {g for g in got if len(g) == 1} == plain


def test_sketches_never_overstate_the_difference(monkeypatch):
    monkeypatch.setattr(LD, "SKETCHED", 7)
    rng = random.Random(4)
    pool = words(60, 9).split() + ["a longer word than sixteen bytes".replace(" ", "-")]
    lines = [" ".join(rng.choices(pool, k=rng.randint(1, 80))).encode() for _ in range(40)]
    sizes, found = LD.sketches(lines, 99)
    assert sizes.tolist() == [len(set(x.split())) for x in lines]
    for i, j in itertools.combinations(range(40), 2):
        apart = (int.from_bytes(found[i], "big") ^ int.from_bytes(found[j], "big")).bit_count()
        true = len(set(lines[i].split()) ^ set(lines[j].split()))
        assert apart <= true and (true - apart) % 2 == 0
    assert LD.sketches([], 1)[0].tolist() == []


def near_copies(n, seed, size=30, changed=1):
    """Lines that differ from one line in a word or two each."""
    rng, base = random.Random(seed), words(size, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.sample(range(size), changed):
            w[i] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def partners_of(spark, lines):
    rows = LD._rows(table(spark, [(i, x, "s") for i, x in enumerate(lines)]), "doc_id", "text")
    counts = LD.word_counts(rows, 16, 99)
    sets = LD.materialize(LD.numbered_sets(LD.lines_of(rows, counts, 0.8, 99)), "lines").where("not copy")
    return sets, counts, LD.close_partners(sets, None, counts, 0.8, LD.FEW).collect()


def test_partners_of_near_copies_grow_with_the_lines(spark):
    few, many = (partners_of(spark, near_copies(n, 3))[2] for n in (100, 400))
    assert len(few) == 99 and len(many) == 399  # each but the first has an earlier one
    assert sum(len(r["ys"]) for r in many) < 6 * sum(len(r["ys"]) for r in few)  # all pairs: 16 times as many
    assert sum(r["more"] for r in many) > 300  # what a set leaves out is told


def test_unlike_long_lines_that_share_rare_words_are_no_partners(spark):
    rng = random.Random(4)
    lines = [" ".join([f"rare{i // 10}x{k}" for k in range(6)] + [f"w{k}" for k in rng.sample(range(500), 200)]) for i in range(60)]
    assert partners_of(spark, lines)[2] == []  # each shares six rare words with nine others


def test_sets_that_their_first_partners_do_not_settle_ask_again(spark, monkeypatch):
    rng = random.Random(8)
    lines = near_copies(60, 5, 40, 2) + near_copies(60, 6, 40, 4) + near_copies(12, 7, 180, 12) + near_copies(12, 9, 400, 20) + near_copies(6, 10, 800, 30)
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]
    rounds, real = [], LD.close_partners
    monkeypatch.setattr(LD, "FEW", 1)
    monkeypatch.setattr(LD, "close_partners", lambda *a: (rounds.append(a[-1]), real(*a))[1])
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_text"]) for r in LD.line_dedup(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), 0.8).collect()), key=str)
    assert got == plain_lines(list(enumerate(texts)), 0.8) and rounds[0] == 1 and rounds[1] >= LD.MORE


def test_bitmaps_of_any_width_never_overstate_the_difference():
    import numpy as np
    import pyarrow as pa

    from trestle.llm.words import chunks

    lines = [x for size in (3, 60, 66, 150, 170, 350, 380, 700, 740, 1500) for x in near_copies(2, size, size, 3)]
    (_, found), = chunks(pa.array(["\n".join(lines).encode()], pa.binary()), 5)
    s = LD.LineSets(found, np.ones(1 << 10, np.uint32))
    bitmap, wide, lengths = LD.parity_bitmaps(s)
    assert lengths.max() == 15 and lengths.min() == 0
    n = len(lines)
    x = {"key": np.zeros(2 * n, np.uint64), "row": np.repeat(np.arange(n), 2), "id": np.zeros(2 * n, np.int64), "at": np.zeros(2 * n, np.int64), "asks": np.ones(2 * n, bool)}
    x |= {"set": x["row"] + 100, "size": s.size[x["row"]], "bitmap": bitmap[x["row"]]}
    cuts = [np.arange(0, n, 3), np.setdiff1d(np.arange(2 * n), np.arange(0, n, 3))]
    told = LD._unpacked([LD._packed(x, c) for c in cuts])
    full = LD._bitmaps([LD._wide_packed(x["set"][c], x["row"][c], (wide, np.cumsum(lengths) - lengths, lengths)) for c in cuts], told, [len(c) for c in cuts])
    a, b = (np.array(p) for p in zip(*itertools.combinations(range(2 * n), 2), strict=True))
    sets = [set(t.split()) for t in lines]
    for i, j, apart in zip(told["set"][a] - 100, told["set"][b] - 100, LD._apart(*full, a, b).tolist(), strict=True):
        true = len(sets[i] ^ sets[j])
        assert apart <= true and (true - apart) % 2 == 0 and (apart > 0 or i == j or true < 8)
