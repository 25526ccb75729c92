"""Meetings of names, roots, pointers and changes, each against a plain version of it."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trestle.functions import sql
from trestle.functions import text as T
from trestle.operators import history, matching, planning, registry, works
from trestle.sources import stores

WORDS = "монтаж монтажа кабель кабеля кабельный труба трубы трубный опора опоры мост шкаф м ка 12 110 пнд".split()


def names(n, seed, most=5):
    rng = random.Random(seed)
    return sorted({" ".join(rng.choice(WORDS[: rng.choice([4, 9, len(WORDS)])]) for _ in range(rng.randint(1, most))) for _ in range(n)})


def test_contained_equals_all_pairs(spark):
    short, long = sorted({*names(60, 1, 2), "", "м", "ка", "zz"}), names(90, 2)
    frame = lambda xs, c: spark.createDataFrame([(x, k) for x in xs for k in "ab"], f"{c} string, k string")
    for cell in (4096, 3):
        got = matching.contained(frame(short, "short"), frame(long, "long"), ["k"], cell).collect()
        assert sorted(map(tuple, got)) == sorted((k, s, x) for s in short for x in long for k in "ab" if s and s in x)


@pytest.mark.parametrize("hot", [64, 3, 1, 0])
def test_matches_equal_all_pairs(spark, hot):
    """However few entries make a root hot, the best works are those of all pairs."""
    rng = random.Random(3)
    entries = names(70, 4, 4)
    held = [(f"w{i}", i, rng.sample(entries, rng.randint(1, 3)) + [""] * (i % 5 == 0)) for i in range(40)]
    catalogue = spark.createDataFrame(held, "work_id string, ord int, names array<string>")
    asked = [*names(60, 5), "", None, "окраска", entries[0]]
    queries = spark.createDataFrame([(x,) for x in asked], "q string")
    pairs = queries.withColumn("k", F.lit(1)).join(catalogue.select(F.lit(1).alias("k"), "work_id", "ord", F.explode("names").alias("n")), "k")
    best = defaultdict(dict)
    for r in pairs.select("q", "work_id", "ord", works.match_score(F.col("q"), F.col("n")).alias("s")).collect():
        best[r["q"]][(r["ord"], r["work_id"])] = max(best[r["q"]].get((r["ord"], r["work_id"]), 0), r["s"])
    got = {r["name"]: r for r in works.match_works(queries, "q", catalogue, hot=hot).collect()}
    assert got.keys() == set(asked)
    for ask, r in got.items():
        ranked = sorted((-s, o, w) for (o, w), s in best[ask].items())[:4]
        top, score = ranked[0][2], -ranked[0][0]
        assert (r["score"], r["work_id"]) == (score, top if score >= 40 else None), ask
        assert [(a["work_id"], a["score"]) for a in r["alternatives"]] == [(w, -s) for s, _, w in ranked[1:] if s < 0], ask


def test_matches_of_an_empty_catalogue(spark):
    catalogue = spark.createDataFrame([], "work_id string, ord int, names array<string>")
    queries = spark.createDataFrame([("a",)], "q string")
    assert tuple(works.match_works(queries, "q", catalogue).first())[:4] == ("a", None, 0, "none")


def test_first_named_equals_all_pairs(spark):
    entries, asked = names(50, 6, 3), names(50, 7, 3)
    catalogue = spark.createDataFrame([(f"w{i}", i, [n, ""]) for i, n in enumerate(entries)], "work_id string, ord int, names array<string>")
    got = {r["text"]: r["work_id"] for r in works.first_named(spark.createDataFrame([(x,) for x in asked], "q string"), "q", catalogue).collect()}
    assert got == {a: f"w{hit[0]}" for a in asked if (hit := [i for i, n in enumerate(entries) if a in n or n in a])}


@pytest.mark.parametrize("by_roots", [True, False])
def test_resources_equal_all_pairs(spark, by_roots):
    rng = random.Random(8)
    expected = [(rng.choice("ab"), n, [rng.choice(names(30, 9, 6)), ""]) for n in names(40, 10, 7)] + [("a", "окраска", [""])]
    present = [(rng.choice("ab"), n, i) for i, n in enumerate(names(80, 11, 6) + ["", "монтаж"])]
    e = spark.createDataFrame(expected, "key string, name string, names array<string>").dropDuplicates(["key", "name"])
    p = spark.createDataFrame(present, "key string, name string, ord int")
    alias = e.select("key", "name", F.explode(F.array_union(F.array("name"), F.col("names"))).alias("a"))
    x, y = T.normalize_plain("a"), T.normalize_plain("n")
    fits = T.texts_match("a", F.col("n")) if by_roots else (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    plain = alias.join(p.select("key", F.col("name").alias("n"), "ord"), "key").where(fits).groupBy("key", "name").agg(F.min_by("n", "ord").alias("n"))
    plain = {(r["key"], r["name"]): r["n"] for r in plain.collect()}
    got = {(r["key"], r["name"]): (r["matched"], r["found"]) for r in works.match_resources(e, p, "key", by_roots=by_roots).collect()}
    assert got == {(k, n): (plain.get((k, n)), (k, n) in plain) for k, n in got} and len(got) == e.count()
    assert 3 < len(plain) < len(got)


def test_resolution_in_order(spark):
    """A Russian work by its taxonomy; others by the matcher; a family without a clear variant; nothing."""
    catalogue = spark.createDataFrame([("lay", 0, ["Прокладка кабеля"])], "work_id string, ord int, names array<string>")
    told = spark.createDataFrame([("cable-duct", "overpass", "duct-over")], "family string, variant string, work_id string")
    asked = ["Кабельная канализация на эстакаде ДВ-4", "прокладка кабеля ВВГ", "Канализация кабельная", "окраска стен", None]
    rows = spark.createDataFrame([(x,) for x in asked], "n string")
    got = {r["name"]: (r["work_id"], r["source"], r["family"], r["variant"]) for r in planning.resolve_works(rows, "n", catalogue, told, T.L.TAXONOMY).collect()}
    none = (None, None)
    assert got == {asked[0]: ("duct-over", "taxonomy", "cable-duct", "overpass"), asked[1]: ("lay", "matcher", *none), asked[2]: (None, "variant-required", *none), asked[3]: (None, "unresolved", *none), None: (None, "unresolved", *none)}


def test_russian_taxonomy(spark):
    told = {"Кабельная канализация на эстакаде ДВ-4": "overpass", "Подземная кабельная канализация в траншее": "underground", "Кабельная канализация: подземный участок и эстакада": None, "Прокладка кабельной канализации": None, "Монтаж опоры": None, "Канализация кабельная через пролётное строение моста": "bridge"}
    rows = spark.createDataFrame([(n,) for n in told], "n string")
    assert {r["n"]: r["variant"] for r in works.classify_taxonomy(rows, "n").collect()} == told


def test_pointers(spark):
    chain = [(i, i + 1) for i in range(100)] + [(100, None), (200, 201), (201, 202), (202, 200), (203, 200), (300, 999), (301, 300), (400, 400)]
    got = {r["id"]: (r["target"], r["hops"], r["state"]) for r in works.resolve_pointers(spark.createDataFrame(chain, "id long, to long"), "id", "to").collect()}
    assert all(got[i] == (100, 100 - i, "resolved") for i in range(100)) and got[100] == (100, 0, "own")
    assert all(got[i] == (None, None, "cycle") for i in (200, 201, 202, 203, 400))
    assert got[300] == (None, 1, "unknown") and got[301] == (None, 2, "unknown") and len(got) == len(chain)


def test_variants(spark):
    variants = spark.createDataFrame([("f", "a", 1), ("f", "b", None), ("f", "c", 9)], "family string, variant string, work_id int")
    pointers = works.resolve_pointers(spark.createDataFrame([(1, 2), (2, None)], "work_id int, p int"), "work_id", "p")
    asked = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c"), ("f", "x"), ("f", None), ("g", "a")], "family string, variant string")
    got = {(r["family"], r["variant"]): (r["mode"], r["work_id"]) for r in works.resolve_variants(asked, variants, pointers).collect()}
    assert got == {("f", "a"): ("work", 2), ("f", "b"): ("overlay", None), ("f", "c"): ("overlay", None), ("f", "x"): (None, None), ("f", None): ("base", None), ("g", "a"): (None, None)}


def plain_replay(actions):
    status, accepted = None, 0
    for a in actions:
        to, allowed = history.TRANSITIONS.get(a, (None, ()))
        if to and status in allowed:
            status, accepted = to, accepted + 1
    return status, accepted, len(actions) - accepted


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_replay_of_a_busy_key(spark, block):
    """One key with nearly all changes, cut over tasks and blocks."""
    rng = random.Random(12)
    rows = [("busy", i, rng.choice(["create", "update", "archive", "restore", "odd"])) for i in range(5000)] + [("quiet", 3, "create"), ("quiet", 9, "archive"), (None, 1, "create")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = {r["key"]: (r["status"], r["revision"], r["rejected"]) for r in history.replay(spark.createDataFrame(shuffled, "key string, seq int, action string"), "key", ["seq"], block=block).collect()}
    assert got == {k: plain_replay([a for x, _, a in rows if x == k]) for k in ("busy", "quiet", None)}
    maps = history.transition_maps(spark.createDataFrame(shuffled, "key string, seq int, action string"), "key", ["seq"], block=block)
    assert maps.agg(F.max("n")).first()[0] <= block


def test_refused_arrivals_meet_no_window(spark):
    arrivals = spark.createDataFrame([(i, "d", None, None, "x") for i in range(50)] + [(60, None, "", None, "y"), (61, "d", None, None, "z")], "seq int, document string, title string, label string, sha256 string")
    held = spark.createDataFrame([("d", 7, "current", "old")], "document string, revision int, status string, sha256 string")
    got = {r["seq"]: r for r in registry.register(arrivals, held).collect()}
    assert [(got[0]["error"], got[0]["revision_no"], got[0]["previous_revision"]), (got[61]["revision_no"], got[61]["revision_label"])] == [(None, 2, 7), (3, "R3")]
    assert all((got[i]["error"], got[i]["document"], got[i]["status"]) == ("DUPLICATE_CONTENT", None, None) for i in range(1, 50)) and got[60]["error"] == "TITLE_REQUIRED"


def test_functions_in_sql_text(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    rows = spark.createDataFrame([("Прокладка «кабелей», трубы!", "кабель и труба — ПНД"), (None, "ёлка"), ("", "")], "a string, b string")
    text = spark.sql("""SELECT trestle_normalize_work(a) AS n, trestle_normalize_plain(a) AS p, trestle_roots(trestle_tokens_work(a)) AS ra, trestle_roots(trestle_tokens_audit(b)) AS rb, trestle_stem(a) AS s,
        trestle_coverage(trestle_roots(trestle_tokens_work(a)), trestle_roots(trestle_tokens_audit(b))) AS c, trestle_matched_roots(array('кабел', 'мост'), array('кабельн')) AS m, trestle_roots_match('опор', 'опорн') AS o FROM {rows}""", rows=rows)
    ra, rb = T.roots(T.tokens_work("a")), T.roots(T.tokens_audit("b"))
    plain = rows.select(T.normalize_work("a"), T.normalize_plain("a"), ra, rb, T.stem(F.col("a")), T.coverage(ra, rb), F.array(F.lit("кабел")), F.lit(True))
    assert sorted(map(str, map(tuple, text.collect()))) == sorted(map(str, map(tuple, plain.collect())))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    changes = spark.createDataFrame([(i % 7, "update", "2026-01-01") for i in range(40)] + [(1, "archive", "2026-01-02"), (None, "archive", "2026-01-02")], "id int, action string, at string")
    path = str(tmp_path / "events")
    for _ in range(2):
        stores.write_batch_once(stores.change_events(changes, "id", "action", "at", chunk_ids=2), 5, path)
    stores.write_batch_once(stores.change_events(changes.limit(0), "id", "action", "at"), 6, path)
    rows = stores.read_batches(spark, path).collect()
    assert sorted(i for r in rows if r["action"] == "update" for i in r["ids"]) == list(range(7)) and {r["total"] for r in rows} == {7, 1}
    assert len([r for r in rows if r["action"] == "update"]) > 1


def test_change_events_of_a_stream(spark, tmp_path):
    schema = "id int, action string, at string"
    spark.createDataFrame([(1, "update", "m"), (2, "update", "m"), (1, "update", "m")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    for _ in range(2):  # a restart finds nothing new
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        run = stores.write_change_events(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id", "action", "at").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    assert [(r["ids"], r["total"]) for r in stores.read_batches(spark, str(tmp_path / "out")).collect()] == [([1, 2], 2)]
