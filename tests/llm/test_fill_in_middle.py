"""Fill-in-middle against plain formulas, and the exact round trip."""

import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from tests.llm.conftest import ROWS, table, words
from trestle.llm import fill_in_middle as F
from trestle.llm import queries

MORE = [(100 + i, words(i % 7, i) + " " * (i % 3), "a") for i in range(200)] + [(400, "a <P> b", "a"), (401, "a<M", "a"), (402, "w" * 3_000_000, "a"), (403, " " * 2_000_000, "a"), (404, "x " * 500_000, "a"), (405, "a b \x85 \x1c c\x00d", "a")]


def plain(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (i, n, "plain", None, None, sha(text), sha(text))
    if h4 % 100 < 80:
        return (i, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text))
    return (i, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_query_equals_plain_formulas(spark, tmp_path):
    table(spark, ROWS + MORE).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_fill_in_middle(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain(i, t) for i, t, _ in ROWS + MORE), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@given(st.text(alphabet="ab \t\n<>PSM　é😀", max_size=60), st.integers(0, 10**6))
def test_round_trip(text, seed):
    n, form, a, b, output = F.formed(text, "7", seed, 100, 50)
    assert "".join(F.parts(output, form)) == text and n == len(F.unit_ends(text))
    if form != "plain":
        assert tuple(map(len, F.parts(output, form)[:2])) == (a, b)


def test_other_columns_stay_and_clashing_ones_are_replaced(spark):
    docs = table(spark, ROWS[:3])
    out = F.fill_in_middle(docs)
    assert out.columns == [*[c for c in docs.columns if c != "n"], "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    assert out.count() == 3


def test_nothing(spark):
    assert F.fill_in_middle(table(spark, [])).collect() == []
