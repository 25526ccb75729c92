"""Fill-in-middle transformation: a text is cut at two places and its parts are written around three marks.

An Arrow-batched pandas UDF does the work: the regex library finds the units of a text (a word with the blanks before it, or
blanks at the end), their end offsets go into an array of integers, and two look-ups in it say where the prefix and the middle
end. Cuts and form come from the SHA-256 of ``seed:id``, so that any task, retry or rerun gives a document the same form.

Forms: plain (the text), psm (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) and spm (``<S>`` suffix ``<P>`` prefix ``<M>``
middle). A text that holds one of the marks stays plain, so ``restored`` gives every text back exactly from output and form.

No rows are shuffled: the operator is one pass over texts. A batch ends by bytes, so a worker holds one batch of texts, or a
single longer text, its output and eight bytes for each of its units (a text is bounded by Spark's 2 GB a value).

Defined cases: null and empty texts are plain, with no units; a text of blanks alone is one unit; a null id is hashed as
nothing after the colon; rows with the same id are cut by the same draws, each by its own units; repeated rows give repeated
rows; an empty table gives an empty result; other columns are kept as they are, but for those named like the five new ones,
which are replaced.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_MARK = regex.compile("|".join(map(regex.escape, MARKS)))
FORMED = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def draws(seed: int, doc_id: str) -> tuple[int, int, int, int]:
    """The first four groups of eight hexadecimal digits of the SHA-256 of ``seed:id``."""
    digits = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))


def unit_ends(text: str) -> array:
    return array("q", (m.end() for m in UNIT.finditer(text)))


def formed(text: str, doc_id: str, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = unit_ends(text)
    n = len(ends)
    first, second, whether, which = draws(seed, doc_id)
    if not text or whether % 100 >= fim_percent or _MARK.search(text):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    at, to = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:at], text[at:to], text[to:]
    if which % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", len(prefix), len(middle), "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parts(output: str, form: str) -> tuple[str, str, str]:
    """Prefix, middle and suffix of an output: each mark stands once in it."""
    if form == "plain":
        return output, "", ""
    front, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = front[len(PREFIX) :].split(SUFFIX)
    else:
        suffix, prefix = front[len(SUFFIX) :].split(PREFIX)
    return prefix, middle, suffix


def form_column(doc_id: Column, text: Column, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> Column:
    """A struct of FORMED for a text."""

    @F.pandas_udf(FORMED)
    def form_texts(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [formed(t, i, seed, fim_percent, spm_percent) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        out[["prefix_chars", "middle_chars"]] = out[["prefix_chars", "middle_chars"]].astype("Int64")
        out["output_sha256"] = [sha256(r[4]) for r in rows]
        return out

    return form_texts(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def restored(output: Column, form: Column) -> Column:
    """A struct of the exact text, rebuilt from output and form alone, and its digest (text, sha256)."""

    @F.pandas_udf("text string, sha256 string")
    def restore_texts(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = ["".join(parts(o, f)) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": texts, "sha256": [sha256(t) for t in texts]})

    return restore_texts(output, form)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs with n (units), form, prefix_chars and middle_chars (code points; null if plain), output and output_sha256."""
    new = [x.split()[0] for x in FORMED.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    cut = docs.select(*kept, form_column(F.col(id_col), F.col(text_col), seed, fim_percent, spm_percent).alias("__formed"))
    return cut.select(*kept, *(F.col(f"__formed.{c}").alias(c) for c in new))
