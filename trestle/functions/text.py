"""Text normalisers, tokens, stems and matching as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trestle.functions import lexicon as L


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """White space runs, no-break spaces included, to one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)[\s﻿]+", " "))


def _lower_e(c: Column | str) -> Column:
    return F.translate(F.lower(F.coalesce(_col(c), F.lit(""))), "ё", "е")


def normalize_work(c: Column | str) -> Column:
    """Work names: lower case, ё as е; quotes, brackets, stops and dashes as spaces."""
    return collapse(F.regexp_replace(_lower_e(c), "[«»\"'().,;:–—-]", " "))


def normalize_table(c: Column | str) -> Column:
    """Table cells: as work names, but hyphens stay and long dashes become hyphens."""
    return collapse(F.regexp_replace(F.translate(_lower_e(c), "–—", "--"), "[«»\"'().:;,]", " "))


def table_form(phrase: str) -> str:
    """normalize_table() of a phrase of the caller's."""
    return " ".join(re.sub("[«»\"'().:;,]", " ", phrase.lower().translate(str.maketrans("ё–—", "е--"))).split())


def normalize_quantity(c: Column | str) -> Column:
    """Running text with quantities: stops stay."""
    return collapse(_quantity_chars(F.coalesce(_col(c), F.lit(""))))


def _quantity_chars(c: Column) -> Column:
    return F.translate(F.lower(c), "ё–—«»\"'()", "е--       ")


def quantity_chars(c: Column | str) -> Column:
    """What normalize_quantity() makes of each character, in its place, so that windows can be cut out; null where letters of a text are lower-cased by their neighbours or to more than one."""
    made = _quantity_chars(_col(c))
    return F.when((F.length(made) == F.length(_col(c))) & ~F.contains(_col(c), F.lit("Σ")), made)


def normalize_plain(c: Column | str) -> Column:
    """Lower case, ё as е, single spaces."""
    return collapse(_lower_e(c))


def normalize_intake(c: Column | str) -> Column:
    """As normalize_plain, with long dashes as hyphens."""
    return collapse(F.translate(_lower_e(c), "–—", "--"))


def normalize_key(c: Column | str) -> Column:
    """Join keys: trimmed lower case; ё and inner spaces stay."""
    return F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", ""))


#: Characters of the words of table cells and running text, all others part words.
WORD_CHARS = "[а-яa-z0-9-]"


def tokens(normalized: Column, stop: Sequence[str], least: int, chars: str | None = None) -> Column:
    """Words of ``least`` characters or more that are no stop words: between spaces, or runs of ``chars`` (found as such: splitting at all other characters takes twelve times as long)."""
    if chars is not None:
        return F.filter(F.regexp_extract_all(normalized, F.lit(f"{chars}{{{least},}}"), F.lit(0)), lambda w: ~w.isin(*stop))
    return F.filter(F.split(normalized, " "), lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def tokens_work(c: Column | str) -> Column:
    return tokens(normalize_work(c), L.STOP_WORK, 2)


def tokens_taxonomy(c: Column | str) -> Column:
    return tokens(normalize_work(c), L.STOP_TAXONOMY, 2)


def tokens_table(c: Column | str) -> Column:
    return tokens(normalize_table(c), L.STOP_TABLE, 3, WORD_CHARS)


def tokens_quantity(c: Column | str, normalized: bool = False) -> Column:
    """normalized: the text is so already (normalize_quantity)."""
    return tokens(_col(c) if normalized else normalize_quantity(c), L.STOP_TABLE, 3, WORD_CHARS)


def tokens_audit(c: Column | str) -> Column:
    return tokens(normalize_plain(c), L.STOP_AUDIT, 2)


#: The shortest start of at least four letters that an ending completes, which takes off the longest ending.
STEM_PATTERN = "^(.{4,}?)(?:" + "|".join(L.ENDINGS) + ")$"


def stem(word: Column) -> Column:
    """The word without the longest ending that leaves four letters (what STEM_PATTERN says, by looking its ends up)."""
    n, out = F.length(word), word
    for k in sorted({len(e) for e in L.ENDINGS}):
        out = F.when((n >= 4 + k) & F.right(word, F.lit(k)).isin(*[e for e in L.ENDINGS if len(e) == k]), F.substring(word, F.lit(1), n - k)).otherwise(out)
    return out


def roots(words: Column) -> Column:
    return F.transform(words, stem)


def roots_match(a: Column, b: Column) -> Column:
    """Equal, or both of four letters or more and one the start of the other."""
    # most pairs differ from the start, so that is asked first
    return (F.startswith(a, b) | F.startswith(b, a)) & ((a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4)))


def matched_roots(wanted: Column, there: Column) -> Column:
    return F.filter(wanted, lambda a: F.exists(there, lambda b: roots_match(a, b)))


def coverage(wanted: Column, there: Column) -> Column:
    """Share of the distinct wanted roots that are there; 0 if none is wanted."""
    distinct = F.array_distinct(wanted)
    return F.when(F.size(distinct) == 0, F.lit(0.0)).otherwise(F.size(matched_roots(distinct, there)) / F.size(distinct))


def js_round(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + 0.5)


def texts_match(a: Column | str, b: Column | str) -> Column:
    """One contains the other, or at least half of the shorter one's roots are matched."""
    x, y = normalize_plain(a), normalize_plain(b)
    rx, ry = roots(tokens_audit(a)), roots(tokens_audit(b))
    n = F.size(matched_roots(rx, ry))
    some = (F.size(rx) > 0) & (F.size(ry) > 0) & (n >= 1) & (n / F.greatest(F.least(F.size(rx), F.size(ry)), F.lit(1)) >= 0.5)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | some)


def phrase_count(text: Column, phrase: Column | str) -> Column:
    """Occurrences of a phrase that do not overlap."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    n = F.length(p)
    return F.when(n == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, p, F.lit("")))) / n).cast("int"))


def by_letters(pattern: str) -> str:
    """A pattern that occurs in the same texts: one that begins with (^|[^set]) or (^|\\s) and letters looks for the letters first, then at what stands before them.

    Else every character of a text is held against the set, which takes many times as long.
    """
    m = re.match(r"\(\^\|(?:\[\^([^\[\]\\&]+)\]|\\s)\)(\w+)(.*)$", pattern, re.S)
    if not m:
        return pattern
    barred, letters, rest = f"[{m[1]}]" if m[1] else r"\S", m[2], m[3]
    if rest[:1] in "?*+{":
        letters, rest = letters[:-1], letters[-1] + rest
    outer = re.sub(r"\\.", "", rest)
    while (inner := re.sub(r"\([^()]*\)|\[[^\[\]]*\]", "", outer)) != outer:
        outer = inner
    return pattern if not letters or "|" in outer else f"{letters}(?<!{barred}{letters}){rest}"


def patterns_matched(text: Column, patterns: Sequence[str]) -> Column:
    """Number of patterns that occur."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_like(text, F.lit(by_letters(p))).cast("int")
    return out


def phrases_found(text: Column, phrases: Sequence[str], normalize: Callable[[Column], Column]) -> Column:
    """The phrases, as given, whose normalised form occurs in the normalised text."""
    pairs = F.array(*[F.struct(F.lit(p).alias("phrase"), normalize(F.lit(p)).alias("form")) for p in phrases])
    return F.transform(F.filter(pairs, lambda p: (p["form"] != "") & F.contains(text, p["form"])), lambda p: p["phrase"])


def starts_with_any(text: Column, phrases: Sequence[str]) -> Column:
    """The first phrase whose normalised form (so without spaces at its end) starts the text, else null: one pattern, alternatives in order."""
    forms: dict[str, str] = {}
    for p in phrases:
        forms.setdefault(table_form(p), p)
    told = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    start = "^(?:" + "|".join(map(re.escape, forms)) + ")"
    return F.when(F.regexp_like(text, F.lit(start)), told[F.regexp_extract(text, start, 0)])


def clean_work_name(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(c), "^[-–— ]+", ""), "[-–— ]+$", ""))


def material_name(c: Column | str) -> Column:
    """Without leading numbering, the last ten words, without a leading label and trailing stops."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", " "), r"^[\d\s.,;:№\-–—]+", ""))
    words = F.split(plain, " ")
    last = F.array_join(F.slice(words, F.greatest(F.size(words) - 9, F.lit(1)), F.lit(10)), " ")
    unlabelled = F.regexp_replace(last, r"(?iu)^(позиция|поз\.?|наименование|материал|оборудование)\s+", "")
    return F.trim(F.regexp_replace(unlabelled, r"\s*[-–—:;,.]+\s*$", ""))


def window_around(text: Column, index: Column, before: int, after: int) -> Column:
    """The stretch from ``before`` characters ahead of a 0-based index to ``after`` behind it."""
    start = F.greatest(index - before, F.lit(0))
    return collapse(F.substring(text, start + 1, F.least(index + after, F.length(text)) - start))


def sentence_around(text: Column, index: Column, length: Column) -> Column:
    """The sentence that holds a hit; if that has under 20 characters, 90 before to 120 after the hit."""
    head = F.reverse(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), index)), r"^[^.!?;\n\r]*", 0))
    rest = F.substring(text, index + length + 1, F.length(text))
    tail = F.regexp_extract(rest, r"^[^.!?;\n\r]*[.!?;\n\r]?", 0)
    sentence = collapse(F.concat(head, F.substring(text, index + 1, length), tail))
    start = F.greatest(index - 90, F.lit(0))
    near = collapse(F.substring(text, start + 1, F.least(index + length + 120, F.length(text)) - start))
    return F.when(F.length(sentence) >= 20, sentence).otherwise(near)


def signature(context: Column) -> Column:
    """The first 14 words of four letters or more that are no stop words."""
    words = F.split(F.regexp_replace(normalize_intake(context), r"[^а-яёa-z0-9\s]", " "), " ")
    return F.array_join(F.slice(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*L.STOP_SIGNATURE)), 1, 14), " ")


def is_followup_revision(label: Column | str) -> Column:
    """Labels such as revB, rev.2, R3 and изм.1; revA, rev1 and R1 are firsts."""
    t = F.regexp_replace(F.lower(F.coalesce(_col(label), F.lit(""))), r"(?U)\s+", "")
    letter, number, r = F.regexp_extract(t, r"^rev\.?([a-z])$", 1), F.regexp_extract(t, r"^rev\.?(\d+)$", 1), F.regexp_extract(t, r"^r(\d+)$", 1)
    return (
        F.when(letter != "", letter != "a")
        .when(number != "", number.cast("double") > 1)
        .when(r != "", r.cast("double") > 1)
        .otherwise(F.regexp_like(t, F.lit(r"^изм\.?\d+$")))
    )


def joined_label(parts: Sequence[Column], separator: str = " · ") -> Column:
    """The parts that are not empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), separator)


def plural_documents(n: Column) -> Column:
    """Russian plural of «документ»."""
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    word = F.when((tens >= 11) & (tens <= 14), "документов").when(ones == 1, "документ").when((ones >= 2) & (ones <= 4), "документа").otherwise("документов")
    return F.concat_ws(" ", n.cast("string"), word)


def literal(text: str) -> str:
    return re.escape(text)
