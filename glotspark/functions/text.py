"""Text primitives as Columns: strip, fold, language tags, and cell detectors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: All 29 white-space code points; Spark's ``trim`` knows only the blank.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
# What a wrongly decoded text and a placeholder look like.
MOJIBAKE = "[Â-ô][\u0080-¿]+|�"
PLACEHOLDER = r"\{[^}]*\}|%\d*\$?[sdfx]|<[^>]+>|\[\[[^\]]+\]\]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def filled(c: Column) -> Column:
    """Null, empty and blank are all missing."""
    return strip(c) != ""


def _fold(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text).casefold()


@F.pandas_udf(StringType())
def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC and case folding; Spark has no built-in for either."""
    for s in batches:
        yield s.map(_fold)


@F.pandas_udf(BooleanType())
def is_nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: x is None or unicodedata.is_normalized("NFC", x))


def has_mojibake(c: Column) -> Column:
    return c.rlike(MOJIBAKE)


def placeholders(c: Column) -> Column:
    """The multiset of placeholders, as a sorted array."""
    return F.array_sort(F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0)))


def multiset_minus(a: Column, b: Column) -> Column:
    """What ``a`` holds more of than ``b``, each value as often as it does."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    more = F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(F.lit(0), times(a, x) - times(b, x))))
    return F.flatten(more)


def whitespace_issue(c: Column) -> Column:
    """The first that applies, or null."""
    return F.when(strip(c) != c, "leading/trailing whitespace").when(c.rlike(r"\p{Cc}"), "control character").when(c.contains("﻿"), "embedded BOM")


#: Han, kana, Hangul: terms of these scripts have no word boundaries.
CJK = re.compile("[\u1100-\u11ff\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3038-\u303b\u3040-\u30ff\u3130-\u318f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff\uff66-\uff9d\uffa0-\uffdc\U0001b000-\U0001b16f\U00020000-\U0003fffd]")
WORD = r"[\p{L}\p{N}_]"


def is_cjk(c: Column) -> Column:
    return c.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def wide_script(c: Column) -> Column:
    """The wider test that linking uses: any character from U+2E80 on."""
    return c.rlike(r"[\x{2E80}-\x{10FFFF}]")


def mostly_cjk(c: Column) -> Column:
    """Whether at least half of the characters, and one at least, are Hangul, kana or Han."""
    return F.length(F.regexp_replace(c, r"[^가-힣぀-ヿ㐀-鿿]", "")) >= F.greatest(F.lit(1), F.floor(F.length(c) / 2))


def looks_korean(c: Column) -> Column:
    return c.rlike("[가-힣]")


def looks_japanese(c: Column) -> Column:
    return c.rlike("[぀-ヿ]")


def printable(c: Column) -> Column:
    """Control, format, surrogate, private and unassigned characters as ``·``."""
    return F.regexp_replace(c, r"\p{C}", "·")


def boundary_pattern(term: str) -> str:
    """A pattern for ``term`` with a word boundary at both ends: on each side of it a word character and none (or the text's end) meet.

    So a term that begins or ends with a mark (``C++``) needs a word character next to that mark, as with ``\\b``.
    """
    inside = lambda c: c.isalnum() or c == "_"
    if not term:
        return "(?!)"
    quoted = re.sub(r"([^\w\s]|_)", r"\\\1", term)
    after = f"(?!{WORD})" if inside(term[-1]) else f"(?={WORD})"
    return f"{quoted}{after}(?<{'!' if inside(term[0]) else '='}{WORD}{quoted})"


def at_boundary(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] has word boundaries at both ends."""
    inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    return inside(start - 1) != inside(start) and inside(end - 1) != inside(end)


def bounded(text: Column, term: Column) -> Column:
    """Whether ``term`` stands in ``text`` between word boundaries (see ``boundary_pattern``); CJK terms match anywhere, an empty term nowhere."""
    quoted = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    left = F.when(term.rlike(f"^{WORD}"), F.lit(f"(?<!{WORD})")).otherwise(F.lit(f"(?<={WORD})"))
    right = F.when(term.rlike(f"{WORD}$"), F.lit(f"(?!{WORD})")).otherwise(F.lit(f"(?={WORD})"))
    return F.when(term == "", F.lit(False)).when(is_cjk(term), F.contains(text, term)).otherwise(F.contains(text, term) & F.regexp_like(text, F.concat(left, quoted, right)))


def base_lang(c: Column) -> Column:
    return F.lower(F.split_part(F.replace(c, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)))


def normalize_lang(c: Column) -> Column:
    """BCP-47 casing: language lower, script title, region upper, digits kept, the rest lower."""
    parts = F.split(F.replace(strip(c), F.lit("_"), F.lit("-")), "-")
    cased = F.transform(
        parts,
        lambda p, i: F.when(i == 0, F.lower(p)).when(p.rlike("^[A-Za-z]{4}$"), F.initcap(p)).when(p.rlike("^[A-Za-z]{2}$"), F.upper(p)).otherwise(F.lower(p)),
    )
    return F.array_join(cased, "-")


def canon_lang(c: Column) -> Column:
    """Language lower, every later part upper."""
    parts = F.split(F.replace(strip(c), F.lit("_"), F.lit("-")), "-")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).otherwise(F.upper(p))), "-")


def lang_aliases(c: Column) -> Column:
    norm = normalize_lang(c)
    return F.filter(F.array_distinct(F.array(norm, F.split_part(norm, F.lit("-"), F.lit(1)))), lambda x: x != "")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Grams of the text between ``^`` and ``$``; a shorter text is one gram. Fold and strip it first, as ``corpus.gram_weights`` does."""
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    return F.when(F.length(padded) <= n, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))


def cosine(a: Column, b: Column) -> Column:
    """Of two maps from gram to weight; 0 for an empty one or one without length."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda acc, k: acc + a[k] * F.coalesce(b[k], F.lit(0.0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when(norm(a) * norm(b) > 0, dot / (norm(a) * norm(b))).otherwise(0.0)


def cluster_fold(c: Column) -> Column:
    """NFKC and case folding without hyphens, white space runs as one blank: what cosmetic variants share."""
    return F.regexp_replace(strip(F.replace(fold(c), F.lit("-"), F.lit(""))), f"{SPACE}+", " ")


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """The edit distance, or ``most + 1`` where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def csv_row(*cells: Column) -> Column:
    """An RFC 4180 row: cells with comma, quote or line break are quoted, quotes doubled."""
    quote = lambda c: F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *(quote(F.coalesce(c, F.lit(""))) for c in cells))


def content_disposition(name: Column, kind: str = "attachment") -> Column:
    """A header (``attachment`` or ``inline``) with an ASCII fallback and the RFC 5987 form."""
    plain = F.regexp_replace(name, r'[^\x20-\x7e]|["\\]', "_")
    coded = F.url_encode(name)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%21", "!"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.concat(F.lit(f'{kind}; filename="'), plain, F.lit("\"; filename*=UTF-8''"), coded)
