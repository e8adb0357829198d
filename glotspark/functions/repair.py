"""Candidates for text that was decoded with the wrong encoding. Python's codecs are strict where the JVM's replace, so this is an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import mostly_cjk

# The encodings tried, in this order.
WRONG = ["latin-1", "cp1252", "cp949", "utf-8"]
WRONG_WIDE = ["latin-1", "cp1252", "cp949", "utf-8", "shift_jis"]
TRUE = ["utf-8", "cp949", "shift_jis", "gb18030", "big5"]


def candidates(text: str | None, wrong: list[str]) -> list[tuple[str, str, str]]:
    """(wrong, true, text) of every pair whose round trip works and changes the text; none for null."""
    found = []
    for w in wrong if text else []:
        try:
            raw = text.encode(w)
        except UnicodeError:
            continue
        for t in TRUE:
            try:
                again = raw.decode(t)
            except UnicodeError:
                continue
            if again != text:
                found.append((w, t, again))
    return found


def repairs(c: Column, wrong: list[str] = WRONG) -> Column:
    """An array of (wrong, true, text), in the order of the encodings; empty for null."""

    @F.pandas_udf("array<struct<wrong:string,true:string,text:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: [dict(zip(("wrong", "true", "text"), row, strict=True)) for row in candidates(x, wrong)])

    return run(c)


def traced(c: Column, every: bool = False) -> Column:
    """``repairs`` over the wider list, longest text first, then by encodings; only those mostly of CJK letters unless ``every``."""
    found = repairs(c, WRONG_WIDE)
    if not every:
        found = F.filter(found, lambda x: mostly_cjk(x["text"]))
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x["text"])).alias("n"), x["wrong"].alias("wrong"), x["true"].alias("true"), x["text"].alias("text"))))
    return F.transform(ranked, lambda x: F.struct(x["wrong"].alias("wrong"), x["true"].alias("true"), x["text"].alias("text")))
