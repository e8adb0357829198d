"""Sinks: paged CSV with one BOM, Markdown and JSON reports, triples, and report gates."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def csv_pages(df: DataFrame, order: list[str], page_rows: int = 1000) -> Iterator[bytes]:
    """The BOM with the header, then pages of RFC 4180 rows in order. One partition is held at a time."""
    head = df.sparkSession.range(1).select(X.csv_row(*(F.lit(c) for c in df.columns)).alias("line")).first().line
    yield f"\ufeff{head}\r\n".encode()
    page: list[str] = []
    lines = df.orderBy(*order).select(X.csv_row(*(F.col(f"`{c}`").cast("string") for c in df.columns)).alias("line"))
    for r in lines.toLocalIterator(prefetchPartitions=True):
        page.append(r.line)
        if len(page) == page_rows:
            yield ("\r\n".join(page) + "\r\n").encode()
            page = []
    if page:
        yield ("\r\n".join(page) + "\r\n").encode()


def write_csv_bom(df: DataFrame, path: str, order: list[str]) -> None:
    """One file on the driver's disk, for a spreadsheet; large tables go to ``df.write.csv``."""
    with open(path, "wb") as f:
        for page in csv_pages(df, order):
            f.write(page)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder with a header, at any size; quotes are doubled."""
    df.write.csv(path, header=True, escape='"')


def wide(cells: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """(key, one column for each language) from (key, lang, value); a missing cell is empty."""
    return cells.groupBy(key).pivot("lang", langs).agg(F.first("value", ignorenulls=True)).na.fill("")


def jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line; null fields are kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).write.text(path)


def triples(df: DataFrame, path: str) -> None:
    """``s p o .`` lines."""
    df.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.text(path)


def rows_of(df: DataFrame, most: int | None = 1000) -> list:
    """A report's rows. More than ``most`` are an error, since a report isn't an export; without ``most`` they come partition by partition."""
    if most is None:
        return list(df.toLocalIterator())
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write the table, or give most=None")
    return rows


def markdown(df: DataFrame, title: str, most: int | None = 1000) -> str:
    """A report table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows_of(df, most)]) + "\n"


def report_json(df: DataFrame, path: str | None = None, most: int | None = 1000) -> str:
    """The report's rows as a JSON array, written to ``path`` if given."""
    out = json.dumps([r.asDict(recursive=True) for r in rows_of(df, most)], ensure_ascii=False, indent=2, default=str)
    if path:
        Path(path).write_text(out, encoding="utf-8")
    return out


def audit_report(head: dict, findings: DataFrame, form: str = "md", most: int = 50) -> str:
    """An audit (see ``quality.audit``) as Markdown or JSON, with the first ``most`` findings by row, column and issue."""
    first = findings.orderBy("row", "column", "issue", "detail").limit(most).collect()
    if form == "json":
        return json.dumps(head | {"findings": [r.asDict() for r in first]}, ensure_ascii=False, indent=2)
    total = sum(head["counts"].values())
    lines = ["# Audit", "", f"- key column: {head['key_column']}", f"- base language: {head['base']}", f"- findings: {total}", "", "| language | coverage |", "|---|---|"]
    lines += [f"| {c} | {head['coverage'][c]:.1%} |" for c in head["languages"]]
    lines += ["", "| issue | n |", "|---|---|", *(f"| {k} | {n} |" for k, n in sorted(head["counts"].items()))]
    lines += ["", "| row | column | issue | detail |", "|---|---|---|---|", *(f"| {r.row} | {r.column} | {r.issue} | {(r.detail or '').replace('|', chr(92) + '|')} |" for r in first)]
    if total > len(first):
        lines.append(f"\n{total - len(first)} more.")
    return "\n".join(lines) + "\n"


def gate(df: DataFrame, failing: str) -> int:
    """An exit code: 1 where any row meets the SQL condition."""
    return int(not df.where(failing).isEmpty())


#: When each report fails: fixed conditions over the report's rows.
GATES = {
    "audit": "true",  # any finding
    "adherence": "rate < 0.8",
    "equity": "underserved",
    "merge": "true",  # any conflict
    "spans": "true",  # any conflict
    "cluster": "n > 1",
}
