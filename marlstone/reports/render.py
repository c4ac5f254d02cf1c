"""Renderings of the report tables: CSV, JSON, Markdown, HTML, and a workbook where openpyxl is installed. Tables have tens of rows, a model each."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from .tables import TABLES, build, newest

ABSENT = "—"
#: How many digits a column shows, by the first of these that its name holds.
DIGITS = [("cost", 6), ("per_million", 4), ("savings", 6), ("rate", 4), ("f1", 4), ("accuracy", 4), ("tokens_mean", 1), ("", 4)]


def cell(name: str, value: object) -> str:
    """A value as shown; what is absent is a dash and never 0."""
    if value is None or value == "":
        return ABSENT
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return format(value, f",.{next(d for token, d in DIGITS if token in name)}f")
    return format(value, ",") if isinstance(value, int) else str(value)


def rows_of(table: DataFrame) -> list[dict]:
    return [r.asDict() for r in table.collect()]


def markdown_table(columns: list[str], rows: list[dict]) -> str:
    head = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    return "\n".join(head + ["| " + " | ".join(cell(c, r[c]).replace("|", "\\|").replace("\n", " ") for c in columns) + " |" for r in rows])


def markdown(tables: dict[str, tuple[list[str], list[dict]]], stamp: str | None) -> str:
    """One section for each table; those of judges and modes only if they have rows."""
    parts = ["# Results", f"As of {stamp or ABSENT}. {ABSENT}: not computed."]
    for name, (columns, rows) in tables.items():
        if rows or name not in ("Judge", "ClassificationModes"):
            parts += [f"## {name}", markdown_table(columns, rows)]
    return "\n\n".join(parts) + "\n"


def html_page(tables: dict[str, tuple[list[str], list[dict]]], stamp: str | None) -> str:
    e = html.escape
    out = ["<!doctype html>", '<html lang="en"><head><meta charset="utf-8"><title>Results</title><style>table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}</style></head><body>', f"<h1>Results</h1><p>As of {e(stamp or ABSENT)}</p>"]
    for name, (columns, rows) in tables.items():
        body = "".join("<tr>" + "".join(f"<td>{e(cell(c, r[c]))}</td>" for c in columns) + "</tr>" for r in rows)
        out.append(f"<h2>{e(name)}</h2><table><tr>{''.join(f'<th>{e(c)}</th>' for c in columns)}</tr>{body}</table>")
    return "\n".join([*out, "</body></html>", ""])


def csv_text(columns: list[str], rows: list[dict]) -> str:
    held = io.StringIO()
    writer = csv.DictWriter(held, columns, lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    return held.getvalue()


def workbook(tables: dict[str, tuple[list[str], list[dict]]], stamp: str | None) -> bytes:
    """A sheet for each table after one that says what this is. Needs openpyxl; ImportError where it is absent."""
    import openpyxl

    book = openpyxl.Workbook()
    book.active.title = "About"
    book.active.append(["As of", stamp or ABSENT])
    for name, (columns, rows) in tables.items():
        sheet = book.create_sheet(name)
        sheet.append(columns)
        for r in rows:
            sheet.append([r[c] for c in columns])
    held = io.BytesIO()
    book.save(held)
    return held.getvalue()


def render(summaries: DataFrame) -> dict[str, str | bytes]:
    """File name to content, a function of the summaries alone."""
    stamp = newest(summaries)
    tables = {name: (df.columns, rows_of(df)) for name, df in build(summaries).items()}
    files: dict[str, str | bytes] = {"leaderboard.csv": csv_text(*tables["Leaderboard"]), "leaderboard.json": json.dumps(tables["Leaderboard"][1], ensure_ascii=False, indent=2) + "\n"}
    files |= {"leaderboard.md": markdown_table(*tables["Leaderboard"]) + "\n", "RESULT.md": markdown(tables, stamp), "report.html": html_page(tables, stamp)}
    try:
        files["results.xlsx"] = workbook(tables, stamp)
    except ImportError:
        pass  # an optional package
    return files


def generate(summaries: DataFrame, write: Callable[[str, str | bytes], None]) -> list[str]:
    """Every rendering, handed to ``write(name, content)``; returns the names."""
    files = render(summaries)
    for name, content in files.items():
        write(name, content)
    return list(files)


__all__ = ["TABLES", "cell", "generate", "markdown", "render"]
