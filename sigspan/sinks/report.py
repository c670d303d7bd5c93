"""Audit outputs: CSV tables, a JSON summary, a Markdown report, console text.

Only bounded results reach the driver: one-row summaries and previews.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

PREVIEW_ROWS = 10
SUMMARY_ROWS = 20


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file on whichever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    """Pipe table; floats to four digits, numbers aligned at the decimal point."""
    if not rows:
        return "_No data_\n"

    def cell(value: Any) -> str:
        if value is None:
            return "nan"
        if isinstance(value, float):
            return f"{round(value, 4):g}" if value == value else "nan"
        return str(value)

    body = [[cell(v) for v in row] for row in rows]
    numeric = [
        all(isinstance(row[i], (int, float)) and not isinstance(row[i], bool) for row in rows)
        for i in range(len(columns))
    ]
    for i in (i for i, is_number in enumerate(numeric) if is_number):
        tails = [len(r[i]) - len(r[i].split(".")[0]) for r in body]
        for r, tail in zip(body, tails):
            r[i] += " " * (max(tails) - tail)
    # Headers get two spaces more than their text.
    width = [max(len(c) + 2, *(len(r[i]) for r in body)) for i, c in enumerate(columns)]

    def line(cells: list[str]) -> str:
        padded = [
            c.rjust(w) if n else c.ljust(w) for c, w, n in zip(cells, width, numeric)
        ]
        return "| " + " | ".join(padded) + " |"

    rule = "|".join("-" * (w + 1) + ":" if n else ":" + "-" * (w + 1) for w, n in zip(width, numeric))
    return "\n".join([line(columns), f"|{rule}|", *map(line, body)]) + "\n"


def preview(df: DataFrame, n: int) -> str:
    return markdown_table(df.columns, [tuple(r) for r in df.limit(n).collect()])


def _bullets(values: dict[str, Any], bold: bool = True, digits: int | None = None) -> list[str]:
    def shown(value: Any) -> Any:
        return round(value, digits) if digits is not None and value is not None else value

    mark = "**" if bold else ""
    return [f"- {mark}{key}{mark}: {shown(value)}" for key, value in values.items()]


def markdown_report(
    metadata: dict[str, Any],
    blocks: dict[str, dict[str, Any]],
    tables: dict[str, str],
) -> str:
    """Nine numbered sections; ``tables`` maps a section title to a preview."""
    facts = {
        "Dataset": f"`{metadata['input_path']}`",
        "Number of rows": metadata["n_rows_dataset"],
        "Columns": ", ".join(metadata["columns"]),
        "Recording column used": metadata["recording_column_used"],
    }
    stats: list[str] = []
    for name, values in blocks["distribution_stats"].items():
        stats += [f"### {name}", "", *_bullets(values, digits=6), ""]
    sections: list[tuple[str, list[str]]] = [
        ("Metadata", [*_bullets(facts, bold=False), ""]),
        ("Global summary", [*_bullets(blocks["global_summary"]), ""]),
        ("Subject-level distribution statistics", stats),
        ("Dataset concentration", [*_bullets(blocks["concentration"], digits=6), ""]),
        ("Methodological risk flags", [*_bullets(blocks["risk_flags"]), ""]),
        *[(title, [table]) for title, table in tables.items()],
    ]
    lines = ["# Pre-split subject-level inspection", ""]
    for number, (title, body) in enumerate(sections, start=1):
        lines += [f"## {number}. {title}", "", *body]
    return "\n".join(lines)


def summary_json(metadata: dict[str, Any], blocks: dict[str, dict[str, Any]]) -> str:
    return json.dumps({"metadata": metadata, **blocks}, indent=2, ensure_ascii=False)


def console_summary(
    blocks: dict[str, dict[str, Any]], tables: dict[str, str], output_dir: str
) -> str:
    rule = "=" * 80
    lines = ["", rule, "PRE-SPLIT SUBJECT-LEVEL INSPECTION", rule]
    for title, name, digits in (
        ("Global summary", "global_summary", None),
        ("Concentration", "concentration", 6),
        ("Methodological risk flags", "risk_flags", None),
    ):
        lines += ["", f"[{title}]", *_bullets(blocks[name], bold=False, digits=digits)]
    for title, table in tables.items():
        lines += ["", f"[{title}]", table.rstrip("\n")]
    return "\n".join([*lines, "", f"Results saved to: {output_dir}", ""])
