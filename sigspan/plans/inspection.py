"""The audit from a stored table to its report files."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sigspan.errors import stage_errors
from sigspan.operators import audit
from sigspan.sinks import report
from sigspan.sinks.tables import save_csv
from sigspan.sources.tables import load_dataset


@dataclass(frozen=True)
class InspectionConfig:
    input_path: str
    output_dir: str = "reports/inspection_subject_distribution"
    top_k: int = 10
    positive_label: int = 1


@dataclass
class Inspection:
    """Bounded results on the driver, tables still distributed."""

    metadata: dict[str, Any]
    blocks: dict[str, dict[str, Any]]
    summary: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def inspect(df: DataFrame, config: InspectionConfig) -> Inspection:
    """Run the audit; the table is read once, for the subject summary."""
    valid = audit.validate_dataset(df, config.positive_label)
    recording = audit.infer_recording_column(df)
    # The only large aggregation; every later step reads its cached result.
    summary = audit.sort_summary(audit.subject_summary(valid, recording)).persist()
    with stage_errors():
        totals = audit.global_summary(summary).first().asDict()
        stats = {r["block"]: r.asDict() for r in audit.distribution_stats(summary).collect()}
        shares = audit.concentration(summary).first().asDict()
        flags = audit.risk_flags(summary).first().asDict()
    order = [f"{c}_per_subject" for c in audit.DISTRIBUTION_COLUMNS]
    blocks = {
        "global_summary": totals,
        "distribution_stats": {
            b: {k: v for k, v in stats[b].items() if k != "block"} for b in order
        },
        "concentration": shares,
        "risk_flags": flags,
    }
    metadata = {
        "input_path": config.input_path,
        "n_rows_dataset": totals["total_segments"],
        "columns": df.columns,
        "recording_column_used": recording,
    }
    tables = {
        "top_by_positive": audit.top_by_positive(summary, config.top_k),
        "top_by_segments": audit.top_by_segments(summary, config.top_k),
        "zero_positive_subjects": audit.zero_positive_subjects(summary),
    }
    return Inspection(metadata, blocks, summary, tables)


def save(spark: SparkSession, result: Inspection, config: InspectionConfig) -> str:
    """Write tables, JSON and Markdown; return the console text."""
    folder = config.output_dir.rstrip("/")
    for name, table in {"subject_summary": result.summary, **result.tables}.items():
        save_csv(table, f"{folder}/{name}.csv")
    top, zero = report.PREVIEW_ROWS, result.tables["zero_positive_subjects"]
    previews = {
        "Top subjects by positive segments": report.preview(result.tables["top_by_positive"], top),
        "Top subjects by total segments": report.preview(result.tables["top_by_segments"], top),
        "Subjects with zero positive segments": report.preview(zero, top),
        "Subject summary preview": report.preview(result.summary, report.SUMMARY_ROWS),
    }
    report.write_text(
        spark,
        f"{folder}/inspection_summary.json",
        report.summary_json(result.metadata, result.blocks),
    )
    report.write_text(
        spark,
        f"{folder}/inspection_report.md",
        report.markdown_report(result.metadata, result.blocks, previews),
    )
    tops = {
        f"Top {config.top_k} subjects by positive segments": report.preview(
            result.tables["top_by_positive"], config.top_k
        ),
        f"Top {config.top_k} subjects by total segments": report.preview(
            result.tables["top_by_segments"], config.top_k
        ),
    }
    return report.console_summary(result.blocks, tops, folder)


def run(spark: SparkSession, config: InspectionConfig) -> Inspection:
    result = inspect(load_dataset(spark, config.input_path), config)
    print(save(spark, result, config))
    result.summary.unpersist()
    return result
