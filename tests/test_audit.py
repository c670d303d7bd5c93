import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspan.errors import DatasetInspectionError, stage_errors
from sigspan.operators import audit
from sigspan.operators.quantiles import exact_quantiles, melt
from sigspan.plans import inspection
from sigspan.sources.tables import load_dataset

# Published audit of 23 subjects (subject, segments, positive).
PUBLISHED = """
15 28792 399
12 17027 294
08 14397 182
11 25046 160
01 52827 129
05 28078 112
13 23748 107
24 15321 102
10 36007 88
23 19115 84
03 27358 83
04 112356 76
07 48273 64
18 25652 64
17 15123 59
20 19863 58
09 48861 55
19 21543 46
22 22320 41
02 25389 35
14 18714 34
06 48040 31
16 13674 18
"""


@pytest.fixture(scope="module")
def summary(spark):
    """The published summary, rebuilt from its counts."""
    rows = [r.split() for r in PUBLISHED.split("\n") if r]
    counts = spark.createDataFrame(
        [(f"sub-{s}", int(n), int(p)) for s, n, p in rows],
        "subject string, n_segments bigint, n_positive bigint",
    )
    base = counts.selectExpr(
        "*",
        "n_segments - n_positive AS n_negative",
        "n_positive / n_segments AS positive_ratio",
        "CAST(1 AS BIGINT) AS n_recordings",
    )
    totals = base.agg(F.sum("n_positive").alias("positive"), F.sum("n_segments").alias("segments"))
    return audit._shares(base, totals).persist()


def test_published_totals(summary):
    row = audit.global_summary(summary).first()
    assert (row.total_segments, row.total_positive, row.total_negative) == (707524, 2321, 705203)
    assert row.global_positive_ratio == pytest.approx(0.003280454090603287, rel=1e-12)
    assert (row.total_subjects, row.subjects_with_positive) == (23, 23)


def test_published_distribution(summary):
    stats = {r.block: r for r in audit.distribution_stats(summary).collect()}
    seg, pos = stats["n_segments_per_subject"], stats["n_positive_per_subject"]
    assert (seg.min, seg.p25, seg.median, seg.p75, seg.max) == (
        13674, 18914.5, 25046, 32399.5, 112356,
    )
    assert seg["mean"] == pytest.approx(30761.91304347826, rel=1e-12)
    assert seg["std"] == pytest.approx(20905.100043255607, rel=1e-12)
    assert (pos.min, pos.p25, pos.median, pos.p75, pos.max) == (18, 50.5, 76, 109.5, 399)
    assert pos["std"] == pytest.approx(87.02069371256185, rel=1e-12)


def test_published_concentration(summary):
    row = audit.concentration(summary).first()
    expected = [
        0.17190866006031882, 0.37699267557087457, 0.5015079707022835,
        0.15880168022568847, 0.3025254266993063, 0.43865225773259986,
    ]
    assert list(row) == pytest.approx(expected, rel=1e-12)


def test_published_flags_and_order(summary):
    flags = audit.risk_flags(summary).first().asDict()
    assert flags.pop("recommended_strategy") == audit.STRATEGY_DEFAULT
    assert len(flags) == 11 and not any(flags.values())
    subjects = [r.subject for r in audit.sort_summary(summary).collect()]
    assert subjects == [f"sub-{r.split()[0]}" for r in PUBLISHED.split("\n") if r]


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(7)
    values = [float(rng.choice([0, 0, 0, rng.gauss(0, 5), rng.randint(1, 9)])) for _ in range(5001)]
    df = spark.createDataFrame(
        [(v, -v if i % 3 else None) for i, v in enumerate(values)], "a double, b double"
    ).repartition(7)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.column, r.p): r.q for r in exact_quantiles(melt(df, ["a", "b"]), probs).collect()}
    other = [-v for i, v in enumerate(values) if i % 3]
    for p in probs:
        assert got["a", p] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert got["b", p] == pytest.approx(np.quantile(other, p), abs=1e-12)


def test_quantiles_of_tiny_and_constant_columns(spark):
    one = spark.createDataFrame([(3.0,)], "a double")
    same = spark.createDataFrame([(2.0,)] * 50, "a double")
    for df, want in ((one, 3.0), (same, 2.0)):
        rows = exact_quantiles(melt(df, ["a"]), [0.25, 0.5, 0.75]).collect()
        assert [r.q for r in rows] == [want] * 3


def test_subject_summary_matches_pandas(spark):
    rng = random.Random(3)
    pdf = pd.DataFrame(
        {
            "subject": [f" s{min(rng.randint(0, 12), 8)} " for _ in range(600)],
            "label": [int(rng.random() < 0.1) for _ in range(600)],
            "run": [rng.choice(["0", "1", "2", None]) for _ in range(600)],
        }
    )
    df = audit.validate_dataset(spark.createDataFrame(pdf))
    assert audit.infer_recording_column(df) == "run"
    got = audit.sort_summary(audit.subject_summary(df, "run")).toPandas()
    want = (
        pdf.assign(subject=pdf.subject.str.strip())
        .groupby("subject")
        .agg(n_segments=("label", "size"), n_positive=("label", "sum"), n_recordings=("run", "nunique"))
        .reset_index()
        .sort_values(["n_positive", "n_segments", "subject"], ascending=[False, False, True])
        .reset_index(drop=True)
    )
    for column in want.columns:
        assert got[column].tolist() == want[column].tolist()
    assert got.positive_share_overall.sum() == pytest.approx(1)
    assert got.segment_share_overall.sum() == pytest.approx(1)


def test_no_positives_and_no_recording_column(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0)], "subject string, label int")
    summary = audit.subject_summary(audit.validate_dataset(df), None)
    rows = {r.subject: r for r in summary.collect()}
    assert rows["a"].n_recordings is None and rows["a"].positive_share_overall == 0.0
    flags = audit.risk_flags(summary).first()
    assert flags.has_zero_positive_subjects and flags.has_many_very_small_subjects
    assert flags.recommended_strategy == audit.STRATEGY_FEW_SUBJECTS
    assert [r.subject for r in audit.zero_positive_subjects(summary).collect()] == ["a", "b"]


def test_positive_label_selects_the_class(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 0)], "subject string, label int")
    rows = audit.validate_dataset(df, positive_label=2).orderBy("subject").collect()
    assert sorted(r.label for r in rows) == [0, 0, 1]
    inverted = audit.validate_dataset(df.where("label < 2"), positive_label=0)
    assert {(r.subject, r.label) for r in inverted.collect()} == {("a", 0), ("b", 1)}


@pytest.mark.parametrize(
    "rows, message",
    [
        ([("a", None)], "no label"),
        ([(None, 1)], "no subject"),
        ([("  ", 1)], "blank"),
        ([("a", 2)], "one of the labels"),
    ],
)
def test_bad_rows_are_rejected(spark, rows, message):
    df = spark.createDataFrame(rows, "subject string, label int")
    with pytest.raises(DatasetInspectionError, match=message), stage_errors():
        audit.subject_summary(audit.validate_dataset(df), None).collect()


def test_missing_columns(spark):
    with pytest.raises(DatasetInspectionError, match="label"):
        audit.validate_dataset(spark.createDataFrame([("a",)], "subject string"))


def test_report_files(spark, tmp_path):
    rows = [(f"s{i % 12:02d}", str(i % 5), int(i % 12 < 4 and i % 7 == 0)) for i in range(1200)]
    source = str(tmp_path / "segments.parquet")
    spark.createDataFrame(rows, "subject string, run string, label int").write.parquet(source)
    config = inspection.InspectionConfig(source, str(tmp_path / "out"), top_k=3)
    result = inspection.run(spark, config)
    saved = json.loads((tmp_path / "out" / "inspection_summary.json").read_text())
    assert list(saved) == [
        "metadata", "global_summary", "distribution_stats", "concentration", "risk_flags",
    ]
    assert saved["metadata"]["recording_column_used"] == "run"
    assert saved["global_summary"]["total_segments"] == 1200
    text = (tmp_path / "out" / "inspection_report.md").read_text()
    assert "## 9. Subject summary preview" in text and "| subject " in text
    back = spark.read.csv(str(tmp_path / "out" / "subject_summary.csv"), header=True)
    assert back.count() == 12 and back.columns == result.summary.columns
    assert spark.read.csv(str(tmp_path / "out" / "top_by_segments.csv"), header=True).count() == 3


def test_load_dataset_dispatch(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "subject string, label int")
    df.write.option("header", True).csv(str(tmp_path / "t.CSV"))
    assert load_dataset(spark, str(tmp_path / "t.CSV")).first().label == 1
    df.where("false").write.parquet(str(tmp_path / "empty.parquet"))
    df.write.json(str(tmp_path / "t.json"))
    for name, message in (
        ("empty.parquet", "no rows"), ("t.json", "Neither"), ("no.parquet", "No table"),
    ):
        with pytest.raises(DatasetInspectionError, match=message):
            load_dataset(spark, str(tmp_path / name))


def test_markdown_table_layout():
    from sigspan.sinks.report import markdown_table

    rows = [("sub-15", 28792, 0.013858016115587663, True), ("sub-05", 280, 0.003988888097442838, False)]
    assert markdown_table(["subject", "n_segments", "positive_ratio", "has_positive"], rows) == (
        "| subject   |   n_segments |   positive_ratio | has_positive   |\n"
        "|:----------|-------------:|-----------------:|:---------------|\n"
        "| sub-15    |        28792 |           0.0139 | True           |\n"
        "| sub-05    |          280 |           0.004  | False          |\n"
    )
    assert markdown_table(["a"], []) == "_No data_\n"
