"""Subject-level audit of a labelled table.

Only the subject summary reads the table; everything else derives from it, in one
pass (two for quantiles). The shares of single subjects also need the totals, a
scan of the labels. The number of subjects may be large as well, so nothing here
gathers the summary in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspan.errors import DatasetInspectionError, fail
from sigspan.functions.events import strip
from sigspan.operators.quantiles import describe
from sigspan.schemas import require_columns
from sigspan.session import shuffle_partitions

# Columns that may identify a recording, in order of preference.
RECORDING_COLUMNS = (
    "recording_id",
    "recording",
    "file_path",
    "edf_path",
    "signal_path",
    "run",
    "session",
    "filename",
)

# Columns of the distribution block.
DISTRIBUTION_COLUMNS = ("n_segments", "n_positive", "n_negative", "positive_ratio")

# Risk thresholds.
FEW_SUBJECTS, VERY_FEW_SUBJECTS = 15, 10
FEW_POSITIVE_SUBJECTS, VERY_FEW_POSITIVE_SUBJECTS = 6, 4
LOW_POSITIVE_SUBJECT_RATIO = 0.5
TOP1_POSITIVE_SHARE, TOP3_POSITIVE_SHARE = 0.40, 0.75
TOP1_SEGMENT_SHARE, TOP3_SEGMENT_SHARE = 0.25, 0.50
SMALL_SUBJECT_SEGMENTS, SMALL_SUBJECT_FRACTION = 50, 0.20
TOP = 5

# Recommendation texts.
STRATEGY_FEW_SUBJECTS = (
    "Very few subjects: start with a subject-level hold-out split to move forward, but "
    "strongly consider subject-level cross-validation in the final evaluation."
)
STRATEGY_FEW_POSITIVE = (
    "Very few positive subjects: do not use a purely random subject split. Assign positive "
    "subjects in a controlled way to guarantee positives in validation and test."
)
STRATEGY_POSITIVES_CONCENTRATED = (
    "Positives are highly concentrated in a few subjects: use a subject-level hold-out split "
    "with controlled assignment of positive subjects before filling with negatives."
)
STRATEGY_SEGMENTS_CONCENTRATED = (
    "Total segment volume is highly concentrated: use a subject-level hold-out split while "
    "also monitoring the total size of each split."
)
STRATEGY_DEFAULT = (
    "The dataset seems compatible with a reproducible subject-level hold-out split. Still, "
    "explicitly verify that validation and test contain enough positive subjects."
)


def validate_dataset(df: DataFrame, positive_label: int = 1) -> DataFrame:
    """Trimmed subject and 0/1 label; bad values abort the job that reads them.

    The checks sit inside the two columns, so they cost no separate pass.
    """
    require_columns(df, ("subject", "label"), DatasetInspectionError, "dataset")
    subject = strip(F.col("subject").cast("string"))
    label = F.col("label")
    checked_subject = (
        F.when(
            subject.isNull(),
            fail(DatasetInspectionError, "A row has no subject."),
        )
        .when(
            subject == "",
            fail(DatasetInspectionError, "A subject is blank."),
        )
        .otherwise(subject)
    )
    checked_label = (
        F.when(
            label.isNull(), fail(DatasetInspectionError, "A row has no label.")
        )
        .when(
            ~label.isin(0, 1, positive_label),
            fail(
                DatasetInspectionError, "Not one of the labels: ", label
            ),
        )
        .otherwise((label == positive_label).cast("bigint"))
    )
    return df.withColumns({"subject": checked_subject, "label": checked_label})


def infer_recording_column(df: DataFrame) -> str | None:
    return next((c for c in RECORDING_COLUMNS if c in df.columns), None)


def _shares(summary: DataFrame, totals: DataFrame) -> DataFrame:
    """Contribution of each subject to the one row of totals."""
    totals = totals.select(F.struct(F.greatest("positive", F.lit(1)).alias("positive"), "segments")).scalar()
    return summary.withColumns(
        {
            "has_positive": F.col("n_positive") > 0,
            "positive_share_overall": F.col("n_positive") / totals["positive"],
            "segment_share_overall": F.col("n_segments") / totals["segments"],
        }
    )


def subject_summary(df: DataFrame, recording_column: str | None) -> DataFrame:
    """One row per subject, unsorted.

    The recording count is a distinct count: Spark spreads it over (subject,
    recording) first, so a subject with most of the rows is not one task.
    """
    recordings = (
        F.count_distinct(F.col(recording_column))
        if recording_column
        else F.lit(None).cast("bigint")
    )
    counts = df.groupBy("subject").agg(
        F.count("*").alias("n_segments"),
        F.sum("label").alias("n_positive"),
        *([recordings.alias("n_recordings")] if recording_column else []),
    )
    summary = counts.select(
        "subject",
        "n_segments",
        "n_positive",
        (F.col("n_segments") - F.col("n_positive")).alias("n_negative"),
        (F.col("n_positive") / F.col("n_segments")).alias("positive_ratio"),
        (F.col("n_recordings") if recording_column else recordings).alias("n_recordings"),
    )
    # counted in the table itself, which needs no shuffle by subject
    return _shares(summary, df.agg(F.sum("label").alias("positive"), F.count("*").alias("segments")))


def by_positive() -> list[Column]:
    return [F.desc("n_positive"), F.desc("n_segments"), F.asc("subject")]


def by_segments() -> list[Column]:
    return [F.desc("n_segments"), F.desc("n_positive"), F.asc("subject")]


def sort_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(*by_positive())


def global_summary(summary: DataFrame) -> DataFrame:
    """One row of totals and guarded ratios."""
    positive = F.count_if("has_positive")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    sums = summary.agg(
        F.coalesce(F.sum("n_segments"), F.lit(0)).alias("total_segments"),
        F.coalesce(F.sum("n_positive"), F.lit(0)).alias("total_positive"),
        F.count("subject").alias("total_subjects"),
        positive.alias("subjects_with_positive"),
    )
    segments, hits = F.col("total_segments"), F.col("total_positive")
    subjects, with_hits = F.col("total_subjects"), F.col("subjects_with_positive")
    return sums.select(
        segments,
        hits,
        (segments - hits).alias("total_negative"),
        ratio(hits, segments).alias("global_positive_ratio"),
        subjects,
        with_hits,
        (subjects - with_hits).alias("subjects_without_positive"),
        ratio(with_hits, subjects).alias("subject_positive_ratio"),
    )


def distribution_stats(summary: DataFrame) -> DataFrame:
    """One row per summary column; population std, interpolated quantiles."""
    quartiles = {0.25: "p25", 0.5: "median", 0.75: "p75"}
    stats = describe(summary, DISTRIBUTION_COLUMNS, quartiles, sample_std=False)
    return stats.select(
        F.concat(F.col("column"), F.lit("_per_subject")).alias("block"),
        "min",
        "p25",
        "median",
        "mean",
        "p75",
        "max",
        "std",
    )


def _facts(summary: DataFrame) -> DataFrame:
    """One row: totals, and the five largest counts of positives and of segments.

    One pass over the summary. Subjects are dealt into parts; each part keeps its
    sums and its five largest counts, so that what meets in the end is small.
    """
    part = F.pmod(F.xxhash64("subject"), F.lit(shuffle_partitions(summary.sparkSession)))
    counts = summary.select("n_segments", "n_positive", part.alias("part"))

    def rank(column: str) -> Column:
        return F.row_number().over(Window.partitionBy("part").orderBy(F.desc(column)))

    def largest(column: str, rank: str) -> Column:
        return F.collect_list(F.when(F.col(rank) <= TOP, F.col(column))).alias(f"top_{column}")

    def five(column: str) -> Column:
        joined = F.flatten(F.collect_list(f"top_{column}"))
        return F.slice(F.sort_array(joined, asc=False), 1, TOP).alias(f"top_{column}")

    parts = (
        counts.select("*", rank("n_positive").alias("_p"), rank("n_segments").alias("_s"))
        .groupBy("part")
        .agg(
            F.sum("n_segments").alias("segments"),
            F.sum("n_positive").alias("positive"),
            F.count("*").alias("subjects"),
            F.count_if(F.col("n_positive") > 0).alias("with_positive"),
            F.count_if(F.col("n_segments") < SMALL_SUBJECT_SEGMENTS).alias("small"),
            largest("n_positive", "_p"),
            largest("n_segments", "_s"),
        )
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns[1:6]]
    return parts.agg(*sums, five("n_positive"), five("n_segments"))


def _shares_of_largest() -> list[Column]:
    """Cumulative share of the top 1, 3 and 5 subjects, over the columns of ``_facts``."""

    def share(counts: str, whole: Column, k: int) -> Column:
        shares = F.transform(F.slice(counts, 1, k), lambda n: n / whole)
        return F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)

    positive, segments = F.greatest("positive", F.lit(1)), F.greatest("segments", F.lit(1))
    return [
        *[share("top_n_positive", positive, k).alias(f"top_{k}_positive_share") for k in (1, 3, 5)],
        *[share("top_n_segments", segments, k).alias(f"top_{k}_segment_share") for k in (1, 3, 5)],
    ]


def concentration(summary: DataFrame) -> DataFrame:
    """One row: how much of all positives and segments the top subjects hold."""
    return _facts(summary).select(*_shares_of_largest())


def recommend_strategy() -> Column:
    """First matching recommendation, over the columns of ``_facts``."""
    return (
        F.when(F.col("total_subjects") < VERY_FEW_SUBJECTS, STRATEGY_FEW_SUBJECTS)
        .when(F.col("subjects_with_positive") < VERY_FEW_POSITIVE_SUBJECTS, STRATEGY_FEW_POSITIVE)
        .when(
            F.col("top_3_positive_share") >= TOP3_POSITIVE_SHARE, STRATEGY_POSITIVES_CONCENTRATED
        )
        .when(F.col("top_3_segment_share") >= TOP3_SEGMENT_SHARE, STRATEGY_SEGMENTS_CONCENTRATED)
        .otherwise(STRATEGY_DEFAULT)
    )


def risk_flags(summary: DataFrame) -> DataFrame:
    """One row of warning flags and the recommended strategy."""
    subjects, hits = F.col("subjects"), F.col("with_positive")
    facts = _facts(summary).select(
        subjects.alias("total_subjects"),
        hits.alias("subjects_with_positive"),
        F.when(subjects > 0, hits / subjects).otherwise(0.0).alias("subject_positive_ratio"),
        F.when(subjects > 0, F.col("small") / subjects).alias("small"),
        (subjects - hits).alias("zero_positive"),
        *_shares_of_largest(),
    )
    col = F.col
    flags = {
        "few_total_subjects": col("total_subjects") < FEW_SUBJECTS,
        "very_few_total_subjects": col("total_subjects") < VERY_FEW_SUBJECTS,
        "few_positive_subjects": col("subjects_with_positive") < FEW_POSITIVE_SUBJECTS,
        "very_few_positive_subjects": col("subjects_with_positive") < VERY_FEW_POSITIVE_SUBJECTS,
        "many_subjects_without_positive": col("subject_positive_ratio")
        < LOW_POSITIVE_SUBJECT_RATIO,
        "positives_highly_concentrated_top1": col("top_1_positive_share") >= TOP1_POSITIVE_SHARE,
        "positives_highly_concentrated_top3": col("top_3_positive_share") >= TOP3_POSITIVE_SHARE,
        "segments_highly_concentrated_top1": col("top_1_segment_share") >= TOP1_SEGMENT_SHARE,
        "segments_highly_concentrated_top3": col("top_3_segment_share") >= TOP3_SEGMENT_SHARE,
        "has_many_very_small_subjects": F.coalesce(col("small"), F.lit(0.0))
        >= SMALL_SUBJECT_FRACTION,
        "has_zero_positive_subjects": col("zero_positive") > 0,
        "recommended_strategy": recommend_strategy(),
    }
    return facts.select(*[value.alias(name) for name, value in flags.items()])


def top_by_positive(summary: DataFrame, k: int = 10) -> DataFrame:
    return summary.orderBy(*by_positive()).limit(k)


def top_by_segments(summary: DataFrame, k: int = 10) -> DataFrame:
    return summary.orderBy(*by_segments()).limit(k)


def zero_positive_subjects(summary: DataFrame) -> DataFrame:
    return summary.where("n_positive = 0").orderBy(F.desc("n_segments"), F.asc("subject"))
