"""Every operator as a query over the driver's tables.

Doubles are rounded because sums arrive in no fixed order; the oracle rounds the
same way. ``spark_queries`` and ``oracles.duckdb_sql`` share their keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspan.functions import bids, spectral, timedomain
from sigspan.functions.events import (
    coerce_non_negative,
    is_seizure_event_type,
    normalize_event_type,
)
from sigspan.functions.windows import WindowSpec
from sigspan.operators import audit, features, quality
from sigspan.operators import segmentation as seg
from sigspan.operators.intervals import extract_seizure_intervals, sort_intervals
from sigspan.operators.ranks import numbered
from sigspan.plans import inspection
from sigspan.plans import testbed as tb
from sigspan.plans import testbed_files as files
from sigspan.plans.features import build_features_dataset, limit_segments
from sigspan.plans.segments import build_segments_dataset
from sigspan.session import shared_dir
from sigspan.sinks import tables as sinks
from sigspan.sources import dataset_root, edf
from sigspan.sources.events_tsv import read_events, read_paths, read_seizure_intervals
from sigspan.sources.manifest import build_manifest, list_recordings, load_manifest, recording_entities
from sigspan.sources.tables import file_order, head, load_dataset, load_segments

HOURLY = WindowSpec(3600.0, 3600.0)
FILE_WINDOWS = WindowSpec(4.0, 2.0)
Query = Callable[[SparkSession, str], DataFrame]


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(
        *[r(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


# --- windows, overlaps, labels ------------------------------------------------


def windows(spec: WindowSpec) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = seg.generate_time_windows(tb.recordings(spark, sf), spec)
        return out.select(
            "path",
            "start_sec",
            "end_sec",
            r(F.col("end_sec") - F.col("start_sec")).alias("duration_sec"),
        )

    return run


def _pairs(intervals: DataFrame, recordings: DataFrame, spec: WindowSpec) -> DataFrame:
    pairs = seg.window_overlaps(intervals, recordings, spec)
    return rounded(pairs.select("path", "start_sec", "onset_sec", "interval_end_sec", "overlap_sec"))


def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(tb.intervals(spark, sf), tb.recordings(spark, sf), HOURLY)


def long_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of hundreds of strides, with open bounds, and of unknown recordings."""
    quarter = WindowSpec(900.0, 900.0)
    onset, number = F.col("onset_sec"), F.col("n")
    length = F.when(number % 5 == 0, F.lit(400 * 900.0)).otherwise(F.lit(100 * 900.0))
    firsts = tb.intervals(spark, sf).groupBy("path").agg(F.min("onset_sec").alias("onset_sec"))
    firsts = firsts.withColumn("n", F.regexp_extract("path", r"sub-(\d+)", 1).cast("int"))
    long = firsts.select(
        F.when(number % 7 == 0, F.concat(F.lit("/gone"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(number % 5 != 1, onset).alias("onset_sec"),
        F.when(number % 5 != 2, onset + length).alias("end_sec"),
    )
    return _pairs(long, tb.recordings(spark, sf), quarter)


def total_overlap(spark: SparkSession, sf: str) -> DataFrame:
    out = seg.windows_with_overlap(tb.recordings(spark, sf), tb.intervals(spark, sf), HOURLY)
    return rounded(out.select("path", "start_sec", "end_sec", "overlap_sec"))


def ratio(spec: WindowSpec) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = seg.windows_with_ratio(tb.recordings(spark, sf), tb.intervals(spark, sf), spec)
        return rounded(out.select("path", "start_sec", "overlap_ratio"))

    return run


def _labelled(spark: SparkSession, sf: str, drop: bool = True) -> DataFrame:
    spec = WindowSpec(3600.0, 3600.0, 0.5, drop)
    return seg.label_windows(tb.recordings(spark, sf), tb.intervals(spark, sf), spec)


def labels(drop: bool) -> Query:
    return lambda spark, sf: _labelled(spark, sf, drop).select("path", "start_sec", "decision.*")


def reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).groupBy("decision.reason").agg(F.count("*").alias("n"))


def segments_dataset(spark: SparkSession, sf: str) -> DataFrame:
    recordings, intervals = tb.recordings(spark, sf), tb.intervals(spark, sf)
    out = seg.segments(recordings, intervals, HOURLY, ordered=True)
    return out.withColumn("overlap_ratio", r("overlap_ratio"))


def _segments_path(spark: SparkSession, sf: str) -> str:
    """The segments as a stored table, written once per session."""

    def write(path: str) -> None:
        sinks.save_segments_dataset(seg.segments(tb.recordings(spark, sf), tb.intervals(spark, sf), HOURLY), path)

    return tb.written_once(spark, sf, "events", "segments", write, ".parquet")


def event_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The stored segments, which is what the checks read; a check scans only the columns it needs."""
    return load_segments(spark, _segments_path(spark, sf))


def first_segments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(limit_segments(event_segments(spark, sf), 1000))


def threshold_study(spark: SparkSession, sf: str) -> DataFrame:
    """Label counts for three thresholds and both policies, in one pass."""
    ratios = seg.windows_with_ratio(tb.recordings(spark, sf), tb.intervals(spark, sf), HOURLY)
    covered = F.col("overlap_ratio")
    cases = [(t, d) for t in (0.3, 0.5, 0.7) for d in (True, False)]
    counts = []
    for threshold, drop in cases:
        positive = F.count_if(covered >= threshold)
        rest = covered == 0 if drop else covered < threshold
        counts.append(
            F.struct(
                F.lit(threshold).alias("threshold"),
                F.lit(drop).alias("drop_partial"),
                positive.alias("n_positive"),
                F.count_if(rest).alias("n_negative"),
            )
        )
    return ratios.agg(F.array(*counts).alias("cases")).select(F.inline("cases"))


# --- names, annotations, scalar rules -------------------------------------------


def _event_names(spark: SparkSession, sf: str) -> DataFrame:
    """A recording name per event: user, day, type, number."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = F.concat(
        F.lit("/data/sub-"), F.col("user_id").cast("string"),
        F.lit("/sub-"), F.col("user_id").cast("string"),
        F.lit("_ses-"), two(F.dayofmonth("ts")),
        F.lit("_task-"), F.col("event_type"),
        F.lit("_run-"), F.col("event_id").cast("string"), F.lit("_eeg.edf"),
    )
    return tb.table(spark, sf, "events").select("event_id", name.alias("path"))


def parse_bids(spark: SparkSession, sf: str) -> DataFrame:
    path, parts = F.col("path"), F.col("parts")
    split = _event_names(spark, sf).select("*", bids.name_parts(path).alias("parts"))
    return split.select(
        "event_id",
        *bids.filename_fields(parts),
        bids.suffix(parts).alias("suffix"),
        bids.basename(path).alias("filename"),
    )


def parse_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _event_names(spark, sf).select("event_id", F.explode(bids.entities(F.col("path"))))


def events_path(spark: SparkSession, sf: str) -> DataFrame:
    return _event_names(spark, sf).select(
        "event_id", bids.events_path(F.col("path")).alias("events_path")
    )


def _annotation_text(spark: SparkSession, sf: str) -> DataFrame:
    """Events as annotation text, with untidy and missing fields.

    Background rows carry an invalid onset on purpose: it must be ignored.
    """
    kind = F.col("event_type")
    micros = F.timestamp_diff("MICROSECOND", F.expr(tb.EPOCH), F.col("ts").cast("timestamp_ntz"))
    seconds = F.concat(
        F.floor(micros / 1_000_000).cast("string"),
        F.lit("."),
        F.lpad((micros % 1_000_000).cast("string"), 6, "0"),
    )
    text = (
        F.when(kind == "error", F.lit(" SZ_Error\t"))
        .when(kind == "purchase", F.lit(" Sz"))
        .when(kind == "click", F.lit("BCKG "))
        .when(kind == "view", F.lit("n/a"))
    )
    return tb.table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "click", F.lit("-1")).otherwise(F.concat(seconds, F.lit(" "))).alias("onset"),
        F.when(F.col("event_id") % 97 == 0, F.lit("n/a"))
        .otherwise(F.col("value").cast("string"))
        .alias("duration"),
        text.alias("eventType"),
    )


def norm_event_type(spark: SparkSession, sf: str) -> DataFrame:
    return _annotation_text(spark, sf).select(
        "event_id", normalize_event_type(F.col("eventType")).alias("event_type")
    )


def is_seizure(spark: SparkSession, sf: str) -> DataFrame:
    kind = normalize_event_type(F.col("eventType"))
    flagged = _annotation_text(spark, sf).select(
        kind.alias("event_type"), is_seizure_event_type(kind).alias("is_seizure")
    )
    return flagged.groupBy("event_type", "is_seizure").agg(F.count("*").alias("n"))


def coerce_nonneg(spark: SparkSession, sf: str) -> DataFrame:
    return _annotation_text(spark, sf).select(
        "event_id", coerce_non_negative(F.col("duration"), "duration").alias("duration_sec")
    )


def extract_intervals(spark: SparkSession, sf: str) -> DataFrame:
    found = extract_seizure_intervals(_annotation_text(spark, sf), ["event_id"])
    return sort_intervals(rounded(found), "event_id")


def safe_str(spark: SparkSession, sf: str) -> DataFrame:
    df = tb.table(spark, sf, "events").select("event_id", F.col("user_id").alias("session"))
    return df.select(
        "event_id", seg.optional_string(df, "session"), seg.optional_string(df, "run")
    )


def channel_names(spark: SparkSession, sf: str) -> DataFrame:
    number = (F.col("p_partkey") % 150 + 1).cast("int")
    return tb.table(spark, sf, "part").select(
        "p_partkey", features.channel_name(number).alias("channel_name")
    )


# --- audit -----------------------------------------------------------------------


def _event_labels(spark: SparkSession, sf: str, rare: bool) -> DataFrame:
    label = F.col("event_type") == "error"
    if rare:
        label = label & (F.col("value") > 150)
    df = tb.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("subject"),
        F.to_date("ts").cast("string").alias("session"),
        label.cast("int").alias("label"),
    )
    return audit.validate_dataset(df)


def _event_summary(spark: SparkSession, sf: str, rare: bool = True) -> DataFrame:
    df = _event_labels(spark, sf, rare)
    return audit.subject_summary(df, audit.infer_recording_column(df))


def _document_summary(spark: SparkSession, sf: str) -> DataFrame:
    documents = tb.table(spark, sf, "documents").select("doc_id", "source", "lang")
    df = documents.join(tb.table(spark, sf, "labels"), "doc_id").select(
        F.col("source").alias("subject"), F.col("toxic").alias("label"), F.col("lang").alias("run")
    )
    return audit.subject_summary(audit.validate_dataset(df), "run")


def on_summary(operator: Callable[[DataFrame], DataFrame], rare: bool = True) -> Query:
    return lambda spark, sf: rounded(operator(_event_summary(spark, sf, rare)))


def document_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audit.sort_summary(_document_summary(spark, sf)))


def document_flags(spark: SparkSession, sf: str) -> DataFrame:
    return audit.risk_flags(_document_summary(spark, sf))


def validated_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Padded subjects and three label values, the third being positive."""
    label = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1)
    df = tb.table(spark, sf, "events").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("\t")).alias("subject"),
        label.otherwise(0).alias("label"),
    )
    valid = audit.validate_dataset(df, positive_label=2)
    return valid.groupBy("subject", "label").agg(F.count("*").alias("n"))


# --- quality ---------------------------------------------------------------------


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.value_counts(event_segments(spark, sf), "label", "label")


def duration_counts(spark: SparkSession, sf: str) -> DataFrame:
    length = r(F.col("end_sec") - F.col("start_sec"))
    return quality.value_counts(event_segments(spark, sf), length, "duration_sec").limit(5)


def describe_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.summary_statistics(event_segments(spark, sf), ["overlap_ratio"]))


def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.null_counts(event_segments(spark, sf))


def unique_values(spark: SparkSession, sf: str) -> DataFrame:
    return quality.unique_values(event_segments(spark, sf), "window_size_sec")


def n_unique(spark: SparkSession, sf: str) -> DataFrame:
    return quality.n_unique(event_segments(spark, sf), ["subject", "path"])


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return features.extract_all_features(_matrix(spark, sf), "signal", tb.SFREQ, max_channels=4)


def describe_features(spark: SparkSession, sf: str) -> DataFrame:
    wide = _wide(spark, sf)
    return rounded(
        quality.summary_statistics(wide, quality.feature_columns(wide.drop("vec_id"))[:10]), 9
    )


def feature_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return quality.null_counts(ragged(spark, sf))


def negative_power(spark: SparkSession, sf: str) -> DataFrame:
    return quality.negative_power(_wide(spark, sf))


# --- signals ----------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("x"), "label"
    )


def time_kernel(name: str) -> Query:
    kernel = timedomain.TIME_FEATURES[name]
    return lambda spark, sf: _vectors(spark, sf).select(
        "vec_id", r(kernel(F.col("x")), 9).alias(name)
    )


def bandpower(relative: bool) -> Query:
    return lambda spark, sf: _vectors(spark, sf).select(
        "vec_id",
        r(spectral.compute_bandpower(F.col("x"), tb.SFREQ, 8.0, 13.0, relative), 9).alias("alpha"),
    )


def standard_bands(relative: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        powers = spectral.compute_standard_bandpowers(F.col("x"), tb.SFREQ, relative)
        return rounded(_vectors(spark, sf).select("vec_id", powers.alias("p")).select("vec_id", "p.*"), 9)

    return run


def _matrix(spark: SparkSession, sf: str, channels: int = 4) -> DataFrame:
    """A vector cut into four channels of 16 samples."""
    parts = F.array(*[F.slice("x", 16 * i + 1, 16) for i in range(channels)])
    return _vectors(spark, sf).select("vec_id", parts.alias("signal"))


def time_channels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        features.extract_time_domain_features(_matrix(spark, sf), "signal", max_channels=4), 9
    )


def frequency_channels(spark: SparkSession, sf: str) -> DataFrame:
    names = ["Fz", "Cz", "Pz", "Oz"]
    return rounded(
        features.extract_frequency_domain_features(
            _matrix(spark, sf), "signal", tb.SFREQ, names, relative=True
        ),
        9,
    )


def all_channels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_wide(spark, sf), 9)


def ragged(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of two and four channels in one table."""
    cut = F.slice("signal", 1, F.when(F.col("vec_id") % 2 == 0, 2).otherwise(4))
    df = _matrix(spark, sf).select("vec_id", cut.alias("signal"))
    return rounded(features.extract_all_features(df, "signal", tb.SFREQ, max_channels=4), 9)


def crop(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.col("vec_id") % 7) * 0.05
    # Past the end for some vectors, and on half samples for others.
    end = start + 0.3 + (F.col("vec_id") % 5) * 0.1171875
    part = features.crop_samples(F.col("x"), start, end, F.lit(tb.SFREQ))
    return _vectors(spark, sf).select("vec_id", part.alias("part")).select(
        "vec_id",
        F.size("part").alias("n_samples"),
        r(F.col("part")[0].cast("double"), 9).alias("first"),
        r(F.aggregate("part", F.lit(0.0), lambda t, v: t + v), 9).alias("total"),
    )


# --- files ---------------------------------------------------------------------------


def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return build_manifest(spark, files.recording_tree(spark, sf)).drop("path")


def stored_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "manifest")
    sinks.save_parquet(build_manifest(spark, files.recording_tree(spark, sf)), path)
    return load_manifest(spark, path).drop("path")


def file_entities(spark: SparkSession, sf: str) -> DataFrame:
    found = recording_entities(spark, files.recording_tree(spark, sf))
    return found.select(bids.basename(F.col("path")).alias("filename"), F.explode("entities"))


def _named(df: DataFrame) -> DataFrame:
    """The file name instead of the full path, which differs from run to run."""
    rest = [c for c in df.columns if c != "path"]
    return df.select(bids.basename(F.col("path")).alias("filename"), *rest)


def edf_headers(spark: SparkSession, sf: str) -> DataFrame:
    edf.register(spark)
    found = spark.read.format("edf_header").load(files.recording_tree(spark, sf))
    return _named(found).select(
        "filename", "n_channels", "sfreq", "n_samples", "duration_sec",
        F.array_join("channel_names", ",").alias("channel_names"),
    )


def edf_samples(spark: SparkSession, sf: str) -> DataFrame:
    edf.register(spark)
    rows = spark.read.format("edf").option("secondsPerRow", 1).load(files.recording_tree(spark, sf))
    return _named(rows).select(
        "filename",
        "channel",
        "start_sec",
        F.size("samples").alias("n_samples"),
        r(timedomain.compute_rms(F.col("samples")), 9).alias("rms"),
        r(timedomain.compute_mean(F.col("samples")), 9).alias("mean"),
    )


def edf_stretch(spark: SparkSession, sf: str) -> DataFrame:
    """Two channels of seconds 2 to 6 of the first subject's recordings; no other file is opened."""
    root = files.recording_tree(spark, sf)
    first = list_recordings(spark, root).where(F.col("path").contains("/sub-00/"))
    paths = [r["path"] for r in first.collect()]  # names that the caller asks for
    rows = edf.read_samples(spark, root, paths, 2.5, 6.0, [1, 3], 1)
    total = F.aggregate("samples", F.lit(0.0), lambda t, v: t + v)
    return _named(rows).select("filename", "channel", "start_sec", F.size("samples").alias("n_samples"), r(total, 9).alias("total"))


def events_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return _annotations(read_events(spark, files.recording_tree(spark, sf)))


def _annotations(rows: DataFrame) -> DataFrame:
    return _named(rows).select(
        "filename",
        F.col("onset").cast("double").alias("onset"),
        F.col("duration").cast("double").alias("duration"),
        F.col("eventType").alias("event_type"),
    )


def tsv_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return _named(read_seizure_intervals(spark, files.recording_tree(spark, sf)))


def annotations_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten annotations of the first recording."""
    root = files.recording_tree(spark, sf)
    first = list_recordings(spark, root).agg(F.min("path").alias("path")).where("path IS NOT NULL")
    return _annotations(read_paths(first.select(bids.events_path(F.col("path")).alias("path")))).orderBy("onset").limit(10)


def _file_segments(spark: SparkSession, sf: str) -> DataFrame:
    manifest = build_manifest(spark, files.recording_tree(spark, sf))
    return build_segments_dataset(spark, manifest, FILE_WINDOWS)


def file_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _named(_file_segments(spark, sf))


def file_features(relative: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = shared_dir(spark, "segments")
        sinks.save_segments_dataset(_file_segments(spark, sf), path)
        found = build_features_dataset(spark, load_segments(spark, path), relative, None, files.CHANNELS)
        return rounded(_named(found), 9)

    return run


def feature_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Features written as one numbered file per recording, every column read back."""
    folder = shared_dir(spark, "parts")
    found = build_features_dataset(spark, _file_segments(spark, sf), False, None, files.CHANNELS)
    sinks.save_feature_parts(found, folder)
    back = sinks.load_feature_parts(spark, folder, schema=found.schema)
    part = F.col("_metadata.file_name").alias("part")
    place = F.col("_metadata.row_index").alias("row")
    return rounded(_named(back.select(part, place, *back.columns)), 9)


def stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features saved as one table, every column read back."""
    path = shared_dir(spark, "features")
    found = build_features_dataset(spark, _file_segments(spark, sf), False, None, files.CHANNELS)
    sinks.save_features_dataset(found, path)
    return rounded(_named(spark.read.parquet(path)), 9)


def stored_segments(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "segments")
    sinks.save_segments_dataset(segments_dataset(spark, sf), path)
    return load_segments(spark, path)


def _inspected(spark: SparkSession, sf: str) -> str:
    """Audit the stored segments into a report folder."""
    folder = shared_dir(spark, "report")
    config = inspection.InspectionConfig(_segments_path(spark, sf), folder)
    result = inspection.inspect(load_dataset(spark, config.input_path), config)
    inspection.save(spark, result, config)
    result.summary.unpersist()
    return folder


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON summary, read back value by value; only the input's path, which differs, is left out."""
    numbers = "map<string,double>"
    schema = (
        "metadata struct<n_rows_dataset: bigint, columns: array<string>, recording_column_used: string>, "
        f"global_summary {numbers}, distribution_stats map<string,{numbers}>, concentration {numbers}, "
        "risk_flags map<string,string>"
    )
    text = spark.read.text(f"{_inspected(spark, sf)}/inspection_summary.json", wholetext=True)
    report = text.select(F.from_json("value", schema).alias("j")).select("j.*")
    none = F.lit(None).cast("string").alias("text")
    parts = [report.select(F.lit(b).alias("block"), F.explode(b).alias("name", "value")) for b in ("global_summary", "concentration")]
    stats = report.select(F.explode("distribution_stats").alias("block", "stats"))
    parts.append(stats.select("block", F.explode("stats").alias("name", "value")))
    values = reduce(DataFrame.unionByName, parts).select("block", "name", none, r("value").alias("value"))
    meta = F.create_map(
        F.lit("columns"), F.array_join("metadata.columns", ","), F.lit("recording_column_used"), F.col("metadata.recording_column_used"),
        F.lit("n_rows_dataset"), F.col("metadata.n_rows_dataset").cast("string"),
    )
    texts = report.select(F.lit("risk_flags").alias("block"), F.explode("risk_flags").alias("name", "text"))
    texts = texts.unionByName(report.select(F.lit("metadata").alias("block"), F.explode(meta).alias("name", "text")))
    return values.unionByName(texts.withColumn("value", F.lit(None).cast("double")))


def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    """All sections of the Markdown report, read back: every bullet and every table cell but the input's path."""
    text = spark.read.text(f"{_inspected(spark, sf)}/inspection_report.md", wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    order = Window.orderBy("at")  # one report, of bounded length
    title = F.when(F.col("line").rlike("^## "), F.regexp_extract("line", r"^## (\d+)\.", 1).cast("int"))
    lines = lines.withColumn("section", F.last(title, True).over(order))
    within = Window.partitionBy("section").orderBy("at")
    block = F.last(F.when(F.col("line").rlike("^### "), F.substring("line", 5, 1000)), True).over(within)
    lines = lines.withColumn("block", block)
    bullet = r"^- (?:\*\*)?([A-Za-z0-9_ ]+?)(?:\*\*)?: (.*)$"
    bullets = lines.where(F.col("line").rlike(bullet)).select(
        "section", "block", F.lit(0).alias("row"),
        F.regexp_extract("line", bullet, 1).alias("name"), F.regexp_extract("line", bullet, 2).alias("cell"),
    )
    cells = F.transform(F.split(F.expr("trim(BOTH '|' FROM line)"), "\\|"), lambda cell: F.trim(cell))
    rows = lines.where("line LIKE '|%' AND line NOT LIKE '|:-%' AND line NOT LIKE '|--%'").withColumn("cells", cells)
    rows = rows.withColumn("row", F.row_number().over(within) - 1).withColumn("names", F.first("cells").over(within))
    rows = rows.where("row > 0").select("section", "block", "row", F.explode(F.arrays_zip("names", "cells")).alias("c"))
    found = bullets.unionByName(rows.select("section", "block", "row", F.col("c.names").alias("name"), F.col("c.cells").alias("cell")))
    number = F.expr("try_cast(cell AS DOUBLE)")
    return found.where("name <> 'Dataset'").select(
        "section", "block", "row", "name", F.when(number.isNull(), F.col("cell")).alias("text"), r(number).alias("value")
    )


def checksums(spark: SparkSession, sf: str) -> DataFrame:
    found = dataset_root.file_checksums(spark, files.recording_tree(spark, sf), "*_events.tsv")
    return _named(found)


def csv_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The subject summary through its one CSV file: all columns and the place of each line."""
    path = shared_dir(spark, "summary") + ".csv"
    sinks.save_csv(audit.sort_summary(_event_summary(spark, sf)), path)
    lines = spark.read.schema(
        "subject string, n_segments bigint, n_positive bigint, n_negative bigint, positive_ratio double, "
        "n_recordings bigint, has_positive string, positive_share_overall double, segment_share_overall double"
    ).csv(path, header=True)
    # a large file has several splits: lines are counted over all of them, in the order of their bytes
    at = [F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")]
    placed = numbered(lines.select("*", *at), [F.col("split"), F.col("at")])
    return rounded(placed.drop("split", "at"))


# --- places of rows ----------------------------------------------------------------


def quoted_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation files whose notes hold line ends and quotes, in ranges far below a file's size."""
    return _annotations(read_events(spark, files.noted_annotations(spark, sf), 4096))


def ordered_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals by file and onset, equal onsets as in the file, with their place in it."""
    events = read_events(spark, files.noted_annotations(spark, sf), 4096)
    found = sort_intervals(extract_seizure_intervals(events, ["path", "position"])).drop("position")
    numbered = _named(found.withColumn("at", F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("filename").orderBy("at")) - 1  # NOTED rows at most
    return rounded(numbered.select("*", place.alias("place")).drop("at"))


def ordered_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a table of several files by first appearance."""
    events = files.ordered_events(spark, sf)
    day = F.concat_ws("-", "event_type", F.dayofmonth("ts")).alias("value")
    found = events.select(day, file_order().alias("order"))
    found = quality.unique_values(found, "value", F.col("order"))
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1  # distinct values only
    return found.select("value", place.alias("place"))


def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The head of a stored table, in file order."""
    return head(files.ordered_events(spark, sf), 25).select("event_id", "user_id", "event_type", "value")


def non_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Feature columns that hold no numbers, with their distinct values."""
    labelled = _wide(spark, sf).join(_vectors(spark, sf).select("vec_id", "label"), "vec_id")
    df = labelled.select("*", (F.col("mean_ch_01") > 0).alias("rising"), F.col("label").cast("string").alias("kind"))
    names = quality.non_numeric_features(df.drop("vec_id"))
    counts = [F.count_distinct(c).alias(c) for c in names]
    return df.agg(*counts).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in names])))


SPARK_QUERIES: dict[str, Query] = {
    "seg_windows": windows(HOURLY),
    "seg_windows_sliding": windows(WindowSpec(7200.0, 1800.0)),
    "seg_windows_gapped": windows(WindowSpec(3600.0, 10800.0)),
    "seg_windows_drifting": windows(WindowSpec(1800.3, 4321.1)),
    "seg_overlap_pairs": overlap_pairs,
    "seg_overlap_long": long_overlap_pairs,
    "seg_total_overlap": total_overlap,
    "seg_ratio": ratio(HOURLY),
    "seg_ratio_sliding": ratio(WindowSpec(7200.0, 1800.0)),
    "assign_label_drop": labels(True),
    "assign_label_keep": labels(False),
    "label_reason_counts": reason_counts,
    "segments_dataset": segments_dataset,
    "limit_segments": first_segments,
    "threshold_study": threshold_study,
    "parse_bids": parse_bids,
    "parse_entities": parse_entities,
    "events_path": events_path,
    "norm_event_type": norm_event_type,
    "is_seizure": is_seizure,
    "coerce_nonneg": coerce_nonneg,
    "extract_intervals": extract_intervals,
    "safe_str": safe_str,
    "channel_names": channel_names,
    "subject_summary": on_summary(audit.sort_summary),
    "subject_summary_common": on_summary(audit.sort_summary, rare=False),
    "subject_summary_documents": document_subjects,
    "global_summary": on_summary(audit.global_summary),
    "distribution_stats": on_summary(audit.distribution_stats),
    "concentration": on_summary(audit.concentration),
    "risk_flags": on_summary(audit.risk_flags),
    "risk_flags_documents": document_flags,
    "topk_positive": on_summary(audit.top_by_positive),
    "topk_segments": on_summary(audit.top_by_segments),
    "topk_zero_positive": on_summary(audit.zero_positive_subjects),
    "value_counts": label_counts,
    "duration_counts": duration_counts,
    "describe": describe_ratio,
    "describe_features": describe_features,
    "null_counts": null_counts,
    "feature_nulls": feature_nulls,
    "unique_values": unique_values,
    "nunique": n_unique,
    "negative_power": negative_power,
    **{f"feat_{name}": time_kernel(name) for name in timedomain.TIME_FEATURES},
    "feat_bandpower_abs": bandpower(False),
    "feat_bandpower_rel": bandpower(True),
    "feat_standard_bands": standard_bands(False),
    "feat_time_channels": time_channels,
    "feat_freq_channels": frequency_channels,
    "feat_all_channels": all_channels,
    "feat_concat_ragged": ragged,
    "crop_samples": crop,
    "src_manifest": file_manifest,
    "src_load_manifest": stored_manifest,
    "src_entities": file_entities,
    "src_edf_header": edf_headers,
    "src_edf_samples": edf_samples,
    "src_events_tsv": events_tsv,
    "src_intervals": tsv_intervals,
    "src_annotations": annotations_head,
    "segments_from_files": file_segments,
    "features_from_files": file_features(False),
    "features_from_files_relative": file_features(True),
    "sink_feature_parts": feature_parts,
    "sink_features": stored_features,
    "sink_segments": stored_segments,
    "sink_csv": csv_summary,
    "sink_json": json_report,
    "sink_markdown": markdown_report,
    "src_checksums": checksums,
    "validate_dataset": validated_labels,
    "src_edf_stretch": edf_stretch,
    "src_events_quoted": quoted_annotations,
    "sort_intervals": ordered_intervals,
    "unique_values_ordered": ordered_values,
    "preview_head": first_rows,
    "agg_non_numeric": non_numeric,
}
