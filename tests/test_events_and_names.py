import pytest
from pyspark.sql import functions as F

from sigspan.errors import DatasetBuilderError, EventsFileError, stage_errors
from sigspan.functions import bids
from sigspan.functions.events import coerce_non_negative, is_seizure_event_type, normalize_event_type
from sigspan.operators.intervals import extract_seizure_intervals, sort_intervals
from sigspan.schemas import INTERVALS


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    with stage_errors():
        return [r.o for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_event_type_normalisation(spark):
    raw = [" SZ_foc_A\t", " sz ", None, "", "n/a", "BCKG", "Seizure", "x\x1f"]
    assert column(spark, raw, normalize_event_type) == [
        "sz_foc_a", "sz", "", "", "", "bckg", "seizure", "x",
    ]
    flags = column(spark, raw, lambda c: is_seizure_event_type(normalize_event_type(c)))
    assert flags == [True, True, False, False, False, False, False, False]


def test_numbers(spark):
    raw = ["1", " 2.5 ", "1e3", "1_000", ".5", "+7.", "inf", "-0.0", "n/a", "", None, "NAN"]
    got = column(spark, raw, lambda c: coerce_non_negative(c, "onset"))
    assert got == [1, 2.5, 1000, 1000, 0.5, 7, float("inf"), 0, None, None, None, None]


@pytest.mark.parametrize("text", ["12d", "abc", "1__0", "0x10", "-1", "-inf", "1 2"])
def test_bad_numbers(spark, text):
    with pytest.raises(EventsFileError):
        column(spark, [text], lambda c: coerce_non_negative(c, "onset"))


def test_missing_can_be_an_error(spark):
    with pytest.raises(EventsFileError, match="Missing value for 'duration'"):
        column(spark, ["n/a"], lambda c: coerce_non_negative(c, "duration", "error"))


EVENTS = "path string, onset string, duration string, eventType string"


def test_intervals(spark):
    rows = [
        ("f", "30", "2.5", "sz_gen"),
        ("f", "-5", "junk", "bckg"),
        ("f", "10", "n/a", " SZ"),
        ("f", "n/a", "1", "sz"),
        ("f", "1", "1", None),
    ]
    got = extract_seizure_intervals(spark.createDataFrame(rows, EVENTS), ["path"])
    assert [tuple(r) for r in sort_intervals(got).collect()] == [
        ("f", 10.0, None, None, "sz"),
        ("f", 30.0, 2.5, 32.5, "sz_gen"),
        ("f", None, 1.0, None, "sz"),
    ]
    assert [f.dataType for f in got.schema][1:] == [f.dataType for f in INTERVALS]


def test_intervals_errors(spark):
    with pytest.raises(EventsFileError, match="eventType"):
        extract_seizure_intervals(spark.createDataFrame([("1",)], "onset string"))
    bad = spark.createDataFrame([("f", "-5", "1", "sz")], EVENTS)
    with pytest.raises(EventsFileError, match="Negative"), stage_errors():
        extract_seizure_intervals(bad, ["path"]).collect()


NAMES = [
    "/d/sub-01/sub-01_ses-02_task-szMonitoring_run-00_eeg.edf",
    "sub-a-b_task-x_eeg.edf",
    "sub-1_sub-2_run-_foo_eeg.edf",
    "/d/plain.edf",
]


def test_filename_fields(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "i int, p string")
    parts = bids.name_parts(F.col("p"))
    fields = [*bids.filename_fields(parts), bids.suffix(parts).alias("suffix")]
    got = [tuple(r) for r in df.orderBy("i").select(*fields).collect()]
    assert got == [
        ("sub-01", "ses-02", "szMonitoring", "00", "eeg"),
        ("sub-a-b", None, "x", None, "eeg"),
        ("sub-2", None, None, "", "eeg"),
        (None, None, None, None, "plain"),
    ]


def test_entities(spark):
    got = column(spark, NAMES, bids.entities)
    assert got == [
        {"sub": "01", "ses": "02", "task": "szMonitoring", "run": "00", "suffix": "eeg"},
        {"sub": "a-b", "task": "x", "suffix": "eeg"},
        {"sub": "2", "run": "", "suffix": "eeg"},
        {"suffix": "plain"},
    ]


def test_events_path(spark):
    paths = ["/a_eeg.edf/sub-1_eeg.edf", "x_eeg.edf_eeg.edf", "sub-01_ses-01_task-rec01_01_eeg.edf"]
    assert column(spark, paths, bids.events_path) == [
        "/a_eeg.edf/sub-1_events.tsv", "x_events.tsv_events.tsv",
        "sub-01_ses-01_task-rec01_01_events.tsv",
    ]
    for bad in ("sub-1.edf", None):
        with pytest.raises(DatasetBuilderError):
            column(spark, [bad], bids.events_path)


def test_plain_path(spark):
    assert column(spark, ["file:///a%20b/c+d", "file:/x", "hdfs://h/a%20b"], bids.plain_path) == [
        "/a b/c+d", "/x", "hdfs://h/a b",
    ]
    # Encoded metadata and listed paths give one form on every file system.
    for root in ("file:///", "hdfs://h:1/", "s3a://bucket/"):
        encoded, listed = root + "a%20b/c+d%25%23.tsv", root + "a b/c+d%#.tsv"
        assert column(spark, [encoded], bids.plain_path) == column(spark, [listed], lambda c: bids.plain_path(c, False))
