import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspan.errors import LabelingError, SegmentationError, stage_errors
from sigspan.functions.labeling import assign_label
from sigspan.functions.windows import WindowSpec, accumulated_pieces, overlap_ratio, overlap_seconds, window_start
from sigspan.operators import segmentation as sg

RECORDING = "subject string, session string, run string, path string, recording_duration_sec double"
INTERVAL = "path string, onset_sec double, end_sec double"


def recordings(spark, durations):
    rows = [(f"s{p}", None, "0", p, d) for p, d in durations.items()]
    return spark.createDataFrame(rows, RECORDING)


def scalar(spark, column):
    with stage_errors():
        return spark.range(1).select(column.alias("v")).first().v


def windows(spark, duration, size, stride):
    df = sg.generate_time_windows(recordings(spark, {"p": duration}), WindowSpec(size, stride))
    return sorted((r.start_sec, r.end_sec) for r in df.collect())


def by_repeated_addition(duration, size, stride):
    out, start = [], 0.0
    while duration >= size and start + size <= duration:
        out.append((start, start + size))
        start += stride
    return out


def test_only_complete_windows(spark):
    assert windows(spark, 12.0, 5.0, 5.0) == [(0, 5), (5, 10)]
    assert windows(spark, 4.0, 5.0, 5.0) == []
    assert windows(spark, 0.0, 5.0, 5.0) == []


@pytest.mark.parametrize(
    "duration, size, stride",
    [(10.0, 1.0, 0.1), (20.0, 5.0, 2.5), (100.0, 5.0, 8.0), (15.0, 5.0, 5.0), (14.999, 5.0, 5.0),
     (3000.0, 2.0, 1.0), (2000.0, 0.3, 0.1), (700.0, 0.7, 1.3)],
)
def test_starts_equal_repeated_addition(spark, duration, size, stride):
    assert windows(spark, duration, size, stride) == by_repeated_addition(duration, size, stride)


@pytest.mark.parametrize("size, stride", [(0.0, 5.0), (5.0, 0.0), (-1.0, 5.0)])
def test_bad_window_parameters(size, stride):
    with pytest.raises(SegmentationError):
        WindowSpec(size, stride)


@pytest.mark.parametrize("duration", [-1.0, None, float("inf")])
def test_bad_duration(spark, duration):
    with pytest.raises(SegmentationError), stage_errors():
        windows(spark, duration, 5.0, 5.0)


@pytest.mark.parametrize(
    "ws, we, onset, end, want",
    [(10, 15, 12, 18, 3.0), (0, 5, 6, 8, 0.0), (0, 5, 5, 8, 0.0), (0, 5, None, None, 5.0),
     (0, 5, 3, None, 2.0), (0, 5, 1, 2, 1.0)],
)
def test_overlap_seconds(spark, ws, we, onset, end, want):
    args = [F.lit(v).cast("double") for v in (ws, we, onset, end)]
    assert scalar(spark, overlap_seconds(*args)) == want


@pytest.mark.parametrize("bounds", [(5, 0, 1, 2), (0, 5, 2, 1)])
def test_reversed_bounds(spark, bounds):
    with pytest.raises(SegmentationError):
        scalar(spark, overlap_seconds(*[F.lit(float(v)) for v in bounds]))


def test_overlap_ratio(spark):
    assert scalar(spark, overlap_ratio(F.lit(2.5), F.lit(5.0))) == 0.5
    for bad in (-0.1, 5.1):
        with pytest.raises(SegmentationError):
            scalar(spark, overlap_ratio(F.lit(bad), F.lit(5.0)))


@pytest.mark.parametrize(
    "ratio, drop, want",
    [
        (0.7, True, (1, True, "positive_overlap_threshold_reached")),
        (0.5, True, (1, True, "positive_overlap_threshold_reached")),
        (0.0, True, (0, True, "no_overlap")),
        (0.2, True, (None, False, "partial_overlap_dropped")),
        (0.2, False, (0, True, "partial_overlap_assigned_negative")),
    ],
)
def test_assign_label(spark, ratio, drop, want):
    assert tuple(scalar(spark, assign_label(F.lit(ratio), 0.5, drop))) == want


def test_label_errors(spark):
    with pytest.raises(LabelingError):
        scalar(spark, assign_label(F.lit(1.2)))
    for threshold in (0.0, 1.1):
        with pytest.raises(LabelingError):
            assign_label(F.lit(0.5), threshold)


def brute_force(durations, intervals, spec):
    out = {}
    for path, duration in durations.items():
        for start, end in by_repeated_addition(duration, spec.window_size_sec, spec.stride_sec):
            total = 0.0
            for p, onset, stop in intervals:
                if p == path:
                    lo = start if onset is None else max(start, onset)
                    hi = end if stop is None else min(end, stop)
                    total += max(0.0, hi - lo)
            out[path, start] = total / (end - start)
    return out


@pytest.mark.parametrize(
    "size, stride", [(5.0, 5.0), (4.0, 1.0), (2.0, 7.5), (0.5, 0.1), (0.3, 0.7)]
)
def test_ratios_match_brute_force(spark, size, stride):
    rng = random.Random(11)
    durations = {"a": 400.0, "b": 7.0, "c": 3.0, "d": 1500.5, "quiet": 50.0}
    intervals = []
    for path in ("a", "b", "d", "elsewhere"):
        at = 0.0
        for _ in range(40):
            onset = at + rng.choice([0.0, rng.uniform(0, 20), 0.25])
            at = onset + rng.choice([0.0, rng.uniform(0, 9), 2.5])
            intervals.append((path, onset, at))
    intervals.append(("c", None, None))
    intervals.append(("quiet", 30.0, None))
    intervals.append(("d", 1600.0, float("inf")))
    spec = WindowSpec(size, stride)
    df = sg.windows_with_ratio(
        recordings(spark, durations), spark.createDataFrame(intervals, INTERVAL), spec
    )
    rows = df.collect()
    got = {(r.path, r.start_sec): r.overlap_ratio for r in rows}
    want = brute_force(durations, intervals, spec)
    assert len(rows) == len(got) and got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-9), key


def test_pairs_do_not_depend_on_the_length(spark):
    """Four windows exist, whatever the interval runs on to; an unknown recording has none."""
    for end in (100.0, 1281.0, 1e12, float("inf"), None):
        for start in (0.0, None):
            intervals = spark.createDataFrame([("p", start, end), ("gone", start, end)], INTERVAL)
            pairs = sg.window_overlaps(intervals, recordings(spark, {"p": 20.0}), WindowSpec()).collect()
            assert sorted((r.path, r.start_sec) for r in pairs) == [("p", 5.0 * k) for k in range(4)]


def test_double_counted_overlap_fails(spark):
    intervals = spark.createDataFrame([("p", 0.0, 5.0), ("p", 1.0, 4.0)], INTERVAL)
    with pytest.raises(SegmentationError, match="exceeds"), stage_errors():
        sg.segments(recordings(spark, {"p": 10.0}), intervals, WindowSpec()).collect()


def test_double_count_past_the_recording_is_harmless(spark):
    intervals = spark.createDataFrame([("p", 20.0, 25.0), ("p", 20.0, 25.0)], INTERVAL)
    got = sg.segments(recordings(spark, {"p": 10.0}), intervals, WindowSpec()).collect()
    assert [r.label for r in got] == [0, 0]


def test_segments_table(spark):
    intervals = spark.createDataFrame([("p", 4.0, 12.0)], INTERVAL)
    rec = recordings(spark, {"p": 21.0, "q": 5.0})
    got = sg.sort_segments(sg.segments(rec, intervals, WindowSpec())).collect()
    assert got[0].__fields__ == [
        "subject", "session", "run", "path", "recording_duration_sec", "start_sec", "end_sec",
        "window_size_sec", "stride_sec", "overlap_ratio", "label",
    ]
    assert [(r.path, r.start_sec, r.label, r.overlap_ratio) for r in got] == [
        ("p", 5.0, 1, 1.0), ("p", 15.0, 0, 0.0), ("q", 0.0, 0, 0.0),
    ]
    keep = WindowSpec(drop_partial_overlap=False)
    got = sg.sort_segments(sg.segments(rec, intervals, keep)).collect()
    assert [r.label for r in got] == [0, 1, 0, 0, 0]


def test_empty_inputs_keep_the_schema(spark):
    none = spark.createDataFrame([], INTERVAL)
    rec = recordings(spark, {"p": 12.0})
    assert sg.segments(rec, none, WindowSpec()).count() == 2
    empty = sg.segments(rec.where("false"), none, WindowSpec())
    assert empty.count() == 0 and len(empty.columns) == 11


def test_window_rows_are_not_shuffled(spark):
    """Only blocks and touched windows move; no nested loop, no per-recording join."""
    intervals = spark.createDataFrame([("p", 4.0, 12.0)], INTERVAL)
    df = sg.segments(recordings(spark, {"p": 1e6}), intervals, WindowSpec())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    after_windows = plan.split("Generate explode(sequence(")[0]
    assert "Exchange" not in after_windows
    assert df.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("ordered", [False, True])
def test_a_dominant_recording_is_spread(spark, ordered):
    """One recording with almost all windows and intervals fills every partition."""
    rec = recordings(spark, {"hot": 400_000.0, "cold": 60.0})
    rows = spark.range(0, 40_000).selectExpr(
        "'hot' AS path", "CAST(id * 10 AS DOUBLE) AS onset_sec", "CAST(id * 10 + 4 AS DOUBLE) AS end_sec"
    )
    df = sg.segments(rec, rows, WindowSpec(), ordered=ordered)
    sizes = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 80_012 and len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)
    if ordered:
        got = [(r.path, r.start_sec) for r in df.select("path", "start_sec").collect()]
        assert got == sorted(got)


@pytest.mark.parametrize("stride", [0.1, 0.3, 1 / 3, 4321.1, 7.7, 1 + 2**-52, 74715249908.23267, 3 * 2.0**-40, 1e-300])
def test_repeated_addition_in_closed_form(spark, stride):
    """Bit for bit what adding gives, also where additions round to even."""
    pieces = np.array(accumulated_pieces(stride))
    k = np.arange(300_001)
    at = np.searchsorted(pieces[:, 0], k, "right") - 1
    want = np.cumsum(np.r_[0.0, np.full(300_000, stride)])
    assert (pieces[at, 1] + (k - pieces[at, 0]) * pieces[at, 2] == want).all()
    spec = WindowSpec(1.0, stride)
    if not spec.exact_grid:
        ks = spark.range(0, 300_001, 997)
        got = [r.s for r in ks.select("id", window_start(F.col("id"), spec).alias("s")).orderBy("id").collect()]
        assert got == want[::997].tolist()


def test_repeated_addition_far_on():
    pieces, at, k = np.array(accumulated_pieces(0.1)), 0.0, 0
    while k < 10**8:
        run = np.cumsum(np.r_[at, np.full(10**7, 0.1)])
        ks = np.arange(k, k + 10**7 + 1)
        piece = np.searchsorted(pieces[:, 0], ks, "right") - 1
        assert (pieces[piece, 1] + (ks - pieces[piece, 0]) * pieces[piece, 2] == run).all()
        at, k = run[-1], k + 10**7


def test_drifting_windows_need_no_python(spark):
    plan = sg.generate_time_windows(spark.createDataFrame([("a", 50.0)], "path string, recording_duration_sec double"), WindowSpec(1.0, 0.1))
    assert "ArrowEval" not in plan._jdf.queryExecution().toString() and plan.count() == 491
