import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sigspan.errors import (
    FeatureComputationError,
    FeatureDatasetBuilderError,
    FeatureExtractionError,
    FrequencyFeatureError,
    stage_errors,
)
from sigspan.functions import spectral
from sigspan.functions import timedomain as td
from sigspan.operators import features as fx


def one(spark, signal, function, kind="array<double>"):
    df = spark.createDataFrame([(signal,)], f"x {kind}")
    with stage_errors():
        return df.select(function(F.col("x")).alias("v")).first().v


def sine(freq, sfreq, seconds, amplitude=1.0):
    t = np.arange(int(sfreq * seconds)) / sfreq
    return (amplitude * np.sin(2 * np.pi * freq * t)).tolist()


def slow_psd(x, fs, nperseg):
    """Welch by the defining sums, one frequency at a time."""
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / nperseg) for i in range(nperseg)]
    starts = range(0, len(x) - nperseg + 1, nperseg - nperseg // 2)
    psd = []
    for k in range(nperseg // 2 + 1):
        total = 0.0
        for s in starts:
            seg = np.array(x[s : s + nperseg])
            seg = (seg - seg.mean()) * w
            angle = 2 * np.pi * k * np.arange(nperseg) / nperseg
            total += (seg @ np.cos(angle)) ** 2 + (seg @ np.sin(angle)) ** 2
        p = total / len(starts) / (fs * sum(v * v for v in w))
        psd.append(p if k == 0 or 2 * k == nperseg else 2 * p)
    return psd


def test_time_kernels(spark):
    assert one(spark, [1.0, 2.0, 3.0], td.compute_mean) == 2.0
    assert one(spark, [1.0, 2.0, 3.0], td.compute_std) == pytest.approx(np.std([1, 2, 3]))
    assert one(spark, [3.0, 4.0], td.compute_rms) == pytest.approx(math.sqrt(12.5))
    assert one(spark, [1.0, 3.0, 2.0, 5.0], td.compute_line_length) == 6.0
    assert one(spark, [7.0], td.compute_line_length) == 0.0
    assert one(spark, [1e8 + 1, 1e8 + 2, 1e8 + 3], td.compute_std) == pytest.approx(np.std([1, 2, 3]))


@pytest.mark.parametrize("kernel", td.TIME_FEATURES.values())
@pytest.mark.parametrize("signal", [[], None])
def test_empty_signal(spark, kernel, signal):
    with pytest.raises(FeatureComputationError):
        one(spark, signal, kernel)


def test_two_dimensional_signal_is_refused(spark):
    with pytest.raises(AnalysisException, match="coalesce|cast"):
        one(spark, [[1.0]], td.compute_mean, "array<array<double>>")


def test_alpha_of_a_unit_sine(spark):
    for sfreq, seconds in ((100.0, 2), (256.0, 5)):
        x = sine(10.0, sfreq, seconds)
        alpha = one(spark, x, lambda c: spectral.compute_bandpower(c, sfreq, 8.0, 13.0))
        delta = one(spark, x, lambda c: spectral.compute_bandpower(c, sfreq, 0.5, 4.0))
        share = one(spark, x, lambda c: spectral.compute_bandpower(c, sfreq, 8.0, 13.0, True))
        assert alpha == pytest.approx(0.5) and alpha > delta >= 0
        assert share == pytest.approx(1.0)


@pytest.mark.parametrize("n, sfreq", [(64, 64.0), (16, 64.0), (640, 64.0), (333, 100.0), (129, 65.5)])
def test_welch_matches_the_definition(n, sfreq):
    x = np.random.default_rng(n).normal(size=n)
    freqs, psd = spectral.welch_psd(x, sfreq)
    nperseg = min(n, int(2 * sfreq))
    assert psd == pytest.approx(slow_psd(x, sfreq, nperseg), rel=1e-9, abs=1e-15)
    assert freqs == pytest.approx(np.fft.rfftfreq(nperseg, 1 / sfreq))


def test_standard_bands(spark):
    row = one(spark, sine(10.0, 100.0, 2), lambda c: spectral.compute_standard_bandpowers(c, 100.0))
    assert row.__fields__ == ["delta_power", "theta_power", "alpha_power", "beta_power"]
    assert row.alpha_power == max(row)


def test_mixed_lengths_in_one_batch(spark):
    rows = [(i, np.random.default_rng(i).normal(size=40 + 30 * (i % 4)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, x array<double>").coalesce(1)
    got = df.select("i", spectral.compute_bandpower(F.col("x"), 64.0, 8.0, 13.0).alias("p")).collect()
    for r in got:
        want = spectral.band_powers(np.array(rows[r.i][1]), 64.0, [(8.0, 13.0)], False)[0]
        assert r.p == pytest.approx(want)


def test_constant_signal_and_empty_band(spark):
    flat = [2.0] * 128
    assert one(spark, flat, lambda c: spectral.compute_bandpower(c, 64.0, 8.0, 13.0, True)) == 0.0
    short = sine(10.0, 64.0, 0.25)
    assert one(spark, short, lambda c: spectral.compute_bandpower(c, 64.0, 0.5, 4.0)) == 0.0


@pytest.mark.parametrize(
    "sfreq, low, high", [(0.0, 8, 13), (-1.0, 8, 13), (100.0, 13, 8), (100.0, -1, 8), (50.0, 13, 30)]
)
def test_band_errors(sfreq, low, high):
    with pytest.raises(FrequencyFeatureError):
        spectral.compute_bandpower(F.array(), sfreq, low, high)


@pytest.mark.parametrize("signal", [[1.0], [], None])
def test_signal_errors_in_the_worker(spark, signal):
    with pytest.raises(FrequencyFeatureError):
        one(spark, signal, lambda c: spectral.compute_bandpower(c, 100.0, 8.0, 13.0))


def matrix(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "i int, x array<array<double>>")


def test_time_features_per_channel(spark):
    df = matrix(spark, [[[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]])
    out = fx.extract_time_domain_features(df, "x", max_channels=2)
    assert out.columns[1:] == [
        f"{stem}_ch_{c}" for c in ("01", "02") for stem in ("mean", "std", "rms", "line_length")
    ]
    row = out.first()
    assert (row.mean_ch_01, row.mean_ch_02, row.line_length_ch_02) == (2.0, 5.0, 2.0)


def test_all_features_per_channel(spark):
    signal = [sine(10.0, 100.0, 2), sine(5.0, 100.0, 2)]
    out = fx.extract_all_features(matrix(spark, [signal]), "x", 100.0, channel_names=["Fz", "Cz"])
    assert len(out.columns) == 1 + 16 and out.columns[1] == "mean_Fz"
    assert out.columns[9:13] == [f"{b}_power_Fz" for b in ("delta", "theta", "alpha", "beta")]
    row = out.first()
    assert row.alpha_power_Fz == pytest.approx(0.5) and row.theta_power_Cz == pytest.approx(0.5)
    only = fx.extract_frequency_domain_features(matrix(spark, [signal]), "x", 100.0, max_channels=2)
    assert only.first().alpha_power_ch_01 == row.alpha_power_Fz and len(only.columns) == 9


def test_features_equal_the_native_kernels(spark):
    rng = np.random.default_rng(5)
    df = matrix(spark, [rng.normal(size=(3, 200)).tolist() for _ in range(7)])
    wide = {r.i: r for r in fx.extract_all_features(df, "x", 100.0, max_channels=3).collect()}
    native = df.select(
        "i", F.posexplode("x").alias("c", "s")
    ).select("i", "c", *[f(F.col("s")).alias(n) for n, f in td.TIME_FEATURES.items()])
    for r in native.collect():
        for name in td.TIME_FEATURES:
            assert wide[r.i][f"{name}_ch_{r.c + 1:02d}"] == pytest.approx(r[name], rel=1e-9)


def test_ragged_rows_leave_nulls(spark):
    df = matrix(spark, [[[1.0, 2.0]], [[1.0, 2.0], [3.0, 5.0]]])
    rows = fx.extract_time_domain_features(df, "x", max_channels=2).orderBy("i").collect()
    assert rows[0].mean_ch_02 is None and rows[1].line_length_ch_02 == 2.0


def test_channel_names():
    names = fx.default_channel_names(103)
    assert (names[0], names[99], names[102]) == ("ch_01", "ch_100", "ch_103")


@pytest.mark.parametrize("signal", [[[1.0, 2.0]], [[1.0, 2.0], [3.0]], [[]], [], None])
def test_bad_matrices(spark, signal):
    with pytest.raises(FeatureExtractionError), stage_errors():
        fx.extract_time_domain_features(matrix(spark, [signal]), "x", ["a", "b"]).collect()


def test_bad_extraction_calls(spark):
    df = matrix(spark, [[[1.0]]])
    for names in ([], ["a", "a"]):
        with pytest.raises(FeatureExtractionError):
            fx.extract_time_domain_features(df, "x", names)
    with pytest.raises(FeatureExtractionError, match="2D"):
        fx.extract_time_domain_features(df.selectExpr("x[0] AS x"), "x", ["a"])


def test_crop_rounds_half_to_even(spark):
    df = spark.createDataFrame([(list(map(float, range(10))),)], "x array<double>")

    def crop(start, end, sfreq=1.0):
        column = fx.crop_samples(F.col("x"), *[F.lit(v) for v in (start, end, sfreq)])
        with stage_errors():
            return df.select(column.alias("v")).first().v

    assert crop(0.5, 2.5) == [0.0, 1.0] and crop(1.5, 3.5) == [2.0, 3.0]
    assert crop(8.0, 12.0) == [8.0, 9.0]
    for bounds in ((2.0, 2.0), (3.0, 2.0), (0.1, 0.2)):
        with pytest.raises(FeatureDatasetBuilderError):
            crop(*bounds)
