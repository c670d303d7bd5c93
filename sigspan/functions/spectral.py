"""Welch band power, batched in Arrow.

Spark SQL has no Fourier transform. Each Arrow batch is stacked into one matrix
and transformed at once; one spectrum serves all bands.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F

from sigspan.errors import FrequencyFeatureError

# Band edges in Hz, lower bound included, upper excluded.
STANDARD_BANDS: dict[str, tuple[float, float]] = {
    "delta_power": (0.5, 4.0),
    "theta_power": (4.0, 8.0),
    "alpha_power": (8.0, 13.0),
    "beta_power": (13.0, 30.0),
}

# Samples transformed at a time, to bound the memory of a Python worker.
CHUNK_SAMPLES = 1 << 19


def check_bands(sfreq: float, bands: Sequence[tuple[float, float]]) -> float:
    if not sfreq > 0:
        raise FrequencyFeatureError(f"The sampling rate is not positive: {sfreq}")
    for fmin, fmax in bands:
        if fmin < 0 or fmax <= fmin:
            raise FrequencyFeatureError(f"Not a frequency band: {fmin} to {fmax}")
        if fmax > sfreq / 2:
            raise FrequencyFeatureError(f"The band edge {fmax} lies above half the sampling rate, {sfreq / 2}")
    return float(sfreq)


def welch_psd(signals: np.ndarray, sfreq: float) -> tuple[np.ndarray, np.ndarray]:
    """Averaged one-sided periodograms along the last axis (Welch 1967).

    Segments of two seconds (or the whole signal) with a periodic Hann taper,
    half overlap, mean removed; a trailing partial segment is not used.
    """
    length = min(signals.shape[-1], int(sfreq * 2))
    if length < 2:
        raise FrequencyFeatureError("Too few samples for a Welch estimate.")
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    pieces = sliding_window_view(signals, length, axis=-1)[..., :: length - length // 2, :]
    spectrum = np.fft.rfft((pieces - pieces.mean(axis=-1, keepdims=True)) * taper)
    power = (spectrum.real**2 + spectrum.imag**2).mean(axis=-2)
    power /= sfreq * np.square(taper).sum()
    # Both signs of a frequency fold into one bin, except at zero and Nyquist.
    power[..., 1 : (length + 1) // 2] *= 2
    return np.arange(length // 2 + 1) * sfreq / length, power


def band_powers(
    signals: np.ndarray, sfreq: float, bands: Sequence[tuple[float, float]], relative: bool
) -> np.ndarray:
    """Integrated power per band, shape ``signals.shape[:-1] + (len(bands),)``.

    The trapezoid rule runs over a band's own bins; fewer than two bins give 0.
    """
    freqs, power = welch_psd(signals, sfreq)
    masks = [(freqs >= low) & (freqs < high) for low, high in bands]
    out = np.stack([np.trapezoid(power[..., m], freqs[m], axis=-1) for m in masks], axis=-1)
    if relative:
        total = np.trapezoid(power, freqs, axis=-1)[..., None]
        out = np.divide(out, total, out=np.zeros_like(out), where=total > 0)
    return out


def time_features(signals: np.ndarray) -> np.ndarray:
    """Mean, population std, rms and line length along the last axis."""
    return np.stack(
        [
            signals.mean(axis=-1),
            signals.std(axis=-1),
            np.sqrt(np.square(signals).mean(axis=-1)),
            np.abs(np.diff(signals, axis=-1)).sum(axis=-1),
        ],
        axis=-1,
    )


def by_length(column: pa.Array, width: int, kernel) -> np.ndarray:
    """Apply ``kernel`` to equally long signals of a list column, chunk by chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise FrequencyFeatureError("A signal has no samples.")
    offsets = column.offsets.to_numpy()
    if column.flatten().null_count:
        raise FrequencyFeatureError("A signal has a missing sample.")
    samples = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.empty((len(column), width))
    for length in np.unique(lengths):
        if length == 0:
            raise FrequencyFeatureError("A signal has no samples.")
        rows = np.flatnonzero(lengths == length)
        step = max(1, CHUNK_SAMPLES // int(length))
        for at in range(0, rows.size, step):
            part = rows[at : at + step]
            if part.size == part[-1] - part[0] + 1:
                # Neighbouring signals of one length are a matrix already.
                block = samples[offsets[part[0]] : offsets[part[-1] + 1]].reshape(-1, length)
            else:
                block = samples[offsets[part][:, None] + np.arange(length)]
            out[part] = kernel(block.astype(np.float64, copy=False))
    return out


def compute_bandpower(
    signal: Column, sfreq: float, fmin: float, fmax: float, relative: bool = False
) -> Column:
    """Power of one band per signal."""
    sfreq = check_bands(sfreq, [(fmin, fmax)])

    @F.arrow_udf("double")
    def power(column: pa.Array) -> pa.Array:
        kernel = lambda x: band_powers(x, sfreq, [(fmin, fmax)], relative)
        return pa.array(by_length(column, 1, kernel)[:, 0])

    return power(signal)


def compute_standard_bandpowers(signal: Column, sfreq: float, relative: bool = False) -> Column:
    """Struct of the four standard bands, from one spectrum per signal."""
    bands = list(STANDARD_BANDS.values())
    names = list(STANDARD_BANDS)
    sfreq = check_bands(sfreq, bands)

    @F.arrow_udf(", ".join(f"{name} double" for name in names))
    def powers(column: pa.Array) -> pa.Array:
        values = by_length(column, len(bands), lambda x: band_powers(x, sfreq, bands, relative))
        return pa.StructArray.from_arrays([pa.array(v) for v in values.T], names)

    return powers(signal)
