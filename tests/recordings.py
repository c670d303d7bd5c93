"""Writes small EDF recordings and annotation files for the tests."""

import numpy as np


def edf_bytes(channels, sfreq, record_sec=1.0, labels=None, units="uV", limit=1000.0, reserved="", n_records=None):
    """A 16-bit EDF file; channels are in the given physical unit."""
    channels = [np.asarray(c, dtype=float) for c in channels]
    per_record = int(round(sfreq * record_sec))
    records = len(channels[0]) // per_record
    ns = len(channels)
    labels = labels or [f"EEG {i}" for i in range(ns)]

    def text(value, width):
        return str(value).ljust(width)[:width].encode("ascii")

    head = b"".join(
        [
            text("0", 8), text("X", 80), text("X", 80), text("01.01.24", 8), text("00.00.00", 8),
            text(256 * (ns + 1), 8), text(reserved, 44),
            text(records if n_records is None else n_records, 8), text(f"{record_sec:g}", 8),
            text(ns, 4),
        ]
    )
    columns = [
        (labels, 16), ([""] * ns, 80), ([units] * ns, 8), ([-limit] * ns, 8), ([limit] * ns, 8),
        ([-32768] * ns, 8), ([32767] * ns, 8), ([""] * ns, 80), ([per_record] * ns, 8),
        ([""] * ns, 32),
    ]
    table = b"".join(text(v, w) for values, w in columns for v in values)
    step = 2 * limit / 65535
    digital = [np.clip(np.rint((c + limit) / step - 32768), -32768, 32767) for c in channels]
    data = np.stack([d.reshape(records, per_record) for d in digital], axis=1)
    return head + table + data.astype("<i2").tobytes()


def quantised(channel, limit=1000.0, scale=1e-6):
    """What a reader should return for a channel written above."""
    step = 2 * limit / 65535
    digital = np.clip(np.rint((np.asarray(channel) + limit) / step - 32768), -32768, 32767)
    return ((digital + 32768) * step - limit) * scale


def make_tree(root, recordings):
    """``recordings``: {(subject, session, run): (channels, sfreq, events_text)}."""
    paths = {}
    for (sub, ses, run), (channels, sfreq, events) in recordings.items():
        folder = root / f"sub-{sub}" / f"ses-{ses}" / "eeg"
        folder.mkdir(parents=True, exist_ok=True)
        name = f"sub-{sub}_ses-{ses}_task-szMonitoring_run-{run}"
        path = folder / f"{name}_eeg.edf"
        path.write_bytes(edf_bytes(channels, sfreq))
        if events is not None:
            (folder / f"{name}_events.tsv").write_text(events)
        paths[sub, ses, run] = str(path)
    (root / "dataset_description.json").write_text("{}")
    (root / "participants.tsv").write_text("participant_id\n")
    return paths
