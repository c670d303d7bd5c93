from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import difference
from pyspark.sql import functions as F
from recordings import edf_bytes, make_tree, quantised

from sigspan.errors import (
    DatasetBuilderError,
    EventsFileError,
    FeatureDatasetBuilderError,
    stage_errors,
)
from sigspan.functions.windows import WindowSpec
from sigspan.operators.intervals import extract_seizure_intervals, sort_intervals
from sigspan.plans.features import build_features_dataset, limit_segments, segment_features
from sigspan.plans.oracles import DUCKDB_SQL, FILES_CTE
from sigspan.plans.queries import SPARK_QUERIES
from sigspan.plans.segments import build_segments_dataset
from sigspan.plans import features as feature_plans
from sigspan.plans import testbed
from sigspan.sinks.tables import load_feature_parts, save_feature_parts, save_segments_dataset
from sigspan.sources import edf, events_tsv, remote
from sigspan.sources.events_tsv import read_events, read_seizure_intervals
from sigspan.sources.manifest import build_manifest, load_manifest, recording_entities
from sigspan.sources.tables import load_segments
from sigspan.functions.spectral import band_powers, time_features, STANDARD_BANDS

RNG = np.random.default_rng(17)
SFREQ = 64


def noise(seconds, channels):
    return RNG.normal(scale=100, size=(channels, seconds * SFREQ))


SIGNALS = {("01", "01", "00"): noise(31, 3), ("01", "02", "00"): noise(12, 2), ("02", "01", "01"): noise(40, 3)}
EVENTS = {
    ("01", "01", "00"): "onset\tduration\teventType\tnote\n7.0\t9.5\tsz_foc_a\tx\n-3\tn/a\tbckg\ty\n",
    ("01", "02", "00"): "duration\teventType \tonset\n12\tbckg\t0\n",
    ("02", "01", "01"): "onset\tduration\teventType\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    # A folder name that looks like an encoded URI.
    root = tmp_path_factory.mktemp("bids tree+50%25")
    paths = make_tree(root, {k: (SIGNALS[k], SFREQ, EVENTS[k]) for k in SIGNALS})
    return root, paths


def test_manifest(spark, tree, tmp_path):
    root, paths = tree
    rows = build_manifest(spark, str(root)).collect()
    assert [r.path for r in rows] == sorted(paths.values())
    assert tuple(rows[0])[:5] == (
        "sub-01", "ses-01", "szMonitoring", "00", rows[0].path.rsplit("/", 1)[1],
    )
    ents = {r.path: r.entities for r in recording_entities(spark, str(root)).collect()}
    assert ents[paths["02", "01", "01"]]["suffix"] == "eeg"
    out = str(tmp_path / "manifest.parquet")
    build_manifest(spark, str(root)).write.parquet(out)
    assert load_manifest(spark, out).count() == 3
    with pytest.raises(FileNotFoundError):
        load_manifest(spark, str(tmp_path / "none.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "bad.parquet"))
    with pytest.raises(DatasetBuilderError, match="path"):
        load_manifest(spark, str(tmp_path / "bad.parquet"))


def test_events_with_different_layouts(spark, tree):
    root, paths = tree
    rows = {(r.path.rsplit("/", 1)[1][:13], r.onset, r.duration, r.eventType) for r in read_events(spark, str(root)).collect()}
    assert rows == {
        ("sub-01_ses-01", "7.0", "9.5", "sz_foc_a"), ("sub-01_ses-01", "-3", "n/a", "bckg"),
        ("sub-01_ses-02", "0", "12", "bckg"),
    }
    got = read_seizure_intervals(spark, str(root)).collect()
    assert [(r.onset_sec, r.end_sec) for r in got] == [(7.0, 16.5)]


def test_events_without_required_columns(spark, tmp_path):
    (tmp_path / "a_events.tsv").write_text("onset\tduration\n1\t2\n")
    with pytest.raises(EventsFileError, match="eventType"), stage_errors():
        read_events(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        read_events(spark, str(tmp_path / "none"))


def test_events_in_byte_ranges(spark, tmp_path, monkeypatch):
    """Two roots, 200 layouts, and ranges far smaller than a file."""
    monkeypatch.setattr(events_tsv, "RANGE_BYTES", 40)
    want, paths = set(), []
    for i in range(200):
        folder = tmp_path / ("one a" if i % 2 else "two%b+#") / f"d{i}"
        folder.mkdir(parents=True)
        names = ["onset", "duration", f"extra{i}"]
        names.insert(i % 4, '"eventType"' if i % 3 else " eventType ")
        lines = ["\t".join(names)]
        for k in range(i % 12):
            cells = {"onset": str(k), "duration": "" if k == 3 else "1.5", "eventType": f'"sz é{k}"'}
            lines.append("\t".join(cells.get(n.strip(' "'), "x" * k) for n in names))
            want.add((str(folder), str(k), cells["duration"] or None, f"sz é{k}"))
        path = folder / "a_events.tsv"
        path.write_bytes(("\r\n" if i % 5 == 0 else "\n").join(lines).encode() + b"\n" * (i % 2))
        paths.append((str(path),))
    rows = events_tsv.read_paths(spark.createDataFrame(paths, "path string")).collect()
    assert len(rows) == len(want)
    assert {(r.path.rsplit("/", 1)[0], r.onset, r.duration, r.eventType) for r in rows} == want


QUOTED = (
    'note\tonset\t"ev""x"\tduration\teventType\n'
    '"two\nlines"\t1\ta\t2\tsz\r\n'
    'in"side\t2\t"q"x\t2\t"s""z"\n'
    '"tab\there ""and\r\nthere"""\t3\t\t\tbckg\r\n\r\n   \n'
    '\t4\t"""\n\t"""\t1\t"sz\n"\r'
    '"é\n\n"\t5\t""\t1\tsz\n'
    '"last"\t6\tb\t""\t"end\n"'
)


@pytest.mark.parametrize("text", [QUOTED, QUOTED + "\n", QUOTED.replace("\r\n", "\n"), "\n \n" + QUOTED, QUOTED.replace("\n", "\r\n")])
def test_quoted_cells_at_every_range_size(spark, tmp_path, text):
    """Line ends in quotes, doubled and stray quotes, all row ends: as pandas reads them, from one byte on."""
    path = tmp_path / "q_events.tsv"
    path.write_bytes(text.encode())
    frame = pd.read_csv(path, sep="\t", dtype=str, keep_default_na=False)
    want = [tuple(v or None for v in row) for row in frame[["onset", "duration", "eventType"]].itertuples(index=False)]
    assert len(want) == 6
    size = len(text.encode())
    begin = events_tsv._head(str(path))[1]
    for width in [*range(1, 40), size]:  # the steps that the plan takes, without its shuffles
        starts = list(range(begin, size, width))
        ask = {"path": [str(path)] * len(starts), "columns": [[1, 3, 4]] * len(starts), "start": starts,
               "stop": [min(s + width, size) for s in starts], "ranges": [len(starts)] * len(starts)}
        found = events_tsv._rows(events_tsv._chained(events_tsv._transitions([pa.RecordBatch.from_pydict(ask)])))
        rows = [r for batch in found for r in batch.to_pylist()]
        assert [(r["onset"], r["duration"], r["eventType"]) for r in rows] == want, width
        assert [r["position"] for r in rows] == sorted({r["position"] for r in rows})
    for width in (1, 7, 64):
        rows = events_tsv.read_paths(spark.createDataFrame([(str(path),)], "path string"), width).orderBy("position").collect()
        assert [(r.onset, r.duration, r.eventType) for r in rows] == want


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a_events.tsv").write_text('onset\tduration\teventType\n1\t2\t"sz\n3\t4\tsz\n')
    with pytest.raises(EventsFileError, match="never closed"), stage_errors():
        read_events(spark, str(tmp_path)).collect()


def test_equal_onsets_keep_the_order_of_the_file(spark, tmp_path):
    rows = [f"{(i * 7) % 3}\t{i}\tsz" for i in range(300)]
    (tmp_path / "a_events.tsv").write_text("\n".join(["onset\tduration\teventType", *rows]))
    got = extract_seizure_intervals(read_events(spark, str(tmp_path), 64), ["path", "position"])
    want = sorted(((i * 7) % 3, i) for i in range(300))
    assert [(r.onset_sec, r.duration_sec) for r in sort_intervals(got).collect()] == want
    assert [(r.onset_sec, r.duration_sec) for r in read_seizure_intervals(spark, str(tmp_path), ordered=True).collect()] == want


def test_labels_of_recordings_under_unrelated_roots(spark, tmp_path):
    text = "onset\tduration\teventType\n2\t6\tsz_x\n"
    for root in ("a b", "c%20d+#"):
        make_tree(tmp_path / root, {("1", "1", "1"): (noise(20, 1), SFREQ, text)})
    manifests = [build_manifest(spark, str(tmp_path / root)) for root in ("a b", "c%20d+#")]
    rows = build_segments_dataset(spark, manifests[0].unionByName(manifests[1])).collect()
    assert [r.label for r in rows] == [1, 1, 0, 0] * 2


def test_paths_with_blanks(tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x_eeg.edf").write_bytes(b"12345")
    for root in (f"{tmp_path}/a b", f"file://{tmp_path}/a b", f"file://{tmp_path}/a%20b"):
        (path, size), = remote.find_files(root, ".edf")
        assert size == 5 and remote.open_file(path).read() == b"12345"


def test_edf_channels_of_different_rates(tmp_path):
    """The slower channel holds its samples; 64 and 16 samples in a record."""
    fast, slow = noise(3, 1)[0], noise(3, 1)[0][: 3 * 16]
    even = bytearray(edf_bytes([fast, np.zeros_like(fast)], SFREQ))
    table = 256 + 2 * 216  # samples per record, 8 bytes a channel
    even[table + 8 : table + 16] = b"16".ljust(8)
    step = 2000 / 65535
    raw = [np.clip(np.rint((x + 1000) / step - 32768), -32768, 32767).astype("<i2") for x in (fast, slow)]
    data = b"".join(raw[0][k * 64 : k * 64 + 64].tobytes() + raw[1][k * 16 : k * 16 + 16].tobytes() for k in range(3))
    path = tmp_path / "x.edf"
    path.write_bytes(bytes(even[: 256 * 3]) + data)
    header = edf.read_header(str(path), ValueError)
    assert (header.sfreq, header.duration_sec, header.n_samples) == (64.0, 3.0, 192)
    with open(path, "rb") as source:
        both = edf.read_records(source, header, 0, 3)
        assert both[0] == pytest.approx(quantised(fast)) and both[1] == pytest.approx(np.repeat(quantised(slow), 4))
        assert edf.read_records(source, header, 1, 2, [1])[0] == pytest.approx(both[1][64:128])


def test_edf_channel_selection(spark, tree):
    root, paths = tree
    edf.register(spark)
    path = paths["01", "02", "00"]
    df = spark.read.format("edf").option("channels", "1,5").load(path)
    found = df.orderBy("start_sec").collect()
    assert {(r.path, r.channel, r.channel_name) for r in found} == {(path, 1, "EEG 1")}
    assert np.concatenate([r.samples for r in found]) == pytest.approx(quantised(SIGNALS["01", "02", "00"][1]), abs=1e-15)
    # A filter of one query does not change the next one.
    all_rows = spark.read.format("edf").load(str(root))
    n = all_rows.count()
    assert 0 < all_rows.where(all_rows.path == path).count() < n == all_rows.count()


def test_edf_header_and_samples(spark, tree):
    root, paths = tree
    edf.register(spark)
    heads = {r.path: r for r in spark.read.format("edf_header").load(str(root)).collect()}
    key = ("01", "02", "00")
    head = heads[paths[key]]
    assert (head.n_channels, head.sfreq, head.n_samples, head.duration_sec) == (2, 64.0, 768, 12.0)
    assert head.channel_names == ["EEG 0", "EEG 1"]
    # Tiny splits: the same samples must come back from many byte ranges.
    reader = spark.read.format("edf").option("secondsPerRow", 2)
    for split in (1 << 25, 700):
        df = reader.option("splitBytes", split).load(str(root))
        rows = df.where(df.path == paths[key]).orderBy("channel", "start_sec").collect()
        for c in range(2):
            got = np.concatenate([r.samples for r in rows if r.channel == c])
            assert got == pytest.approx(quantised(SIGNALS[key][c]), abs=1e-15)
    assert df.rdd.getNumPartitions() > 10


@pytest.mark.parametrize(
    "data",
    [b"", b"junk" * 100, edf_bytes([[0.0] * 64], 64, reserved="EDF+D")],
)
def test_unreadable_recordings(spark, tmp_path, data):
    path = tmp_path / "x_eeg.edf"
    path.write_bytes(data)
    df = spark.createDataFrame([(str(path),)], "path string")
    with pytest.raises(DatasetBuilderError, match="Could not read"), stage_errors():
        edf.recording_headers(df, DatasetBuilderError).collect()


def test_record_count_comes_from_the_file_size(tmp_path):
    path = tmp_path / "x.edf"
    path.write_bytes(edf_bytes([[1.0] * 192], 64, n_records=-1) + b"\0\0")
    assert edf.read_header(str(path), ValueError).duration_sec == 3.0


def test_annotation_channel_is_not_signal(tmp_path):
    path = tmp_path / "x.edf"
    path.write_bytes(edf_bytes([[1.0] * 64, [2.0] * 64], 64, labels=["EDF Annotations", "C3"]))
    head = edf.read_header(str(path), ValueError)
    with open(path, "rb") as source:
        assert edf.read_records(source, head, 0, 1) == pytest.approx(quantised([[2.0] * 64]))


def test_segments_from_files(spark, tree, tmp_path):
    root, paths = tree
    manifest = build_manifest(spark, str(root))
    rows = build_segments_dataset(spark, manifest).collect()
    a = paths["01", "01", "00"]
    assert [(r.start_sec, r.label) for r in rows if r.path == a] == [
        (0.0, 0), (5.0, 1), (10.0, 1), (20.0, 0), (25.0, 0),
    ]
    assert len(rows) == 5 + 2 + 8 and rows == sorted(rows, key=lambda r: (r.subject, r.path, r.start_sec))
    # One recording only: annotations of the others are neither read nor checked.
    only = build_segments_dataset(spark, manifest.where("session = 'ses-02'"))
    assert [r.recording_duration_sec for r in only.collect()] == [12.0, 12.0]
    empty = build_segments_dataset(spark, manifest.where("false"))
    assert empty.count() == 0 and len(empty.columns) == 11


def test_missing_or_bad_annotations(spark, tmp_path):
    make_tree(tmp_path, {("1", "1", "1"): (noise(6, 1), SFREQ, None)})
    manifest = build_manifest(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="events.tsv"), stage_errors():
        build_segments_dataset(spark, manifest).collect()
    make_tree(tmp_path, {("1", "1", "1"): (noise(6, 1), SFREQ, "onset\tduration\teventType\n-1\t2\tsz\n")})
    with pytest.raises(EventsFileError, match="Negative"), stage_errors():
        save_segments_dataset(build_segments_dataset(spark, manifest), str(tmp_path / "out"))


def test_features_from_files(spark, tree, tmp_path):
    root, paths = tree
    segments = build_segments_dataset(spark, build_manifest(spark, str(root)), WindowSpec(5.0, 2.5))
    save_segments_dataset(segments, str(tmp_path / "segments.parquet"))
    features = build_features_dataset(spark, str(tmp_path / "segments.parquet"))
    rows = features.collect()
    assert len(features.columns) == 7 + 8 * 3 and len(rows) == segments.count()
    key_of = {p: k for k, p in paths.items()}
    for r in rows:
        signal = np.array([quantised(c) for c in SIGNALS[key_of[r.path]]])
        part = signal[:, int(r.start_sec * SFREQ) : int(r.end_sec * SFREQ)]
        power = band_powers(part, SFREQ, list(STANDARD_BANDS.values()), False)
        for c in range(3):
            got = [r[f"{n}_ch_{c + 1:02d}"] for n in ("mean", "std", "rms", "line_length", *STANDARD_BANDS)]
            if c >= len(part):
                assert got == [None] * 8
            else:
                assert got[:4] == pytest.approx(time_features(part[c]), rel=1e-9)
                assert got[4:] == pytest.approx(power[c], rel=1e-9)
    limited = build_features_dataset(spark, segments, True, max_segments=4, max_channels=3).collect()
    assert [(r.path, r.start_sec) for r in limited] == [(r.path, r.start_sec) for r in rows[:4]]
    for bad in (0, -1):
        with pytest.raises(FeatureDatasetBuilderError):
            build_features_dataset(spark, segments, max_segments=bad)
    # Two recordings with the same file name stay apart.
    twice = features.unionByName(features.withColumn("path", F.concat(F.lit("/other"), "path")))
    save_feature_parts(twice, str(tmp_path / "parts"))
    back = load_feature_parts(spark, str(tmp_path / "parts"))
    assert back.exceptAll(twice).isEmpty() and back.count() == 2 * len(rows)
    for path in paths.values():
        one = load_feature_parts(spark, str(tmp_path / "parts"), path)
        assert one.exceptAll(features.where(features.path == path)).isEmpty() and not one.isEmpty()


def test_selective_scans_open_few_files(spark, tree):
    """Files that aren't asked for may be unreadable; the next scan is complete again."""
    root, paths = tree
    path = str(sorted(paths.values())[0])
    whole = {tuple(map(str, r)) for r in edf.read_samples(spark, str(root)).where(F.col("path") == path).collect()}
    broken = root / "sub-99" / "x_eeg.edf"
    broken.parent.mkdir()
    broken.write_bytes(b"no recording")
    one = edf.read_samples(spark, str(root), [path])
    assert {tuple(map(str, r)) for r in one.collect()} == whole and whole
    with pytest.raises(Exception, match="Could not read"):
        edf.read_samples(spark, str(root)).collect()
    broken.unlink()
    assert edf.read_samples(spark, str(root)).select("path").distinct().count() == len(paths)
    ranges = edf._SampleReader({"path": str(root), "recordings": f'["{path}"]', "splitBytes": "500"}).partitions()
    assert {p for group in ranges for p, _, _ in group.ranges} == {path} and len(ranges) > 1
    header = edf.read_header(path, ValueError)
    part = edf.read_samples(spark, str(root), [path], 1.5 * header.record_sec, 4 * header.record_sec, [0], header.record_sec)
    rows = part.orderBy("start_sec").collect()
    assert [r.start_sec for r in rows] == [k * header.record_sec for k in (1, 2, 3)] and {r.channel for r in rows} == {0}
    with pytest.raises(ValueError):
        edf.read_samples(spark, str(root), start_sec=3.0, end_sec=3.0)


def test_gathered_samples_are_bounded(monkeypatch, tmp_path):
    """A stride far below the window size does not grow what is held at once."""
    seen = []
    block = feature_plans.feature_block
    monkeypatch.setattr(feature_plans, "feature_block", lambda x, *a: seen.append(x.size) or block(x, *a))
    monkeypatch.setattr(feature_plans, "READ_SAMPLES", 4096)
    path = tmp_path / "x.edf"
    path.write_bytes(edf_bytes(noise(60, 3), SFREQ))
    header = edf.read_header(str(path), ValueError)
    start = np.arange(0, 55, 0.1)
    with open(path, "rb") as source:
        found = feature_plans._recording_features(source, header, start, start + 5.0, False)
    assert len(found) == len(start) and max(seen) <= 4096 and not np.isnan(found).any()


def test_feature_errors(spark, tree, tmp_path):
    root, paths = tree
    path = next(iter(paths.values()))
    schema = "subject string, session string, run string, path string, start_sec double, end_sec double, label long"

    def run(*rows):
        with stage_errors():
            df = spark.createDataFrame([("s", None, None, *r, 0) for r in rows], schema)
            segment_features(df, max_channels=3).collect()

    for row in ((path, 2.0, 2.0), (path, 100.0, 105.0), (None, 0.0, 1.0), ("/no/such.edf", 0.0, 5.0)):
        with pytest.raises(FeatureDatasetBuilderError):
            run(row)
    with pytest.raises(FeatureDatasetBuilderError, match="max_channels"), stage_errors():
        df = spark.createDataFrame([("s", None, None, path, 0.0, 5.0, 0)], schema)
        segment_features(df, max_channels=2).collect()
    spark.range(1).write.parquet(str(tmp_path / "s.parquet"))
    with pytest.raises(FeatureDatasetBuilderError, match="end_sec"):
        load_segments(spark, str(tmp_path / "s.parquet"))
    with pytest.raises(FileNotFoundError):
        load_segments(spark, str(tmp_path / "none.parquet"))


# as many seconds as start in the last recording, and channels that have samples there
@pytest.mark.parametrize("n, seconds, channels", [(42, 1, 2), (46, 2, 4)])
def test_recordings_of_a_table_that_ends_within_one(spark, tmp_path, n, seconds, channels):
    vectors = [(i, RNG.uniform(-1, 1, SFREQ).tolist(), None if i == 41 else i % 10) for i in range(n)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    table.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    same = [k for k, sql in DUCKDB_SQL.items() if FILES_CTE in sql and k != "src_edf_samples"]
    assert len(same) == 14
    for key in same:
        assert difference(SPARK_QUERIES[key](spark, str(tmp_path)), duck, DUCKDB_SQL[key]) is None, key
    rows = SPARK_QUERIES["src_edf_samples"](spark, str(tmp_path)).where("filename LIKE '%run-0001%'").collect()
    cells = {(int(r.start_sec), r.channel): r.rms for r in rows}
    assert cells.keys() == {(s, c) for s in range(seconds) for c in range(channels)}
    # a second that the file has and the table lacks is silent
    assert {k for k, rms in cells.items() if rms < 1e-4} == {k for k in cells if 40 + k[0] * 4 + k[1] >= n}


def _vectors(spark, folder, rows):
    """A table of embeddings in this folder, and the SQL's view of its rows with ids."""
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet') WHERE vec_id IS NOT NULL")
    return duck


WHOLE = [(i, RNG.uniform(-1, 1, SFREQ).astype("float32").tolist(), i % 10) for i in range(80)]


@pytest.fixture(scope="module", params=["odd", "none"])
def odd_vectors(request, spark, tmp_path_factory):
    """Vectors without ids and with more components than a second has; a table without rows."""
    folder = tmp_path_factory.mktemp(request.param)
    odd = [(i, [*v, 0.5, 0.25] if i % 3 == 0 else v, label) for i, v, label in WHOLE]
    rows = [*odd, (None, WHOLE[0][1], 1), (None, None, None)] if request.param == "odd" else []
    return str(folder), _vectors(spark, folder, rows)


@pytest.mark.parametrize("key", [k for k, sql in DUCKDB_SQL.items() if FILES_CTE in sql])
def test_recordings_of_odd_vectors(spark, odd_vectors, key):
    folder, duck = odd_vectors
    assert difference(SPARK_QUERIES[key](spark, folder), duck, DUCKDB_SQL[key]) is None


def test_seconds_of_short_vectors_and_of_ids_below_zero_and_far_above(spark, tmp_path):
    def cells(name, rows):
        _vectors(spark, tmp_path / name, rows)
        found = SPARK_QUERIES["src_edf_samples"](spark, str(tmp_path / name)).collect()
        return [tuple(r)[1:] for r in sorted(found, key=lambda r: (int(r.filename.split("run-")[1].split("_")[0]), r.start_sec, r.channel))]

    whole = cells("whole", WHOLE)
    assert len(whole) == 80
    assert cells("below", [(i - 40, v, label) for i, v, label in WHOLE]) == whole
    assert cells("far", [(i + 4 * 10**18, v, label) for i, v, label in WHOLE]) == whole  # beyond 2**53
    short = [(i, v[:60] if i % 3 == 0 else [] if i % 20 == 1 else v, label) for i, v, label in WHOLE]
    silent = [(i, [*v, *[0.0] * (SFREQ - len(v))], label) for i, v, label in short]
    assert cells("short", short) == cells("silent", silent) != whole


def test_a_channel_without_samples_has_no_features(spark, tmp_path):
    """The middle one of three channels is in the header only."""
    path, channels = str(tmp_path / "sub-1_eeg.edf"), noise(8, 3)
    data = bytearray(edf_bytes(channels[[0, 2]], SFREQ, labels=["A", "C"]))
    whole = edf_bytes(channels, SFREQ, labels=["A", "B", "C"])[: 256 * 4]
    counts = 256 + 216 * 3
    Path(path).write_bytes(whole[: counts + 8] + b"0".ljust(8) + whole[counts + 16 :] + data[256 * 3 :])
    header = edf.read_header(path, ValueError)
    assert header.names == ("A", "B", "C") and header.sampled == [0, 2] and header.n_samples == 8 * SFREQ
    got = edf.read_samples(spark, path).orderBy("channel").collect()
    assert [r.channel_name for r in got] == ["A", "C"]
    assert np.allclose([r.samples for r in got], quantised(channels[[0, 2]]))
    keys = "subject string, session string, run string, path string, start_sec double, end_sec double, label long"
    row = segment_features(spark.createDataFrame([("s", None, None, path, 0.0, 4.0, 1)], keys)).first()
    assert row["mean_ch_02"] is None and row["alpha_power_ch_02"] is None
    assert np.isclose(row["mean_ch_03"], quantised(channels[2])[: 4 * SFREQ].mean())


@pytest.mark.parametrize("key", ["src_edf_header", "src_events_tsv", "src_entities"])
def test_recordings_are_written_again_when_gone_or_stale(spark, tmp_path, key):
    def names(vectors):
        rows = [(i, RNG.normal(scale=0.1, size=64).tolist(), i % 7) for i in range(vectors)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        return {r["filename"] for r in SPARK_QUERIES[key](spark, str(tmp_path)).collect()}

    assert len(names(40)) == 1
    assert len(names(120)) == 3  # the same path, another table
    at = next(k for k in testbed._written if k[2] == str(tmp_path))
    state, _ = testbed._written[at]
    testbed._written[at] = state, f"{tmp_path}/cleared"
    assert len({r["filename"] for r in SPARK_QUERIES[key](spark, str(tmp_path)).collect()}) == 3


@pytest.mark.parametrize("most", [1000, 20_000])
def test_the_first_segments_are_not_sought_by_sending_all_of_them(spark, tmp_path, most):
    """Files of segments can be smaller than those of the counts by recording."""
    number = F.col("id") / 700
    rows = spark.range(0, 140_000, numPartitions=1).select(
        F.lit("s").alias("subject"), F.format_string("p%05d", F.floor(number)).alias("path"), (F.col("id") % 700 * 4.0).alias("start_sec")
    )
    rows.write.parquet(f"{tmp_path}/segments")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        found = limit_segments(spark.read.parquet(f"{tmp_path}/segments"), most)
        assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["path"], r["start_sec"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {(f"p{i // 700:05d}", i % 700 * 4.0) for i in range(most)}
