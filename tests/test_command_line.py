import zipfile

import numpy as np
import pytest
from recordings import make_tree

from sigspan.__main__ import parser, run
from sigspan.sources import dataset_root

EVENTS = "onset\tduration\teventType\n3\t9\tsz\n0\t1\tbckg\n"


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    base = tmp_path_factory.mktemp("archive")
    rng = np.random.default_rng(1)
    make_tree(
        base / "wrapped",
        {(f"{i:02d}", "01", "00"): (rng.normal(size=(2, 64 * 40)), 64, EVENTS) for i in range(3)},
    )
    path = base / "data.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(f for f in (base / "wrapped").rglob("*") if f.is_file()):
            out.write(file, file.relative_to(base))
    return path


def call(spark, *words):
    run(spark, parser().parse_args([str(w) for w in words]))


def test_whole_chain(spark, archive, tmp_path, capsys):
    root = tmp_path / "root"
    call(spark, "unpack", archive, root)
    assert (root / "dataset_description.json").exists()
    call(spark, "check-root", root)
    call(spark, "read-one", root)
    call(spark, "annotations", root)
    text = capsys.readouterr().out
    assert "Subjects: 3" in text and "Channels: 2" in text and "Number of annotations: 2" in text
    call(spark, "manifest", root, tmp_path / "manifest.parquet")
    call(spark, "segments", tmp_path / "manifest.parquet", tmp_path / "segments.parquet")
    call(spark, "features", tmp_path / "segments.parquet", tmp_path / "features.parquet")
    call(spark, "features", tmp_path / "segments.parquet", tmp_path / "parts", "--parts",
         "--relative", "--max-segments", "10", "--max-channels", "2")
    text = capsys.readouterr().out
    # Windows at 0 s and 10 s are covered by less than half and dropped.
    assert "Segments: 18" in text and "Rows: 18" in text and "Rows: 10" in text
    call(spark, "check-segments", tmp_path / "segments.parquet")
    call(spark, "check-features", tmp_path / "features.parquet")
    text = capsys.readouterr().out
    assert "Shape: (18, 23)" in text and "Number of feature columns:\n16" in text
    assert "All feature columns are numeric." in text and "No nulls found." in text
    call(spark, "inspect", "--input", tmp_path / "segments.parquet", "--output-dir", tmp_path / "out")
    assert "few_total_subjects: True" in capsys.readouterr().out
    assert (tmp_path / "out" / "inspection_report.md").exists()


def test_checksum(spark, archive):
    import hashlib

    right = hashlib.md5(archive.read_bytes()).hexdigest()
    dataset_root.verify_checksum(spark, str(archive), right)
    with pytest.raises(RuntimeError, match="mismatch"):
        dataset_root.verify_checksum(spark, str(archive), "0" * 32)


@pytest.mark.parametrize("name", ["../evil", "/etc/evil", "a/../../evil"])
def test_unsafe_archive(spark, tmp_path, name):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as out:
        out.writestr(name, "x")
    with pytest.raises(RuntimeError, match="Unsafe"):
        dataset_root.extract_archive(spark, str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_bad_root(spark, tmp_path):
    with pytest.raises(RuntimeError, match="dataset_description"):
        dataset_root.validate_root(spark, str(tmp_path))
    (tmp_path / "dataset_description.json").write_text("{}")
    (tmp_path / "participants.tsv").write_text("")
    with pytest.raises(RuntimeError, match="sub-"):
        dataset_root.validate_root(spark, str(tmp_path))
