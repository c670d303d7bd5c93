"""Files with names of their own: numbered parts, single CSV files, and what failures leave."""

import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sigspan.operators import quality
from sigspan.operators.ranks import numbered, running_sum
from sigspan.plans import inspection
from sigspan.sinks.staged import FILE, RANGE, write_files
from sigspan.sinks.tables import load_feature_parts, save_csv, save_feature_parts
from sigspan.sources.tables import file_order, head


def listing(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_places_and_running_sums(spark):
    values = spark.range(1000).select(((F.col("id") * 37) % 101).alias("v"), "id").repartition(7)
    got = {r["id"]: r["place"] for r in numbered(values, [F.col("v"), F.col("id")]).collect()}
    order = sorted(range(1000), key=lambda i: (i * 37 % 101, i))
    assert got == {i: k for k, i in enumerate(order)}
    sums = {r["id"]: r["s"] for r in running_sum(values, [F.col("id")], F.col("v"), "s").collect()}
    assert sums == {i: sum(k * 37 % 101 for k in range(i)) for i in range(1000)}
    assert numbered(values.limit(0), [F.col("v")]).count() == 0


def features(spark, recordings=12, rows=50):
    df = spark.range(recordings * rows).repartition(5)
    path = F.concat(F.lit("/r/"), F.lpad(((F.col("id") % recordings) * 7 % recordings).cast("string"), 3, "0"), F.lit("_eeg.edf"))
    return df.select(path.alias("path"), F.floor(F.col("id") / recordings).cast("double").alias("start_sec"), (F.col("id") * 0.1).alias("rms_ch_01"))


def test_one_numbered_file_per_recording(spark, tmp_path):
    found = features(spark)
    folder = tmp_path / "parts"
    for _ in range(2):  # a second save replaces the first
        save_feature_parts(found, str(folder))
    want = found.toPandas().sort_values(["path", "start_sec"])
    names = [f"features_part_{i:04d}.parquet" for i in range(12)]
    assert sorted(n for n in os.listdir(folder)) == names and os.listdir(tmp_path) == ["parts"]
    for name, (path, rows) in zip(names, want.groupby("path")):
        part = pd.read_parquet(folder / name)
        pd.testing.assert_frame_equal(part, rows.reset_index(drop=True))
    assert load_feature_parts(spark, str(folder), "/r/003_eeg.edf").count() == 50
    # more than four digits
    many = spark.range(3).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(0.0).alias("start_sec"))
    save_feature_parts(many.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


def test_a_long_recording_is_joined_from_several_tasks(spark, tmp_path):
    found = features(spark, 2, 4000)
    save_feature_parts(found, str(tmp_path / "parts"))
    part = pq.ParquetFile(tmp_path / "parts" / "features_part_0000.parquet")
    assert part.num_row_groups > 1 and part.metadata.num_rows == 4000
    assert (np.diff(part.read().column("start_sec").to_numpy()) > 0).all()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    save_feature_parts(features(spark), str(tmp_path / "parts"))
    before = listing(tmp_path)
    bad = features(spark).withColumn("rms_ch_01", F.when(F.col("start_sec") == 30, F.raise_error("broken")).otherwise(1.0))
    with pytest.raises(Exception, match="broken"):
        save_feature_parts(bad, str(tmp_path / "parts"))
    assert listing(tmp_path) == before
    rows = spark.range(100).select("id", F.lit("a").alias(FILE), F.spark_partition_id().alias(RANGE))
    rows = rows.where(F.when(F.col("id") == 99, F.raise_error("late")).otherwise(True))
    with pytest.raises(Exception, match="late"):
        write_files(rows, str(tmp_path / "late"))
    assert listing(tmp_path) == before


def test_csv_files_are_those_of_a_local_ordered_write(spark, tmp_path):
    rows = [(f"s{i % 40}", i % 7 == 0, f"run-{i % 3}") for i in range(3000)] + [('quoted, "x"\ny', True, None), ("é", False, "r")]
    df = spark.createDataFrame(rows, "subject string, positive boolean, run string")
    df = df.select("subject", F.col("positive").cast("int").alias("label"), "run").repartition(6)
    df.write.parquet(str(tmp_path / "in.parquet"))
    config = inspection.InspectionConfig(str(tmp_path / "in.parquet"), str(tmp_path / "report"), 10, 1)
    result = inspection.inspect(spark.read.parquet(config.input_path), config)
    inspection.save(spark, result, config)
    for name, table in {"subject_summary": result.summary, **result.tables}.items():
        path = tmp_path / "report" / f"{name}.csv"
        assert path.is_file()
        assert path.read_bytes() == table.toPandas().to_csv(index=False, lineterminator="\n").encode()
    assert not [n for n in os.listdir(tmp_path / "report") if n.endswith(".new") or n.startswith("_")]
    result.summary.unpersist()
    values = spark.range(500).select(F.col("id"), (F.col("id") / 7 - 3e-7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    save_csv(values.repartition(5), str(tmp_path / "v.csv"), [F.col("id").desc()])
    back = pd.read_csv(tmp_path / "v.csv", float_precision="round_trip")
    assert back["id"].tolist() == list(range(499, -1, -1)) and back["n"].isna().sum() == 167
    assert back["x"].tolist() == [i / 7 - 3e-7 for i in range(499, -1, -1)]
    save_csv(values.limit(0), str(tmp_path / "v.csv"))
    assert (tmp_path / "v.csv").read_text() == "id,x,n\n"


def test_first_appearance_and_head_in_file_order(spark, tmp_path):
    path = str(tmp_path / "a b%20c")
    values = [(i, "zyxab"[(i * 3 // 40) % 5]) for i in range(400)]
    df = spark.createDataFrame(values, "i int, v string")
    df.repartitionByRange(6, "i").sortWithinPartitions("i").write.parquet(path)
    stored = spark.read.parquet(path)
    assert len(stored.inputFiles()) == 6
    want = list(dict.fromkeys(v for _, v in values))
    assert [r["v"] for r in quality.unique_values(stored, "v", file_order()).collect()] == want
    assert [r["i"] for r in head(stored, 150).collect()] == list(range(150))
    assert head(stored, 1000).count() == 400
