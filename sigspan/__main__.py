"""Command line: python -m sigspan <command> ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sigspan.functions.windows import WindowSpec
from sigspan.plans import checks, inspection
from sigspan.plans.features import build_features_dataset
from sigspan.plans.segments import build_segments_dataset
from sigspan.sinks.report import preview
from sigspan.sinks.tables import (
    save_feature_parts,
    save_features_dataset,
    save_parquet,
    save_segments_dataset,
)
from sigspan.sources import dataset_root
from sigspan.sources.manifest import build_manifest, load_manifest
from sigspan.sources.tables import file_order, head, load_segments


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sigspan")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *positional: str) -> argparse.ArgumentParser:
        command = commands.add_parser(name, help=text)
        for argument in positional:
            command.add_argument(argument)
        return command

    unpack = add("unpack", "verify and extract a dataset archive", "archive", "root")
    unpack.add_argument("--md5", help="expected checksum; not checked if absent")
    add("check-root", "check the structure of a dataset folder", "root")
    add("read-one", "header of the first recording", "root")
    add("annotations", "annotations of the first recording", "root")
    add("manifest", "index the recordings of a folder", "root", "output")
    segments = add("segments", "label windows of every recording", "manifest", "output")
    segments.add_argument("--window", type=float, default=5.0)
    segments.add_argument("--stride", type=float, default=5.0)
    segments.add_argument("--threshold", type=float, default=0.5)
    segments.add_argument("--keep-partial", action="store_true")
    segments.add_argument("--missing-bounds", choices=("open", "error"), default="open")
    add("check-segments", "quality report of a segments table", "segments")
    features = add("features", "features of every segment", "segments", "output")
    features.add_argument("--relative", action="store_true", help="relative band power")
    features.add_argument("--max-segments", type=int)
    features.add_argument("--max-channels", type=int)
    features.add_argument("--parts", action="store_true", help="one numbered file per recording")
    add("check-features", "quality report of a features table", "features")
    audit = add("inspect", "subject-level audit of a labelled table")
    audit.add_argument("--input", required=True)
    audit.add_argument("--output-dir", default=inspection.InspectionConfig.output_dir)
    audit.add_argument("--top-k", type=int, default=10)
    audit.add_argument("--positive-label", type=int, default=1)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "unpack":
        if args.md5:
            dataset_root.verify_checksum(spark, args.archive, args.md5)
        n = dataset_root.extract_archive(spark, args.archive, args.root)
        print(f"Files: {n}\nSubjects: {len(dataset_root.validate_root(spark, args.root))}")
    elif args.command == "check-root":
        print(f"Subjects: {len(dataset_root.validate_root(spark, args.root))}")
    elif args.command == "read-one":
        print(checks.recording_report(spark, args.root))
    elif args.command == "annotations":
        print(checks.annotations_report(spark, args.root))
    elif args.command == "manifest":
        save_parquet(build_manifest(spark, args.root), args.output)
        stored = load_manifest(spark, args.output)
        subjects = stored.select("subject").distinct().count()
        print(f"{preview(head(stored, 5), 5)}Rows: {stored.count()}\nSubjects: {subjects}")
    elif args.command == "segments":
        spec = WindowSpec(args.window, args.stride, args.threshold, not args.keep_partial)
        found = build_segments_dataset(spark, args.manifest, spec, args.missing_bounds)
        save_segments_dataset(found, args.output)
        stored = load_segments(spark, args.output)
        print(f"Segments: {stored.count()}\n{preview(head(stored, 5), 5)}")
    elif args.command == "check-segments":
        print(checks.segments_report(load_segments(spark, args.segments), file_order()))
    elif args.command == "features":
        found = build_features_dataset(
            spark, args.segments, args.relative, args.max_segments, args.max_channels
        )
        (save_feature_parts if args.parts else save_features_dataset)(found, args.output)
        print(f"Rows: {spark.read.parquet(args.output).count()}")
    elif args.command == "check-features":
        print(checks.features_report(spark.read.parquet(args.features)))
    else:
        config = inspection.InspectionConfig(
            args.input, args.output_dir, args.top_k, args.positive_label
        )
        inspection.run(spark, config)


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName(f"sigspan-{args.command}").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
