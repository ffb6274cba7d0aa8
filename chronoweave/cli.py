"""Command line: ingest, summarise, map, fit and exchange anchors over a Parquet store."""

from __future__ import annotations

import argparse
import sys

from chronoweave.operators.nearest import NearestConfig
from chronoweave.plans.anchors import AnchorService
from chronoweave.plans.audit import audit
from chronoweave.plans.ingest import ingest
from chronoweave.plans.mapping import MappingService, Timeline
from chronoweave.plans.payloads import build_artifacts, mapped_pair, read_payloads
from chronoweave.plans.synthetic import report
from chronoweave.sources.package import read_package, write_reports
from chronoweave.sources.store import ParquetStore


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronoweave")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        p = sub.add_parser(name)
        for flag, *how in options:
            p.add_argument(flag, **(how[0] if how else {"required": True}))

    many = {"type": float}
    pair = [(f"--{side}-{c}",) for side in ("source", "target") for c in ("run", "device", "timeline")]
    config = [("--top-k", {"type": int, "default": 3}), ("--weak-ms", many | {"default": 75.0}), ("--max-ms", many | {"default": 200.0}), ("--primary-policy", {"default": "supported_only"}), ("--window", {"default": "target_overlap"}), ("--margin-ms", many | {"default": 0.0}), ("--extrapolation", {"default": "disallow"}), ("--allow-numeric", {"action": "store_true"}), ("--overwrite", {"action": "store_true"})]
    store = [("--store",)]
    command("ingest-temp", *store, ("--package",), ("--reports", {"default": None}))
    command("summary", *store)
    command("build-artifacts", *store, ("--package",), ("--payloads",), ("--overwrite", {"action": "store_true"}))
    command("audit-artifacts", *store, ("--root",))
    command("inspect-pair", *store, ("--payloads",), ("--version",), ("--sample", {"type": int, "required": True}))
    command("map-nearest", *store, ("--subject",), *pair, ("--version",), *config)
    command("map-nearest-all", *store, *[(f"--{s}-{c}",) for s in ("source", "target") for c in ("device", "timeline")], ("--min-overlap-sec", many | {"default": 5.0}), *config)
    command("fit-piecewise", *store, ("--subject",), *pair, ("--model",), ("--version",), ("--parent", {"default": None}), *config)
    for name in ("export-anchors", "import-anchors"):
        more = [("--subject",), *[(f"--{s}-{c}",) for s in ("source", "target") for c in ("run", "device")]] if name[0] == "e" else [("--overwrite", {"action": "store_true"})]
        command(name, *store, ("--file",), *more)
    command("piecewise-synthetic-report")
    return top


def _config(a: argparse.Namespace) -> NearestConfig:
    return NearestConfig(a.top_k, a.weak_ms, a.max_ms, a.extrapolation, a.window, a.margin_ms, a.primary_policy, a.allow_numeric)


def main(argv: list[str] | None = None, spark=None) -> int:
    """0 if all went well, 1 if an audit found errors, 2 if the request was wrong."""
    a = _parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = ParquetStore(spark, a.store) if hasattr(a, "store") else None
    side = lambda p: Timeline(a.subject, getattr(a, f"{p}_run"), getattr(a, f"{p}_device"), getattr(a, f"{p}_timeline"))
    run = lambda p: (getattr(a, f"{p}_run"), getattr(a, f"{p}_device"))
    try:
        if a.command == "ingest-temp":
            reports = ingest(store, read_package(spark, a.package))
            if a.reports:
                write_reports(reports, a.reports)
        elif a.command == "summary":
            store.counts().show(50, False)
        elif a.command == "build-artifacts":
            package = read_package(spark, a.package)
            build_artifacts(store, a.payloads, package["rgb_samples"], package["radar_pc_samples"], a.overwrite)
        elif a.command == "audit-artifacts":
            found = audit(store.read("RUN_ASSET"), store.read("SAMPLE_ARTIFACT"), store.read("SAMPLE_SUMMARY"), root=a.root)
            found.show(200, False)
            return int(not found.where("severity = 'error'").limit(1).isEmpty())
        elif a.command == "inspect-pair":
            mapped_pair(store.read("SAMPLE_MAPPING"), read_payloads(spark, a.payloads), store.read("SAMPLE_SUMMARY"), a.version, a.sample).show(50, 80)
        elif a.command == "map-nearest":
            MappingService(store).map_nearest(side("source"), side("target"), a.version, _config(a), a.overwrite).show(50, False)
        elif a.command == "map-nearest-all":
            MappingService(store).map_all(a.source_device, a.source_timeline, a.target_device, a.target_timeline, _config(a), a.min_overlap_sec, a.overwrite).show(200, False)
        elif a.command == "fit-piecewise":
            MappingService(store).fit_piecewise(side("source"), side("target"), a.model, a.version, _config(a), a.extrapolation, a.parent, a.overwrite).show(50, False)
        elif a.command == "export-anchors":
            print(AnchorService(store).export_json(a.file, a.subject, run("source"), run("target")))
        elif a.command == "import-anchors":
            print(AnchorService(store).import_json(a.file, a.overwrite))
        else:
            report(spark).orderBy("case").show(20, False)
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
