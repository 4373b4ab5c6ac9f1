"""Command line: run, validate, discover, releases, fetch, gnaf-info."""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pydantic import ValidationError

from areaweave.plans.config import Config, load_config


def _sources(spec: str, spark, config: Config):
    """Sources from ``module:function``, called with the session and the configuration."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)(spark, config)


def _prepare(spark, config: Config, args) -> None:
    """Parse what was put into the folder, so that a run finds it parsed. Nothing is fetched from the network."""
    from areaweave.plans.loaders import Store
    from areaweave.sources import corpus

    c = config.census
    store = Store(spark, args.data_dir.rstrip("/"), c.year, c.datum, descriptor=c.descriptor, region=c.region, refresh=args.refresh)
    if args.boundaries:
        print(f"Boundaries: {store.sa2.count()} areas")
    if args.census:
        print(f"Census: {len(store.datapack(c.year))} tables")
    if args.gnaf:
        at = f"{store.root}/gnaf"
        release = corpus.resolve_release(spark, at, config.geocoding.gnaf.release)
        print(f"Addresses: release {release}, {corpus.read(spark, at, release, census_year=c.year).count()} rows")
        print(f"Mesh blocks: {store.mesh.count() if store.mesh is not None else 'none'}")


def _corpus_info(spark, config: Config, root: str) -> int:
    """The corpus that a run would use: mode, datum, release, place and size."""
    from areaweave.plans.wiring import corpus_root
    from areaweave.sources import corpus

    g = config.geocoding
    if "gnaf" not in g.providers:
        print("the address corpus is none of geocoding.providers", file=sys.stderr)
        return 1
    at = corpus_root(config, root.rstrip("/"))
    print(f"Mode: {g.gnaf.mode}\nDatum: {g.gnaf.datum}\nConfigured release: {g.gnaf.release}")
    release = corpus.resolve_release(spark, at, g.gnaf.release)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{release}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    print(f"Resolved release: {release}\nPlace: {at}/{release}\nSize: {size / 1e6:.1f} MB")
    return 0 if size else 1


def main(argv: list[str] | None = None) -> int:
    """0 on success, 1 on an error of configuration or data, 2 on wrong usage."""
    parser = argparse.ArgumentParser(prog="areaweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "validate"):
        p = commands.add_parser(name)
        p.add_argument("config", type=Path)
        if name == "run":
            p.add_argument("--sources", help="module:function that builds the sources")
        p.add_argument("--data-dir", help="folder of published files" + (", in place of --sources" if name == "run" else ": variables are looked up in its catalogue too"))
    for name in ("fetch", "gnaf-info"):
        p = commands.add_parser(name)
        p.add_argument("--config", "-c", type=Path, required=True)
        p.add_argument("--data-dir", required=True)
        if name == "fetch":
            for what in ("boundaries", "census", "gnaf", "refresh"):
                p.add_argument(f"--{what}", action="store_true")
    p = commands.add_parser("discover")
    p.add_argument("text", nargs="?", default="")
    p = commands.add_parser("releases")
    p.add_argument("root")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if args.command == "discover":
            from areaweave.plans.presets import FeatureRegistry
            from areaweave.plans.registry import Registry

            for s in Registry().list_datasets():
                if args.text.lower() in f"{s.id} {s.namespace}".lower():
                    print(f"{s.namespace}\t{s.id}\t{', '.join(s.releases)}")
            for f in FeatureRegistry().list_features():
                if args.text.lower() in f.id.lower():
                    print(f"PRESET.{f.id}\t{f.output_kind}")
            return 0
        if args.command == "releases":
            from pyspark.sql import SparkSession

            from areaweave.sources.corpus import releases

            print("\n".join(releases(SparkSession.builder.getOrCreate(), args.root)))
            return 0
        config = load_config(args.config.read_text(encoding="utf-8"))
        if args.command == "validate":
            if args.data_dir:
                from pyspark.sql import SparkSession

                from areaweave.plans.pipeline import Pipeline

                Pipeline.from_config(SparkSession.builder.getOrCreate(), config, args.data_dir)
            print("valid")
            return 0
        if args.command == "fetch" and not (args.boundaries or args.census or args.gnaf):
            print("Error: one or more of --boundaries, --census and --gnaf", file=sys.stderr)
            return 2
        from pyspark.sql import SparkSession

        from areaweave.plans.pipeline import Pipeline

        spark = SparkSession.builder.getOrCreate()
        if args.command == "fetch":
            _prepare(spark, config, args)
            return 0
        if args.command == "gnaf-info":
            return _corpus_info(spark, config, args.data_dir)
        if not args.sources and not args.data_dir:
            print("Error: --sources or --data-dir", file=sys.stderr)
            return 2
        made = Pipeline(spark, config, _sources(args.sources, spark, config)) if args.sources else Pipeline.from_config(spark, config, args.data_dir)
        print(made.run().human_readable())
        return 0
    except (ValidationError, ValueError, KeyError, OSError, RuntimeError, NotImplementedError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
