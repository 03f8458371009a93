"""Command line, for spark-submit: ``python -m tessera update ROOT STORE VERSION`` and the like."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.runs import pick, shard, with_prefix
from tessera.plans.audit import audited, store_files, unowned
from tessera.plans.blobs import run_blobs, totals
from tessera.plans.site import run_sites
from tessera.plans.statistics import update, validate_store
from tessera.session import configure, read_settings
from tessera.sources.npz import read_tiles
from tessera.sources.store import done_sites, read_catalog, site_state, staged


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("update", help="bring the statistics tables up to the masks on disk")
    c.add_argument("root"), c.add_argument("store"), c.add_argument("version")
    c.add_argument("--full", action="store_true", help="decode all masks anew")
    c.add_argument("--prune", action="store_true", help="drop tiles whose mask is gone")
    c = commands.add_parser("validate", help="compare stored tiles with a new scan")
    c.add_argument("root"), c.add_argument("store")
    c.add_argument("--sample", type=int, default=0, help="tiles to look at (0: all)")
    c = commands.add_parser("sites", help="list the catalog's sites of a shard")
    c.add_argument("catalog")
    c.add_argument("--shard", default="0/1", help="index/number of shards")
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--prefix", action="append", default=[])
    c.add_argument("--pick", help="the first site whose key holds this")
    c = commands.add_parser("status", help="which sites have cells, patches and metadata")
    c.add_argument("out")
    c.add_argument("--site", help="what the store has of this one")
    c = commands.add_parser("audit", help="check a store's files, cells, patches and metadata against each other")
    c.add_argument("out")
    c.add_argument("--unowned", action="store_true", help="list the files that no site owns")
    c = commands.add_parser("run-sites", help="grid, embed and store the cells of sites")
    c.add_argument("tiles", help="root of the image tiles"), c.add_argument("rasters", help="table of rasters"), c.add_argument("out")
    c.add_argument("--pixels", help="table of the rasters' pixels")
    c.add_argument("--patch", type=int, default=512)
    c.add_argument("--embedder", required=True, help="module:function that makes the embedder in a task")
    c.add_argument("--cells", required=True, help="module:function that adds the pixels of cells")
    c.add_argument("--patches", action="store_true", help="the embedder gives patch vectors too")
    c.add_argument("--model", default=""), c.add_argument("--least", type=float, default=0.02)
    c.add_argument("--site", action="append", default=[], help="only this site; may be repeated")
    c.add_argument("--shard", default="0/1"), c.add_argument("--limit", type=int, default=0)
    c.add_argument("--anew", action="store_true", help="don't skip sites that are done")
    c.add_argument("--config", help="a TOML file with settings to record with the run")
    c = commands.add_parser("run-blobs", help="embed the windows of blobs")
    c.add_argument("pixels", help="table of tiles' pixels"), c.add_argument("cells", help="table of tiles"), c.add_argument("out")
    c.add_argument("--embedder", required=True)
    c.add_argument("--tile", type=int, default=512), c.add_argument("--overlap", type=int, default=128), c.add_argument("--cell", type=int, default=8)
    return p


def named(place: str) -> Callable:
    """What ``module:function`` names."""
    module, _, function = place.partition(":")
    return getattr(importlib.import_module(module), function)


def site_run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    tiles = read_tiles(spark, args.tiles).where("problem is null")
    if args.site:
        tiles = tiles.where(F.col("site_id").isin(args.site))
    index, shards = map(int, args.shard.split("/"))
    mine = shard(tiles.select("site_id").distinct(), "site_id", index, shards, args.limit)
    tiles = tiles.join(mine, "site_id", "left_semi")
    rasters, pixels = spark.read.parquet(args.rasters), spark.read.parquet(args.pixels) if args.pixels else None
    settings = read_settings(Path(args.config).read_text()) if args.config else {}
    return run_sites(tiles, rasters, args.out, args.patch, named(args.cells), named(args.embedder), pixels, args.model, not args.anew, args.least, args.patches, settings)


def blob_run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Patches and metadata, stored; the totals come back."""
    patches, meta = run_blobs(spark.read.parquet(args.pixels), spark.read.parquet(args.cells), named(args.embedder), args.tile, args.overlap, args.cell)
    staged(patches, f"{args.out}/patches")
    return totals(staged(meta, f"{args.out}/meta"))


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The command's result, to be shown."""
    if args.command == "update":
        return update(spark, args.root, args.store, args.version, args.full, args.prune)["site_resolution"]
    if args.command == "validate":
        return validate_store(spark, args.root, args.store, args.sample)
    if args.command == "status":
        return site_state(spark, args.out, args.site) if args.site else done_sites(spark, args.out).orderBy("site_id")
    if args.command == "audit":
        return unowned(store_files(spark, args.out)) if args.unowned else audited(spark, args.out).orderBy("site_id")
    if args.command == "run-sites":
        return site_run(spark, args)
    if args.command == "run-blobs":
        return blob_run(spark, args)
    sites = read_catalog(spark, args.catalog)
    sites = with_prefix(sites, "site_key", args.prefix) if args.prefix else sites
    if args.pick:
        return pick(sites, "site_key", args.pick, "pos")
    index, shards = map(int, args.shard.split("/"))
    return shard(sites, "pos", index, shards, args.limit).orderBy(F.col("pos"))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = configure(SparkSession.builder.appName("tessera").getOrCreate())
    run(spark, args).show(1000, truncate=False)


if __name__ == "__main__":
    main()
