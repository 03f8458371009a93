"""Whole runs on small sites: footprints, grids, stored cells, statistics tables, blobs, the command line."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from tessera import __main__ as command
from tessera.functions.projections import reprojected_boxes
from tessera.operators import runs, spatial
from tessera.plans import blobs, site, statistics
from tessera.sources import archives, npz, store

GT = [0.5, 0.0, 1000.0, 0.0, -0.5, 2000.0, 0.0, 0.0, 1.0]


def raster_rows(spark, mask, name="s"):
    rows = [(name, r, c, int(v), 0, 0) for (r, c), v in np.ndenumerate(mask)]
    pixels = spark.createDataFrame(rows, "site_id string, row int, col int, r int, g int, b int")
    rasters = spark.createDataFrame([(name, mask.shape[1], mask.shape[0], GT)], "site_id string, width int, height int, geo_transform array<double>")
    return pixels, rasters


def painted(foot, shape):
    out = np.zeros(shape, bool)
    for r in foot.collect():
        c0, c1 = round((r["xmin"] - 1000) / 0.5), round((r["xmax"] - 1000) / 0.5)
        r0, r1 = round((2000 - r["ymax"]) / 0.5), round((2000 - r["ymin"]) / 0.5)
        out[r0:r1, c0:c1] = True
    return out


def regions(mask):
    """Brute force: cells joined by sides."""
    left, out = set(zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True)), []
    while left:
        todo, found = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            found.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(found)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_footprint_keeps_large_regions_only(spark, seed):
    mask = np.random.default_rng(seed).random((30, 40)) < 0.55
    pixels, rasters = raster_rows(spark, mask)
    want = np.zeros(mask.shape, bool)
    for region in regions(mask):
        if len(region) >= 12:
            want[tuple(np.array(sorted(region)).T)] = True
    assert (painted(spatial.footprint(pixels, rasters, least_pixels=12), mask.shape) == want).all()


def test_footprint_without_a_region_is_the_extent(spark):
    mask = np.zeros((6, 8), int)
    mask[2, 3] = 7
    pixels, rasters = raster_rows(spark, mask)
    assert painted(spatial.footprint(pixels, rasters), mask.shape).all()


def test_thinned_footprint_covers_about_the_same(spark):
    mask = np.zeros((40, 60), int)
    mask[4:31, 10:50] = 1
    pixels, rasters = raster_rows(spark, mask)
    # every third pixel stands for three by three
    want = np.kron(mask[::3, ::3], np.ones((3, 3), int))[: mask.shape[0], : mask.shape[1]]
    got = painted(spatial.footprint(pixels, rasters, max_side=20, least_pixels=4), mask.shape)
    assert (got == (want > 0)).all()


def test_clipping_takes_the_box_around_what_is_left(spark):
    foot = spark.createDataFrame([("s", 0.0, 0.0, 4.0, 4.0), ("s", 6.0, 2.0, 9.0, 3.0), ("t", 0.0, 0.0, 1.0, 1.0)], "site_id string, xmin double, ymin double, xmax double, ymax double")
    tiles = spark.createDataFrame([("s", "a", 3.0, 1.0, 8.0, 9.0), ("s", "b", 9.0, 0.0, 12.0, 5.0), ("t", "c", 0.5, 0.5, 3.0, 3.0)], "site_id string, tile string, xmin double, ymin double, xmax double, ymax double")
    got = {r["tile"]: (r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in spatial.clip_to_footprint(tiles, foot, 5.0, ["site_id", "tile"]).collect()}
    assert got == {"a": (3.0, 1.0, 8.0, 4.0), "c": (0.5, 0.5, 1.0, 1.0)}


def test_more_than_one_extent_raises(spark):
    box = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "xmin double, ymin double, xmax double, ymax double")
    with pytest.raises(ValueError):
        spatial.clip_to(box, box.union(box))


@pytest.fixture
def two_sites(spark):
    masks = {"s": np.ones((64, 64), int), "t": np.ones((64, 64), int)}
    masks["s"][:, 40:] = 0
    parts = [raster_rows(spark, m, n) for n, m in masks.items()]
    pixels, rasters = parts[0][0].union(parts[1][0]), parts[0][1].union(parts[1][1])
    box = lambda n, t, c0, r0, c1, r1: (n, t, 1000 + 0.5 * c0, 2000 - 0.5 * r1, 1000 + 0.5 * c1, 2000 - 0.5 * r0)
    tiles = spark.createDataFrame(
        [box("s", "a", 1, 1, 30, 20), box("s", "b", 20, 10, 64, 30), box("t", "a", 0, 0, 16, 16), box("none", "a", 0, 0, 5, 5)],
        "site_id string, tile string, xmin double, ymin double, xmax double, ymax double",
    )
    return tiles, rasters, pixels


def test_grid_is_snapped_to_pixels_and_void_cells_go(spark, two_sites):
    tiles, rasters, pixels = two_sites
    cells, info = site.site_grid(tiles, rasters, 16, pixels, least=0.02)
    got = cells.where("site_id = 's'").toPandas().sort_values("cell_id")
    # tiles are cut at column 40: columns 1 to 40, rows 1 to 30 in cells of 16 from (1, 1)
    assert got[["col_px", "row_px"]].values.tolist() == [[1, 1], [17, 1], [33, 1], [1, 17], [17, 17], [33, 17]]
    assert got["cell_id"].tolist() == list(range(6))
    assert ((got["xmin"] - 1000) / 0.5 % 1 == 0).all() and ((got["xmax"] - got["xmin"]) == 8).all()
    told = {r["site_id"]: r for r in info.collect()}
    assert (told["s"]["n_cells_full"], told["s"]["after_tile_filter"], told["s"]["n_cells"], told["s"]["dropped_void"], told["s"]["cell_sizes_px"]) == (6, 6, 6, 0, [16])
    strict, counted = site.site_grid(tiles, rasters, 16, pixels, least=0.5)
    assert strict.where("site_id = 's'").count() == 4 and counted.where("site_id = 's'").first()["dropped_void"] == 2


def pixels_of(cells):
    return cells.withColumn("pixels", F.array(F.col("row").cast("float"), F.col("col").cast("float")))


def counting(spark):
    """(calls, embedder): the class vector is twice the pixels, the patches are 3 across and 3 down of two channels."""
    calls = spark.sparkContext.accumulator(0)

    def embedder():
        def run(x):
            calls.add(len(x))
            return x * 2, x[:, :, None] + np.arange(9)

        return run

    return calls, embedder


def test_sites_are_stored_once_and_resumed(spark, two_sites, tmp_path):
    tiles, rasters, pixels = two_sites
    calls, embedder = counting(spark)
    out = str(tmp_path / "out")
    told = {r["site_id"]: r for r in site.run_sites(tiles, rasters, out, 16, pixels_of, embedder, pixels, model="twice", with_patches=True, settings={"weights": "w1"}).collect()}
    assert {k: r["status"] for k, r in told.items()} == {"s": runs.OK, "t": runs.OK, "none": runs.FAILED} and told["none"]["problem"] == "no raster"
    cells = store.read_cells(spark, f"{out}/cells")
    assert calls.value == cells.count() == told["s"]["n_cells"] + told["t"]["n_cells"]
    first = store.cell(spark, f"{out}/cells", "s", 4).first()
    assert first["cls"] == [2.0, 2.0] and first["patch_ref"] == "s/patches#4"
    # every reference resolves to the patches of its own cell
    patches = store.read_cells(spark, f"{out}/patches")
    assert patches.groupBy("site_id", "cell_id").count().where("count = 9").join(cells, ["site_id", "cell_id"]).count() == cells.count()
    got = {(r["prow"], r["pcol"]): r["vec"] for r in store.patch_of(spark, out, first["patch_ref"]).collect()}
    assert got == {(i // 3, i % 3): [first["row"] + i, first["col"] + i] for i in range(9)}
    meta = {r["site_id"]: r for r in store.read_site_meta(spark, f"{out}/meta").collect()}
    assert (meta["s"]["n_cells"], meta["s"]["embed_dim"], meta["s"]["model"], meta["s"]["patch_px"], meta["s"]["patch_grid"], meta["s"]["patch_ground_m"]) == (6, 2, "twice", 16, [3, 3], 8 / 3)
    again = {r["site_id"]: r["status"] for r in site.run_sites(tiles, rasters, out, 16, pixels_of, embedder, pixels, with_patches=True).collect()}
    assert again == {"s": runs.SKIPPED, "t": runs.SKIPPED, "none": runs.FAILED} and calls.value == cells.count()
    record = {r["run_id"]: r for r in spark.read.json(f"{out}/runs").collect()}
    assert len(record) == 2 and record[meta["s"]["run_id"]]["sites"] == ["none", "s", "t"] and record[meta["s"]["run_id"]]["settings"]["weights"] == "w1"
    args = command.parser().parse_args(["status", out])
    assert [tuple(r) for r in command.run(spark, args).collect()] == [("s", True, True, True), ("t", True, True, True)]
    state = store.site_state(spark, out, "t")
    row = state.first()
    assert (row["stored_cells"], row["stored_dim"], row["cells_with_patches"], row["stored_grid"], row["n_cells"]) == (told["t"]["n_cells"], 2, row["n_cells"], [3, 3], row["n_cells"])
    scans = [x for x in state._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x]
    assert scans and all("site_id" in x.split("PartitionFilters")[1].split("PushedFilters")[0] for x in scans)


@pytest.mark.parametrize("fails", ["write_patches", "write_site_meta"])
def test_a_run_stopped_between_the_sinks_is_made_anew(spark, two_sites, tmp_path, monkeypatch, fails):
    tiles, rasters, pixels = two_sites
    calls, embedder = counting(spark)
    out = str(tmp_path / "out")

    def stop(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(site, fails, stop)
        with pytest.raises(KeyboardInterrupt):
            site.run_sites(tiles, rasters, out, 16, pixels_of, embedder, pixels, with_patches=True)
    assert store.done_sites(spark, out).where("has_cells and not has_meta").count() == 2
    assert spark.read.json(f"{out}/runs").count() == 1
    told = {r["site_id"]: r["status"] for r in site.run_sites(tiles, rasters, out, 16, pixels_of, embedder, pixels, with_patches=True).collect()}
    assert told == {"s": runs.OK, "t": runs.OK, "none": runs.FAILED}
    n = store.read_cells(spark, f"{out}/cells").count()
    assert calls.value == 2 * n and store.read_cells(spark, f"{out}/patches").count() == 9 * n
    assert store.done_sites(spark, out).where("has_cells and has_patches and has_meta").count() == 2


def test_tiles_of_one_name_and_other_systems(spark, two_sites):
    _, rasters, pixels = two_sites
    row = lambda path, c0, c1: ("t", "a", path, 1000 + 0.5 * c0, 2000 - 0.5 * 10, 1000 + 0.5 * c1, 2000.0)
    kinds = "site_id string, tile string, path string, xmin double, ymin double, xmax double, ymax double"
    tiles = spark.createDataFrame([row("train/a", 0, 9), row("val/a", 50, 60)], kinds)
    cells, _ = site.site_grid(tiles, rasters, 16, pixels)
    assert sorted(r["col"] for r in cells.collect()) == [0, 3]  # one box around both would take in the cells between them
    raster = spark.createDataFrame([("w", 64, 64, [10.0, 0.0, 390_000.0, 0.0, -10.0, 6_460_000.0, 0.0, 0.0, 1.0], 32750)], "site_id string, width int, height int, geo_transform array<double>, srid int")
    here = spark.createDataFrame([("w", "a", "p", 390_100.0, 6_459_700.0, 390_200.0, 6_459_900.0, 32750)], f"{kinds}, srid int")
    there = reprojected_boxes(here, F.col("srid"), F.lit(4326)).withColumn("srid", F.lit(4326))
    boxes = [site.in_raster_systems(x, raster).first() for x in (here, there)]
    assert boxes[0]["xmin"] == 390_100.0 and boxes[1]["srid"] == 32750
    assert all(abs(boxes[0][c] - boxes[1][c]) < 5 for c in ("xmin", "ymin", "xmax", "ymax"))
    assert site.site_grid(there, raster, 16)[0].count() >= site.site_grid(here, raster, 16)[0].count() > 0


def test_cells_where_only_the_box_around_the_data_reaches_go(spark):
    """Data along a diagonal and below: what is left of the tile has the whole tile's box, but no cell above touches it."""
    mask = np.tri(64, dtype=int)
    pixels, rasters = raster_rows(spark, mask)
    tiles = spark.createDataFrame([("s", "a", 1000.0, 1968.0, 1032.0, 2000.0)], "site_id string, tile string, xmin double, ymin double, xmax double, ymax double")
    cells, info = site.site_grid(tiles, rasters, 16, pixels, least=0.0)
    got = {(r["row"], r["col"]) for r in cells.collect()}
    assert {(r, c) for r in range(4) for c in range(r + 1)} <= got <= {(r, c) for r in range(4) for c in range(min(4, r + 2))}
    told = info.first()
    assert told["n_cells_full"] == 16 and told["after_tile_filter"] == len(got) < 16
    assert site.site_grid(tiles, rasters, 16, pixels, least=0.0, keep_footprint=False)[0].count() == 16


def test_a_window_of_512_pixels_is_packed_in_seconds(spark):
    side = 512
    pixels = spark.range(side * side).select(
        F.lit("b").alias("uuid"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("seq"), F.floor(F.col("id") / side).cast("int").alias("row"),
        (F.col("id") % side).cast("int").alias("col"), (F.col("id") % 251 + 1).cast("int").alias("r"), (F.col("id") % 7).cast("int").alias("g"), F.lit(0).alias("b"),
    )
    cells = spark.createDataFrame([("b", 0, 0, side, side)], "uuid string, x int, y int, w int, h int")
    means = lambda a: a.reshape(a.shape[0] // 64, 64, a.shape[1] // 64, 64, 3).mean(axis=(1, 3))
    began = time.time()
    patches, _ = blobs.run_blobs(pixels, cells, lambda: means, tile=side, overlap=128, cell=64)
    got = {(r["prow"], r["pcol"]): r["vec"] for r in patches.collect()}
    assert time.time() - began < 60
    i = np.arange(side * side)
    want = means(np.stack([i % 251 + 1, i % 7, 0 * i], axis=1).reshape(side, side, 3).astype(float))
    assert len(got) == 64 and all(np.allclose(v, want[p]) for p, v in got.items())


def save_mask(root, name, mask, image=None, **more):
    folder = root / "v1" / "10cm" / "site" / "trainannot"
    folder.mkdir(parents=True, exist_ok=True)
    np.savez(folder / f"{name}.npz", **({"CLASSIFY": np.array(mask)} if mask is not None else more))
    if image:
        (folder.parent / "train").mkdir(exist_ok=True)
        (folder.parent / "train" / f"{image}.npz").write_bytes(b"image")


def test_statistics_are_updated_step_by_step(spark, tmp_path):
    root, kept = tmp_path / "masks", str(tmp_path / "store")
    save_mask(root, "mask_1", [[0, 2], [2, 7]], image="image_1")
    save_mask(root, "mask_2", None, OTHER=np.zeros(3))
    save_mask(root, "mask_3", np.zeros(3))
    save_mask(root, "mask_4", [[2, 99]])
    assert store.current_version(spark, kept) is None
    one = statistics.update(spark, str(root), kept, "1")
    t = one["tiles"].collect()
    assert [(r["tile_id"], r["site"], r["resolution"], r["dataset_version"], r["split"], r["total_pixels"], r["pixels_class_2"], r["pixels_class_301"], r["image_exists"]) for r in t] == [("mask_1", "site", "10cm", "v1", "train", 4, 2, 1, True)]
    assert (t[0]["annot_bbox_area_frac"], t[0]["annot_in_bbox_density"], t[0]["no_data_frac"]) == (1.0, 0.75, 0.25)
    assert sorted((r["original_class_id"], r["pixel_count"]) for r in one["tiles_orig_classes"].collect()) == [(0, 1), (2, 2), (7, 1)]
    roll = one["site_resolution"].first()
    assert (roll["n_tiles_train"], roll["median_no_data_frac"], roll["n_unique_orig_classes_union"]) == (1, 0.25, 3)

    save_mask(root, "mask_5", [[0, 0], [0, 3]])
    (root / "v1/10cm/site/train/image_1.npz").unlink()
    two = statistics.update(spark, str(root), kept, "2")
    assert store.current_version(spark, kept) == "2"
    got = {r["tile_id"]: r for r in two["tiles"].collect()}
    assert set(got) == {"mask_1", "mask_5"} and not got["mask_1"]["image_exists"] and got["mask_1"]["scanned_at"] == t[0]["scanned_at"]
    assert statistics.validate_store(spark, str(root), kept).count() == 0

    save_mask(root, "mask_5", [[0, 0], [3, 3]])
    off = statistics.validate_store(spark, str(root), kept).collect()
    assert [r["mask_path"].split("/")[-1] for r in off] == ["mask_5.npz"] and "pixels_class_3" in off[0]["mismatched"] and "no_data_frac" in off[0]["mismatched"]
    assert statistics.validate_store(spark, str(root), kept, sample=1).count() <= 1
    (root / "v1/10cm/site/trainannot/mask_1.npz").unlink()
    args = command.parser().parse_args(["update", str(root), kept, "3", "--full"])
    assert command.run(spark, args).first()["n_tiles_train"] == 1
    three = statistics.update(spark, str(root), kept, "4", pruned=True)
    assert [r["pixels_class_3"] for r in three["tiles"].collect()] == [2]
    with pytest.raises(ValueError):
        statistics.validate_store(spark, str(root), str(tmp_path / "nothing"))


def test_pruned_tiles_lose_their_class_counts(spark, tmp_path):
    root, kept = tmp_path / "masks", str(tmp_path / "store")
    save_mask(root, "mask_1", [[2, 2]])
    save_mask(root, "mask_2", [[3, 3]])
    statistics.update(spark, str(root), kept, "1")
    (root / "v1/10cm/site/trainannot/mask_1.npz").unlink()
    assert statistics.update(spark, str(root), kept, "2")["tiles"].count() == 2
    last = statistics.update(spark, str(root), kept, "3", pruned=True)
    assert [r["tile_id"] for r in last["tiles_orig_classes"].collect()] == [r["tile_id"] for r in last["tiles"].collect()] == ["mask_2"]


def test_tiles_are_read_by_their_headers(spark, tmp_path):
    folder = tmp_path / "P" / "Site 1" / "val"
    folder.mkdir(parents=True)
    gt = np.array([[0.1, 0, 500.0], [0, -0.1, 1000.0], [0, 0, 1]])
    band = np.arange(12, dtype=np.float32).reshape(3, 4)
    np.savez(folder / "a_0_0.npz", RED=band, GREEN=band, BLUE=band, GEO_TRANSFORM=gt, SRID=np.array([28350]))
    (folder / "broken.npz").write_bytes(b"no archive")
    np.savez(folder / "other.npz", X=band)
    got = {r["tile"]: r for r in npz.read_tiles(spark, str(tmp_path)).collect()}
    a = got["a_0_0"]
    assert (a["w"], a["h"], a["srid"], a["site_id"], round(a["xmax"], 6), round(a["ymin"], 6)) == (4, 3, 28350, "Site_1", 500.4, 999.7)
    assert got["broken"]["problem"] and "RED" in got["other"]["problem"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    pixels = npz.pixel_rows(npz.read_tiles(spark, str(tmp_path)), files).collect()
    assert len(pixels) == 12 and {(r["row"], r["col"]): r["g"] for r in pixels}[2, 1] == 9.0


def test_little_is_read_of_a_tile_and_other_folders_arent_listed(spark, tmp_path):
    gt, big = np.array([[0.1, 0, 500.0], [0, -0.1, 1000.0], [0, 0, 1]]), np.random.default_rng(0).random((600, 500)).astype(np.float32)
    for site_name in ("A", "B"):
        for split in ("train", "val"):
            folder = tmp_path / "p" / site_name / split
            folder.mkdir(parents=True)
            for i in range(3):
                np.savez(folder / f"t{i}.npz", RED=big, GREEN=big, BLUE=big, GEO_TRANSFORM=gt, SRID=np.array([28350]))
    (tmp_path / "p/A/val/t0.npz").write_bytes(b"PK broken")
    archives.register(spark)
    rows = spark.read.format("npz_tiles").load(f"file:{tmp_path}").collect()
    size = (tmp_path / "p/A/train/t0.npz").stat().st_size
    assert len(rows) == 12 and {r["tile"] for r in rows if r["problem"]} == {"t0"}
    assert all((r["w"], r["h"], r["srid"]) == (500, 600, 28350) and r["bytes_read"] < 30_000 < size for r in rows if not r["problem"])
    reader = archives.TileReader({"path": f"file:{tmp_path}"})
    kept = list(reader.pushFilters([EqualTo(("split",), "val"), In(("site_id",), ("B", "C"))]))
    assert len(kept) == 2 and reader.folders() == [f"{tmp_path}/p/B/val"]
    assert npz.read_tiles(spark, str(tmp_path)).where("split = 'val' and site_id = 'B'").count() == 3
    assert npz.read_tiles(spark, str(tmp_path / "p/A/train")).count() == 0  # no folder of a split below


def test_blobs_from_tiles_to_metadata(spark):
    files = spark.createDataFrame(
        [("s", "d/train/b_0_0.npz", [1.0]), ("s", "d/val/b_0_0.npz", [2.0]), ("s", "d/train/b_16_0.npz", [3.0]), ("s", "d/train/readme.npz", [4.0])], "site string, path string, geo_transform array<double>"
    )
    found = {(r["x"], r["y"]): (r["path"], r["geo_transform"]) for r in blobs.discovered(files).collect()}
    assert found == {(0, 0): ("d/val/b_0_0.npz", [1.0]), (16, 0): ("d/train/b_16_0.npz", [1.0])}
    cells = spark.createDataFrame([("b", 0, 0, 16, 16), ("b", 16, 0, 16, 16), ("k", 0, 0, 8, 8)], "uuid string, x int, y int, w int, h int")
    rows = [("b", x, 0, 1, r, c, 1 + x + c, r, 0) for x in (0, 16) for r in range(16) for c in range(16)] + [("k", 0, 0, 1, r, c, 0, 0, 0) for r in range(8) for c in range(8)]
    pixels = spark.createDataFrame(rows, "uuid string, x int, y int, seq int, row int, col int, r int, g int, b int")
    means = lambda a: a.reshape(a.shape[0] // 8, 8, a.shape[1] // 8, 8, 3).mean(axis=(1, 3))
    patches, meta = blobs.run_blobs(pixels, cells, lambda: means, tile=16, overlap=8, cell=8)
    got = {(r["prow"], r["pcol"]): (r["vec"], r["n"]) for r in patches.collect()}
    image = np.array([[[1 + c, r, 0] for c in range(32)] for r in range(16)], float)
    assert set(got) == {(r, c) for r in range(2) for c in range(4)}
    assert all(np.allclose(v, means(image)[p]) for p, (v, _) in got.items()) and got[0, 1][1] == 2
    told = {r["uuid"]: r for r in meta.collect()}
    assert told["b"]["patch_grid"].asDict() == {"rows": 2, "cols": 4, "patches": 8, "dim": 3} and told["k"]["patch_grid"] is None
    assert told["k"]["boxes"].asDict() == {"planned": 1, "embedded": 0} and told["b"]["boxes"].asDict() == {"planned": 3, "embedded": 3}
    assert blobs.totals(meta).first().asDict() == {"n_blobs": 2, "n_patches": 8, "n_boxes": 3, "n_embedded": 1}
    assert store.flattened(meta).columns[:3] == ["uuid", "size.width", "size.height"]


def made_embedder():
    return lambda x: (x * 2, x[:, :, None] + np.arange(4))


def made_means():
    return lambda a: a.reshape(a.shape[0] // 8, 8, a.shape[1] // 8, 8, 3).mean(axis=(1, 3))


def test_sites_and_blobs_by_command(spark, tmp_path):
    gt = np.array([[0.5, 0, 1000.0], [0, -0.5, 2000.0], [0, 0, 1]])
    for name in ("a", "b", "c"):
        folder = tmp_path / "tiles" / name / "train"
        folder.mkdir(parents=True)
        np.savez(folder / "t.npz", RED=np.ones((20, 40), np.float32), GEO_TRANSFORM=gt, SRID=np.array([32750]))
    rasters = spark.createDataFrame([(x, 64, 64, GT, 32750) for x in "abc"], "site_id string, width int, height int, geo_transform array<double>, srid int")
    rasters.write.parquet(str(tmp_path / "rasters"))
    (tmp_path / "c.toml").write_text("[grid]\npatch = 16\n")
    out = str(tmp_path / "out")
    run = lambda *a: command.run(spark, command.parser().parse_args([*map(str, a)])).collect()
    here = "tests.test_sites"
    told = run("run-sites", tmp_path / "tiles", tmp_path / "rasters", out, "--patch", 16, "--embedder", f"{here}:made_embedder", "--cells", f"{here}:pixels_of", "--patches", "--shard", "0/2", "--config", tmp_path / "c.toml")
    assert sorted((r["site_id"], r["status"], r["n_cells"]) for r in told) == [("a", "ok", 6), ("c", "ok", 6)]
    assert [(r["n_sites"], r["sites"], r["settings"]["grid.patch"]) for r in spark.read.json(f"{out}/runs").collect()] == [(2, ["a", "c"], "16")]
    assert [(r["site_id"], r["ok"], r["problems"]) for r in run("audit", out)] == [("a", True, []), ("c", True, [])] and run("audit", out, "--unowned") == []
    assert run("status", out, "--site", "c")[0]["stored_grid"] == [2, 2]
    rows = [("b", 0, 0, 1, r, c, 1 + c, r, 0) for r in range(16) for c in range(16)]
    spark.createDataFrame(rows, "uuid string, x int, y int, seq int, row int, col int, r int, g int, b int").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("b", 0, 0, 16, 16)], "uuid string, x int, y int, w int, h int").write.parquet(str(tmp_path / "k"))
    sums = run("run-blobs", tmp_path / "p", tmp_path / "k", tmp_path / "blobs", "--embedder", f"{here}:made_means", "--tile", 16, "--overlap", 8)
    assert sums[0].asDict() == {"n_blobs": 1, "n_patches": 4, "n_boxes": 1, "n_embedded": 1}


def test_patches_and_catalog_by_command(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, 0, j, [float(i), float(j)]) for i in range(3) for j in range(2)], "site_id string, cell_id bigint, prow int, pcol int, vec array<float>")
    path = str(tmp_path / "patches")
    store.write_patches(rows, path)
    assert store.read_cells(spark, path).where("cell_id = 1 and pcol = 1").first()["vec"] == [1.0, 1.0]
    assert [tuple(r) for r in store.patch_shapes(store.read_cells(spark, path)).collect()] == [("s", 3, 1, 2, 2)]
    (tmp_path / "c.json").write_text('{"P/b": {"resolutions": ["10cm"]}, "P/a": {"resolutions": []}, "Q/c": {"resolutions": []}}')
    catalog = str(tmp_path / "c.json")
    run = lambda *a: [r["site_key"] for r in command.run(spark, command.parser().parse_args(["sites", catalog, *a])).collect()]
    assert run() == ["P/b", "P/a", "Q/c"] and run("--shard", "1/2") == ["P/a"] and run("--prefix", "P/", "--limit", "1") == ["P/b"] and run("--pick", "q/") == ["Q/c"]
    store.append_run(spark.createDataFrame([("r1", ["s"])], "run_id string, sites array<string>"), str(tmp_path / "runs"))
    store.append_run(spark.createDataFrame([("r2", ["t"])], "run_id string, sites array<string>"), str(tmp_path / "runs"))
    assert sorted(r["run_id"] for r in spark.read.json(str(tmp_path / "runs")).collect()) == ["r1", "r2"]
