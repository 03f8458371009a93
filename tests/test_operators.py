"""Operators on small cases worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.functions import geo, names, vectors
from tessera.operators import embedding, maintenance, percentiles, runs, spatial, stats, tiling
from tessera.sources import store
from tessera.streaming.incremental import append_stream


def one(df):
    return df.collect()[0].asDict()


def test_tile_box_uses_the_geotransform(spark):
    df = spark.createDataFrame([([0.1, 0.0, 500.0, 0.0, -0.1, 1000.0, 0.0, 0.0, 1.0], 384, 384)], "gt array<double>, w int, h int")
    box = one(df.select(*[F.round(v, 6).alias(k) for k, v in geo.tile_box(F.col("gt"), F.col("w"), F.col("h")).items()]))
    assert box == {"xmin": 500.0, "ymin": 961.6, "xmax": 538.4, "ymax": 1000.0}


@pytest.mark.parametrize(
    ("res", "high", "want"), [(0.05, False, (1024, 1, 0.8)), (0.07, False, (512, 2, 0.56)), (0.1, True, (512, 4, 0.4)), (0.15, False, (256, 4, 0.6)), (0.15, True, (256, 8, 0.3))]
)
def test_resolution_policy_is_strict_at_its_bounds(spark, res, high, want):
    p = geo.resolution_policy(F.lit(res), high)
    row = spark.range(1).select(p["patch_px"], p["upsample"], F.round(p["embed_gsd"], 6)).first()
    assert tuple(row) == want


@pytest.mark.parametrize(("extent", "want"), [(100, [0]), (512, [0]), (1000, [0, 384, 488]), (1001, [0, 384, 488]), (2055, [0, 384, 768, 1152, 1536])])
def test_window_starts(spark, extent, want):
    assert spark.range(1).select(tiling.window_starts(F.lit(extent), 512, 384, 8)).first()[0] == want


def test_window_starts_need_a_stride():
    with pytest.raises(ValueError):
        tiling.window_starts(F.lit(10), 512, 0, 8)


def test_tile_rows_of_a_small_mask(spark):
    mask = [0, 0, 0, 0, 0, 7, 2, 0, 0, 303, 9003, 0, 0, 0, 0, 0]
    rows = [("t", "s", "10cm", "v1", "train", "m1", 4, 4, mask, None), ("u", "s", "10cm", "v1", "train", "m2", 1, 2, [99, 2], None), ("n", "s", "10cm", "v1", "val", "m3", 1, 2, [0, 255], None), ("b", "s", "10cm", "v1", "val", "m4", None, None, None, "bad")]
    kinds = "tile_id string, site string, resolution string, dataset_version string, split string, mask_path string, height int, width int, classify array<int>, problem string"
    wide, long = stats.tile_rows(spark.createDataFrame(rows, kinds))
    got = {r["tile_id"]: r for r in wide.collect()}
    assert set(got) == {"t", "n"}
    t = got["t"]
    assert (t["total_pixels"], t["pixels_no_data"], t["pixels_class_301"], t["pixels_class_2"], t["pixels_class_3"], t["pixels_unmapped"]) == (16, 12, 2, 1, 1, 0)
    assert (t["no_data_frac"], t["annot_bbox_area_frac"], t["annot_in_bbox_density"], t["n_unique_orig_classes"]) == (0.75, 0.25, 1.0, 5)
    assert (got["n"]["annot_bbox_area_frac"], got["n"]["annot_in_bbox_density"]) == (0.0, 0.0)
    assert {r["tile_id"] for r in long.collect()} == {"t", "n"}


def test_rollup_fractions(spark):
    rows = [("s", "r", "v1", "val", 10, 1, x) for x in (0.1, 0.5, 0.7, 0.95, 1.0, 0.3)]
    t = spark.createDataFrame(rows, "site string, resolution string, dataset_version string, split string, total_pixels int, pixels_no_data int, no_data_frac double")
    r = one(stats.site_rollup(t, spark.createDataFrame([], "site string, resolution string, original_class_id int")))
    assert (round(r["median_no_data_frac"], 6), round(r["p90_no_data_frac"], 6), r["n_tiles_train"], r["n_unique_orig_classes_union"]) == (0.6, 0.975, 0, 0)
    assert r["frac_tiles_mostly_no_data"] == pytest.approx(2 / 6)


def test_tile_names(spark):
    df = spark.createDataFrame([("image_ab_part_384_0.npz",), ("other.txt",)], "n string")
    got = [tuple(r) for r in df.select(names.tile_key(F.col("n")), names.tile_col(F.col("n")), names.tile_row(F.col("n"))).collect()]
    assert got == [("ab", 384, 0), (None, None, None)]


def test_site_ids_that_collide_are_told(spark):
    df = spark.createDataFrame([("A B",), ("A_B",), ("C",)], "site_key string")
    assert one(names.colliding_sites(df)) == {"site_id": "A_B", "keys": ["A B", "A_B"]}


def test_pairing_prefers_the_same_name(spark):
    masks = spark.createDataFrame([("d/trainannot/mask_1.npz",), ("d/trainannot/x.npz",), ("d/trainannot/mask_9.npz",)], "mask_path string")
    images = spark.createDataFrame([("d/train/image_1.npz",), ("d/train/x.npz",)], "image_path string")
    got = {r["mask_path"][-10:]: (r["image_path"], r["image_exists"]) for r in maintenance.pair_images(masks, images).collect()}
    assert got == {"mask_1.npz": ("d/train/image_1.npz", True), "nnot/x.npz": ("d/train/x.npz", True), "mask_9.npz": (None, False)}


def test_deduplication_keeps_conflicts_when_verified(spark):
    rows = [("b.npz", "i1", True, "x"), ("mask_a.npz", "i1", True, "x"), ("c.npz", "i2", True, "x"), ("d.npz", "i2", True, "y"), ("e.npz", None, False, "z")]
    t = spark.createDataFrame(rows, "mask_path string, image_path string, image_exists boolean, content string")
    plain = sorted(r[0] for r in maintenance.deduplicated(t).select("mask_path").collect())
    careful = sorted(r[0] for r in maintenance.deduplicated(t, True, F.col("content")).select("mask_path").collect())
    assert plain == ["c.npz", "e.npz", "mask_a.npz"]
    assert careful == ["c.npz", "d.npz", "e.npz", "mask_a.npz"]


def test_validation_takes_nulls_as_differences(spark):
    a = spark.createDataFrame([("t", 1, 1.0), ("u", 2, 5.0), ("v", 3, 1.0)], "k string, n int, x double")
    b = spark.createDataFrame([("t", 1, 1.000001), ("u", 2, None)], "k string, n int, x double")
    got = {r["k"]: r["mismatched"] for r in maintenance.validate(a, b, ["k"], ["n"], ["x"]).collect()}
    assert got == {"u": ["x"], "v": ["n", "x"]}


def test_box_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [[(int(i), float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.uniform(0, 50, (60, 4)) * [1, 1, 0.2, 0.2])] for _ in range(2)]
    kinds = "id int, xmin double, ymin double, xmax double, ymax double"
    a, b = (spark.createDataFrame(r, kinds) for r in rows)
    want = {(p[0], q[0]) for p in rows[0] for q in rows[1] if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    got = [tuple(r) for r in spatial.box_join(a, b, 7.0).select("a.id", "b.id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["id"] for r in spatial.box_semi_join(a, b, 7.0).collect()} == {p for p, _ in want}


def test_study_area_of_two_squares(spark):
    boxes = spark.createDataFrame([("s", 0.0, 0.0, 1000.0, 1000.0), ("s", 500.0, 0.0, 2000.0, 1000.0), ("t", 0.0, 0.0, 10.0, 10.0)], "site_id string, xmin double, ymin double, xmax double, ymax double")
    got = {r["site_id"]: r for r in spatial.study_area(boxes, ["site_id"]).collect()}
    assert (got["s"]["area_km2"], got["s"]["perim_km"], got["s"]["fill_ratio"]) == pytest.approx((2.0, 6.0, 1.0))
    assert got["t"]["area_km2"] == pytest.approx(1e-4)


def test_mixed_srids_raise(spark):
    with pytest.raises(ValueError):
        spatial.one_srid(spark.createDataFrame([(1,), (2,)], "srid int"))


def test_padding_repeats_the_edge(spark):
    pixels = spark.createDataFrame([("b", 0, 0, 1), ("b", 0, 1, 2)], "k string, row int, col int, v int")
    sizes = spark.createDataFrame([("b", 1, 2, 2, 4)], "k string, h int, w int, new_h int, new_w int")
    got = {(r["row"], r["col"]): r["v"] for r in tiling.pad_by_edge(pixels, sizes, "k").collect()}
    assert got == {(r, c): 1 if c == 0 else 2 for r in range(2) for c in range(4)}


def test_pca_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=(200, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    mean, parts = embedding.fit_pca(df, "v", 2, normalise=False)
    _, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(mean, x.mean(axis=0))
    for k in range(2):
        assert abs(abs(parts[k] @ vectors[:, -1 - k]) - 1) < 1e-9


def test_normalising_takes_time_in_proportion_to_the_dimension(spark):
    plan = lambda d: spark.range(1).select(F.sequence(F.lit(1), F.lit(d)).alias("v")).select(vectors.l2_normalise(F.col("v")).alias("u"))
    u = np.array(plan(3000).first()["u"])
    x = np.arange(1, 3001)
    assert np.allclose(u, x / (np.linalg.norm(x) + 1e-8))


def test_snapping_takes_rotation_into_account(spark):
    a = np.radians(30)
    gt = list(map(float, (0.5 * np.cos(a), 0.5 * np.sin(a), 100.0, 0.5 * np.sin(a), -0.5 * np.cos(a), 200.0, 0.0, 0.0, 1.0)))
    box = (103.0, 170.0, 120.0, 190.0)
    m = np.linalg.inv(np.array(gt).reshape(3, 3))
    corners = np.array([m @ [x, y, 1] for x in box[::2] for y in box[1::2]])[:, :2]
    (c0, r0), (c1, r1) = np.floor(corners.min(axis=0)), np.ceil(corners.max(axis=0))
    df = spark.createDataFrame([(gt,)], "gt array<double>")
    got = one(df.select(*[v.alias(k) for k, v in geo.snap_to_patch(*map(F.lit, box), F.col("gt"), F.lit(16)).items()]))
    assert got == {"col0": c0, "row0": r0, "w_px": -(-(c1 - c0) // 16) * 16, "h_px": -(-(r1 - r0) // 16) * 16}


def test_percentiles_of_skewed_groups_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=5000), "b": np.r_[np.zeros(3000), 1e9, -1e9, rng.random(10)], "c": np.array([3.0]), None: np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    got = {r["k"]: (r["p0"], r["p1"], r["p2"]) for r in percentiles.exact_percentiles(df, ["k"], F.col("x"), [0.0, 0.37, 0.98]).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.0, 0.37, 0.98])))
    assert percentiles.exact_percentiles(df.limit(0), [], F.col("x"), [0.5]).count() == 0


def test_pooled_means_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), None if i % 7 == 0 else "x", rng.normal(size=4).tolist()) for i in range(300)] + [(9, "x", None)]
    got = embedding.mean_pool(spark.createDataFrame(rows, "a int, b string, v array<float>").repartition(5), ["a", "b"], "v").collect()
    want = {}
    for a, b, v in rows:
        if v:
            want.setdefault((a, b), []).append(v)
    assert {(r["a"], r["b"]) for r in got} == set(want)
    for r in got:
        assert r["mean"] == pytest.approx(np.mean(want[r["a"], r["b"]], axis=0)[r["pos"]], rel=1e-5)


def test_duplicates_with_equal_places_leave_one(spark):
    t = spark.createDataFrame([("i", "a", True, "x")] * 3 + [("i", "b", True, "x")], "image_path string, mask_path string, image_exists boolean, content string")
    assert [r["mask_path"] for r in maintenance.deduplicated(t).collect()] == ["a"]
    places = sorted(r["place"] for r in maintenance.duplicates(t, F.col("image_path"), [F.col("mask_path")], F.col("content"), ranked=True).collect())
    assert places == [1, 2, 3, 4]


def test_clusters_are_the_best_of_the_seeds(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 3)) * 10
    x = np.concatenate([c + rng.normal(size=(30, 3)) * 0.1 for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    got = embedding.kmeans(df, "v", 5).toPandas().sort_values("i")["cluster"].to_numpy()
    cost = sum(((x[got == k] - x[got == k].mean(axis=0)) ** 2).sum() for k in range(5))
    best = sum(((x[30 * k : 30 * k + 30] - x[30 * k : 30 * k + 30].mean(axis=0)) ** 2).sum() for k in range(5))
    assert cost == pytest.approx(best)
    angles = embedding.kmeans(df, "v", 2, seeds=2, cosine=True).select("cluster").distinct().count()
    assert angles == 2 and not spark.sparkContext._jsc.getPersistentRDDs()


def test_three_components_as_colours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)) * [6, 4, 3, 1, 1, 1] + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    got = embedding.pca_rgb(df, "v").toPandas().sort_values("i")
    _, basis = np.linalg.eigh(np.cov(x.T))
    for k, c in enumerate("rgb"):
        p = (x - x.mean(axis=0)) @ basis[:, -1 - k]
        low, high = np.quantile(p, [0.02, 0.98])
        want = np.clip((p - low) / (high - low + 1e-6), 0, 1)
        assert np.allclose(got[c], want, atol=1e-5) or np.allclose(got[c], 1 - want, atol=1e-5)


def test_boxes_are_embedded_and_blended(spark):
    h, w, cell = 8, 12, 4
    image = np.arange(h * w * 3, dtype=float).reshape(h, w, 3)
    windows = [(0, 0, 8, 8), (0, 4, 8, 8)]
    bands = lambda r, c, hh, ww: [image[r : r + hh, c : c + ww, b].ravel()[::-1].tolist() for b in range(3)]
    rows = [("u", r, c, hh, ww, list(range(hh * ww))[::-1], *bands(r, c, hh, ww)) for r, c, hh, ww in windows]
    boxes = spark.createDataFrame(rows, "uuid string, row_px int, col_px int, h_px int, w_px int, at array<int>, r array<double>, g array<double>, b array<double>")
    means = lambda a: a.reshape(a.shape[0] // cell, cell, a.shape[1] // cell, cell, 3).mean(axis=(1, 3))
    got = {(r["prow"], r["pcol"]): (r["vec"], r["n"]) for r in embedding.embed_boxes(boxes, lambda: means, cell).collect()}
    want = means(image)
    assert len(got) == 6 and all(np.allclose(v, want[p]) for p, (v, _) in got.items())
    assert {p for p, (_, n) in got.items() if n == 2} == {(0, 1), (1, 1)}


def test_tokens_become_patch_rows(spark):
    cells = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in range(5)], "cell_id int, x array<float>")
    model = lambda: lambda x: (x[:, :2] * 2, np.stack([x, x + 10], axis=1))
    found = embedding.embed_tokens(cells, "x", model, batch=2)
    rows = {(r["cell_id"], r["prow"], r["pcol"]): r["vec"] for r in embedding.patch_rows(found, "tokens", ["cell_id"]).collect()}
    assert len(rows) == 20 and rows[3, 0, 0] == [3.0, 13.0] and rows[3, 1, 0] == [2.0, 12.0]
    assert found.where("cell_id = 4").first()["cls"] == [8.0, 2.0]


def test_settings_from_toml():
    assert session.read_settings('name = "x"\n[grid]\npatch = 16\n[grid.void]\nleast = 0.02') == {"name": "x", "grid.patch": 16, "grid.void.least": 0.02}


def test_samples_take_each_file_in_equal_parts(spark):
    rows = spark.createDataFrame([(f"f{i % 3}", i) for i in range(60)], "file string, id int")
    got = runs.sampled_by_file(rows, 10, "file", "id", seed=3)
    assert sorted(r["n"] for r in got.groupBy("file").agg(F.count("*").alias("n")).collect()) == [3, 3, 3]
    again = runs.sampled_by_file(rows.repartition(5), 10, "file", "id", seed=3)
    assert got.exceptAll(again).count() == 0 and runs.sampled(rows, 7, "id").count() == 7


def test_status_and_shards(spark):
    sites = spark.createDataFrame([(c,) for c in "abcdefg"], "k string")
    assert [r["k"] for r in runs.shard(sites, "k", 1, 3).collect()] == ["b", "e"]
    assert [r["k"] for r in runs.shard(sites, "k", 1, 3, 1).collect()] == ["b"]
    done = spark.createDataFrame([("a", True, True), ("b", True, False)], "k string, has_cells boolean, has_meta boolean")
    assert sorted(r["k"] for r in runs.to_do(sites, done, "k").collect()) == list("bcdefg")


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"P/b": {"resolutions": ["10cm", "3cm"]}, "P/a": {"resolutions": []}}')
    got = [(r["pos"], r["site_key"], r["default_res"]) for r in store.read_catalog(spark, str(tmp_path / "c.json")).collect()]
    assert got == [(0, "P/b", "10cm"), (1, "P/a", None)]


def test_append_stream_adds_each_key_once(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "mask_path string, n int")
    for turn in range(2):
        rows.withColumn("n", F.col("n") + turn).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        append_stream(stream, table, str(tmp_path / "check"), "mask_path").awaitTermination()
    assert sorted((r["mask_path"], r["n"]) for r in spark.read.parquet(table).collect()) == [("a", 1), ("b", 2)]


def test_integrity_finds_faults(spark):
    cells = spark.createDataFrame([("s", 0, "s#0", [1.0]), ("s", 2, "s#1", [1.0])], "site_id string, cell_id bigint, patch_ref string, cls array<double>")
    meta = spark.createDataFrame([("s", 2, 1), ("t", 1, 1)], "site_id string, n_cells bigint, embed_dim int")
    patches = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 1.0)], "site_id string, cell_id bigint, max_abs double")
    got = {r["site_id"]: r for r in runs.integrity(cells, meta, patches).collect()}
    assert got["s"]["problems"] == ["cell ids aren't 0 to n - 1", "patch references differ from cell ids", "patches are empty"]
    assert got["t"]["problems"] == ["no cells", "no patches"] and not got["t"]["ok"]
