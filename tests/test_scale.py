"""What keeps queries in bounds on larger tables: no join that sends what explodes make to all tasks, no step in one task."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import classes as C
from tessera.operators import polygons, spatial, stats, tiling
from tessera.plans import site_queries, store_queries  # noqa: F401
from tessera.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_footprint_regions_of_one_site_are_traced_in_several_tasks(spark):
    """F1"""
    pixels = spark.createDataFrame([("s", 4 * (k // 8) + i, 4 * (k % 8) + j, 1, 0, 0) for k in range(64) for i in (0, 1) for j in (0, 1)] * 2, "site_id string, row int, col int, r int, g int, b int")
    rasters = spark.createDataFrame([("s", 40, 40, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), ("none", 9, 9, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "site_id string, width int, height int, geo_transform array<double>")
    found = polygons.footprint_polygons(pixels, rasters, least_pixels=4, tolerance=0)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    mine = [r for r in rows if r["site_id"] == "s"]
    assert len({r["region"] for r in mine}) == len(mine) == 64
    assert [r["region"] for r in rows if r["site_id"] == "none"] == [None]
    assert len({r["task"] for r in mine}) > 1
    assert polygons.trapezoids(found.where("region is not null"), ["site_id", "region"]).selectExpr("sum((xmax - xmin) * (ymax - ymin)) as a").first()["a"] == 256


def test_rings_of_a_block_are_those_of_its_edges():
    """F1"""
    x, y = polygons.rings_of(np.ones((3, 5), bool))[0]
    edges = {tuple(e) for e in polygons.straight_edges(np.ones((3, 5), bool)).tolist()}
    assert edges == {(*a, *b) for a, b in zip(zip(x, y, strict=True), zip(np.roll(x, -1), np.roll(y, -1), strict=True), strict=True)}


def test_edge_padding_sends_no_pixels_to_all_tasks(spark, data):
    """F2"""
    assert "Broadcast" not in plan(QUERIES["edge_padding"](spark, data))


def test_pad_by_edge_over_smaller_and_larger_canvases(spark):
    """F2"""
    sizes = spark.createDataFrame([(1, 2, 3, 4, 2), (2, 1, 1, 2, 2), (None, 1, 1, 1, 1)], "k int, h int, w int, new_h int, new_w int")
    pixels = spark.createDataFrame([(1, r, c, 10 * r + c) for r in range(3) for c in range(4)] + [(2, 0, 0, 7), (2, -1, 0, 8), (3, 0, 0, 9)], "k int, row int, col int, v int")
    got = sorted(tuple(r) for r in tiling.pad_by_edge(pixels, sizes, "k").select("k", "row", "col", "v").collect())
    assert got == [(1, r, c, 10 * min(r, 1) + c) for r in range(4) for c in range(2)] + [(2, r, c, 7) for r in range(2) for c in range(2)]


def test_trimmed_stitch_groups_by_hash_and_sends_no_windows_to_all_tasks(spark, data):
    """F3"""
    told = plan(QUERIES["trimmed_stitch"](spark, data))
    assert "Broadcast" not in told and "SortAggregate" not in told


def test_class_rollup_is_one_aggregate_and_one_shuffle(spark, data):
    """F5"""
    found = QUERIES["class_rollup"](spark, data)
    assert plan(found).count("Exchange hashpartitioning") == 1
    ids = [*C.ORIGINALS, *C.NO_DATA]
    rows = [("all", i, 1) for i in ids] + [("two", 2, 3), ("two", 2, 4), ("two", -128, 5), ("bad", 2, 1), ("bad", 99, 1), ("null", None, 1)]
    wide = stats.class_rollup(spark.createDataFrame(rows, "tile string, original_class_id int, pixel_count long"), ["tile"])
    assert {r["tile"]: r["n_unique_orig_classes"] for r in wide.collect()} == {"all": len(set(ids)), "two": 2}


def test_overlap_coverage_is_dealt_out_before_windows_are_made(spark, data):
    """F6"""
    told = plan(QUERIES["overlap_coverage"](spark, data))
    assert "REPARTITION_BY_NUM" in told and told.count("Exchange hashpartitioning") == 1


def test_masks_are_summarised_by_lots_as_one_by_one(spark, monkeypatch):
    """F8"""
    rng = np.random.default_rng(3)
    masks = [(i, [int(v) for v in rng.choice([0, 2, 9, -128, 40], int(rng.integers(0, 5)) * w)], w) for i, w in enumerate(rng.integers(1, 7, 300).tolist())] + [(300, [1, 2], 0), (301, [0, 15], 1)]
    got = {r["i"]: r.asDict() for r in stats.summarised(spark.createDataFrame([*masks, (302, None, 3)], "i int, classify array<int>, width int")).collect()}
    want = {i: stats.mask_summary(np.asarray(m, np.int64).reshape(-1, w) if w else np.zeros((0, 0), np.int64)) for i, m, w in masks}
    assert got == {i: {"i": i, "width": w, **want[i]} for i, _, w in masks}


def test_mask_counts_is_dealt_out_and_has_no_row_by_row_python(spark, data):
    """F8"""
    told = plan(QUERIES["mask_counts"](spark, data))
    assert "REPARTITION_BY_NUM" in told and "MapInArrow" in told


def test_box_semi_join_sends_no_buckets_to_all_tasks(spark, data):
    """F7"""
    boxes = spark.read.parquet(f"{data}/part.parquet").selectExpr("p_brand as site", "p_partkey * 1.0D as xmin", "0.0D as ymin", "p_partkey + 40.0D as xmax", "9.0D as ymax")
    found = spatial.box_semi_join(boxes, boxes, 5.0, ["site"])
    assert "Broadcast" not in plan(found)
    assert found.count() == boxes.distinct().count()


def test_weights_are_learned_on_all_training_words():
    """F4"""
    from tessera.llm import context_mixing

    words, c = [f"w{i}".encode() for i in range(1000)], np.arange(1000) % 3
    assert sorted(context_mixing.learning_order(words, c).tolist()) == np.flatnonzero(c).tolist()
    assert not hasattr(context_mixing, "LEARN_FROM")
