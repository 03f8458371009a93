"""Whole runs, stores and their audit over the driver's tables, and operators beside them: footprints, masks, links, shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import embedding, maintenance, polygons, runs, spatial, stats
from tessera.plans import audit, site, statistics
from tessera.plans.queries import _BOXES, boxes, dealt, query, r6, read
from tessera.plans.site_queries import _CELLS, _NEAR, PATCH, rasters
from tessera.session import work_path
from tessera.sources import store

# --- site runs -----------------------------------------------------------------------------------


def row_and_col():
    """An embedder whose class vector is its two pixels, and whose 2 x 2 patches are those and the patch's number."""
    return lambda x: (x, x[:, :, None] + np.arange(4))


def site_store(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """A store made by a run over all parts' boxes as tiles, and the run's status."""
    out = work_path(spark, "store")
    pixels = lambda cells: cells.withColumn("pixels", F.array(F.col("row").cast("float"), F.col("col").cast("float")))
    tiles = boxes(spark, sf).withColumnRenamed("p_partkey", "tile")
    return out, site.run_sites(tiles, rasters(spark, sf), out, PATCH, pixels, row_and_col, model="rows", with_patches=True)


_CUT = f"(SELECT * REPLACE (least(ymax, 900.75::DOUBLE) AS ymax) FROM {_BOXES} WHERE ymin < 900.75)"
_RUN = _NEAR.replace(_BOXES, _CUT)


@query(
    f"""SELECT site_id, cell_id, site_id || '/patches#' || CAST(cell_id AS VARCHAR) AS patch_ref, r AS c0, k AS c1, CAST(4 AS BIGINT) AS n_patches, r + 3 AS last0, k + 3 AS last1
 FROM (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY "row", col) - 1 AS cell_id, CAST("row" AS DOUBLE) AS r, CAST(col AS DOUBLE) AS k FROM {_RUN})"""
)
def site_run(spark: SparkSession, sf: str) -> DataFrame:
    """Cells as a run stores them, with the patches that their references name."""
    out, _ = site_store(spark, sf)
    last = F.max_by("vec", F.struct("prow", "pcol"))
    patches = store.read_cells(spark, f"{out}/patches").groupBy("site_id", "cell_id").agg(F.count("*").alias("n_patches"), last.alias("last"))
    cells = store.read_cells(spark, f"{out}/cells").select("site_id", "cell_id", "patch_ref", *[F.col("cls")[i].cast("double").alias(f"c{i}") for i in (0, 1)])
    return cells.join(patches, ["site_id", "cell_id"]).select(*cells.columns, "n_patches", *[F.col("last")[i].cast("double").alias(f"last{i}") for i in (0, 1)])


@query(
    f"""SELECT site_id, 'ok' AS status, n_cells, n_cells_full, 2 AS embed_dim, '2,2' AS patch_grid, 8.0::DOUBLE AS patch_ground_m, 'rows' AS model FROM
 (SELECT site_id, count(*) AS n_cells FROM {_RUN} GROUP BY 1) JOIN (SELECT site_id, count(*) AS n_cells_full FROM {_CELLS.replace(_BOXES, _CUT)} GROUP BY 1) USING (site_id)"""
)
def site_run_report(spark: SparkSession, sf: str) -> DataFrame:
    """What a run says of its sites, and the metadata that it stores of them."""
    out, status = site_store(spark, sf)
    meta = store.read_site_meta(spark, f"{out}/meta")
    told = meta.select("site_id", "n_cells_full", F.col("embed_dim").cast("int").alias("embed_dim"), F.array_join(F.col("patch_grid").cast("array<string>"), ",").alias("patch_grid"), "patch_ground_m", "model")
    return status.select("site_id", "status", "n_cells").join(told, "site_id")


_LABELLED = "(SELECT coalesce('s' || CAST(label AS VARCHAR), 'none') AS site_id, coalesce(label, 0) % 5 AS fault, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cell_id FROM embeddings)"


@query(
    f"""SELECT site_id, fault NOT IN (1, 2, 3) AS ok, CASE fault WHEN 1 THEN 'cells and metadata differ in number' WHEN 2 THEN 'cells and patches differ in number; ' || CAST((n + 2) // 3 AS VARCHAR) || ' cells without patches'
 WHEN 3 THEN 'patch references differ from cell ids' ELSE '' END AS problems FROM (SELECT site_id, fault, count(*) AS n FROM {_LABELLED} GROUP BY 1, 2)"""
)
def store_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A store of the embeddings, a site a label, with faults by label: the audit finds each."""
    out, label = work_path(spark, "store"), F.coalesce("label", F.lit(0)) % 5
    site_id = F.coalesce(F.concat(F.lit("s"), F.col("label").cast("string")), F.lit("none"))
    e = read(spark, sf, "embeddings").select("vec_id", label.alias("fault"), site_id.alias("site_id"), F.col("embedding").alias("cls"))
    cells = spatial.with_cell_ids(e.withColumn("row", F.floor(F.col("vec_id") / 64)).withColumn("col", F.col("vec_id") % 64))
    ref = F.concat("site_id", F.lit("/patches#"), (F.col("cell_id") + F.when(F.col("fault") == 3, 1).otherwise(0)).cast("string"))
    store.write_cells(cells.select("site_id", "cell_id", ref.alias("patch_ref"), "cls"), f"{out}/cells")
    whole = cells.where("fault != 2 or cell_id % 3 != 0")
    store.write_patches(whole.select("site_id", "cell_id", F.lit(0).alias("prow"), F.lit(0).alias("pcol"), F.col("cls").alias("vec")), f"{out}/patches")
    meta = cells.groupBy("site_id", "fault").agg(F.count("*").alias("n"), F.max(F.size("cls")).alias("embed_dim"))
    meta = meta.select("site_id", (F.col("n") + F.when(F.col("fault") == 1, 1).otherwise(0)).alias("n_cells"), "embed_dim", F.array(F.lit(1), F.lit(1)).alias("patch_grid"), F.lit(8.0).alias("cell_ground_m"))
    store.write_site_meta(meta, f"{out}/meta")
    return audit.audited(spark, out).select("site_id", "ok", F.array_join("problems", "; ").alias("problems"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 3 <> 0")
def committed_version(spark: SparkSession, sf: str) -> DataFrame:
    """The table of the version that was committed last; a writer that builds on an older one gets nothing in."""
    root, p = work_path(spark, "tables"), read(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    store.write_tables({"part": p}, root, "all", None)
    store.write_tables({"part": p.where("p_partkey % 3 != 0")}, root, "some", "all")
    try:
        store.write_tables({"part": p.limit(0)}, root, "none", "all")
    except store.Conflict:
        return store.read_table(spark, root, "part")
    raise AssertionError("a stale writer has committed")


# --- areas and footprints ------------------------------------------------------------------------


@query(
    f"""SELECT site_id, count(*) * 0.25::DOUBLE AS union_m2 FROM (SELECT DISTINCT site_id, x, y FROM {_BOXES}, LATERAL (SELECT unnest(range(CAST(xmin * 2 AS BIGINT), CAST(xmax * 2 AS BIGINT))) AS x),
 LATERAL (SELECT unnest(range(CAST(ymin * 2 AS BIGINT), CAST(ymax * 2 AS BIGINT))) AS y)) GROUP BY 1"""
)
def union_areas(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.union_area(boxes(spark, sf), ["site_id"], 100.0).withColumn("union_m2", F.round("union_m2", 4))


_BLOCK = "(SELECT p_partkey, p_brand AS site_id, p_partkey % 97 * 20 AS c0, p_partkey // 97 * 20 AS r0, p_size % 16 + 1 AS w, 5 + p_size % 9 AS h FROM part)"


@query(
    f"""SELECT site_id, count(*) AS n, sum(w * h) * 0.25::DOUBLE AS area, min(c0) * 0.5::DOUBLE - 3.25 AS xmin, 900.75 - min(r0) * 0.5::DOUBLE AS ymax FROM {_BLOCK} WHERE w * h >= 64 GROUP BY 1"""
)
def footprint_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Rasters with a block of data for each part, apart from each other: small ones are speckle, the others polygons."""
    k, size = F.col("p_partkey"), F.col("p_size")
    b = read(spark, sf, "part").select(F.col("p_brand").alias("site_id"), (k % 97 * 20).alias("c0"), (F.floor(k / 97) * 20).alias("r0"), (size % 16 + 1).alias("w"), (5 + size % 9).alias("h"))
    b = dealt(b, 50_000, "site_id", "r0")
    span = lambda at, n: F.explode(F.sequence(F.col(at).cast("int"), (F.col(at) + F.col(n) - 1).cast("int")))
    pixels = b.select("site_id", "r0", "h", span("c0", "w").alias("col")).select("site_id", span("r0", "h").alias("row"), "col", F.lit(1).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    found = polygons.footprint_polygons(pixels, rasters(spark, sf).withColumn("height", F.lit(1 << 20)), max_side=1 << 20)
    pieces = polygons.trapezoids(found, ["site_id", "region"])
    area = (F.col("xr0") - F.col("xl0") + F.col("xr1") - F.col("xl1")) / 2 * (F.col("y1") - F.col("y0"))
    told = pieces.groupBy("site_id").agg(F.countDistinct("region").alias("n"), F.round(F.sum(area), 4).alias("area"), F.round(F.min("xmin"), 4).alias("xmin"), F.round(F.max("ymax"), 4).alias("ymax"))
    return told


# --- masks, links and shards ---------------------------------------------------------------------


@query(
    """SELECT l_orderkey, list_sort(list(DISTINCT c))::VARCHAR AS ids, CAST(count(*) FILTER (c <> 0) AS BIGINT) AS annotated, CAST(coalesce(min(i) FILTER (c <> 0), -1) AS INTEGER) AS col0, CAST(coalesce(max(i) FILTER (c <> 0), -1) AS INTEGER) AS col1
 FROM (SELECT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 5 + 2 END AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem) GROUP BY 1"""
)
def mask_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of one row of pixels, an order each: their ids and the box around what is annotated."""
    k = F.col("l_partkey")
    pixel = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(k % 3 == 0, 0).otherwise(k % 5 + 2).cast("int").alias("c"))
    rows = dealt(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 500_000, "l_orderkey")
    masks = rows.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(pixel)), lambda p: p["c"]).alias("classify")).withColumn("width", F.size("classify"))
    ids = F.concat(F.lit("["), F.array_join(F.col("class_ids").cast("array<string>"), ", "), F.lit("]"))
    return stats.summarised(masks).select("l_orderkey", ids.alias("ids"), "annotated", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("col0", "col1")])


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/d/' || p_brand || '/train/mask_' || p_partkey || '.npz' WHEN 1 THEN '/d/' || p_brand || '/train/image_' || p_partkey || '.npz' END AS image_path, p_partkey % 3 <> 2 AS image_exists FROM part"""
)
def image_links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = read(spark, sf, "part").select(k, F.concat(F.lit("/d/"), "p_brand", F.lit("/train")).alias("at"), F.concat(k.cast("string"), F.lit(".npz")).alias("name"))
    masks = p.select("p_partkey", F.concat("at", F.lit("annot/mask_"), "name").alias("mask_path"))
    images = p.where(k % 3 != 2).select(F.concat("at", F.when(k % 3 == 0, "/mask_").otherwise("/image_"), "name").alias("image_path"))
    return maintenance.pair_images(masks, images).select("p_partkey", "image_path", "image_exists")


@query("SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer) WHERE n % 7 = 2 AND n // 7 < 40")
def limited_shard(spark: SparkSession, sf: str) -> DataFrame:
    return runs.shard(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 2, 7, 40)


@query("SELECT CAST(p_partkey AS INTEGER) AS p_partkey, CAST(p_size AS SMALLINT) AS p_size, CAST(NULL AS VARCHAR) AS image_path, CAST(p_retailprice AS BIGINT) AS p_retailprice FROM (SELECT p_partkey, p_size, floor(p_retailprice) AS p_retailprice FROM part)")
def coerced_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").withColumn("p_retailprice", F.floor("p_retailprice"))
    return statistics.coerced(rows, "p_partkey int, p_size smallint, image_path string, p_retailprice bigint")


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT i, avg(v) AS mu FROM x GROUP BY 1), c AS (SELECT vec_id, x.i, v - mu AS v FROM x JOIN m ON m.i = x.i)
 SELECT CAST(a.i AS BIGINT) AS i, CAST(b.i AS BIGINT) AS j, round(sum(a.v * b.v), 4) + 0.0 AS s FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i < 8 AND b.i <= a.i GROUP BY 1, 2"""
)
def scatter_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of products of the embeddings' first eight numbers about their mean, added up task by task."""
    rows = read(spark, sf, "embeddings").select(F.slice("embedding", 1, 8).cast("array<double>").alias("v"))
    sums = embedding.added_up(embedding.per_task(rows, lambda x: np.r_[len(x), x.sum(axis=0)]))
    mean = sums[1:] / sums[0]
    square = embedding.added_up(embedding.per_task(rows, lambda x: (x - mean).T @ (x - mean))).reshape(8, 8)
    found = spark.createDataFrame([(i, j, float(square[i, j])) for i in range(8) for j in range(i + 1)], "i long, j long, s double")
    return found.withColumn("s", F.round("s", 4) + 0.0)


@query("SELECT site_id, xmin::DOUBLE AS xmin, ymin::DOUBLE AS ymin, xmax::DOUBLE AS xmax, ymax::DOUBLE AS ymax FROM (SELECT DISTINCT p_brand AS site_id FROM part), (SELECT -3.25 AS xmin, 900.75 - 1900 * 0.5 AS ymin, -3.25 + 2000 * 0.5 AS xmax, 900.75 AS ymax)")
def raster_extents(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.lit(0)
    box = geo.pixel_box_to_world(F.col("geo_transform"), zero, zero, F.col("width"), F.col("height"))
    return rasters(spark, sf).select("site_id", *[r6(v).alias(k) for k, v in box.items()])
