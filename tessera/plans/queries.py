"""The library's operators over the driver's tables, each with the same in DuckDB's SQL.

Stand-ins: orders are tiles (site: nation of the customer, resolution: market segment), lineitem rows are annotated pixels of
a tile, parts are blobs and boxes, embeddings are cells of the site ``site_<label>``, documents are mask files.
Computed fractions are rounded, as sums of floats depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import classes as C
from tessera.functions import geo, names, vectors
from tessera.operators import embedding, maintenance, runs, spatial, stats, tiling
from tessera.session import work_path
from tessera.sources.store import staged
from tessera.streaming.incremental import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def dealt(rows: DataFrame, per_task: int, *by: str) -> DataFrame:
    """``rows`` dealt out by key in parts of about ``per_task`` rows, at least one a core.

    For rows of which much is made: a small table is one split, and Spark brings small shuffles together by their bytes.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task))
    return rows.repartition(parts, *by)


def r6(c: Column) -> Column:
    return F.round(c, 6)


# --- stand-ins -----------------------------------------------------------------------------------

IDS = [*C.ORIGINALS, *C.NO_DATA, 99, 7777]  # the last two are in no map
_LIST = "[" + ", ".join(map(str, IDS)) + "]"
_ORIGINAL = f"{_LIST}[(l_suppkey % {len(IDS)}) + 1]"
_GOOD = f"{_LIST}[(l_suppkey % {len(IDS) - 2}) + 1]"
_TARGET = "CASE " + " ".join(f"WHEN c IN ({', '.join(map(str, ids))}) THEN {t}" for t, ids in {0: C.NO_DATA, **C.TARGETS}.items()) + " END"


def original(good: bool = False) -> Column:
    ids = IDS[:-2] if good else IDS
    return F.element_at(F.array(*map(F.lit, ids)), (F.col("l_suppkey") % len(ids) + 1).cast("int"))


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile"), original().alias("original_class_id"), F.col("l_quantity").cast("bigint").alias("n"))
    return stats.class_histogram(dealt(rows, 500_000, "tile"), ["tile"], count="n")


_HISTOGRAM = f"""SELECT l_orderkey AS tile, CAST(c AS INTEGER) AS original_class_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pixel_count
FROM (SELECT l_orderkey, l_quantity, {_ORIGINAL} AS c FROM lineitem) GROUP BY 1, 2"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (read(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("tile_id"),
        F.col("n_name").alias("site"),
        F.col("c_mktsegment").alias("resolution"),
        F.when(key % 3 == 0, "val").otherwise("train").alias("split"),
        F.concat(F.lit("v"), (key % 4).cast("string")).alias("dataset_version"),
        (key % 1000 + 1).alias("total_pixels"),
        F.floor((key % 1000 + 1) * (key % 101) / 100).cast("bigint").alias("pixels_no_data"),
        ((key % 101) / 100.0).alias("no_data_frac"),
        (key % len(IDS)).cast("int").alias("original_class_id"),
    )


_TILES = f"""(SELECT o_orderkey AS tile_id, n_name AS site, c_mktsegment AS resolution,
 CASE WHEN o_orderkey % 3 = 0 THEN 'val' ELSE 'train' END AS split, 'v' || CAST(o_orderkey % 4 AS VARCHAR) AS dataset_version,
 o_orderkey % 1000 + 1 AS total_pixels, CAST(floor((o_orderkey % 1000 + 1) * (o_orderkey % 101) / 100.0) AS BIGINT) AS pixels_no_data,
 (o_orderkey % 101) / CAST(100 AS DOUBLE) AS no_data_frac, CAST(o_orderkey % {len(IDS)} AS INTEGER) AS original_class_id
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    site = F.concat(F.lit("site_"), F.col("label").cast("string"))
    order = W.partitionBy("label").orderBy("vec_id")
    return e.select(site.alias("site_id"), (F.row_number().over(order) - 1).cast("bigint").alias("cell_id"), F.col("embedding").alias("cls"), "vec_id", "label")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A box for each part, by a site of its own for each brand."""
    p = read(spark, sf, "part")
    x, y = F.col("p_partkey") % 97 * 10.0, F.floor(F.col("p_partkey") / 97) % 89 * 10.0
    side = F.col("p_size") * 0.5 + 1.0
    return p.select("p_partkey", F.col("p_brand").alias("site_id"), x.alias("xmin"), y.alias("ymin"), (x + side).alias("xmax"), (y + side).alias("ymax"))


_BOXES = """(SELECT p_partkey, p_brand AS site_id, p_partkey % 97 * 10.0::DOUBLE AS xmin, (p_partkey // 97) % 89 * 10.0::DOUBLE AS ymin,
 p_partkey % 97 * 10.0::DOUBLE + p_size * 0.5::DOUBLE + 1 AS xmax, (p_partkey // 97) % 89 * 10.0::DOUBLE + p_size * 0.5::DOUBLE + 1 AS ymax FROM part)"""


# --- scans and names -----------------------------------------------------------------------------


@query(
    """SELECT 'site_' || CAST(label AS VARCHAR) AS site_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cell_id,
 CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM embeddings"""
)
def cells_manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("site_id", "cell_id", F.size("cls").alias("dim"), r6(F.col("cls")[0].cast("double")).alias("first_value"))


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS site_id,
 replace(url, '/', '__') AS archived_id FROM pages"""
)
def site_id_slug(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf, "pages").select("page_id", names.site_id(url).alias("site_id"), names.archived_site_id(url).alias("archived_id"))


@query(
    r"""SELECT p_partkey, regexp_extract(name, '^(.*)_(\d+)_(\d+)\.npz$', 1) AS blob_key, CAST(regexp_extract(name, '^(.*)_(\d+)_(\d+)\.npz$', 2) AS INTEGER) AS tile_col,
 CAST(regexp_extract(name, '^(.*)_(\d+)_(\d+)\.npz$', 3) AS INTEGER) AS tile_row
 FROM (SELECT p_partkey, 'b' || CAST(p_partkey % 7 AS VARCHAR) || '_' || CAST(p_size * 384 AS VARCHAR) || '_' || CAST(p_partkey % 5 * 384 AS VARCHAR) || '.npz' AS name FROM part)"""
)
def path_parse(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat(F.lit("image_b"), (key % 7).cast("string"), F.lit("_part_"), (F.col("p_size") * 384).cast("string"), F.lit("_"), (key % 5 * 384).cast("string"), F.lit(".npz"))
    return read(spark, sf, "part").select("p_partkey", names.tile_key(name).alias("blob_key"), names.tile_col(name).alias("tile_col"), names.tile_row(name).alias("tile_row"))


@query(
    """SELECT p_partkey, 'site/' || p_brand || '.zarr' AS path, p_partkey AS cell_index, 'cell_' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 4
 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END AS cell_key, p_brand || '.zarr#' || CAST(p_partkey AS VARCHAR) AS relative FROM part"""
)
def ref_split(spark: SparkSession, sf: str) -> DataFrame:
    ref = names.patch_ref(F.concat(F.lit("site/"), F.col("p_brand"), F.lit(".zarr")), F.col("p_partkey"))
    p = read(spark, sf, "part").withColumn("ref", ref)
    r = F.col("ref")
    return p.select(
        "p_partkey",
        names.ref_path(r).alias("path"),
        names.ref_index(r).alias("cell_index"),
        names.cell_key(names.ref_index(r)).alias("cell_key"),
        names.relative_ref(r, F.lit("site/")).alias("relative"),
    )


@query(
    """SELECT c_custkey, CASE WHEN n > 1 THEN clean ELSE left(clean, 8) END AS blob_id FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, left(clean, 8)) AS n
 FROM (SELECT c_custkey, c_nationkey, regexp_replace(reverse(c_name), '[^0-9A-Za-z_-]', '_', 'g') AS clean FROM customer))"""
)
def blob_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("site"), F.reverse("c_name").alias("key"))
    return names.blob_ids(c).select("c_custkey", "blob_id")


@query(
    """SELECT p_partkey, CASE WHEN res < 0.07 THEN 1024 WHEN res < 0.15 THEN 512 ELSE 256 END AS patch_px, CASE WHEN res < 0.07 THEN 1 WHEN res < 0.15 THEN 2 ELSE 4 END AS upsample,
 round(res * 16 / CASE WHEN res < 0.07 THEN 1 WHEN res < 0.15 THEN 2 ELSE 4 END, 6) AS embed_gsd FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 100 AS res FROM part)"""
)
def resolution_policy(spark: SparkSession, sf: str) -> DataFrame:
    p = geo.resolution_policy(F.col("p_size").cast("double") / 100)
    return read(spark, sf, "part").select("p_partkey", p["patch_px"].alias("patch_px"), p["upsample"].alias("upsample"), r6(p["embed_gsd"]).alias("embed_gsd"))


@query(
    """SELECT p_partkey, CAST(floor((xmin - 3) / 0.5) AS BIGINT) AS col0, CAST(floor((ymax - 2000) / -0.5) AS BIGINT) AS row0,
 CAST(ceil((ceil((xmax - 3) / 0.5) - floor((xmin - 3) / 0.5)) / 16) * 16 AS BIGINT) AS w_px, CAST(ceil((ceil((ymin - 2000) / -0.5) - floor((ymax - 2000) / -0.5)) / 16) * 16 AS BIGINT) AS h_px FROM """
    + _BOXES
)
def grid_snap(spark: SparkSession, sf: str) -> DataFrame:
    gt = F.array(*[F.lit(x) for x in (0.5, 0.0, 3.0, 0.0, -0.5, 2000.0, 0.0, 0.0, 1.0)])
    s = geo.snap_to_patch(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), gt, F.lit(16))
    return boxes(spark, sf).select("p_partkey", *[v.alias(k) for k, v in s.items()])


@query(
    """SELECT p_partkey, round(least(x0, x1, x2, x3), 6) AS xmin, round(least(y0, y1, y2, y3), 6) AS ymin, round(greatest(x0, x1, x2, x3), 6) AS xmax, round(greatest(y0, y1, y2, y3), 6) AS ymax FROM (
 SELECT p_partkey, 0.1*c + 0.02*r AS x0, 0.1*(c+w) + 0.02*r AS x1, 0.1*c + 0.02*(r+w) AS x2, 0.1*(c+w) + 0.02*(r+w) AS x3,
 0.03*c - 0.1*r AS y0, 0.03*(c+w) - 0.1*r AS y1, 0.03*c - 0.1*(r+w) AS y2, 0.03*(c+w) - 0.1*(r+w) AS y3 FROM (SELECT p_partkey, CAST(p_partkey % 512 AS DOUBLE) AS c, CAST(p_partkey % 300 AS DOUBLE) AS r, CAST(p_size AS DOUBLE) AS w FROM part))"""
)
def pixel_boxes_to_world(spark: SparkSession, sf: str) -> DataFrame:
    gt = F.array(*[F.lit(x) for x in (0.1, 0.02, 0.0, 0.03, -0.1, 0.0, 0.0, 0.0, 1.0)])
    c, r, w = ((F.col("p_partkey") % n).cast("double") for n in (512, 300, 1 << 40))
    box = geo.pixel_box_to_world(gt, c, r, F.col("p_size").cast("double"), F.col("p_size").cast("double"))
    return read(spark, sf, "part").select("p_partkey", *[r6(v).alias(k) for k, v in box.items()])


# --- statistics ----------------------------------------------------------------------------------


@query(_HISTOGRAM)
def class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(spark, sf)


@query(
    f"""SELECT tile, CAST(sum(pixel_count) AS BIGINT) AS total_pixels, CAST(coalesce(sum(pixel_count) FILTER (t = 0), 0) AS BIGINT) AS pixels_no_data,
 {", ".join(f"CAST(coalesce(sum(pixel_count) FILTER (t = {k}), 0) AS BIGINT) AS pixels_class_{k}" for k in C.TARGETS)},
 CAST(count(DISTINCT original_class_id) AS INTEGER) AS n_unique_orig_classes, round(coalesce(sum(pixel_count) FILTER (t = 0), 0) / CAST(sum(pixel_count) AS DOUBLE), 6) AS no_data_frac
 FROM (SELECT tile, original_class_id, pixel_count, original_class_id AS c, {_TARGET} AS t FROM ({_HISTOGRAM})) GROUP BY tile HAVING count(*) FILTER (t IS NULL) = 0"""
)
def class_rollup(spark: SparkSession, sf: str) -> DataFrame:
    wide = stats.class_rollup(histogram(spark, sf), ["tile"]).drop("pixels_unmapped")
    return wide.withColumn("no_data_frac", r6(F.col("no_data_frac"))).withColumn("n_unique_orig_classes", F.col("n_unique_orig_classes").cast("int"))


@query(
    f"""SELECT tile, array_to_string(list_sort(list(DISTINCT original_class_id)), ',') AS invalid FROM (SELECT tile, original_class_id, original_class_id AS c, {_TARGET} AS t FROM ({_HISTOGRAM}))
 WHERE t IS NULL GROUP BY tile"""
)
def invalid_class_tiles(spark: SparkSession, sf: str) -> DataFrame:
    bad = stats.invalid_classes(histogram(spark, sf), ["tile"])
    return bad.select("tile", F.array_join(F.col("invalid").cast("array<string>"), ",").alias("invalid"))


@query(
    f"""SELECT tile, round(CASE WHEN k > 0 THEN area / CAST(384 * 384 AS DOUBLE) ELSE 0 END, 6) AS annot_bbox_area_frac, round(CASE WHEN k > 0 THEN k / CAST(area AS DOUBLE) ELSE 0 END, 6) AS annot_in_bbox_density
 FROM (SELECT tile, count(*) FILTER (seen) AS k, (max(r) FILTER (seen) - min(r) FILTER (seen) + 1) * (max(q) FILTER (seen) - min(q) FILTER (seen) + 1) AS area
 FROM (SELECT l_orderkey AS tile, l_linenumber AS r, l_partkey % 384 AS q, {_GOOD} NOT IN ({", ".join(map(str, C.NO_DATA))}) AS seen FROM lineitem) GROUP BY tile)"""
)
def tile_annotation_bbox(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "tile")
    box = stats.annotation_box(rows, ["tile"], original(good=True), F.col("l_linenumber"), F.col("l_partkey") % 384, F.lit(384 * 384))
    return box.select("tile", r6(F.col("annot_bbox_area_frac")).alias("annot_bbox_area_frac"), r6(F.col("annot_in_bbox_density")).alias("annot_in_bbox_density"))


@query(
    f"""SELECT site, resolution, max(dataset_version) AS dataset_version, count(*) FILTER (split = 'train') AS n_tiles_train, count(*) FILTER (split = 'val') AS n_tiles_val, count(*) AS n_tiles_total,
 CAST(sum(total_pixels) AS BIGINT) AS total_pixels, CAST(sum(pixels_no_data) AS BIGINT) AS total_no_data_pixels, round(avg(no_data_frac), 6) AS mean_no_data_frac,
 round(quantile_cont(no_data_frac, 0.5), 6) AS median_no_data_frac, round(quantile_cont(no_data_frac, 0.9), 6) AS p90_no_data_frac,
 round(avg(CASE WHEN no_data_frac > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS frac_tiles_mostly_no_data, CAST(count(DISTINCT original_class_id) AS INTEGER) AS n_unique_orig_classes_union
 FROM {_TILES} GROUP BY site, resolution"""
)
def site_resolution_rollup(spark: SparkSession, sf: str) -> DataFrame:
    t = staged(tiles(spark, sf), work_path(spark, "tiles"))
    rows = stats.site_rollup(t.drop("original_class_id"), t.select("site", "resolution", "original_class_id"))
    for c in ("mean_no_data_frac", "median_no_data_frac", "p90_no_data_frac", "frac_tiles_mostly_no_data"):
        rows = rows.withColumn(c, r6(F.col(c)))
    return rows.withColumn("n_unique_orig_classes_union", F.col("n_unique_orig_classes_union").cast("int"))


# --- maintenance ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def incremental_new(spark: SparkSession, sf: str) -> DataFrame:
    known = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return maintenance.new_rows(read(spark, sf, "orders"), known, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey AS tile_id, o_orderpriority AS mask_path, CAST(NULL AS DOUBLE) AS price FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 5 = 0")
def append_union(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), F.col("o_orderpriority").alias("mask_path"), F.col("o_totalprice").alias("price"))
    return maintenance.append(o.where("tile_id % 2 = 0").drop("price"), o.where("tile_id % 5 = 0"))


@query("SELECT l_orderkey AS tile_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def prune_semi(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), F.lit("s").alias("site"), F.lit("r").alias("resolution"), F.lit("train").alias("split"), F.col("o_orderkey").alias("mask_path"), "o_orderstatus")
    c = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile_id"), F.lit("s").alias("site"), F.lit("r").alias("resolution"), F.lit("train").alias("split"))
    _, classes = maintenance.prune(t, c, t.where("o_orderstatus = 'F'"))
    return classes.groupBy("tile_id").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS tile_id, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'O') GROUP BY 1")
def orphan_anti(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "orders").where("o_orderstatus != 'O'").select(F.col("o_orderkey").alias("tile_id"))
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile_id"))
    return maintenance.orphans(rows, t, ["tile_id"]).groupBy("tile_id").agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey AS mask_path, CASE WHEN c_custkey IS NOT NULL THEN c_name END AS image_path, c_custkey IS NOT NULL AS image_exists
 FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey"""
)
def link_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    links = read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("image_path"), F.lit(True).alias("image_exists"))
    t = read(spark, sf, "orders").select(F.col("o_orderkey").alias("mask_path"), F.col("o_custkey").alias("key"))
    return maintenance.reconcile_links(t, links, "key").select("mask_path", "image_path", "image_exists")


_RANKED = """(SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place,
 min(source) OVER (PARTITION BY text) <> max(source) OVER (PARTITION BY text) AS conflict FROM documents WHERE text IS NOT NULL)"""


def _duplicates(spark: SparkSession, sf: str, ranked: bool = False) -> DataFrame:
    docs = read(spark, sf, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("content"))
    return maintenance.duplicates(docs, F.col("content"), [F.col("doc_id")], F.col("source"), ranked)


@query(f"SELECT doc_id, copies FROM {_RANKED} WHERE place = 1")
def dedup_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return _duplicates(spark, sf).where("place = 1").select("doc_id", "copies")


@query(f"SELECT doc_id, CAST(place AS INTEGER) AS place FROM {_RANKED} WHERE conflict")
def dedup_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return _duplicates(spark, sf, True).where("conflict").select("doc_id", "place")


@query(
    """SELECT o_orderkey AS tile_id, CASE WHEN n IS NULL OR n <> 4 THEN 'n' ELSE '' END || CASE WHEN q IS NULL OR abs(q - 100) > 0.3 * 100 THEN 'q' ELSE '' END AS mismatched
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n IS NULL OR n <> 4 OR q IS NULL OR abs(q - 100) > 30"""
)
def validate_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    stored = read(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), F.lit(4).cast("bigint").alias("n"), F.lit(100.0).alias("q"))
    found = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tile_id")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    off = maintenance.validate(stored, found, ["tile_id"], ["n"], ["q"], 0.3)
    return off.select("tile_id", F.array_join("mismatched", "").alias("mismatched"))


# --- vectors -------------------------------------------------------------------------------------

_V = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_REF = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_REF_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _REF) + "]"


@query(f"SELECT vec_id, round(v[1] / (sqrt(list_sum([x * x FOR x IN v])) + 1e-8), 6) AS first_value, round(v[64] / (sqrt(list_sum([x * x FOR x IN v])) + 1e-8), 6) AS last_value FROM {_V}")
def l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").withColumn("u", vectors.l2_normalise(F.col("embedding")))
    return e.select("vec_id", r6(F.col("u")[0]).alias("first_value"), r6(F.col("u")[63]).alias("last_value"))


@query(f"SELECT vec_id, round(list_dot_product(v, {_REF_SQL}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({_REF_SQL}, {_REF_SQL})) + 1e-8), 6) AS cosine FROM {_V}")
def cosine_to_ref(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", r6(vectors.cosine(F.col("embedding"), F.array(*map(F.lit, _REF)))).alias("cosine"))


@query(f"SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(v[pos]), 6) AS mean FROM {_V}, range(1, 65) r(pos) GROUP BY 1, 2")
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.mean_pool(read(spark, sf, "embeddings"), ["label"], "embedding").withColumn("mean", r6(F.col("mean")))


@query("SELECT round(avg(CASE WHEN label <> vec_id % 10 THEN 1.0 ELSE 0.0 END), 6) AS mismatch FROM embeddings")
def label_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    other = e.select("vec_id", (F.col("vec_id") % 10).cast("int").alias("label"))
    return embedding.disagreement(e.select("vec_id", "label"), other, ["vec_id"], "label").select(r6(F.col("mismatch")).alias("mismatch"))


@query("SELECT CAST(c AS INTEGER) AS cluster, count(e.vec_id) AS n, round(count(e.vec_id) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE), 6) AS fraction FROM range(0, 16) r(c) LEFT JOIN embeddings e ON e.label = c GROUP BY 1")
def cluster_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.cluster_fractions(read(spark, sf, "embeddings"), "label", 16).withColumn("fraction", r6(F.col("fraction")))


_CENTRES = [[(((i + 1) * (k + 3) * 29) % 101 - 50) / 50 for i in range(64)] for k in range(5)]


@query(
    "SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS cluster FROM (SELECT vec_id, ["
    + ", ".join(f"round(list_dot_product(v, [{', '.join(f'{x!r}::DOUBLE' for x in c)}]), 9)" for c in _CENTRES)
    + f"] AS s FROM {_V})"
)
def assign_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", embedding.assign(None, _CENTRES, F.col("embedding")).alias("cluster"))


_BASIS = [[1.0 / 8 if (i >> k) & 1 else -1.0 / 8 for i in range(64)] for k in range(3)]


@query(
    "SELECT vec_id, "
    + ", ".join(f"round(list_dot_product([u[i] - ({_REF_SQL})[i] FOR i IN range(1, 65)], [{', '.join(f'{x!r}::DOUBLE' for x in b)}]), 6) AS pc{k}" for k, b in enumerate(_BASIS))
    + f" FROM (SELECT vec_id, [x / (sqrt(list_dot_product(v, v)) + 1e-6) FOR x IN v] AS u FROM {_V})"
)
def pca_project_fixed(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").withColumn("p", embedding.project(F.col("embedding"), _REF, _BASIS))
    return e.select("vec_id", *[r6(F.col("p")[k]).alias(f"pc{k}") for k in range(3)])


@query("SELECT o_orderkey, round(least(greatest((o_totalprice - lo) / (hi - lo + 1e-6), 0), 1), 6) AS stretched FROM orders, (SELECT quantile_cont(o_totalprice, 0.02) AS lo, quantile_cont(o_totalprice, 0.98) AS hi FROM orders)")
def percentile_stretch(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("stretched"))
    return embedding.percentile_stretch(o, ["stretched"]).withColumn("stretched", r6(F.col("stretched")))


@query()
def pca_fit(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    mean, parts = embedding.fit_pca(e, "embedding", 3)
    return e.select("vec_id", embedding.project(F.col("embedding"), mean.tolist(), parts.tolist()).alias("pc"))


@query()
def kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.kmeans(read(spark, sf, "embeddings"), "embedding", 6).select("vec_id", "cluster")


# --- grids and tiling ----------------------------------------------------------------------------

_AREAS = f"(SELECT site_id, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM {_BOXES} GROUP BY 1)"
_GRID = f"""(SELECT site_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, xmin + c * 20 AS x0, ymax - r * 20 - 20 AS y0, xmin + c * 20 + 20 AS x1, ymax - r * 20 AS y1
 FROM {_AREAS}, LATERAL (SELECT unnest(range(0, greatest(CAST(ceil((ymax - ymin) / 20) AS BIGINT), 1))) AS r), LATERAL (SELECT unnest(range(0, greatest(CAST(ceil((xmax - xmin) / 20) AS BIGINT), 1))) AS c))"""


@query(f'SELECT site_id, "row", col, round(x0, 6) AS xmin, round(y0, 6) AS ymin, row_number() OVER (PARTITION BY site_id ORDER BY "row", col) - 1 AS cell_id FROM {_GRID}')
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    areas = spatial.total_bounds(boxes(spark, sf), ["site_id"]).withColumn("side", F.lit(20.0))
    g = spatial.with_cell_ids(spatial.grid_cells(areas, "side"))
    return g.select("site_id", "row", "col", r6(F.col("xmin")).alias("xmin"), r6(F.col("ymin")).alias("ymin"), "cell_id")


@query(
    f"""SELECT site_id, "row", col, row_number() OVER (PARTITION BY site_id ORDER BY "row", col) - 1 AS cell_id FROM {_GRID} g WHERE EXISTS
 (SELECT 1 FROM {_BOXES} b WHERE b.site_id = g.site_id AND b.xmin <= g.x1 AND g.x0 <= b.xmax AND b.ymin <= g.y1 AND g.y0 <= b.ymax)"""
)
def grid_tile_semi(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.build_tile_grid(boxes(spark, sf), 20.0).select("site_id", "row", "col", "cell_id")


@query(
    f"""SELECT p_partkey, round(greatest(xmin, 100), 6) AS xmin, round(greatest(ymin, 100), 6) AS ymin, round(least(xmax, 400), 6) AS xmax, round(least(ymax, 300), 6) AS ymax FROM {_BOXES}
 WHERE xmin < 400 AND xmax > 100 AND ymin < 300 AND ymax > 100"""
)
def clip_to_extent(spark: SparkSession, sf: str) -> DataFrame:
    extent = spark.createDataFrame([(100.0, 100.0, 400.0, 300.0)], "xmin double, ymin double, xmax double, ymax double")
    cut = spatial.clip_to(boxes(spark, sf).drop("site_id"), extent)
    return cut.select("p_partkey", *[r6(F.col(c)).alias(c) for c in geo.BOX])


@query("SELECT l_orderkey AS cell_id, round(avg(CASE WHEN l_linenumber % 3 <> 0 OR l_suppkey % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM lineitem GROUP BY 1 HAVING avg(CASE WHEN l_linenumber % 3 <> 0 OR l_suppkey % 5 = 0 THEN 1.0 ELSE 0.0 END) >= 0.8")
def void_filter(spark: SparkSession, sf: str) -> DataFrame:
    lit = (F.col("l_linenumber") % 3 != 0) | (F.col("l_suppkey") % 5 == 0)
    samples = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.when(lit, 9).otherwise(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    seen = samples.groupBy("cell_id").agg(r6(F.avg(F.when(F.col("r") != 0, 1.0).otherwise(0.0))).alias("coverage"))
    return spatial.without_void(seen, samples, ["cell_id"], 0.8)


_BLOBS = "(SELECT p_partkey AS uuid, CAST(200 + p_size * 40 AS INTEGER) AS width, CAST(100 + p_partkey % 900 AS INTEGER) AS height FROM part)"
_STARTS = "(SELECT uuid, width, height, list_distinct([CAST(floor(s / 8.0) * 8 AS INTEGER) FOR s IN list_append(range(0, greatest({0} - 512, 0) + 1, 384), greatest({0} - 512, 0))]) AS s FROM " + _BLOBS + ")"


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("uuid"), (200 + F.col("p_size") * 40).cast("int").alias("width"), (100 + F.col("p_partkey") % 900).cast("int").alias("height"))


_WINDOWS = f"""(SELECT a.uuid, col_px, row_px, least(512, a.width - col_px) AS w_px, least(512, a.height - row_px) AS h_px FROM
 (SELECT uuid, width, height, unnest(s) AS col_px FROM {_STARTS.format("width")}) a JOIN (SELECT uuid, unnest(s) AS row_px FROM {_STARTS.format("height")}) b USING (uuid))"""


@query(f"SELECT uuid, col_px, row_px, w_px, h_px FROM {_WINDOWS}")
def overlap_windows(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.overlap_windows(blobs(spark, sf), 512, 128).select("uuid", "col_px", "row_px", "w_px", "h_px")


@query(
    f"""SELECT uuid, CAST(br AS BIGINT) AS brow, CAST(bc AS BIGINT) AS bcol, count(*) AS n FROM {_WINDOWS}, LATERAL (SELECT unnest(range(row_px // 64, (row_px + h_px - 1) // 64 + 1)) AS br),
 LATERAL (SELECT unnest(range(col_px // 64, (col_px + w_px - 1) // 64 + 1)) AS bc) GROUP BY 1, 2, 3"""
)
def overlap_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.overlap_coverage(tiling.overlap_windows(dealt(blobs(spark, sf), 10_000, "uuid"), 512, 128), 64)


@query('SELECT CAST(l_partkey % 40 AS BIGINT) AS "row", CAST(l_suppkey % 30 AS BIGINT) AS col, round(avg(l_extendedprice), 2) AS value, count(*) AS n FROM lineitem GROUP BY 1, 2')
def mean_blend(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select((F.col("l_partkey") % 40).alias("row"), (F.col("l_suppkey") % 30).alias("col"), F.col("l_extendedprice").alias("value"))
    return tiling.mean_blend(rows, ["row", "col"]).withColumn("value", F.round("value", 2))


@query('SELECT CAST(l_partkey % 40 AS BIGINT) AS "row", CAST(l_suppkey % 30 AS BIGINT) AS col, min_by(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS value FROM lineitem GROUP BY 1, 2')
def first_writer_stitch(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select((F.col("l_partkey") % 40).alias("row"), (F.col("l_suppkey") % 30).alias("col"), F.col("l_quantity").alias("value"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).alias("seq"))
    return tiling.first_writer(rows, ["row", "col"], ["seq"]).select("row", "col", "value")


@query('SELECT CAST(l_partkey % 40 AS BIGINT) AS "row", CAST(l_suppkey % 30 AS BIGINT) AS col, max_by(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS value FROM lineitem GROUP BY 1, 2')
def canvas_last_writer(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.lit(1).alias("key"), F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("l_partkey") % 40).alias("row"), (F.col("l_suppkey") % 30).alias("col"), F.col("l_quantity").alias("value"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).alias("seq"))
    return tiling.canvas(rows, "key").select("row", "col", "value")


@query("SELECT l_orderkey AS uuid, CAST(max(l_partkey % 9 * 384 + 384) AS BIGINT) AS width, CAST(max(l_suppkey % 7 * 384 + 384) AS BIGINT) AS height, count(*) AS n_tiles FROM lineitem GROUP BY 1")
def blob_extent(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uuid"), (F.col("l_partkey") % 9 * 384).alias("x"), (F.col("l_suppkey") % 7 * 384).alias("y"), F.lit(384).alias("w"), F.lit(384).alias("h"))
    return tiling.blob_extents(rows, ["uuid"])


@query("SELECT l_orderkey AS uuid, CAST((count(DISTINCT l_suppkey % 7) // 2) * (count(DISTINCT l_partkey % 9) // 2) AS BIGINT) AS blocks, count(DISTINCT l_suppkey % 7) % 2 <> 0 OR count(DISTINCT l_partkey % 9) % 2 <> 0 AS leftover FROM lineitem GROUP BY 1")
def super_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uuid"), (F.col("l_partkey") % 9).alias("x"), (F.col("l_suppkey") % 7).alias("y"))
    return tiling.super_blocks(rows, ["uuid"])


# --- runs ----------------------------------------------------------------------------------------


@query(f"SELECT uuid, CAST(width AS BIGINT) * height AS area FROM {_BLOBS} ORDER BY area DESC, uuid LIMIT 25")
def top_blobs(spark: SparkSession, sf: str) -> DataFrame:
    area = F.col("width").cast("bigint") * F.col("height")
    return runs.largest(blobs(spark, sf).withColumn("area", area), F.col("area"), "uuid", 25).select("uuid", "area")


@query("SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation) WHERE i % 4 = 1")
def shard_sites(spark: SparkSession, sf: str) -> DataFrame:
    return runs.shard(read(spark, sf, "nation").select("n_name"), "n_name", 1, 4)


_STATUS = "CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'skipped' ELSE 'ok' END"


@query(f"SELECT o_orderpriority AS run, count(*) AS n_sites, count(*) FILTER ({_STATUS} = 'ok') AS n_ok, count(*) FILTER ({_STATUS} = 'skipped') AS n_skipped, count(*) FILTER ({_STATUS} = 'failed') AS n_failed FROM orders GROUP BY 1")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("run"), F.when(key % 7 == 0, runs.FAILED).when(key % 3 == 0, runs.SKIPPED).otherwise(runs.OK).alias("status"))
    return runs.status(rows, ["run"])


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'on_1') ORDER BY n_name LIMIT 1")
def pick_site(spark: SparkSession, sf: str) -> DataFrame:
    return runs.pick(read(spark, sf, "nation"), "n_name", "ON_1", "n_name").select("n_nationkey", "n_name")


_INTEGRITY = """WITH c AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cell_id FROM embeddings),
 k AS (SELECT label, cell_id FROM c WHERE NOT (label = 1 AND cell_id = 0)), n AS (SELECT label, count(*) AS n, min(cell_id) AS lo, max(cell_id) AS hi FROM k GROUP BY 1),
 m AS (SELECT label, count(*) AS meta FROM c WHERE label <> 2 GROUP BY 1), p AS (SELECT label, count(*) AS patches FROM c WHERE NOT (label = 3 AND cell_id = 0) GROUP BY 1)"""


@query(
    _INTEGRITY
    + """ SELECT 'site_' || CAST(label AS VARCHAR) AS site_id, NOT (meta IS NULL OR n <> meta OR n <> patches OR lo <> 0 OR hi <> n - 1) AS ok,
 CAST(CASE WHEN meta IS NULL THEN 1 ELSE 0 END + CASE WHEN n <> coalesce(meta, n) THEN 1 ELSE 0 END + CASE WHEN n <> patches THEN 1 ELSE 0 END + CASE WHEN lo <> 0 OR hi <> n - 1 THEN 1 ELSE 0 END AS INTEGER) AS n_problems
 FROM n LEFT JOIN m USING (label) LEFT JOIN p USING (label)"""
)
def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    whole = cells(spark, sf).withColumn("patch_ref", names.patch_ref(F.col("site_id"), F.col("cell_id")))
    kept = whole.where("not (label = 1 and cell_id = 0)")
    meta = whole.where("label != 2").groupBy("site_id").agg(F.count("*").alias("n_cells"), F.max(F.size("cls")).alias("embed_dim"))
    patches = whole.where("not (label = 3 and cell_id = 0)").select("site_id", "cell_id", F.lit(1.0).alias("max_abs"))
    return runs.integrity(kept, meta, patches).select("site_id", "ok", F.size("problems").alias("n_problems"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = windowed_counts(read(spark, sf, "events"), "ts", "event_type")
    return rows.withColumn("total", F.round("total", 4))
