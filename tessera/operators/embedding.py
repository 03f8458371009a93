"""Embeddings: pluggable embedders, pooling, projection, clusters and comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from tessera.functions.vectors import dot, doubles, l2_normalise, stretched
from tessera.operators.percentiles import exact_percentiles

Embedder = Callable[[np.ndarray], np.ndarray]
TokenEmbedder = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def embed(cells: DataFrame, pixels: str, make_embedder: Callable[[], Embedder], batch: int = 32) -> DataFrame:
    """Adds ``cls``: the embedder's vector for each cell's pixels (an array of floats of equal lengths).

    ``make_embedder`` runs once a Python worker and task, so a model is loaded where it is used.
    """
    schema = StructType([*cells.schema.fields, StructField("cls", ArrayType(FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_embedder()
        for part in parts:
            for i in range(0, len(part), batch):
                some = part.iloc[i : i + batch].copy()
                some["cls"] = list(np.asarray(model(np.stack(some[pixels].to_list())), np.float32))
                yield some

    return cells.mapInPandas(run, schema)


def embed_tokens(cells: DataFrame, pixels: str, make_embedder: Callable[[], TokenEmbedder], batch: int = 32) -> DataFrame:
    """Adds ``cls`` and ``tokens`` (channels x patches, see :func:`patch_rows`) from one pass of the embedder, which gives for
    some cells' pixels (n, d) class vectors and (n, d, patches) patch vectors."""
    fields = StructType.fromDDL("cls array<float>, tokens array<array<float>>").fields
    schema = StructType([*cells.schema.fields, *fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_embedder()
        for part in parts:
            for i in range(0, len(part), batch):
                some = part.iloc[i : i + batch].copy()
                cls, tokens = (np.asarray(x, np.float32) for x in model(np.stack(some[pixels].to_list())))
                some["cls"], some["tokens"] = list(cls), [list(t) for t in tokens]
                yield some

    return cells.mapInPandas(run, schema)


def mean_pool(vectors: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The mean vector of each group, by position: (by..., pos, mean); vectors of a group are of equal length.

    Each task adds up whole vectors, so what is spread out by position is a row a task and group, not a row a vector.
    """
    schema = StructType([*[vectors.schema[c] for c in by], *StructType.fromDDL("n bigint, total array<double>").fields])

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([[*k, n, t] for k, (n, t) in sums.items()], columns=schema.names)
            return out.astype({f.name: "Int64" for f in schema.fields[: len(by)] if f.dataType.typeName() in ("integer", "long", "short")})

        for p in parts:
            p = p[p["v"].notna()]
            for k, g in p.groupby(by, dropna=False, sort=False)["v"]:
                n, t = sums.get(k, (0, 0.0))
                sums[tuple(None if pd.isna(x) else x for x in k)] = [n + len(g), t + np.stack(g.to_list()).sum(axis=0)]
            if len(sums) > 10_000:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    parts = vectors.select(*by, doubles(F.col(vector)).alias("v")).mapInPandas(add, schema)
    long = parts.select(*by, "n", F.posexplode("total").alias("pos", "x"))
    return long.groupBy(*by, "pos").agg((F.sum("x") / F.sum("n")).alias("mean"))


def constant(v: list[float]) -> Column:
    """A vector as one literal, not a literal a number."""
    return F.lit(np.asarray(v, np.float64))


def assign(vectors: DataFrame, centres: list[list[float]], vector: Column) -> Column:
    """The number of the centre with the largest dot product; ties go to the first."""
    scores = F.array(*[dot(vector, constant(c)) for c in centres])
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def added_up(parts: DataFrame, fan: int = 64) -> np.ndarray | None:
    """The sum of the arrays of all rows (``part``, doubles as bytes), by ``fan`` tasks and then by the driver, which never hold
    more than two of them."""

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x in b["part"]:
                x = np.frombuffer(x)
                total = x.copy() if total is None else total + x
        yield pd.DataFrame({"part": [total.tobytes()]})

    total = None
    for r in parts.withColumn("fan", F.spark_partition_id() % fan).groupBy("fan").applyInPandas(add, "part binary").toLocalIterator():
        x = np.frombuffer(r["part"])
        total = x.copy() if total is None else total + x
    return total


def per_task(vectors: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(part): the sum over a task's vectors (``v``, rows of an array) of what ``make`` gives for some of them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for p in parts:
            for i in range(0, len(p), 1024):
                x = make(np.stack(p["v"].iloc[i : i + 1024].to_list()).astype(np.float64))
                total = x if total is None else total + x
        if total is not None:
            yield pd.DataFrame({"part": [np.ascontiguousarray(total, np.float64).tobytes()]})

    return vectors.mapInPandas(run, "part binary")


def fit_pca(vectors: DataFrame, vector: str, k: int, normalise: bool = True, wide_from: int = 512, passes: int = 12, close: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) from all rows; a component's sign is set so that its largest loading is positive.

    Vectors up to ``wide_from`` long: each task adds up products, and those d x d matrices are added up.  Longer ones: by a
    growing basis.  A pass takes k + 8 directions through all vectors, which gives as many new ones; the components are the best
    within all directions so far, and passes end when those hold (``close``, as a share of the largest variance) or after
    ``passes``.  Tasks hold d x (k + 8) numbers then, the driver ``passes`` times as many.
    """
    col = l2_normalise(F.col(vector), 1e-6) if normalise else doubles(F.col(vector))
    rows = vectors.select(col.alias("v")).where("v is not null")
    sums = added_up(per_task(rows, lambda x: np.r_[len(x), x.sum(axis=0)]))
    if sums is None:
        raise ValueError("there is no vector")
    n, mean = sums[0], sums[1:] / sums[0]
    d = len(mean)
    if d <= wide_from:
        square = added_up(per_task(rows, lambda x: (x - mean).T @ (x - mean))).reshape(d, d)
        _, basis = np.linalg.eigh(square)
        components = basis[:, ::-1][:, :k].T
    else:
        width = min(k + 8, d)
        basis, onto = np.zeros((d, 0)), np.zeros((d, 0))
        fresh = np.linalg.qr(np.random.default_rng(0).normal(size=(d, width)))[0]
        for _ in range(passes):
            some = fresh
            image = added_up(per_task(rows, lambda x: (x - mean).T @ ((x - mean) @ some))).reshape(d, -1)
            basis, onto = np.hstack([basis, fresh]), np.hstack([onto, image])
            value, turn = np.linalg.eigh((basis.T @ onto + onto.T @ basis) / 2)
            turn = turn[:, ::-1][:, :k]
            components = (basis @ turn).T
            off = np.linalg.norm(onto @ turn - (basis @ turn) * value[::-1][:k], axis=0)
            if off.max() <= close * max(value[-1], 1e-300):
                break
            for _ in range(2):  # what is new in it, twice for rounding
                image = image - basis @ (basis.T @ image)
            q, r = np.linalg.qr(image)
            fresh = q[:, np.abs(np.diag(r)) > 1e-10 * max(value[-1], 1e-300)][:, : d - basis.shape[1]]
            if not fresh.shape[1]:
                break
    at = np.abs(components).argmax(axis=1)
    return mean, components * np.sign(components[np.arange(len(components)), at])[:, None]


def project(vector: Column, mean: list[float], components: list[list[float]], normalise: bool = True) -> Column:
    """(x - mean) on each component, inside the JVM."""
    x = l2_normalise(vector, 1e-6) if normalise else doubles(vector)
    centred = F.zip_with(x, constant(mean), lambda a, b: a - b)
    # the array of one binds the centred vector once for all components
    return F.element_at(F.transform(F.array(centred), lambda v: F.array(*[dot(v, constant(c)) for c in components])), 1)


def percentile_stretch(rows: DataFrame, columns: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Columns brought to 0..1 between two percentiles of the whole table."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.c", "x.v")
    bounds = exact_percentiles(long, ["c"], F.col("v"), [low, high])
    for c in columns:  # one row a column; without any value there is nothing to stretch
        one = bounds.where(F.col("c") == c).select(F.col("p0").alias("_low"), F.col("p1").alias("_high"))
        rows = rows.join(F.broadcast(one), how="left").withColumn(c, stretched(F.col(c).cast("double"), F.col("_low"), F.col("_high"))).drop("_low", "_high")
    return rows


def pca_rgb(vectors: DataFrame, vector: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds r, g, b, 0 to 1: the first three principal components of the vectors as they are, stretched."""
    mean, parts = fit_pca(vectors, vector, 3, normalise=False)
    p = vectors.withColumn("_p", project(F.col(vector), mean.tolist(), parts.tolist(), normalise=False))
    return percentile_stretch(p.select("*", *[F.col("_p")[k].alias(c) for k, c in enumerate("rgb")]).drop("_p"), ["r", "g", "b"], low, high)


def embed_boxes(boxes: DataFrame, make_embedder: Callable[[], Embedder], cell: int, key: str = "uuid", bands: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(key, prow, pcol, vec, n): patch vectors of boxes (key, row_px, col_px, h_px, w_px, at, bands...), the mean where boxes
    overlap, and of how many.

    ``at`` lists the places of a box's pixels, row by row from 0, the bands their values; pixels not listed are 0.  The
    embedder gives a vector for each patch of ``cell`` pixels of a box, as (patches down, patches across, d).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_embedder()
        for part in parts:
            for r in part.to_dict("records"):
                image = np.zeros((r["h_px"] * r["w_px"], len(bands)))
                for i, band in enumerate(bands):
                    image[r["at"], i] = r[band]
                grid = np.asarray(model(image.reshape(r["h_px"], r["w_px"], -1)), np.float64)
                down, across, d = grid.shape
                prow, pcol = np.divmod(np.arange(down * across), across)
                yield pd.DataFrame({"k": [r["k"]] * (down * across), "prow": prow + r["row_px"] // cell, "pcol": pcol + r["col_px"] // cell, "v": list(grid.reshape(-1, d))})

    kind = dict(boxes.dtypes)[key]
    rows = boxes.select(F.col(key).alias("k"), "row_px", "col_px", "h_px", "w_px", "at", *bands).mapInPandas(run, f"k {kind}, prow int, pcol int, v array<double>")
    # a place is in a few boxes at most; their vectors are added up whole
    met = rows.groupBy("k", "prow", "pcol").agg(F.collect_list("v").alias("vs"))
    total = F.aggregate(F.slice("vs", F.lit(2), F.size("vs")), F.col("vs")[0], lambda t, v: F.zip_with(t, v, lambda a, b: a + b))
    return met.select(F.col("k").alias(key), "prow", "pcol", F.transform(total, lambda x: x / F.size("vs")).alias("vec"), F.size("vs").alias("n"))


def patch_rows(cells: DataFrame, tokens: str, by: list[str]) -> DataFrame:
    """(by..., prow, pcol, vec) of cells whose ``tokens`` are channels x patches, the patches of a square grid."""
    t = F.col(tokens)
    flat = cells.select(*by, t.alias("t"), F.round(F.sqrt(F.size(t[0]))).cast("int").alias("g"))
    each = flat.select(*by, "g", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(F.col("t")[0]) - 1), lambda i: F.transform("t", lambda c: F.get(c, i)))).alias("at", "vec"))
    return each.select(*by, F.floor(F.col("at") / F.col("g")).cast("int").alias("prow"), (F.col("at") % F.col("g")).cast("int").alias("pcol"), F.col("vec").cast("array<float>").alias("vec"))


def kmeans(vectors: DataFrame, vector: str, k: int, seeds: int = 10, cosine: bool = False) -> DataFrame:
    """Adds ``cluster`` by the best of ``seeds`` runs; ``cosine``: spherical, by angles."""
    ready = vectors.withColumn("_features", array_to_vector(doubles(F.col(vector))))
    kept = ready.select("_features").persist()
    measure = "cosine" if cosine else "euclidean"
    try:
        fits = [KMeans(k=k, seed=s, featuresCol="_features", predictionCol="cluster", distanceMeasure=measure, maxIter=50).fit(kept) for s in range(seeds)]
        best = min(fits, key=lambda f: f.summary.trainingCost)
    finally:
        kept.unpersist()
    return best.transform(ready).drop("_features")


def cluster_fractions(labels: DataFrame, label: str, k: int) -> DataFrame:
    """(cluster, n, fraction) for 0..k-1, those without a row too."""
    counts = labels.groupBy(F.col(label).cast("int").alias("cluster")).agg(F.count("*").alias("n"))
    every = labels.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    total = labels.agg(F.count("*").alias("total"))
    return every.join(counts, "cluster", "left").fillna(0, ["n"]).crossJoin(F.broadcast(total)).select("cluster", "n", (F.col("n") / F.col("total")).alias("fraction"))


def disagreement(a: DataFrame, b: DataFrame, key: list[str], label: str) -> DataFrame:
    """The share of places where two labellings differ."""
    both = a.select(*key, F.col(label).alias("_x")).join(b.select(*key, F.col(label).alias("_y")), key)
    return both.agg(F.avg(F.when(F.col("_x") != F.col("_y"), 1.0).otherwise(0.0)).alias("mismatch"))
