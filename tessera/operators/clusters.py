"""Spherical k-means of any number of groups at once: by angles, seeded by distance, without empty clusters.

A group's centres are one row (``centres``, k vectors); a round joins them to the group's vectors, where each takes the centre
with the largest cosine, and adds up the vectors of each cluster, whole vectors a task first.  No group is one task, and
rounds go on until no group's centres move.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, l2_normalise
from tessera.operators.embedding import mean_pool
from tessera.session import work_path
from tessera.sources.store import staged

SEED_ROUNDS = 4
CENTRES = "array<array<double>>"


def _kept(df: DataFrame, name: str) -> DataFrame:
    return staged(df, work_path(df.sparkSession, name))


def nearest_centre(vector: Column, centres: Column) -> tuple[Column, Column]:
    """(number of the centre with the largest cosine, the first of equal ones; 1 - that cosine) for unit vectors."""
    scores = F.transform(centres, lambda c: dot(vector, c))
    one = F.element_at(F.transform(F.array(scores), lambda s: F.struct((F.array_position(s, F.array_max(s)) - 1).cast("int").alias("at"), F.array_max(s).alias("top"))), 1)
    return one["at"], F.greatest(1 - one["top"], F.lit(0.0))


def _unit(vectors: DataFrame, vector: str, by: list[str]) -> DataFrame:
    return vectors.select(*by, l2_normalise(F.col(vector), 1e-8).alias("v")).where("v is not null")


def seeded(units: DataFrame, by: list[str], k: int, seed: int) -> DataFrame:
    """(by..., centres) to begin with: in each round vectors are drawn with a chance that goes with their distance, 1 - cosine, to
    those drawn before (2k a round and group, about); the draws, weighted by the vectors nearest to them, are thinned to k."""
    chance = lambda turn: F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "v", "_n"), F.lit(1 << 32)) / float(1 << 32)
    units = units.withColumn("_n", F.monotonically_increasing_id()) if "_n" not in units.columns else units
    drawn = _kept(units.groupBy(*by).agg(F.array(F.min_by("v", F.xxhash64(F.lit(seed), "v"))).alias("centres")), "drawn")
    for turn in range(SEED_ROUNDS):
        _, far = nearest_centre(F.col("v"), F.col("centres"))
        told = units.join(drawn, by).withColumn("far", far) if by else units.crossJoin(F.broadcast(drawn)).withColumn("far", far)
        cost = told.groupBy(*by).agg(F.sum("far").alias("cost"))
        told = told.join(F.broadcast(cost), by) if by else told.crossJoin(F.broadcast(cost))
        more = told.where(chance(turn) * F.col("cost") < 2 * k * F.col("far")).groupBy(*by).agg(F.collect_set("v").alias("more"))
        both = drawn.join(more, by, "left") if by else drawn.crossJoin(F.broadcast(more))
        drawn = _kept(both.select(*by, F.array_distinct(F.concat("centres", F.coalesce("more", F.array().cast(CENTRES)))).alias("centres")), "drawn")
    at, _ = nearest_centre(F.col("v"), F.col("centres"))
    near = (units.join(drawn, by) if by else units.crossJoin(F.broadcast(drawn))).groupBy(*by, at.alias("at")).agg(F.count("*").alias("n"))
    weights = near.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("weights"))  # a few dozen a group
    rows = drawn.join(weights, by) if by else drawn.crossJoin(F.broadcast(weights))

    def thinned(batches):
        for b in batches:
            out = []
            for centres, weights in zip(b["centres"], b["weights"], strict=True):
                x = np.stack([np.asarray(c, float) for c in centres])
                out.append(_thinned(x, np.array([dict(weights).get(i, 0) for i in range(len(x))], float), k, seed).tolist())
            yield b.drop(columns=["weights"]).assign(centres=out)

    kinds = {f.name: f.dataType.simpleString() for f in drawn.schema.fields}
    return rows.mapInPandas(thinned, ", ".join(f"`{c}` {kinds[c]}" for c in drawn.columns))


def _thinned(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the unit rows: the best of ten weighted draws by distance, each with a few rounds over the rows."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(10):
        c = [x[rng.choice(len(x), p=weight / weight.sum())]]
        while len(c) < min(k, len(x)):
            far = weight * np.clip(1 - (x @ np.array(c).T).max(1), 0, None)
            c.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 1e-12 else x[len(c)])
        c = np.array(c)
        for _ in range(10):
            near = (x @ c.T).argmax(1)
            sums = np.stack([(x * weight[:, None])[near == j].sum(0) for j in range(len(c))])
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
        cost = float((weight * (1 - (x @ c.T).max(1))).sum())
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def moved(told: DataFrame, centres: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by..., centres, shift): the unit means of the clusters of (by..., v, cluster, far) rows.

    A cluster without a vector gets the group's farthest one (one cluster a round; others stay where they are for now).
    """
    means = mean_pool(told, [*by, "cluster"], "v")
    vectors = means.groupBy(*by, "cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("m"))
    vectors = vectors.select(*by, "cluster", l2_normalise(F.transform("m", lambda p: p["mean"]), 1e-8).alias("c"))
    found = vectors.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "c"))).alias("found"))
    joined = centres.join(found, by) if by else centres.crossJoin(F.broadcast(found))
    empty = joined.where(F.size("found") < F.size("centres"))
    if empty.limit(1).count():
        some = told.join(empty.select(*by), by, "left_semi") if by else told
        far = some.groupBy(*by).agg(F.max_by("v", F.struct("far", F.xxhash64("v"))).alias("farthest"))
        joined = joined.join(far, by, "left") if by else joined.crossJoin(F.broadcast(far))
    else:
        joined = joined.withColumn("farthest", F.lit(None).cast("array<double>"))
    numbers = F.sequence(F.lit(0), F.size("centres") - 1)
    first = F.element_at(F.filter(numbers, lambda i: ~F.map_contains_key("found", i)), 1)
    new = F.transform(numbers, lambda i: F.coalesce(F.try_element_at("found", i), F.when(i == F.col("_first"), F.col("farthest")), F.get("centres", i)))
    joined = joined.withColumn("_first", F.when(F.size("found") < F.size("centres"), first)).withColumn("_new", new)
    shift = F.array_max(F.zip_with("centres", "_new", lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))))
    return joined.select(*by, F.col("_new").alias("centres"), shift.alias("shift"))


def spherical_kmeans(vectors: DataFrame, vector: str, k: int, by: list[str] | None = None, rounds: int = 50, seed: int = 0, start: DataFrame | None = None, close: float = 1e-6) -> DataFrame:
    """(by..., centres): k unit vectors for each group (fewer where a group has fewer different vectors).

    ``start`` gives first centres in place of seeding.  Null vectors don't count; vectors of length 0 are in the first cluster.
    """
    by = by or []
    units = _kept(_unit(vectors, vector, by).withColumn("_n", F.monotonically_increasing_id()), "units")
    centres = _kept(seeded(units, by, k, seed) if start is None else start, "centres")
    for _ in range(rounds):
        at, far = nearest_centre(F.col("v"), F.col("centres"))
        pairs = units.join(centres, by) if by else units.crossJoin(F.broadcast(centres))
        told = pairs.select(*by, "v", at.alias("cluster"), far.alias("far"))
        after = _kept(moved(told, centres, by, k), "centres")
        centres = after.select(*by, "centres")
        if not after.where(F.col("shift") > close).limit(1).count():
            break
    return centres


def clustered(vectors: DataFrame, vector: str, centres: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ``cluster``, the number of the nearest of the group's centres; null for null vectors."""
    by = by or []
    at, _ = nearest_centre(l2_normalise(F.col(vector), 1e-8), F.col("centres"))
    pairs = vectors.join(centres, by, "left") if by else vectors.crossJoin(F.broadcast(centres))
    return pairs.withColumn("cluster", at).drop("centres")


def cluster_blobs(patches: DataFrame, k: int = 6, key: str = "uuid", vector: str = "vec", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(patches with ``cluster``, fractions): the patches of each blob clustered by angles among themselves, and (key, cluster,
    n, fraction) for all k clusters of each blob, those without a patch too."""
    centres = spherical_kmeans(patches, vector, k, [key], seed=seed)
    labels = _kept(clustered(patches, vector, centres, [key]), "labels")
    counts = labels.where("cluster is not null").groupBy(key, "cluster").agg(F.count("*").alias("n"))
    whole = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "n"))).alias("m"), F.sum("n").alias("total"))
    every = whole.select(key, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"), "m", "total")
    n = F.coalesce(F.try_element_at("m", F.col("cluster")), F.lit(0))
    return labels, every.select(key, "cluster", n.alias("n"), (n / F.col("total")).alias("fraction"))
