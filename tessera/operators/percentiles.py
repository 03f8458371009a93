"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAN = 16  # a group is cut into FAN * FAN ranges


def exact_percentiles(rows: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """(by..., p0, p1, ...): percentiles with linear interpolation, one for each of ``shares``; null values don't count.

    A group is cut into ranges at approximate quantiles and only counted by range, a small row a task and range; the ranges that
    hold the wanted ranks are the only ones whose values are shuffled (equal ones as one row a task) and sorted.  So no task
    gets a whole group, and most values stay where they are.  ``rows`` are read three times: stage them if they are dear.
    Groups without a value have no row.
    """
    if not by:
        alone = exact_percentiles(rows.withColumn("_all", F.lit(0)), ["_all"], value, shares)
        return alone.drop("_all")
    told = rows.select(*by, value.cast("double").alias("v")).where("v is not null")
    steps = [i / FAN**2 for i in range(1, FAN**2)]
    cuts = told.groupBy(*by).agg(F.percentile_approx("v", steps, 10 * FAN**2).alias("cuts"), F.count("*").alias("total"))
    groups = [F.slice("cuts", i * FAN + 1, FAN) for i in range(FAN)]
    # the last cut of each FAN, and each FAN's cuts: a value is looked for among the first, then in one of the others
    cuts = cuts.select(*by, "total", F.transform(F.array(*groups[:-1]), lambda g: g[FAN - 1]).alias("tops"), F.array(*groups).alias("cuts"))
    below = lambda array: F.size(F.filter(array, lambda c: c < F.col("v")))
    outer = _joined(told, cuts, by).withColumn("outer", below("tops"))
    placed = outer.withColumn("span", F.col("outer") * (FAN + 1) + below(F.get("cuts", F.col("outer")))).select(*by, "span", "v", "total")
    spans = placed.groupBy(*by, "span").agg(F.count("*").alias("size"), F.first("total").alias("total"))
    each = spans.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("span", "size"))).alias("s"), F.first("total").alias("total"))  # FAN * FAN at most
    start = lambda s: F.aggregate(F.filter("s", lambda t: t["span"] < s["span"]), F.lit(0).cast("long"), lambda n, t: n + t["size"])
    rank = [F.lit(float(q)) * (F.col("total") - 1) for q in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(r), F.ceil(r)) for r in rank])))
    begun = F.transform("s", lambda s: F.struct(s["span"].alias("span"), start(s).alias("start"), s["size"].alias("size")))
    mine = F.transform(begun, lambda s: F.struct(s["span"].alias("span"), s["start"].alias("start"), F.filter(ranks, lambda r: (r >= s["start"]) & (r < s["start"] + s["size"])).alias("ranks")))
    wanted = each.select(*by, F.explode(F.filter(mine, lambda s: F.size(s["ranks"]) > 0)).alias("w")).select(*by, "w.*")
    near = _joined(placed, wanted, [*by, "span"]).groupBy(*by, "span", "v", "start", "ranks").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    sorted_in = W.partitionBy(*by, "span").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("first", F.col("start") + F.coalesce(F.sum("n").over(sorted_in), F.lit(0)))
    hit = near.withColumn("rank", F.explode(F.filter("ranks", lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("n")))))
    ends = hit.groupBy(*by).agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("at"), F.first("total").alias("total"))  # two a share
    low = [F.element_at("at", F.floor(r)) for r in rank]
    high = [F.element_at("at", F.ceil(r)) for r in rank]
    return ends.select(*by, *[(a + (b - a) * (r - F.floor(r))).alias(f"p{i}") for i, (a, b, r) in enumerate(zip(low, high, rank, strict=True))])


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """An inner join on columns that may be null."""
    b = b.select(*[F.col(c).alias(f"_b_{c}") if c in by else F.col(c) for c in b.columns if c not in a.columns or c in by])
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return a.join(b, same).drop(*[f"_b_{c}" for c in by])
