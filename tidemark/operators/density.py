"""Density clusters (DBSCAN) over numeric columns, exact, by grids.

Equal points are folded into one with a weight. Cells are so wide that all points of one are neighbours: a cell
with MIN_POINTS points has core points only and none of its pairs is looked at. Only points of sparser cells, which are few
to a cell, look for neighbours in the cells within reach. Cells with core points form a graph; whether two
of them hold a pair within eps is asked of boxes: the box of each cell's core points tells most pairs by its nearest
and furthest distance, the rest are split and asked again. So no step pairs the points of two full cells.

A cluster is named by its first core point in the order of the keys; a border point goes to the first cluster, in
that order, that has a core point within eps; noise has no cluster. Rows with a null or non-finite feature are noise.
Repeated rows are points of their own."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

MIN_POINTS = 4
#: Dimensions for which the cells within reach are enumerated.
MOST_DIMENSIONS = 5
#: Points of a cell at which the search for the nearest neighbours starts.
LOAD = 32


def squared(a: str, b: str) -> Column:
    """Squared distance of two array columns, summed from the first dimension on."""
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def cell_of(point: str, width: Column | float) -> Column:
    return F.transform(point, lambda x: F.floor(x / width).cast("long"))


def longs(values: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def around(rows: DataFrame, cell: str, offsets: list[tuple[int, ...]], out: str) -> DataFrame:
    """rows once for each offset, with the cell there as out."""
    each = rows.withColumn("_offset", F.explode(F.array(*[longs(o) for o in offsets])))
    return each.withColumn(out, F.zip_with(cell, "_offset", lambda a, b: a + b)).drop("_offset")


def points_of(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(x, weight, first): distinct points with the number and the first key of their rows."""
    if not 0 < len(columns) <= MOST_DIMENSIONS:
        raise ValueError(f"1 to {MOST_DIMENSIONS} columns")
    good = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in columns])
    x = F.array(*[(F.col(c).cast("double") + 0.0) for c in columns])
    return rows.where(good).groupBy(x.alias("x")).agg(F.count("*").alias("weight"), F.min(F.struct(*keys)).alias("first"))


def neighbour_distance(points: DataFrame, rank: int = MIN_POINTS, share: float = 0.45) -> float | None:
    """The share-quantile (interpolated) over all rows of the distance to the rank-th nearest other row.

    Searches cells of growing width, from one at which no cell is full, and only for points that still lack it; it
    stops once the quantile is known, since what is not found within a width lies beyond it."""
    points = cut(points)
    n, low, high = points.agg(F.sum("weight"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n or n <= rank:
        return None
    d, span = len(points.first()["x"]), max(high - low, 1e-300)
    levels = [span / 2**k for k in range(24)]
    loads = points.select(F.posexplode(F.array(*[F.struct(cell_of("x", w).alias("c")) for w in levels])).alias("k", "c")).groupBy("k", "c").agg(F.count("*").alias("m")).groupBy("k").agg(F.max("m").alias("m")).collect()
    start = next((k for k, m in sorted((r.k, r.m) for r in loads) if m <= LOAD), len(levels) - 1)
    at = share * (n - 1)
    need = math.ceil(at) + 1
    found, open_, width = None, points, levels[start]
    near = list(product((-1, 0, 1), repeat=d))
    while True:
        asked = around(open_.select("x", "weight", cell_of("x", width).alias("at")), "at", near, "cell")
        there = points.select(F.col("x").alias("y"), F.col("weight").alias("m"), cell_of("x", width).alias("cell"))
        gaps = asked.join(there, "cell").withColumn("q", squared("x", "y")).where(F.col("q") <= width * width)
        # Of a point's neighbours the nearest rank + 1 suffice, itself among them; weights count.
        nearest = gaps.groupBy("x", "weight").agg(F.slice(F.sort_array(F.collect_list(F.struct("q", "m"))), 1, rank + 1).alias("near"))
        total = F.aggregate("near", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("q")), lambda s, e: F.struct((s["n"] + e["m"]).alias("n"), F.when(s["q"].isNull() & (s["n"] + e["m"] > rank), e["q"]).otherwise(s["q"]).alias("q")))
        now = cut(nearest.select("x", "weight", F.sqrt(total["q"]).alias("r")).where("r IS NOT NULL"))
        found = now if found is None else cut(found.unionByName(now))
        if (found.agg(F.sum("weight")).first()[0] or 0) >= need:
            break
        open_ = cut(open_.join(now.select("x"), "x", "left_anti"))
        width *= 2
    counts = found.groupBy("r").agg(F.sum("weight").alias("w"))
    return quantile_of_counts(counts, at)


#: Bins of a round of the search for a rank, and the most values that it fetches in the end.
BINS = 1024


def quantile_of_counts(counts: DataFrame, at: float) -> float:
    """The value at a rank from 0, between ranks by interpolation, of values r with weights w. Each round counts the values by
    BINS equal bins of their range and goes on with the bin of the rank."""
    counts = cut(counts)

    def value(rank: int) -> float:
        here, before = counts, 0
        while True:
            low, high, n = here.agg(F.min("r"), F.max("r"), F.count("*")).first()
            if n <= BINS:
                for r, w in sorted((x.r, x.w) for x in here.collect()):
                    before += w
                    if before > rank:
                        return r
            step = (high - low) / BINS
            binned = here.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("r") - low) / step)))
            for k, w in sorted((x.bin, x.w) for x in binned.groupBy("bin").agg(F.sum("w").alias("w")).collect()):
                if before + w > rank:
                    here = binned.where(F.col("bin") == k).drop("bin")
                    break
                before += w

    floor = math.floor(at)
    a = value(floor)
    return a if floor == at else a + (value(floor + 1) - a) * (at - floor)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) reach. Labels spread along edges and jump along labels, so the
    number of rounds grows with the log of the longest path."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = labels.join(spread, "node").select("node", "root", F.least("root", "near").alias("low"))
        # The old root learns what its nodes have found.
        told = moved.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("heard"))
        moved = moved.join(told, "node", "left").select("node", "root", F.least("low", F.coalesce("heard", "low")).alias("low"))
        jump = moved.select(F.col("node").alias("low"), F.col("low").alias("far"))
        now = cut(moved.join(jump, "low").select("node", F.least("low", "far").alias("root"), (F.least("low", "far") != F.col("root")).alias("changed")))
        changed = not now.where("changed").isEmpty()
        labels = now.select("node", "root")
        if not changed:
            return labels


def linked_cells(core: DataFrame, eps: float, width: float, reach: list[tuple[int, ...]]) -> DataFrame:
    """(a, b): cells with core points within eps of each other. core: (x, cell)."""
    d = len(reach[0])
    boxes = lambda by: [F.array(*[f(F.get("x", F.lit(k))) for k in range(d)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]  # noqa: E731, ARG005
    ahead = [o for o in reach if o > (0,) * d]
    cells = core.select("cell").distinct()
    open_ = cut(around(cells.select(F.col("cell").alias("a")), "a", ahead, "b").join(cells.select(F.col("cell").alias("b")), "b").select("a", "b", F.col("a").alias("u"), F.col("b").alias("v")))
    linked, level = None, 0
    gap = lambda lo, hi, LO, HI: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: F.greatest(F.lit(0.0), F.get(LO, k) - F.get(hi, k), F.get(lo, k) - F.get(HI, k))), F.lit(0.0), lambda s, x: s + x * x)  # noqa: E731, N803
    far = lambda lo, hi, LO, HI: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: F.greatest(F.get(HI, k) - F.get(lo, k), F.get(hi, k) - F.get(LO, k))), F.lit(0.0), lambda s, x: s + x * x)  # noqa: E731, N803
    while True:
        unit = core.withColumn("unit", cell_of("x", width / 2**level)).groupBy("cell", "unit").agg(*boxes(None))
        side = lambda c, u, n: unit.select(F.col("cell").alias(c), F.col("unit").alias(u), F.col("lo").alias(f"lo{n}"), F.col("hi").alias(f"hi{n}"))  # noqa: B023, E731
        pairs = open_.join(side("a", "u", 1), ["a", "u"]).join(side("b", "v", 2), ["b", "v"]).select("a", "b", "u", "v", gap("lo1", "hi1", "lo2", "hi2").alias("near"), far("lo1", "hi1", "lo2", "hi2").alias("far"))
        pairs = cut(pairs.where(F.col("near") <= eps * eps))
        sure = pairs.where(F.col("far") <= eps * eps).select("a", "b").distinct()
        linked = cut(sure if linked is None else linked.unionByName(sure))
        rest = pairs.where(F.col("far") > eps * eps).join(linked, ["a", "b"], "left_anti")
        # Halves of the units that are still open.
        halves = list(product((0, 1), repeat=d))
        double = lambda c: F.transform(c, lambda x: x * 2).alias(c)
        open_ = cut(around(around(rest.select("a", "b", double("u"), double("v")), "u", halves, "u"), "v", halves, "v"))
        if open_.isEmpty():
            return linked
        level += 1


def dbscan(rows: DataFrame, keys: list[str], columns: list[str], eps: float, min_points: int = MIN_POINTS) -> DataFrame:
    """rows with cluster (a struct of the keys of its first core point, null for noise) and core."""
    d = len(columns)
    points = cut(points_of(rows, keys, columns))
    width = eps / math.sqrt(d) * (1 - 1e-12)
    steps = range(-math.ceil(math.sqrt(d)), math.ceil(math.sqrt(d)) + 1)
    # Cells that may hold a point within eps: their nearest corners are not further apart.
    reach = [o for o in product(steps, repeat=d) if sum(max(0, abs(x) - 1) ** 2 for x in o) <= d]
    placed = cut(points.withColumn("cell", cell_of("x", width)))
    loads = placed.groupBy("cell").agg(F.sum("weight").alias("load"))
    placed = cut(placed.join(loads, "cell"))
    sparse = placed.where(F.col("load") < min_points)
    there = placed.select(F.col("x").alias("y"), F.col("weight").alias("m"), "cell", F.col("load").alias("there"))
    near = around(sparse.select("x", F.col("cell").alias("at")), "at", reach, "cell").join(there, "cell").where(squared("x", "y") <= eps * eps)
    near = cut(near.select("x", "y", "m", "there", F.col("cell").alias("of")))
    own = near.groupBy("x").agg(F.sum("m").alias("n")).where(F.col("n") >= min_points).select("x")
    core = cut(placed.where(F.col("load") >= min_points).select("x", "cell", "first").unionByName(sparse.join(own, "x", "left_semi").select("x", "cell", "first")))
    edges = linked_cells(core.select("x", "cell"), eps, width, reach)
    alone = core.select("cell").distinct()
    roots = components(edges.unionByName(alone.select(F.col("cell").alias("a"), F.col("cell").alias("b"))))
    names = core.join(roots, F.col("cell") == F.col("node"))
    of_root = names.groupBy("root").agg(F.min("first").alias("cluster"))
    of_cell = cut(roots.join(of_root, "root").select(F.col("node").alias("cell"), "cluster"))
    cores = core.join(of_cell, "cell").select("x", "cluster", F.lit(True).alias("core"))
    core_points = core.select(F.col("x").alias("y"), "cell")
    border = near.join(own, "x", "left_anti").join(core_points.select("y"), "y", "left_semi").join(of_cell.withColumnRenamed("cell", "of"), "of").groupBy("x").agg(F.min("cluster").alias("cluster")).withColumn("core", F.lit(False))
    told = cores.unionByName(border)
    x = F.array(*[(F.col(c).cast("double") + 0.0) for c in columns])
    out = rows.withColumn("_x", x).join(told, F.col("_x") == F.col("x"), "left").drop("_x", "x")
    return out.withColumn("core", F.coalesce("core", F.lit(False)))
