"""Partitions of rows and how far they can be trusted: a grid of k-means runs, their agreement, silhouettes, average linkage, co-clustering.

k-means runs for all numbers of clusters and seeds at once: an iteration is one pass over the rows, from which
come sums by run and cluster; the driver holds centres alone. Agreement of two runs comes from counts of label pairs, never
from pairs of rows. What looks at pairs of rows (silhouette, linkage, co-clustering) does so on a sample of a stated
size, chosen by hash and so the same wherever the rows lie; linkage then assigns every row.

Rows with a null or non-finite column are left out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

#: Rows of a sample for silhouettes, and for linkage.
SILHOUETTE_ROWS, LINKAGE_ROWS = 900, 200
ITERATIONS = 100


def known(rows: DataFrame, columns: list[str]) -> DataFrame:
    good = [F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in columns]
    return rows.where(reduce(lambda a, b: a & b, good))


def sample(rows: DataFrame, keys: list[str], columns: list[str], most: int, seed: int = 0, more: tuple[str, ...] = ()) -> list:
    """At most `most` rows (keys, columns, more) in the order of a hash of their keys and the seed."""
    x = known(rows, columns).select(*keys, *[F.col(c).cast("double").alias(c) for c in columns], *more)
    return x.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(most).collect()


def matrix_of(found: list, columns: list[str]) -> np.ndarray:
    return np.array([[r[c] for c in columns] for r in found], float).reshape(len(found), len(columns))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre, the first of equal ones."""
    return ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)


Run = tuple[int, int]  # clusters, seed


def kmeans_grid(rows: DataFrame, keys: list[str], columns: list[str], ks: tuple[int, ...], seeds: tuple[int, ...], iterations: int = ITERATIONS) -> dict[Run, np.ndarray]:
    """The centres of every run after at most `iterations` passes, in the order of their first column. A run starts from the k rows with the least
    hashes of its seed (fewer if the rows are fewer); a cluster that loses all rows keeps its centre."""
    x = known(rows, columns).select(*[F.col(c).cast("double").alias(c) for c in columns])
    x = cut(x)
    centres: dict[Run, np.ndarray] = {}
    for seed in seeds:
        first = matrix_of(sample(rows, keys, columns, max(ks), seed), columns)
        centres |= {(k, seed): first[:k] for k in ks if len(first)}
    open_ = dict(centres)
    for _ in range(iterations):
        if not open_:
            break
        now = list(open_.items())

        def sums(batches: Iterator[pa.RecordBatch], now: list = now) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(c), len(columns) + 1)) for _, c in now]
            for b in batches:
                v = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
                for t, (_, c) in zip(total, now, strict=True):
                    label = nearest(v, c)
                    np.add.at(t, label, np.column_stack([v, np.ones(len(v))]))
            ids = [(n, j) for n, t in enumerate(total) for j in range(len(t)) if t[j, -1]]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in ids], pa.int32()), pa.array([j for _, j in ids], pa.int32()), pa.array([total[n][j].tolist() for n, j in ids], pa.list_(pa.float64()))], names=["run", "cluster", "sums"])

        parts = x.mapInArrow(sums, "run int, cluster int, sums array<double>")
        # One row for each run and cluster reaches the driver.
        each = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(len(columns) + 1)]
        moved = {run: c.copy() for run, c in now}
        for r in parts.groupBy("run", "cluster").agg(*each).collect():
            v = np.array([r[f"s{j}"] for j in range(len(columns) + 1)])
            moved[now[r.run][0]][r.cluster] = v[:-1] / v[-1]
        open_ = {run: moved[run] for run, c in now if not np.allclose(moved[run], c, rtol=0, atol=1e-12)}
        centres |= moved
    return {run: c[np.lexsort(c.T[::-1])] for run, c in centres.items()}


def labelled(rows: DataFrame, columns: list[str], centres: dict[Run, np.ndarray]) -> DataFrame:
    """rows with labels: the number (from 1) of the nearest centre of every run, in the runs' order."""
    runs = list(centres.values())
    schema = known(rows, columns)
    names = schema.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
            found = np.column_stack([nearest(v, c) + 1 for c in runs]).tolist() if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], names=[*names, "labels"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return schema.mapInArrow(run, f"{out}, labels array<int>")


def rand_index(counts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, ari): the adjusted Rand index of counts (*by, a, b, n) of label pairs; 1 where both partitions are trivial."""
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    cells = counts.groupBy(*by).agg(F.sum("n").alias("n"), pairs("n").alias("same"))
    margins = [counts.groupBy(*by, side).agg(F.sum("n").alias("m")).groupBy(*by).agg(pairs("m").alias(f"of_{side}")) for side in ("a", "b")]
    x = cells.join(margins[0], by).join(margins[1], by)
    chance = F.col("of_a") * F.col("of_b") / F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0))
    x = x.withColumns({"chance": F.coalesce(chance, F.lit(0.0)), "most": (F.col("of_a") + F.col("of_b")) / 2})
    return x.select(*by, F.coalesce(F.try_divide(F.col("same") - F.col("chance"), F.nullif(F.col("most") - F.col("chance"), F.lit(0.0))), F.lit(1.0)).alias("ari"))


def agreement(found: DataFrame, runs: list[Run]) -> DataFrame:
    """(k, a_seed, b_seed, ari) of every two seeds of a number of clusters, from labelled() rows."""
    pairs = [(k, s, t, runs.index((k, s)), runs.index((k, t))) for k, s in runs for l, t in runs if k == l and s < t]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("a_seed"), F.lit(t).alias("b_seed"), F.get("labels", F.lit(i)).alias("a"), F.get("labels", F.lit(j)).alias("b")) for k, s, t, i, j in pairs])).alias("p")
    counts = found.select(each).groupBy("p.k", "p.a_seed", "p.b_seed", "p.a", "p.b").agg(F.count("*").alias("n"))
    return rand_index(counts, ["k", "a_seed", "b_seed"])


def silhouettes(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The silhouette of every row (0 where a cluster is alone): distances to others block by block."""
    kinds, label = np.unique(labels, return_inverse=True)
    sizes = np.bincount(label)
    out = np.zeros(len(x))
    if len(kinds) < 2:
        return out
    member = np.eye(len(kinds))[label]
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        far = np.sqrt(np.maximum(0, ((x[part, None] - x[None]) ** 2).sum(2)))
        sums = far @ member
        own = label[part]
        rows = np.arange(len(own))
        a = np.divide(sums[rows, own], sizes[own] - 1, out=np.zeros(len(own)), where=sizes[own] > 1)
        means = sums / sizes
        means[rows, own] = np.inf
        b = means.min(1)
        out[part] = np.divide(b - a, np.maximum(a, b), out=np.zeros(len(own)), where=np.maximum(a, b) > 0)
    return out


def merges(x: np.ndarray) -> list[tuple[float, int, int, int]]:
    """Average linkage as (height, a, b, size), from the lowest height on: clusters a < b by their first rows, merged into one of that size.

    Follows chains of nearest neighbours: two clusters that are nearest to each other merge, and distances to the merged one are
    weighted means (Lance and Williams), so no list of members is ever averaged again."""
    n = len(x)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    size, alive, chain, out = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.nonzero(alive)[0][0])]
        while True:
            top = chain[-1]
            near = int(np.where(alive, far[top], np.inf).argmin())
            if len(chain) > 1 and far[top, chain[-2]] <= far[top, near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        del chain[-2:]
        a, b = sorted((top, near))
        out.append((float(far[a, b]), a, b))
        far[a] = (size[a] * far[a] + size[b] * far[b]) / (size[a] + size[b])
        far[:, a] = far[a]
        far[a, a], alive[b] = np.inf, False
        size[a] += size[b]
        far[b], far[:, b] = np.inf, np.inf
    out.sort(key=lambda m: m[0])
    sizes = dict.fromkeys(range(n), 1)
    root = list(range(n))

    def top_of(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    told = []
    for height, a, b in out:
        a, b = sorted((top_of(a), top_of(b)))
        root[b] = a
        sizes[a] += sizes[b]
        told.append((height, a, b, sizes[a]))
    return told


def cut_tree(steps: list[tuple[float, int, int, int]], n: int, k: int) -> np.ndarray:
    """Labels from 1 in the order of the clusters' first rows, after all merges but the last k - 1."""
    root = list(range(n))
    for _, a, b, _ in steps[: max(0, n - k)]:
        root[b] = a
    top = []
    for i in range(n):  # a merge points to an earlier row
        top.append(i if root[i] == i else top[root[i]])
    order = {t: j + 1 for j, t in enumerate(sorted(set(top)))}
    return np.array([order[t] for t in top])


def linkage(rows: DataFrame, keys: list[str], columns: list[str], k: int, most: int = LINKAGE_ROWS) -> DataFrame:
    """known rows with cluster: that of the average linkage of a sample of at most `most` rows, or for a row
    outside of it the cluster to whose sampled members its mean distance is least."""
    found = sample(rows, keys, columns, most)
    x = matrix_of(found, columns)
    labels = cut_tree(merges(x), len(x), k) if len(x) else np.zeros(0, int)
    frame = known(rows, columns)
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.array([labels == j for j in range(1, labels.max() + 1)]).T / np.bincount(labels)[1:]
        place = {r.tobytes(): int(c) for r, c in zip(x, labels, strict=True)}
        for b in batches:
            v = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
            out = []
            for at in range(0, len(v), 512):
                part = v[at : at + 512]
                out += ((np.sqrt(((part[:, None] - x[None]) ** 2).sum(2)) @ member).argmin(1) + 1).tolist()
            out = [place.get(r.tobytes(), c) for r, c in zip(v, out, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*names, "cluster"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{schema}, cluster int")


def co_clustered(rows: DataFrame, keys: list[str], columns: list[str], k: int, replicates: int = 500, share: float = 0.8, most: int = LINKAGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pairs, replicates) of average linkage repeated on random shares of the sample: pairs (a, b, drawn, together) by place in
    the sample, a < b, and (replicate, ari) against the linkage of the whole sample. Replicates are dealt to tasks; a task adds up its own before anything is shuffled."""
    spark = rows.sparkSession
    x = matrix_of(sample(rows, keys, columns, most), columns)
    n = len(x)
    whole = cut_tree(merges(x), n, k) if n else np.zeros(0, int)

    def drawn(replicate: int) -> tuple[np.ndarray, np.ndarray]:
        some = np.sort(np.random.default_rng([7, replicate]).choice(n, min(n, max(4, int(n * share))), replace=False))
        return some, cut_tree(merges(x[some]), len(some), k)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, same = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
        for b in batches:
            for r in b.column(0).to_pylist():
                some, labels = drawn(r)
                seen[np.ix_(some, some)] += 1
                same[np.ix_(some, some)] += labels[:, None] == labels[None]
        a, b = np.nonzero(np.triu(seen, 1))
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (a, b, seen[a, b], same[a, b])], names=["a", "b", "drawn", "together"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.column(0).to_pylist():
                some, labels = drawn(r)
                kinds, m = np.unique(np.column_stack([whole[some], labels]), axis=0, return_counts=True)
                out += [(r, int(p), int(q), int(c)) for (p, q), c in zip(kinds, m, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(4)], names=["replicate", "a", "b", "n"])

    ids = spark.range(replicates if n else 0, numPartitions=min(replicates, max(1, spark.sparkContext.defaultParallelism)))
    sums = ids.mapInArrow(pairs, "a long, b long, drawn long, together long").groupBy("a", "b").agg(F.sum("drawn").alias("drawn"), F.sum("together").alias("together"))
    return sums, rand_index(ids.mapInArrow(counts, "replicate long, a long, b long, n long"), ["replicate"])
