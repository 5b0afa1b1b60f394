"""Near-duplicate vectors: int8 products of tiles with rigorous error bounds.

Equal vectors of a label are folded into one weighted node. The nodes of a label (and length) are
dealt to tiles of about TILE nodes, and every two tiles of a label meet in one group, whose size so
has a bound whatever the label's share of the rows. There each unit vector u becomes s * q with
q in -127..127 and the rest e = u - s * q, whose norm is kept. By Cauchy and Schwarz

    |<u, v> - s t <q, r>|  <=  |e| + |f| + |e| |f|

so the integer product decides most pairs alone: below the threshold less the bound there is no
link, above the threshold plus the bound there is one. The pairs between are computed again in
double precision from the vectors themselves.

A group returns no pairs: for each node that has a link there, the weight it links with and the
smallest node that the group's links reach. Sums and components come from these rows, at most two
tiles of them for each group, also where thousands of near copies are all linked. The products
grow with the square of a label's distinct vectors, as the threshold admits no smaller exact set.

Null, empty or zero vectors, those with null or non-finite components, and rows with a null label
link with nothing. Vectors of different lengths are not compared. Repeated rows and equal ids are
vectors of their own. A null id keeps its row and takes part in links, but names a component only if
all its ids are null (component is then null). Vectors of any length are taken whole; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.simhash import components

#: Nodes of a tile, on average.
TILE = 2048
#: Rows of a tile that meet the other tile at once.
STRIP = 256
#: Components whose products float32 sums without rounding: 127 * 127 * 1024 < 2 ** 24.
EXACT = 1024
#: Allowance for the rounding of doubles in norms and bounds.
ROUNDING = 1e-9
THRESHOLD = 0.93


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision. A power of two scales first, which rounds nothing and keeps squares finite."""
    _, power = np.frexp(np.abs(vectors).max(1))
    scaled = np.ldexp(vectors, -power[:, None])
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error): unit = scale * q + rest, q in -127..127 and error the norm of the rest."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1)) + ROUNDING


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of int8 rows."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        total += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return total


def linked(a: tuple, b: tuple, threshold: float, strip: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of a, rows of b, pairs computed again) of the links between rows (unit, q, scale, error).
    strip: a is the rows of b from there on, and each pair counts once; None: they are different tiles."""
    (u, q, s, e), (v, r, t, f) = a, b
    near = product(q, r) * s[:, None] * t[None, :]
    bound = e[:, None] + f[None, :] + e[:, None] * f[None, :]
    sure, perhaps = near - bound >= threshold, near + bound >= threshold
    if strip is not None:
        later = np.arange(len(v))[None, :] > strip + np.arange(len(u))[:, None]
        sure, perhaps = sure & later, perhaps & later
    i, j = np.nonzero(perhaps & ~sure)
    again = [np.einsum("ij,ij->i", u[i[k : k + 8192]], v[j[k : k + 8192]]) >= threshold for k in range(0, len(i), 8192)]
    found = np.concatenate(again) if again else np.zeros(0, bool)
    x, y = np.nonzero(sure)
    return np.concatenate([x, i[found]]), np.concatenate([y, j[found]]), len(i)


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Takes the links (a, b) into root, where each place points at the smallest place it reaches."""
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for at in (a, b):
            np.minimum.at(root, before[at], low)
            np.minimum.at(root, at, low)
        while not np.array_equal(root, jump := root[root]):
            root[:] = jump
        if np.array_equal(root, before):
            return


def tile_links(node: np.ndarray, tile: np.ndarray, weight: np.ndarray, vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, weight of its links, smallest node reached) of the nodes with a link between the tiles, or within the only one."""
    order = np.lexsort((node, tile))
    node, tile, weight, vectors = node[order], tile[order], weight[order], vectors[order]
    first = int((tile == tile[0]).sum())
    unit = units(vectors)
    q, s, e = quantised(unit)
    alone = first == len(node)
    other = slice(0, first) if alone else slice(first, len(node))
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    for at in range(0, first, STRIP):
        rows = slice(at, min(first, at + STRIP))
        a, b, _ = linked(tuple(x[rows] for x in (unit, q, s, e)), tuple(x[other] for x in (unit, q, s, e)), threshold, at if alone else None)
        a, b = a + at, b + other.start
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        if len(a):
            joined(root, a, b)
    low = node.copy()
    np.minimum.at(low, root, node)
    some = links > 0
    return node[some], links[some], low[root][some]


def clusters(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(id, n_links, component): one row for each row; see the module for the rules."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    vector = F.col(vec_col).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.coalesce(F.col(label_col).isNotNull() & F.exists(vector, lambda x: x != 0) & ~F.exists(vector, odd), F.lit(False))
    hashes = [F.xxhash64(F.lit(k), label_col, vector).alias(f"h{k}") for k in (1, 2)]
    seen = cut(rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(fit, vector).alias("vector"), fit.alias("fit"), *hashes))
    folded = seen.where("fit").groupBy("h1", "h2").agg(F.min("id").alias("low"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = cut(folded.select("h1", "h2", "low", "weight", F.xxhash64("label", F.size("vector")).alias("label"), F.col("vector").alias("vector"), F.monotonically_increasing_id().alias("node")))
    met = cut(met_in_tiles(nodes, threshold, tile))
    degree = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "of")
    placed = nodes.select("h1", "h2", "node", "low", "weight").join(degree, "node", "left").join(found, F.col("node") == F.col("of"), "left")
    placed = cut(placed.select("h1", "h2", F.coalesce("component", "node").alias("component"), "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    names = placed.groupBy("component").agg(F.min("low").alias("name"))
    named = placed.join(names, "component").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "name", "n_links")
    out = seen.select("id", "fit", "h1", "h2").join(named, F.col("fit") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("fit"), F.col("name")).otherwise(F.col("id")).alias("component"))


def met_in_tiles(nodes: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(node, links, low) of each group of two tiles, from nodes (node, label, weight, vector)."""
    sizes = nodes.groupBy("label").agg(F.ceil(F.count("*") / tile).alias("tiles"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    dealt = nodes.select("node", "label", "weight", "vector").join(sizes, "label").withColumn("tile", own)
    pairs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    meeting = dealt.select("node", "label", "weight", "vector", "tile", pairs).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})

    def run(group: pa.Table) -> pa.Table:
        vectors = group["vector"].combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        columns = tile_links(*[group[c].to_numpy() for c in ("node", "tile", "weight")], flat, threshold)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "low"])

    return meeting.drop("other").groupBy("label", "i", "j").applyInArrow(run, "node long, links long, low long")


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "embeddings"))
    kept = F.col("id").eqNullSafe(F.col("component"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(degree.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN degree ON degree.a = v.vec_id
"""

QUERIES = {"op13_embeddings": op13_embeddings}
ORACLES = {"op13_embeddings": OP13_SQL}
