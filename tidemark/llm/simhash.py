"""SimHash near-duplicates with pivot distance tables.

A fingerprint's row of the pivot table holds its Hamming distances to fixed reference
fingerprints. Two fingerprints within d bits differ by at most d in every coordinate (triangle
inequality), so a pair with a larger coordinate difference is discarded before verification.

Candidates. The references come in four groups; those of a group differ from the zero fingerprint
only in the group's 16 bits, so their distances, less the distance to zero, depend on these bits
alone. Two differing bits touch at most two groups: on the two others a linked pair agrees in all
coordinates. Each distinct fingerprint is therefore listed under six keys, one for each two groups,
and only fingerprints with an equal key are compared. This loses no link.

Crowded keys. Where more than CROWD distinct fingerprints share a key, pairs are not made. Their
members are listed under the 65 fingerprints within one bit of them instead; two are within two
bits exactly if they share such a neighbour, and each neighbour links its members to the smallest.
A neighbour has 65 members at most, so this is exact, in proportion to the members, and free of
hot keys.

Equal fingerprints are folded before any of this; links between folded rows are joined to
components by min-label steps over the links alone.

Nulls and empty texts have fingerprint zero. A null doc_id keeps its row and takes part in links,
but never names a component unless all ids of the component are null (component_id is then null).
Repeated rows stay, each with its component. clusters() ignores extra columns, keep_one() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_name, table, tasks_for

#: Bits that may differ between linked fingerprints. The key scheme holds for up to 2.
MAX_BITS = 2
#: Distinct fingerprints of a key that are compared in pairs; beyond it, see "Crowded keys".
CROWD = 64
SEED = 42
CHUNK = 1 << 14
#: Edges that a task of components() takes.
TASK_EDGES = 50_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the shingles of a text, repeats included; 0 if it has no words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII space
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found))
    n = len(found) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, th, fp): fp holds the 64 bits as a signed long, th is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fps, pa.int64())], names=["id", "th", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(run, "id long, th long, fp long")


def hadamard_row(row: int) -> int:
    """A row of the 16 x 16 Hadamard matrix as bits: 8 ones, but for row 0, which has 16."""
    return sum(1 << c for c in range(16) if (row & c).bit_count() % 2 == 0)


#: References of each group, besides zero: the rows of the Hadamard matrix whose distances tell
#: most about the 16 bits while none follows from the others' parity.
ROWS = (0, 1, 2, 4, 8, 7, 11)
GROUPS = 4


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame) -> DataFrame:
    """fps and the array pivots: distances to the references, less those to zero, group by group."""
    zero = distance(F.col("fp"), F.lit(0).cast("long"))
    cells = [(distance(F.col("fp"), F.lit(signed(hadamard_row(r) << (16 * g))).cast("long")) - zero).cast("tinyint") for g in range(GROUPS) for r in ROWS]
    return fps.withColumn("pivots", F.array(*cells))


def links(fps: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(a, b): reps of distinct fingerprints within max_bits, by way of pairs or shared neighbours.

    fps: (fp, rep), one row for each distinct fp. The links' closure is that of all close pairs."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    k = len(ROWS)
    part = lambda g: F.slice("pivots", g * k + 1, k)
    keys = F.array(*[F.xxhash64(F.lit(i), part(g), part(h)) for i, (g, h) in enumerate(combinations(range(GROUPS), 2))])
    listed = cut(pivot_table(fps).select("fp", "rep", "pivots", F.explode(keys).alias("key")))
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    small = listed.join(sizes.where(F.col("n") <= crowd).select("key"), "key")
    a, b = small.alias("a"), small.alias("b")
    apart = F.array_max(F.zip_with("a.pivots", "b.pivots", lambda x, y: F.abs(x - y)))
    # A reference's distance less that to zero moves by two per differing bit at most.
    pairs = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
        .where(apart <= 2 * max_bits)
        .where(distance(F.col("a.fp"), F.col("b.fp")) <= max_bits)
        .select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    )
    crowded = listed.join(sizes.where(F.col("n") > crowd).select("key"), "key", "left_semi").select("fp", "rep").distinct()
    return pairs.unionByName(neighbour_links(crowded, max_bits)).distinct()


def neighbour_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of fingerprints that share a fingerprint within one bit; exact for max_bits 2."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)).cast("long") for i in range(64)])
    near = fps.select("fp", "rep", F.explode(flips).alias("flip")).select("rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"), "fp")
    if max_bits < 2:  # a shared neighbour would allow two bits: only a member itself may be shared
        near = near.where((F.col("near") == F.col("fp")) | F.lit(max_bits == 1))
        own = near.where(F.col("near") == F.col("fp")).select("near", F.col("rep").alias("b"))
        return near.join(own, "near").where(F.col("rep") != F.col("b")).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    first = near.groupBy("near").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("near", "a")
    return near.join(first, "near").where(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach. Alternating large and small
    stars: every step keeps the closure, and the number of steps grows with the log of the longest path.
    No step adds edges, so each runs in as many tasks as the edges left need."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = now.count()
    while True:
        tasks = tasks_for(n, TASK_EDGES)
        n, open_ = unfinished(now := now.coalesce(tasks), tasks)
        if not open_:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now = cut(star_step(now, tasks))


def unfinished(edges: DataFrame, tasks: int) -> tuple[int, int]:
    """Edges (a, b), a over b, and nodes at which they are not yet stars around the smallest node."""
    ends = F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("up")), F.struct(F.col("b").alias("u"), F.lit(0).alias("up")))
    around = edges.select(F.inline(ends)).groupBy("u").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).coalesce(tasks)
    got = around.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if((F.col("ups") > 0) & (F.col("n") > 1))).first()
    return got[0], got[1]


def star_step(edges: DataFrame, tasks: int) -> DataFrame:
    """A large and a small star of edges (a, b), a over b."""
    low = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    large = edges.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
    small_low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(small_low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").coalesce(tasks).distinct().coalesce(tasks)


#: Stand-ins for null ids lie above all ids.
NO_ID = 1 << 62


def rep_of(id_: Column, fp: Column) -> Column:
    return F.coalesce(id_, F.shiftrightunsigned(F.xxhash64(fp), 2) + F.lit(NO_ID))


def grouped(seen: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """seen (id, fp, ...) with component: the smallest id reached, or a stand-in from NO_ID on."""
    folded = fold(seen)
    return named(seen, folded, links(folded, max_bits))


def fold(seen: DataFrame) -> DataFrame:
    """(fp, rep): the smallest id of each fp, or a stand-in."""
    return cut(seen.groupBy("fp").agg(F.min("id").alias("low")).select("fp", rep_of(F.col("low"), F.col("fp")).alias("rep")))


def named(seen: DataFrame, folded: DataFrame, edges: DataFrame) -> DataFrame:
    """seen with component, by edges (a, b) of reps."""
    found = components(edges)
    names = folded.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return seen.join(names, "fp")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component): one row for each row of docs."""
    found = grouped(cut(fingerprints(docs, id_col, text_col, shingle)), max_bits)
    return found.select("id", "fp", F.when(F.col("component") < NO_ID, F.col("component")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component: that of the smallest id (of several texts under it, that of the
    smallest hash; of repeated rows, one)."""
    seen = cut(fingerprints(docs, id_col, text_col, shingle))
    return chosen(docs, grouped(seen, max_bits), id_col, text_col)


def chosen(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that name their components; found: (id, th, fp, component) of each row."""
    best = F.struct("th", F.lit(0))
    rows = found.where(rep_of(F.col("id"), F.col("fp")) == F.col("component"))
    chosen = cut(rows.groupBy("component").agg(F.min(best).alias("best"), F.min("id").alias("low"), F.count("*").alias("n")))
    kept_id, kept_th = free_name("kept_id", docs), free_name("kept_th", docs)
    match = F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(kept_th))
    own = lambda which: docs.join(chosen.where(which).select(F.col("low").alias(kept_id), F.col("best.th").alias(kept_th)), match, "left_semi")
    return own("n = 1").unionByName(own("n > 1").dropDuplicates([id_col, text_col]))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
