"""Sums over input that is clustered by a key, in one pass and without a shuffle of rows.

Rows of a key stand together, as in logs that are written key by key. A task holds the rows of one key and gives what a
function makes of them when the key changes. Runs at the ends of a partition may go on in the next one; they alone are put together
first. A key that comes again elsewhere breaks the promise: KEY_RETURNS is raised, never a second result given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tidemark.operators.lineage import cut


def flushed(rows: DataFrame, key: str, fold: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """(key, *schema): fold of the rows of each key, given in their order. A null key is a key."""
    kind = rows.schema[key].dataType.simpleString()
    packed = ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rows.schema.fields).replace(", ", ",")
    types: StructType = _parse_datatype_string(f"`{key}` {kind}, run long, edge boolean, held array<struct<{packed}>>, made array<struct<{','.join(':'.join(c.split()) for c in schema.split(', '))}>>")
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = to_arrow_schema(types)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, run, out = None, [], 0, []

        def done(last: bool) -> tuple:
            edge = run == 0 or last  # the run may go on in the partition before or behind
            return (now[0], run, edge, held if edge else None, None if edge else [dict(zip(names, x, strict=True)) for x in fold(held)])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for b in batches:
            for row in b.to_pylist():
                if now != (row[key],):
                    if now:
                        out.append(done(False))
                        run += 1
                    now, held = (row[key],), []
                held.append(row)
            if out:
                yield batch()
                out = []
        if now:
            out.append(done(True))
            yield batch()

    found = cut(rows.mapInArrow(sweep, types).withColumn("part", F.spark_partition_id()))
    # Runs of a key must lie in partitions one after the other, at their touching ends; what they hold is read below.
    spans = found.groupBy(key).agg(F.count("*").alias("runs"), F.count_distinct("part").alias("parts"), F.min("part").alias("a"), F.max("part").alias("z"), F.bool_and("edge").alias("edges"))
    sizes = found.groupBy("part").agg(F.max("run").alias("top"))
    torn = found.join(sizes, "part").join(spans.where("runs > 1").select(F.col(key).alias("_k"), "a", "z"), F.col(key).eqNullSafe(F.col("_k")))
    # In the first partition it is the last run, in the last the first, between them the only one; partitions without rows may lie between.
    odd = ((F.col("part") == F.col("a")) & (F.col("run") != F.col("top"))) | ((F.col("part") == F.col("z")) & (F.col("run") != 0)) | ((F.col("part") > F.col("a")) & (F.col("part") < F.col("z")) & ((F.col("run") != 0) | (F.col("top") != 0)))
    others = sizes.select(F.col("part").alias("_p"))
    between = torn.select("_k", "a", "z").distinct().join(others, (F.col("_p") > F.col("a")) & (F.col("_p") < F.col("z"))).join(torn.select(F.col("_k").alias("_k2"), F.col("part").alias("_p2")), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_p") == F.col("_p2")), "left_anti")
    bad = spans.where("runs <> parts").select(F.col(key).cast("string").alias("k")).unionByName(torn.where(odd).select(F.col(key).cast("string").alias("k"))).unionByName(between.select(F.col("_k").cast("string").alias("k"))).first()
    if bad:
        raise ValueError(f"KEY_RETURNS: {key} {bad.k} comes again after other keys")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        plain = to_arrow_schema(end)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(plain)], schema=plain)

        for b in batches:
            for row in b.to_pylist():
                if now != (row[key],):
                    out += [(now[0], *x) for x in fold(held)] if now else []
                    now, held = (row[key],), []
                held += row["held"]
            if out:
                yield batch()
                out = []
        if now and (out := [(now[0], *x) for x in fold(held)]):
            yield batch()

    end: StructType = _parse_datatype_string(f"`{key}` {kind}, {schema}")
    inner = found.where("NOT edge").select(key, F.explode("made").alias("m")).select(key, "m.*")
    ends = found.where("edge").select(key, "part", "run", "held").repartition(key).sortWithinPartitions(key, "part", "run").mapInArrow(merged, end)
    return inner.unionByName(ends)
