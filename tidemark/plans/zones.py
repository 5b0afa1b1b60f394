"""The tables of the hierarchical zone machine over hourly bars: one run, typed outputs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import zones as Z
from tidemark.sources.bars import bars


def zone_table(spark: SparkSession, sf_dir: str, kind: str, hours: int = 1) -> DataFrame:
    return Z.table(Z.run(bars(spark, sf_dir, hours)), kind)


#: A program's outputs are beyond SQL; tests compare them with definitions row by row.
QUERIES = {f"zone_{kind.lower()}s": partial(zone_table, kind=kind) for kind in Z.TABLES}
ORACLES: dict[str, str] = {}
