"""Typed file sources and sinks: declared schemas, hash gates, candidate-then-publish writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "timestamp_utc string, open double, high double, low double, close double, volume double, turnover double"


def scan_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """CSV (plain or gzip) under a declared schema; strict fails on malformed rows. Columns are pruned in the scan."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    return rows.select(*columns) if columns else rows


def scan_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as text alone, nulls as empty texts."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).na.fill("")


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema."""
    return spark.read.schema(schema).json(path)


def bars_of(rows: DataFrame, symbol: str) -> DataFrame:
    """Bars with epoch seconds t from rows with an ISO timestamp."""
    t = F.unix_seconds(F.to_timestamp("timestamp_utc")).alias("t")
    return rows.select(F.lit(symbol).alias("symbol"), t, "open", "high", "low", "close", "volume", "turnover")


def epoch_of(value, name: str = "t"):  # noqa: ANN001, ANN201
    """Epoch seconds from text that holds seconds, milliseconds (above 1e10) or ISO time."""
    number = F.try_to_number(value, F.lit("99999999999999")).cast("long")
    return F.when(F.abs(number) > 10_000_000_000, F.floor(number / 1000)).when(number.isNotNull(), number).otherwise(F.unix_seconds(F.try_to_timestamp(value))).cast("long").alias(name)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pinned(spark: SparkSession, path: str, sha256: str, schema: str) -> DataFrame:
    """A CSV scan that refuses files whose hash isn't the one given."""
    found = [r["sha256"] for r in file_hashes(spark, path).limit(2).collect()]
    if found != [sha256]:
        raise ValueError(f"{path}: hash differs")
    return scan_csv(spark, path, schema)


def publish(rows: DataFrame, staging: str, final: str, checks: DataFrame | None = None) -> None:
    """Writes rows to staging, refuses if checks has rows, then writes what was staged to its place."""
    rows.write.mode("overwrite").parquet(staging)
    if checks is not None and checks.limit(1).count():
        raise ValueError("checks failed; nothing published")
    rows.sparkSession.read.parquet(staging).write.mode("overwrite").parquet(final)


def canonical_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a digest of a table that doesn't depend on the order of rows. Cells carry their lengths, nulls a mark of their own."""
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    text = F.concat_ws("|", *[cell(c) for c in columns])
    parts = [F.conv(F.substring(F.sha2(text, 256), 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)") for k in range(4)]
    return rows.select(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.coalesce(F.sum(f"p{k}"), F.lit(0)).cast("string") for k in range(4)]).alias("digest"))
