"""Platforms: stretches in which the log price stays near where they began, and null models of their number.

A stretch begins at a bar with a known volatility and keeps that bar's price and band. It ends once two closes in a row
lie clear of the band, at its last bar inside; the next one begins right behind that bar, so the program goes
back over bars it has seen. A stretch of LEAST bars or more is a platform; while it lasts it is known as one from its LEAST-th bar on.

Null models resample the changes of the log price: a permutation breaks all order, blocks of a few bars keep the clusters of
volatility. Each replicate is a series of its own; its changes come by a join on (symbol, place) that
hashes choose, so no task gathers a series to shuffle it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import machines as M
from tidemark.operators.programs import Program, Rows, Step

# Fixed values of the surveyed rules.
VOLATILITY_BARS, LEAST_CHANGES, BAND, CLEAR, CONFIRM, LEAST, BLOCK = 14, 3, 1.5, 0.5, 2, 6, 6


def chance(*parts: Column | str) -> Column:
    """A whole number under 2 ** 32 from a hash of parts, the same in every engine that has MD5."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def changes(bars: DataFrame) -> DataFrame:
    """(symbol, i, p, dp): the log of the close and its change, null on the first bar. Closes of 0 or less have none and are left out."""
    x = S.position(bars.where("close > 0").withColumn("p", F.ln("close")))
    return x.select("symbol", "i", "t", "p", (F.col("p") - F.lag("p").over(S.order())).alias("dp"))


def with_volatility(paths: DataFrame) -> DataFrame:
    """paths (key, i, p) with v, the deviation of the last changes, null before there are LEAST_CHANGES; both rounded, so that equal sums in another order decide alike."""
    order = Window.partitionBy("key").orderBy("i")
    x = paths.withColumn("dp", F.col("p") - F.lag("p").over(order))
    frame = order.rowsBetween(-(VOLATILITY_BARS - 1), 0)
    v = F.when(F.count("dp").over(frame) >= LEAST_CHANGES, F.stddev_pop("dp").over(frame))
    return x.select("key", "i", F.round("p", 9).alias("p"), F.round(v, 9).alias("v"))


def resampled(found: DataFrame, replicates: int, kind: str) -> DataFrame:
    """(symbol, replicate, i, p): paths from 0 over resampled changes; kind is shuffle or block."""
    moves = found.where("dp IS NOT NULL").select("symbol", F.col("i").alias("place"), "dp")
    sizes = moves.groupBy("symbol").agg(F.count("*").alias("n"))
    each = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    if kind == "shuffle":
        drawn = moves.select("symbol", "place", "dp", each)
        by = Window.partitionBy("symbol", "replicate").orderBy(chance("symbol", "replicate", "place"), "place")
        steps = drawn.withColumn("i", F.row_number().over(by))
    else:
        blocks = sizes.where(F.col("n") > BLOCK).select("symbol", "n", each).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("b"))
        begin = F.pmod(chance("symbol", "replicate", "b"), F.col("n") - BLOCK) + 1
        places = blocks.select("symbol", "n", "replicate", "b", begin.alias("begin"), F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("k"))
        places = places.select("symbol", "replicate", (F.col("b") * BLOCK + F.col("k") + 1).alias("i"), (F.col("begin") + F.col("k")).alias("place"), "n").where("i <= n")
        steps = places.join(moves, ["symbol", "place"])
    path = Window.partitionBy("symbol", "replicate").orderBy("i")
    steps = steps.select("symbol", "replicate", F.col("i").cast("long").alias("i"), F.sum("dp").over(path).alias("p"))
    first = sizes.select("symbol", each, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("p"))
    return steps.unionByName(first)


def stretches(band: float):  # noqa: ANN201
    """The program: (first, last) bar of every stretch, in order; together they cover all bars with a volatility."""

    def program(rows: Rows) -> Step:
        i = 0
        while (yield from rows.has(i)):
            start = rows[i]
            if not start["v"]:
                i += 1
                rows.forget(i)
                continue
            width, clear = band * start["v"], (band + CLEAR) * start["v"]
            last, out, j = i, 0, i + 1
            while out < CONFIRM and (yield from rows.has(j)):
                off = abs(rows[j]["p"] - start["p"])
                out = out + 1 if off > clear else 0
                if off <= width:
                    last = j
                    rows.forget(last)
                j += 1
            yield {"first": start["i"], "last": start["i"] + last - i}
            i = last + 1  # goes back behind the last bar inside
            rows.forget(i)

    return program


def segments(paths: DataFrame, band: float = BAND) -> DataFrame:
    """(key, first, last) of the stretches of paths (key, i, p, v)."""
    return M.run(paths, "key", ["i"], lambda: Program(stretches(band), ["first", "last"]), "first long, last long")


def measured(found: DataFrame, sizes: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, platforms, coverage, median_bars, mean_bars, forming) of stretches; sizes: (key, bars). forming is the share of bars on which no platform is known."""
    bars = F.col("last") - F.col("first") + 1
    long = bars >= least
    sums = found.groupBy("key").agg(F.count(F.when(long, 1)).alias("platforms"), F.coalesce(F.sum(F.when(long, bars)), F.lit(0)).alias("covered"), F.coalesce(F.percentile(F.when(long, bars), 0.5), F.lit(0.0)).alias("median_bars"), F.coalesce(F.avg(F.when(long, bars)), F.lit(0.0)).alias("mean_bars"))
    known = F.coalesce(F.col("covered") - F.col("platforms") * (least - 1), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return sizes.join(sums, "key", "left").select("key", F.coalesce("platforms", F.lit(0)).cast("long").alias("platforms"), F.coalesce(F.col("covered") / F.col("bars"), F.lit(0.0)).alias("coverage"), zero("median_bars"), zero("mean_bars"), (1 - known / F.col("bars")).alias("forming"))


def against_null(found: DataFrame, replicates: int) -> DataFrame:
    """(symbol, model, statistic, real, null_mean, null_deviation, p): p is the share of replicates that reach the real value. found: changes()."""
    real = found.select(F.col("symbol").alias("key"), "i", "p")
    names = ("platforms", "coverage", "median_bars")
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in names])).alias("s")
    sized = lambda paths: paths.groupBy("key").agg(F.count("*").alias("bars"))
    told = lambda paths: measured(segments(with_volatility(paths)), sized(paths)).select("key", stack).select("key", "s.*")
    keyed = None
    for kind in ("shuffle", "block"):
        one = resampled(found, replicates, kind).select(F.concat_ws("|", "symbol", F.lit(kind), F.col("replicate").cast("string")).alias("key"), "i", "p")
        keyed = one if keyed is None else keyed.unionByName(one)
    part = lambda k: F.element_at(F.split("key", r"\|"), k)
    nulls = told(keyed).select(F.expr("substring_index(key, '|', size(split(key, '[|]')) - 2)").alias("symbol"), part(-2).alias("model"), "statistic", "value")
    both = nulls.join(told(real).select(F.col("key").alias("symbol"), "statistic", F.col("value").alias("real")), ["symbol", "statistic"])
    return both.groupBy("symbol", "model", "statistic").agg(F.first("real").alias("real"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_deviation"), F.avg((F.col("value") >= F.col("real")).cast("double")).alias("p"))


def overlap_of_grid(found: DataFrame, bands: tuple[float, ...], leasts: tuple[int, ...]) -> DataFrame:
    """(symbol, a, b, overlap): shared bars over all bars of the platforms of two settings (band, least bars); 1 where neither has any."""
    paths = with_volatility(found.select(F.col("symbol").alias("key"), "i", "p"))
    bars = F.col("last") - F.col("first") + 1
    parts = []
    for band in bands:
        each = segments(paths, band).select("key", "first", "last", bars.alias("bars"))
        parts += [each.where(F.col("bars") >= n).select("key", F.lit(f"{band}/{n}").alias("setting"), F.explode(F.sequence("first", "last")).alias("i")) for n in leasts]
    marks = parts[0]
    for more in parts[1:]:
        marks = marks.unionByName(more)
    # A bar's settings stand beside each other; pairs of settings, whose number is fixed, are counted by bar.
    settings = [f"{band}/{n}" for band in bands for n in leasts]
    by_bar = marks.groupBy("key", "i").agg(F.collect_set("setting").alias("has"))
    pairs = [(a, b) for k, a in enumerate(settings) for b in settings[k + 1 :]]
    has = lambda x: F.array_contains("has", x)
    counts = by_bar.groupBy("key").agg(*[F.struct(F.count(F.when(has(a) & has(b), 1)).alias("both"), F.count(F.when(has(a) | has(b), 1)).alias("either")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    whole = found.select(F.col("symbol").alias("key")).distinct().join(counts, "key", "left")
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(f"p{k}.either") > 0, F.col(f"p{k}.both") / F.col(f"p{k}.either")).otherwise(1.0).alias("overlap")) for k, (a, b) in enumerate(pairs)])).alias("r")
    return whole.select(F.col("key").alias("symbol"), rows).select("symbol", "r.*")
