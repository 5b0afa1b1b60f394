"""Sections of dispute in a rising trend: windows that open and resolve, their merging, and chains of episodes.

windows() and sections() are declarative. A window opens where agreement was lost before a trigger and closes when
three of four bars have recovered or taken the other configuration, whichever is first. Windows that overlap, or between
which no recovery was confirmed, merge.

chains() is a program: within a section, attempts to recover go on probation; a failed one rewinds the cursor to
the bar of its failure, where the next episode begins. Three versions differ in what an attempt must show."""

from __future__ import annotations

from collections.abc import Callable, Generator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import machines as M
from tidemark.operators import zones as Z
from tidemark.operators.programs import Program, Rows, Step

# Fixed values of the surveyed rules.
REACH, FALLBACK, SHORT_GAP, FEW = 30, 12, 4, 3
#: By probation: bars, least closes above the average, bars on which it doesn't fall, bars on which the gap doesn't shrink, aligned among the last four, closes above the reset level.
PROBATIONS = {"RECOVERY": (24, 18, 16, 14, 3, 0), "STRONG_RECOVERY": (6, 5, 4, 4, 0, 0), "MODERATE_RECOVERY": (12, 9, 8, 7, 3, 0), "STRUCTURAL_RESET": (6, 5, 4, 0, 0, 4), "INTERNAL_RECOVERY": (24, 18, 16, 14, 3, 0)}
CONFIRMED = {"RECOVERY": "CONFIRMED_RECOVERED_LONG", "INTERNAL_RECOVERY": "CONFIRMED_PERSISTENT_INTERNAL_RECOVERY"}
OTHER_BARS, OTHER_BELOW, OTHER_CLOSES, OTHER_FALLING = 8, 7, 6, 6
EXTENSION, CLEAR, PERSISTENT, STRONG, MODERATE, RESET_CLEAR = 0.75, 0.25, 5, 4, 3, 0.15
VERSIONS = ("R3", "R4", "R5")

TABLES = {
    "SECTION": "section long, start long, effective long, confirmed long, resolution string, episodes long, cores long, attempts long, failed long, configurations long, high double, low double",
    "EPISODE": "section long, episode long, start long, end long, reason string, cores long, attempts long, below long, crossed boolean, depth double",
    "ATTEMPT": "section long, episode long, attempt long, type string, effective long, detected long, score long, upgrade long, ceiling double, level double, clearance double, required long, seen long, status string, failed_at long, reason string, above long, rising long, widening long, final4 long",
    "CONFIGURATION": "section long, episode long, attempt long, effective long, detected long, seen long, status string, failed_at long, reason string, below long, closes_below long, falling long",
    "EVENT": "section long, episode long, seq long, event string, t long",
}


def columns_of(kind: str) -> dict[str, str]:
    return dict(c.split() for c in TABLES[kind].split(", "))


COLUMNS = {c: t for kind in TABLES for c, t in columns_of(kind).items()}


def features(bars: DataFrame) -> DataFrame:
    """Zone features and the bars' configurations: recovered is agreement in a rising trend, other its opposite below the slow average."""
    x = S.position(Z.features(bars))
    back = lambda c, n=1: F.lag(c, n).over(S.order())
    true = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumn("gap1", F.col("gap") - back("gap"))
    other = true((F.col("ema27") < F.col("ema200")) & (F.col("close") < F.col("ema27")) & (F.col("change") < 0) & (F.col("gap1") <= 0))
    cross = true((F.col("ema27") <= F.col("ema200")) & (back("ema27") > back("ema200")))
    return x.withColumns({"other": other, "cross": cross})


def first_from(flag: str, start: int = 0):  # noqa: ANN201
    """Number of the first bar from start bars on that has the flag; the frame may be as long as the series, Spark takes one running minimum from behind."""
    behind = Window.partitionBy("symbol").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, -start)
    return F.min(F.when(F.col(flag), F.col("i"))).over(behind)


def windows(x: DataFrame) -> DataFrame:
    """(symbol, trigger, start, run_end, candidate, end, resolution) by number of bar, for each trigger of features()."""
    four = S.last(4)
    count = lambda c: F.sum(F.col(c).cast("int")).over(four)
    first_of = lambda c: F.min(F.when(F.col(c), F.col("i"))).over(four)
    whole = F.col("i") >= 3
    latest = lambda c: F.max(c).over(S.order().rowsBetween(Window.unboundedPreceding, -1))
    y = x.withColumns(
        {
            "run3": whole & (count("aligned") >= 3), "last_aligned": F.max(F.when(F.col("aligned"), F.col("i"))).over(S.order().rowsBetween(Window.unboundedPreceding, 0)),
            "back3": whole & (count("aligned") >= 3), "other3": whole & (count("other") >= 3), "back_first": first_of("aligned"), "other_first": first_of("other"),
            "opens": F.col("context") & ((F.col("discord") >= 2) | ((F.col("discord") >= 1) & F.coalesce(F.lead("context").over(S.order()) & (F.lead("discord").over(S.order()) >= 1), F.lit(False)))),
        }
    ).withColumns({"done": F.col("back3") | F.col("other3"), "run_at": latest(F.when(F.col("run3"), F.struct("i", "last_aligned")))})
    y = y.withColumns({"opens_at": first_from("opens"), "done_at": first_from("done"), "last": F.max("i").over(Window.partitionBy("symbol"))})
    found = F.col("run_at.i") >= F.greatest(F.lit(0), F.col("i") - REACH) + 3
    triggers = y.where("core").select("symbol", F.col("i").alias("trigger"), "done_at", "last", F.when(found, F.col("run_at.last_aligned")).alias("run_end"))
    triggers = triggers.withColumn("from", F.coalesce(F.col("run_end") + 1, F.greatest(F.lit(0), F.col("trigger") - FALLBACK)))
    starts = y.select(F.col("symbol").alias("_s"), F.col("i").alias("_i"), F.col("opens_at").alias("start"))
    ends = y.where("done").select(F.col("symbol").alias("_z"), F.col("i").alias("_e"), F.when(F.col("back3"), "RECOVERED_LONG").otherwise("NEW_DOWN_CONFIGURATION").alias("kind"), F.when(F.col("back3"), F.col("back_first")).otherwise(F.col("other_first")).alias("first"))
    joined = triggers.join(starts, (F.col("symbol") == F.col("_s")) & (F.col("from") == F.col("_i"))).join(ends, (F.col("symbol") == F.col("_z")) & (F.col("done_at") == F.col("_e")), "left")
    return joined.select("symbol", "trigger", "start", "run_end", F.coalesce("first", "last").alias("candidate"), F.coalesce("done_at", "last").alias("end"), F.coalesce("kind", F.lit("OPEN_AT_TRAIN_END")).alias("resolution"))


def sections(x: DataFrame, found: DataFrame) -> DataFrame:
    """(symbol, section, start, trigger, last_trigger, end, resolution, triggers) of windows() that merge."""
    order = Window.partitionBy("symbol").orderBy("trigger")
    w = found.withColumn("reached", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # The last confirmed recovery and the number of aligned bars up to each bar tell about a gap by two look-ups.
    three = (F.sum(F.col("aligned").cast("int")).over(S.last(4)) >= 3) & (F.col("i") >= 3)
    y = x.withColumns({"at": F.max(F.when(three, F.col("i"))).over(S.order().rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum(F.col("aligned").cast("long")).over(S.order())})
    by = lambda name: y.select(F.col("symbol").alias(f"{name}_s"), F.col("i").alias(f"{name}_i"), F.col("at").alias(f"{name}_at"), F.col("n").alias(f"{name}_n"))
    w = w.join(by("a"), (F.col("symbol") == F.col("a_s")) & (F.col("start") - 1 == F.col("a_i")), "left").join(by("b"), (F.col("symbol") == F.col("b_s")) & (F.col("reached") == F.col("b_i")), "left")
    recovered = F.coalesce(F.col("a_at") >= F.greatest(F.col("reached") + 4, F.lit(3)), F.lit(False))
    short = (F.col("start") - F.col("reached") - 1 < SHORT_GAP) & (F.col("a_n") - F.col("b_n") < FEW)
    apart = F.col("reached").isNull() | ((F.col("start") > F.col("reached")) & recovered & ~short)
    w = w.withColumn("section", F.sum(apart.cast("long")).over(order))
    last = F.max_by("resolution", F.struct("end", "trigger"))
    return w.groupBy("symbol", "section").agg(F.min("start").alias("start"), F.min("trigger").alias("trigger"), F.max("trigger").alias("last_trigger"), F.max("end").alias("end"), last.alias("resolution"), F.count("*").alias("triggers"))


def three_of_four(rows: Rows, i: int, column: str, start: int) -> int | None:
    """The first of three or more bars with the column among the four up to i, all from start on."""
    if i - 3 < start:
        return None
    good = [k for k in range(i - 3, i + 1) if rows[k][column]]
    return good[0] if len(good) >= 3 else None


def below(row: dict) -> bool:
    return row["close"] < row["ema27"]


def renewed(rows: Rows, j: int) -> tuple[str, int] | None:
    """Why the dispute is renewed at bar j, and from which bar."""
    row = rows[j]
    if row["core"]:
        return "CORE_TRIGGER", j
    if j >= 1 and row["discord"] >= 2 and rows[j - 1]["discord"] >= 2:
        return "TWO_DISCORDANT_BARS", j - 1
    under = [k for k in range(j - 2, j + 1) if below(rows[k])] if j >= 2 else []
    if len(under) >= 2 and (row["change"] or 0) < 0 and (row["gap1"] or 0) < 0:
        return "THREE_BAR_PRICE_FAST_GAP_DISPUTE", under[0]
    return ("EMA27_CROSS_BELOW_EMA200", j) if row["cross"] else None


def sinking(rows: Rows, j: int) -> tuple[str, int] | None:
    """Three of four closes below the falling average."""
    sinks = j >= 3 and sum(below(r) for r in rows.span(j - 3, j)) >= 3 and (rows[j]["change"] or 0) < 0
    return ("THREE_OF_FOUR_BELOW_EMA27", j - 3) if sinks else None


Check = Callable[[int], tuple[str, int] | None]


def watched(rows: Rows, detected: int, bars: int, check: Check) -> Generator[None, None, tuple[list[dict], tuple[str, int] | None]]:
    """(the bars of a probation, its first failure); fewer bars if the rows end."""
    failure = None
    for j in range(detected + 1, detected + bars + 1):
        if not (yield from rows.has(j)):
            return rows.span(detected + 1, j - 1), failure
        failure = failure or check(j)
    return rows.span(detected + 1, detected + bars), failure


def strength(rows: Rows, i: int, ceiling: float) -> dict:
    """Six facts of a recovery at bar i: three of price (separation, clearance of the dispute's ceiling, persistence) and three of the averages."""
    row, unit = rows[i], rows[i]["atr"] or None
    recent = lambda n: rows.span(max(0, i - n + 1), i)
    grown = lambda c: i >= 3 and row[c] - rows[i - 3][c] > 0
    clearance = (row["close"] - ceiling) / unit if unit else None
    separate = unit is not None and (row["close"] - row["ema27"]) / unit >= EXTENSION
    clear = row["close"] > ceiling or (clearance or 0.0) >= CLEAR
    faster = grown("ema27") and sum((r["change"] or 0) > 0 for r in recent(4)) >= 3
    wider = grown("gap") and sum((r["gap1"] or 0) > 0 for r in recent(4)) >= 3
    aligned = sum(r["aligned"] for r in recent(4)) >= 3
    above = sum(r["close"] > r["ema27"] for r in recent(6)) >= PERSISTENT
    score = separate + clear + faster + wider + aligned + above
    kind = "STRONG" if score >= STRONG and (separate or clear) else "MODERATE" if score >= MODERATE else "WEAK"
    return {"type": f"{kind}_RECOVERY", "score": score, "ceiling": ceiling, "clearance": clearance}


def judge(kind: str, seen: list[dict], level: float | None, failure: tuple[str, int] | None, last: int) -> tuple[str, str | None, int | None]:
    """(status, reason, bar of failure) of a probation over the bars seen, the last of which has the number last."""
    bars, above, rising, widening, final4, over = PROBATIONS[kind]
    if failure:
        return f"FAILED_{kind}", *failure
    if len(seen) < bars:
        return "CENSORED_BY_TRAIN_END", None, None
    counts = tallies(seen)
    good = counts["above"] >= above and counts["rising"] >= rising and counts["widening"] >= widening and counts["final4"] >= final4
    good = good and all(r["ema27"] > r["ema200"] for r in seen) and (not over or sum(r["close"] > level for r in seen) >= over)
    if good:
        return CONFIRMED.get(kind, f"CONFIRMED_{kind}"), None, None
    family = {"STRONG_RECOVERY": "ADAPTIVE_RECOVERY", "MODERATE_RECOVERY": "ADAPTIVE_RECOVERY", "RECOVERY": "RECOVERY_PROBATION"}.get(kind, kind)
    return f"FAILED_{kind}", f"{family}_THRESHOLDS_NOT_MET", last


def tallies(seen: list[dict]) -> dict:
    return {"above": sum(r["close"] > r["ema27"] for r in seen), "rising": sum((r["change"] or 0) >= 0 for r in seen), "widening": sum((r["gap1"] or 0) >= 0 for r in seen), "final4": sum(r["aligned"] for r in seen[-4:])}


class Section:
    """What is counted of the section that is open."""

    def __init__(self, rows: Rows, number: int, start: int, version: str) -> None:
        self.rows, self.number, self.start, self.version = rows, number, start, version
        self.episode, self.from_, self.seq = 1, start, 0
        self.cores = self.attempts = self.failed = self.configurations = self.episode_cores = self.episode_attempts = 0
        wide = Z.last_run(rows, rows[start]["trigger"])
        self.before = Z.upper_seed(rows, start, wide)[1]  # the high of what came before the dispute

    def out(self, kind: str, **values: object) -> dict:
        return {"kind": kind, "section": self.number, **values}

    def event(self, name: str, i: int) -> dict:
        self.seq += 1
        return self.out("EVENT", episode=self.episode, seq=self.seq, event=name, t=self.rows[i]["t"])

    def see(self, i: int) -> None:
        """Leaves the extremes since the section's start with a bar."""
        row, old = self.rows[i], self.rows[i - 1] if i > self.start else None
        row["top"] = max(row["high"], old["top"]) if old else row["high"]
        row["bottom"] = min(row["low"], old["bottom"]) if old else row["low"]

    def close_episode(self, end: int, reason: str) -> dict:
        seen = self.rows.span(self.from_, end)
        depths = [(r["ema27"] - r["close"]) / r["gap"] for r in seen if r["gap"] > 0]
        return self.out("EPISODE", episode=self.episode, start=seen[0]["t"], end=seen[-1]["t"], reason=reason, cores=self.episode_cores, attempts=self.episode_attempts, below=sum(below(r) for r in seen), crossed=any(r["cross"] for r in seen), depth=max(depths, default=None))

    def next_episode(self, start: int) -> dict:
        self.episode, self.from_, self.episode_cores, self.episode_attempts = self.episode + 1, start, 0, 0
        return self.event("EPISODE_START", start)

    def kind_of(self, i: int) -> dict:
        """What an attempt at bar i claims, by version."""
        if self.version == "R3":
            return {"type": "RECOVERY"}
        ceiling = self.rows[i - 1]["top"]
        if self.version == "R4":
            return strength(self.rows, i, ceiling)
        row, level = self.rows[i], max(self.before, ceiling)
        clearance = (row["close"] - level) / row["atr"] if row["atr"] else None
        held = sum(r["close"] > r["ema27"] for r in self.rows.span(max(0, i - 3), i)) >= 3
        resets = row["close"] > level and (clearance or 0.0) >= RESET_CLEAR and held and (row["change"] or 0) > 0 and row["ema27"] > row["ema200"]
        return {"type": "STRUCTURAL_RESET" if resets else "INTERNAL_RECOVERY", "ceiling": ceiling, "level": level, "clearance": clearance}

    def result(self, effective: int, confirmed: int, resolution: str) -> dict:
        row = self.rows[effective]
        return self.out("SECTION", start=self.start_t, effective=row["t"], confirmed=self.rows[confirmed]["t"], resolution=resolution, episodes=self.episode, cores=self.cores, attempts=self.attempts, failed=self.failed, configurations=self.configurations, high=row["top"], low=row["bottom"])


def one_section(rows: Rows, s: Section) -> Generator[dict | None, None, int]:
    """The section's bars; the number of the last one that it uses up."""
    s.start_t = rows[s.start]["t"]
    yield s.event("DISPUTE_START", s.start)
    yield s.event("EPISODE_START", s.start)
    i = s.start
    ahead = s.start  # extremes are left up to here
    while (yield from rows.has(i)):
        while ahead <= i:
            s.see(ahead)
            ahead += 1
        row = rows[i]
        if row["core"]:
            s.cores, s.episode_cores = s.cores + 1, s.episode_cores + 1
            yield s.event("CORE_TRIGGER", i)
        if row["cross"]:
            yield s.event("EMA_CROSS", i)
        effective = three_of_four(rows, i, "aligned", s.from_)
        other = three_of_four(rows, i, "other", s.from_) if effective is None else None
        if effective is None and other is None:
            i += 1
            rows.forget(min(i - Z.KEEP, s.from_))
            continue
        if effective is not None:
            s.attempts, s.episode_attempts = s.attempts + 1, s.episode_attempts + 1
            claim = s.kind_of(i)
            kind = claim["type"]
            told = {"episode": s.episode, "attempt": s.attempts, "effective": rows[effective]["t"], "detected": row["t"], **claim}
            yield s.event(kind if s.version != "R3" else "RECOVERY_ATTEMPT", effective)
            if kind == "WEAK_RECOVERY":
                yield s.out("ATTEMPT", **told, upgrade=claim["score"], required=0, seen=0, status="INTERNAL_WEAK_RECOVERY")
                i += 1
                continue
            best = [claim.get("score")]

            def check(j: int) -> tuple[str, int] | None:
                if s.version == "R4" and three_of_four(rows, j, "aligned", effective) is not None:  # noqa: B023
                    best[0] = max(best[0], strength(rows, j, max([rows[ahead - 1]["top"], *[r["high"] for r in rows.span(ahead, j - 1)]]))["score"])  # noqa: B023
                return renewed(rows, j) or (None if s.version == "R5" else sinking(rows, j))

            seen, failure = yield from watched(rows, i, PROBATIONS[kind][0], check)
            last = i + len(seen)
            status, reason, failed_at = judge(kind, seen, claim.get("level"), failure, last)
            yield s.out("ATTEMPT", **told, upgrade=best[0], required=PROBATIONS[kind][0], seen=len(seen), status=status, failed_at=None if failed_at is None else rows[failed_at]["t"], reason=reason, **tallies(seen))
            episode_end = {"R3": "RECOVERY_ATTEMPT", "R4": "FAILED_RECOVERY"}.get(s.version, f"FAILED_{kind}")
            fits = status.startswith("CONFIRMED")
            if fits and kind == "STRUCTURAL_RESET":
                effective = next((k for k in range(effective, last + 1) if rows[k]["close"] > claim["level"]), i)
            if fits and s.version != "R3":
                episode_end = {"R4": "CONFIRMED_RECOVERY"}.get(s.version, "CONFIRMED_STRUCTURAL_RESET" if kind == "STRUCTURAL_RESET" else "CONFIRMED_INTERNAL_RECOVERY")
        else:
            s.configurations += 1
            effective, episode_end = other, "NEW_CONFIGURATION_ATTEMPT"
            yield s.event("NEW_CONFIGURATION_ATTEMPT", effective)

            def check(j: int) -> tuple[str, int] | None:
                if rows[j]["ema27"] > rows[j]["ema200"]:
                    return "EMA27_RETURNED_ABOVE_EMA200", j
                if three_of_four(rows, j, "aligned", effective) is not None:  # noqa: B023
                    return "RECOVERY_ATTEMPT_FORMED", j
                return ("PRICE_RETURNED_ABOVE_EMA27", j - 3) if j >= 3 and sum(r["close"] > r["ema27"] for r in rows.span(j - 3, j)) >= 3 else None

            seen, failure = yield from watched(rows, i, OTHER_BARS, check)
            last = i + len(seen)
            counts = {"below": sum(r["ema27"] < r["ema200"] for r in seen), "closes_below": sum(below(r) for r in seen), "falling": sum((r["change"] or 0) <= 0 for r in seen)}
            good = counts["below"] >= OTHER_BELOW and counts["closes_below"] >= OTHER_CLOSES and counts["falling"] >= OTHER_FALLING
            failure = failure or (("NEW_CONFIGURATION_THRESHOLDS_NOT_MET", last) if len(seen) == OTHER_BARS and not good else None)
            status = "NEW_CONFIGURATION_FAILED" if failure else "CONFIRMED_NEW_DOWN_CONFIGURATION" if len(seen) == OTHER_BARS else "CENSORED_BY_TRAIN_END"
            reason, failed_at = failure or (None, None)
            yield s.out("CONFIGURATION", episode=s.episode, attempt=s.configurations, effective=rows[effective]["t"], detected=row["t"], seen=len(seen), status=status, failed_at=None if failed_at is None else rows[failed_at]["t"], reason=reason, **counts)
        for k in range(ahead, last + 1):
            s.see(k)
        ahead = max(ahead, last + 1)
        if status.startswith("CONFIRMED"):
            yield s.close_episode(i, episode_end)
            yield s.event("EFFECTIVE_EXIT", effective)
            yield s.event("EXIT_CONFIRMATION", last)
            yield s.result(effective, last, status)
            return last
        if status == "CENSORED_BY_TRAIN_END":
            i = len(rows)
            break
        s.failed += other is None
        yield s.close_episode(i if s.version == "R3" or other is not None else max(failed_at, s.from_), episode_end)
        yield s.event(status, failed_at)
        yield s.next_episode(failed_at)
        i = failed_at  # rewinds
    last = len(rows) - 1
    while ahead <= last:
        s.see(ahead)
        ahead += 1
    yield s.close_episode(last, "TRAIN_END")
    yield s.event("OPEN_AT_TRAIN_END", last)
    yield s.result(last, last, "OPEN_AT_TRAIN_END")
    return last


def chains(version: str):  # noqa: ANN201
    """The program of a version: R3 wants any recovery to last, R4 grades it by strength, R5 asks for a reset of structure or for long persistence."""

    def program(rows: Rows) -> Step:
        i = number = 0
        while True:
            while (yield from rows.has(i)) and rows[i]["trigger"] is None:
                i += 1
                rows.forget(i - Z.KEEP)
            if i >= len(rows):
                return
            if not (yield from rows.has(rows[i]["trigger"])):
                return
            number += 1
            i = (yield from one_section(rows, Section(rows, number, i, version))) + 1

    return program


def run(bars: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """The tagged union of the outputs of every symbol and version."""
    x = features(bars)
    starts = sections(x, windows(x)).select(F.col("symbol").alias("_s"), F.col("start").alias("_i"), "trigger")
    rows = x.join(starts, (F.col("symbol") == F.col("_s")) & (F.col("i") == F.col("_i")), "left").drop("_s", "_i")
    keyed = rows.withColumn("version", F.explode(F.array(*[F.lit(v) for v in versions]))).withColumn("key", F.concat_ws("|", "symbol", "version")).drop("symbol", "version")
    schema = ", ".join(["kind string", *[f"{c} {t}" for c, t in COLUMNS.items()]])
    made = M.run_by_key(keyed, "key", ["t"], lambda key: Program(chains(key.rsplit("|", 1)[1]), ["kind", *COLUMNS], Z.with_streak), schema)
    return made.withColumns({"symbol": F.expr("substring(key, 1, length(key) - length(substring_index(key, '|', -1)) - 1)"), "version": F.substring_index("key", "|", -1)})


def table(outputs: DataFrame, kind: str) -> DataFrame:
    return outputs.where(F.col("kind") == kind).select("symbol", "version", *columns_of(kind))
