"""Repair of the structure of conversations: cheapest edits by a bidirectional tight-arc DAG.

Turns go by turn number (null first), then role and text. A turn is blank (no character but white space),
else a duplicate (its role and text occur earlier in the conversation), else truncated (its last such character
is not `.`, `!` or `?`), else sound. The repaired roles' initials must read `(s?(ua)+)?`. Edits: Keep costs 0,
Rerole to user or assistant 2, Delete 3 (the only one for blank turns and duplicates), Insert an empty turn
of user or assistant 2; a truncated turn that stays adds 1.

Nodes are (turns used, state of the roles), arcs are edits. Forward and backward minimum costs tell
the tight arcs: those on a cheapest path, where cost before + edit + cost behind is the least. From the
start a frontier of nodes follows the least letter of its tight arcs at each step, which gives the
ASCII-least of all cheapest edit strings.

Long conversations are cut into segments of at most SEGMENT turns. A segment is summed up by its least
costs from each state to each state, which compose in the (min, +) semiring; with the costs at its ends every segment
is solved by itself, once for each state in which a cheapest path can enter it (four at most), and a last step
picks the solutions that fit together. So no task holds a conversation's turns: the steps over a conversation
read one row for each segment.

Null roles and texts count as one space. Turns with a null conv_id form one conversation. Repeated rows are
duplicates. Very long texts are read whole, by Spark's expressions; no Python step of the repair sees a text.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidemark.llm.common import cut, table
from tidemark.llm.turns import CRC_TABLE, crc_sql, ordered, plain, range_of

#: Turns of a segment at most.
SEGMENT = 4096
BLANK = r"^[\x20\x09-\x0D]*\z"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: State 0: no turn yet, 1: after system, 2: after user, 3: after assistant; states 0 and 3 may end.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS, FAR = range(4), (0, 3), 1 << 40
ROLES = {"u": "user", "a": "assistant"}

Costs = list[int]
Arc = tuple[str, int, int, int, str]  # letter, from, to, cost, initial of the new role
INSERTS: list[Arc] = [("I", p, q, INSERT, c) for (p, c), q in STEPS.items() if c in ROLES]


@lru_cache(1 << 16)
def arcs(initial: str, fault: str) -> list[Arc]:
    """The edits that use up a turn."""
    found: list[Arc] = [("D", p, p, DELETE, "") for p in STATES]
    if fault not in ("blank", "duplicate"):
        more = CUT_SHORT if fault == "truncated" else 0
        found += [("K", p, q, KEEP + more, c) for (p, c), q in STEPS.items() if c == initial]
        found += [("R", p, q, REROLE + more, c) for (p, c), q in STEPS.items() if c in ROLES]
    return found


def forward(costs: Costs, moves: list[Arc]) -> Costs:
    """The least costs behind one arc of moves."""
    out = [FAR] * len(STATES)
    for _, p, q, cost, _ in moves:
        out[q] = min(out[q], costs[p] + cost)
    return out


def backward(costs: Costs, moves: list[Arc]) -> Costs:
    """The least costs to the end from before one arc of moves."""
    out = [FAR] * len(STATES)
    for _, p, q, cost, _ in moves:
        out[p] = min(out[p], cost + costs[q])
    return out


def settled(costs: Costs, step: Callable[[Costs, list[Arc]], Costs]) -> Costs:
    """costs with any number of inserts in addition."""
    while (more := [min(x) for x in zip(costs, step(costs, INSERTS), strict=True)]) != costs:
        costs = more
    return costs


def through(turns: list[tuple[str, str]], costs: Costs) -> list[Costs]:
    """The forward costs before each turn and behind the last."""
    out = [settled(costs, forward)]
    for turn in turns:
        out.append(settled(forward(out[-1], arcs(*turn)), forward))
    return out


def behind(turns: list[tuple[str, str]], costs: Costs) -> list[Costs]:
    """The backward costs before each turn and behind the last."""
    out = [settled(costs, backward)]
    for turn in reversed(turns):
        out.append(settled(backward(out[-1], arcs(*turn)), backward))
    return out[::-1]


def matrix(turns: list[tuple[str, str]]) -> list[Costs]:
    """The least costs from each state before the turns to each state behind them."""
    return [through(turns, [0 if p == q else FAR for q in STATES])[-1] for p in STATES]


def tight_path(turns: list[tuple[str, str]], enter: int, before: list[Costs], after: list[Costs], least: int, last: bool) -> tuple[int, list[str], list[str]]:
    """(state behind the turns, letters and initials of new roles for each turn) of the ASCII-least cheapest edits from
    the state enter. Inserts stand with the turn behind them. A segment ends once its turns are used up; what is
    inserted there is the next segment's, or in the last one stands with its last turn."""
    at, frontier = 0, {enter}
    letters, initials = [""] * len(turns), [""] * len(turns)
    while at < len(turns) or last and not any(p in ENDS and before[at][p] == least for p in frontier):
        moves = [(a, at) for a in INSERTS] + ([(a, at + 1) for a in arcs(*turns[at])] if at < len(turns) else [])
        tight = [(letter, to, q, c) for (letter, p, q, cost, c), to in moves if p in frontier and before[at][p] + cost + after[to][q] == least]
        taken = [x for x in tight if x[0] == min(tight)[0]]
        # From a state, a letter leads to one state at most: places, states and initials agree in all of taken.
        place = min(at, len(turns) - 1)
        letters[place] += taken[0][0]
        initials[place] += taken[0][3] or "-"
        at, frontier = taken[0][1], {q for _, _, q, _ in taken}
    return min(frontier), letters, initials


def streamed(rows: DataFrame, key: list[str], order: list[str], fold: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """What fold makes of the rows of each key, dealt by key and read in order; a task holds one key's rows."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(types)], schema=types)

        for b in batches:
            for row in b.to_pylist():
                this = tuple(row[c] for c in key)
                if this != now and held:
                    out += fold(held)
                    held = []
                now = this
                held.append(row)
            if out:
                yield batch()
                out = []
        if held and (out := [*fold(held)]):
            yield batch()

    spark_types = _parse_datatype_string(schema)
    types = to_arrow_schema(spark_types)
    return rows.select(*names).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, spark_types)


def judged(turns: DataFrame) -> DataFrame:
    """(conv_id, seg, at, initial, fault) of ordered turns (at, conv_id, initial, blank, ended, h1, h2)."""
    again = turns.where("not blank").groupBy("conv_id", "h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    a, b = turns.where("not blank").alias("a"), again.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
    repeats = a.join(b, same).where("a.at > b.first").select(F.col("a.at").alias("again"))
    fault = F.when(F.col("blank"), "blank").when(F.col("again").isNotNull(), "duplicate").when(~F.col("ended"), "truncated").otherwise("sound")
    seg = range_of(F.col("at")) * (1 << 20) + F.floor(F.col("at") % (1 << 33) / SEGMENT)
    return cut(turns.join(repeats, F.col("at") == F.col("again"), "left").select("conv_id", seg.alias("seg"), "at", "initial", fault.alias("fault")))


def summed(rows: list[dict]) -> Iterator[tuple]:
    """A segment: least costs between states, counts, its ends' initials."""
    turns = [(r["initial"], r["fault"]) for r in rows]
    faults = [f for _, f in turns]
    wrong = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    yield (rows[0]["conv_id"], rows[0]["seg"], rows[0]["at"], [x for r in matrix(turns) for x in r], *[faults.count(f) for f in ("blank", "duplicate", "truncated")], wrong, turns[0][0], turns[-1][0])


def bounded(segments: list[dict]) -> Iterator[tuple]:
    """The segments of a conversation with the costs at their ends, and the conversation's counts with its first."""
    table_of = [[s["costs"][k : k + 4] for k in range(0, 16, 4)] for s in segments]
    before = [[0, FAR, FAR, FAR]]
    for m in table_of:
        before.append([min(before[-1][p] + m[p][q] for p in STATES) for q in STATES])
    after = [[0 if q in ENDS else FAR for q in STATES]]
    for m in reversed(table_of):
        after.append([min(m[p][q] + after[-1][q] for q in STATES) for p in STATES])
    after.reverse()
    least = settled(after[0], backward)[0]
    joints = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(segments, segments[1:], strict=False))
    counts = [sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal")]
    for k, s in enumerate(segments):
        head = [*counts[:3], counts[3] + joints] if k == 0 else [None] * 4
        yield (s["conv_id"], s["seg"], s["at"], before[k], after[k + 1], least, k == len(segments) - 1, *head)


def solved(rows: list[dict]) -> Iterator[tuple]:
    """The tight paths of a segment, one for each state in which a cheapest path enters it; the segment's ends come as its first row."""
    ends, turns = rows[0], [(r["initial"], r["fault"]) for r in rows[1:]]
    before, after = through(turns, ends["before"]), behind(turns, ends["after"])
    for p in STATES:
        if before[0][p] + after[0][p] == ends["least"]:
            to, letters, initials = tight_path(turns, p, before, after, ends["least"], ends["final"])
            yield (ends["conv_id"], ends["seg"], rows[1]["at"], p, to, letters, initials, ends["least"], ends["blank"], ends["duplicate"], ends["truncated"], ends["illegal"])


def chained(paths: list[dict]) -> Iterator[tuple]:
    """Of the paths of a conversation's segments in order, those that start where the path before ended."""
    state, seg = 0, None
    for r in paths:
        if r["seg"] != seg and r["enter"] == state:
            state, seg = r["leave"], r["seg"]
            yield tuple(r[c] for c in ("conv_id", "seg", "first", "letters", "initials", "least", "blank", "duplicate", "truncated", "illegal"))


COUNTS = "blank long, duplicate long, truncated long, illegal long"


def edits(turns: DataFrame) -> DataFrame:
    """(conv_id, seg, first, letters, initials, cost, blank, duplicate, truncated, illegal) of ordered turns as judged()
    takes them: the edits of each segment; cost and counts are the conversation's, the counts with its first segment."""
    marked = judged(turns)
    sums = streamed(marked, ["conv_id", "seg"], ["at"], summed, f"conv_id long, seg long, at long, costs array<long>, {COUNTS}, first string, last string")
    ends = streamed(sums, ["conv_id"], ["seg"], bounded, f"conv_id long, seg long, at long, before array<long>, after array<long>, least long, final boolean, {COUNTS}")
    stacked = marked.unionByName(ends.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True)
    paths = streamed(stacked, ["conv_id", "seg"], ["at"], solved, f"conv_id long, seg long, first long, enter int, leave int, letters array<string>, initials array<string>, least long, {COUNTS}")
    return cut(streamed(paths, ["conv_id"], ["seg", "enter"], chained, f"conv_id long, seg long, first long, letters array<string>, initials array<string>, cost long, {COUNTS}"))


def sorted_turns(rows: DataFrame) -> DataFrame:
    """rows of plain() in order, with what the repair asks of them."""
    hashes = [F.xxhash64(F.lit(k), F.length("role"), "role", "text").alias(f"h{k}") for k in (1, 2)]
    asked = [F.substring("role", 1, 1).alias("initial"), F.rlike("text", F.lit(BLANK)).alias("blank"), F.rlike("text", F.lit(ENDED)).alias("ended")]
    return ordered(rows, "conv_id", "turn", "role", "text", *asked, *hashes)


def applied(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, at, step, edit, role, text): the edits in order, with the turn that comes of each; null for deletions."""
    by_turn = found.select("first", F.posexplode(F.arrays_zip("letters", "initials")).alias("k", "turn"))
    by_turn = by_turn.select((F.col("first") + F.col("k")).alias("_at"), "turn.letters", "turn.initials")
    each = F.posexplode(F.split(F.col("letters"), "(?!^)(?!$)"))
    rows = turns.select("at", "conv_id", "role", "text").join(by_turn, F.col("at") == F.col("_at")).select("conv_id", "at", "role", "text", "initials", each.alias("step", "edit"))
    new = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.expr("substring(initials, step + 1, 1)")]
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") != "D", new)
    text = F.when(F.col("edit").isin("K", "R"), F.col("text")).when(F.col("edit") == "I", F.lit(""))
    return rows.select("conv_id", "at", "step", "edit", role.alias("role"), text.alias("text"))


def repair(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, at, step, edit, role, text): the cheapest edits of every conversation and the turns they leave, in the order of (at, step)."""
    rows = sorted_turns(plain(turns, " ", **columns))
    return applied(rows, edits(rows.drop("text", "role", "turn")))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256). A digest reads its conversation in order: one task streams it and holds
    the digest's state and the letters alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, letters, lines = None, None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        for b in batches:
            for conv, edit, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")], strict=True):
                if now != (conv,):
                    if now:
                        yield done()
                    now, digest, letters, lines = (conv,), hashlib.sha256(), [], 0
                letters.append(edit)
                if edit != "D":
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    lines += 1
        if now:
            yield done()

    rows = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at", "step")
    return rows.mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows of plain() with faults by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 sets the role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.withColumn("kind", kind).where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = plain(table(spark, sf_dir, "conversations"), " ")
    rows = sorted_turns(damaged(source))
    found = edits(rows.drop("text", "role", "turn"))
    heads = found.where("blank IS NOT NULL").select("conv_id", "cost", "blank", "duplicate", "truncated", "illegal")
    spans = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    out = source.select(F.col("conv_id").alias("_c")).distinct()
    for part in (spans, heads, digests(applied(rows, found))):
        out = out.join(part, F.col("_c").eqNullSafe(part["conv_id"]), "left").drop("conv_id")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def state_sql(cost: str, audit: str, lines: str) -> str:
    return f"{{'cost': CAST({cost} AS BIGINT), 'audit': {audit}, 'lines': {lines}}}"


def insert_sql(of: str, role: str) -> str:
    return state_sql(f"({of}).cost + 2", f"({of}).audit || 'I'", f"({of}).lines || chr(10) || '{role}:'")


def edit_sql(of: str, edit: str, initial: str = "") -> str:
    """The state of by one edit of the row t; null where the edit may not be."""
    if edit == "D":
        return state_sql(f"{of}.cost + 3", f"{of}.audit || 'D'", f"{of}.lines")
    role, cost, fits = ("role", 0, f"initial = '{initial}'") if edit == "K" else (f"'{dict(u='user', a='assistant')[initial]}'", 2, "true")
    return f"CASE WHEN {fits} AND NOT must_go THEN {state_sql(f'{of}.cost + {cost} + short', f"{of}.audit || '{edit}'", f'{of}.lines || chr(10) || {role} || chr(58) || text')} END"


#: The repair as a recursion over turns: the least (cost, audit, lines) of each state, by way of edits and inserts.
OP12_SQL = rf"""
WITH RECURSIVE bits AS (
  {CRC_TABLE}
), source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations, bits
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM source, (VALUES (0), (1)) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, left(role, 1) AS initial,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended
  FROM damaged
), repeats AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier FROM placed
), t AS (
  SELECT *, blank OR again AS must_go, CASE WHEN ended THEN 0 ELSE 1 END AS short FROM repeats
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
         count(*) FILTER (NOT must_go AND NOT ended) AS truncated, count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM t GROUP BY conv_id
), best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, {state_sql("0", "''", "''")} AS p0, {state_sql("9999999", "''", "''")} AS p1,
         {state_sql("2", "'I'", "chr(10) || 'user:'")} AS p2, {state_sql("4", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")} AS p3
  FROM conversations
  UNION ALL
  SELECT conv_id, pos, q0, q1, least(q2, {insert_sql("q0", "user")}, {insert_sql("q1", "user")}, {insert_sql("q3", "user")}) AS r2,
         least(q3, {insert_sql("least(q2, " + insert_sql("q0", "user") + ", " + insert_sql("q1", "user") + ")", "assistant")}) AS r3
  FROM (
    SELECT best.conv_id, t.pos, {edit_sql("p0", "D")} AS q0, least({edit_sql("p1", "D")}, {edit_sql("p0", "K", "s")}) AS q1,
           least({edit_sql("p2", "D")}, {", ".join(edit_sql(f"p{k}", e, "u") for k in (0, 1, 3) for e in "KR")}) AS q2,
           least({edit_sql("p3", "D")}, {edit_sql("p2", "K", "a")}, {edit_sql("p2", "R", "a")}) AS q3
    FROM best JOIN t ON t.conv_id IS NOT DISTINCT FROM best.conv_id AND t.pos = best.pos + 1
  ) AS moved
), ends AS (
  SELECT best.conv_id, gaps, blank, duplicate, truncated, illegal, least(p0, p3) AS found FROM best JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id AND best.pos = n
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(found.cost, 0) AS cost, coalesce(found.audit, '') AS audit, sha256(coalesce(substr(found.lines, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

QUERIES = {"op12_repair": op12_repair}
ORACLES = {"op12_repair": OP12_SQL}
