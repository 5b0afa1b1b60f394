import hashlib
import heapq
import random
import re
import zlib

from tidemark.llm import repair as R

SPACE = " \t\n\v\f\r"


def cheapest(turns):
    """(cost, audit, kept turns) by best-first search over all edit strings."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return cost, audit, kept
        if (at, state) in done:
            continue
        done.add((at, state))
        for c in allowed[state]:
            if c != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", at, c, [*kept, (R.ROLES[c], "")]))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, kept))
            if fault in ("sound", "truncated"):
                more = int(fault == "truncated")
                for c in allowed[state]:
                    if c == role[:1]:
                        heapq.heappush(heap, (cost + more, audit + "K", at + 1, c, [*kept, (role, text)]))
                    if c != "s":
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, c, [*kept, (R.ROLES[c], text)]))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not text.strip(SPACE):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "sound" if text.rstrip(SPACE)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out = convs.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [] if kind == 0 else [(t, role, text)] * (2 if kind == 3 else 1)
    res = []
    for c, out in convs.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = faults([r[1:] for r in out])
        cost, audit, kept = cheapest(turns)
        numbers = [r[0] for r in out if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        kinds = [t[2] for t in turns]
        text = "\n".join(f"{r}:{x}" for r, x in kept)
        res.append((str(c), gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(res)


def rows_of(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([t, t, t, t, None, t * 3]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "u"]), rng.choice(["a.", "b", "c!", " \t", "", None, "d. ", "é?\n", "e.x"])))
    return rows


def query(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, at string, seg int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = R.op12_repair(spark, str(tmp_path)).collect()
    return sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got)


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 3)
    rng = random.Random(4)
    rows = rows_of(rng, 120, 14) + [(None, 1, "user", "q?"), (None, None, None, None)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_long_conversation_and_text(spark, tmp_path):
    rng = random.Random(5)
    rows = [(7, None if k % 3 else k, rng.choice(["user", "assistant", "x"]), rng.choice(["a.", "b"]) + str(rng.randrange(400)) + rng.choice([".", ""])) for k in range(9000)]
    rows += [(8, 0, "user", "y" * 300_000), (8, 1, "assistant", "z " * 200_000 + ".\n")]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_every_short_conversation():
    """All of up to four turns over seven kinds, cut anywhere."""
    kinds = [("system", "sound"), ("user", "sound"), ("user", "truncated"), ("assistant", "sound"), ("assistant", "blank"), ("tool", "truncated"), ("tool", "duplicate")]
    rng = random.Random(6)
    for _ in range(400):
        turns = [rng.choice(kinds) for _ in range(rng.randrange(1, 7))]
        flat = [(r[:1], f) for r, f in turns]
        before, after = R.through(flat, [0, R.FAR, R.FAR, R.FAR]), R.behind(flat, [0, R.FAR, R.FAR, 0])
        least = after[0][0]
        _, letters, _ = R.tight_path(flat, 0, before, after, least, True)
        assert (least, "".join(letters)) == cheapest([(r, "t", f) for r, f in turns])[:2]


def test_edits_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b"), (1, 2, "tool", ""), (2, 0, "assistant", "c.")], schema)
    got = [tuple(r) for r in R.repair(frame).orderBy("at", "step").select("conv_id", "edit", "role", "text").collect()]
    # b is a second user turn: renamed (2) and left cut short (1); the blank turn goes (3).
    assert got == [(1, "K", "user", "a."), (1, "R", "assistant", "b"), (1, "D", None, None), (2, "I", "user", ""), (2, "K", "assistant", "c.")]
    assert R.repair(frame.limit(0)).count() == 0
