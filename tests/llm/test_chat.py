import random

from tidemark.llm import chat as C


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    seqs = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in convs.items()}
    keep = {}
    for c, s in sorted(seqs.items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        keep.setdefault(s, []).append(c)
    return sorted((min((c for c in cs if c is not None), default=None), len(s), len(cs), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s)) for s, cs in keep.items())


def joined(frame):
    by = {}
    for r in sorted(frame.collect(), key=lambda r: (str(r.conv_id), r.part)):
        by.setdefault((r.conv_id, r.n_turns, r.n_equal), []).append(r.text)
    return sorted((*k, "".join(v)) for k, v in by.items())


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    rng, rows = random.Random(2), []
    for c in range(120):
        script = random.Random(rng.randrange(6))
        rows += [(c, t, script.choice(["user", "assistant"]), script.choice("abc")) for t in range(rng.randrange(1, 12))]
    rows += [(500, 0, None, None), (501, 0, "", ""), (502, 1, "user", "gap"), (502, 9, "user", "gap2")]
    frame = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, pos string")
    assert joined(C.render(frame)) == brute(rows)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.render(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "x" * 300_000), (1, 0, "user", "x" * 300_000), (2, None, "user", "a"), (None, 0, "user", "z")]
    got = C.render(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.conv_id), r.n_turns, len(r.text)) for r in got) == [("1", 2, 2 * (300_000 + 28)), ("2", 1, 29), ("None", 1, 29)]


def test_equal_turns_go_by_text(spark):
    rows = [(1, 0, "user", x) for x in "badc"] + [(None, 0, "user", "y"), (None, 0, "user", "x")]
    got = {r.conv_id: r.text for r in C.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    line = "<|im_start|>user\n{}<|im_end|>\n".format
    assert got == {1: "".join(map(line, "abcd")), None: line("x") + line("y")}
