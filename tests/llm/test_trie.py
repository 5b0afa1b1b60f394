import hashlib
import random
import zlib

from tidemark.llm import trie as T


def sequences(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    plain = {c: [r[2:] for r in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(plain.get(c - c % 5, [])[:h] + own[h:])
    return out


def brute(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for p, convs in nodes.items():
        sub = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes) for q in sub)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        ends = ",".join(str(c) for c in sorted(convs) if seqs[c] == p)
        out.append((min(convs), len(p), min(nodes[p[:-1]]) if p else None, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def rows_of(rng, convs):
    rows = []
    for c in range(convs):
        script = random.Random(rng.randrange(9))
        first = rng.choice(["hot", "hot", "hot", "warm", "é" * 5, None])
        rows += [(c, t if t % 4 else None if rng.random() < 0.1 else t, script.choice(["user", "assistant", None]), first if t == 0 else script.choice(["a", "bb", "", "ü"])) for t in range(rng.randrange(1, 14))]
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = rows_of(random.Random(8), 90) + [(None, 0, "user", "x"), (200, 0, "user", "only"), (203, None, None, None), (203, None, None, None), (207, 1, "user", "y" * 200_000)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, rep string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(T.op11_trie(spark, str(tmp_path))) == brute(sequences(rows))


def test_spines_and_chains(spark):
    """Limits so small that hot first turns, shared turns and lone long conversations all take their own ways."""
    rng = random.Random(9)
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows_of(rng, 70) if t is not None]
    rows += [(300, t, "user", f"{t}" * (t % 5)) for t in range(40)] + [(301, t, "user", f"{t}" * (t % 5)) for t in range(40)]
    rows += [(302, t, "user", "hot" if t < 3 else f"v{t}") for t in range(30)]
    seqs = {}
    for c, t, r, x in sorted(rows):
        seqs.setdefault(c, ())
        seqs[c] += ((r, x),)
    seqs[400] = seqs[401] = ()
    frame, sizes = T.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sizes = sizes.select("conv_id", sizes.own.alias("n")).unionByName(spark.createDataFrame([(400, 0), (401, 0)], "conv_id long, n long"))
    for limit in (6, 12, 60):
        assert got(T.prefix_trie(frame, sizes, limit)) == brute(seqs)


def test_empty_table_and_only_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert T.prefix_trie(*T.rebuilt(*T.turn_rows(empty))).count() == 0
    frame, sizes = T.turn_rows(empty)
    lone = sizes.select("conv_id", sizes.own.alias("n")).unionByName(spark.createDataFrame([(4, 0), (3, 0)], "conv_id long, n long"))
    assert got(T.prefix_trie(frame, lone)) == brute({4: (), 3: ()})
