import random

import pytest
import xxhash

from tidemark.llm import simhash as S
from tidemark.llm.common import table


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """{(id, fp)}: component by union-find over all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return [low.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", "  \t", "one", "One two", "a b c d a b c d", "É é x Y z \x1c q", "x " * 20_000])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_documents(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op1_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: (f"{brute_fingerprint(r.text):016x}", c) for r, c in zip(rows, want)}


@pytest.mark.parametrize("crowd", [1, 64])
def test_links_and_crowded_keys(spark, crowd):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1}
    for f in list(fps)[:10]:
        for _ in range(12):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    want = brute_components(rows)
    frame = spark.createDataFrame([(S.signed(f), i) for i, f in rows], "fp long, rep long")
    edges = S.links(frame, crowd=crowd)
    got = {r.node: r.component for r in S.components(edges).collect()}
    assert [got.get(i, i) for i, _ in rows] == want


def test_nulls_ties_extra_columns_and_empty(spark):
    rows = [(3, "", 1), (None, None, 2), (1, "a b c", 3), (1, "a b c", 3), (None, "z y x w", 4), (2, "A  B\nC", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted(((r.id, S.hex_of is not None, r.component) for r in S.clusters(docs).collect()), key=str)
    assert [(i, c) for i, _, c in got] == [(1, 1), (1, 1), (2, 1), (3, 3), (None, 3), (None, None)]
    kept = sorted(((r.doc_id, r.text, r.component) for r in S.keep_one(docs).collect()), key=str)
    assert kept == [(1, "a b c", 3), (3, "", 1), (None, "z y x w", 4)]
    assert S.clusters(docs.where("false")).count() == 0
    assert S.keep_one(docs.where("false")).count() == 0


def test_steps_of_small_graphs_run_in_few_tasks_and_stop_at_stars(spark, monkeypatch):
    sizes, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: (sizes.append((out := cut(df)).rdd.getNumPartitions()), out)[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        star = spark.createDataFrame([(0, k) for k in range(1, 60)], "a long, b long")
        chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(7, 7)], "a long, b long")
        for edges, n in ((star, 60), (chain, 61)):
            assert {(r.node, r.component) for r in S.components(edges).collect()} == {(k, 0) for k in range(1, n)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sizes[:2] == [23, 23] and len(sizes) < 9 and max(sizes[2:]) <= 4
