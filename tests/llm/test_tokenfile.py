import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokenfile as K
from tidemark.llm.common import table

MODEL = Tokenizer.from_file(K.model_path())


def brute(rows):
    at, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*MODEL.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(K, "KEEP", 40)
    rng, e = random.Random(6), K.Encoder(K.model_path())
    parts = ["the", " the", "'s", "'ll ", "\n", "  ", " \t", "12", "_", "__ a", "é", "ß", "²", "½", "\x1c", "\x85", "\xa0", "日本", "Ⅷ", "😀", "<|endoftext|>", "!?", "’s", "…"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert e.encode([t])[0].tolist() == [*MODEL.encode(t, add_special_tokens=False).ids, 0], repr(t)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    assert [x.tolist() for x in e.encode(texts)] == [[*MODEL.encode(t, add_special_tokens=False).ids, 0] for t in texts]


@pytest.mark.parametrize("terminals", [4, 70_000])
def test_round_trip_and_random_access(terminals, monkeypatch):
    monkeypatch.setattr(K, "FREQUENT", 2)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 4, rng.integers(1, 400)).astype(np.uint32) for _ in range(40)] + [np.zeros(999, np.uint32), np.zeros(1, np.uint32)]
    shard = K.Shard(K.pack([*range(41), None], texts, terminals))
    want = np.concatenate(texts)
    assert (shard.ids() == want).all() and len(shard.symbols) < 0.6 * len(want)
    assert (K.lengths_of(shard.rules, terminals) == [len(K.expand(np.array([terminals + k]), shard.rules, terminals)) for k in range(len(shard.rules))]).all()
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(want) + 1, 2))
        assert (shard.ids_at(a, b) == want[a:b]).all()
    at = 0
    for text, own in zip(texts, shard.own):
        assert (K.expand(shard.symbols[at : at + own], shard.rules, terminals) == text).all()
        at += own
    with pytest.raises(ValueError):
        K.Shard(K.pack([1], texts[:1], terminals)[:-1] + b"\0")


def test_query(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_TOKENS", 30_000)
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, K.op9_tokenfile(spark, d).collect())) == sorted(brute(rows))


def test_edges(spark, tmp_path):
    rows = [(2, ""), (None, None), (1, "a " * 30_000), (2, ""), (7, "b")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, part int")
    K.write(frame, f"{tmp_path}/a", shard_tokens=100)
    assert sorted(map(str, map(tuple, K.read(spark, f"{tmp_path}/a").collect()))) == sorted(map(str, brute(rows)))
    K.write(frame.where("false"), f"{tmp_path}/b")
    assert K.read(spark, f"{tmp_path}/b").count() == 0


def test_smallest_id_is_no_null():
    payload = K.pack([None, -(1 << 63), 5], [np.array([1, 0], np.uint32), np.array([0], np.uint32), np.array([2, 3, 0], np.uint32)], 100)
    shard = K.Shard(payload)
    assert shard.known.tolist() == [False, True, True] and shard.doc_ids.tolist()[1:] == [-(1 << 63), 5] and shard.ids().tolist() == [1, 0, 0, 2, 3, 0]
