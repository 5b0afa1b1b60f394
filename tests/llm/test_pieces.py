import random
import zlib

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import pieces as P
from tidemark.llm.common import table

MODEL = sentencepiece.SentencePieceProcessor(model_file=P.model_path())


def test_equals_the_library():
    rng, m = random.Random(4), P.Transducer(P.model_path())
    parts = ["the", "ing", " ", "  ", "     ", "\n", "\t", "▁", "é", "日本", "Ⅷ", "Ａ", "​", "\x00", "<s>", "<0x41>", "aaaa", "!!", "ﬁ", "1234", "　", "Zü", "xyz", "😀", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(30)) for _ in range(200)] + ["a" * 5000, " " * 3000, "ab" * 40_000, " x" * 50_000, ""]
    for t in texts:
        ids = m.encode(t).tolist()
        assert ids == MODEL.encode(t), t[:200]
        assert m.decode(ids) == t.replace("▁", " ")


def test_weights_equal_merging():
    """Two pieces can stand side by side exactly if merging their joint text by score gives them."""
    rng, m = random.Random(5), P.Transducer(P.model_path())
    every = list(m.id)
    short, spaces = [p for p in every if len(p) < 4], [p for p in every if not p.strip(" ")]
    pairs = [(rng.choice(k), rng.choice(k)) for k in (every, short) for _ in range(6000)] + [(a, b) for a in spaces for b in spaces]
    got = m.stands(np.array([m.id[a] for a, _ in pairs]), np.array([m.id[b] for _, b in pairs]))
    assert got.tolist() == [[t for t, *_ in m.merged(a + b)] == [a, b] for a, b in pairs]
    for text in ("unbelievable", "  a  b", "aaaaaaa", "zzzq"):
        ids, _ = m.paths(np.array(list(map(ord, text)), np.uint32), np.array([0]), np.array([len(text)]))
        assert [m.text[i] for i in m.shortest(text)] == [m.text[i] for i in ids]


def test_query_equals_the_library(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in table(spark, d, "documents").select("doc_id", "text").collect()}
    for r in P.op3_pieces(spark, d).collect():
        ids = np.array(MODEL.encode(docs[r.doc_id]), "<i4")
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "a b", 3)], "doc_id long, text string, row int").withColumnRenamed("row", "decoded")
    rows = P.decoded(P.tokenized(docs), out="back").collect()
    assert sorted((len(r.ids), r.back, r.decoded) for r in rows) == [(0, "", 1), (0, "", 2), (0, "", 2), (2, "a b", 3)]
    assert P.tokenized(docs.where("false")).count() == 0
    assert P.decoded(docs.select(F.lit(None).cast("array<int>").alias("ids"))).first().decoded == ""
    assert P.tokenized(docs.withColumnRenamed("decoded", "row"), ("ids_crc32",)).columns == ["doc_id", "text", "row", "ids_crc32"]
    rows = P.tokenized(docs, ("ids", "decoded")).collect()
    assert sorted(r.decoded for r in rows) == ["", "", "", "a b"] and rows[0].__fields__ == ["doc_id", "text", "ids", "decoded"]
