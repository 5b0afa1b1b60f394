import random

from pyspark.sql import functions as F

from tidemark.llm import langid as L
from tidemark.llm.common import table


def brute_phrases(train, text):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in train:
            size += 1
        at += size
        n += 1
    return n


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        train = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
        a = L.SuffixAutomaton(train)
        for _ in range(20):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 15)))
            assert a.phrases(text) == brute_phrases(train, text), (train, text)


def test_whole_texts_equal_brute_force(monkeypatch):
    """Phrases of whole texts, across words, whether read side by side or one by one."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    text = lambda n: rng.choice([" ", ", ", "\n 1 "]).join(word() for _ in range(n))
    training = {k: text(60) for k in ("x", "y", "z")}
    texts = [text(rng.randrange(0, 40)) for _ in range(60)] + ["", "Q q", "1", "ABC" * 50]
    plain = lambda t: " " + "".join(c + " " * (c == " ") if c.isalpha() else " " for c in t.lower()) + " "
    fold = lambda t: " ".join(plain(t).split()).join("  ") if plain(t).strip() else " "
    for few in (1, 16, 1000):
        monkeypatch.setattr(L, "FEW", few)
        monkeypatch.setattr(L, "BATCH_CHARS", 50)
        counts, letters = L.Parser(training).counts(texts)
        assert counts.tolist() == [[brute_phrases(fold(training[k]), fold(t)) for k in sorted(training)] for t in texts]
        assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = L.op10_langid(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    right = sum(r.lang_pred == r.lang for r in rows)
    assert right >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat", "en"), (2, "die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 ² _ !", None), (None, "THE CAT", None), (None, "THE CAT", None), (6, "katze " * 50_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit("x"))
    training = L.training_texts(docs.where("doc_id < 3"))
    got = {(r.doc_id, r.text): (r.o.lang, r.o.score) for r in L.identified(docs, training, out="o").collect()}
    assert [got[k][0] for k in ((1, "the cat"), (2, "die katze"), (None, "THE CAT"), (6, "katze " * 50_000))] == ["en", "de", "en", "de"]
    assert got[(3, None)] == got[(4, "")] == got[(5, "12 ² _ !")] == ("und", 0.0)
    assert L.training_texts(docs.where("false")) == {}
    assert {r.o.lang for r in L.identified(docs, {}, out="o").collect()} == {"und"}
    assert L.identified(docs.where("false"), training).count() == 0
    assert L.identified(docs, training).columns == ["doc_id", "text", "lang", "language"]
