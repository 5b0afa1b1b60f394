import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm.common import table


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_base_columns(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b", "a a a a", "a a a a a a", "x y z x y z x", "l1\nl1\n\nl1 \nl2\x0bl2", "é<>|&%$*# b"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)] + ["p q r s " * 20_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.base_columns(docs).drop("text").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_order_is_by_rejections_per_cost_and_never_changes_verdicts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rules = Q.bound(Q.BASE + Q.MORE, Q.text_features(F.col("text")))
    assert sorted(Q.in_order(Q.sample_of(docs), rules)) == sorted(n for n, _ in rules)
    kept = [sorted(r.doc_id for r in Q.cascade(docs, rs, "ok").where("ok").select("doc_id").collect()) for rs in (rules, rules[::-1])]
    assert kept[0] == kept[1]
    want = sorted(r.doc_id for r in Q.op5_quality(spark, "/root/testdata/sf0.001").where("kept").collect())
    assert kept[0] == want == sorted(r.doc_id for r in Q.keep_good(docs).select("doc_id").collect())


def test_good_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    op5 = Q.op5_quality(spark, d).join(table(spark, d, "labels"), "doc_id")
    n = op5.groupBy("quality").agg(F.avg(F.col("kept").cast("double")), F.avg((F.col("n_words") >= 50).cast("double"))).collect()
    by = {r[0]: r for r in n}
    assert by[1][1] > by[1][2] - 0.01 and by[0][1] < 0.05


def test_edges(spark):
    rows = [(1, None), (None, ""), (2, "good " * 3), (2, "good " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_kept", F.lit(1))
    out = Q.cascade(docs, [("none", F.lit(None).cast("boolean"))])
    assert out.where("kept").count() == 4
    assert Q.cascade(docs, []).where("kept").count() == 4
    assert Q.keep_good(docs).columns == docs.columns and Q.keep_good(docs).count() == 0
    assert Q.keep_good(docs.where("false")).count() == 0
    clash = docs.selectExpr("*", "'x' AS n_words", "'y' AS lines", "'z' AS _both", "'k' AS kept")
    made = Q.base_columns(clash)
    assert sorted(made.columns) == sorted({*clash.columns, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"})
    assert {(r.doc_id, r.n_words, r._both) for r in made.collect()} == {(1, 0, "z"), (None, 0, "z"), (2, 3, "z")}
    assert Q.cascade(clash, []).columns == clash.columns


def test_cascade_over_a_map_column(spark):
    from tidemark.llm import quality

    frame = spark.sql("SELECT id AS doc_id, repeat('a word here. ', 40) AS text, map('k', id) AS more FROM range(40)")
    assert quality.keep_good(frame).columns == frame.columns
    assert quality.keep_good(frame).count() in range(41)
