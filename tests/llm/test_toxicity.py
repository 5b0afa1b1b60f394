import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T
from tidemark.llm.common import held_out, table


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    terms = [("abcab", False, True), ("bbbbbbbbb", False, True), ("abc", False, True), ("cab", True, True), ("bacab", False, False), ("abcabcabc", False, True), ("dcba", False, True)]
    m = T.Matcher(terms)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    words += [t[:i] + c + t[i + k :] for t, _, _ in terms for i in range(len(t) + 1) for k in (0, 1) for c in ("", "a", "x", "1")]
    m.hit("abcab")
    T.STATES, bound = 40, T.STATES  # states are dropped on the way
    for w in filter(None, words):
        stems = [(0, k) for k, (t, s, _) in enumerate(terms) if s and w.startswith(t)]
        whole = [(levenshtein(w, t), k) for k, (t, s, f) in enumerate(terms) if not s and levenshtein(w, t) <= (T.edits(t) if f else 0) and (len(t) > 4 or t == w or not w.isalpha())]
        best = min(whole, default=None)
        want = stems[0] if stems and (best is None or best[0]) else best
        assert m.hit(w) == want, w
    T.STATES = bound


def test_quotation_and_abuse():
    m = T.Matcher([("idiot", False, True)])
    assert T.features("you idiot", m)[0][0] > 0 and T.features("you idi0t", m)[0][2] > 0
    for text in ('they wrote "you idiot" there', "the word idiot is old", "er sagte idiot"):
        assert T.features(text, m)[0][:3].sum() == 0 and T.features(text, m)[0][3] > 0


def test_inflected_forms_in_training_leave_misspellings_of_the_word(spark):
    forms = ["idiot", "idiot", "idiots", "scum", "idiotic", "idiot", "idioty", "scum", "idiot", "idiotism", "scum", "idiot"]
    rows = [(i, f"k{i} l{i} {forms[i // 3 % 12] if i % 3 == 0 else 'nice'} m{i} w{i} x{i}") for i in range(720)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_y", F.lit(1)).withColumn("_ID", F.lit(1))
    model = T.learn(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(720)], "doc_id long, toxic int"))
    test = spark.createDataFrame([(w,) for w in ("idiots", "idiotically", "idi0t", "iidot", "1diot", "5cum", "sum", "nice")], "text string")
    got = {r.text: r.score >= T.THRESHOLD for r in T.scored(test.selectExpr("text", "'x' AS score"), model).collect()}
    assert got == {"idiots": True, "idiotically": True, "idi0t": True, "iidot": False, "1diot": True, "5cum": True, "sum": False, "nice": False}, (got, model.terms)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = T.op2_toxicity(spark, d).join(table(spark, d, "labels").where("toxic IS NOT NULL"), "doc_id").where("held_out").collect()
    got, want = np.array([r.predicted for r in rows]), np.array([r.toxic for r in rows])
    assert (got & want).sum() >= 0.93 * want.sum() and (got & (1 - want)).sum() <= 0.01 * (1 - want).sum()


def test_edges(spark):
    rows = [(i, ("so idiot here" if i % 3 == 0 else "so nice here") + f" w{i} x{i} y{i}", "z") for i in range(150)] + [(None, "idiot", "z"), (7, None, "z"), (7, "", "z"), (1000, "You IDIOTT " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    assert ("idiot", False, True) in model.terms
    out = {(r.doc_id, r.text): r.s for r in T.scored(docs, model, out="s").collect()}
    assert all(0 <= s <= 1 for s in out.values()) and out[(None, "idiot")] > 0.9 and out[(1000, "You IDIOTT " * 9000)] > 0.5
    assert out[(7, None)] == out[(7, "")] < T.THRESHOLD
    assert T.keep_harmless(docs, labels).columns == docs.columns
    none = T.learn(docs.where("false"), labels.where("false"))
    assert T.scored(docs, none).where(F.col("score") >= T.THRESHOLD).count() == 0
    assert T.scored(docs.where("false"), model).count() == 0
    assert spark.range(4).where(held_out(F.lit(None))).count() in (0, 4)
