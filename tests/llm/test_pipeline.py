import numpy as np
import sentencepiece
from test_quality import brute as quality_of
from test_similar import brute_kept

import corpus_pipeline as P
from tidemark.llm import pieces, quality, toxicity
from tidemark.llm.common import table


def test_against_brute_force(spark):
    """Each stage against a plain version of it, on the stage's own input."""
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    columns = docs.columns
    rows = {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, d).cache()
        rows[name] = (before, {r.doc_id: r for r in docs.collect()})
        assert docs.columns[: len(columns)] == columns and docs.count() == len(rows[name][1])
    before, after = rows["quality"]
    base = {k: quality_of(r.text) for k, r in before.items()}
    assert not [k for k in after if base[k][0] < 50 or 100 * base[k][4] > 50 * base[k][0] or 10 * base[k][2] > base[k][0]]
    assert set(after) == {r.doc_id for r in quality.op5_quality(spark, d).where("kept").collect()}
    before, after = rows["toxicity"]
    lexicon = "idiot moron scum trash loser clown stupid pathetic worthless disgusting".split()
    assert all(k in after for k, r in before.items() if r.lang == "en" and not toxicity.features(r.text, toxicity.Matcher([(w, False, True) for w in lexicon]))[0].any())
    before, after = rows["simhash"]
    ids = sorted(before)
    assert set(after) == brute_kept([(k, before[k].text) for k in ids])[0]
    before, after = rows["decontamination"]
    items = [r.text for r in table(spark, d, "benchmark").collect()]
    assert not [k for k, r in after.items() if any(i in r.text for i in items)]
    assert len(after) >= len(before) - 1 - sum(any(i.split()[0] in r.text for i in items) for r in before.values())
    before, after = rows["pieces"]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert set(before) == set(after) and all(r.round_trip and np.array_equal(r.ids, model.encode(r.text)) for r in after.values())


def test_extra_columns_with_clashing_names_stay(spark):
    d = "/root/testdata/sf0.001"
    extra = ["_kept", "_score", "_id", "_y", "kept_id", "kept_th", "_leaks", "n_words", "w", "score", "leaks"]
    docs = table(spark, d, "documents").selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in extra])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in extra), name
    last = P.token_ids(spark, docs.selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS round_trip"), d)
    assert sorted(last.columns) == sorted([*docs.columns, "ids", "n_tokens", "round_trip"]) and all(r.round_trip is True for r in last.collect())


def test_shuffle_files_go_with_their_job_and_the_session_keeps_its_setting(spark, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(spark.conf.get(P.CLEANUP))
        return docs

    monkeypatch.setattr(P, "STAGES", [("one", stage), ("two", stage)])
    before = spark.conf.get(P.CLEANUP, "false")
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
    assert seen == ["true", "true"] and spark.conf.get(P.CLEANUP) == before
