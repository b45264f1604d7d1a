"""Language identification: held-out accuracy, exact forward-backward, code-switched text, odd input."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from parley.llm import language_id as l
from parley.llm.common import crc_bucket

from .conftest import pairs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_bucket("doc_id", 3) == 1
    model = l.train(docs, ~held)
    found = l.predict_languages(docs, model, passed=("lang",)).where(crc_bucket("doc_id", 3) == 1)
    right, all_of = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / all_of > 0.95
    assert found.where("score < 0 or score > 1").count() == 0


def test_posteriors_are_exact():
    rng = np.random.default_rng(3)
    emit, move = rng.random((7, 3)) + 0.1, rng.random((3, 3)) + 0.1
    sums = np.zeros((7, 3))
    for path in itertools.product(range(3), repeat=7):
        # Every state is equally likely before the first word.
        weight = move[:, path[0]].sum() * emit[0, path[0]]
        for k in range(1, 7):
            weight *= move[path[k - 1], path[k]] * emit[k, path[k]]
        sums[range(7), path] += weight
    want = sums / sums.sum(axis=1, keepdims=True)
    assert np.allclose(l.chunk_posteriors(emit, move, np.array([0, 7])), want)


def test_chunks_make_no_difference(monkeypatch):
    rng = np.random.default_rng(4)
    emit, move, starts = rng.random((400, 3)) + 0.1, rng.random((3, 3)) + 0.1, np.array([0, 0, 10, 300, 400])
    whole = l.chunk_posteriors(emit, move, starts)
    monkeypatch.setattr(l, "CHUNK", 16)
    assert np.allclose(whole, l.chunk_posteriors(emit, move, starts))


def test_switched_text(spark):
    """Words of two unseen documents, one after the other, get each its language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_bucket("doc_id", 3) == 1
    model = l.train(docs, ~held)
    texts = {r["lang"]: r["t"].split() for r in docs.where(held & F.col("lang").isNotNull()).groupBy("lang").agg(F.max_by("text", F.length("text")).alias("t")).collect()}
    pairs_of = list(itertools.permutations(sorted(texts), 2))
    mixed = [" ".join(texts[a][5:20] + texts[b][5:20]) for a, b in pairs_of]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(mixed)] + [(90, "123"), (91, None), (92, "\u0301\u0300 \u0308")], "doc_id long, text string")
    right = total = 0
    for r in l.label_words(df, model).collect():
        a, b = pairs_of[r["doc_id"]]
        for k in range(r["first_word"], r["end_word"]):
            right += r["lang"] == (a if k < 15 else b)
            total += 1
    assert total == 30 * len(mixed) and right / total > 0.95


def test_odd_input(spark, odd, empty):
    model = l.train(odd, F.lit(True))
    got = l.predict_languages(odd, model).collect()
    assert len(got) == odd.count()
    by_text = {t: i for i, t in pairs(odd)}
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {by_text[""], by_text[" "], by_text["\n\n\t"]} <= und
    nothing = l.train(empty, F.lit(True))
    assert {r["lang_pred"] for r in l.predict_languages(odd, nothing).collect()} == {"und"}
    assert l.predict_languages(empty, model).count() == 0 == l.label_words(empty, model).count()
