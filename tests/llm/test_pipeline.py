"""The pipeline's stages, each on its own input."""

import corpus_pipeline as c
from parley.llm import queries

from .conftest import counted, pairs
from .test_jaccard import brute


def test_stages(spark, docs, small):
    assert [n for n, _ in c.STAGES] == ["language_id", "jaccard_join", "secret_scans", "best_fit_packing"]
    columns = docs.columns
    kept = c.language_stage(spark, docs, small)
    assert kept.columns == columns and 0.9 * docs.count() < kept.count() <= docs.count()
    alone = c.near_duplicate_stage(spark, docs, small)
    groups = brute(pairs(docs), 80, 5)
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted({root for _, root in groups.values()})
    clean = c.secret_stage(spark, docs, small)
    assert clean.columns == columns and clean.count() == docs.count()
    before = dict(pairs(docs))
    changed = [t for i, t in pairs(clean) if t != before[i]]
    assert all("[secret]" in t for t in changed)
    packed = c.packing_stage(spark, docs, small)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run(spark, small, docs):
    rows = c.run(spark, small)
    assert 0 < rows.select("doc_id").distinct().count() <= docs.count()


def test_odd_input(spark, odd, empty, small):
    columns = list(c.COLUMNS)
    for df in (odd.select(*columns), empty.select(*columns)):
        for name, stage in c.STAGES:
            out = stage(spark, df, small)
            assert name == "best_fit_packing" or out.columns == columns
    rows = odd.select(*columns)
    # Nothing can be learned from the one language but that language: what has a letter stays.
    kept = [r["doc_id"] for r in c.language_stage(spark, rows, small).collect()]
    assert counted(kept) == counted(i for i, t in pairs(rows) if any(ch.isalpha() for ch in t))
    assert c.secret_stage(spark, rows, small).count() == rows.count()
    packed = c.packing_stage(spark, rows, small)
    assert counted(r["doc_id"] for r in packed.where("piece = 0").collect()) == counted(i for i, _ in pairs(rows))


def test_one_of_each_group_stays(spark, small):
    def words(k):
        return " ".join(f"{k}w{n}" for n in range(40))

    rows = [
        (7, words(1)), (7, words(2)),  # one id, two texts: both stay
        (9, words(1) + " more"), (None, words(1)),  # copies of the first
        (None, words(3)), (None, words(3)),  # copies without ids: one stays
        (5, words(4)), (5, words(4)), (6, words(4) + " x"),  # a repeated row stays once
        (1, ""), (1, None), (2, " "), (2, " "),  # no words: all stay
    ]
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = c.near_duplicate_stage(spark, df, small)
    assert left.columns == df.columns
    want = [(7, words(1)), (7, words(2)), (None, words(3)), (5, words(4)), (1, ""), (1, None), (2, " "), (2, " ")]
    assert counted((r["doc_id"], r["text"]) for r in left.collect()) == counted(want)


def test_queries_are_named():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
