"""Voices: walks in order beside plain versions, and figures of known cases."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from parley.operators import voices as v


def unit_rows(seed, count, groups=3, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    rows = centres[rng.integers(0, groups, count)] + rng.normal(size=(count, size)) * 0.5
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame(spark, m):
    return spark.createDataFrame([(1, k, [float(x) for x in row]) for k, row in enumerate(m)], "m int, vec_id long, embedding array<double>")


def plain_prune(m, keep):
    sims = m @ m.T
    alive = list(range(len(m)))
    while len(alive) > keep:
        mean = [np.mean([sims[a, b] for b in alive if b != a]) for a in alive]
        for k in np.argsort([-x for x in mean], kind="stable"):
            if alive[k] != len(m) - 1:
                alive.pop(k)
                break
    return alive


@pytest.mark.parametrize("seed", range(3))
def test_prune(spark, seed):
    m = unit_rows(seed, 30)
    got = v.prune(frame(spark, m), ["m"], 12).where("kept").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == plain_prune(m, 12)


def plain_linkage(m, least):
    groups = [[k] for k in range(len(m))]
    while len(groups) > 1:
        best = max(((np.mean([m[x] @ m[y] for x in a for y in b]), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] <= least:
            break
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    label = {}
    for g in groups:
        for k in g:
            label[k] = min(g)
    seen = {}
    return [seen.setdefault(label[k], len(seen)) for k in range(len(m))]


@pytest.mark.parametrize("seed", range(3))
def test_linkage(spark, seed):
    m = unit_rows(seed, 25)
    got = v.average_linkage(frame(spark, m), ["m"], 0.4).orderBy("vec_id").collect()
    assert [r["cluster"] for r in got] == plain_linkage(m, 0.4)


def test_online_speakers(spark):
    m = unit_rows(9, 40)
    sums, want = [], []
    for row in m:
        scores = [s @ row / np.linalg.norm(s) for s in sums]
        best = max(range(len(sums)), key=lambda k: (scores[k], k), default=None)
        if best is None or scores[best] < 0.6:
            best = len(sums)
            sums.append(np.zeros_like(row))
        sums[best] = sums[best] + row
        want.append(f"Speaker {best + 1}")
    got = v.online_speakers(frame(spark, m), ["m"], 0.6).orderBy("vec_id").collect()
    assert [r["speaker"] for r in got] == want


def test_similarities_do_not_depend_on_blocks(spark):
    m = unit_rows(4, 60)
    library = spark.createDataFrame([(k % 4, [float(x) for x in row]) for k, row in enumerate(m[10:])], "person int, embedding array<double>")
    queries = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(m[:10])], "query int, embedding array<double>")
    want = {(q, p): np.mean(np.sort([m[q] @ m[10 + k] for k in range(50) if k % 4 == p])[-3:]) for q in range(10) for p in range(4)}
    for block in (7, 1000):
        got = {(r["query"], r["person"]): r["score"] for r in v.similarities(queries, library, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_matching(spark):
    voices = spark.createDataFrame([(1, f"S{k}", k) for k in range(4)], "meeting int, cluster string, seq int")
    scores = spark.createDataFrame([(1, "S0", "A", 0.9), (1, "S0", "B", 0.5), (1, "S1", "A", 0.95), (1, "S1", "B", 0.1), (1, "S2", "B", 0.3)], "meeting int, cluster string, person string, score double")
    got = {r["cluster"]: (r["person"], r["status"], r["score"], r["unknown_label"]) for r in v.match_voices(voices, scores).collect()}
    assert got == {"S0": ("B", "suggested", 0.5, "Unknown speaker 1"), "S1": ("A", "auto", 0.95, None), "S2": (None, "unknown", 0.3, "Unknown speaker 2"), "S3": (None, "unknown", None, "Unknown speaker 3")}


def test_verification(spark):
    scores = spark.createDataFrame([(True, x) for x in (0.8, 0.85, 0.9, 0.7)] + [(False, x) for x in (0.1, 0.2, 0.3, 0.75)], "genuine boolean, score double")
    r = v.verification(scores).first()
    assert (r["eer"], r["eer_threshold"], r["threshold_far"], r["frr_at_far"], r["n_genuine"], r["n_impostor"]) == (0.25, 0.75, 0.8, 0.25, 4, 4)


def test_split(spark):
    a, b = np.eye(8)[0], np.eye(8)[1]
    rows = [(1, k, k // 4, 1.5, [float(x) for x in (a if k < 8 else b)]) for k in range(16)]
    df = spark.createDataFrame(rows, "m int, seq int, segment int, seconds double, embedding array<double>")
    assert [r["voice"] for r in v.split_voices(df, ["m"]).orderBy("seq").collect()] == [0] * 8 + [1] * 8
    assert {r["voice"] for r in v.split_voices(df.where("seq < 9"), ["m"]).collect()} == {0}


def test_zero_and_broken_vectors(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [float("nan"), 1.0]), (2, 2, [3.0, 4.0])], "m int, vec_id long, embedding array<double>")
    got = {r["m"]: r["mean"] for r in v.mean_vectors(df, ["m"]).collect()}
    assert got == {1: None, 2: [0.6, 0.8]}


def test_asked_voices_are_known_or_new(spark, small):
    """The stated queries all get a speaker, each held against all other vectors."""
    from parley.plans.live import known_or_new_speakers

    e = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").toPandas()
    m, people = np.stack(e["embedding"]).astype(float), e["label"].to_numpy()
    sims = m @ m.T
    np.fill_diagonal(sims, -np.inf)
    got = {r["vec_id"]: r["speaker"] for r in known_or_new_speakers(spark, small).collect()}
    asked = [(k, number) for k, number in enumerate(e["vec_id"]) if number % 100 == 0]
    assert sorted(got) == [number for _, number in asked]
    for k, number in asked:
        means = {p: np.mean([x for x in -np.sort(-sims[k, people == p])[:3] if x > -np.inf]) for p in np.unique(people)}
        best = max(means, key=means.get)
        if means[best] >= 0.2 + 1e-9:
            assert got[number] == str(best)
        elif means[best] < 0.2 - 1e-9:
            assert got[number].startswith("Speaker ")


def test_known_people_are_never_merged(spark):
    """Windows recognised as two people stay two voices however near those are; unknown ones nearby join the nearer."""
    a, b = [1.0, 0.05], [1.0, -0.05]
    rows = [(k, 0, 2.0, a, "Ann") for k in range(3)] + [(3 + k, 1, 2.0, b, "Bob") for k in range(3)] + [(6, 2, 1.0, [1.0, 0.04], None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "m int, seq long, segment int, seconds double, embedding array<double>, known string")
    got = {r["seq"]: r["voice"] for r in v.split_voices(df, ["m"], 0.5, 3.0).collect()}
    assert len({got[0], got[3]}) == 2 and got[6] == got[0]
    plain = {r["voice"] for r in v.split_voices(df.drop("known"), ["m"], 0.5, 3.0).collect()}
    assert plain == {0}


def test_pairs_are_told_apart_and_counted_within_blocks(spark, small):
    """No pair is joined or shuffled, and counts by rounded score are those of the pairs."""
    from parley.operators import voices as operators
    from parley.plans import voices as plans

    rows = plans.vectors(spark, small)
    pairs = operators.verification_scores(plans.asked(rows), rows)
    assert "LeftAnti" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = {(r["s"], r["genuine"]): r["count"] for r in pairs.groupBy(F.round("score", 6).alias("s"), "genuine").count().collect()}
    got = {}
    for r in operators.verification_counts(plans.asked(rows), rows).collect():
        got |= {(r["score"], kind): n for kind, n in ((True, r["g"]), (False, r["i"])) if n}
    assert got == want


def test_rounding_keeps_the_sign_of_nothing(spark):
    from parley.functions.vectors import rounded

    got = [r[0] for r in spark.createDataFrame([(-0.00002,), (0.00002,), (-0.12345678,)], "x double").select(rounded(F.col("x"), 4)).collect()]
    assert list(map(str, got)) == ["-0.0", "0.0", "-0.1235"]
