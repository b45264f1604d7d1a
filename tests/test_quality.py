"""Error rates: golden cases, exact mapping against all permutations, frames by loops."""

import itertools
import random

import pandas as pd
import pytest

from parley.operators import quality as q


def test_word_errors(spark):
    pairs = spark.createDataFrame([("The cat sat on the mat.", "the cat sat on a mat"), ("", ""), ("", "one"), ("a b c", None), ("it’s", "it's")], "reference string, hypothesis string")
    got = [(r["errors"], r["words"], round(r["wer"], 4)) for r in q.word_errors(pairs).collect()]
    assert got == [(1, 6, 0.1667), (0, 0, 0.0), (1, 0, 1.0), (3, 3, 1.0), (0, 1, 0.0)]


def test_distance():
    rng = random.Random(1)

    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))

    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert q._distance(a, b) == slow(a, b)


@pytest.mark.parametrize("seed", range(30))
def test_mapping_is_best(seed):
    rng = random.Random(seed)
    left, right = rng.randint(1, 5), rng.randint(1, 5)
    cells = {(a, b): rng.randint(1, 20) for a in range(left) for b in range(right) if rng.random() < 0.7}
    if not cells:
        return
    pairs = pd.DataFrame([(f"r{a}", f"h{b}", n) for (a, b), n in cells.items()], columns=["reference", "hypothesis", "frames"])
    keep = pairs[q._best_mapping(pairs)]
    assert keep["reference"].is_unique and keep["hypothesis"].is_unique
    most = max(sum(cells.get((a, b), 0) for a, b in zip(range(left), order)) for order in itertools.permutations(range(max(left, right)), left))
    assert keep["frames"].sum() == most


def by_frames(reference, hypothesis, collar, step):
    n = round(max(e for _, _, e in reference + hypothesis) / step) + 1
    masked = set()
    for _, a, b in reference:
        for x in (a, b):
            masked |= set(range(max(0, round(x / step) - collar), min(n, round(x / step) + collar)))
    on = [{s: {f for x, a, b in side if x == s for f in range(round(a / step), round(b / step))} - masked for s in {x for x, _, _ in side}} for side in (reference, hypothesis)]
    total = missed = false = both = 0
    for f in range(n):
        r, h = (sum(f in v for v in side.values()) for side in on)
        total, missed, false, both = total + r, missed + max(0, r - h), false + max(0, h - r), both + min(r, h)
    names = list(on[1])
    correct = max(sum(len(on[0][a] & on[1][b]) for a, b in zip(on[0], order) if b is not None) for order in itertools.permutations(names + [None] * len(on[0]), len(on[0])))
    return total, missed, false, both - correct


def test_speaker_errors(spark):
    rng = random.Random(7)
    schema = "m int, speaker string, start double, end double"
    for collar, step in ((0.25, 0.01), (0.0, 0.05)):
        sides = [[(rng.choice(names), a := round(rng.uniform(0, 20), 2), round(a + rng.uniform(0.3, 5), 2)) for _ in range(9)] for names in ("ABC", "xyz")]
        frames = [spark.createDataFrame([(1, *s) for s in side], schema) for side in sides]
        r = q.speaker_errors(*frames, ["m"], collar, step, 7.0).first()
        assert (r["total"], r["missed"], r["false_alarm"], r["confusion"]) == by_frames(*sides, round(collar / step), step)


def test_one_label_for_two(spark):
    schema = "m int, speaker string, start double, end double"
    r = q.speaker_errors(spark.createDataFrame([(1, "alice", 0.0, 10.0), (1, "bob", 10.0, 20.0)], schema), spark.createDataFrame([(1, "X", 0.0, 20.0)], schema), ["m"]).first()
    assert abs(r["der"] - 0.5) < 1e-9 and r["missed"] == r["false_alarm"] == 0


def test_parts_follow_the_number_of_rows(spark, small):
    """Tasks of speaker errors and of assignment are as many as rows need; run time does not make them fewer and larger."""
    from parley.operators import common
    from parley.plans import quality as plans
    from parley.plans import timeline

    assert [common.parts_for(n, 10) for n in (0, 10, 11, 1000)] == [1, 1, 2, 100]
    for made in (plans.der_components, plans.der_frames, plans.der_total, timeline.assign_by_overlap):
        assert "RepartitionByExpression" in made(spark, small)._jdf.queryExecution().optimizedPlan().toString()
