"""Language-model scores: exact base, probabilities that sum to one, a plain backoff over all n-grams."""

import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
import pytest

from parley.llm import backoff_lm as b

from .conftest import pairs


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def tokens(text):
    return [*text.encode().lower().split(), None]


class Plain:
    """All n-grams of the training texts in dictionaries, and the model's probabilities by its definition."""

    def __init__(self, rows):
        train = [tokens(t) for i, t in rows if not held(i)]
        self.grams = {k: Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in (1, 2, 3)}
        self.n, self.v = sum(self.grams[1].values()), len(self.grams[1])
        self.after = {}
        for k in (2, 3):
            for g, c in self.grams[k].items():
                if c >= 2:
                    self.after.setdefault(g[:-1], {})[g[-1]] = c

    def p(self, context, w):
        if not context:
            return (self.grams[1][w,] + 1) / (self.n + self.v + 1)
        lower = self.p(context[1:], w)
        if context not in self.after:
            return lower
        seen, whole = self.after[context], self.grams[len(context)][context]
        return max(seen.get(w, 0) - 0.75, 0) / whole + (1 - sum(c - 0.75 for c in seen.values()) / whole) * lower

    def score(self, text):
        t = tokens(text)
        return sum(log10(self.p(tuple(t[max(0, k - 2) : k]), t[k])) for k in range(len(t)))


@pytest.mark.parametrize("options", [{}, {"most_short": 5, "block_bytes": 3000, "meeting_tokens": 4000}, {"most_short": 0, "block_bytes": 20_000, "meeting_tokens": 50_000}])
def test_scores_are_those_of_all_grams(docs, odd, options):
    """Whatever is cut into blocks, meets in one place or has a short number."""
    for df in (docs, odd):
        rows = pairs(df)
        plain = Plain(rows)
        want = {i: (held(i), len(tokens(t)), sum(plain.grams[1][w,] > 0 for w in tokens(t)), plain.n, sum(log10(plain.p((), w)) for w in tokens(t)), plain.score(t)) for i, t in rows}
        got = b.score_texts(df, **options).collect()
        assert len(got) == len(rows)
        for r in got:
            *exact, base, score = want[r["doc_id"]]
            assert [r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens")] == exact
            assert isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and isclose(r["score"], score, rel_tol=1e-9, abs_tol=1e-9), r


def test_probabilities_sum_to_one():
    plain = Plain([(0, x) for x in ["a b c a b c a b d a b c x a b", "b c a b c d d a b", "a b c a b e"] * 3])
    words = [w for w, in plain.grams[1]] + [b"never seen"]
    assert len(plain.after) > 5
    for context in [(), *plain.after]:
        assert isclose(sum(plain.p(context, w) for w in words), 1, rel_tol=1e-9)


def test_model_beats_its_base(spark):
    got = b.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    score, base = (sum(r[c] for r in got) for c in ("score", "base_score"))
    assert score > base


def test_a_rare_gram_counts_in_a_large_corpus(spark):
    """A pair or triple seen twice counts however large the corpus is."""
    lines = ["p q r s", "p q r t", "x p q r s q", "p q r s p"] + [f"common words w{k % 50} common" for k in range(3000)]
    plain = Plain(list(enumerate(lines)))
    assert any(c in plain.after for c in ((b"p", b"q"), (b"q", b"r")))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    for r in b.score_texts(df, block_bytes=9000, meeting_tokens=2000).where("doc_id < 60").collect():
        assert isclose(r["score"], plain.score(lines[r["doc_id"]]), rel_tol=1e-9), r


def test_packed_arrays():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 1 << 63, 50, np.uint64), np.zeros(0, np.uint32), rng.integers(0, 9, 7).astype(np.uint8), np.arange(5, dtype=np.uint32)]
    for x, y in zip(arrays, b.unsqueeze(b.squeeze(*arrays))):
        assert x.dtype == y.dtype and (x == y).all()


def test_empty(empty):
    assert b.score_texts(empty).count() == 0
