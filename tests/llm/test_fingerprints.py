"""Fingerprints and edited texts against a plain loop."""

import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from parley.llm import fingerprints as f
from parley.llm.common import word_memo

from .conftest import pairs


M = (1 << 64) - 1


def finalised(x, salt):
    """The 64-bit finaliser, in whole numbers."""
    x = (x + 0x9E3779B97F4A7C15 * (salt + 1)) & M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def set_of(text):
    """All shingle hashes of a text."""
    words = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
    size, found = min(5, len(words)), set()
    for k in range(len(words) - size + 1 if words else 0):
        total = 0
        for w in words[k : k + size]:
            total = finalised(total + w & M, size)
        found.add(total)
    return found


def kept(text):
    return {x for x in set_of(text) if x < 1 << 61}


def fingerprint(text):
    name = sum(finalised(x, 21) for x in set_of(text)) & M
    return f"{name:016x}" + "".join(f"{x:016x}" for x in sorted(kept(text)))


def share(a, b, of):
    return len(kept(a) & kept(b)) / len(of) if of else float(set_of(a) == set_of(b))


def plain(rows):
    """rows in order of descending id."""
    out = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = [share(text, x, kept(text) | kept(x)) for x in (edited, after)]
        within = [share(text, x, kept(y)) for x, y in ((edited, text), (edited, edited), (after, text), (after, after))]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(text), fingerprint(edited), *near, *within)
    return out


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "edited_in", "in_next", "next_in")


def found(df, **options):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in f.edited_fingerprints(df, **options).collect()}


def test_edited_texts(docs):
    want = plain(sorted(pairs(docs), reverse=True))
    assert found(docs) == want
    assert found(docs.repartition(7), rows_per_range=11) == want


def test_likeness_is_near_the_truth(docs):
    memo = word_memo()
    rows = sorted(pairs(docs), reverse=True)
    errors = []
    for _, text in rows[:60]:
        words = text.split()
        changed = " ".join(words[: len(words) * 3 // 4])
        truth = [set(f.shingle_hashes(f.word_hashes(x.encode(), memo), f.WIDTH).tolist()) for x in (text, changed)]
        if len(truth[0]) > 300:
            a, b = (f.sketch(x.encode(), memo) for x in (text, changed))
            errors.append(abs(f.likeness(a, b) - len(truth[0] & truth[1]) / len(truth[0] | truth[1])))
    assert np.mean(errors) < 0.08


def test_containment_of_unequal_texts(spark):
    """A passage of a long text is found in it, from the sketches alone."""
    long = " ".join(f"w{k}" for k in range(40_000))
    part = " ".join(f"w{k}" for k in range(1000, 1800))
    got = found(spark.createDataFrame([(2, part), (1, long)], "doc_id long, text string"))
    assert got[2][8] == 1.0 and 0.005 < got[2][9] < 0.05 and got[1][9] == 1.0


def test_containment_and_merging(spark):
    long = " ".join(f"w{k}" for k in range(4000))
    part = " ".join(f"w{k}" for k in range(1000, 1800))
    df = f.sketch_texts(spark.createDataFrame([(1, long), (2, part), (3, None)], "doc_id long, text string"))
    rows = {r["doc_id"]: r["sketch"] for r in df.collect()}
    both = spark.createDataFrame([(rows[2], rows[1], rows[3])], "a array<long>, b array<long>, c array<long>")
    r = both.select(f.contained("a", "b").alias("in"), f.contained("b", "a").alias("back"), f.contained("c", "a").alias("none"), F.array_sort(f.merged("a", "b")).alias("m")).first()
    assert r["in"] == 1.0 and 0.1 < r["back"] < 0.3 and r["none"] == 1.0 and r["m"] == sorted(rows[1])


def test_odd_input(spark, odd, empty):
    got = f.edited_fingerprints(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["n_chars"] == 0 and by_id[0]["fingerprint"] == "0" * 16
    assert f.edited_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")
    assert found(one) == plain([(5, "only one text here")])
