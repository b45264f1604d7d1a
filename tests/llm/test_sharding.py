"""Shards: sizes, slots, groups that straddle borders, odd input."""

import random
import zlib
from collections import defaultdict

from parley.llm.sharding import BIAS, boundaries, shard_by_bytes

from .conftest import counted, pairs


def check(df, shards, most_error):
    got = shard_by_bytes(df, shards, rows_per_part=7).collect()
    want = [(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in pairs(df)]
    assert counted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == counted(want)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    mean = sum(sizes.values()) / shards
    assert all(abs(s - mean) <= most_error for s in sizes.values())
    return got


def test_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    largest = max(len((r["text"] or "").encode()) for r in docs.select("text").collect())
    check(docs, 10, largest + 40)


def test_one_text_larger_than_a_shard(spark):
    df = spark.createDataFrame([(k, "the same text" if k % 3 else f"another {k}") for k in range(3000)], "doc_id long, text string")
    check(df, 8, 80)


def test_boundaries_against_sorting(spark):
    """Each boundary by probes is where a full sort has it, to within the tolerance, whatever groups of equal keys there are."""
    rng = random.Random(8)
    for case in range(6):
        keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(50)]
        hot = keys[: 1 + case % 3]
        rows = [(rng.choice(hot) if rng.random() < 0.5 else rng.choice(keys) if case % 2 else rng.randrange(-(1 << 63), 1 << 63), rng.randrange(-(1 << 63), 1 << 63), rng.randint(16, 90)) for _ in range(1500)]
        total = sum(x[2] for x in rows)
        goals = [total * k // 7 for k in range(1, 7)]
        found = boundaries(spark.createDataFrame(rows, "key long, tie long, size long").repartition(3), "size", goals, 50, 200)
        for goal, (key, tie) in zip(goals, found):
            below = sum(size for k, t, size in rows if (k + BIAS, t + BIAS) < (key, tie))
            assert abs(below - goal) <= (200 if tie == 0 else 95), (goal, below)


def test_slots_follow_the_sorted_keys(spark):
    """Read by shard and slot, rows of equal texts stand together: a full sort by the text's hash."""
    docs = spark.createDataFrame([(k, f"text {k % 700}") for k in range(3000)], "doc_id long, text string")
    rows = shard_by_bytes(docs, 5, rows_per_part=10).orderBy("shard", "slot").collect()
    texts = [r["doc_id"] % 700 for r in rows]
    runs = 1 + sum(a != b for a, b in zip(texts, texts[1:]))
    assert runs == 700


def test_odd_input(odd, empty):
    got = shard_by_bytes(odd, 4).collect()
    assert len(got) == odd.count()
    assert shard_by_bytes(empty, 4).count() == 0


def test_no_python_on_the_path(docs):
    plan = shard_by_bytes(docs, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
