"""Shards of near equal bytes by histogram sort. DataFrame functions only."""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import MASK, durable, whole_text

#: Bits by which a round of probes refines a key, and the bits of each of the two keys.
STEP, KEY_BITS = 8, 64
BIAS = 1 << 63

#: Bits of the key by which boundaries are looked up.
GRAIN = 12

#: Least and most intervals of rows that are sorted by a task each.
LEAST_PARTS, MOST_PARTS = 64, 2000


def digits(key: str, bits: int) -> Column:
    """The first ``bits`` bits of a key, in the key's order."""
    flipped = F.col(key).bitwiseXOR(F.lit(-BIAS))
    return F.shiftrightunsigned(flipped, KEY_BITS - bits)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of numbers that the driver made."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>"))).select(*names)


def boundaries(rows: DataFrame, weight: str, goals: list[int], tight: float, loose: float) -> list[tuple[int, int]]:
    """For each goal the boundary (key, tie), as unsigned numbers, below which about that much of ``weight`` lies.

    Each round counts exactly what lies below 256 further probes in every interval that still holds a goal, one job for all of
    them, until a boundary is within ``tight`` of each goal. Rows of one key stay together where an error of ``loose`` allows it;
    where a goal falls into a larger group of one key, rounds go on with the second key, again one job for all groups.
    At most 256 numbers an open interval come to the driver, whatever the rows.
    """
    found: dict[int, tuple[int, int]] = {}
    groups: dict[int, tuple[int, int]] = {}  # goal: the key of the group that holds it, and what lies below the group
    still = {goal: (0, 0) for goal in goals}  # goal: prefix of the interval that holds it, and what lies below that
    for fixed in range(0, KEY_BITS, STEP):
        if not still:
            break
        part = rows.where(digits("key", fixed).isin(sorted({p for p, _ in still.values()}))) if fixed else rows
        counted = part.groupBy(digits("key", fixed + STEP).alias("at")).agg(F.sum(weight).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        counted = sorted((r["at"] & MASK, r["n"], r["low"], r["low"] == r["high"]) for r in counted)
        inside = {prefix: list(x) for prefix, x in groupby(counted, key=lambda x: x[0] >> STEP)}
        left, now, still = KEY_BITS - fixed - STEP, still, {}
        for goal, (prefix, below) in now.items():
            low, high, (at, _, key, alone) = interval(inside[prefix], goal, below)
            error = min(goal - low, high - goal)
            if error <= tight or alone and error <= loose:
                found[goal] = (at << left, 0) if goal - low <= high - goal else (at + 1 << left, 0)
            elif alone:
                groups[goal] = (key + BIAS, low)
            else:
                still[goal] = (at, low)
    open_groups = {goal: (key, 0, below) for goal, (key, below) in groups.items()}
    for fixed in range(0, KEY_BITS, STEP):
        if not open_groups:
            break
        part = rows.where(F.col("key").isin(sorted({key - BIAS for key, _, _ in open_groups.values()})))
        part = part.where(digits("tie", fixed).isin(sorted({p for _, p, _ in open_groups.values()}))) if fixed else part
        counted = part.groupBy("key", digits("tie", fixed + STEP).alias("at")).agg(F.sum(weight).alias("n")).collect()
        counted = sorted((r["key"] + BIAS, r["at"] & MASK, r["n"]) for r in counted)
        inside = {name: [x[1:] for x in own] for name, own in groupby(counted, key=lambda x: (x[0], x[1] >> STEP))}
        left, now, open_groups = KEY_BITS - fixed - STEP, open_groups, {}
        for goal, (key, prefix, below) in now.items():
            low, high, (at, _) = interval(inside[key, prefix], goal, below)
            if min(goal - low, high - goal) <= tight or not left:
                tie = at << left if goal - low <= high - goal else at + 1 << left
                found[goal] = (key, tie) if tie < 1 << KEY_BITS else (key + 1, 0)
            else:
                open_groups[goal] = (key, at, low)
    return [found[goal] for goal in goals]


def interval(counted: list[tuple], goal: int, below: int) -> tuple[int, int, tuple]:
    """What lies below and up to the end of the counted interval that holds the goal, and that interval."""
    edges = list(accumulate((x[1] for x in counted), initial=below))
    k = max(0, min(bisect_right(edges, goal) - 1, len(counted) - 1))
    return edges[k], edges[k + 1], counted[k]


def place(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with the number of boundaries at or below each as ``part``; boundaries (key, tie) ascend.

    Boundaries are looked up by the key's first bits: how many lie below those, and the few that share them.
    """
    inside: dict[int, list[dict]] = {}
    for key, tie in bounds:
        if key < 1 << KEY_BITS:
            inside.setdefault(key >> (KEY_BITS - GRAIN), []).append({"key": key - BIAS, "tie": tie - BIAS})
    before = list(accumulate((len(inside.get(k, ())) for k in range(1 << GRAIN)), initial=0))
    table = small_table(rows.sparkSession, [(k, before[k], inside.get(k, [])) for k in range(1 << GRAIN)], "grain int, before int, own array<struct<key:long,tie:long>>")
    passed = F.filter("own", lambda b: (b["key"] < F.col("key")) | ((b["key"] == F.col("key")) & (b["tie"] <= F.col("tie"))))
    found = rows.withColumn("grain", digits("key", GRAIN).cast("int")).join(F.broadcast(table), "grain")
    return found.withColumn("part", F.col("before") + F.size(passed)).drop("grain", "before", "own")


def shard_by_bytes(df: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text", loose: float = 0.01, tight: float = 0.001, rows_per_part: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of ``df``.

    A row's size is its text's UTF-8 bytes (null: none) plus 16. Rows are ordered by a hash of the text and then a hash of the
    row; shards are ranges of that order, found by counting bytes below probes until every boundary meets its tolerance.
    Boundaries by the number of rows cut shards into intervals of about ``rows_per_part`` rows in the same way; then rows are exchanged once,
    by interval, and sorted there. Slots count a shard's rows in that order, gapless from 0. Equal texts share a shard unless their
    group straddles a boundary and is larger than the tolerance. Null ids and repeated rows are rows like others; an empty
    table gives an empty one; other columns are not read.
    """
    text = whole_text(text_column)
    rows = df.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.monotonically_increasing_id(), F.col(id_column)).alias("tie"),
        F.lit(1).alias("one"),
    )
    rows = durable(rows)
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    of_shards = of_parts = []
    if count:
        mean, parts = total / shards, max(LEAST_PARTS, min(MOST_PARTS, -(-count // rows_per_part)))
        of_shards = boundaries(rows, "size", [round(mean * k) for k in range(1, shards)], mean * tight, mean * loose)
        of_parts = boundaries(rows, "one", sorted({count * k // parts for k in range(1, parts)} - {0}), count / parts / 8, count / parts / 2)
    bounds = sorted({*of_shards, *of_parts})
    placed = place(rows, bounds)
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # at most as many numbers as boundaries
    begins = [(0, 0), *bounds]
    shard_of = [bisect_right(sorted(of_shards), b) for b in begins]
    starts, held = [], dict.fromkeys(range(shards), 0)
    for part, shard in enumerate(shard_of):
        starts.append((part, shard, held[shard]))
        held[shard] += counts.get(part, 0)
    table = small_table(df.sparkSession, starts, "part int, shard int, start long")
    rank = F.row_number().over(W.partitionBy("part").orderBy("key", "tie", "doc_id"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(table), "part")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op4_histogram_sort(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
