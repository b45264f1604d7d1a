"""Queries over sound: customers are recordings of a made tone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import sound
from parley.operators.common import spread
from parley.plans import query, table

_LENGTH = "(300 + 97 * (c_custkey % 23))"


@F.pandas_udf(T.BinaryType())
def _tone(recording: pd.Series, first: pd.Series, end: pd.Series) -> pd.Series:
    """16-bit samples first to end - 1 of a recording's tone."""
    return pd.Series([((np.arange(a, b) * 37 + c * 11) % 2001 - 1000).astype("<i2").tobytes() for c, a, b in zip(recording, first, end)], dtype=object)


def recordings(spark, sf_dir):
    """Pieces of 700 samples: sample k of customer c is (k * 37 + c * 11) % 2001 - 1000."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recording"), (300 + 97 * (F.col("c_custkey") % 23)).alias("length"))
    c = spread(c, ["recording"], c.count(), 10_000)  # a small file of short rows, from which much sound is made
    pieces = c.withColumn("seq", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / 700).cast("int"))))
    first = F.col("seq").cast("long") * 700
    return pieces.select("recording", "seq", _tone("recording", first, F.least(first + 700, F.col("length"))).alias("pcm"))


@F.pandas_udf(T.LongType())
def _weighed(at: pd.Series, pcm: pd.Series) -> pd.Series:
    """Sum of a piece's samples, sample k by k % 7 + 1."""
    samples = [np.frombuffer(raw, "<i2").astype(np.int64) for raw in pcm]
    return pd.Series([int(((np.arange(a, a + len(x)) % 7 + 1) * x).sum()) for a, x in zip(at, samples)], dtype="int64")


@query(f"""
WITH c AS (SELECT c_custkey, {_LENGTH} AS n FROM customer), k AS (SELECT c_custkey, n, unnest(range(n)) AS k FROM c),
f AS (SELECT c_custkey, CASE WHEN n < 400 THEN 0 ELSE (n - 400) // 160 + 1 END AS frames, k, (k * 37 + c_custkey * 11) % 2001 - 1000 AS v FROM k)
SELECT c_custkey AS recording, CAST(max(frames) AS BIGINT) AS frames, CAST(sum(v * v * greatest(0, least(k // 160, frames - 1) - (CASE WHEN k < 400 THEN 0 ELSE (k - 400) // 160 + 1 END) + 1)) AS BIGINT) AS energy
FROM f WHERE frames > 0 GROUP BY c_custkey""")
def mel_frames(spark, sf_dir):
    """Frames of each recording and the energy in them, from the blocks of log-mel features."""
    return sound.mel_means(recordings(spark, sf_dir)).select("recording", "frames", "energy")


@query(f"""
WITH c AS (SELECT c_custkey, {_LENGTH} AS n FROM customer), k AS (SELECT c_custkey, unnest(range(n)) AS k FROM c), v AS (SELECT c_custkey, k, (k * 37 + c_custkey * 11) % 2001 - 1000 AS v FROM k),
w AS (SELECT c_custkey, k, coalesce(lead(v, 2) OVER s, 0) AS a, coalesce(lead(v, 1) OVER s, 0) AS b, coalesce(lag(v, 1) OVER s, 0) AS d FROM v WINDOW s AS (PARTITION BY c_custkey ORDER BY k))
SELECT c_custkey AS recording, count(*) AS samples, CAST(sum((k % 7 + 1) * (2 * a + 4 * b + 6 * d)) AS BIGINT) AS weighed FROM w GROUP BY c_custkey""")
def filtered_recordings(spark, sf_dir):
    """Each recording through a filter of taps 2, 4, 0, 6, whose delay of two samples is taken back."""
    out = sound.filtered(recordings(spark, sf_dir), taps=[2, 4, 0, 6], delay=2, strength=1.0, size=500)
    return out.groupBy("recording").agg(F.sum(F.floor(F.octet_length("pcm") / 2)).alias("samples"), F.sum(_weighed("at", "pcm")).alias("weighed"))
