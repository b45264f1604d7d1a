"""Streams end with what their batch twins say."""

import numpy as np
from pyspark.sql import functions as F

from parley.operators import live
from parley.streaming import live as streams


def sound(seconds, loud):
    t = np.arange(int(seconds * live.RATE)) / live.RATE
    return (np.sin(2 * np.pi * 220 * t) * (0.4 if loud else 0.0005) * 32767).astype("<i2").tobytes()


PCM = sound(1, False) + sound(2, True) + sound(1, False) + sound(0.2, True) + sound(1.5, False) + sound(1, True)


def pieces(spark, size):
    cut = [PCM[k : k + size] for k in range(0, len(PCM), size)]
    return spark.createDataFrame([("r1", k, bytearray(c), k == len(cut) - 1) for k, c in enumerate(cut)], "recording string, seq int, pcm binary, last boolean")


def test_utterances_do_not_depend_on_pieces(spark):
    want = None
    for size in (len(PCM), 1000, 33_334):
        got = [(r["start"], r["end"]) for r in live.utterances(pieces(spark, size)).orderBy("start").collect()]
        want = want or got
        assert got == want
    assert len(want) == 2 and abs(want[0][0] - 0.8) < 0.1 and abs(want[0][1] - 3.6) < 0.15


def drained(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_utterance_stream(spark, tmp_path):
    df = pieces(spark, 20_000)
    for k in range(3):
        df.where((F.col("seq") >= k * 4) & (F.col("seq") < (k * 4 + 4 if k < 2 else 1000))).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    drained(streams.utterance_stream(source), "utterances")
    got = sorted(tuple(r) for r in spark.table("utterances").collect())
    assert got == sorted(tuple(r) for r in live.utterances(df).collect())


def test_upserts_converge(spark, tmp_path):
    rows = [(s, i, r, f"{s}-{i}-{r}" if r % 5 else "") for r, (s, i) in enumerate([(k % 3, k % 4) for k in range(60)])]
    df = spark.createDataFrame(rows, "session int, id int, rev int, text string")
    for k, part in enumerate(("rev >= 40", "rev < 20", "rev between 20 and 39", "rev < 10")):  # late and repeated rows
        df.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = streams.upsert_stream(source, ["session", "id"], f"{tmp_path}/table", f"{tmp_path}/check", availableNow=True)
    q.awaitTermination(120)
    got = streams.read_upserted(spark, f"{tmp_path}/table", ["session", "id"])
    assert sorted(got.collect()) == sorted(live.latest(df, ["session", "id"]).collect())


def test_sessions_and_repeats(spark, tmp_path, small):
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = e.agg(F.max("ts")).first()[0]
    flush = spark.createDataFrame([(-1, end, -1, "flush", 0.0, "{}")], e.schema).withColumn("ts", F.col("ts") + F.expr("interval 2 days"))
    e.repartition(1).write.parquet(f"{tmp_path}/in/a")
    e.where("event_id % 10 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    flush.coalesce(1).write.parquet(f"{tmp_path}/in/c")
    source = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    drained(streams.distinct_stream(source, ["event_id"], "40 days"), "distinct_events")
    assert spark.table("distinct_events").where("event_id >= 0").count() == e.count()
    source = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in/a")
    drained(streams.session_stream(source, ["user_id"], "30 minutes", "1 hour"), "sessions")
    want = {tuple(r) for r in live.sessions(e, ["user_id"], "30 minutes").collect()}
    got = {tuple(r) for r in spark.table("sessions").collect()}
    assert got <= want and len(got) > 0.9 * len(want)
