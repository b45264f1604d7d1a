"""Early rows, conflation and control rows: batch twins, streams, bounded state, and timers."""

import pickle
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import early, live
from parley.streaming import early as streams

PCM_SHAPE = "recording string, seq int, pcm binary, control string"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(streams.PROVIDER)
    spark.conf.set(streams.PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(streams.PROVIDER, old)


def sound(seconds, loud):
    t = np.arange(int(seconds * live.RATE)) / live.RATE
    return (np.sin(2 * np.pi * 220 * t) * (0.4 if loud else 0.0005) * 32767).astype("<i2").tobytes()


PCM = sound(1, False) + sound(2, True) + sound(1, False) + sound(0.2, True) + sound(1.5, False) + sound(1, True)


def pieces(spark, size, control=early.FINISH, name="r1"):
    cut = [PCM[k : k + size] for k in range(0, len(PCM), size)]
    rows = [(name, k, bytearray(c), None) for k, c in enumerate(cut)]
    return spark.createDataFrame([*rows, (name, len(cut), None, control)], PCM_SHAPE)


def told(df):
    return [(r["id"], r["start"], r["end"], r["partial"], None if r["pcm"] is None else bytes(r["pcm"])) for r in df.collect()]


def test_early_rows_are_replaced_by_their_final_one(spark):
    rows = told(early.early_utterances(pieces(spark, 1000)))
    for size in (len(PCM), 33_334):
        assert told(early.early_utterances(pieces(spark, size))) == rows
    assert [r[0] for r in rows] == sorted(r[0] for r in rows) and {r[0] for r in rows} == {1, 2}
    for number in (1, 2):
        own = [r for r in rows if r[0] == number]
        assert all(r[3] for r in own[:-1]) and not own[-1][3]
        lengths = [r[2] - r[1] for r in own]
        assert all(b - a >= 0.7 - 1e-6 for a, b in zip(lengths, lengths[1:-1])) and len(own) >= 2
        assert len({r[1] for r in own}) == 1
    final = [r for r in rows if not r[3]]
    start, end = (2 * round(x * live.RATE) for x in final[0][1:3])
    assert final[0][4] == PCM[start:end]  # as heard, from the sound that is kept
    assert final[1][4] is None  # too short
    assert [r[1:3] for r in final] == [(r["start"], r["end"]) for r in live.utterances(pieces(spark, 5000).where("pcm is not null"), silence=0.45, longest=8.0).orderBy("start").collect()]


def test_finish_tells_the_open_utterance_and_cancel_drops_it(spark):
    kept, dropped = told(early.early_utterances(pieces(spark, 4000))), told(early.early_utterances(pieces(spark, 4000, early.CANCEL)))
    assert dropped == kept[:-1] and kept[-1][3] is False and dropped[-1][3] is True
    late = pieces(spark, 4000, early.CANCEL).unionByName(spark.createDataFrame([("r1", 10**6, bytearray(PCM), None)], PCM_SHAPE))
    assert told(early.early_utterances(late)) == dropped  # nothing is heard after the end


def test_state_is_bounded():
    walk, sizes = early.EarlySpeech(), []
    for k in range(120):
        walk.row(PCM, None)
        sizes.append(len(pickle.dumps(walk)))
    assert max(sizes) < 1.3 * 2 * 12 * live.RATE and sizes[-1] <= max(sizes[5:20])


def drained(spark, stream, name):
    """All input, then the end: batches without data, which timers need, would go on for ever."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.table(name)


def source(spark, parts, folder):
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/part={k}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def test_utterance_stream_equals_its_batch_twin(rocks, tmp_path):
    df = pieces(rocks, 20_000).unionByName(pieces(rocks, 30_000, early.CANCEL, "r2"))
    parts = [df.where("seq < 5"), df.where("seq >= 5")]
    got = told(drained(rocks, streams.early_utterance_stream(source(rocks, parts, tmp_path)), "early_utterances").orderBy("recording", "id", "end", F.desc("partial")))
    assert got == told(early.early_utterances(df).orderBy("recording", "id", "end", F.desc("partial")))


def test_session_and_conflated_streams(rocks, tmp_path, small):
    e = rocks.read.parquet(f"{small}/events.parquet").where("user_id < 4").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("control", F.lit(None).cast("string"))
    ends = e.groupBy("user_id").agg(F.max("ts").alias("ts")).select(F.lit(10**9).alias("event_id"), "user_id", (F.col("ts") + F.expr("interval 1 second")).alias("ts"), F.lit(early.FINISH).alias("control"))
    cut = [0, 301, 10**8]
    parts = [e.where(f"event_id >= {a} and event_id < {b}") for a, b in zip(cut, cut[1:])]
    stream = source(rocks, [*parts, ends.select(e.columns)], tmp_path)
    got = drained(rocks, streams.early_session_stream(stream, ["user_id"], "12 hours", "3 hours", control="control"), "early_sessions")
    want = early.early_sessions(e, ["user_id"], "12 hours", "3 hours")
    assert sorted(got.collect()) == sorted(want.collect()) and want.where("partial").count() > 10
    shed = drained(rocks, streams.shed_stream(stream.where("control is null").withColumn("final", F.col("event_id") % 5 == 0), ["user_id"], "20 hours", "final"), "shed_events")
    assert sorted(shed.collect()) == sorted(early.shed(e.withColumn("final", F.col("event_id") % 5 == 0), ["user_id"], "20 hours", "final").collect())


def test_a_timer_lets_out_what_waits(rocks, tmp_path):
    """Three rows at once: the first is let out, the newest after the interval, though no row follows."""
    rows = rocks.createDataFrame([(k, 1) for k in range(3)], "event_id long, user_id long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rocks.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streams.conflated_stream(stream, ["user_id"], "2 seconds").writeStream.format("memory").queryName("conflated_events").outputMode("update").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and rocks.table("conflated_events").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    at = 1_700_000_000_000_000
    assert sorted(tuple(r) for r in rocks.table("conflated_events").collect()) == [(1, at, 0, 0), (1, at + 2_000_000, 2, 1)]


def test_conflation_against_time_steps(spark):
    """Against a plain simulation that goes through every moment."""
    rng = random.Random(4)
    for _ in range(200):
        rows = sorted((rng.randint(0, 60), k) for k in range(rng.randint(0, 25)))
        rows = [(at, k) for k, (at, _) in enumerate(rows)]
        walk, got = early.Conflate(7), []
        for at, item in rows:
            got += walk.row(at, item)
        got += walk.end()
        want, last, pending = [], None, []
        for now in range(0, 200):
            if pending and now >= last + 7:
                want.append((now, pending[-1], len(pending) - 1))
                last, pending = now, []
            for at, item in rows:
                if at == now:
                    if last is None or now >= last + 7:
                        want.append((now, item, 0))
                        last = now
                    else:
                        pending.append(item)
        assert got == want


def test_odd_rows_and_provider(spark):
    empty = spark.createDataFrame([], PCM_SHAPE)
    assert early.early_utterances(empty).count() == 0
    odd = spark.createDataFrame([(None, 0, bytearray(PCM), None), (None, 1, None, None), ("x", 0, bytearray(b"\x01"), None), ("x", 1, None, "finish"), ("x", 2, None, "finish")], PCM_SHAPE)
    assert {r["recording"] for r in early.early_utterances(odd).collect()} == {None}
    events = spark.createDataFrame([(1, None, 5), (2, None, None)], "event_id long, ts timestamp, user_id long")
    assert early.early_sessions(events, ["user_id"], "1 hours", "1 minutes").count() == 0 == early.conflated(events, ["user_id"], "1 hours").count()
    with pytest.raises(ValueError, match="RocksDB"):
        streams.conflated_stream(events, ["user_id"], "1 hours")
