"""Log-mel features against a plain transform, filters against a plain sum, however the sound is cut; resampling of tones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import sound as s
from parley.sources.files import _resampled
from parley.streaming import early as streams

SHAPE = "recording string, seq int, pcm binary, at int, total string, block int"


def pieces(spark, sounds, size):
    rows = [(name, k, bytearray(raw[k : k + size]), 1, "x", 2) for name, raw in sounds.items() for k in range(0, len(raw), size)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


def noise(samples, seed):
    return np.random.default_rng(seed).integers(-9000, 9000, samples).astype("<i2")


def plain_mel(samples):
    """By sums over sines and cosines, frame by frame."""
    out = []
    angle = 2 * np.pi * np.outer(np.arange(257), np.arange(400)) / 512
    for first in range(0, len(samples) - 399, 160):
        frame = samples[first : first + 400].astype(float) / 32768 * 32768
        frame = frame - frame.mean()
        frame = np.array([frame[k] - 0.97 * frame[max(0, k - 1)] for k in range(400)])
        frame = frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 399)) ** 0.85
        power = (np.cos(angle) @ frame) ** 2 + (np.sin(angle) @ frame) ** 2
        mels = 1127 * np.log(1 + np.arange(257) * 31.25 / 700)
        edges = np.linspace(1127 * np.log(1 + 20 / 700), 1127 * np.log(1 + 8000 / 700), 82)
        banks = [np.clip(np.minimum((mels - a) / (b - a), (c - mels) / (c - b)), 0, None) for a, b, c in zip(edges, edges[1:], edges[2:])]
        out.append([np.log(max(power @ bank, np.finfo(np.float32).eps)) for bank in banks])
    return np.array(out)


def test_features_equal_a_plain_transform(spark):
    sounds = {"a": noise(2000, 1).tobytes(), "b": noise(400, 2).tobytes(), "short": noise(399, 3).tobytes(), "odd": noise(1000, 4).tobytes() + b"x"}
    want = {k: plain_mel(np.frombuffer(v, "<i2", len(v) // 2)) for k, v in sounds.items()}
    for size in (10_000, 322):
        df = pieces(spark, sounds, size)
        found = {r["recording"]: r for r in s.mel_means(df).collect()}
        assert sorted(found) == ["a", "b", "odd"]
        for k, r in found.items():
            raw = np.frombuffer(sounds[k], "<i2", len(sounds[k]) // 2).astype(int)
            assert r["frames"] == len(want[k]) and r["energy"] == sum(int((raw[f : f + 400] ** 2).sum()) for f in range(0, len(raw) - 399, 160))
            assert np.allclose(r["means"], want[k].mean(axis=0), atol=2e-4)
        for k in found:
            rows = s.mel_features(df.where(F.col("recording") == k)).orderBy("frame").collect()
            assert np.allclose([r["mel"] for r in rows], want[k] - want[k].mean(axis=0), atol=5e-4)


def test_a_long_recording_is_several_blocks(spark):
    raw = noise(160 * 6100, 5)
    df = pieces(spark, {"long": raw.tobytes()}, 100_000)
    blocks = s._mel_walk(df, "recording", False, s.BLOCKS).orderBy("first").collect()
    mel = s.log_mel(raw.astype(np.float32) / 32768)
    assert [(r["first"], r["frames"]) for r in blocks] == [(0, 6000), (6000, len(mel) - 6000)]
    assert np.allclose(s.mel_means(df).first()["means"], mel.mean(axis=0), atol=1e-3)


def plain_filter(raw, taps, delay, strength):
    wet = np.convolve(np.concatenate([raw, np.zeros(delay)]), taps)[delay : delay + len(raw)]
    return np.clip(np.rint(strength * wet + (1 - strength) * raw), -32768, 32767).astype(int)


def joined(df):
    out = {}
    for r in df.orderBy("recording", "at").collect():
        own = out.setdefault(r["recording"], b"")
        assert r["at"] * 2 == len(own)  # gapless
        out[r["recording"]] = own + bytes(r["pcm"])
    return {k: np.frombuffer(v, "<i2").astype(int) for k, v in out.items()}


@pytest.mark.parametrize("taps, delay", [(None, s.DELAY), ([0.5, 0.25, 0.25], 0), ([1.0], 3)])
def test_any_cutting_gives_the_same_samples(spark, taps, delay):
    sounds = {"a": noise(5000, 6).tobytes(), "b": noise(3, 7).tobytes(), "c": noise(1024, 8).tobytes()}
    want = {k: plain_filter(np.frombuffer(v, "<i2").astype(float), s.low_pass() if taps is None else taps, delay, 0.5) for k, v in sounds.items()}
    for size, block in ((100_000, 1 << 20), (778, 1000), (200, 512)):
        df = pieces(spark, sounds, size)
        for found in (joined(s.filtered(df, taps=taps, delay=delay, size=block)), joined(s.filtered_in_order(df, taps=taps, delay=delay))):
            assert sorted(found) == sorted(want)
            assert all(len(found[k]) == len(want[k]) and np.abs(found[k] - want[k]).max() <= 1 for k in want)  # halves may round either way


def test_filter_stream(spark, tmp_path):
    old = spark.conf.get(streams.PROVIDER)
    spark.conf.set(streams.PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    raw = noise(4000, 9)
    rows = [("a", k, bytearray(raw[1000 * k : 1000 * k + 1000].tobytes()), None) for k in range(4)] + [("a", 4, None, "finish")]
    df = spark.createDataFrame(rows, "recording string, seq int, pcm binary, control string")
    for k, part in enumerate(("seq < 2", "seq >= 2")):
        df.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    try:
        q = streams.filter_stream(source).writeStream.format("memory").queryName("filtered_sound").outputMode("update").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    finally:
        spark.conf.set(streams.PROVIDER, old)
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert (joined(spark.table("filtered_sound"))["a"] == joined(s.filtered_in_order(df.where("pcm is not null")))["a"]).all()


def test_empty_and_odd(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert s.mel_means(empty).count() == s.mel_features(empty).count() == s.filtered(empty).count() == 0
    odd = spark.createDataFrame([(None, 0, bytearray(noise(500, 1).tobytes()), 1, "x", 2), (None, 1, None, 1, "x", 2), ("e", 0, bytearray(b""), 1, "x", 2)], SHAPE)
    assert [(r["recording"], r["frames"]) for r in s.mel_means(odd).collect()] == [(None, 1)]
    assert len(joined(s.filtered(odd))[None]) == 500
    r = spark.range(1).select(s.sigmoid(F.lit(0.0)).alias("a"), s.sigmoid(F.lit(1e9)).alias("b"), s.frame_count(F.lit(559)).alias("c"), s.padded(F.array(F.lit(1), F.lit(2)), F.lit(4)).alias("d"), s.frame_times(F.lit(10)).alias("e")).first()
    assert (r["a"], r["c"], r["d"], tuple(r["e"])) == (0.5, 1, [1, 2, 2, 2], (0.1, 0.11)) and r["b"] <= 1


@pytest.mark.parametrize("rate", [8000, 44_100, 48_000])
def test_resampling_keeps_tones_and_drops_what_does_not_fit(rate):
    t = np.arange(rate) / rate
    got = _resampled(np.sin(2 * np.pi * 440 * t), rate, 16_000)
    want = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert len(got) == 16_000 and np.abs(got - want)[200:-200].max() < 0.01
    if rate > 16_000:
        assert np.abs(_resampled(np.sin(2 * np.pi * 12_000 * t), rate, 16_000))[200:-200].max() < 0.05


def test_queries_handle_samples_in_batches(spark, small):
    """No sample is made or weighed by expressions of its own, and no row is a sample."""
    from parley.plans import sound as plans

    for name in ("mel_frames", "filtered_recordings"):
        plan = getattr(plans, name)(spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "unhex" not in plan and "conv(" not in plan and "RepartitionByExpression" in plan
    first = plans.recordings(spark, small).where("recording = 5 and seq = 1").first()["pcm"]
    assert np.frombuffer(first, "<i2").tolist() == [(k * 37 + 55) % 2001 - 1000 for k in range(700, 785)]


def test_no_piece_of_a_recording_is_broadcast(spark, small):
    """Lengths of pieces and means of recordings grow with the table, however small its file is estimated."""
    from parley.plans import sound as plans

    for df in (plans.mel_frames(spark, small), plans.filtered_recordings(spark, small), s.mel_features(plans.recordings(spark, small))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_utterances_stream_through_one_walk(spark):
    """No pandas group a recording, and null pieces are empty."""
    from parley.operators.live import utterances

    loud = np.tile(np.array([8000, -8000], "<i2"), 8000).tobytes()
    df = spark.createDataFrame([(1, 0, loud), (1, 1, None), (2, 0, None)], "recording long, seq int, pcm binary")
    found = utterances(df)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 0.0, 0.99)]
