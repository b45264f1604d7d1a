"""Live transcripts as streams. Each operator has a batch twin in ``parley.operators.live``."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.live import Detector, latest, samples_of
from parley.sources.tables import snapshot, upsert_by_key


def utterance_stream(pcm: DataFrame, idle_ms: int = 3_600_000, **settings) -> DataFrame:
    """recording, start, end of utterances as they complete, from a stream of (recording, seq, pcm, last).

    The detector's state is kept by recording; a row with ``last`` ends it, and so does a recording that has sent nothing for ``idle_ms``;
    then its state goes. Within a micro-batch pieces are ordered by seq.
    """

    def run(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = pickle.loads(state.get[0]) if state.exists else Detector(**settings)
        found, ended = [], state.hasTimedOut
        if not ended:
            batch = pd.concat(pieces).sort_values("seq")
            for raw in batch["pcm"]:
                found += detector.feed(samples_of(raw))
            ended = bool(batch["last"].any())
        if ended:
            if span := detector.close():
                found.append(span)
            state.remove()
        else:
            state.update((pickle.dumps(detector),))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"recording": [key[0]] * len(found), "start": [a for a, _ in found], "end": [b for _, b in found]})

    return pcm.groupBy("recording").applyInPandasWithState(run, "recording string, start double, end double", "detector binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_stream(events: DataFrame, keys: list[str], gap: str, delay: str, time: str = "ts") -> DataFrame:
    """keys, start, end, n of sessions that no event within ``delay`` can extend any more."""
    held = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    counted = held.groupBy(*keys, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_stream(events: DataFrame, keys: list[str], delay: str, time: str = "ts") -> DataFrame:
    """Events without those whose keys came before, within ``delay``."""
    held = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return held.dropDuplicatesWithinWatermark(keys)


def upsert_stream(segments: DataFrame, keys: list[str], table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the table at ``table`` at each segment's latest revision.

    Each micro-batch is merged with those parts of the table that its keys fall into, and only these are written anew; a batch that is run
    again, or rows that come late, change nothing. Withdrawn segments are kept until the table is read with ``latest``.
    """

    def merge(batch: DataFrame, _: int) -> None:
        upsert_by_key(batch, table, keys, "rev")

    return segments.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_upserted(spark, table: str, keys: list[str]) -> DataFrame:
    return latest(snapshot(spark, table), keys)
