"""Live transcripts: revisions of segments, human corrections, sessions of speech. Batch operators and kernels that the streaming
module shares."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from parley.functions.text import blank_to_null
from parley.operators.common import Walk, walked

#: Fixed values of the speech detector.
RATE, FRAME_S = 16_000, 0.03


def latest(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The row of highest ``rev`` for each key; a segment whose latest text is empty has been withdrawn and is left out.

    Rows are reduced before the exchange, so a segment with very many revisions is no burden. Arrival order does not matter.
    """
    rest = [c for c in segments.columns if c not in keys]
    newest = segments.groupBy(*keys).agg(F.max_by(F.struct(*rest), "rev").alias("row"))
    return newest.select(*keys, "row.*").where("text <> ''")


def since(segments: DataFrame, revision: int) -> DataFrame:
    """What changed after a revision."""
    return segments.where(F.col("rev") > revision)


def since_id(segments: DataFrame, last_id: int) -> DataFrame:
    """Finished segments behind an id, for readers that know no revisions."""
    return segments.where((F.col("id") > last_id) & ~F.col("partial"))


def apply_overrides(segments: DataFrame, overrides: DataFrame, names: DataFrame) -> DataFrame:
    """Segments (session, id, speaker_key, …) with ``speaker`` and ``corrected``: a person's word on the segment (overrides: session,
    id, name) comes before a name given to its voice (names: session, speaker_key, name), and that before the model's key."""
    joined = segments.join(overrides.withColumnRenamed("name", "__own"), ["session", "id"], "left").join(names.withColumnRenamed("name", "__voice"), ["session", "speaker_key"], "left")
    return joined.withColumns({"speaker": F.coalesce("__own", "__voice", "speaker_key"), "corrected": F.col("__own").isNotNull() | F.col("__voice").isNotNull()}).drop("__own", "__voice")


def check_edits(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """Edits (edit, session, id, rev, name) with ``verdict``: ok, missing, unfinished or changed (its revision is no longer the
    segment's). A null rev asks for no check."""
    now = segments.select("session", "id", F.col("rev").alias("__rev"), (F.col("partial") | blank_to_null("text").isNull()).alias("__open"))
    joined = edits.join(now, ["session", "id"], "left")
    verdict = F.when(F.col("__rev").isNull(), "missing").when(F.col("__open"), "unfinished").when(F.col("rev") != F.col("__rev"), "changed").otherwise("ok")
    return joined.withColumn("verdict", verdict).drop("__rev", "__open")


def sessions(events: DataFrame, keys: list[str], gap: str, time: str = "ts") -> DataFrame:
    """keys, start, end, n: activity with pauses shorter than ``gap``."""
    window = F.session_window(time, gap)
    return events.groupBy(*keys, window).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def known_or_new(voices: DataFrame, scores: DataFrame, keys: list[str], match: float, least: float, order: str = "vec_id") -> DataFrame:
    """keys, ``order``, speaker: the best-scoring person (scores: keys, ``order``, person, score) at or above ``match``, else the
    group of voices of this recording that the vector joins in order ('Speaker n')."""
    from parley.operators.voices import online_speakers

    best = scores.where(F.col("score") >= match).groupBy(*keys, order).agg(F.max_by("person", F.struct("score", "person")).alias("speaker"))
    unknown = voices.join(best.select(*keys, order), [*keys, order], "left_anti")
    return best.select(*keys, order, "speaker").unionByName(online_speakers(unknown, keys, least, order))


# ---------------------------------------------------------------- speech detection


@dataclass
class Detector:
    """State of one recording's speech detector: samples not yet a frame, the frame count, the noise floor, the utterance under way."""

    silence: float = 0.6
    longest: float = 12.0
    least: float = 0.4
    ratio: float = 3.0
    floor: float = 0.004
    lead: int = 6  # frames before an utterance that belong to it
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    frames: int = 0
    noise: float = 0.004
    begun: int = -1
    quiet: int = 0
    spoken: int = 0
    waiting: int = 0  # quiet frames since the last utterance, at most ``lead``

    def feed(self, samples: np.ndarray) -> list[tuple[float, float]]:
        """(start, end) in seconds of utterances that the samples complete. How they are cut into pieces makes no difference."""
        size = int(FRAME_S * RATE)
        self.rest = np.concatenate((self.rest, samples.astype(np.float32)))
        count = len(self.rest) // size
        levels = np.sqrt((self.rest[: count * size].reshape(count, size).astype(np.float32) ** 2).mean(axis=1)) + 1e-9
        self.rest = self.rest[count * size :]
        return [span for level in levels.tolist() if (span := self.step(level))]

    def step(self, level: float) -> tuple[float, float] | None:
        self.noise = 0.9 * self.noise + 0.1 * level if level < self.noise else self.noise * 1.002
        speech = level > max(self.floor, self.noise * self.ratio)
        at, self.frames = self.frames, self.frames + 1
        if self.begun < 0:
            if not speech:
                self.waiting = min(self.lead, self.waiting + 1)
                return None
            self.begun, self.waiting, self.quiet, self.spoken = at - self.waiting, 0, 0, 0
        self.quiet = 0 if speech else self.quiet + 1
        self.spoken += speech
        over = self.quiet * FRAME_S >= self.silence - 1e-9 or (self.frames - self.begun) * FRAME_S >= self.longest - 1e-9
        return self.close() if over else None

    def close(self) -> tuple[float, float] | None:
        """End the utterance under way; None if it has too little speech."""
        span = (round(self.begun * FRAME_S, 3), round(self.frames * FRAME_S, 3))
        enough = self.begun >= 0 and self.spoken * FRAME_S >= self.least - 1e-9
        self.begun = -1
        return span if enough else None


@dataclass
class _Speech(Walk):
    """A recording's pieces through its detector."""

    detector: Detector

    def row(self, raw: bytes | None) -> list[tuple]:
        return self.detector.feed(samples_of(raw or b""))

    def end(self) -> list[tuple]:
        last = self.detector.close()
        return [last] if last else []


def utterances(pcm: DataFrame, key: str = "recording", **settings) -> DataFrame:
    """key, start, end of the utterances in 16-bit mono samples (key, seq, pcm): pieces of a recording in order of seq; null pieces are empty.

    An odd byte at a piece's end is dropped. A recording's samples are walked in order by one task, which holds a batch of pieces and one
    detector.
    """
    shape = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
    return walked(pcm, [key], ["seq"], ["pcm"], lambda: _Speech(Detector(**settings)), shape)


def samples_of(raw: bytes) -> np.ndarray:
    """Samples from -1 to 1 of little-endian 16-bit values."""
    return np.frombuffer(raw, "<i2", len(raw) // 2).astype(np.float32) / 32768


def numbered(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with ``rev`` counted in order of arrival (seq)."""
    return segments.withColumn("rev", F.row_number().over(W.partitionBy(*keys).orderBy("seq")))
