"""Early results: what is still under way is told again and again under one id, until its final row replaces it. Walks that the streams in
``parley.streaming.early`` share, and their batch twins."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.common import Walk, walked
from parley.operators.live import FRAME_S, RATE, Detector, samples_of

#: What a control row may say: the recording is over and its open utterance counts, or nothing more of it is wanted.
FINISH, CANCEL = "finish", "cancel"

SPAN = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("partial", T.BooleanType()), T.StructField("pcm", T.BinaryType())])
SESSION = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n", T.LongType()), T.StructField("partial", T.BooleanType())])
LET_OUT = T.StructType([T.StructField("at", T.LongType()), T.StructField("item", T.LongType()), T.StructField("skipped", T.LongType())])


# ---------------------------------------------------------------- speech


@dataclass
class EarlySpeech(Detector, Walk):
    """One recording's utterances, with early rows: an open one that holds enough speech gets an id and is told each time it has grown
    by ``every`` seconds; the final row carries the same id. Of final rows of at least ``voiced`` seconds the samples are given too, cut
    from the last ``keep`` seconds, which are all that is kept of the sound."""

    silence: float = 0.45
    longest: float = 8.0
    every: float = 0.7
    voiced: float = 1.5
    keep: float = 12.0
    number: int = 0
    open: bool = False  # whether the utterance under way has been told under ``number``
    told: float = 0.0
    history: list[bytes] = field(default_factory=list)
    heard: int = 0  # bytes of sound so far
    over: bool = False

    def row(self, pcm: bytes | None, control: str | None) -> list[tuple]:
        out: list[tuple] = []
        if self.over:
            return out
        if pcm:
            pcm = pcm[: len(pcm) // 2 * 2]
            self.history.append(pcm)
            self.heard += len(pcm)
            out += self.feed(samples_of(pcm))
            self.trim()
        if control == FINISH:
            out += self.end()
        if control in (FINISH, CANCEL):
            self.over, self.begun, self.history, self.open = True, -1, [], False
        return out

    def feed(self, samples: np.ndarray) -> list[tuple]:
        size = int(FRAME_S * RATE)
        self.rest = np.concatenate((self.rest, samples.astype(np.float32)))
        count = len(self.rest) // size
        levels = np.sqrt((self.rest[: count * size].reshape(count, size) ** 2).mean(axis=1)) + 1e-9
        self.rest = self.rest[count * size :]
        out: list[tuple] = []
        for level in levels.tolist():
            was_open = self.begun >= 0
            if span := self.step(level):
                out.append(self.final(span))
            elif self.begun < 0:
                if was_open:
                    self.told = 0.0
            else:
                length = round((self.frames - self.begun) * FRAME_S, 6)
                if self.spoken * FRAME_S >= self.least - 1e-9 and length - self.told >= self.every - 1e-9:
                    if not self.open:
                        self.number, self.open = self.number + 1, True
                    self.told = length
                    out.append((self.number, round(self.begun * FRAME_S, 3), round(self.frames * FRAME_S, 3), True, None))
        return out

    def final(self, span: tuple[float, float]) -> tuple:
        if not self.open:
            self.number += 1
        self.open, self.told = False, 0.0
        pcm = None
        if span[1] - span[0] >= self.voiced - 1e-9:
            sound, first = b"".join(self.history), self.heard - sum(map(len, self.history))
            start, end = (2 * round(x * RATE) - first for x in span)
            pcm = sound[max(0, start) : end]
        return (self.number, *span, False, pcm)

    def trim(self) -> None:
        """Pieces are kept in blocks of at most a second; those that lie wholly before the last ``keep`` seconds go."""
        second, most = 2 * RATE, 2 * int(self.keep * RATE)
        sound = b"".join(self.history)[-most:]
        self.history = [sound[k : k + second] for k in range(0, len(sound), second)]

    def end(self) -> list[tuple]:
        span = None if self.over else self.close()
        return [self.final(span)] if span else []


def early_utterances(pcm: DataFrame, key: str = "recording", **settings) -> DataFrame:
    """key, id, start, end, partial, pcm of a table of pieces (key, seq, pcm, control), in order of seq; control is null, 'finish' or 'cancel'.

    Rows of one id follow each other; the one that is not partial is the last. A recording whose open utterance is cancelled has no final row
    for it. How the sound is cut into pieces makes no difference.
    """
    return walked(pcm, [key], ["seq"], ["pcm", "control"], partial(EarlySpeech, **settings), SPAN)


# ---------------------------------------------------------------- sessions


@dataclass
class EarlySessions(Walk):
    """Sessions of activity with early rows; times are microseconds. A session counts from ``least`` rows on."""

    gap: int
    every: int
    least: int = 2
    id: int = 0
    open: bool = False
    start: int = 0
    last: int = 0
    told: int = 0
    n: int = 0
    over: bool = False

    def row(self, at: int, control: str | None) -> list[tuple]:
        if self.over:
            return []
        if control is not None:
            out = self.end() if control == FINISH else []
            self.n, self.over = 0, True
            return out
        out = self.end() if self.n and at - self.last >= self.gap else []
        if not self.n:
            self.start = self.told = at
        self.last, self.n = at, self.n + 1
        if self.n >= self.least and at - self.told >= self.every:
            if not self.open:
                self.id, self.open = self.id + 1, True
            self.told = at
            out.append((self.id, self.start, at, self.n, True))
        return out

    def end(self) -> list[tuple]:
        out = []
        if self.n >= self.least:
            if not self.open:
                self.id += 1
            out.append((self.id, self.start, self.last, self.n, False))
        self.n, self.open = 0, False
        return out

    def waiting(self) -> bool:
        return self.n > 0


def micros(time: str):
    return F.unix_micros(F.col(time).cast("timestamp"))


def early_sessions(events: DataFrame, keys: list[str], gap: str, every: str, time: str = "ts", order: str = "event_id", least: int = 2) -> DataFrame:
    """keys, id, start, end, n, partial: sessions with pauses shorter than ``gap``, told each time they have grown by ``every``, and at their end.

    Times are microseconds; gap and every are intervals ('30 minutes'). Rows without a time are left out.
    """
    rows = events.select(*keys, micros(time).alias("w_at"), F.col(order).alias("w_order"), F.lit(None).cast("string").alias("w_control")).where("w_at is not null")
    return walked(rows, keys, ["w_at", "w_order"], ["w_at", "w_control"], partial(EarlySessions, interval(gap), interval(every), least), SESSION)


def interval(text: str) -> int:
    """Microseconds of '30 minutes' and the like."""
    number, unit = text.split()
    return round(float(number) * {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}[unit.rstrip("s")])


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a reader has after all rows: the last one of each id, final ones before early ones."""
    rest = [c for c in rows.columns if c not in (*keys, "id")]
    return rows.groupBy(*keys, "id").agg(F.max_by(F.struct(*rest), F.struct(~F.col("partial"), "end")).alias("__row")).select(*keys, "id", "__row.*")


# ---------------------------------------------------------------- letting out less


@dataclass
class Conflate(Walk):
    """Only the newest row that waits, at most once an ``interval`` (microseconds); the state is that one row."""

    interval: int
    last: int | None = None
    pending: int | None = None
    skipped: int = 0

    def row(self, at: int, item: int) -> list[tuple]:
        out = []
        if self.last is not None and at >= self.last + self.interval:
            out += self.end()
        if self.last is None or at >= self.last + self.interval:
            out.append((at, item, 0))
            self.last = at
        else:
            self.skipped += self.pending is not None
            self.pending = item
        return out

    def end(self) -> list[tuple]:
        if self.pending is None:
            return []
        self.last += self.interval
        told = (self.last, self.pending, self.skipped)
        self.pending, self.skipped = None, 0
        return [told]

    def waiting(self) -> bool:
        return self.pending is not None


@dataclass
class Shed(Walk):
    """Rows pass while the worker behind is free, for ``busy`` after each; others are dropped unless they must be kept, and those count on top."""

    busy: int
    free: int | None = None
    skipped: int = 0

    def row(self, at: int, item: int, must: bool | None) -> list[tuple]:
        if not must and self.free is not None and at < self.free:
            self.skipped += 1
            return []
        self.free = max(at, self.free or at) + self.busy
        told = (at, item, self.skipped)
        self.skipped = 0
        return [told]


def _timed(rows: DataFrame, keys: list[str], time: str, item: str, *more: str) -> DataFrame:
    return rows.select(*keys, micros(time).alias("w_at"), F.col(item).cast("long").alias("w_item"), *(F.col(c).alias(f"w_{c}") for c in more)).where("w_at is not null")


def conflated(rows: DataFrame, keys: list[str], every: str, time: str = "ts", item: str = "event_id") -> DataFrame:
    """keys, at, item, skipped: a key's first row at once; those that come within ``every`` of the last one let out wait, and when it is over
    the newest of them is let out alone, with the number of those that it replaced. Rows without a time are left out."""
    return walked(_timed(rows, keys, time, item), keys, ["w_at", "w_item"], ["w_at", "w_item"], partial(Conflate, interval(every)), LET_OUT)


def shed(rows: DataFrame, keys: list[str], busy: str, must: str, time: str = "ts", item: str = "event_id") -> DataFrame:
    """keys, at, item, skipped: rows for which a worker that takes ``busy`` for each is free, and all for which ``must`` holds; skipped
    counts those dropped since the last. Rows without a time are left out."""
    return walked(_timed(rows, keys, time, item, must), keys, ["w_at", "w_item"], ["w_at", "w_item", f"w_{must}"], partial(Shed, interval(busy)), LET_OUT)
