"""Streams of early results, on arbitrary state with processing-time timers. The batch twins are in ``parley.operators.early``.

Timers are looked after in batches, with data or without. A query with the trigger ``availableNow`` would therefore never end: for it
switch ``spark.sql.streaming.noDataMicroBatches.enabled`` off; what then still waits is in the checkpoint for the next run.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from parley.operators.common import Walk
from parley.operators.early import LET_OUT, SESSION, SPAN, Conflate, EarlySessions, EarlySpeech, Shed, _timed, interval, micros
from parley.operators.sound import DELAY, PIECES, Filter, low_pass

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class WalkProcessor(StatefulProcessor):
    """A ``Walk`` for each key as its state; what its rows tell goes out at once.

    A timer lets out what the walk holds back after ``idle_ms`` without rows. With ``forget``, the state goes then too, and at once
    when the walk is over; all state has a time to live of ten times that, for keys that are never heard of again.
    """

    def __init__(self, start: Callable[[], Walk], order: list[str], columns: list[str], schema: T.StructType, idle_ms: int, forget: bool):
        self.start, self.order, self.columns, self.schema, self.idle_ms, self.forget = start, order, columns, schema, idle_ms, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("walk", "walk binary", 10 * self.idle_ms)

    def _told(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        table = {f.name: [(*key, *r)[k] for r in rows] for k, f in enumerate(self.schema.fields)}
        types = {f.name: pd.ArrowDtype(a.type) for f, a in zip(self.schema.fields, to_arrow_schema(self.schema))}
        return pd.DataFrame({c: pd.array(v, dtype=types[c]) for c, v in table.items()})

    def _held(self) -> tuple[Walk, int, bool]:
        """The walk, when its key was last heard of, and whether a timer is set."""
        return pickle.loads(self.state.get()[0]) if self.state.exists() else (self.start(), 0, False)

    def _keep(self, walk: Walk, heard: int, timer: bool, now: int) -> None:
        """State goes back, and one timer at most is set for a key, however often it is heard of."""
        if not timer and (self.forget or walk.waiting()):
            self.handle.registerTimer(now + self.idle_ms)
            timer = True
        self.state.update((pickle.dumps((walk, heard, timer)),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        walk, _, timer = self._held()
        told: list[tuple] = []
        whole = pd.concat(list(rows)).sort_values(self.order)
        for values in zip(*(whole[c].astype(object).where(whole[c].notna(), None) for c in self.columns)):
            told += walk.row(*values)
        if self.forget and getattr(walk, "over", False):
            self.state.clear()
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            self._keep(walk, now, timer, now)
        if told:
            yield self._told(key, told)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():  # the walk was over before
            return
        (walk, heard, _), now = self._held(), timerValues.getCurrentProcessingTimeInMs()
        if self.forget and now < heard + self.idle_ms:
            self._keep(walk, heard, False, heard)  # it has been heard of since
            return
        told = walk.end()
        if self.forget:
            self.state.clear()
        else:
            self._keep(walk, heard, False, now)
        if told:
            yield self._told(key, told)

    def close(self) -> None: ...


def _stream(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Walk], schema: T.StructType, idle_ms: int, forget: bool) -> DataFrame:
    if "RocksDB" not in rows.sparkSession.conf.get(PROVIDER):
        raise ValueError(f"{PROVIDER} must name the RocksDB provider: timers and state with a time to live need it")
    whole = T.StructType([*(rows.schema[k] for k in keys), *schema.fields])
    return rows.groupBy(*keys).transformWithStateInPandas(WalkProcessor(start, order, columns, whole, idle_ms, forget), whole, "update", "processingTime")


def early_utterance_stream(pcm: DataFrame, key: str = "recording", idle_ms: int = 3_600_000, **settings) -> DataFrame:
    """key, id, start, end, partial, pcm from a stream of pieces (key, seq, pcm, control), in update mode: a row replaces those of its id.

    A control row 'finish' ends a recording and tells its open utterance, 'cancel' ends it and drops that; so does silence of ``idle_ms``
    like 'finish'. Then the state goes. Until then it is the detector and the last 12 seconds of sound, however long the recording.
    Within a micro-batch pieces are ordered by seq.
    """
    return _stream(pcm.select(key, "seq", "pcm", "control"), [key], ["seq"], ["pcm", "control"], partial(EarlySpeech, **settings), SPAN, idle_ms, True)


def early_session_stream(events: DataFrame, keys: list[str], gap: str, every: str, time: str = "ts", order: str = "event_id", control: str | None = None, least: int = 2, idle_ms: int = 3_600_000) -> DataFrame:
    """keys, id, start, end, n, partial in update mode; a row with ``control`` ends a key. State: one open session a key."""
    told = F.lit(None).cast("string") if control is None else F.col(control)
    rows = events.select(*keys, micros(time).alias("w_at"), F.col(order).alias("w_order"), told.alias("w_control"))
    return _stream(rows, keys, ["w_at", "w_order"], ["w_at", "w_control"], partial(EarlySessions, interval(gap), interval(every), least), SESSION, idle_ms, True)


def conflated_stream(rows: DataFrame, keys: list[str], every: str, time: str = "ts", item: str = "event_id") -> DataFrame:
    """keys, at, item, skipped: the newest row that waits, once an interval; a timer lets it out if no row follows. State: one row a key."""
    return _stream(_timed(rows, keys, time, item), keys, ["w_at", "w_item"], ["w_at", "w_item"], partial(Conflate, interval(every)), LET_OUT, max(1, interval(every) // 1000), False)


def shed_stream(rows: DataFrame, keys: list[str], busy: str, must: str, time: str = "ts", item: str = "event_id") -> DataFrame:
    """keys, at, item, skipped: what a worker has the time for, and what must be kept. State: a time and a count a key."""
    return _stream(_timed(rows, keys, time, item, must), keys, ["w_at", "w_item"], ["w_at", "w_item", f"w_{must}"], partial(Shed, interval(busy)), LET_OUT, 3_600_000, False)


def filter_stream(pcm: DataFrame, key: str = "recording", taps: np.ndarray | None = None, delay: int = DELAY, strength: float = 0.5, idle_ms: int = 3_600_000) -> DataFrame:
    """key, at, pcm: sound filtered as it comes (key, seq, pcm, control), on its own time line. State: what the taps and the delay still reach.

    'finish' drains it, 'cancel' drops it, and ``idle_ms`` without a piece is like 'finish'.
    """
    taps = low_pass() if taps is None else np.asarray(taps, float)
    return _stream(pcm.select(key, "seq", "pcm", "control"), [key], ["seq"], ["pcm", "control"], partial(Filter, taps=taps, delay=delay, strength=strength), PIECES, idle_ms, True)
