"""Transcription and speaker quality: word errors, speaker errors over spans, optimal mapping of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from parley.functions.text import spoken_words
from parley.operators.common import parts_for
from parley.operators.timeline import merge_spans, overlap, range_join


def _distance(a: list[str], b: list[str]) -> int:
    """Fewest insertions, deletions and substitutions of words that turn one into the other; a row of the table at a time."""
    numbers: dict[str, int] = {}
    left, right = ([numbers.setdefault(w, len(numbers)) for w in words] for words in (a, b))
    other, steps = np.array(right, np.int64), np.arange(len(right) + 1)
    row = steps
    for k, word in enumerate(left, 1):
        kept = np.concatenate(([k], np.minimum(row[:-1] + (other != word), row[1:] + 1)))
        row = np.minimum.accumulate(kept - steps) + steps  # insertions from the left
    return int(row[-1])


@F.pandas_udf(T.LongType())
def word_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word edit distance of two word arrays."""
    return pd.Series([_distance(list(a), list(b)) for a, b in zip(reference, hypothesis)])


def word_errors(pairs: DataFrame) -> DataFrame:
    """pairs (reference, hypothesis) with errors, words (of the reference) and wer; an empty reference has a rate of 0 or 1."""
    reference, hypothesis = (F.coalesce(spoken_words(c), F.array().cast("array<string>")) for c in ("reference", "hypothesis"))
    counted = pairs.withColumns({"errors": word_distance(reference, hypothesis), "words": F.size(reference).cast("long")})
    return counted.withColumn("wer", F.when(F.col("words") > 0, F.col("errors") / F.col("words")).otherwise((F.col("errors") > 0).cast("double")))


def error_totals(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Summed errors and words, their rate, and audio seconds for each second of processing; the least rate first."""
    sums = measured.groupBy(*keys).agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"), F.sum("audio_s").alias("audio_s"), F.sum("processing_s").alias("processing_s"))
    rated = sums.withColumns({"wer": F.round(F.col("errors") / F.nullif("words", F.lit(0)), 4), "speed": F.round(F.col("audio_s") / F.nullif("processing_s", F.lit(0)), 2)})
    return rated.orderBy(F.asc_nulls_last("wer"), *keys)


# ---------------------------------------------------------------- speaker errors


def in_frames(spans: DataFrame, step: float = 0.01) -> DataFrame:
    """Spans with start and end as numbers of frames, to the nearest, half to even."""
    return spans.withColumns({c: F.greatest(F.bround(F.col(c) / step, 0).cast("long"), F.lit(0)) for c in ("start", "end")})


def collars(reference: DataFrame, keys: list[str], frames: int) -> DataFrame:
    """Merged spans around the borders of reference spans that are not scored."""
    edges = reference.select(*keys, F.explode(F.array("start", "end")).alias("at"))
    return merge_spans(edges.select(*keys, F.greatest(F.col("at") - frames, F.lit(0)).alias("start"), (F.col("at") + frames).alias("end")), keys, 0)


def speaker_overlap(reference: DataFrame, hypothesis: DataFrame, keys: list[str], masked: DataFrame, width: int, parts: int | None = None) -> DataFrame:
    """keys, reference, hypothesis, frames: how many scored frames each pair of labels shares.

    Both sides: keys, speaker, start, end, merged by speaker. What masked spans take from an intersection is counted off, so
    no frames are listed.
    """
    shared = range_join(reference.withColumnRenamed("speaker", "reference"), hypothesis.withColumnRenamed("speaker", "hypothesis"), keys, width, parts)
    shared = shared.select(*keys, "reference", "hypothesis", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
    lost = range_join(shared, masked, keys, width, parts).groupBy(*keys, "reference", "hypothesis").agg(F.sum(overlap()).alias("lost"))
    sums = shared.groupBy(*keys, "reference", "hypothesis").agg(F.sum(F.col("end") - F.col("start")).alias("all"))
    return sums.join(lost, [*keys, "reference", "hypothesis"], "left").select(*keys, "reference", "hypothesis", (F.col("all") - F.coalesce("lost", F.lit(0))).alias("frames")).where("frames > 0")


def _best_mapping(pairs: pd.DataFrame) -> list[bool]:
    """Which pairs belong to the one-to-one mapping of largest sum: shortest augmenting paths over the pairs.

    Costs are negative overlaps; labels may stay single. Each pass adds the best path from a free left label; with few
    labels a recording, Bellman-Ford over the pairs is enough.
    """
    left = pairs["reference"].tolist()
    right = pairs["hypothesis"].tolist()
    gain = pairs["frames"].tolist()
    match: dict = {}  # right label: index of its pair
    while True:
        worth: dict = {}  # by right label: best gain of a path that ends there, and the pair by which it came
        taken = {left[k]: right[k] for k in match.values()}
        changed = True
        while changed:
            changed = False
            for k, value in enumerate(gain):
                if match.get(right[k]) == k:
                    continue
                if left[k] in taken:
                    at = taken[left[k]]
                    if at not in worth:
                        continue
                    value += worth[at][0] - gain[match[at]]
                if value > worth.get(right[k], (0.0,))[0] + 1e-9:
                    worth[right[k]], changed = (value, k), True
        ends = [(v, r) for r, (v, _) in worth.items() if r not in match]
        if not ends:
            return [match.get(r) == k for k, r in enumerate(right)]
        at = max(ends, key=lambda e: (e[0], str(e[1])))[1]
        while at is not None:
            k = worth[at][1]
            before = taken.get(left[k])
            match[at] = k
            at = before


def map_speakers(shared: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of labels of the one-to-one mapping with most shared frames, by recording."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["reference", "hypothesis"], ignore_index=True)
        return group[_best_mapping(group)]

    return shared.groupBy(*keys).applyInPandas(run, shared.schema)


def frame_counts(reference: DataFrame, hypothesis: DataFrame, keys: list[str], masked: DataFrame, parts: int | None = None) -> DataFrame:
    """keys, total, missed, false_alarm, both: scored frames of reference speech, of speech missing from either side, and of
    the lesser number of speakers at a time. Counts change only where a span begins or ends, so sums run over those."""

    def edges(spans: DataFrame, name: str) -> DataFrame:
        return spans.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias(name)), F.struct(F.col("end").alias("at"), F.lit(-1).alias(name)))).alias("e")).select(*keys, "e.*")

    names = ("__r", "__h", "__m")
    steps = edges(reference, "__r").unionByName(edges(hypothesis, "__h"), True).unionByName(edges(masked, "__m"), True)
    steps = steps.repartition(parts, *keys) if parts else steps
    points = steps.groupBy(*keys, "at").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    order = W.partitionBy(*keys).orderBy("at")
    level = points.select(*keys, (F.lead("at").over(order) - F.col("at")).alias("frames"), *(F.sum(c).over(order.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in names))
    zero, r, h = F.lit(0), F.col("__r"), F.col("__h")
    scored = level.where("__m = 0 and frames > 0")
    return scored.groupBy(*keys).agg(
        F.sum(r * F.col("frames")).alias("total"),
        F.sum(F.greatest(zero, r - h) * F.col("frames")).alias("missed"),
        F.sum(F.greatest(zero, h - r) * F.col("frames")).alias("false_alarm"),
        F.sum(F.least(r, h) * F.col("frames")).alias("both"),
    )


def speaker_errors(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar: float = 0.25, step: float = 0.01, width: float = 60.0) -> DataFrame:
    """keys, total, missed, false_alarm, confusion (in frames of ``step``) and der of each recording.

    Both sides: keys, speaker, start, end in seconds. Frames within ``collar`` of a reference border are not scored. Rows are dealt into
    parts by their number, as a task sorts spans, borders and levels of all its recordings.
    """
    parts = parts_for(reference.count() + hypothesis.count())
    reference, hypothesis = (s.select(*keys, "speaker", "start", "end").repartition(parts, *keys) for s in (reference, hypothesis))
    sides = [merge_spans(in_frames(s, step), [*keys, "speaker"], 0) for s in (reference, hypothesis)]
    masked = collars(in_frames(reference.select(*keys, "start", "end"), step), keys, round(collar / step)) if round(collar / step) else sides[0].limit(0).drop("speaker")
    counts = frame_counts(*sides, keys, masked, parts)
    mapped = map_speakers(speaker_overlap(*sides, keys, masked, round(width / step), parts), keys).groupBy(*keys).agg(F.sum("frames").alias("correct"))
    joined = counts.join(mapped, keys, "left").withColumn("confusion", F.col("both") - F.coalesce("correct", F.lit(0)))
    wrong = F.col("missed") + F.col("false_alarm") + F.col("confusion")
    return joined.select(*keys, "total", "missed", "false_alarm", "confusion", F.when(F.col("total") > 0, wrong / F.col("total")).otherwise(0.0).alias("der"))


def speaker_error_total(errors: DataFrame) -> DataFrame:
    """One row for all recordings: the error rate of the summed parts."""
    sums = errors.agg(*(F.sum(c).alias(c) for c in ("total", "missed", "false_alarm", "confusion")))
    return sums.withColumn("der", (F.col("missed") + F.col("false_alarm") + F.col("confusion")) / F.nullif("total", F.lit(0)))
