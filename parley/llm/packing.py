"""Best-fit packing into bins of several permitted sizes, planned on the histogram of exact token counts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import durable, map_arrow, slices, table, vocabulary_path, whole_text
from parley.llm.token_counts import GAPS, MEMO, Counter

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096)

#: What a sequence costs besides its places: a fixed sum, and attention, as many places as its length is to SPAN, for each of its places.
OPENING, SPAN = 32, 8192


@dataclass
class Plan:
    """segments: pieces of one length, by rank, and the bins they go to; bins: runs of bins with equal contents."""

    segments: list[tuple[int, int, int, int, int, int]]
    bins: list[tuple[int, int, int, int]]

    def cost(self, opening: int = OPENING, span: int = SPAN) -> float:
        return sum((b - a) * cost(capacity, opening, span) for a, b, capacity, _ in self.bins)


def cost(capacity: int, opening: int = OPENING, span: int = SPAN) -> float:
    return opening + capacity + capacity * capacity / span


class Outlook:
    """The pieces that no opened bin is expected to hold yet, by length."""

    def __init__(self, histogram: dict[int, int]):
        self.count, self.lengths = dict(histogram), sorted(histogram)

    def take(self, length: int, times: int) -> None:
        self.count[length] -= times
        if self.count[length] <= 0 and (k := bisect_left(self.lengths, length)) < len(self.lengths) and self.lengths[k] == length:
            del self.lengths[k]

    def filling(self, length: int, waiting: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
        """What a new bin for ``length`` will likely hold: as many of that length as fit, then the longest others that still fit."""
        times = min(capacity // length, waiting)
        room, content = capacity - times * length, [(length, times)]
        k = bisect_right(self.lengths, min(room, length - 1)) - 1
        while k >= 0:
            shorter = self.lengths[k]
            times = min(self.count[shorter], room // shorter)
            room -= times * shorter
            content.append((shorter, times))
            k = bisect_right(self.lengths, room, 0, k) - 1
        return capacity - room, content


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING, span: int = SPAN) -> Plan:
    """The cheapest of the plans that open sizes of one subset of the permitted ones each; every subset has the largest size."""
    *smaller, largest = sorted(capacities)
    subsets = [(*some, largest) for n in range(len(smaller), -1, -1) for some in combinations(smaller, n)]
    return min((best_fit(histogram, some, tuple(sorted(capacities)), opening, span) for some in subsets), key=lambda p: p.cost(opening, span))


def best_fit(histogram: dict[int, int], opened: tuple[int, ...], capacities: tuple[int, ...], opening: int, span: int) -> Plan:
    """Best-fit decreasing over all pieces at once, for lengths of 1 to the largest capacity.

    Pieces of one length are alike, and so are bins with equal contents; both are kept as runs, so the work grows with
    the number of lengths and not with the number of pieces. Each piece goes to the open bin that it leaves the
    least room in. If it fits in none, a size of ``opened`` is opened: the one that costs least for each place that the lengths
    still open are expected to fill, counted at the size it will shrink to. As many bins are opened together as those lengths
    can fill alike. In the end each bin takes the smallest permitted size that holds its contents.

    A segment is (length, first rank, end rank, pieces a bin, first bin, offset in the bin); a run of bins is (first bin,
    end bin, capacity, filled).
    """
    rooms: list[int] = []  # of open runs, sorted
    runs: dict[int, list[tuple[int, int, int]]] = {}  # by room: first bin, end bin, capacity

    def put(room: int, first: int, end: int, capacity: int) -> None:
        if end > first:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, end, capacity))

    segments, bins, outlook = [], 0, Outlook(histogram)
    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        outlook.take(length, outlook.count[length])
        while rank < count:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                choices = []
                for capacity in opened:
                    if capacity >= length:
                        filled, content = outlook.filling(length, count - rank, capacity)
                        shrunk = capacities[bisect_left(capacities, filled)]
                        choices.append((cost(shrunk, opening, span) / filled, capacity, content))
                _, capacity, content = min(choices, key=lambda x: x[:2])
                (_, each), *others = content
                needed = min([-(-(count - rank) // each), *(outlook.count[n] // t for n, t in others)])
                for n, t in others:
                    outlook.take(n, t * needed)
                put(capacity, bins, bins + needed, capacity)
                bins += needed
                continue
            room = rooms[k]
            first, end, capacity = runs[room].pop()
            if not runs[room]:
                del runs[room]
                rooms.pop(k)
            each, waiting = room // length, count - rank
            full = min(end - first, waiting // each)
            if full:
                segments.append((length, rank, rank + full * each, each, first, capacity - room))
                put(room - each * length, first, first + full, capacity)
                rank, first = rank + full * each, first + full
            elif first < end:
                segments.append((length, rank, count, waiting, first, capacity - room))
                put(room - waiting * length, first, first + 1, capacity)
                rank, first = count, first + 1
            put(room, first, end, capacity)
    packed = sorted((a, b, capacity, capacity - room) for room, found in runs.items() for a, b, capacity in found)
    return Plan(segments, [(a, b, capacities[bisect_left(capacities, filled)], filled) for a, b, _, filled in packed])


def cut_text(counter: Counter, text: str, largest: int) -> list[tuple[int, int, int]]:
    """Pieces of a text as (first character, end, length), each of ``largest`` tokens at most with the end token that follows it.

    A text that fits is one piece. Others are cut between words; a word that is too long by itself is cut inside, and then its
    parts are counted as they will be tokenized, each by itself.
    """
    limit = largest - 1
    if len(text) <= 4 * limit or len(text) // 2 < limit:
        total = counter.text(text)
        if total <= limit:
            return [(0, len(text), total + 1)]
    if (cut := cut_between_words(counter, text, limit)) is not None:
        return cut
    found: list[tuple[int, int, int]] = []
    first = end = tokens = 0

    def flush() -> None:
        if tokens:
            found.append((first, end, tokens + 1))

    at = 0
    for gap in [*(m.span() for m in GAPS.finditer(text)), (len(text), len(text))]:
        begin, stop = at, gap[0]
        at = gap[1]
        if begin == stop:
            continue
        while stop - begin > 4 * limit or (count := counter.words[text[begin:stop]]) > limit:
            flush()
            tokens, size = 0, min(limit, stop - begin)
            while (part := counter.text(text[begin : begin + size])) > limit:
                size = max(1, int(size * limit / part * 0.9))
            found.append((begin, begin + size, part + 1))
            begin += size
        if tokens + count > limit:
            flush()
            tokens = 0
        if not tokens:
            first = begin
        tokens, end = tokens + count, stop
    flush()
    return found or [(0, len(text), 1)]


@cache
def white_table() -> np.ndarray:
    """Whether a character is white space, by its number; the last place stands for all beyond."""
    return np.array([GAPS.fullmatch(chr(k)) is not None for k in range(0x3002)])


def cut_between_words(counter: Counter, text: str, limit: int) -> list[tuple[int, int, int]] | None:
    """The same pieces where each word fits into one and has tokens, from sums over all words at once; else None."""
    white = white_table()[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x3001)]
    edges = np.flatnonzero(np.diff(white, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    words = counter.split(text)
    if len(words) != len(starts) or not words or int((ends - starts).max()) > 4 * limit:
        return None
    counts = np.fromiter(map(counter.words.__getitem__, words), np.int64, len(words))
    if counts.min() < 1 or counts.max() > limit:
        return None
    sums, found, k = np.concatenate(([0], np.cumsum(counts))), [], 0
    while k < len(words):
        after = int(np.searchsorted(sums, sums[k] + limit, "right")) - 1
        found.append((int(starts[k]), int(ends[after - 1]), int(sums[after] - sums[k]) + 1))
        k = after
    return found


def text_pieces(df: DataFrame, path: str, largest: int, id_column: str = "doc_id", text_column: str = "text", memo: int = MEMO) -> DataFrame:
    """doc_id, row_key, piece, first_char, end_char and piece_length for the pieces of each row's text; a null or empty text is
    one piece, its end token. ``row_key`` is a hash of id and text."""
    fields = [("doc_id", pa.int64()), ("row_key", pa.int64()), ("row_id", pa.int64())]
    schema = pa.schema(fields + [("piece", pa.int32()), ("first_char", pa.int64()), ("end_char", pa.int64()), ("piece_length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of_worker(path, memo)
        for batch in slices(batches, "text", 4 << 20):
            rows, texts = [], batch.column("text").to_pylist()
            for *keys, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "row_id")), texts):
                rows += [(*keys, k, *piece) for k, piece in enumerate(cut_text(counter, text, largest))]
            if rows:
                yield table(schema, *zip(*rows, strict=True))
            counter.trim(texts)
        counter.done()

    text = whole_text(text_column)
    key = F.xxhash64(F.coalesce(F.col(id_column).cast("long"), F.lit(-1)), text)
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), key.alias("row_key"), F.monotonically_increasing_id().alias("row_id"), text.alias("text"))
    return map_arrow(rows, run, "doc_id long, row_key long, row_id long, piece int, first_char long, end_char long, piece_length int")


def pieces(rows: DataFrame, largest: int) -> DataFrame:
    """Rows with piece and piece_length: whole, or cut into pieces of the largest capacity and a rest."""
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / largest).cast("int") - 1, F.lit(0)))
    cut = rows.withColumn("piece", F.explode(numbers))
    return cut.withColumn("piece_length", F.least(F.lit(largest), F.col("length") - F.col("piece") * largest).cast("int"))


def pack(df: DataFrame, length: Column, id_column: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING, span: int = SPAN, rows_per_part: int = 50_000) -> DataFrame:
    """One row for each piece of each row of ``df``: doc_id, piece, length, bin, capacity, filled, at.

    Rows longer than the largest capacity are cut; a length of null or below 1 counts as 1, so every row has a place.
    Repeated rows and null ids are packed like others; an empty table gives none. See ``place_pieces``.
    """
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(1)), F.lit(1)).alias("length"), F.monotonically_increasing_id().alias("row_id"))
    cut = pieces(rows, max(capacities)).select("doc_id", "piece", "piece_length", F.xxhash64("row_id", "piece").alias("tie"))
    return place_pieces(durable(cut), capacities, opening, span, rows_per_part)


def pack_texts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING, span: int = SPAN, rows_per_part: int = 50_000, keep: bool = False, memo: int = MEMO, broadcast_rows: int = 300_000) -> DataFrame:
    """One row for each piece of each row's text: doc_id, piece, first_char, end_char, length, bin, capacity, filled, at and, if
    ``keep``, the piece's text.

    ``length`` is the piece's exact number of tokens in the vocabulary at ``path`` and one for the end token behind it; the piece is the text's
    characters from ``first_char`` to before ``end_char``. Texts longer than the largest capacity are cut between words, longer words
    inside. Null and empty texts are an end token; repeated rows and null ids are packed like others; other columns are not read.
    """
    cut = durable(text_pieces(df, path, max(capacities), id_column, text_column, memo).withColumn("tie", F.xxhash64("row_id", "piece")).drop("row_id"))
    packed = place_pieces(cut, capacities, opening, span, rows_per_part)
    if keep:
        key = F.xxhash64(F.coalesce(F.col(id_column).cast("long"), F.lit(-1)), whole_text(text_column))
        texts = df.select(key.alias("row_key"), F.coalesce(F.col(id_column).cast("long"), F.lit(-1)).alias("id"), whole_text(text_column).alias("text"))
        packed = packed.withColumn("id", F.coalesce("doc_id", F.lit(-1)))
        rows, distinct = cut.agg(F.count("*"), F.count_distinct("row_key", "piece")).first()
        if rows == distinct and rows <= broadcast_rows:
            packed = texts.join(F.broadcast(packed), ["row_key", "id"]).select(*packed.columns, "text").drop("id")
        else:  # rows of one id and text have the same pieces, so one text for each key is enough
            packed = packed.join(texts.groupBy("row_key", "id").agg(F.first("text").alias("text")), ["row_key", "id"]).drop("id")
        packed = packed.withColumn("text", F.substr("text", (F.col("first_char") + 1).cast("int"), (F.col("end_char") - F.col("first_char")).cast("int")))
    return packed.drop("row_key")


def place_pieces(cut: DataFrame, capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING, span: int = SPAN, rows_per_part: int = 50_000) -> DataFrame:
    """The rows of ``cut`` (doc_id, piece, piece_length, tie and others; stored, as it is read several times) with length, bin, capacity, filled and at.

    ``at`` is where the piece begins in its bin, ``filled`` what the bin holds. Only the count of pieces of each
    length comes to the driver, at most as many numbers as the largest capacity; the plan made of it is as small and is
    joined back by length and rank.
    """
    others = [c for c in cut.columns if c not in ("doc_id", "piece", "piece_length", "tie")]
    histogram = {r["piece_length"]: r["count"] for r in cut.groupBy("piece_length").count().collect()}
    made = plan(histogram, capacities, opening, span)
    spark = cut.sparkSession
    segments = spark.createDataFrame(made.segments, "piece_length int, low long, high long, each long, first long, start int")
    bins = spark.createDataFrame(made.bins, "bin_low long, bin_high long, capacity int, filled int")
    # Ranks within a length: ranks within parts of it, moved up by the parts before. A frequent length has more parts.
    spread = spark.createDataFrame([(k, -(-n // rows_per_part)) for k, n in histogram.items()], "piece_length int, parts long")
    parted = cut.join(F.broadcast(spread), "piece_length").withColumn("part", F.pmod("tie", F.col("parts")))
    counts = parted.groupBy("piece_length", "part").count()
    before = W.partitionBy("piece_length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("piece_length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("piece_length", "part").orderBy("tie", "doc_id", "piece"))
    ranked = parted.withColumn("own", rank).join(starts, ["piece_length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    placed = ranked.join(F.broadcast(segments), (ranked["piece_length"] == segments["piece_length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(segments["piece_length"])
    offset = F.col("rank") - F.col("low")
    placed = placed.withColumn("bin", F.col("first") + F.floor(offset / F.col("each"))).withColumn("at", (F.col("start") + offset % F.col("each") * F.col("piece_length")).cast("int"))
    # Runs of bins are found by the last run that begins at or below the bin; grains of bins keep that an equi-join.
    grain = max(1, (made.bins[-1][1] if made.bins else 1) // 1024)
    grains = bins.withColumn("grain", F.explode(F.sequence(F.floor(F.col("bin_low") / grain), F.floor((F.col("bin_high") - 1) / grain))))
    sized = placed.withColumn("grain", F.floor(F.col("bin") / grain)).join(F.broadcast(grains), "grain").where((F.col("bin") >= F.col("bin_low")) & (F.col("bin") < F.col("bin_high")))
    return sized.select("doc_id", "piece", *others, F.col("piece_length").alias("length"), F.col("bin").cast("long").alias("bin"), "capacity", "filled", "at")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"))
