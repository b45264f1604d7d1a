"""Exact Jaccard self-join on word shingles: signatures find blocks, T-occurrence search over inverted lists finds links.

A signature is something that two linked sets are bound to share. All sets that share one go to the block of the least of them,
so every link lies within a block, and no pairs are listed to find blocks. In each block the search is exact.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import durable, hashed_words, hot_join, map_arrow, mixed, raw_texts, shingle_hashes, signed, slices, table, whole_text
from parley.llm.components import components

#: Shingles of the sets in one task of the search; larger candidate groups are cut into tasks of this size.
BLOCK = 600_000

#: Sets below this size share a rare shingle as signature, larger ones the contents of a range of hashes.
SMALL = 48

#: Most shingles that are told to every task as frequent, and how often one must at least be seen.
FREQUENT, SEEN = 1_000_000, 30

#: How much dearer a probe of a long list is than a step of the merge (fixed value of the published method).
PROBE = 0.0085

#: Long lists that are probed in one round, and probes up to which a round takes more lists.
PROBED, PROBES = 64, 2048

#: A list that one in so many members of a block are in is kept as bits too, which takes at most the array's 64 bits for each place.
MAPPED = 64

#: Bytes of texts whose words are hashed at once; arrays of about this size stay in a core's cache.
TOGETHER = 1 << 19


# ---------------------------------------------------------------- sets and signatures


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Distinct shingles of each text, as sorted 64-bit hashes; words and shingles are hashed for about TOGETHER bytes of texts at once."""
    found, first, size = [], 0, 0
    for k, raw in enumerate(texts):
        if size and size + len(raw) > TOGETHER:
            found += _shingle_sets(texts[first:k], width)
            first, size = k, 0
        size += len(raw) + 1
    return found + _shingle_sets(texts[first:], width) if first < len(texts) else found


def _shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    words, bounds = hashed_words(texts)
    runs, found = shingle_hashes(words, width), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = np.sort(runs[a : b - width + 1] if b - a >= width else shingle_hashes(words[a:b], width))
        found.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
    return found


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """Equal sets have equal names; 0 is the empty set's."""
    sizes = np.array([len(x) for x in sets], np.int64)
    names, some = np.zeros(len(sets), np.uint64), sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mixed(np.concatenate(sets), 1), starts) + sizes[some].astype(np.uint64)
        names[some] = mixed(total, 2) | np.uint64(1)
    return names


@cache
def size_classes(percent: int) -> np.ndarray:
    """Smallest set size of each class. In the first class only equal sets can link; the second ends at SMALL."""
    starts, largest = [1], 1
    while differences(largest + 1, percent) == 0:
        largest += 1
    starts.append(largest + 1)
    low = max(SMALL, largest + 2)
    while low < 1 << 40:
        starts.append(low)
        low = low * 3 // 2
    return np.array(starts)


def differences(size: int, percent: int) -> int:
    """Most shingles by which two linked sets of at most ``size`` shingles differ, both ways together."""
    return 2 * size * (100 - percent) // (100 + percent)


@cache
def parts(kind: int, percent: int) -> tuple[np.ndarray, int]:
    """Borders of the parts into which a class cuts the range of hashes, and how many parts each set leaves out."""
    most = differences(int(size_classes(percent)[kind + 1]) - 1, percent)
    spare = 4 + (most + 1) // 5
    count = most + 1 + spare
    return np.array([k * (1 << 64) // count for k in range(1, count)], np.uint64), spare


def signatures(shingles: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """Hashes of which two linked sets that differ share at least one.

    Small sets: the first shingles in an order in which ``frequent`` ones come last. Two linked sets share so many that
    the first one shared is among the first size - needed + 1 of both.
    Others: two linked sets whose larger one is in a class differ by fewer shingles than the class has parts, not counting ``spare``
    of them; so more than ``spare`` parts agree. Each set leaves out ``spare`` parts, those with the fewest shingles that aren't
    frequent, in an order that depends on contents alone: the last of the agreeing parts is left out by neither.
    A set also joins the class above if a linked larger set can be there.
    """
    starts, size, found = size_classes(percent), len(shingles), []
    own = int(np.searchsorted(starts, size, "right")) - 1
    above = int(np.searchsorted(starts, size * 100 // percent, "right")) - 1
    if above < 1:
        return np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(frequent, shingles), max(0, len(frequent) - 1))
    rare = frequent[at] != shingles if len(frequent) else np.ones(size, bool)
    if own <= 1:
        first = np.concatenate((shingles[rare], shingles[~rare]))[: size - -(-size * percent // 100) + 1]
        found.append(mixed(first, 7))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(shingles, 3), dtype=np.uint64)))
        rares = np.concatenate(([0], np.cumsum(rare)))
        for kind in range(max(own, 2), above + 1):
            borders, spare = parts(kind, percent)
            ends = np.concatenate(([0], np.searchsorted(shingles, borders), [size]))
            content = sums[ends[1:]] - sums[ends[:-1]]
            marks = mixed(mixed(content, 4) + np.arange(len(content), dtype=np.uint64) + np.uint64(kind << 40), 5)
            few, all_of = (np.minimum(x, 255).astype(np.uint64) for x in (rares[ends[1:]] - rares[ends[:-1]], np.diff(ends)))
            rank = few << np.uint64(56) | all_of << np.uint64(48) | marks >> np.uint64(16)
            found.append(marks[np.argpartition(rank, spare)[spare:]])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """row_key (hash of id and text), doc_id, n_shingles and the set's name for each row.

    Rows without row_key are statistics: set_id is a shingle that a batch has in three sets or more, n_shingles in how many.
    """
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(raw_texts(batch.column("text")), width)
            yield table(schema, batch.column("row_key"), batch.column("doc_id"), [len(x) for x in sets], signed(set_names(sets)))
            if sets:
                shingles, counts = np.unique(np.concatenate(sets), return_counts=True)
                often = counts >= 3
                blank = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([blank, blank, pa.array(counts[often]), pa.array(signed(shingles[often]))], schema=schema)

    return map_arrow(docs, run, "row_key long, doc_id long, n_shingles long, set_id long")


def frequent_shingles(seen: DataFrame, total: int) -> np.ndarray:
    """The shingles seen most often, sorted. Their number is bounded: no more than FREQUENT can reach that share of ``total``.

    They only order what signatures are made of; links do not depend on them.
    """
    counts = seen.groupBy("set_id").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= max(SEEN, total // FREQUENT))
    return np.sort(counts.select("set_id").toPandas()["set_id"].to_numpy(np.int64).view(np.uint64))


def blocks(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(id, group): the sets (by name) of each block. A signature's sets are in the block of the least of them.

    Within a batch, only the first set of a signature goes on to find the least one of all; the others learn it
    from the signature afterwards. So a signature that very many sets have is one row a batch.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("key", pa.int64()), ("signature", pa.int64()), ("id", pa.int64()), ("role", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for batch in slices(batches, "text"):
            sets = shingle_sets(raw_texts(batch.column("text")), width)
            found = [signatures(x, percent, frequent) for x in sets]
            if not any(map(len, found)):
                continue
            marks, ids = np.concatenate(found), np.repeat(signed(set_names(sets)), [len(x) for x in found])
            order = np.lexsort((ids, marks))
            marks, ids = marks[order], ids[order]
            fresh = np.concatenate(([True], (marks[1:] != marks[:-1]) | (ids[1:] != ids[:-1])))  # without repeated sets
            marks, ids = marks[fresh], ids[fresh]
            first = np.concatenate(([True], marks[1:] != marks[:-1]))
            alone = np.concatenate((first[1:], [True]))
            # Role 0: a signature's only set in this batch, 1: its first, 2: one that follows; those get keys of their own.
            role = np.where(first, np.where(alone, 0, 1), 2).astype(np.int8)
            key = np.where(first, marks, mixed(marks ^ ids.view(np.uint64), 6))
            # A set's rows in a row, and no signature where the key is the same: shuffle files are half as large.
            order = np.argsort(ids, kind="stable")
            yield table(schema, signed(key)[order], pa.array(signed(marks)[order], mask=first[order]), ids[order], role[order])

    rows = map_arrow(docs.select("text"), run, "key long, signature long, id long, role byte")
    least = F.min(F.when(F.col("role") < 2, F.col("id"))).over(W.partitionBy("key"))
    shared = durable(rows.withColumn("group", least).where("role > 0 or id <> group").select(F.coalesce("signature", "key").alias("signature"), "id", "role", "group"))
    hubs = shared.where("role = 1").select("signature", "group").distinct()
    led = shared.where("role < 2").select("id", "group")
    following = shared.where("role = 2").select("signature", "id").join(hubs, "signature").select("id", "group")
    members = led.union(following).where("id <> group").distinct()
    return members.union(members.select(F.col("group").alias("id"), "group").distinct())


# ---------------------------------------------------------------- T-occurrence search


class Inverted:
    """Inverted lists of a block in one array of shingle << 32 | member, sorted as a whole.

    Each list has room for all members that will ever be added; free places hold a number above every member, so the array
    stays sorted while members are added in growing order, and any list can be probed by bisection. Lists with room for at least one
    in MAPPED of the block's ``members`` are kept as bits too, a row for each member: these take no more bytes than the array, and a
    member is probed for all of them by counting the bits that its row shares with the query's.
    """

    def __init__(self, room: np.ndarray, members: int | None = None):
        self.start = np.concatenate(([0], np.cumsum(room)))[:-1]
        self.size = np.zeros(len(room), np.int64)
        self.most = 0
        self.keys = np.repeat(np.arange(len(room), dtype=np.int64) << 32 | 0xFFFFFFFF, room)
        mapped = room * MAPPED >= (room.max(initial=0) if members is None else members)
        self.columns = np.where(mapped, np.cumsum(mapped) - 1, -1)
        self.rows = np.zeros((members or 1, -(-int(mapped.sum()) // 64)), np.uint64)

    def bits(self, shingles: np.ndarray) -> np.ndarray:
        """A row in which the bits of those of the lists are set that are kept as bits."""
        columns = self.columns[shingles]
        row = np.zeros(64 * self.rows.shape[1], np.uint8)
        row[columns[columns >= 0]] = 1
        return np.packbits(row).view(np.uint64)

    def add(self, shingles: np.ndarray, member: int) -> None:
        self.keys[self.start[shingles] + self.size[shingles]] = shingles << 32 | member
        self.size[shingles] += 1
        self.most = member + 1
        if member >= len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((member + 1, self.rows.shape[1]), np.uint64)))
        self.rows[member] = self.bits(shingles)

    def shared(self, shingles: np.ndarray, members: np.ndarray) -> np.ndarray:
        """For each member, how many of the lists hold it, of those that are kept as bits."""
        return np.bitwise_count(self.rows[members] & self.bits(shingles)).sum(axis=1, dtype=np.int64)

    def united(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members of stretches of the array, each once, and how many stretches hold each."""
        ends = np.cumsum(size)
        held = self.keys[np.repeat(first - ends + size, size) + np.arange(ends[-1])] & 0xFFFFFFFF
        low = int(held.min())
        counts = np.bincount(held - low)
        members = np.flatnonzero(counts)
        return members + low, counts[members]

    def spans(self, shingles: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each list's members from ``low`` to ``high`` - 1 begin, and how many they are."""
        first = np.searchsorted(self.keys, shingles << 32 | low) if low else self.start[shingles]
        ends = self.start[shingles] + self.size[shingles]
        if high < self.most:
            ends = np.minimum(ends, np.searchsorted(self.keys, shingles << 32 | high))
        return first, ends - first

    def lists(self, first: np.ndarray, size: np.ndarray) -> list[tuple[int, ...]]:
        """The members of stretches of the array."""
        ends = np.cumsum(size)
        flat = tuple((self.keys[np.repeat(first - ends + size, size) + np.arange(ends[-1])] & 0xFFFFFFFF).tolist())
        return [flat[a:b] for a, b in zip((ends - size).tolist(), ends.tolist())]

    def holds(self, shingles: np.ndarray, members: np.ndarray) -> np.ndarray:
        """For each member, how many of the lists hold it."""
        wanted = (shingles << 32)[:, None] | members
        at = np.minimum(np.searchsorted(self.keys, wanted.ravel()), len(self.keys) - 1)
        return (self.keys[at].reshape(wanted.shape) == wanted).sum(axis=0)


def merge_skip(lists: list[tuple[int, ...]], enough: int) -> list[tuple[int, int]]:
    """Members of at least ``enough`` of the sorted lists, with the number of lists that hold them, by a heap that skips ahead
    past members which can't reach that number any more. Equal lists, of which near copies have many, are one list that counts as often."""
    times = Counter(lists)
    lists, weights = list(times), list(times.values())
    heap = [x[0] << 32 | k for k, x in enumerate(lists)]
    heapq.heapify(heap)
    at, found, left, pop, push = [0] * len(lists), [], sum(weights), heapq.heappop, heapq.heappush
    while left >= enough:
        beyond = (heap[0] >> 32) + 1 << 32
        popped, count = [], 0
        while heap and heap[0] < beyond:
            popped.append(k := pop(heap) & 0xFFFFFFFF)
            count += weights[k]
        goal = beyond >> 32
        if count >= enough:
            found.append((goal - 1, count))
        else:
            while heap and (count := count + weights[heap[0] & 0xFFFFFFFF]) < enough:
                popped.append(pop(heap) & 0xFFFFFFFF)
            if not heap:
                break
            goal = heap[0] >> 32
        for k in popped:
            own = lists[k]
            at[k] = place = bisect_left(own, goal, at[k])
            if place < len(own):
                push(heap, own[place] << 32 | k)
            else:
                left -= weights[k]
    return found


def divide_skip(index: Inverted, shingles: np.ndarray, needed: int, low: int = 0, high: int = 1 << 31) -> list[tuple[int, int]]:
    """Members from ``low`` to ``high`` - 1 that at least ``needed`` of the shingles' lists hold, with the number of lists that hold them.

    The longest lists are set aside, and more of them where all are kept as bits, as probes then cost nearly nothing: all but so
    many that one of the rest must hold each member, so the rest are united. Else the rest are merged. What survives is looked up in
    the long lists, in those of bits at once and in others by bisection, in rounds, after each of which members that can't reach the
    number any more are given up.
    """
    shingles = shingles[index.size[shingles] > 0]
    if len(shingles) < needed or needed < 1:
        return []
    first, size = index.spans(shingles, low, high)
    order = np.argsort(size, kind="stable")
    order = order[np.searchsorted(size[order], 1) :]
    if len(order) < needed:
        return []
    mapped = index.columns[shingles[order]] >= 0
    long = needed - 1
    if not mapped[len(order) - long :].all():
        long = min(long, int(needed / (PROBE * log2(max(2, int(size[order[-1]]))) + 1)))
    shorts, longs, mapped = order[: len(order) - long], shingles[order[len(order) - long :]], mapped[len(order) - long :]
    if needed - long == 1:
        members, counts = index.united(first[shorts], size[shorts])
    else:
        found = merge_skip(index.lists(first[shorts], size[shorts]), needed - long)
        if not found:
            return []
        members, counts = np.array(found, np.int64).T
    counts = counts + index.shared(longs[mapped], members)
    longs = longs[~mapped]
    alive = counts + len(longs) >= needed
    members, counts = members[alive], counts[alive]
    k, long = 0, len(longs)
    while k < long and len(members):
        step = max(PROBED, PROBES // len(members))
        counts = counts + index.holds(longs[k : k + step], members)
        k += step
        alive = counts >= needed - max(0, long - k)
        members, counts = members[alive], counts[alive]
    return list(zip(members.tolist(), counts.tolist()))


class Block:
    """Sets of one task, in order of size, their shingles numbered anew. A shingle of one set only is left out, as no two sets share it."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, [len(x) for x in sets]
        _, numbers, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        renumbered = np.where(shared, np.cumsum(shared) - 1, -1)[numbers]
        self.room = counts[shared]
        self.sets = [x[x >= 0] for x in np.split(renumbered, np.cumsum(self.sizes)[:-1])]

    def index(self) -> Inverted:
        return Inverted(self.room, len(self.sets))

    def add(self, index: Inverted, k: int) -> None:
        """Positions must grow, so that lists are sorted."""
        index.add(self.sets[k], k)

    def linked(self, index: Inverted, k: int) -> list[int]:
        """Indexed sets that link with set k: 100 * intersection >= percent * union. Only sets of a size that can link are merged."""
        size, p = self.sizes[k], self.percent
        needed = -(-size * p // 100)  # no linked set shares less, so none is smaller
        low, high = bisect_left(self.sizes, needed), bisect_right(self.sizes, size * 100 // p)
        return [other for other, both in divide_skip(index, self.sets[k], needed, low, high) if 100 * both >= p * (size + self.sizes[other] - both)]


def links(sets: list[np.ndarray], labels: list[int], queries: list[bool], percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that, with equal labels taken as linked, connect exactly what all links would.

    If all are queries, sets are first held against leaders, the sets that linked with no leader before them. What is left
    are links between sets of different groups, at least one of which is no leader; sets outside the largest group look
    for those, among the followers and, followers that precede a leader, among the leaders too. If only some are queries,
    they search among all.
    """
    parent = list(range(len(sets)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    by_label: dict[int, int] = {}
    for k, label in enumerate(labels):
        parent[k] = by_label.setdefault(label, k)
    found: list[tuple[int, int]] = []

    def tie(a: int, b: int) -> None:
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
            found.append((a, b))

    block = Block(sets, percent)
    searched, asking = list(range(len(sets))), [k for k, q in enumerate(queries) if q]
    if len(asking) == len(sets):
        leaders, followers, last = block.index(), [], 0
        for k in searched:
            near = block.linked(leaders, k)
            for other in near:
                tie(k, other)
            if near:
                followers.append(k)
            else:
                block.add(leaders, k)
                last = k
        groups: dict[int, int] = {}
        for k in searched:
            groups[root(k)] = groups.get(root(k), 0) + 1
        largest = max(groups, key=groups.get)
        searched, asking = followers, [k for k in searched if root(k) != largest]
        outside = set(asking)
        for k in followers:
            if k in outside and k < last:  # a later leader was held against leaders only
                for other in block.linked(leaders, k):
                    tie(k, other)
    if searched and asking:
        index = block.index()
        for k in searched:
            block.add(index, k)
        for k in asking:
            for other in block.linked(index, k):
                tie(k, other)
    return found


def search_tasks(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) found within each task. rows: task, id, label, asks, text; a task has at most a few blocks of sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        def members() -> Iterator[tuple]:
            for batch in slices(batches, "text"):
                sets = shingle_sets(raw_texts(batch.column("text")), width)
                yield from zip(*(batch.column(c).to_pylist() for c in ("task", "id", "label", "asks")), sets, signed(set_names(sets)).tolist())

        for _, group in groupby(members(), key=lambda x: x[0]):
            by_id = {}  # a repeated row comes again; a row that only shares another's key has another set
            for _, number, label, asks, shingles, name in group:
                if number not in by_id and name == number:
                    by_id[number] = (shingles, number, label, asks)
            own = sorted(by_id.values(), key=lambda x: (len(x[0]), x[1]))
            if len(own) > 1:
                ids = [x[1] for x in own]
                pairs = links([x[0] for x in own], [x[2] for x in own], [x[3] for x in own], percent)
                if pairs:
                    yield table(schema, [ids[a] for a, _ in pairs], [ids[b] for _, b in pairs])

    return map_arrow(rows.repartition("task").sortWithinPartitions("task"), run, "a long, b long")


# ---------------------------------------------------------------- the operator


def link_groups(docs: DataFrame, shingled: DataFrame, members: DataFrame, width: int, percent: int, block: int, broadcast_rows: int) -> DataFrame:
    """(id, label) of every set that links with another one. members: (id, group), the sets of each block."""
    one = shingled.where("set_id <> 0").groupBy("set_id").agg(F.min("row_key").alias("row_key"), F.first("n_shingles").alias("weight"))
    chosen = durable(one.join(members.withColumnRenamed("id", "set_id"), "set_id").select("row_key", F.col("set_id").alias("id"), "group", "weight"))
    count = chosen.count()
    sized = durable(chosen.groupBy("group").agg(F.sum("weight").alias("size")))
    small = chosen.join(sized.where(F.col("size") <= block), "group")

    def texts(picked: DataFrame) -> DataFrame:
        # The picked rows are broadcast only where counting has shown that they are few.
        return docs.select("row_key", "text").join(F.broadcast(picked) if count <= broadcast_rows else picked, "row_key")

    edges = durable(search_tasks(texts(small.select("row_key", "id", F.col("group").alias("task"), F.col("id").alias("label"), F.lit(True).alias("asks"))), width, percent))
    large = durable(chosen.join(sized.where(F.col("size") > block), "group").withColumn("cuts", F.ceil(F.col("size") / block)))
    if large.isEmpty():
        return components(edges)
    # Large blocks, first step: random parts of the block, then the leaders of all parts, find the bulk of the links.
    every = large.select("id").distinct()
    labels = every.select("id", F.col("id").alias("label"))
    for salt in (1, 2):
        leading = large.join(labels, "id").where("id = label")
        cut = leading.groupBy("group").agg(F.ceil(F.sum("weight") / block).alias("pieces"))
        tasks = leading.join(cut, "group").withColumn("task", F.xxhash64("group", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("pieces"))))
        edges = durable(edges.union(search_tasks(texts(tasks.select("row_key", "id", "task", "label", F.lit(True).alias("asks"))), width, percent)))
        linked = components(edges).withColumnRenamed("label", "found")
        labels = durable(every.join(linked, "id", "left").select("id", F.coalesce("found", "id").alias("label")))
    # Second step, exact: whatever isn't in its block's largest label asks every part of the block.
    state = large.join(labels, "id")
    sums = state.groupBy("group", "label").count()
    main = sums.groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    state = durable(state.join(main, "group").withColumn("asks", F.col("label") != F.col("main")).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("cuts"))))
    asking = state.where("asks").groupBy("group").agg(F.ceil(F.sum("weight") / block).alias("askers"))
    state = state.join(asking, "group").withColumn("asker", F.pmod(F.xxhash64("id", F.lit(3)), F.col("askers")))
    key = F.xxhash64("group", "asker", "piece").alias("task")
    index = state.drop("asker").withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).select("row_key", "id", key, "label", F.lit(False).alias("asks"))
    ask = state.where("asks").drop("piece").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("row_key", "id", key, "label", F.lit(True).alias("asks"))
    tasks = index.union(ask).groupBy("row_key", "id", "task", "label").agg(F.max("asks").alias("asks"))
    crossing = docs.select("row_key", "text").join(tasks, "row_key")
    return components(edges.union(search_tasks(crossing, width, percent)))


def keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """row_key (a hash of id and text), doc_id and text of each row."""
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return docs.withColumn("row_key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text"))


def labelled_sets(docs: DataFrame, percent: int, width: int, block: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """row_key, doc_id, n_shingles and set_id of each row of ``docs`` (0: no words), and (set_id, label, n) of each set: its group and its rows."""
    first_pass = durable(shingle_table(docs, width))
    shingled, seen = first_pass.where("row_key is not null"), first_pass.where("row_key is null")
    frequent = frequent_shingles(seen, shingled.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0])
    members = durable(blocks(docs, width, percent, frequent))
    labels = durable(link_groups(docs.select("row_key", "text"), shingled, members, width, percent, block, broadcast_rows)).withColumnRenamed("id", "set_id")
    sets = shingled.where("set_id <> 0").groupBy("set_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("first"))
    return shingled, durable(sets.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")))


def jaccard_groups(df: DataFrame, percent: int = 85, width: int = 4, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, broadcast_rows: int = 300_000) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``df``: groups of texts connected by links.

    Two texts link when 100 times the shingles that both have is at least ``percent`` times the shingles that either
    has. Equal sets are one member of the search. A text with fewer words than ``width`` is one shingle; without
    words (or null) it has none, links with nothing and is its own component. Repeated rows are kept; a row with a null
    id gets a component id of the others that it links with, or null. Other columns are not read.
    """
    shingled, sets = labelled_sets(keyed(df, id_column, text_column), percent, width, block, broadcast_rows)
    total = shingled.count()
    # A label's least id is found over sets, so that exact copies are one row; both joins keep frequent keys apart.
    least = durable(sets.groupBy("label").agg(F.count("*").alias("n"), F.min("least").alias("component_id")))
    found = hot_join(sets.select("set_id", "label", F.col("n").alias("rows")), least, "label", total).select("set_id", F.col("rows").alias("n"), "component_id")
    full = hot_join(shingled.where("set_id <> 0"), durable(found), "set_id", total).select("doc_id", "n_shingles", "component_id")
    return full.union(shingled.where("set_id = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each_group(df: DataFrame, percent: int = 80, width: int = 5, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, broadcast_rows: int = 300_000) -> DataFrame:
    """``df`` with one row of each group of linked texts: that of the least id, rows without id last; of equal ids, the least by a hash
    of the text. Of rows equal in id and text one stays. Texts without words link with nothing, so all of them stay."""
    rows = df.withColumn("__row_key", F.xxhash64(F.coalesce(F.col(id_column).cast("long"), F.lit(-1)), whole_text(text_column)))
    shingled, sets = labelled_sets(keyed(df, id_column, text_column), percent, width, block, broadcast_rows)
    chosen = sets.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), "least", "first"))["first"].alias("row_key"))
    lettered = shingled.where("set_id <> 0").groupBy("row_key").agg(F.count("*").alias("n"))
    dropped = durable(lettered.join(chosen.withColumn("stays", F.lit(True)), "row_key", "left").where("stays is null or n > 1"))
    gone = dropped.where("stays is null").select(F.col("row_key").alias("__row_key"))
    kept = rows.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, "__row_key", "left_anti")
    repeated = dropped.where("stays").select(F.col("row_key").alias("__row_key"))
    if not repeated.isEmpty():  # only rows that repeat another one are brought together
        few = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated
        kept = kept.join(few, "__row_key", "left_anti").unionByName(kept.join(few, "__row_key", "left_semi").dropDuplicates(["__row_key"]))
    return kept.select(df.columns)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
