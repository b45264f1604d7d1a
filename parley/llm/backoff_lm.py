"""Language-model scores by a weighted backoff automaton over words, of all pairs and triples that occur at least LEAST times.

States are the contexts of two words, of one and of none; an arc reads a word, a failure arc drops a context's first word. Texts
are kept in blocks as numbered tokens. A block sends its distinct n-grams, packed by the hash of their context, to where all blocks'
counts meet, and gets the counts back; so each block holds the arcs that its texts can take, and walks them from left to right.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Memo, brief_shuffles, crc_bucket, durable, map_arrow, mixed, raw_texts, slices, table, whole_text, word_memo, words_of

#: Hash of the token that ends each text; words' hashes that equal it are moved by one.
END = 1

#: Most words that get short numbers, which every task is told, and blocks from which they are drawn. Other words go by their hash; it
#: makes no difference to any score.
SHORT, SAMPLE = 1_000_000, 32

#: Least count of pairs and triples in the model, whatever the size of the corpus, and the discount of their counts.
LEAST, DISCOUNT = 2, 0.75

#: Bytes of text in a block, and tokens whose n-grams meet in one place.
BLOCK, MEETING = 8 << 20, 1_500_000

#: What marks a word without a short number: in its 64-bit code, and in the 32 bits of a packed one.
RARE, PACKED_RARE = 1 << 63, 1 << 31


# ---------------------------------------------------------------- packed arrays


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte plane by byte plane, compressed."""
    head = struct.pack(f"<I{'BI' * len(arrays)}", len(arrays), *(x for a in arrays for x in (a.itemsize, len(a))))
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = struct.unpack_from("<I", raw)[0]
    fields = struct.unpack_from(f"<{'BI' * count}", raw, 4)
    at, found = 4 + 5 * count, []
    for size, length in zip(fields[::2], fields[1::2]):
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        found.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1))
        at += size * length
    return found


# ---------------------------------------------------------------- blocks


def _token_memo() -> Memo:
    plain = word_memo().make
    return Memo(lambda w: h if (h := plain(w)) != END else END + 1)


def block_texts(rows: DataFrame, most_bytes: int = BLOCK) -> DataFrame:
    """(block, training, payload) of rows (row_id, doc_id, held_out, text): the texts as numbered words with an end each, and what else
    the result needs; ``training`` counts tokens of training texts. Numbers are places in the block's sorted list of word hashes."""
    schema = pa.schema([("block", pa.int64()), ("training", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _token_memo()
        for batch in slices(batches, "text", most_bytes):
            found = []
            for raw in raw_texts(batch.column("text")):
                words = words_of(raw)
                found.append(np.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), np.uint64(END)))
            memo.trim()
            if not found:
                continue
            words, tokens = np.unique(np.concatenate(found), return_inverse=True)
            ids = batch.column("doc_id")
            numbers = np.array(ids.fill_null(0).to_pylist(), np.int64).view(np.uint64)
            flags = np.array(ids.is_null().to_pylist(), np.uint8) | np.array(batch.column("held_out").to_pylist(), np.uint8) << 1
            lengths = np.array([len(x) for x in found], np.uint32)
            payload = squeeze(np.diff(words, prepend=np.uint64(0)), tokens.astype(np.uint32), lengths, numbers, flags)
            yield table(schema, [batch.column("row_id")[0].as_py()], [int(lengths[(flags & 2) == 0].sum())], [payload])

    return map_arrow(rows, run, "block long, training long, payload binary")


class Block:
    """A block's tokens, and its distinct pairs and triples, in the order of the places where they meet."""

    def __init__(self, payload: bytes):
        words, tokens, self.lengths, self.ids, self.flags = unsqueeze(payload)
        self.words = np.cumsum(words, dtype=np.uint64)
        self.tokens = tokens.astype(np.int64)
        self.training = np.repeat((self.flags & 2) == 0, self.lengths)

    def counts(self) -> np.ndarray:
        """How often each word occurs in training texts."""
        return np.bincount(self.tokens[self.training], minlength=len(self.words))

    def word_places(self, meetings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' marks, the places where they meet, and their order by place and mark."""
        marks = self.words | np.uint64(RARE)
        places = word_place(marks, meetings)
        return marks, places, np.lexsort((marks, places))

    def grams(self, meetings: int, frequent: np.ndarray) -> np.ndarray:
        """Sets pairs (first, second) and triples (pair, third) with their places; of each position the pair and the triple that end there, or -1.

        A pair with a word that has no short number meets others where that word's do, so the word goes to few places. Returns the words' codes.
        """
        codes = coded(self.words, frequent)
        t, v = self.tokens, len(self.words)
        end = int(np.searchsorted(self.words, np.uint64(END)))
        at = np.flatnonzero(t[:-1] != end)  # a text's last token begins nothing
        pairs, of_pair = np.unique(t[at] * v + t[at + 1], return_inverse=True)
        first, second = pairs // v, pairs % v
        a, b, rare = self.words[first], self.words[second], codes >= RARE
        key = np.where(rare[first], mixed(a, 16), np.where(rare[second], mixed(b, 16), pair_hash(a, b)))
        place = (key % np.uint64(meetings)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        self.first, self.second, self.place = first[order], second[order], place[order]
        self.pair_ending = np.full(len(t), -1)
        self.pair_ending[at + 1] = moved[of_pair]
        at = at[t[at + 1] != end]
        triples, of_triple = np.unique(self.pair_ending[at + 1] * v + t[at + 2], return_inverse=True)
        self.context, self.third = triples // v, triples % v
        self.triple_ending = np.full(len(t), -1)
        self.triple_ending[at + 2] = of_triple
        return codes

    def training_counts(self, ending: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(ending[(ending >= 0) & self.training], minlength=size)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(a, 11) + b, 12)


def word_place(marks: np.ndarray, meetings: int) -> np.ndarray:
    return (mixed(marks, 15) % np.uint64(meetings)).astype(np.int64)


def coded(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """64-bit codes of word hashes: the place of the mark, which is the hash with RARE set, among the frequent ones, or the mark."""
    marks = words | np.uint64(RARE)
    at = np.minimum(np.searchsorted(frequent, marks), max(0, len(frequent) - 1))
    known = frequent[at] == marks if len(frequent) else np.zeros(len(marks), bool)
    return np.where(known, at.astype(np.uint64), marks)


def word_rows(blocks: DataFrame, meetings: int) -> DataFrame:
    """(meeting, block, payload): each block's distinct words by meeting place, with their counts in training texts."""
    schema = pa.schema([("meeting", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                block = Block(payload)
                marks, places, order = block.word_places(meetings)
                marks, counts = marks[order], block.counts()[order].astype(np.uint32)
                borders = np.searchsorted(places[order], np.arange(meetings + 1))
                out = [(k, number, squeeze(np.diff(marks[a:b], prepend=np.uint64(0)), counts[a:b])) for k, (a, b) in enumerate(zip(borders, borders[1:])) if b > a]
                yield table(schema, *zip(*out))

    return map_arrow(blocks, run, "meeting int, block long, payload binary")


def by_meeting(rows: DataFrame, run_one, shape: str) -> DataFrame:
    """What ``run_one`` makes of each meeting place's rows (block, payload), as (block, meeting, payload) rows."""
    schema = pa.schema([("block", pa.int64()), ("meeting", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("meeting", "block", "payload"))))
        for place, group in groupby(every, key=lambda x: x[0]):
            for number, at, payload in run_one(place, [x[1:] for x in group]):
                yield table(schema, [number], [at], [payload])

    return map_arrow(rows.select("meeting", "block", "payload").repartition("meeting").sortWithinPartitions("meeting"), run, shape)


ANSWER = "block long, meeting int, payload binary"


def meet_words(rows: list[tuple[int | None, bytes]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """The distinct marks of a meeting place, their counts, and of each block the places of its words among them."""
    own = [(number, *unsqueeze(payload)) for number, payload in rows]
    marks = [np.cumsum(diff, dtype=np.uint64) for _, diff, _ in own]
    words, at = np.unique(np.concatenate(marks), return_inverse=True)
    counts = np.bincount(at, np.concatenate([n for *_, n in own]), len(words)).astype(np.int64)
    ends = np.cumsum([len(m) for m in marks])
    return words, counts, [(number, part) for (number, *_), part in zip(own, np.split(at, ends[:-1]))]


def short_words(blocks: DataFrame, most: int, sample: int) -> np.ndarray:
    """At most ``most`` sorted marks of words that deserve short numbers: those that stand twice in one of at most ``sample`` blocks, the
    most frequent ones there first. Which words these are decides how small packed rows get, and nothing else."""
    schema = pa.schema([("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                block = Block(payload)
                counts = np.bincount(block.tokens)
                marks = np.unique(block.words[counts > 1] | np.uint64(RARE))
                yield table(schema, [squeeze(np.diff(marks, prepend=np.uint64(0)))])

    drawn = blocks.orderBy(F.xxhash64("block")).limit(sample).select("block")
    chosen = blocks.join(F.broadcast(drawn), "block", "left_semi").select("payload")
    told = [np.cumsum(unsqueeze(r["payload"])[0], dtype=np.uint64) for r in map_arrow(chosen, run, "payload binary").collect()]
    if not told:
        return np.zeros(0, np.uint64)
    marks, times = np.unique(np.concatenate(told), return_counts=True)
    return np.sort(marks[np.argsort(-times, kind="stable")[:most]])


def word_answers(blocks: DataFrame, answered: DataFrame, meetings: int) -> DataFrame:
    """For each block and meeting place its words' counts, and as contexts the sum and the number of their kept pairs; and rows without
    block with the number of distinct words of training texts."""

    def one(place: int, rows: list[tuple[int | None, bytes]]) -> list[tuple[int, int, bytes]]:
        asked, sums = [x for x in rows if x[0] is not None], [unsqueeze(x[1]) for x in rows if x[0] is None]
        if not asked:
            return []
        words, counts, blocks_at = meet_words(asked)
        total, kept = np.zeros(len(words)), np.zeros(len(words))
        for marks, own_total, own_kept in sums:
            at = np.searchsorted(words, marks)  # a context is a word of some block
            total[at] += own_total
            kept[at] += own_kept
        told = [x.astype(np.uint64) for x in (counts, total, kept)]
        distinct = squeeze(np.array([np.count_nonzero(counts)], np.uint64))
        return [(number, place, squeeze(*(x[at] for x in told))) for number, at in blocks_at] + [(None, place, distinct)]

    below = answered.where("block is null").select("meeting", "block", "payload")
    return by_meeting(word_rows(blocks, meetings).union(below), one, ANSWER)


def meeting_rows(blocks: DataFrame, frequent, meetings: int) -> DataFrame:
    """(meeting, block, payload): each block's distinct n-grams by meeting place, with their counts in training texts."""
    schema = pa.schema([("meeting", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                block = Block(payload)
                codes = block.grams(meetings, frequent.value)
                n2 = block.training_counts(block.pair_ending, len(block.first)).astype(np.uint32)
                n3 = block.training_counts(block.triple_ending, len(block.context)).astype(np.uint32)
                followers = np.bincount(block.context, minlength=len(block.first)).astype(np.uint32)
                borders = np.searchsorted(block.place, np.arange(meetings + 1))
                borders3 = np.searchsorted(block.context, borders)
                out = []
                for k in np.flatnonzero(np.diff(borders)).tolist():
                    own, own3 = slice(borders[k], borders[k + 1]), slice(borders3[k], borders3[k + 1])
                    parts = [codes[x] for x in (block.first[own], block.second[own], block.third[own3])]
                    rare = np.unique(np.concatenate([x[x >= RARE] for x in parts]))
                    first, second, third = (np.where(x < RARE, x, PACKED_RARE + np.searchsorted(rare, x).astype(np.uint64)).astype(np.uint32) for x in parts)
                    out.append((k, number, squeeze(rare, np.diff(first, prepend=np.uint32(0)), second, n2[own], followers[own], third, n3[own3])))
                if out:
                    yield table(schema, *zip(*out))

    return map_arrow(blocks, run, "meeting int, block long, payload binary")


# ---------------------------------------------------------------- where counts meet


def meet(rows: list[tuple[int, bytes]], frequent: np.ndarray, meetings: int, least: int = LEAST) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
    """Answers to the blocks' rows of one meeting place, and for the words' meeting places what their words have here as contexts.

    An answer gives for each pair its count, and as a context the sum and the number of its kept triples; for each triple its count. What
    is not kept has count 0.
    """
    firsts, seconds, thirds, n2s, n3s, followed = [], [], [], [], [], []
    for _, payload in rows:
        rare, first, second, n2, followers, third, n3 = unsqueeze(payload)
        for codes, into in ((np.cumsum(first, dtype=np.uint32), firsts), (second, seconds), (third, thirds)):
            wide = codes.astype(np.uint64)
            marked = codes >= PACKED_RARE
            wide[marked] = rare[codes[marked] - np.uint32(PACKED_RARE)]
            into.append(wide)
        n2s.append(n2)
        n3s.append(n3)
        followed.append(followers)
    sizes, sizes3 = [len(x) for x in firsts], [len(x) for x in thirds]
    first, second, third, n2, n3, followers = map(np.concatenate, (firsts, seconds, thirds, n2s, n3s, followed))
    plain = (first < RARE) & (second < RARE)
    keys = np.where(plain, first << np.uint64(20) | second, pair_hash(first, second) | np.uint64(RARE))
    pairs, at, pair = np.unique(keys, return_index=True, return_inverse=True)
    c2 = np.bincount(pair, n2).astype(np.int64)
    c2[c2 < least] = 0
    context = np.repeat(pair, followers)
    keys = np.where(third < RARE, context.astype(np.uint64) << np.uint64(20) | third, pair_hash(context.astype(np.uint64), third) | np.uint64(RARE))
    triples, at3, triple = np.unique(keys, return_index=True, return_inverse=True)
    c3 = np.bincount(triple, n3, len(triples)).astype(np.int64)
    c3[c3 < least] = 0
    owner = context[at3]
    sum2 = np.bincount(owner, c3, len(pairs)).astype(np.int64)
    kept2 = np.bincount(owner, c3 > 0, len(pairs)).astype(np.int64)
    words, word = np.unique(first[at][c2 > 0], return_inverse=True)
    total, kept = np.bincount(word, c2[c2 > 0], len(words)).astype(np.uint64), np.bincount(word, minlength=len(words)).astype(np.uint64)
    short = words < RARE
    marks = words.copy()
    marks[short] = frequent[words[short].astype(np.int64)]
    places = word_place(marks, meetings)
    below = [(k, squeeze(marks[own], total[own], kept[own])) for k in np.unique(places).tolist() for own in [places == k]]
    found, a, b = [], 0, 0
    for (number, _), size, size3 in zip(rows, sizes, sizes3):
        own, own3 = pair[a : a + size], triple[b : b + size3]
        found.append((number, squeeze(*(x[own].astype(np.uint64) for x in (c2, sum2, kept2)), c3[own3].astype(np.uint64))))
        a, b = a + size, b + size3
    return found, below


def answers(rows: DataFrame, frequent, meetings: int) -> DataFrame:
    """(block, meeting, payload) for each row of ``meeting_rows``, and rows without block for the words' meeting places."""

    def one(place: int, own: list[tuple[int, bytes]]) -> list[tuple[int | None, int, bytes]]:
        found, below = meet(own, frequent.value, meetings)
        return [(number, place, payload) for number, payload in found] + [(None, k, payload) for k, payload in below]

    return by_meeting(rows, one, ANSWER)


# ---------------------------------------------------------------- the walk


def walk(block: Block, c1: np.ndarray, sum1: np.ndarray, kept1: np.ndarray, c2: np.ndarray, sum2: np.ndarray, kept2: np.ndarray, c3: np.ndarray, tokens: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each text by the automaton, and by its root alone.

    Read from left to right, the state behind a token is the longest context that was kept: its last two words, its last one, or none. The
    next word takes the state's arc, whose weight is the discounted share with what the failure arcs would add, or else the failure arc,
    whose weight is what the discounts of the context's arcs leave, to the state behind. So each state's probabilities sum to one. A
    token's state depends on the two before it only, so all tokens take their arcs at once.
    """
    t = block.tokens
    root = (c1 + 1.0) / (tokens + distinct + 1.0)
    weight = root[t]
    base = np.log10(weight)
    fail1 = np.where(kept1 > 0, 1 - (sum1 - DISCOUNT * kept1) / np.maximum(c1, 1), 1.0)
    at = np.flatnonzero(block.pair_ending >= 0)
    pair, before = block.pair_ending[at], t[at - 1]
    weight[at] = np.where(c2[pair] > 0, c2[pair] - DISCOUNT, 0.0) / np.maximum(c1[before], 1) + fail1[before] * weight[at]
    fail2 = np.where(kept2 > 0, 1 - (sum2 - DISCOUNT * kept2) / np.maximum(c2, 1), 1.0)
    at = np.flatnonzero(block.triple_ending >= 0)
    triple, state = block.triple_ending[at], block.pair_ending[at - 1]
    weight[at] = np.where(c3[triple] > 0, c3[triple] - DISCOUNT, 0.0) / np.maximum(c2[state], 1) + fail2[state] * weight[at]
    starts = np.concatenate(([0], np.cumsum(block.lengths.astype(np.int64))))[:-1]
    return np.add.reduceat(np.log10(weight), starts), np.add.reduceat(base, starts)


def score_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int = 7, held_bucket: int = 2, most_short: int = SHORT, block_bytes: int = BLOCK, meeting_tokens: int = MEETING) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``df``.

    The model learns from rows whose crc32 of the id modulo ``buckets`` is not ``held_bucket``: all words, and all pairs and
    triples that occur there at least LEAST times. A null or empty text is its end token; repeated rows are kept; a null id counts as the empty
    text for the split; without training rows every probability is 1; an empty table gives an empty one. Other columns are not read. Texts
    start in the empty context.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_column).cast("long").alias("doc_id"), (crc_bucket(id_column, buckets) == held_bucket).alias("held_out"), whole_text(text_column).alias("text")
    )
    spark = df.sparkSession
    with brief_shuffles(spark):  # what the n-grams and words met by is done with when their counts are stored
        blocks = durable(block_texts(rows, block_bytes))
        tokens = blocks.agg(F.coalesce(F.sum("training"), F.lit(0))).first()[0]
        meetings = max(1, -(-tokens // meeting_tokens))
        frequent = spark.sparkContext.broadcast(short_words(blocks, most_short, SAMPLE))
        answered = durable(answers(meeting_rows(blocks, frequent, meetings), frequent, meetings))
        words = durable(word_answers(blocks, answered, meetings))
    lines = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("meeting"), "payload")
    distinct = sum(int(unsqueeze(r["payload"])[0][0]) for r in words.where("block is null").select("payload").collect())  # one number a meeting place
    lines = lines.union(words.where("block is not null").select("block", F.lit(1), "meeting", "payload"))
    lines = lines.union(answered.where("block is not null").select("block", F.lit(2), "meeting", "payload"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "payload"))))
        for _, group in groupby(every, key=lambda x: x[0]):
            (_, _, payload), *rest = group
            block = Block(payload)
            block.grams(meetings, frequent.value)
            order = block.word_places(meetings)[2]
            words = [unsqueeze(x[2]) for x in rest if x[1] == 1]
            c1, sum1, kept1 = (np.zeros(len(order), np.int64) for _ in range(3))
            for into, parts in zip((c1, sum1, kept1), zip(*words)):
                into[order] = np.concatenate(parts)
            told = [unsqueeze(x[2]) for x in rest if x[1] == 2]
            c2, sum2, kept2, c3 = (np.concatenate(x).astype(np.int64) for x in zip(*told)) if told else (np.zeros(0, np.int64) for _ in range(4))
            score, base = walk(block, c1, sum1, kept1, c2, sum2, kept2, c3, tokens, distinct)
            starts = np.concatenate(([0], np.cumsum(block.lengths.astype(np.int64))))[:-1]
            size = len(block.ids)
            ids = pa.array(block.ids.view(np.int64), mask=(block.flags & 1) == 1)
            yield table(schema, ids, (block.flags & 2) == 2, block.lengths, np.add.reduceat((c1 > 0)[block.tokens].astype(np.int64), starts), np.full(size, tokens), base, score)

    together = lines.repartition("block").sortWithinPartitions("block", "kind", "meeting")
    return map_arrow(together, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
