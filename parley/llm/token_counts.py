"""Token counts by a finite-state transducer compiled from a word-end byte-pair vocabulary."""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import merges
from parley.llm.common import Memo, map_arrow, slices, table, vocabulary_path, whole_text

#: Symbols of a chunk; texts of more characters are cut, and their chunks are read in different tasks.
CHUNK = 65_536

#: Symbols before a chunk from which the state at its beginning is told. Where a piece began before them, that is a guess.
LOOKBACK = 512

#: Memorised words, and from how many on a worker keeps them from task to task, and the vocabulary too.
MEMO, KEEPS_VOCABULARY = 900_000, 200_000

#: The symbol of a special token, beside 0 to 255 for bytes and 256 to 511 for bytes that end a piece.
SPECIAL = 512

#: Fixed values of the vocabulary's normaliser and splitter.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{merges.SPACE}\p{{L}}\p{{N}}]+")
GAPS, WORDS = regex.compile(f"[{merges.SPACE}]+"), regex.compile(f"[^{merges.SPACE}]+")
PYTHON_ONLY_SPACE = regex.compile("[\x1c-\x1f]")


class Transducer:
    """Counts the tokens of one piece, symbol by symbol.

    After a prefix of a piece, a state holds for each place that a token under way may have begun: the
    trie node of the symbols since then, the last token of the encoding up to that place, and how many
    tokens that encoding has less than the present prefix's. A prefix's encoding is unique, so a symbol
    leads to one state, and the arc carries by how much the count of tokens changes. States and arcs are
    compiled when a text first reaches them.
    """

    START = 0

    def __init__(self, vocabulary: merges.Vocabulary, limit: int = 400_000):
        self.vocabulary, self.limit = vocabulary, limit
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: dict[int, int] = {}
        for token, symbols in vocabulary.spelling.items():
            if not vocabulary.stands[token]:
                continue
            node = 0
            for symbol in symbols:
                if (after := self.trie[node].get(symbol)) is None:
                    after = self.trie[node][symbol] = len(self.trie)
                    self.trie.append({})
                node = after
            self.token_at[node] = token
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.numbers = [start], {start: self.START}
        self.arcs: dict[int, tuple[int, int]] = {}

    def trim(self) -> None:
        if len(self.arcs) > self.limit:
            self.reset()

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        begun, ending, last, emitted = [], None, -1, 0
        for node, before, less in self.states[state]:  # the longest token first
            after = self.trie[node].get(symbol)
            if after is None:
                continue
            begun.append((after, before, less))
            token = self.token_at.get(after)
            if ending is None and token is not None and (before < 0 or self.vocabulary.beside[before << 20 | token]):
                ending, last, emitted = token, token, less + 1
        if ending is None:
            raise ValueError("a symbol is missing from the vocabulary")
        key = (*((node, before, less - emitted) for node, before, less in begun), (0, last, 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        arc = self.arcs[state << 9 | symbol] = (number, emitted)
        return arc

    def run(self, state: int, symbols: Iterable[int]) -> tuple[int, int]:
        """The state after the symbols, and how many tokens they add. A piece's end leads back to the start, as does a special token."""
        total, arcs = 0, self.arcs
        for symbol in symbols:
            if symbol == SPECIAL:
                total += 1
                continue
            state, emitted = arcs.get(state << 9 | symbol) or self.compile(state, symbol)
            total += emitted
            if symbol > 255:
                state = self.START
        return state, total

    def count(self, piece: bytes) -> int:
        """Tokens of a piece, its last byte ending the word."""
        state, total, arcs = self.START, 0, self.arcs
        for symbol in (*piece[:-1], piece[-1] + 256):
            state, emitted = arcs.get(state << 9 | symbol) or self.compile(state, symbol)
            total += emitted
        return total

    def name(self, state: int) -> str:
        """What a state is, so that any other compilation of the vocabulary knows it."""
        return ";".join(",".join(map(str, x)) for x in self.states[state])

    def named(self, name: str) -> int:
        key = tuple(tuple(map(int, x.split(","))) for x in name.split(";"))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        return self.numbers[key]


#: What a chunk does: for an entry state the state behind it and the tokens counted on the way.
StateMap = dict[str, tuple[str, int]]


def compose(first: StateMap, second: StateMap) -> StateMap:
    """The map of two neighbouring chunks together; associative, so a scan may take neighbours in any grouping."""
    return {entry: (second[middle][0], count + second[middle][1]) for entry, (middle, count) in first.items() if middle in second}


def scan(maps: list[StateMap]) -> list[StateMap]:
    """Of each prefix of the chunks the map: inclusive scan, in which the distance of what is composed doubles each round."""
    distance = 1
    while distance < len(maps):
        maps = [compose(maps[k - distance], m) if k >= distance else m for k, m in enumerate(maps)]
        distance *= 2
    return maps


#: A worker's counters by vocabulary and size.
_KEPT: dict[tuple[str, int], Counter] = {}


class Counter:
    """Counts tokens of texts; words between white space are independent of each other."""

    def __init__(self, path: str, memo: int = MEMO):
        """``memo``: words whose counts are kept, which bounds a worker's memory (900,000: some 400 MB). From KEEPS_VOCABULARY on a worker
        keeps them, and the vocabulary, from task to task (``of_worker``)."""
        self.memo = memo
        self.vocabulary = merges.load(path)
        self.transducer = Transducer(self.vocabulary, memo * 2 // 3)
        self.pieces = Memo(self.transducer.count, memo * 2 // 3)
        self.words = Memo(self._word, memo)

    @classmethod
    def of_worker(cls, path: str, memo: int = MEMO) -> Counter:
        """The worker's counter, which goes on with what earlier tasks have compiled; with a small memo a new one."""
        if memo < KEEPS_VOCABULARY:
            return cls(path, memo)
        if (path, memo) not in _KEPT:
            _KEPT[path, memo] = cls(path, memo)
        return _KEPT[path, memo]

    def _word(self, word: str) -> int:
        if word.isascii():  # most words are one piece of letters, or that and a mark
            if word.isalpha():
                return self.transducer.count(word.lower().encode())
            if word[:-1].isalpha() and not word[-1].isalnum():
                return self.pieces[word[:-1].lower().encode()] + self.pieces[word[-1].encode()]
        total, specials = 0, 0
        if "<|" in word:
            specials = len(self.vocabulary.special_pattern.findall(word))
            parts = self.vocabulary.special_pattern.split(word)
        else:
            parts = [word]
        for part in parts:
            total += sum(self.pieces[x.encode()] for x in self.pieces_of(part))
        return total + specials

    @staticmethod
    def pieces_of(part: str) -> list[str]:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # sigma is lower-cased without its context
        return PIECES.findall(part.lower())

    def split(self, text: str) -> list[str]:
        if PYTHON_ONLY_SPACE.search(text):
            return [x for x in GAPS.split(text) if x]
        return text.split()

    def text(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.split(text)))

    def trim(self, texts: Iterable[str] = ()) -> None:
        """Keep within the bounds. When the words are too many, those of ``texts``, the last ones read, stay, as most of what is frequent is
        among them."""
        if len(self.words) > self.memo:
            kept = {w: self.words[w] for text in texts for w in self.split(text) if w in self.words}
            self.words.clear()
            self.words.update(kept)
        for memo in (self.pieces, self.transducer, self.vocabulary):
            memo.trim()

    def done(self) -> None:
        """At a task's end: keep what later tasks can use, within the bounds, or with a small memo forget it all, also in the vocabulary, which
        other counters of the process share."""
        if self.memo >= KEEPS_VOCABULARY:
            self.trim()
            return
        self.words.clear()
        self.pieces.clear()
        self.transducer.reset()
        self.vocabulary.beside.clear()
        merges.load.cache_clear()

    def symbols(self, text: str) -> np.ndarray:
        """The symbols of a whole text: what the transducer reads. White space and borders of pieces are in its ends of pieces."""
        found = array("H")
        for match in WORDS.finditer(text):
            word = match[0]
            specials = self.vocabulary.special_pattern.findall(word) if "<|" in word else []
            for k, part in enumerate(self.vocabulary.special_pattern.split(word) if specials else [word]):
                if k:
                    found.append(SPECIAL)
                for piece in self.pieces_of(part):
                    raw = piece.encode()
                    found.extend(raw[:-1])
                    found.append(raw[-1] + 256)
        return np.frombuffer(found, np.uint16)

    def chunk_map(self, before: bytes, symbols: bytes) -> StateMap:
        """A chunk's map for the state that the symbols before it lead to from the start."""
        fst = self.transducer
        entry, _ = fst.run(fst.START, np.frombuffer(before, np.uint16).tolist())
        leave, count = fst.run(entry, np.frombuffer(symbols, np.uint16).tolist())
        return {fst.name(entry): (fst.name(leave), count)}

    def total(self, chunks: list[tuple[StateMap, bytes | None]]) -> int:
        """Tokens of a whole text from its chunks' maps in order, and the symbols of those whose entry was guessed.

        The scan tells how far the guesses were right. From a wrong one on, chunks follow one another, and where a map does not know its
        true entry, the chunk is read again from there.
        """
        fst = self.transducer
        start = fst.name(fst.START)
        prefixes = scan([m for m, _ in chunks])
        right = next((k for k, m in enumerate(prefixes) if start not in m), len(chunks))
        state, total = prefixes[right - 1][start] if right else (start, 0)
        for own, symbols in chunks[right:]:
            if state not in own:
                leave, count = fst.run(fst.named(state), np.frombuffer(symbols, np.uint16).tolist())
                own = {state: (fst.name(leave), count)}
            state, total = own[state][0], total + own[state][1]
        return total


def cut_symbols(symbols: np.ndarray, chunk: int, lookback: int) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """Number, symbols before, symbols, and whether the symbols before do not reach back to a piece's begin, of each chunk."""
    borders = np.flatnonzero(symbols > 255) + 1  # where the transducer is at its start
    for k, at in enumerate(range(0, max(1, len(symbols)), chunk)):
        last = int(np.searchsorted(borders, at, "right")) - 1
        begin = int(borders[last]) if last >= 0 else 0
        first = max(begin, at - lookback)
        yield k, symbols[first:at].tobytes(), symbols[at : at + chunk].tobytes(), first > begin


def token_counts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048, chunk: int = CHUNK, lookback: int = LOOKBACK) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are kept as they are; other columns
    are not read. Texts of more than ``chunk`` characters become chunks of that many symbols, cut anywhere, which other
    tasks read; a chunk gives back its state map, and a text's maps are composed by a prefix scan. Where a piece began more than
    ``lookback`` symbols before a chunk, the entry state is a guess, and the chunk's symbols go along, so that a wrong guess is mended.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_column).cast("long").alias("doc_id"), F.octet_length(whole_text(text_column)).cast("long").alias("n_bytes"), whole_text(text_column).alias("text")
    )
    counted = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    keys = [("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("at", pa.int64())]
    chunked = pa.schema([*keys, ("before", pa.binary()), ("symbols", pa.binary()), ("guessed", pa.bool_())])
    mapped = pa.schema([*keys, ("entry", pa.string()), ("leave", pa.string()), ("count", pa.int64()), ("symbols", pa.binary())])

    def count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of_worker(path)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            yield table(counted, batch.column("doc_id"), batch.column("n_bytes"), [counter.text(x) for x in texts])
            counter.trim(texts)
        counter.done()

    def cut_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of_worker(path)
        for batch in slices(batches, "text", 4 << 20):
            for *own, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "n_bytes", "text"))):
                yield table(chunked, *zip(*((*own, *x) for x in cut_symbols(counter.symbols(text), chunk, lookback))))

    def map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of_worker(path)
        for batch in slices(batches, "symbols", 4 << 20):
            found = []
            for *own, before, symbols, guessed in zip(*(batch.column(c).to_pylist() for c in chunked.names)):
                [(entry, (leave, count))] = counter.chunk_map(before, symbols).items()
                found.append((*own, entry, leave, count, symbols if guessed else None))
            if found:
                yield table(mapped, *zip(*found))
            counter.trim()
        counter.done()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of_worker(path)
        every = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in mapped.names)))
        for _, group in groupby(every, key=lambda x: x[0]):
            chunks = [*group]
            total = counter.total([({entry: (leave, count)}, symbols) for *_, entry, leave, count, symbols in chunks])
            yield table(counted, [chunks[0][1]], [chunks[0][2]], [total])
            counter.trim()
        counter.done()

    shape = "doc_id long, n_bytes long, n_tokens long"
    short = map_arrow(rows.where(F.length("text") <= chunk).select("doc_id", "n_bytes", "text"), count_short, shape)
    cut = map_arrow(rows.where(F.length("text") > chunk), cut_long, "row_id long, doc_id long, n_bytes long, at long, before binary, symbols binary, guessed boolean")
    maps = map_arrow(cut.repartition("row_id", "at"), map_chunks, "row_id long, doc_id long, n_bytes long, at long, entry string, leave string, count long, symbols binary")
    long = map_arrow(maps.repartition("row_id").sortWithinPartitions("row_id", "at"), fold, shape)
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"))
