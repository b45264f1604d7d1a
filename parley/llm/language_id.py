"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import crc_bucket, map_arrow, slices, table, whole_text

#: Buckets of the hashed features.
FEATURES = 1 << 16

#: Letters of the words whose features are held at a time.
GROUP = 1 << 17

#: Words of a training sequence, and of a chunk of the forward-backward scan.
SEQUENCE, CHUNK = 24, 128

NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def cleaned(token: str) -> str:
    """The token's letters with their marks, in lower case; empty if it has no letter."""
    word = NO_LETTER.sub("", token.lower())
    return word if word.isascii() or LETTER.search(word) else ""


def hashed(codes: np.ndarray, salt: int) -> np.ndarray:
    """Feature bucket of each row of code points (last axis)."""
    x = np.full(codes.shape[:-1], salt * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[-1]):
            x = (x ^ codes[..., k]) * np.uint32(0x01000193)
            x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
    return x >> np.uint32(16)


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed features of words, in groups of like length: (positions of the words, buckets, which of them hold).

    Character n-grams of 2 to 4 with the borders of the word, and affixes: the first and the last 1 to 4 letters.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    classes = np.ceil(np.log2(np.maximum(lengths, 8) / 8)).astype(np.int64)
    groups = []
    for k in np.unique(classes):
        alike, width = np.flatnonzero(classes == k), 8 << int(k)
        groups += [(alike[i : i + max(1, GROUP // width)], width) for i in range(0, len(alike), max(1, GROUP // width))]
    for at, width in groups:
        codes = np.array([words[i] for i in at], f"U{width}").view(np.uint32).reshape(len(at), width)
        own = lengths[at][:, None]
        bounded = np.zeros((len(at), width + 2), np.uint32)
        bounded[:, 0], bounded[:, 1:-1] = 1, codes
        bounded[np.arange(len(at)), own[:, 0] + 1] = 2
        buckets, holds = [], []
        for n in (2, 3, 4):
            grams = np.lib.stride_tricks.sliding_window_view(bounded, n, axis=1)
            buckets.append(hashed(grams, n))
            holds.append(np.arange(grams.shape[1]) + n <= own + 2)
        for n in (1, 2, 3, 4):
            tail = np.take_along_axis(bounded, np.maximum(0, own + np.arange(1 - n, 1)), axis=1)
            buckets += [hashed(bounded[:, 1 : 1 + n], 10 + n)[:, None], hashed(tail, 20 + n)[:, None]]
            holds += [own >= n, own >= n]
        yield at, np.concatenate(buckets, axis=1), np.concatenate(holds, axis=1)


@dataclass
class Model:
    """Weights of the hashed features and of lexicon words by language, and log weights of transitions."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    words: np.ndarray
    steps: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at, buckets, holds in features(words):
            out[at] = np.einsum("nfl,nf->nl", self.weights[buckets], holds) / np.sqrt(holds.sum(axis=1, keepdims=True) + 1)
        listed = [(i, k) for i, w in enumerate(words) if (k := self.lexicon.get(w)) is not None]
        if listed:
            at, rows = np.array(listed).T
            out[at] += self.words[rows]
        return out


def forward_backward(scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (s, t, l) of equally long sequences of emission scores, and expected transition counts (l, l)."""
    s, t, size = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(steps - steps.max())
    ahead, behind = np.zeros_like(emit), np.ones_like(emit)
    last = np.full((s, size), 1 / size)
    for k in range(t):
        last = (last @ move) * emit[:, k]
        last /= last.sum(axis=1, keepdims=True)
        ahead[:, k] = last
    for k in range(t - 2, -1, -1):
        x = (behind[:, k + 1] * emit[:, k + 1]) @ move.T
        behind[:, k] = x / x.sum(axis=1, keepdims=True)
    posterior = ahead * behind
    posterior /= posterior.sum(axis=2, keepdims=True)
    counts = np.zeros((size, size))
    before = np.concatenate((np.full((s, 1, size), 1 / size), ahead[:, :-1]), axis=1)
    for k in range(t):
        pair = before[:, k, :, None] * move * (emit[:, k] * behind[:, k])[:, None, :]
        counts += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return posterior, counts


def chunk_posteriors(emit: np.ndarray, move: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Posteriors of all words of many texts, exact over whole texts.

    emit: (words, l) factors; starts: first word of each text and, last, the number of words. Texts are cut into chunks
    that are walked side by side. A chunk's transfer matrix says what it makes of any entry state; a scan over a text's
    chunks then gives each chunk its true messages from both sides.
    """
    n, size = emit.shape
    lengths = np.diff(starts)
    chunks = -(-lengths // CHUNK)
    first = np.concatenate(([0], np.cumsum(chunks)))
    total = int(first[-1])
    text_of = np.repeat(np.arange(len(lengths)), chunks)
    number = np.arange(total) - first[text_of]
    begin = starts[:-1][text_of] + number * CHUNK
    count = np.minimum(CHUNK, starts[1:][text_of] - begin)
    entry, leave = np.full((total, size), 1 / size), np.ones((total, size))
    many = np.flatnonzero(chunks[text_of] > 1)
    if len(many):
        transfer = np.broadcast_to(np.eye(size), (len(many), size, size)).copy()
        for k in range(CHUNK):
            on = np.flatnonzero(count[many] > k)
            x = (transfer[on] @ move) * emit[begin[many[on]] + k][:, None, :]
            transfer[on] = x / x.sum(axis=(1, 2), keepdims=True)
        place = np.full(total, -1)
        place[many] = np.arange(len(many))
        for k in range(1, int(chunks.max())):
            on = first[:-1][chunks > k] + k
            x = np.einsum("ni,nij->nj", entry[on - 1], transfer[place[on - 1]])
            entry[on] = x / x.sum(axis=1, keepdims=True)
        for k in range(2, int(chunks.max()) + 1):
            on = first[1:][chunks >= k] - k
            x = np.einsum("nij,nj->ni", transfer[place[on + 1]], leave[on + 1])
            leave[on] = x / x.sum(axis=1, keepdims=True)
    order = np.argsort(-count, kind="stable")  # so that the chunks still running stand in front
    begin, count, entry, leave = begin[order], count[order], entry[order], leave[order]
    running = [int(np.searchsorted(-count, -k, "left")) for k in range(int(count.max(initial=0)))]
    posterior = np.empty_like(emit)
    for k, on in enumerate(running):
        entry = (entry[:on] @ move) * emit[begin[:on] + k]
        entry /= entry.sum(axis=1, keepdims=True)
        posterior[begin[:on] + k] = entry
    message = leave
    for k in range(len(running) - 1, -1, -1):
        on = running[k]
        at = begin[:on] + k
        posterior[at] *= message[:on]
        x = (message[:on] * emit[at]) @ move.T
        message[:on] = x / x.sum(axis=1, keepdims=True)
    return posterior / posterior.sum(axis=1, keepdims=True)


def fit(sample: pd.DataFrame, rounds: int = 25, mixed_share: float = 0.3, seed: int = 7) -> Model:
    """Maximum conditional likelihood by scaled gradient steps. sample: text, lang.

    Sequences are runs of a text's words, all of its language; a share of them is joined from the halves of two, so that
    transitions learn how a language gives way to another one within a text.
    """
    languages = sorted(sample["lang"].unique())
    number, rng = {x: k for k, x in enumerate(languages)}, np.random.default_rng(seed)
    index: dict[str, int] = {}
    sequences, labels, seen = [], [], {}
    for text, lang in sample.sort_values(["lang", "text"])[["text", "lang"]].itertuples(index=False):
        words = [w for w in map(cleaned, text.split()) if w]
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        ids = [index.setdefault(w, len(index)) for w in words]
        for at in range(0, len(ids) - SEQUENCE + 1, SEQUENCE):
            sequences.append(ids[at : at + SEQUENCE])
            labels.append([number[lang]] * SEQUENCE)
        if 0 < len(ids) < SEQUENCE:  # a short text's words are repeated
            sequences.append((ids * SEQUENCE)[:SEQUENCE])
            labels.append([number[lang]] * SEQUENCE)
    x, y = np.array(sequences, np.int64).reshape(-1, SEQUENCE), np.array(labels, np.int64).reshape(-1, SEQUENCE)
    order, half = rng.permutation(len(x)), SEQUENCE // 2
    a, b = order[: int(len(x) * mixed_share)], order[::-1][: int(len(x) * mixed_share)]
    x, y = np.concatenate((x, np.concatenate((x[a, :half], x[b, half:]), axis=1))), np.concatenate((y, np.concatenate((y[a, :half], y[b, half:]), axis=1)))
    size, words = len(languages), list(index)
    lexicon = {w: k for k, w in enumerate(w for w in words if seen[w] >= 5)}
    rows, buckets, scale = [], [], np.ones(len(words))
    for at, found, holds in features(words):
        r, f = np.nonzero(holds)
        rows.append(at[r])
        buckets.append(found[r, f].astype(np.int64))
        scale[at] = 1 / np.sqrt(holds.sum(axis=1) + 1)
    row, bucket = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, buckets))
    factor = scale[row]
    listed = np.array([lexicon.get(w, -1) for w in words], np.int64)
    known = np.flatnonzero(listed >= 0)
    model = Model(languages, np.zeros((FEATURES, size)), lexicon, np.zeros((len(lexicon), size)), np.zeros((size, size)))
    truth = np.eye(size)[y]
    moved = np.zeros((size, size))
    np.add.at(moved, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    starts = np.bincount(y[:, 0], minlength=size) / size
    squares = [1e-8 + np.zeros_like(v) for v in (model.weights, model.words, model.steps)]
    for _ in range(rounds if len(x) else 0):
        scores = np.stack([np.bincount(row, model.weights[bucket, k] * factor, len(words)) for k in range(size)], axis=1)
        scores[known] += model.words[listed[known]]
        posterior, counts = forward_backward(scores[x], model.steps)
        slope = (truth - posterior).reshape(-1, size)
        by_word = np.stack([np.bincount(x.ravel(), slope[:, k], len(words)) for k in range(size)], axis=1)
        by_feature = np.stack([np.bincount(bucket, by_word[row, k] * factor, FEATURES) for k in range(size)], axis=1)
        by_listed = np.zeros_like(model.words)
        by_listed[listed[known]] = by_word[known]
        by_step = moved + starts[None, :] - counts
        for value, gradient, square, rate, decay in ((model.weights, by_feature, squares[0], 0.5, 0.02), (model.words, by_listed, squares[1], 0.5, 0.05), (model.steps, by_step, squares[2], 0.5, 0.5)):
            gradient = gradient - decay * value
            square += gradient**2
            value += rate * gradient / np.sqrt(square)
    model.weights = model.weights.astype(np.float32)
    return model


def labelled_sample(df: DataFrame, id_column: str, lang_column: str, text_column: str, usable, per_language: int, runs: int) -> pd.DataFrame:
    """At most ``runs`` runs of SEQUENCE words of each language, drawn by hash from everywhere in at most ``per_language`` labelled
    texts. Texts are chosen by a hash of the id, before any is read; their words are cut into runs in tasks."""
    ids = df.where(usable & F.col(lang_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"))
    counts = ids.groupBy("lang").count()
    draw = F.xxhash64("id", F.lit(11))
    share = F.pmod(draw, F.lit(1 << 20)) * F.col("count") < 4 * per_language * (1 << 20)
    few = ids.join(F.broadcast(counts), "lang").where(share)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(draw, "id"))
    chosen = few.select("id", "lang", rank.alias("rank")).where(F.col("rank") <= per_language).select("id", "lang")
    rows = df.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text")).join(F.broadcast(chosen), "id")
    words = rows.select("lang", F.split(F.trim("text"), r"\s+").alias("words"))
    starts = F.sequence(F.lit(1), F.size("words"), F.lit(SEQUENCE))
    cut = words.select("lang", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("words", k, SEQUENCE), " "))).alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    return cut.select("lang", "text", rank.alias("rank")).where(F.col("rank") <= runs).select("text", "lang").toPandas()


def train(df: DataFrame, usable, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text", per_language: int = 300, runs: int = 3000) -> Model:
    """A model fitted on a bounded sample of the rows for which ``usable`` holds."""
    return fit(labelled_sample(df, id_column, lang_column, text_column, usable, per_language, runs))


class Tagger:
    """Posteriors of the words of texts; emissions of words seen before are kept."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.move = np.exp(model.steps - model.steps.max(initial=-np.inf))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.used = 0
        self.factors = np.zeros((1024, len(self.model.languages)), np.float32)

    def learn(self, tokens: set[str]) -> None:
        fresh, words = [], []
        for token in tokens:
            word = cleaned(token)
            if word:
                fresh.append(token)
                words.append(word)
            else:
                self.number[token] = -1
        if not fresh:
            return
        base = self.used
        scores = self.model.emissions(words)
        factors = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))
        while base + len(fresh) > len(self.factors):
            self.factors = np.concatenate((self.factors, np.zeros_like(self.factors)))
        self.factors[base : base + len(fresh)] = factors
        self.number.update(zip(fresh, range(base, base + len(fresh))))
        self.used = base + len(fresh)

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
        """Posteriors of words with letters, borders of texts among them, all tokens, and the words' positions among them."""
        if len(self.number) > self.limit:
            self.clear()
        tokens = [x.split() for x in texts]
        self.learn(set(chain.from_iterable(tokens)) - self.number.keys())
        count = sum(map(len, tokens))
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(tokens)), np.int64, count)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        lettered = ids >= 0
        borders = np.concatenate(([0], np.concatenate(([0], np.cumsum(lettered)))[ends]))
        kept = ids[lettered]
        posterior = chunk_posteriors(self.factors[kept].astype(float), self.move, borders) if len(kept) else np.zeros((0, self.factors.shape[1]))
        return posterior, borders, tokens, np.flatnonzero(lettered)


def predict_languages(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``passed``, doc_id, lang_pred and score for each row of ``df``.

    The language is the one with the largest mean posterior over the text's words, which is the score. Without a letter
    (or null) it is 'und' with score 0; so it is if the model has learned nothing. Equal means go to the first language
    by name. Repeated rows and null ids are kept; other columns are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    extra = [f for f in df.schema.fields if f.name in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tagger = Tagger(model)
        for batch in slices(batches, "__text", 2 << 20):
            languages, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if model.languages and batch.num_rows:
                posterior, borders, _, _ = tagger.tag(batch.column("__text").to_pylist())
                sums = np.concatenate((np.zeros((1, len(model.languages))), np.cumsum(posterior, axis=0)))
                sums, lengths = sums[borders[1:]] - sums[borders[:-1]], np.diff(borders)
                best = np.round(sums / np.maximum(1, lengths)[:, None], 12)
                for k in np.flatnonzero(lengths).tolist():
                    languages[k] = model.languages[int(best[k].argmax())]
                    scores[k] = min(1.0, max(0.0, best[k].max()))
            columns = [*(batch.column(c) for c in range(batch.num_columns - 1)), pa.array(languages), pa.array(scores)]
            names = [*batch.schema.names[:-1], "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(*(F.col(f.name) for f in extra), F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("__text"))
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), "doc_id long, lang_pred string, score double"])
    return map_arrow(rows, run, shape)


def label_words(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Runs of words of one language in each text: doc_id, run, first_word, end_word, lang, score (mean posterior).

    Words count from 0 by white space; those without letters belong to the run before. A text without letters has no run.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("run", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tagger = Tagger(model)
        for batch in slices(batches, "text", 2 << 20):
            posterior, borders, tokens, places = tagger.tag(batch.column("text").to_pylist())
            offset = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
            rows = []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = posterior[borders[k] : borders[k + 1]]
                if not len(own):
                    continue
                best, at = own.argmax(axis=1), places[borders[k] : borders[k + 1]] - offset[k]
                turns = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
                ends = [*at[turns[1:]].tolist(), len(tokens[k])]
                stops = [*turns[1:].tolist(), len(own)]
                rows += [(doc, r, int(at[a]) if r else 0, e, model.languages[best[a]], float(own[a:s].max(axis=1).mean())) for r, (a, e, s) in enumerate(zip(turns, ends, stops))]
            if rows:
                yield table(schema, *zip(*rows))

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return map_arrow(rows, run, "doc_id long, run int, first_word long, end_word long, lang string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32 of the id modulo 3 is not 1, and labels all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_bucket("doc_id", 3) == 1
    model = train(docs, ~held_out)
    return predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
