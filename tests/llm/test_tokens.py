"""Token counts, encoding and decoding against the libraries."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from parley.llm import bpe_codec, token_counts
from parley.llm.common import vocabulary_path

from .conftest import ODD, counted, pairs

WORDS, BYTES = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}


def size(library, path, text):
    return len(library[path].encode(text, add_special_tokens=False).ids)


def test_counts_are_the_librarys(spark, docs, odd, library):
    for df in (docs, odd):
        got = token_counts.token_counts(df, WORDS).collect()
        want = [(i, len(t.encode()), size(library, WORDS, t)) for i, t in pairs(df)]
        assert counted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == counted(want)
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


@pytest.mark.parametrize("chunk, lookback", [(7, 512), (7, 2)])
def test_chunks_may_fall_anywhere(spark, docs, odd, library, chunk, lookback):
    """Also where most entry states are guessed wrong at first."""
    for df in (docs.limit(12), odd.where("length(text) < 5000")):
        got = token_counts.token_counts(df, WORDS, chunk=chunk, lookback=lookback).collect()
        assert counted((r["doc_id"], r["n_tokens"]) for r in got) == counted((i, size(library, WORDS, t)) for i, t in pairs(df))


def test_words_longer_than_chunks(spark, library):
    texts = ["ab" * 3000, "中文字符很长的文本没有空格" * 200, "<|endoftext|>" * 300 + "x" * 2000, "9" * 900 + "é" * 900, "tokenization" * 400 + " end", " " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, lookback in ((500, 100), (1000, 3), (400, 0)):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, WORDS, chunk=chunk, lookback=lookback).collect()}
        assert got == {i: size(library, WORDS, t) for i, t in enumerate(texts)}


def test_maps_compose_in_any_grouping():
    counter = token_counts.Counter(WORDS)
    symbols = counter.symbols("unbelievable reinterpretation of transliterations, again")
    maps = [counter.chunk_map(before, own) for _, before, own, _ in token_counts.cut_symbols(symbols, 5, 512)]
    start, fst = counter.transducer.name(counter.transducer.START), counter.transducer
    one = maps[0]
    for m in maps[1:]:
        one = token_counts.compose(one, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = token_counts.compose(m, right)
    assert one[start] == right[start] == token_counts.scan(maps)[-1][start] == (start, fst.run(fst.START, symbols.tolist())[1])


def test_random_strings(library):
    rng, counter, codec = random.Random(5), token_counts.Counter(WORDS), bpe_codec.Codec(BYTES)
    letters = "aabbeehnt  'sSlLΣσéı1²½٣中  \x1c\x00\n\t.,<|endoftext|>😀-"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 24)))
        assert counter.text(text) == size(library, WORDS, text), repr(text)
        want = library[BYTES].encode(text, add_special_tokens=False).ids
        ids = codec.encode(text)
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == want, repr(text)


def test_ids_and_decoding(spark, docs, odd, library):
    for df in (docs, odd):
        got = bpe_codec.encode_texts(df, BYTES).collect()
        want = []
        for i, t in pairs(df):
            ids = library[BYTES].encode(t, add_special_tokens=False).ids
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            back = library[BYTES].decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert counted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == counted(want)


def test_decoding_of_broken_ids(spark, library):
    ids = [[255], [187, 222], [], [50256, 5], [10930, 222, 98]]
    df = spark.createDataFrame([(k, b"".join(x.to_bytes(4, "little") for x in v)) for k, v in enumerate(ids)] + [(9, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: r["text"] for r in bpe_codec.decode_ids(df, BYTES).collect()}
    assert got == {k: library[BYTES].decode(v, skip_special_tokens=False) for k, v in enumerate(ids)} | {9: ""}


def test_empty_tables(empty):
    assert token_counts.token_counts(empty, WORDS).count() == bpe_codec.encode_texts(empty, BYTES).count() == 0
    assert len(ODD) > 10
