"""Exact byte-pair encoding and decoding by dynamic programming over prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import merges
from parley.llm.common import Memo, map_arrow, raw_texts, slices, table, vocabulary_path, whole_text

#: Fixed value: the vocabulary's pattern of pieces.
PIECES = regex.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{merges.SPACE}\p{{L}}\p{{N}}]+|[{merges.SPACE}]+(?![^{merges.SPACE}])|[{merges.SPACE}]+"
)
#: White space that a space follows, or a space at the end: its pieces depend on what stands beside it.
SPACE_RUN = regex.compile(rf"[{merges.SPACE}] | \Z")


class Codec:
    """Encodes and decodes with a byte-level vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = v = merges.load(path)
        #: Reports, for each end in a text, every token that ends there, the longest first.
        self.matcher = ahocorasick.Automaton()
        for token, symbols in v.spelling.items():
            if v.stands[token]:
                self.matcher.add_word(bytes(symbols).decode("latin-1"), (len(symbols), token))
        self.matcher.make_automaton()
        self.pieces, self.runs = Memo(self._piece, 700_000), Memo(self._run, 500_000)
        spelling = {t: bytes(s) for t, s in v.spelling.items()} | {t: s.encode() for s, t in v.specials.items()}
        self.spelling = [spelling.get(t, b"") for t in range(max(spelling) + 1)]
        self.special_ids = {s: np.array([t], "<u4").tobytes() for s, t in v.specials.items()}

    def prefixes(self, piece: bytes) -> list[int]:
        """The last token of the encoding of each prefix; -1 for the empty one.

        Of the tokens that end at a prefix's end exactly one can stand beside the last token of the rest.
        """
        last, beside, done = [-1] * (len(piece) + 1), self.vocabulary.beside, -1
        for end, (size, token) in self.matcher.iter(piece.decode("latin-1")):
            if done != end:
                before = last[end + 1 - size]
                if before < 0 or beside[before << 20 | token]:
                    last[end + 1], done = token, end
        return last

    def piece_ids(self, piece: bytes) -> list[int]:
        last, ids, at = self.prefixes(piece), [], len(piece)
        while at:
            ids.append(last[at])
            at -= len(self.spelling[last[at]])
        return ids[::-1]

    def _piece(self, piece: str) -> bytes:
        return np.array(self.piece_ids(piece.encode()), "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(" " + run)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        What stands between two single spaces is cut into the same pieces wherever it occurs, so it is memorised whole.
        """
        if not any(s in text for s in self.special_ids):
            if SPACE_RUN.search(text):
                return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))
            first, *runs = text.split(" ")
            return b"".join([*map(self.pieces.__getitem__, PIECES.findall(first)), *map(self.runs.__getitem__, runs)])
        parts, at = [], 0
        for m in self.vocabulary.special_pattern.finditer(text):
            parts += [*map(self.pieces.__getitem__, PIECES.findall(text[at : m.start()])), self.special_ids[m[0]]]
            at = m.end()
        return b"".join([*parts, *map(self.pieces.__getitem__, PIECES.findall(text[at:]))])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; bytes that are no valid text are replaced."""
        raw = b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()

    def trim(self) -> None:
        for memo in (self.pieces, self.runs, self.vocabulary):
            memo.trim()

    def clear(self) -> None:
        """Forget what was memorised, also in the vocabulary, which other codecs of the process share."""
        for memo in (self.pieces, self.runs, self.vocabulary.beside):
            memo.clear()


def encode_texts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", keep: bool = True) -> DataFrame:
    """For each row of ``df``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``keep``, ids (binary, little-endian
    unsigned 32-bit) and decoded (string).

    A null or empty text has no ids and decodes to the empty text. Repeated rows and null ids are kept; other columns
    are not read. White space and single characters of any length are pieces as the vocabulary's pattern has them.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.binary()), ("decoded", pa.string())] * keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = Codec(path), lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches, "text", 4 << 20):
            ids = [codec.encode(x) for x in batch.column("text").to_pylist()]
            decoded = [codec.decode(x) for x in ids]
            columns = [batch.column("doc_id"), [len(x) // 4 for x in ids], [*map(sha, ids)], [*map(sha, decoded)]]
            yield table(schema, *columns, *([ids, [x.decode() for x in decoded]] if keep else []))
            codec.trim()
        codec.clear()

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep)


def decode_ids(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and the decoded text of each row's ids (binary, little-endian unsigned 32-bit); null ids decode to the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in slices(batches, "ids"):
            yield table(schema, batch.column("doc_id"), [codec.decode(x).decode() for x in raw_texts(batch.column("ids"))])

    return map_arrow(df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).alias("ids")), run, "doc_id long, text string")


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("byte_bpe_50k.json"), keep=False)
