"""Merge tables of a byte-pair vocabulary and the test whether two tokens can stand side by side."""

from __future__ import annotations

import json
from functools import cache

import regex

from parley.llm.common import Memo

#: White space as Unicode's White_Space property has it (the control characters 1C to 1F are no part of it).
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


@cache
def byte_letters() -> tuple[str, ...]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return tuple(letters[b] for b in range(256))


class Vocabulary:
    """A merge-based vocabulary: tokens as symbol tuples, and the merge that made each of them.

    Symbols are 0 to 255 for bytes; where the vocabulary marks word ends, 256 to 511 are the
    bytes that end a word.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, bytes_of = data["model"], {c: b for b, c in enumerate(byte_letters())}
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.specials)))
        self.ids = model["vocab"]
        self.spelling: dict[int, tuple[int, ...]] = {}
        for token, number in self.ids.items():
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            symbols = [bytes_of[c] for c in (token[: -len(self.suffix)] if ends else token)]
            if ends:
                symbols[-1] += 256
            self.spelling[number] = tuple(symbols)
        #: Of a token: the rank of the merge that makes it (-1 for a single symbol) and its two parts.
        self.rank = dict.fromkeys(self.spelling, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair, made = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.merge_rank[pair] = rank
            if made not in self.parts:
                self.rank[made], self.parts[made] = rank, pair
        self.beside = Memo(self._beside, 600_000)
        self.stands = Memo(self._stands)

    def _stands(self, token: int) -> bool:
        """Whether the token's own spelling is encoded as that one token."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self.stands[a] and self.stands[b] and self._first_merge(a, b) == self.rank[token]

    def _first_merge(self, a: int, b: int) -> int | None:
        """The merge that first crosses the border of two tokens when their joint spelling is encoded; None if none does.

        The pieces at the border are followed back in time. A piece on the left vanishes when it merges with its own
        left neighbour, one on the right when it merges with its right neighbour; a merge across the border happens if
        its rank comes before both. Equal ranks are applied from left to right.
        """
        left_ends = right_ends = len(self.merge_rank)
        found = None
        while True:
            rank = self.merge_rank.get((a, b))
            if rank is not None and rank < left_ends and rank <= right_ends:
                found = rank
            if self.rank[a] < 0 and self.rank[b] < 0:
                return found
            if self.rank[a] > self.rank[b]:  # of equals, the right one came later
                left_ends, a = self.rank[a], self.parts[a][1]
            else:
                right_ends, b = self.rank[b], self.parts[b][0]

    def _beside(self, pair: int) -> bool:
        """pair: the first token's id, moved up 20 bits, with the second's."""
        return self._first_merge(pair >> 20, pair & 0xFFFFF) is None

    def trim(self) -> None:
        self.beside.trim()


@cache
def load(path: str) -> Vocabulary:
    """The vocabulary, read once in each worker process."""
    return Vocabulary(path)
