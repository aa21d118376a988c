"""Token counts of a unigram tokenizer, without making tokens.

The tokenizer puts a mark in place of every blank and before the text, cuts in front of
each mark, and cuts each word into the pieces with the best sum of scores. An
Aho-Corasick automaton finds all pieces that end at each place of a word; dynamic
programming carries only the best score, the number of pieces and whether the last one
is unknown; places that no piece reaches back to are let go. Ties: of pieces that end at one place with equal sums the longest stays;
a character without a piece of its own may be unknown, which wins only if it is
better; unknown characters in a row are one token, or one token per UTF-8 byte where the
vocabulary declares byte fallback. Byte pieces never match text. Words repeat, so counts are
remembered per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the tokenizer: the mark, and how far unknown lies below the least score.
MARK, UNKNOWN_BELOW = "▁", 10.0

#: Public vocabulary with scores; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: Places of a word that are held beyond the longest piece, characters of a text that are cut
#: into words at a time, and the longest word whose count is remembered.
HELD, STRETCH, REMEMBERED = 4_096, 1_000_000, 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of one message in the protocol buffer wire format."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield tag >> 3, value
        else:
            size, at = (_varint(data, at)) if kind == 2 else ({5: 4, 1: 8}[kind], at)
            yield tag >> 3, data[at : at + size]
            at += size


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores from a model file: a list of (piece 1, score 2, kind 3) in field 1."""
    with open(path, "rb") as f:
        data = f.read()
    found = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                found.append((piece[1].decode(), float(np.frombuffer(piece[2], "<f4")[0])))
    return found


def byte_fallback(path: str) -> bool:
    """Whether the model file declares byte fallback (field 35 of its trainer's, field 2) and has all byte pieces (kind 6)."""
    with open(path, "rb") as f:
        data = f.read()
    declared, pieces = False, 0
    for number, value in _fields(data):
        if number == 1:
            pieces += dict(_fields(value)).get(3, 1) == 6
        elif number == 2:
            declared = bool(dict(_fields(value)).get(35, 0))
    return declared and pieces == 256


class Counter(dict):
    """Number of tokens by word; counts a new word when it is asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]], fallback: bool = False) -> None:
        super().__init__()
        self.fallback = fallback
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        if vocabulary:
            self.pieces.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_BELOW
        self.empty = not vocabulary

    def __missing__(self, word: str) -> int:
        found = self.count_word(word)
        if len(word) <= REMEMBERED:
            if len(self) > 400_000:
                self.clear()
            self[word] = found
        return found

    def count_word(self, word: str) -> int:
        """Matches are read as they come and only the places that a piece can start from are
        held, so the memory does not grow with the word."""
        found = iter(()) if self.empty else self.pieces.iter(word)
        at, match = next(found, _NO_MATCH)
        # State of the places from ``gone`` on.
        best, count, strange, gone = [0.0], [0], [False], 0
        for end in range(1, len(word) + 1):
            matches = []
            while at == end - 1:
                matches.append(match)
                at, match = next(found, _NO_MATCH)
            # Longest first: the earliest start is met first and stays when sums are equal.
            matches.sort(reverse=True)
            top, n, odd, single = None, 0, False, False
            for size, score in matches:
                single = single or size == 1
                total = best[end - size - gone] + score
                if top is None or total > top:
                    top, n = total, count[end - size - gone] + 1
            if not single:
                total = best[-1] + self.unknown
                if top is None or total > top:
                    more = len(word[end - 1].encode()) if self.fallback else not strange[-1]
                    top, n, odd = total, count[-1] + more, True
            best.append(top)
            count.append(n)
            strange.append(odd)
            if len(best) > self.longest + HELD:
                gone += HELD
                del best[:HELD], count[:HELD], strange[:HELD]
        return count[-1]

    def count_text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if text[0] != MARK:
            text = MARK + text
        total, start = 0, 0
        while start < len(text):
            # Words of one stretch at a time; a stretch ends where a word does.
            end = text.find(MARK, start + STRETCH)
            end = len(text) if end < 0 else end
            total += sum(map(self.__getitem__, _WORDS.findall(text, start, end)))
            start = end
        return total


_NO_MATCH = (-1, None)
_WORDS = re.compile(f"{MARK}[^{MARK}]*")


def token_counts(docs: DataFrame, path: str = VOCABULARY, text: str = "text") -> Column:
    """Tokens of each whole text. The vocabulary, one file, is read on the driver and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((read_vocabulary(path), byte_fallback(path)))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(*shared.value)
        for batch in batches:
            yield pd.Series([counter.count_text(t) for t in batch], dtype="int64")

    return count(F.coalesce(F.col(text), F.lit("")))


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The documents with n_tokens.

    Null and empty texts have 0; texts are counted whole, whatever their length; repeated
    rows alike; no rows give no rows. An input column n_tokens is replaced.
    """
    kept = [c for c in docs.columns if c != "n_tokens"]
    return docs.select(*kept, token_counts(docs, path).alias("n_tokens"))
