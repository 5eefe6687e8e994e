"""Exact token counts of a byte-pair vocabulary in linear time, without making identifiers.

The vocabulary is compiled into a matching automaton (a trie over bytes) and three tables: each token's longest
proper prefix that is a token, the two tokens that it was merged from, and the token that a pair merges to. A word is
read from left to right by its longest match; a match may follow the token before it only if byte-pair merging
would leave that pair apart. If it may not, the next shorter match is tried, and where none is left the last token
is taken back. A position from which no encoding can go on is marked, so that each is left at most once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts a worker keeps; beyond that it starts afresh.
MEMO = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with one base64 token and rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Vocabulary:
    """The compiled automaton and tables; small enough to broadcast, as its size is the vocabulary's."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.step: dict[int, int] = {}
        self.accept: list[int] = [-1]
        for token, rank in ranks.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                following = self.step.get(key)
                if following is None:
                    following = self.step[key] = len(self.accept)
                    self.accept.append(-1)
                state = following
            self.accept[state] = rank
        absent = bytes(b for b in range(256) if bytes([b]) not in ranks)
        self.lacking = b"[" + re.escape(absent) + b"]" if absent else b""
        self.shorter: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        for rank in sorted(self.tokens):
            token, left = self.tokens[rank], self.shorter[rank]
            self.parts[rank] = (rank, rank)
            while left >= 0:
                right = ranks.get(token[self.length[left] :])
                if right is not None and left < rank and right < rank and self.compatible(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
                left = self.shorter[left]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` as they are when they stand side by side.

        Both are taken apart again, the later merge first; the pair falls if two inner neighbours would have been
        merged before what stands between them was.
        """
        merged, parts, before = self.merged, self.parts, float("inf")
        while True:
            joint = merged.get((left, right))
            if joint is not None and joint < before:
                return False
            inner_left, inner_right = parts[left][1], parts[right][0]
            if left > right and inner_left != left:
                before, left = left, inner_left
            elif inner_right != right:
                before, right = right + 1, inner_right
            elif inner_left != left:
                before, left = left, inner_left
            else:
                return True

    def longest(self, word: bytes, at: int) -> int:
        """The longest token that ``word`` goes on with from ``at``; -1 if none."""
        step, accept, state, best = self.step, self.accept, 0, -1
        for i in range(at, len(word)):
            following = step.get(state << 8 | word[i])
            if following is None:
                break
            state = following
            if accept[state] >= 0:
                best = accept[state]
        return best

    def count(self, word: bytes) -> int:
        """The number of tokens of a word. A byte that is no token by itself counts as one and parts what is around it."""
        if self.lacking:
            parts = re.split(self.lacking, word)
            return len(parts) - 1 + sum(self._count(part) for part in parts if part)
        return self._count(word)

    def _count(self, word: bytes) -> int:
        """Of the tokens only their number is kept and, for each place that one ends at, the one that led there."""
        size, at, n = len(word), 0, 0
        open_ends, led = bytearray(b"\x01") * (size + 1), [-1] * (size + 1)
        token = self.longest(word, 0)
        while at < size:
            last = led[at]
            while token >= 0:
                end = at + self.length[token]
                if open_ends[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                led[end], at, n = token, end, n + 1
                token = self.longest(word, at)
            else:
                # Every byte is a token, so there is an encoding and the start is never left without one.
                open_ends[at] = 0
                token, n = last, n - 1
                at -= self.length[token]
                token = self.shorter[token]
        return n


class Counter:
    """Counts texts; keeps the counts of words that it has met."""

    def __init__(self, vocabulary: Vocabulary, words: str = WORDS) -> None:
        self.vocabulary, self.words, self.memo = vocabulary, regex.compile(words), {}

    def __call__(self, text: str | None) -> int | None:
        if text is None:
            return None
        memo, total = self.memo, 0
        for word in self.words.findall(text):
            n = memo.get(word)
            if n is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = memo[word] = self.vocabulary.count(word.encode("utf-8", "replace"))
            total += n
        return total


def token_counter(spark: SparkSession, path: str):
    """A function from a text column to its number of tokens; null for null, 0 for the empty text."""
    compiled = _broadcasts.get((spark.sparkContext.applicationId, path))
    if compiled is None:
        compiled = _broadcasts[spark.sparkContext.applicationId, path] = spark.sparkContext.broadcast(Vocabulary(read_ranks(path)))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = Counter(compiled.value)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="Int64")

    # Else a filter on the count would have every text counted twice.
    counted = tokens.asNondeterministic()

    def of(text: Column) -> Column:
        return counted(text)

    return of


_broadcasts: dict[tuple[str, str], object] = {}
