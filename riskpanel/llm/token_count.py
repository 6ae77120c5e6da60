"""Token counts by byte-pair merging without identifiers.

A text is cut at ASCII white space, which no normaliser or split rule of the
vocabulary crosses; counts of pieces and of their words are remembered within
bounds, so a frequent word is merged once per worker. Merging pops the lowest-rank adjacent pair
from a heap over a linked list; the count is initial symbols minus merges.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import CACHES, Remembered, text_bytes, with_text

# Pieces and words remembered per Python worker; more are computed again, with the same result.
CACHE_ENTRIES = 150_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [], 256
    for byte in range(256):
        if byte in plain:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging the lowest-rank pairs first, leftmost on ties."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n and (rank := ranks.get((symbols[left], symbols[right]))) is not None:
            heapq.heappush(heap, (rank, left, symbols[left], symbols[right]))

    for i in range(n - 1):
        offer(i)
    merges = 0
    while heap:
        _, left, a, b = heapq.heappop(heap)
        right = after[left] if symbols[left] == a else n
        if right >= n or symbols[right] != b:
            continue  # one of the two has been merged meanwhile
        symbols[left], symbols[right] = a + b, ""
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
        merges += 1
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return n - merges


class Splitter:
    """Cuts UTF-8 texts as the vocabulary file's normaliser and split rule do.

    ``values`` of a white-space piece are remembered, and so are those of its
    words; ``word_value`` and ``join`` say what they are.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        # Special strings in a text stand for themselves and end the pieces beside them.
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(map(regex.escape, special))})".encode())
        # Bytes that every special string starts with: a text without them holds none.
        self.mark = os.path.commonprefix(special).encode() if special else None
        self.values = Remembered(self.piece_value, cache_entries)
        self.words = Remembered(self.word_value, cache_entries)
        self.spec = spec

    def normal(self, piece: bytes) -> str:
        text = piece.decode()
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text)  # by character: no rule for final letters

    def piece_value(self, piece: bytes):
        if not self.may_hold_special(piece):
            return self.join([self.words[w] for w in self.split.findall(self.normal(piece))])
        found = []
        for k, part in enumerate(self.special.split(piece)):
            if k % 2:
                found.append(self.special_value(part.decode()))
            elif part:
                found += [self.words[w] for w in self.split.findall(self.normal(part))]
        return self.join(found)

    def may_hold_special(self, text: bytes) -> bool:
        return self.mark is not None and self.mark in text

    def pieces(self, text: bytes):
        """Values of the white-space pieces. A special string keeps its case, so texts without one are folded first."""
        return map(self.values.__getitem__, (text if self.may_hold_special(text) else text.lower()).split())


class TokenCounter(Splitter):
    """Counts tokens of UTF-8 texts for a byte-level vocabulary file with word ends."""

    join = staticmethod(sum)

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        super().__init__(path, cache_entries)
        spec = self.spec
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocabulary = model["vocab"].keys()
        self.letters = byte_letters()

    def special_value(self, text: str) -> int:
        return 1

    def word_value(self, text: str) -> int:
        """Tokens of one word."""
        symbols = [self.letters[b] for b in text.encode()]
        symbols[-1] += self.suffix
        return merge_count([s for s in symbols if s in self.vocabulary], self.ranks)

    def count(self, text: bytes) -> int:
        return sum(self.pieces(text))


@functools.lru_cache(2)
def counter_of(vocabulary: str) -> TokenCounter:
    """One counter per Python worker, kept between its tasks."""
    return TokenCounter(vocabulary)


CACHES.append(counter_of.cache_clear)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_column: str = "doc_id") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one per input row.

    A null or empty text has 0 bytes and 0 tokens; repeated rows are each
    returned; a null id stays null; further columns are not read. ``vocabulary``
    is a file that every executor can read, such as one of an installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([counter.count(t) for t in texts], pa.int64()),
                ],
                names=["id", "n_bytes", "n_tokens"],
            )

    key = docs.schema[id_column].dataType.simpleString()
    counted = with_text(docs, id_column).mapInArrow(run, f"id {key}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
