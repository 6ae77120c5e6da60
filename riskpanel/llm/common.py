"""Word hashing and small helpers that several corpus operators share.

Words are maximal runs of bytes that are not separators, taken from UTF-8. A
block of documents is hashed with a few numpy passes: a word's hash is the
difference of two prefix sums of a polynomial over a random byte table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

# Bytes hashed in one pass; bounds the temporaries to a few tens of MB.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def separators(only_alphanumeric: bool = False) -> np.ndarray:
    """Which bytes end a word: ASCII white space, or every ASCII byte but letters and digits."""
    if not only_alphanumeric:
        return _SPACE
    table = np.zeros(256, bool)
    table[:128] = True
    for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        table[low:high] = False
    return table


def _random_words(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = _random_words(20240601, 256) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        table[0] = 1
        _powers[name] = table = np.cumprod(table, dtype=np.uint64)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(data: np.ndarray, fold: bool, sep: np.ndarray) -> np.ndarray:
    word = ~sep[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * _power_table("up", _BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table("down", _BASE_INVERSE, len(data))[starts])


def _pieces(data: bytes, sep: np.ndarray) -> Iterator[np.ndarray]:
    """Cut a long document at separators, near every BLOCK_BYTES."""
    whole = np.frombuffer(data, np.uint8)
    start = 0
    while start < len(whole):
        stop = min(len(whole), start + BLOCK_BYTES)
        while stop < len(whole):
            step = np.flatnonzero(sep[whole[stop : stop + 4096]])
            if len(step):
                stop += int(step[0])
                break
            stop = min(len(whole), stop + 4096)
        yield whole[start:stop]
        start = stop


def word_hashes(
    texts: Sequence[bytes], fold: bool = False, sep: np.ndarray = _SPACE
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, all word hashes, word bounds per text) for blocks of texts.

    ``fold`` lower-cases A-Z. The words of text ``first + i`` are
    ``hashes[bounds[i]:bounds[i + 1]]``. Empty texts have no words; a text of
    any length is one whole.
    """
    first = 0
    while first < len(texts):
        stop, size = first, 0
        while stop < len(texts) and (stop == first or size + len(texts[stop]) < BLOCK_BYTES):
            size += len(texts[stop]) + 1
            stop += 1
        block = texts[first:stop]
        if size > BLOCK_BYTES:
            hashes = np.concatenate([_hash_block(p, fold, sep) for p in _pieces(block[0], sep)] or [np.empty(0, np.uint64)])
            bounds = np.array([0, len(hashes)])
        else:
            data = np.frombuffer(b"\n".join(block), np.uint8)
            hashes = _hash_block(data, fold, sep)
            # Starts of words by byte, to count the words before each text.
            begins = np.flatnonzero(np.diff(np.concatenate(([False], ~sep[data])).view(np.int8)) == 1)
            edges = np.cumsum([0, *(len(t) + 1 for t in block)])
            bounds = np.searchsorted(begins, edges)
        yield first, hashes, bounds
        first = stop


def text_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column, null as empty."""
    return [t or b"" for t in column.cast("binary").to_pylist()]


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """The wanted columns and the text with null as empty."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever their case: underscores are added to those it has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# What empties the caches that a Python worker keeps between the tasks of an operator.
CACHES: list[Callable[[], None]] = []


def forget() -> None:
    """Empty the caches that other operators' tasks have left in this Python worker, before a task that needs its memory."""
    for clear in CACHES:
        clear()


class Remembered(dict):
    """Values of a function by key, bounded: beyond ``limit`` entries only those used again are kept."""

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.limit, self.older = function, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
