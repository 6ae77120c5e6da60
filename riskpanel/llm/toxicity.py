"""Toxicity scores from class-conditional Kneser-Ney word models.

Two bigram models, toxic and ordinary, are counted over all labelled training
documents. A word's probability in a class interpolates the class's discounted
bigram with the bigram model that both classes share, tilted by the class's own
discounted continuation counts, so that expressions rare in one class fall back
to the same ground. A document's evidence is its length-normalised log-likelihood difference,
over the whole text and over its most toxic words; a logistic curve, fitted on
training documents scored by models that have not counted them, turns both into a score.

Counting is exact and grouped by Spark, and the counted tables stay there. The
n-grams counted most often, up to a stated number, are broadcast with a sieve of
all others, so what is broadcast has a proven size. A text's n-grams that are not
among them but pass the sieve are joined to the tables, so every counted n-gram
has its value in every text, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_to_table, drop_table, freeing_shuffles, input_bytes
from .common import forget, free_names, mix, partitions, separators, text_bytes, with_text, word_hashes

# Counted words (two floats and a key) and bigrams (one float and a key) that are broadcast at most, 59 MB;
# the sieve of each has up to 2^SIEVE_BITS bits, 8 MB. What is beyond them is joined.
HELD_WORDS = 1 << 21
HELD_BIGRAMS = 1 << 21
SIEVE_BITS = 26
# Bigrams that a task gathers before it merges and deals them out, fewer where each has many sums or none are merged.
GATHERED, GATHERED_SUMS, GATHERED_OPEN = 1 << 19, 1 << 18, 1 << 18
# Bigrams valued at once, which takes some 200 bytes of each.
VALUED = 1 << 15
# Bigrams or tokens in a row of packed ones at most: a row of a few hundred KB is no burden for the heap.
PACKED = 1 << 13
# A bucket of bigrams for so many bytes of input files at least, where the session's partitions are fewer.
BUCKET_INPUT = 16 << 20
# Open bigrams are settled in so many rounds, each with its share of the buckets, which bounds what is on disk at once.
ROUNDS = 3
# Labelled rows at most that the two-feature curve is fitted on.
CURVE_ROWS = 20_000
# Label rows up to this many are broadcast; more are joined by shuffle.
MAX_BROADCAST_LABELS = 2_000_000
# The words that say most for toxicity: this share of a text, and no fewer than so many.
SHARP_SHARE = 0.015
SHARP_LEAST = 2
# Words without evidence that every text is taken to have besides its own.
PRIOR_WORDS = 8
_SEPARATORS = separators(only_alphanumeric=True)
MODELS = ("toxic", "ordinary", "shared")
# What is known of a word: its share in each model, and as a left neighbour what it leaves over and one over its count.
WORD_STATS = [f"{c}_share" for c in MODELS]
LEFT_STATS = [f"{c}_{x}" for c in MODELS for x in ("left", "one")]
# What is summed over a token's bigrams: as their word, then as their left neighbour.
TOKEN_SUMS = ["toxic_k", "ordinary_k", "toxic_none", "ordinary_none", "weight", "as_word"]
TOKEN_SUMS += ["toxic_all", "ordinary_all", "toxic_types", "ordinary_types", "shared_types"]
# The halves of the labelled rows that models are made of.
HALVES = ((0,), (1,), (0, 1))


def _grams(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left neighbour (0 at a start) and bigram key of every word; its low bits are the slot."""
    left = np.concatenate((np.zeros(1, np.uint64), words[:-1])) if len(words) else words
    starts = bounds[:-1][bounds[:-1] < len(words)]
    left[starts] = 0
    return left, _grams_of(left, words)


def _grams_of(left: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((left << np.uint64(23)) | (left >> np.uint64(41))) ^ words


def gram_key(left: Column, word: Column) -> Column:
    """The same bigram key as an expression."""
    return F.shiftleft(left, 23).bitwiseOR(F.shiftrightunsigned(left, 41)).bitwiseXOR(word)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each key by its high bits, so that a bucket holds a range of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers by the significance of their bytes: the high ones are mostly 0 and compress."""
    return np.ascontiguousarray(values, np.int32).reshape(-1).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)


def _joint(column: pa.Array | pa.ChunkedArray, kind: type | None = None) -> np.ndarray:
    """The arrays of a column of packed ones, one after the other; whole numbers in planes without ``kind``."""
    parts = [_from_planes(x) if kind is None else np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, kind or np.int32), *parts])


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def _dealt(buckets: np.ndarray, *columns: np.ndarray, most: int | None = None) -> Iterator[tuple]:
    """Yield each bucket with its rows of the columns, in pieces of at most ``most``."""
    order = np.argsort(buckets, kind="stable")
    buckets, columns = buckets[order], [c[order] for c in columns]
    starts = _starts(buckets)
    for a, b in zip(starts, [*starts[1:], len(buckets)]):
        step = most or b - a
        for k in range(a, b, step):
            yield int(buckets[a]), *(c[k : min(k + step, b)] for c in columns)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, schema)], schema=schema)


_PACKED = pa.schema([("bucket", pa.int32()), ("history", pa.binary()), ("word", pa.binary()), ("n", pa.binary())])
_COUNTED = _PACKED.append(pa.field("sizes", pa.list_(pa.int64())))


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct bigrams in the order of their keys: key, history, word, and the four counts summed."""
    gram, left, words, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    at = _starts(gram)
    n = np.add.reduceat(n[order], at, axis=0) if len(at) else n
    return gram[at], left[order[at]], words[order[at]], n


def _of_halves(n: np.ndarray, halves: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and ordinary counts in these halves."""
    return sum(n[:, 2 * h] for h in halves), sum(n[:, 2 * h + 1] for h in halves)


def count_bigrams(labelled: DataFrame, n_buckets: int) -> DataFrame:
    """The bigrams of all rows of (text, toxic, half), packed by buckets in the order of their keys.

    Rows (bucket, history, word, n, sizes): ``n`` holds the counts toxic_0,
    ordinary_0, toxic_1, ordinary_1 of each, and ``sizes`` the row's sums of
    these, then of each of HALVES and class the number counted once and twice.
    """

    def packed(bucket: int, left: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple:
        return bucket, left.tobytes(), words.tobytes(), _planes(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            gram, left, words, n = _merged(held)
            held.clear()
            return _rows([packed(*x) for x in _dealt(buckets_of(gram, n_buckets), left, words, n, most=PACKED)], _PACKED)

        forget()
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            texts = text_bytes(batch.column(0))
            label, half = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (1, 2))
            part = 2 * half + 1 - label
            for first, words, bounds in word_hashes(texts, True, _SEPARATORS):
                if not len(words):
                    continue
                left, gram = _grams(words, bounds)
                of_word = np.repeat(part[first : first + len(bounds) - 1], np.diff(bounds))
                keys, at, group = np.unique(gram, return_index=True, return_inverse=True)
                counts = np.bincount(4 * group + of_word, minlength=4 * len(keys)).reshape(-1, 4).astype(np.int32)
                held.append((keys, left[at], words[at], counts))
                if sum(len(x[0]) for x in held) >= GATHERED:
                    yield flush()
        if held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        forget()
        left, words = (_joint(table.column(c), np.uint64) for c in ("history", "word"))
        n = _joint_counts(table.column("n"), 4)
        _, left, words, n = _merged([(_grams_of(left, words), left, words, n)])
        rows = []
        for a in range(0, len(left), PACKED):
            some = n[a : a + PACKED].astype(np.int64)
            sizes = [*some.sum(0), *((c == k).sum() for h in HALVES for c in _of_halves(some, h) for k in (1, 2))]
            rows.append((*packed(table.column("bucket")[0].as_py(), left[a : a + PACKED], words[a : a + PACKED], n[a : a + PACKED]), [int(x) for x in sizes]))
        return pa.Table.from_batches([_rows(rows, _COUNTED)])

    schema = "bucket int, history binary, word binary, n binary"
    return labelled.mapInArrow(run, schema).groupBy("bucket").applyInArrow(total, f"{schema}, sizes array<bigint>")


def _joint_counts(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Packed counts as rows of ``width`` numbers."""
    return np.concatenate([np.zeros((0, width), np.int32), *(_from_planes(x).reshape(-1, width) for x in column.to_pylist())])


def rows_of(counts: DataFrame, halves: tuple[int, ...]) -> DataFrame:
    """Rows (history, word, toxic, ordinary) of the bigrams that these halves hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, ordinary = _of_halves(_joint_counts(batch.column("n"), 4), halves)
            held = toxic + ordinary > 0
            columns = [_joint(batch.column(c), np.int64)[held] for c in ("history", "word")] + [toxic[held], ordinary[held]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["history", "word", "toxic", "ordinary"])

    return counts.select("history", "word", "n").mapInArrow(run, "history bigint, word bigint, toxic int, ordinary int")


def _thinned(n: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected count, and probability to be seen at all, if each occurrence is kept with ``share``."""
    return n * share, 1.0 - (1.0 - share) ** n if share < 1 else (n > 0).astype(float)


def token_sums(counts: DataFrame, halves: tuple[int, ...], share: dict[str, float], n_buckets: int) -> DataFrame:
    """Rows (word, *TOKEN_SUMS), one per word or left neighbour of the bigrams that these halves hold."""
    n_word = TOKEN_SUMS.index("as_word") + 1

    def added(keys: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        tokens, group = np.unique(keys, return_inverse=True)
        return tokens, [np.bincount(group, x, len(tokens)) for x in sums]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            left, words, toxic, ordinary = (np.concatenate(x) for x in zip(*held))
            held.clear()
            (n_t, seen_t), (n_o, seen_o) = _thinned(toxic.astype(float), share["toxic"]), _thinned(ordinary.astype(float), share["ordinary"])
            both = 1.0 - (1.0 - seen_t) * (1.0 - seen_o)
            none = [np.log(np.maximum(1.0 - x, 1e-12)) for x in (seen_t, seen_o)]
            own, of_word = added(words, [seen_t, seen_o, *none, n_t + n_o, np.ones(len(words))])
            before, of_left = added(left, [n_t, n_o, seen_t, seen_o, both])
            tokens = np.union1d(own, before)
            sums = np.zeros((len(tokens), len(TOKEN_SUMS)))
            sums[np.searchsorted(tokens, own), :n_word] = np.column_stack(of_word)
            sums[np.searchsorted(tokens, before), n_word:] = np.column_stack(of_left)
            rows = [(k, t.tobytes(), np.ascontiguousarray(x.T).tobytes()) for k, t, x in _dealt(buckets_of(tokens, n_buckets), tokens, sums, most=PACKED // 2)]
            return _rows(rows, pa.schema([("bucket", pa.int32()), ("word", pa.binary()), ("sums", pa.binary())]))

        forget()
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            toxic, ordinary = _of_halves(_joint_counts(batch.column("n"), 4), halves)
            some = toxic + ordinary > 0
            held.append(tuple(x[some] for x in (*(_joint(batch.column(c), np.uint64) for c in ("history", "word")), toxic, ordinary)))
            if sum(len(x[0]) for x in held) >= GATHERED_SUMS:
                yield flush()
        if held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x).reshape(len(TOKEN_SUMS), -1) for x in table.column("sums").to_pylist()]
        tokens, sums = added(_joint(table.column("word"), np.uint64), list(np.concatenate(parts, axis=1)))
        return pa.Table.from_arrays([pa.array(tokens.view(np.int64)), *map(pa.array, sums)], names=["word", *TOKEN_SUMS])

    rows = counts.select("history", "word", "n").mapInArrow(partial, "bucket int, word binary, sums binary")
    return rows.groupBy("bucket").applyInArrow(total, "word bigint, " + ", ".join(f"{c} double" for c in TOKEN_SUMS))


def _discount(once: float, twice: float) -> float:
    """Kneser-Ney discount n1 / (n1 + 2 n2), kept between 0.1 and 0.95."""
    return min(0.95, max(0.1, (once + 0.5) / (once + 2 * twice + 1.0)))


def _least(down: list[tuple[int, int]], most: int) -> tuple[int | None, bool]:
    """Of (weight, number of rows) from the highest, the least weight that ``most`` rows allow, and whether these are all."""
    kept, least = 0, None
    for weight, n in down:
        if kept + n > most:
            return least, False
        kept, least = kept + n, weight
    return least, True


def _top_counted(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The rows of the highest ``weight``, as many whole weights as ``most`` rows allow, and whether these are all."""
    down = df.groupBy("weight").count().orderBy(F.col("weight").desc()).limit(most + 1).collect()
    least, whole = _least([tuple(row) for row in down], most)
    return (df if whole else df.where(F.col("weight") >= least) if least is not None else df.limit(0)), whole


def _sieve_bits(n: int) -> int:
    return min(SIEVE_BITS, max(6, n.bit_length() + 4))


def _in_sieve(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


class Held:
    """Values of the n-grams counted most often by key, and a sieve that all counted ones pass; None if all are held."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, sieve: np.ndarray | None):
        self.keys, self.values, self.sieve = keys, values, sieve

    @classmethod
    def fetch(cls, df: DataFrame, key: Column, most: int, *columns: str) -> Held:
        """Take up to ``most`` rows of ``df`` and a sieve of at most 2^SIEVE_BITS bits to the driver."""
        top, whole = _top_counted(df, most)
        got = top.select(key.alias("key"), *columns).toArrow()
        keys = got.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        values = np.stack([got.column(c).to_numpy()[order] for c in columns]).astype(np.float32)
        if whole:
            return cls(keys[order], values, None)
        bits = _sieve_bits(df.count())
        at = df.select(_in_sieve(key, bits).alias("at")).select((F.col("at") / 64).cast("int").alias("lane"), (F.col("at") % 64).cast("int").alias("bit"))
        lanes = at.groupBy("lane").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
        sieve = np.zeros(1 << (bits - 6), np.uint64)
        sieve[lanes.column("lane").to_numpy()] = lanes.column("bits").to_numpy().view(np.uint64)
        return cls(keys[order], values, sieve)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the keys (0 where not held), whether held, and whether only the tables can tell."""
        # Distinct keys in order are looked up much faster.
        keys, group = np.unique(keys, return_inverse=True)
        values, held = self._values(keys)
        if self.sieve is None:
            return values[:, group], held[group], np.zeros(len(group), bool)
        at = keys >> np.uint64(64 - (64 * len(self.sieve)).bit_length() + 1)
        passed = (self.sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return values[:, group], held[group], (passed.astype(bool) & ~held)[group]

    def _values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros((len(self.values), len(keys)), np.float32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = self.keys[at] == keys
        return np.where(held, self.values[:, at], np.float32(0)), held


class Words(Held):
    """All counted words with what is known of them, by numbers into the distinct values, as most words share theirs."""

    def __init__(self, keys: np.ndarray, as_left: tuple[np.ndarray, np.ndarray], as_word: tuple[np.ndarray, np.ndarray]):
        self.keys, self.sieve = keys, None
        (self.left_stats, self.left_code), (self.word_stats, self.word_code) = as_left, as_word
        of = dict(zip(LEFT_STATS + WORD_STATS, [*self.left_stats, *self.word_stats]))
        log = {c: np.log(x.astype(np.float64)) for c, x in of.items()}
        self.left, self.own = ((log[f"toxic_{x}"] - log[f"ordinary_{x}"]).astype(np.float32) for x in ("left", "share"))

    @classmethod
    def fetch_all(cls, every: DataFrame) -> Words:
        """Take the rows (word, *WORD_STATS, *LEFT_STATS) to the driver, one group of values after the other."""
        coded, keys = [], np.zeros(0, np.uint64)
        for names in (LEFT_STATS, WORD_STATS):
            got = every.select("word", *names).toArrow()
            keys = got.column("word").to_numpy().view(np.uint64)
            order = np.argsort(keys)
            stats, code = _coded(np.stack([got.column(c).to_numpy() for c in names]))
            coded.append((stats, code[order]))
            keys = keys[order]
            del got
            pa.default_memory_pool().release_unused()
        return cls(keys, *coded)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of counted words."""
        return np.searchsorted(self.keys, keys).astype(np.int32)

    def stats(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        """WORD_STATS of the words and LEFT_STATS of the histories with these numbers."""
        return np.concatenate([self.word_stats[:, self.word_code[word]], self.left_stats[:, self.left_code[history]]])

    def _values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros((2, len(keys)), np.float32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = self.keys[at] == keys
        return np.stack([np.where(held, x, np.float32(0)) for x in (self.left[self.left_code[at]], self.own[self.word_code[at]])]), held


def _coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of ``rows``, and the number of each column's."""
    key = np.zeros(rows.shape[1], np.uint64)
    for row in rows:
        key = mix(key ^ row.astype(np.float32).view(np.uint32).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    _, at, code = np.unique(key, return_index=True, return_inverse=True)
    return rows[:, at].astype(np.float32), code.astype(np.int32)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def _few(n: int) -> int:
    """How many of ``n`` words are the sharpest."""
    return min(n, max(SHARP_LEAST, math.ceil(SHARP_SHARE * n)))


def _few_of(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, np.maximum(SHARP_LEAST, np.ceil(SHARP_SHARE * n).astype(np.int64)))


def _highest(values: np.ndarray, few: int) -> np.ndarray:
    return np.partition(values, len(values) - few)[len(values) - few :] if 0 < few < len(values) else values


@dataclass
class Model:
    """Log-likelihood differences of counted bigrams and words, and the curve that turns evidence into a score.

    A counted bigram has its own difference; any other has the sum of what its
    left neighbour leaves over and what its word has, each 0 if not counted.
    """

    words: Held  # what is left over as a left neighbour, and the word's own
    bigrams: Held
    curve: np.ndarray  # intercept and weights of the score
    share: dict[str, float]  # of each class's occurrences that its counts are thinned to
    discount: float
    n_buckets: int
    packed: DataFrame | None = None  # the bigrams with their counts in buckets, where all words are held
    word_table: DataFrame | None = None  # else (word, left, own)
    bigram_table: Callable[[DataFrame], DataFrame] | None = None  # and (history, word, value) of the wanted bigrams, at least
    scratch: tuple[DataFrame, ...] = ()  # written tables behind these
    shared: Broadcast | None = None

    @property
    def whole(self) -> bool:
        """Whether all counted n-grams are held, so that no join is needed."""
        return self.words.sieve is None and self.bigrams.sieve is None

    def __getstate__(self) -> dict:
        """What a broadcast carries: all but the tables."""
        return {**self.__dict__, "packed": None, "word_table": None, "bigram_table": None, "scratch": (), "shared": None}

    def share_out(self, spark: SparkSession) -> Broadcast:
        """The model in the tasks, once for all that read it."""
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(self)
        return self.shared

    def drop(self) -> None:
        """Delete the tables behind a model whose scores have all been read, and its copies if no plan still needs them."""
        for table in self.scratch:
            drop_table(table)
        if self.shared is not None and not self.whole:
            self.shared.destroy()
            self.shared = None

    def _block(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """The difference of each word as far as held, which are open, left neighbours, bigrams."""
        start, _, start_open = self.words.find(np.zeros(1, np.uint64))
        left, gram = _grams(words, bounds)
        (as_left, own), _, word_open = self.words.find(words)
        before, before_open = np.roll(as_left, 1), np.roll(word_open, 1)
        starts = bounds[:-1][bounds[:-1] < len(words)]
        before[starts], before_open[starts] = start[0], start_open
        (value,), held, open_ = self.bigrams.find(gram)
        each = np.where(held, value.astype(np.float64), before.astype(np.float64) + own)
        return each, open_ | ~held & (word_open | before_open), left, gram

    def differences(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per text with words: its index, the difference of each word as far as held, which are open, left neighbours, words."""
        for first, words, bounds in word_hashes(texts, True, _SEPARATORS):
            if not len(words):
                continue
            each, open_, left, _ = self._block(words, bounds)
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if a < b:
                    yield first + i, each[a:b], open_[a:b], left[a:b], words[a:b]

    def evidence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Difference per word over the whole text, and over the words where it is highest, if all is held."""
        whole, sharp = np.zeros(len(texts)), np.zeros(len(texts))
        for i, each, *_ in self.differences(texts):
            # A few words are weaker evidence than many.
            whole[i] = each.sum() / (len(each) + PRIOR_WORDS)
            few = _few(len(each))
            sharp[i] = _highest(each, few).sum() / few
        return whole, sharp

    def known(self, bounds: np.ndarray, each: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text with words: its place, number of words, sum of the held ones, how many highest of them follow, and these."""
        at = np.flatnonzero(np.diff(bounds))
        tops, total = [], np.zeros(len(at))
        for k, i in enumerate(at):
            held = each[bounds[i] : bounds[i + 1]][~open_[bounds[i] : bounds[i + 1]]]
            total[k] = held.sum()
            tops.append(_highest(held, _few(int(bounds[i + 1] - bounds[i]))))
        return at, np.diff(bounds)[at], total, np.array([len(x) for x in tops], np.int64), np.concatenate([np.zeros(0), *tops]).astype(np.float32)

    def asked(self, texts: list[bytes], rounds: int, this: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...] | None]]:
        """Per block: its first text, the words of each, and the open bigrams of this round's buckets.

        These are their texts' places in order, keys, and differences if not
        counted. In the first round what is known of the texts follows.
        """
        for first, words, bounds in word_hashes(texts, True, _SEPARATORS):
            if not len(words):
                continue
            if this:
                left, gram = _grams(words, bounds)
                at = np.flatnonzero(buckets_of(gram, self.n_buckets) % rounds == this)
                at = at[self.bigrams.find(gram[at])[2]]
                (before, _), (_, own) = self.words.find(left[at])[0], self.words.find(words[at])[0]
                apart, known = before.astype(np.float64) + own, None
            else:
                each, open_, _, gram = self._block(words, bounds)
                at = np.flatnonzero(open_)
                at = at[buckets_of(gram[at], self.n_buckets) % rounds == 0]
                apart, known = each[at], self.known(bounds, each, open_)
            yield first, np.diff(bounds), (np.searchsorted(bounds, at, side="right") - 1, gram[at], apart.astype(np.float32)), known

    def value(self, history: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Differences of the counted bigrams of held words with these numbers and counts."""
        found = np.zeros(len(n), np.float32)
        for k in range(0, len(n), VALUED):
            at = slice(k, k + VALUED)
            found[at] = pair_values(n[at, 0], n[at, 1], self.words.stats(history[at], word[at]), self.share, self.discount)
        return found

    def parts(self, texts: list[bytes]) -> list[pa.Array]:
        """Per text: number of words, sum of the held ones, the highest of them, and the open bigrams with their number."""
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        tops, n_tops, opens, n_open = [], np.zeros(len(texts), np.int64), [], np.zeros(len(texts), np.int64)
        for i, each, open_, left, words in self.differences(texts):
            n[i] = len(each)
            known = each[~open_]
            total[i] = known.sum()
            tops.append(_highest(known, _few(len(each))))
            n_tops[i] = len(tops[-1])
            _, at, count = np.unique(_grams_of(left[open_], words[open_]), return_index=True, return_counts=True)
            opens.append((left[open_][at], words[open_][at], count.astype(np.int32)))
            n_open[i] = len(count)
        value = np.concatenate([np.zeros(0), *tops])
        fields = [np.concatenate([np.zeros(0, t), *(x[k] for x in opens)]) for k, t in enumerate((np.uint64, np.uint64, np.int32))]
        fields = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in fields]
        top = pa.StructArray.from_arrays([pa.array(value), pa.array(np.ones(len(value), np.int64))], ["value", "n"])
        return [pa.array(n), pa.array(total), _lists(n_tops, top), _lists(n_open, pa.StructArray.from_arrays(fields, ["history", "word", "n"]))]

    def score(self, whole: np.ndarray, sharp: np.ndarray) -> np.ndarray:
        x = self.curve[0] + self.curve[1] * whole + self.curve[2] * sharp
        return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))

    def score_column(self) -> Column:
        x = F.lit(float(self.curve[0])) + F.lit(float(self.curve[1])) * F.col("whole") + F.lit(float(self.curve[2])) * F.col("sharp")
        return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def derive(counts: DataFrame, halves: tuple[int, ...], sizes: np.ndarray, n_buckets: int, few_texts: bool = False) -> Model:
    """Both models of the packed bigrams that these halves hold; ``sizes`` are the sums of the rows'.

    With ``few_texts`` no bigram is held, and where not all words are, the
    values are not written: the texts' own bigrams pick theirs from the counted ones.

    The larger class enters with the counts expected from a thinning to the
    smaller one's size, so that neither class is favoured for having seen more.
    """
    classes = ("toxic", "ordinary")
    n = {c: int(sum(sizes[2 * h + k] for h in halves)) for k, c in enumerate(classes)}
    small = min(n, key=n.get)
    share = {c: min(n.values()) / n[c] if n[c] else 1.0 for c in n}
    discount = _discount(*sizes[4:].reshape(len(HALVES), 2, 2)[HALVES.index(halves), classes.index(small)].tolist())
    tokens = cut_to_table(token_sums(counts, halves, share, n_buckets))
    seen_any = {c: 1.0 - F.exp(F.col(f"{c}_none")) for c in n}
    kinds = tokens.agg(
        F.count("*").alias("tokens"), F.count(F.when(F.col("as_word") > 0, 1)).alias("types"),
        *[F.sum(f"{c}_k").alias(f"{c}_k") for c in n], *[F.sum(seen_any[c]).alias(f"{c}_any") for c in n],
        *[F.count(F.when(F.round(f"{small}_k") == k, 1)).alias(f"n{k}") for k in (1, 2)],
    ).first()
    total = {c: max(kinds[f"{c}_k"] or 0.0, 1.0) for c in n}
    word_discount = _discount(kinds["n1"], kinds["n2"])
    # One share for both classes, as large as thinned alike: a word that neither has seen says nothing.
    rest = sum(word_discount * (kinds[f"{c}_any"] or total[c]) / total[c] for c in n) / len(n)
    shared_total = sum(total.values()) + kinds["types"] + 1
    unseen = 1.0 / shared_total
    shared = (F.col("toxic_k") + F.col("ordinary_k")) / F.lit(shared_total)

    def class_word(c: str) -> Column:
        """The class's share of a word, above that of an unseen one; a word that is a left neighbour only counts as unseen."""
        kept = (F.col(f"{c}_k") - word_discount * seen_any[c]) / F.lit(total[c])
        return F.greatest(kept, F.lit(0.0)) + F.lit(rest) * shared + F.lit(rest * unseen)

    def left_over(c: str) -> Column:
        share_left = F.lit(discount) * F.col(f"{c}_types") / F.col(f"{c}_all")
        return F.when(F.col(f"{c}_all") > 0, F.least(share_left, F.lit(1.0))).otherwise(1.0)

    both = tokens.withColumn("shared_all", F.col("toxic_all") + F.col("ordinary_all"))
    stats = [class_word("toxic").alias("toxic_share"), class_word("ordinary").alias("ordinary_share"), (shared + F.lit(unseen)).alias("shared_share")]
    stats += [left_over(c).alias(f"{c}_left") for c in MODELS]
    stats += [(1.0 / F.greatest(F.col(f"{c}_all"), F.lit(1e-6))).alias(f"{c}_one") for c in MODELS]
    # As a start of text, history 0 is in every text and held first.
    weight = F.when(F.col("word") == 0, 1e18).otherwise(F.floor("weight")).alias("weight")
    every = both.select("word", weight, *stats).select("word", "weight", *[F.col(c).cast("float").alias(c) for c in WORD_STATS + LEFT_STATS])
    curve = np.array([0.0, 1.0, 0.0])
    if kinds["tokens"] <= HELD_WORDS:
        words = Words.fetch_all(every)
        drop_table(tokens)
        model = Model(words, Held(np.zeros(0, np.uint64), np.zeros((1, 0), np.float32), None), curve, share, discount, n_buckets)
        _hold_bigrams(model, counts, halves, 0 if few_texts else HELD_BIGRAMS)
        return model
    every = cut_to_table(every)
    drop_table(tokens)
    held_words = every.select(
        "word", "weight", (F.log("toxic_left") - F.log("ordinary_left")).cast("float").alias("left"),
        (F.log("toxic_share") - F.log("ordinary_share")).cast("float").alias("own"),
    )
    of_words = Held.fetch(held_words, F.col("word"), HELD_WORDS, "left", "own")
    valued = _valuation(every, share, discount)
    rows = rows_of(counts, halves)
    key = gram_key(F.col("history"), F.col("word"))
    if few_texts:
        counted = rows.select("history", "word", (F.col("toxic") + F.col("ordinary")).alias("weight"), F.lit(0.0).cast("float").alias("value"))
        of_pairs = Held.fetch(counted, key, 0, "value")
        pick = lambda wanted: valued(rows.join(wanted, ["history", "word"], "left_semi")).drop("weight")
        scratch = (every,)
    else:
        pairs = cut_to_table(valued(rows))
        of_pairs = Held.fetch(pairs, key, HELD_BIGRAMS, "value")
        pick = lambda wanted: pairs.drop("weight")
        scratch = (every, pairs)
    return Model(of_words, of_pairs, curve, share, discount, n_buckets, None, held_words.drop("weight"), pick, scratch)


def _hold_bigrams(model: Model, counts: DataFrame, halves: tuple[int, ...], most: int) -> None:
    """Write the model's bigrams with their words' numbers, and take up to ``most`` with their values to the driver."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.words
        for batch in batches:
            for row in batch.to_pylist():
                n = np.column_stack(_of_halves(_from_planes(row["n"]).reshape(-1, 4), halves))
                held = n.sum(1) > 0
                left, word = (_planes(words.place(np.frombuffer(row[c], np.uint64)[held])) for c in ("history", "word"))
                yield _rows([(row["bucket"], left, word, _planes(n[held]))], _PACKED)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, n = np.unique(_joint_counts(batch.column("n"), 2).sum(1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(weight, pa.int64()), pa.array(n)], names=["weight", "n"])

    model.packed = cut_to_table(counts.drop("sizes").mapInArrow(numbered, "bucket int, history binary, word binary, n binary"))
    model.scratch = (model.packed,)
    down = model.packed.mapInArrow(weights, "weight bigint, n bigint").groupBy("weight").agg(F.sum("n").alias("n"))
    down = sorted(map(tuple, down.collect()), reverse=True)
    least, whole = _least(down, most)
    bits = _sieve_bits(sum(n for _, n in down))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.words
        for batch in batches:
            for row in batch.to_pylist():
                left, word = (_from_planes(row[c]) for c in ("history", "word"))
                n = _from_planes(row["n"]).reshape(-1, 2)
                gram = _grams_of(words.keys[left], words.keys[word])
                top = n.sum(1) >= least if least is not None else np.zeros(len(n), bool)
                # A row's bigrams are in the order of their keys, and so are their bits in the sieve.
                at = gram >> np.uint64(64 - bits)
                first = int(at[0] >> np.uint64(6)) if len(at) else 0
                lanes = np.zeros(0 if whole or not len(at) else int(at[-1] >> np.uint64(6)) - first + 1, np.uint64)
                if len(lanes):
                    np.bitwise_or.at(lanes, (at >> np.uint64(6)).astype(np.int64) - first, np.uint64(1) << (at & np.uint64(63)))
                yield _rows([(gram[top].tobytes(), shared.value.value(left[top], word[top], n[top]).tobytes(), first, lanes.tobytes())], _HELD)

    got = model.packed.mapInArrow(held, "gram binary, value binary, first int, lanes binary").toArrow()
    shared.destroy()
    gram, value = _joint(got.column("gram"), np.uint64), _joint(got.column("value"), np.float32)
    sieve = None if whole else np.zeros(1 << (bits - 6), np.uint64)
    for first, lanes in zip(*(got.column(c).to_pylist() for c in ("first", "lanes"))):
        if sieve is not None:
            lanes = np.frombuffer(lanes, np.uint64)
            sieve[first : first + len(lanes)] |= lanes
    del got
    order = np.argsort(gram)
    model.bigrams = Held(gram[order], value[order][None], sieve)
    pa.default_memory_pool().release_unused()


_HELD = pa.schema([("gram", pa.binary()), ("value", pa.binary()), ("first", pa.int32()), ("lanes", pa.binary())])


def pair_values(toxic: np.ndarray, ordinary: np.ndarray, stats: np.ndarray, share: dict[str, float], discount: float) -> np.ndarray:
    """Differences of counted bigrams: each class's discounted share, and the rest by the shared model relative to the word's share.

    The rows of ``stats`` are those of the word, then those of the history.
    """
    of = dict(zip(WORD_STATS + LEFT_STATS, stats.astype(np.float64)))
    n = {"toxic": toxic * share["toxic"], "ordinary": ordinary * share["ordinary"]}
    seen = {c: 1.0 - (1.0 - share[c]) ** count if share[c] < 1 else (count > 0).astype(float) for c, count in (("toxic", toxic), ("ordinary", ordinary))}
    n["shared"] = n["toxic"] + n["ordinary"]
    seen["shared"] = 1.0 - (1.0 - seen["toxic"]) * (1.0 - seen["ordinary"])
    kept = {c: np.maximum(n[c] - discount * seen[c], 0.0) * of[f"{c}_one"] for c in MODELS}
    base = kept["shared"] / of["shared_share"] + of["shared_left"]
    both = [kept[c] + of[f"{c}_left"] * base * of[f"{c}_share"] for c in ("toxic", "ordinary")]
    return (np.log(both[0]) - np.log(both[1])).astype(np.float32)


def _valuation(every: DataFrame, share: dict[str, float], discount: float) -> Callable[[DataFrame], DataFrame]:
    """Rows (history, word, toxic, ordinary) to (history, word, weight, value), by joins with what is known of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            toxic, ordinary, *stats = (c.to_numpy(zero_copy_only=False) for c in batch.columns[2:])
            value = pair_values(toxic, ordinary, np.stack(stats), share, discount)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(toxic + ordinary), pa.array(value)], names=["history", "word", "weight", "value"])

    def valued(rows: DataFrame) -> DataFrame:
        left = every.select(F.col("word").alias("history"), *LEFT_STATS)
        rows = rows.join(every.select("word", *WORD_STATS), "word").join(left, "history")
        columns = [F.col(c).cast("bigint").alias(c) for c in ("history", "word", "toxic", "ordinary")]
        return rows.select(*columns, *WORD_STATS, *LEFT_STATS).mapInArrow(run, "history bigint, word bigint, weight bigint, value float")

    return valued


def fit_curve(whole: np.ndarray, sharp: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression on two features by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(whole)), whole, sharp])
    curve = np.zeros(3)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ curve, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - 1e-3 * curve)
        curve = curve + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return curve


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a label 0 or 1, the higher where an id has several."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= MAX_BROADCAST_LABELS:
        labels = F.broadcast(labels)
    return with_text(docs, "doc_id").join(labels, "doc_id")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3).cast("int")


def _evidence(docs: DataFrame, model: Model, columns: list[str], scratch: list[DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Rows (columns..., whole, sharp), one per row of ``docs``; tables written for them are added to ``scratch``."""
    shared = model.share_out(docs.sparkSession)
    at = len(columns)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, sharp = shared.value.evidence(text_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(whole), pa.array(sharp)], names=[*columns, "whole", "sharp"])

    if model.whole:
        return with_text(docs, *columns).mapInArrow(run, ", ".join([*fields, "whole double, sharp double"]))

    if model.packed is not None:
        return _settled(docs, model, shared, columns, scratch, rounds)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = shared.value.parts(text_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *parts], names=[*columns, "n_", "total_", "top_", "open_"])

    parts = "n_ bigint, total_ double, top_ array<struct<value: double, n: bigint>>, open_ array<struct<history: bigint, word: bigint, n: int>>"
    rows = with_text(docs, *columns).mapInArrow(split, ", ".join([*fields, parts]))
    rows = cut_to_table(rows.withColumn("row_", F.monotonically_increasing_id()))
    scratch.append(rows)
    return _joined(rows, model).select(*columns, "whole", "sharp")


def _tops(group: np.ndarray, values: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group its highest values, as many as ``few`` says, with their groups in order."""
    order = np.lexsort((-values, group))
    group = group[order]
    starts = _starts(group)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    top = rank < few[group]
    return group[top], values[order[top]]


def _settled(docs: DataFrame, model: Model, shared: Broadcast, columns: list[str], scratch: list[DataFrame], rounds: int) -> DataFrame:
    """Whole and sharp where all words are held: texts ask the buckets of the counted bigrams for their open ones.

    Bigrams travel packed, with a hash for their text, and the answers as a sum
    and the highest values of each text. Equal texts ask once in a bucket. A
    round asks some of the buckets, so that a part of all questions is on disk.
    """
    n_parts = partitions(docs)
    keyed = with_text(docs, *columns).withColumn("asked_", F.xxhash64("text"))

    def ask(this: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            model = shared.value

            def flush() -> pa.RecordBatch:
                rows = []
                doc, n, gram, apart = (np.concatenate(x) for x in zip(*held))
                for bucket, doc, n, gram, apart in _dealt(buckets_of(gram, model.n_buckets), doc, n, gram, apart):
                    first = _starts(doc)
                    size = np.diff(np.append(first, len(doc)))
                    rows.append((bucket, doc[first].tobytes(), _planes(n[first]), _planes(size), gram.tobytes(), apart.tobytes()))
                # What is known needs no answer and travels by the part of its text, numbered behind the buckets.
                for doc, n, total, n_top, top in sure:
                    part, ends = buckets_of(doc, n_parts), np.concatenate(([0], np.cumsum(n_top)))
                    for k, at in _dealt(part, np.arange(len(doc))):
                        tops = np.concatenate([np.zeros(0, np.float32), *(top[ends[i] : ends[i + 1]] for i in at)])
                        rows.append((model.n_buckets + k, doc[at].tobytes(), _planes(n[at]), _planes(n_top[at]), total[at].tobytes(), tops.tobytes()))
                held.clear()
                sure.clear()
                seen.clear()
                return _rows(rows, _ASKED)

            held: list[tuple[np.ndarray, ...]] = []
            sure: list[tuple[np.ndarray, ...]] = []
            seen: set[int] = set()
            for batch in batches:
                keys = batch.column(0).to_numpy().view(np.uint64)
                new = [i for i, key in enumerate(keys.tolist()) if not (key in seen or seen.add(key))]
                keys, texts = keys[new], text_bytes(batch.column(1).take(pa.array(new, pa.int64())))
                for first, n, (text, gram, apart), known in model.asked(texts, rounds, this):
                    held.append((keys[first + text], n[text], gram, apart))
                    if known is not None:
                        sure.append((keys[first + known[0]], *known[1:]))
                if sum(len(x[0]) for x in held) >= GATHERED_OPEN:
                    sure[:] = _together(sure)
                    yield flush()
            if held:
                sure[:] = _together(sure)
                yield flush()

        return run

    def answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
        forget()
        model = shared.value
        doc, n_words, size = _joint(asked.column("doc"), np.uint64), _joint(asked.column("n")), _joint(asked.column("size"))
        if not len(doc):
            return _ANSWERED.empty_table()
        # Texts that other tasks have asked for too count once.
        once = np.zeros(len(doc), bool)
        once[np.unique(doc, return_index=True)[1]] = True
        keep = once[np.repeat(np.arange(len(doc)), size)]
        bucket = asked.column("bucket")[0].as_py()
        if bucket >= model.n_buckets:
            total, top = _joint(asked.column("gram"), np.float64)[once], _joint(asked.column("apart"), np.float32)[keep]
            row = bucket - model.n_buckets, doc[once].tobytes(), _planes(n_words[once]), _planes(size[once]), total.tobytes(), top.tobytes()
            return pa.Table.from_batches([_rows([row], _ANSWERED)])
        gram, value = _joint(asked.column("gram"), np.uint64)[keep], _joint(asked.column("apart"), np.float32)[keep]
        doc, n_words, size = doc[once], n_words[once], size[once]
        left, word, n = _joint(counted.column("history")), _joint(counted.column("word")), _joint_counts(counted.column("n"), 2)
        if len(left):
            key = _grams_of(model.words.keys[left], model.words.keys[word])
            order = np.argsort(key, kind="stable")
            found = np.minimum(np.searchsorted(key, gram, sorter=order), len(key) - 1)
            found = order[found]
            hit = np.flatnonzero(key[found] == gram)
            found = found[hit]
            value[hit] = model.value(left[found], word[found], n[found])
        # The texts in the order of their parts.
        part = buckets_of(doc, n_parts)
        order = np.argsort(part, kind="stable")
        place = np.zeros(len(doc), np.int64)
        place[order] = np.arange(len(order))
        pair = np.repeat(place, size)
        doc, n_words, part = doc[order], n_words[order], part[order]
        total = np.bincount(pair, value.astype(np.float64), len(doc))
        of_top, top = _tops(pair, value, _few_of(n_words))
        n_top = np.bincount(of_top, minlength=len(doc))
        ends = np.concatenate(([0], np.cumsum(n_top)))
        starts = _starts(part)
        rows = []
        for a, b in zip(starts, [*starts[1:], len(part)]):
            rows.append((int(part[a]), doc[a:b].tobytes(), _planes(n_words[a:b]), _planes(n_top[a:b]), total[a:b].tobytes(), top[ends[a] : ends[b]].tobytes()))
        return pa.Table.from_batches([_rows(rows, _ANSWERED)])

    def gather(table: pa.Table) -> pa.Table:
        doc, group = np.unique(_joint(table.column("doc"), np.uint64), return_inverse=True)
        n = np.zeros(len(doc), np.int64)
        n[group] = _joint(table.column("n"))
        total = np.bincount(group, _joint(table.column("total"), np.float64), len(doc))
        of_top, top = _tops(np.repeat(group, _joint(table.column("size"))), _joint(table.column("top"), np.float32), _few_of(n))
        tops = _lists(np.bincount(of_top, minlength=len(doc)), pa.array(top.astype(np.float64)))
        return pa.Table.from_arrays([pa.array(doc.view(np.int64)), pa.array(n), pa.array(total), tops], names=["asked_", "n_", "total_", "top_"])

    tables = []
    for this in range(rounds):
        asked = keyed.select("asked_", "text").mapInArrow(ask(this), "bucket int, doc binary, n binary, size binary, gram binary, apart binary")
        counted = model.packed.where(F.col("bucket") % rounds == this)
        answers = asked.groupBy("bucket").cogroup(counted.groupBy("bucket"))
        answers = answers.applyInArrow(answer, "part int, doc binary, n binary, size binary, total binary, top binary")
        tables.append(cut_to_table(answers.groupBy("part").applyInArrow(gather, "asked_ bigint, n_ bigint, total_ double, top_ array<double>")))
    scratch.extend(tables)
    sums = F.max("n_").alias("n_"), F.sum("total_").alias("total_"), F.flatten(F.collect_list("top_")).alias("top_")
    answers = reduce(DataFrame.unionByName, tables).groupBy("asked_").agg(*sums)
    # Texts without words have asked for nothing.
    rows = keyed.drop("text").join(answers, "asked_", "left").withColumn("n_", F.coalesce("n_", F.lit(0)))
    few = F.least(F.col("n_"), F.greatest(F.lit(SHARP_LEAST), F.ceil(F.lit(SHARP_SHARE) * F.col("n_")))).cast("int")
    top = F.aggregate(F.slice(F.sort_array("top_", asc=False), 1, few), F.lit(0.0), lambda held, one: held + one)
    whole = F.coalesce("total_", F.lit(0.0)) / (F.col("n_") + PRIOR_WORDS)
    return rows.select(*columns, whole.alias("whole"), F.when(F.col("n_") > 0, top / few).otherwise(0.0).alias("sharp"))


def _together(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    return [tuple(np.concatenate(x) for x in zip(*parts))] if parts else []


_ASKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("doc", "n", "size", "gram", "apart"))])
_ANSWERED = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("doc", "n", "size", "total", "top"))])


def _joined(rows: DataFrame, model: Model) -> DataFrame:
    """Settle the open bigrams of the rows by joins with the counted tables."""
    open_ = rows.select("row_", F.explode("open_").alias("open")).select("row_", "open.*")
    keys = ["history", "word"]
    wanted = open_.select(*keys).distinct()
    known = open_.join(model.bigram_table(wanted), keys, "left")
    # The words' part of an uncounted bigram comes from the table, once for each distinct one.
    left = model.word_table.select(F.col("word").alias("history"), "left")
    own = model.word_table.select("word", "own")
    zero = F.lit(0.0)
    both = F.coalesce(F.col("left").cast("double"), zero) + F.coalesce(F.col("own").cast("double"), zero)
    words = wanted.join(left, "history", "left").join(own, "word", "left").select("history", "word", both.alias("parts"))
    value = F.coalesce(F.col("value").cast("double"), F.col("parts")).alias("value")
    found = known.join(words, keys).select("row_", value, F.col("n").cast("bigint").alias("n"))
    found = found.groupBy("row_").agg(F.collect_list(F.struct("value", "n")).alias("found_"))
    few = F.least(F.col("n_"), F.greatest(F.lit(SHARP_LEAST), F.ceil(F.lit(SHARP_SHARE) * F.col("n_"))))
    none = F.from_json(F.lit("[]"), "array<struct<value: double, n: bigint>>")
    both = rows.drop("open_").join(found, "row_", "left").withColumn("found_", F.coalesce("found_", none)).withColumn("few_", few)

    def add(held: Column, one: Column) -> Column:
        take = F.least(held["left"], one["n"])
        return F.struct((held["left"] - take).alias("left"), (held["sum"] + take * one["value"]).alias("sum"))

    start = F.struct(F.col("few_").alias("left"), F.lit(0.0).alias("sum"))
    top = F.aggregate(F.sort_array(F.concat("top_", "found_"), asc=False), start, add)["sum"]
    total = F.col("total_") + F.aggregate("found_", F.lit(0.0), lambda held, one: held + one["value"] * one["n"])
    return both.select(
        "*", (total / (F.col("n_") + PRIOR_WORDS)).alias("whole"), F.when(F.col("n_") > 0, top / F.col("few_")).otherwise(0.0).alias("sharp")
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 1) -> Model:
    """Fit on the folds of ``doc_id`` other than ``held_out``: all their labelled rows are counted.

    The curve is fitted across: models of each fold's counts alone score up to
    half of ``CURVE_ROWS`` rows of the other, so no row is scored by a model that
    has counted it.

    Without labelled documents in a fold, or without both classes, scores follow
    what is there: an empty count model gives every text the same evidence.
    """
    with freeing_shuffles(docs.sparkSession):
        folds = [k for k in range(3) if k != held_out]
        labelled = with_labels(docs, labels).withColumn("fold", fold_of(F.col("doc_id"))).where(F.col("fold") != held_out)
        labelled = labelled.withColumn("half", (F.col("fold") == folds[1]).cast("int"))
        n_buckets = max(partitions(docs), input_bytes(docs) // BUCKET_INPUT)
        counts = cut_to_table(count_bigrams(labelled.select("text", "toxic", "half"), n_buckets))
        sizes = np.array([np.zeros(16, np.int64), *counts.select("sizes").toArrow().column(0).to_pylist()]).sum(0)
        found = []
        for counted, scored in ((0, 1), (1, 0)):
            rest = labelled.where(F.col("half") == scored).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS // 2)
            rest = cut_to_table(rest.select("text", "toxic"))
            across = derive(counts, (counted,), sizes, n_buckets, few_texts=True)
            scratch: list[DataFrame] = [rest]
            found.append(_evidence(rest, across, ["toxic"], scratch, rounds=1).toPandas())
            across.drop()
            for table in scratch:
                drop_table(table)
        whole, sharp, toxic = (np.concatenate([rows[c].to_numpy(float) for rows in found]) for c in ("whole", "sharp", "toxic"))
        model = derive(counts, (0, 1), sizes, n_buckets)
        drop_table(counts)
        model.curve = fit_curve(whole, sharp, toxic)
        return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, held_out: int = 1) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per input row.

    Only the text is scored. A null or empty text, or one without words, has no
    evidence and gets the curve's base score. Repeated rows are each returned;
    a row without id is scored too.
    """
    scored = _evidence(docs, model, ["doc_id"], []).withColumn("score", model.score_column())
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id")) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "whole", "sharp",
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents with a score below the threshold, all columns kept; in one pass over the texts if the model is held whole."""
    if not model.whole:
        # A score depends on the text alone.
        text = F.coalesce(F.col("text"), F.lit(""))
        keys = dict(zip(free_names(docs, "key_", "check_"), (F.xxhash64(text), F.xxhash64(F.lit(1), text))))
        scratch: list[DataFrame] = []
        scored = _evidence(docs.withColumns(keys), model, list(keys), scratch).where(model.score_column() >= threshold)
        # Written first, so that what the scores took is freed before the documents move.
        toxic = cut_to_table(scored.select(*keys).distinct())
        for table in scratch:
            drop_table(table)
        kept = docs.withColumns(keys).join(toxic, list(keys), "left_anti")
        return kept.select(*docs.columns)
    shared = model.share_out(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(*shared.value.evidence(text_bytes(batch.column(at))))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
