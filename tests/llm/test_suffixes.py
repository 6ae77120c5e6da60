"""Repeated byte strings against a brute-force version."""

import random
from collections import Counter

import numpy as np
import plain
import pytest
from corpus_tables import edge_rows, frame, passage
from riskpanel.llm import suffixes


def removed(df, window, gram):
    return Counter((*tuple(r)[:4], bytes(r.kept)) for r in suffixes.remove_repeated_bytes(df, window, gram).collect())


def shorter(rows, most=4000):
    """Texts that the brute-force version can hold window by window."""
    return [(d, t if t is None else t[:most]) for d, t in rows]


@pytest.mark.parametrize("window, gram", [(200, 32), (40, 9), (12, 12)])
def test_repeated_bytes_removed(spark, window, gram):
    rows = shorter(edge_rows())
    rng = random.Random(8)
    shared = " ".join(passage(rng, 70))
    rows += [(200 + k, "é" * k + " ".join(passage(rng, 9)) + shared + " ".join(passage(rng, 9)) + "漢") for k in range(40)]
    rows += [(300, "ab" * 700), (301, "xyz" + "ba" * 300), (302, ("0123456789" * 21)[:209]), (303, "q" * (window - 1)), (304, "q" * window), (305, "w" * (window + 1))]
    assert removed(frame(spark, rows), window, gram) == Counter(plain.without_repeated_bytes(rows, window))


def test_few_symbols(spark):
    rng = random.Random(6)
    rows = [(d, "".join(rng.choice("ab") for _ in range(rng.randint(0, 80)))) for d in range(150)]
    assert removed(frame(spark, rows), 14, 5) == Counter(plain.without_repeated_bytes(rows, 14))


@pytest.mark.parametrize("splits", [(16, 1), (7, 3, 1), (1,)])
def test_hot_anchors_are_split(spark, monkeypatch, splits):
    """A passage in many documents has more distinct segments around its edges than a task builds."""
    monkeypatch.setattr(suffixes, "GROUP_SEGMENTS", 10)
    monkeypatch.setattr(suffixes, "SPLITS", splits)
    monkeypatch.setattr(suffixes, "HOT_ROWS", 5)
    rng = random.Random(2)
    shared = " ".join(passage(rng, 60))
    rows = [(k, " ".join(passage(rng, 12)) + shared + " ".join(passage(rng, 12))) for k in range(80)]
    rows += [(100 + k, shared[k:]) for k in range(30)] + [(200, rows[0][1])]
    assert removed(frame(spark, rows), 60, 12) == Counter(plain.without_repeated_bytes(rows, 60))


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 500)
    rng = random.Random(3)
    parts = [" ".join(passage(rng, 40)) for _ in range(12)]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 20)))) for k in range(20)] + [(50, "".join(parts)), (51, "z" * 3000)]
    assert removed(frame(spark, rows), 60, 12) == Counter(plain.without_repeated_bytes(rows, 60))


def test_no_documents(no_docs):
    assert suffixes.remove_repeated_bytes(no_docs).count() == 0


def test_columns_find_every_shared_window():
    rng = random.Random(4)
    for _ in range(100):
        core = "".join(rng.choice("ab") for _ in range(6))
        made = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))), "".join(rng.choice("abc") for _ in range(rng.randint(2, 7)))) for _ in range(12)]
        segments, at = [(a + core + b).encode() for a, b in made], np.array([len(a) for a, _ in made])
        window = 8
        columns = suffixes.Columns(segments, at, window)
        for k, s in enumerate(segments):
            for i in range(len(s) - window + 1):
                same = any(j != k and 0 <= (lo := i - at[k] + at[j]) <= len(t) - window and t[lo : lo + window] == s[i : i + window] for j, t in enumerate(segments))
                assert columns.windows(k)[i] == same
