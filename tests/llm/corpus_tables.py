"""Small tables of documents with edge cases."""

from __future__ import annotations

import random

from riskpanel.session import ship_package

# Extra columns whose names the operators use themselves.
CLASH = ["id", "doc", "row", "n", "rep", "rank", "part", "length", "score", "copy", "rate", "spans", "kept_text", "key", "comp", "start", "words", "table", "mix_source", "n_copies", "salt", "key_", "check_", "place_", "node"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)


def passage(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def edge_rows() -> list[tuple]:
    """(doc_id, text): nulls, blanks, short, copies, near copies, shared passages, a very long text, repeated rows."""
    rng = random.Random(5)
    shared, other = passage(rng, 120), passage(rng, 70)
    base = passage(rng, 90)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, "one two"), (6, "ONE two")]
    for k in range(30):  # near copies of one text, with one to four words changed
        words = list(base)
        for _ in range(1 + k % 4):
            words[rng.randrange(len(words))] = f"x{k}"
        rows.append((10 + k, " ".join(words)))
    for k in range(12):  # passages within other words, cut at different places
        rows.append((50 + k, " ".join(passage(rng, k) + shared[k : 120 - k] + passage(rng, 5) + other + ["end"])))
    rows += [(70, " ".join(shared) + " " + " ".join(shared)), (71, " ".join(base)), (72, " ".join(base).upper())]
    rows.append((80, " ".join(passage(rng, 40_000) + shared + other[:55])))
    rows.append((81, "a" * 300_000))
    rows += [(90, " ".join(other)), (90, " ".join(other)), (91, "repeated id one two three"), (91, " ".join(other) + " more")]
    rows += [(None, " ".join(shared)), (None, None)]
    rows += [(100, "é ñ 漢字 ' don't <|endoftext|> x<|startoftext|>y 12345 z"), (101, "mail john (at) example (dot) com, a.b@c.de, 10.0.0.1, +1 555 123 4567")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    ship_package(spark)
    full = [(d, t, "en" if d is None or d % 2 else None, f"s{d % 3}" if d else None, len(t or ""), *["x"] * len(CLASH)) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
