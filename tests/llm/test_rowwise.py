"""Token counts, personal data, toxicity: operators that look at one text at a time, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import plain
import pytest
from corpus_tables import frame
from riskpanel.llm import pii, toxicity
from riskpanel.llm.packing import Encoder
from riskpanel.llm.token_count import TokenCounter, count_tokens, merge_count
from riskpanel.session import input_bytes
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("word_bpe_49k.json")
POOL = "aAéÉßΣσς'́가 \n\t\x0b\x1c  12½Ⅳ٣!?.,-_😀漢<|endoftext|>sdtmrelv"


def library_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def random_texts(n=1500):
    rng = random.Random(3)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["aA!?1" * 400, "x" * 5000, "a<|endoftext|>b<|STARTOFTEXT|>"]


def test_counts_and_ids_are_the_librarys():
    texts = random_texts()
    counter, encoder = TokenCounter(VOCABULARY, cache_entries=50), Encoder(VOCABULARY)
    ids = library_ids(texts)
    assert [counter.count(t.encode()) for t in texts] == [len(i) for i in ids]
    assert [encoder.encode(t.encode()) for t in texts] == [np.array(i, "<u4").tobytes() for i in ids]


def test_merging_takes_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2, ("d", "d"): 3}
    assert merge_count(list("abc"), ranks) == 1
    assert merge_count(list("abb"), ranks) == 2
    assert merge_count(list("ddd"), ranks) == 2
    assert merge_count([], ranks) == 0


def test_token_rows(edge_docs, edges, no_docs):
    got = sorted(map(tuple, count_tokens(edge_docs, VOCABULARY, 2048).collect()), key=str)
    ids = library_ids([t or "" for _, t in edges])
    want = [(d, len((t or "").encode()), len(i), len(i) > 2048) for (d, t), i in zip(edges, ids)]
    assert got == sorted(want, key=str)
    assert count_tokens(no_docs, VOCABULARY, 2048).count() == 0


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    parts = ["a@b.c", "@", ".", "1", "22", "+1", "4111 1111 1111 1111", "-", " ", "é", "a", "255.1.", "(", ")", "x_y%", "\n"]
    patterns = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.in_order(pii.find(text)) == plain.base_spans(text, patterns, pii.luhn), text


@pytest.mark.parametrize("text, kind, found", [
    ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
    ("mail john at example dot com now", "email", "john at example dot com"),
    ("john[at]example[dot]com", "email", "john[at]example[dot]com"),
    ("john@example dot com.", "email", "john@example dot com"),
    ("write jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("call plus one five five five one two three four five six seven please", "phone", "plus one five five five one two three four five six seven"),
    ("+１ 555 123 4567", "phone", "+１ 555 123 4567"),
    ("ip one nine two dot one six eight dot one dot one ok", "ip", "one nine two dot one six eight dot one dot one"),
    ("at 192[.]168[.]1[.]1 or", "ip", "192[.]168[.]1[.]1"),
    ("four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
])
def test_disguises(text, kind, found):
    start = text.index(found)
    assert pii.all_spans(text) == ([], [(kind, start, start + len(found))])
    assert found not in pii.masked(text) and f"<{kind}>" in pii.masked(text)


@pytest.mark.parametrize("text", [
    "look at example.com dot", "the point at the dot in it", "one two three go", "Anat with by at the of. One, two", "a dot and at an end",
    "Москва и Σωκράτης", "five five five dash one two three", "ten at nine dot", "",
])
def test_clean_prose_is_left_alone(text):
    assert pii.all_spans(text) == ([], [])
    assert pii.masked(text) == text


def test_pii_rows(edge_docs, edges, no_docs):
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_phone, r.n_added) for r in pii.find_pii(edge_docs).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    base = pii.in_order(pii.find(dict((d, t) for d, t in edges if d == 101)[101]))
    assert (101, hashlib.sha256(pii.as_text(base).encode()).hexdigest(), 1, 1, 1, 1) in got
    assert {(0, nothing, 0, 0, 0, 0), (1, nothing, 0, 0, 0, 0), (None, nothing, 0, 0, 0, 0)} <= got
    assert pii.find_pii(edge_docs).count() == len(edges) and pii.find_pii(no_docs).count() == 0
    masked = pii.mask_pii(edge_docs)
    assert masked.columns == edge_docs.columns
    assert masked.where("doc_id = 0").first().text is None
    row = masked.where("doc_id = 101").first()
    assert row.text == "mail <email>, <email>, <ip>, <phone>" and row.n_chars == len(row.text)


def toxic_rows(n=900):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    bad = ["zorg", "blarg", "fnurd"]
    rows, labels = [], []
    for d in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = int(d % 5 == 0)
        for _ in range(max(2, len(text) // 40) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((d, " ".join(text)))
        if d % 4:
            labels.append((d, toxic if rng.random() > 0.03 else 1 - toxic))
    return rows, labels, {d: int(d % 5 == 0) for d, _ in rows}


def test_toxicity_on_held_out_rows(spark):
    rows, labels, truth = toxic_rows()
    docs, labels = frame(spark, rows), spark.createDataFrame([(d, t, 0) for d, t in labels], "doc_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in scored if r.held_out]
    assert len(scored) == len(rows) and 200 < len(held) < 400
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    clean = [r for r in held if not truth[r.doc_id]]
    assert right > 0.93 and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.7) for r in scored)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in scored if not r.predicted}
    # Whole texts count: the same words far behind a long clean start still tell.
    far = frame(spark, [(1, " ".join(w for _, t in rows[1:4] for w in t.split()) * 3 + " zorg blarg fnurd " * 12)])
    assert toxicity.score_toxicity(far, model).first().predicted == 1


def test_toxicity_edges(spark, edge_docs, edges, no_docs):
    labels = spark.createDataFrame([(10, 1), (11, 0), (11, 1), (12, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(edge_docs, labels)
    scored = toxicity.score_toxicity(edge_docs, model)
    assert scored.count() == len(edges) and scored.where("score is null or isnan(score)").count() == 0
    empty = toxicity.fit_toxicity(no_docs, labels.limit(0))
    assert toxicity.score_toxicity(no_docs, empty).count() == 0
    assert toxicity.score_toxicity(edge_docs, empty).select(F.countDistinct("score")).first()[0] == 1


def test_toxicity_joins_what_is_not_held(spark, monkeypatch):
    rows, labels, _ = toxic_rows(300)
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    results = []
    for words, bigrams in ((1 << 20, 1 << 20), (50, 50), (0, 0)):
        monkeypatch.setattr(toxicity, "HELD_WORDS", words)
        monkeypatch.setattr(toxicity, "HELD_BIGRAMS", bigrams)
        model = toxicity.fit_toxicity(docs, labels)
        assert model.whole == (bigrams > 50)
        scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
        results.append((scored, {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}))
    first, kept = results[0]
    assert len(first) == len(rows) and 0 < len(kept) < len(rows)
    for other, other_kept in results[1:]:
        assert other_kept == kept and other.keys() == first.keys()
        for d, row in first.items():
            assert abs(other[d].whole - row.whole) < 1e-9 and abs(other[d].sharp - row.sharp) < 1e-9 and abs(other[d].score - row.score) < 1e-6


def test_toxicity_asks_for_bigrams_that_are_not_held(spark, monkeypatch):
    rows, labels, _ = toxic_rows(300)
    # Copies in other tasks, and texts without words.
    rows += [(1000 + d, t) for d, t in rows[:50]] + [(2000, None), (2001, ""), (2002, "?! .")]
    docs, labels = frame(spark, rows).repartition(7, "doc_id"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = []
    for bigrams, buckets in ((1 << 20, 8), (50, 8), (0, 3)):
        monkeypatch.setattr(toxicity, "HELD_BIGRAMS", bigrams)
        monkeypatch.setattr(toxicity, "GATHERED_OPEN", 500 * buckets)
        model = toxicity.fit_toxicity(docs, labels)
        assert model.whole == (bigrams > 50)
        found.append({r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()})
    for other in found[1:]:
        assert other.keys() == found[0].keys() and len(other) == len(rows)
        for d, row in found[0].items():
            assert abs(other[d].whole - row.whole) < 1e-6 and abs(other[d].sharp - row.sharp) < 1e-6 and abs(other[d].score - row.score) < 1e-5


def test_toxicity_keeps_few_bytes_of_a_bigram(spark, monkeypatch):
    rows, labels, _ = toxic_rows(900)
    docs, labelled = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "HELD_BIGRAMS", 50)
    model = toxicity.fit_toxicity(docs, labelled)
    ids = {d for d, _ in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    bigrams = {pair for d, t in rows if d in ids for pair in zip(["", *t.split()], t.split())}
    assert len(bigrams) > 20_000
    assert sum(input_bytes(table) for table in model.scratch) < 10 * len(bigrams)


def test_toxicity_takes_words_to_the_driver_in_parts(spark, monkeypatch):
    rows, labels, _ = toxic_rows(300)
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    fetched, to_arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: fetched.append(to_arrow(self)) or fetched[-1])
    monkeypatch.setattr(toxicity, "HELD_BIGRAMS", 0)
    toxicity.fit_toxicity(docs, labels)
    of_words = [table.nbytes / table.num_rows for table in fetched if "word" in table.column_names]
    assert of_words and max(of_words) < 36


def test_workers_forget_what_other_operators_remember():
    from riskpanel.llm import common, packing

    packing.encoder_of(VOCABULARY).encode(b"some words")
    common.forget()
    assert packing.encoder_of.cache_info().currsize == 0


def test_toxicity_counts_both_folds(spark):
    rows, labels, truth = toxic_rows(300)
    fold = {r.doc_id: r.fold for r in frame(spark, rows).select("doc_id", toxicity.fold_of(F.col("doc_id")).alias("fold")).collect()}
    # Each fold has a toxic word of its own.
    rows = [(d, t + f" only{fold[d]}" * 4 if truth[d] else t) for d, t in rows]
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    _, sharp = model.evidence([b"only0 only0", b"only2 only2", b"only1 only1"])
    assert sharp[0] > 0.5 and sharp[1] > 0.5 and sharp[2] < 0.5


@pytest.mark.parametrize("text, address", [
    ("write to john.smith at example.com", "john.smith at example.com"),
    ("ask j_doe7 at mail.example.org.", "j_doe7 at mail.example.org"),
    ("e-mail: john at example.com now", "john at example.com"),
    ("email address is john at example.com", "john at example.com"),
])
def test_lone_at_before_a_real_domain(text, address):
    a = text.index(address)
    assert pii.all_spans(text)[1] == [("email", a, a + len(address))]
    assert pii.masked(text) == text.replace(address, "<email>")


def test_lone_at_in_prose():
    for text in ("look at example.com", "email me at example.com", "we met in 2024 at example.com", "john.smith at home", "see a.b at example.zzz"):
        assert pii.all_spans(text)[1] == []


def test_spelled_digits_between_dashes_and_in_capitals():
    row = "four " + " ".join(["one"] * 15)
    for text in (row.replace(" ", " dash "), "\u0130 " + row.upper(), "plus " + " hyphen ".join("one two three four five six seven eight nine zero".split())):
        kind = "phone" if text.startswith("plus") else "card"
        assert pii.all_spans(text)[1] == [(kind, 2 * text.startswith("\u0130"), len(text))]


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write j\u043ehn@example.com now", "email", "j\u043ehn@example.com"),  # a part of it is a base span
        ("john\u200b@example.com", "email", "john\u200b@example.com"),
        ("jo\u00adhn.doe@example.com", "email", "jo\u00adhn.doe@example.com"),
        ("\U0001d423ohn@example.com", "email", "\U0001d423ohn@example.com"),
        ("ask john&#64;example&#x2e;com today", "email", "john&#64;example&#x2e;com"),
        ("card 4111 1111 one one one one 1111 ok", "card", "4111 1111 one one one one 1111"),
        ("jose\u0301@example.com", "email", "jose\u0301@example.com"),
    ],
)
def test_disguises_that_hide_in_characters(text, kind, found):
    base, every = pii.all_spans(text)
    start = text.index(found)
    assert (kind, start, start + len(found)) in every and set(base) <= set(every)
    assert pii.masked(text) == text.replace(found, f"<{kind}>")


def test_plain_prose_with_hidden_characters_stays():
    for text in ("caf\u00e9 cafe\u0301 \u200bnothing", "a &#64; b &amp; c", "in 2020 one two three went", "\U0001d423oy"):
        assert pii.all_spans(text) == ([], []) and pii.masked(text) == text
