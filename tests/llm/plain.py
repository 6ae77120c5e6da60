"""Brute-force versions of the corpus operators on lists of (doc_id, text)."""

from __future__ import annotations

import base64
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int) -> frozenset:
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_groups(rows: list[tuple], size: int, percent: int) -> dict:
    """Component by id of all pairs compared; rows that repeat an id share its vertex."""
    sets = [(d, shingles(t, size)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in parent}


def without_repeats(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept text) per row, windows compared as word tuples."""
    first: dict[tuple, int] = {}
    for d, t in rows:
        words = WORD.findall(t or "")
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def without_repeated_bytes(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) per row, windows compared as byte strings."""
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            key = t[i : i + window]
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base_spans(text: str, patterns, luhn) -> list[tuple]:
    """Base personal data straight from the patterns."""
    out = [("email", *m.span()) for m in patterns["email"].finditer(text)]
    out += [("ip", *m.span()) for m in patterns["ip"].finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in patterns["card"].finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in patterns["phone"].finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    order = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))
