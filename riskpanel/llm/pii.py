"""Personal data in texts, with disguises undone and spans mapped back to the source.

Base spans come from four patterns on the text as it is. For disguises a chain
of transducers rewrites the text: invisible characters go and numbered entities
become characters, look-alike characters change one for one, then spelled digits
and written-out "at" and "dot". Every rewritten piece remembers
the source span it stands for, so what the patterns find in the rewritten text
maps back to source characters. Plain prose is left alone: a lone "at" or "dot"
is rewritten only inside an address, and digits only in a row of spelled ones.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_text

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Cyrillic and Greek letters that look like Latin ones, in pairs.
LOOKALIKES = (
    "аa вb еe кk мm нh оo рp сc тt уy хx ѕs іi јj ԁd ԛq ԝw һh ӏl "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԚQ ԜW "
    "αa εe ιi κk νv οo ρp τt υu χx "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    "․. ‧. 。. ﹒. ﹫@ ‐- ‑- ‒- –- —- −-"
)
_CHARACTERS = {ord(pair[0]): pair[1] for pair in LOOKALIKES.split()}
_CHARACTERS |= {0xFF00 + k: chr(0x20 + k) for k in range(1, 0x5F)}  # full-width forms
_CHARACTERS |= {start + k: str(k) for start in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
# Compatibility letters and digits (circled, letter-like, mathematical) that stand for a single ASCII one.
for _code in (*range(0x2100, 0x2150), *range(0x24B6, 0x24EA), *range(0x1D400, 0x1D800)):
    _plain = unicodedata.normalize("NFKC", chr(_code))
    if len(_plain) == 1 and _plain.isascii() and _plain.isalnum():
        _CHARACTERS.setdefault(_code, _plain)
_LOOKALIKE = frozenset(map(chr, _CHARACTERS))

# Soft hyphen, combining marks, zero-width characters, direction and joining marks; and entities of signs.
_INVISIBLE = "[\u00ad\u0300-\u036f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+"
ENTITIES = {"commat": "@", "period": ".", "plus": "+", "hyphen": "-", "lowbar": "_", "percnt": "%", "nbsp": " "}
_HIDDEN = re.compile(rf"{_INVISIBLE}|&#(?:([0-9]{{1,7}})|[xX]([0-9A-Fa-f]{{1,6}}));|&({'|'.join(ENTITIES)});")

DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_DIGIT = "zero|one|two|three|four|five|six|seven|eight|nine|oh|o"
_SEPARATOR = r"[\s,-]{1,3}"
_FIRST = "zero|one|two|three|four|five|six|seven|eight|nine"
_NEXT = rf"(?:{_SEPARATOR}|\s(?:dot|point|dash|hyphen)\s)(?:{_DIGIT}|[0-9]+)\b"
# Rows of at least three spelled digits, with what may stand between them and up to six groups of written ones before;
# the hint is a part of every such row.
_SPELLED = re.compile(rf"\b(?:plus{_SEPARATOR})?(?:[0-9]{{1,8}}{_SEPARATOR}){{0,6}}(?:{_FIRST})(?:{_NEXT}){{2,}}", re.IGNORECASE)
_SPELLED_HINT = re.compile(rf"\b(?:{_FIRST}){_NEXT}", re.IGNORECASE)
_UNIT = re.compile(rf"\b(?:plus|dot|point|dash|hyphen|{_DIGIT})\b|[0-9]+", re.IGNORECASE)
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_AT = rf"\s*(?:{_OPEN}\s*(?:at|@)\s*{_CLOSE})\s*|\s+at\s+|\s*@\s*"
_DOT = rf"\s*{_OPEN}\s*(?:dot|\.)\s*{_CLOSE}\s*|\s+dot\s+|\."
_LABEL = r"[A-Za-z0-9-]+"
_LOCAL = rf"[A-Za-z0-9_%+-]+(?:(?:{_DOT})[A-Za-z0-9_%+-]+)*"
# An address with any of its signs written out; it counts if it holds a word or bracket.
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])({_LOCAL})({_AT})({_LABEL}(?:(?:{_DOT}){_LABEL})+)", re.IGNORECASE)
# Endings that make an address of words alone, without brackets or "@", credible.
_ENDINGS = "com|org|net|edu|gov|mil|info|biz|io|dev|app|ai|uk|us|eu|ca|de|fr|es|ch|nl|at"
_CREDIBLE = re.compile(rf"{_OPEN}|{_CLOSE}|@|\b(?:{_ENDINGS})\Z", re.IGNORECASE)
_SIGN = re.compile(rf"{_AT}|{_DOT}", re.IGNORECASE)
_STRONG = rf"{_OPEN}\s*(?:at|@|dot|\.)\s*{_CLOSE}|\sdot\s"
_PLAIN_AT = rf"\sat\s+(?={_LABEL}(?:\.{_LABEL})*\.(?:{_ENDINGS})\b)"
_STRONG_ANCHOR = re.compile(_STRONG, re.IGNORECASE)
_ANCHOR = re.compile(rf"{_STRONG}|{_PLAIN_AT}", re.IGNORECASE)
# A lone "at" before a real domain counts after a word that no prose has there, or after one that asks for mail.
_LIKE_LOCAL = re.compile(r"(?=.*[A-Za-z])[A-Za-z0-9._%+-]*[0-9._%+-]")
_ASKS = re.compile(r"\b(?:e-?mail|mail|mailto|contact|write|reach|address)(?:\s+(?:address|is|to))*[\s:]\s*\Z", re.IGNORECASE)
_NO_LOCAL = re.compile(r"(?:me|us|him|her|them|you|it|is|to)\Z", re.IGNORECASE)
# Characters around an anchor that an address can reach.
REACH = 320
_IP_WORDS = re.compile(
    rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\s*{_OPEN}\s*(?:dot|\.)\s*{_CLOSE}\s*|\s+dot\s+)[0-9]{{1,3}}){{3}}(?![0-9.])", re.IGNORECASE
)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, found from their at signs: the longest head since the last match, then the tail."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        found = _EMAIL_TAIL.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans of a text, kind by kind, failing matches dropped."""
    spans = [("email", *span) for span in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


class Rewritten:
    """A text with pieces replaced, and the source span of any span of it."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.source, self.plain = [], [], [], []
        done, length = 0, 0
        for start, end, new in edits:
            for a, b, piece in ((done, start, text[done:start]), (start, end, new)):
                if piece:
                    self.at.append(length)
                    self.source.append((a, b))
                    self.plain.append(a == done and b == start and piece == text[a:b])
                    parts.append(piece)
                    length += len(piece)
            done = end
        if done < len(text) or not self.at:
            self.at.append(length)
            self.source.append((done, len(text)))
            self.plain.append(True)
            parts.append(text[done:])
        self.text = "".join(parts)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Source span of ``start`` to ``end``; a replaced piece is taken whole."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.source[first][0] + (start - self.at[first] if self.plain[first] else 0)
        b = self.source[last][0] + end - self.at[last] if self.plain[last] else self.source[last][1]
        return a, b

    def touched(self, start: int, end: int) -> bool:
        """Whether the span holds a replaced piece."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return not all(self.plain[first : last + 1])


def hidden_edits(text: str) -> list[tuple[int, int, str]]:
    """Invisible characters removed, and entities of printable ASCII characters as those."""
    edits = []
    for m in _HIDDEN.finditer(text):
        code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else None
        if code is None or 0x20 <= code < 0x7F:
            edits.append((*m.span(), ENTITIES[m[3]] if m[3] else "" if code is None else chr(code)))
    return edits


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Rows of spelled digits as digits: separators go, dots and dashes stay, a digit keeps its word's span."""
    edits = []
    for row in _SPELLED.finditer(text):
        done = None
        for unit in _UNIT.finditer(text, row.start(), row.end()):
            word = unit[0].lower()
            new = {"plus": "+", "dot": ".", "point": ".", "dash": "-", "hyphen": "-", "oh": "0", "o": "0", **DIGITS}.get(word, word)
            edits.append((unit.start() if done is None else done, unit.end(), new))
            done = unit.end()
    return edits


def like_local(text: str, address: re.Match) -> bool:
    """Whether what stands before a lone "at" is the local part of an address and not a word of prose."""
    asked = _ASKS.search(text, max(0, address.start() - 40), address.start())
    return bool(_LIKE_LOCAL.match(address[1]) or asked and not _NO_LOCAL.match(address[1]))


def sign_edits(text: str) -> list[tuple[int, int, str]]:
    """Written-out signs inside disguised addresses and number groups."""
    edits: list[tuple[int, int, str]] = []
    windows: list[list[int]] = []
    for anchor in _ANCHOR.finditer(text):
        a, b = max(0, anchor.start() - REACH), min(len(text), anchor.end() + REACH)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    for a, b in windows:
        taken = a
        for address in _ADDRESS.finditer(text, a, b):
            if _ANCHOR.search(address[0]) and _CREDIBLE.search(address[0]) and (_STRONG_ANCHOR.search(address[0]) or like_local(text, address)):
                for sign in _SIGN.finditer(text, *address.span()):
                    written = sign[0].strip()
                    if written not in ("@", ".") or written != sign[0]:
                        new = "@" if sign.start() == address.start(2) else "."
                        edits.append((*sign.span(), new))
                taken = address.end()
        for group in _IP_WORDS.finditer(text, a, b):
            if group.start() >= taken or all(group.end() <= s or group.start() >= e for s, e, _ in edits):
                for sign in _SIGN.finditer(text, *group.span()):
                    edits.append((*sign.span(), "."))
    edits.sort()
    return edits


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans found only after undoing disguises, in source characters."""
    current, layers = text, []
    odd = not text.isascii()

    def rewrite(edits: list[tuple[int, int, str]]) -> None:
        nonlocal current
        if edits:
            layers.append(Rewritten(current, edits))
            current = layers[-1].text

    if odd or "&" in text:
        rewrite(hidden_edits(text))
    if odd:
        # One for one: offsets stay. A set is asked character by character, which a pattern of so many ranges does far slower.
        current = current if _LOOKALIKE.isdisjoint(current) else current.translate(_CHARACTERS)
    if _SPELLED_HINT.search(current):
        rewrite(spelled_edits(current))
    if _ANCHOR.search(current):
        rewrite(sign_edits(current))
    if current == text:
        return []
    found = []
    for kind, a, b in find(current):
        for layer in reversed(layers):
            a, b = layer.span(a, b)
        found.append((kind, a, b))
    return found


_ORDER = {kind: k for k, kind in enumerate(KINDS)}


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base spans with those of disguises that no base span of their kind holds whole."""
    base = find(text)
    added = []
    for kind, a, b in disguised(text):
        if all(k != kind or a < s or b > e for k, s, e in base):
            added.append((kind, a, b))
    return base, in_order(base + added)


def as_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in in_order(spans))


def find_pii(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one per input row.

    Counts and digest are of the base spans; ``spans`` also holds those found
    behind disguises. A null or empty text has none: zero counts, the digest of
    nothing, an empty list. Repeated rows are each returned, null ids stay null,
    texts are read whole, further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans, added = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(as_text(base).encode()).hexdigest())
                spans.append(as_text(every))
                added.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    key = docs.schema[id_column].dataType.simpleString()
    schema = f"id {key}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return with_text(docs, id_column).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    parts, done = [], 0
    for kind, a, b in all_spans(text)[1]:
        if a >= done:
            parts += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in ``text``; null texts stay null, all columns are kept.

    Where a column ``n_chars`` is there, it is set to the new length in code points.
    """
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if chars_at is not None:
                lengths = [old if t is None else len(t) for t, old in zip(texts, columns[chars_at].to_pylist())]
                columns[chars_at] = pa.array(lengths, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
