"""Personal data in plain and disguised form, as spans of the original text.

Base rules find plain e-mail addresses, IPv4 addresses, card numbers and phone numbers. A transducer then rewrites the text into a
normal form, remembering for each character it writes the span of source characters it stands for: homoglyphs and full-width forms
become ASCII, zero-width characters vanish, spelled digits become digits, and spelled or bracketed "at" and "dot" become "@" and
".". The same rules run over the normal form; what they find is mapped back to source characters, and kept as a further span if it
overlaps no base span, or goes beyond those it overlaps. A spelled address counts if its last label is one of ``TOP_DOMAINS``, of which
the longest chain of labels is taken: with other endings, "at" and "dot" are prose as a rule.

Spans count code points of the original, end exclusive. Rules run over whole texts in linear time: a pattern begins at a rare sign, or at
the start of a word, and addresses are read outwards from their "at".

Defined cases: null text counts as empty and has no spans; rows are judged one by one, so repeated rows repeat; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import ship, text_or_empty

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits is matched whole or not at all, so no start inside a run can do better than the run's own.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIGIT = re.compile("[0-9]")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of the local part, @ and the domain, found from each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def plain(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base rules, by kind and start."""
    if not _DIGIT.search(text):
        return [("email", s, e) for s, e in emails(text)]
    found = {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}
    return [(k, s, e) for k in KINDS for s, e in found[k]]


# Look-alike letters of other alphabets, and the digits' names, by language.
CYRILLIC = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhqwABEKMHOPCTXIJS", strict=True))
GREEK = dict(zip("οαινρκτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaivpktuxABEZHIKMNOPTYX", strict=True))
FULL_WIDTH = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
OTHER = {"․": ".", "。": ".", "﹒": ".", "﹫": "@", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
SUPERSCRIPTS = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789", strict=True))
CIRCLED = {chr(0x2460 + i): str(i + 1) for i in range(9)} | {"⓪": "0"}
SCRIPT_DIGITS = {chr(zero + i): str(i) for zero in (0x660, 0x6F0, 0x966) for i in range(10)}
INVISIBLE = "​‌‍⁠﻿­"
HOMOGLYPHS = CYRILLIC | GREEK | FULL_WIDTH | OTHER | SUPERSCRIPTS | CIRCLED | SCRIPT_DIGITS
DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_NAMES = "at|arroba|arobase|chez|ät"
DOT_NAMES = "dot|punto|point|punkt|period"
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz io co dev app xyz online me us uk de fr es it eu ch at nl be ca au pl ru se dk fi cz jp cn br mx ar cl pt gr tr ie nz za kr ua hu ro sk si hr rs bg lt lv ee lu il sg hk tw th vn ph my example test invalid".split()
)

_GLYPH = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + INVISIBLE + "]")
#: A word with such a sign, tried at its start only.
_RUN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?[" + re.escape("".join(HOMOGLYPHS)) + INVISIBLE + r"][^\x20\x09-\x0D]*")
_NAME = "(?:" + "|".join(sorted(DIGIT_NAMES, key=len, reverse=True)) + ")"
#: Names of digits and digits, with what may stand between them.
_SPELLED = re.compile(rf"(?<!\w)(?:{_NAME}|[0-9]+)(?:(?:[ ,-]|, | ?\(?(?:{DOT_NAMES})\)? ?|\.)(?:{_NAME}|[0-9]+)(?!\w))+", re.I)
#: Words of which a text with spelled numbers has one; the others are everyday words too.
_TELLING = frozenset(DIGIT_NAMES) - {"un", "uno", "oh", "null"}
_PARTS = str.maketrans(dict.fromkeys(",.-()", " "))
_SEPARATOR = r"[\x20\t]*"
#: From the bracket on; white space before it is added to what is found.
_BRACKETED = lambda names: re.compile(rf"[\[({{<]{_SEPARATOR}(?:{names}){_SEPARATOR}[\])}}>]{_SEPARATOR}", re.I)
_AT_BRACKET, _DOT_BRACKET = _BRACKETED(AT_NAMES + "|@"), _BRACKETED(DOT_NAMES + r"|\.")
_LABEL = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")
#: With a spelled "at", the last "dot" must be spelled too: prose has "at" before any word.
_SPELLED_AT, _SPELLED_DOT = re.compile(rf" (?:{AT_NAMES}) |@", re.I), re.compile(rf"\.| (?:{DOT_NAMES}) ", re.I)
_SPACED_AT, _SPACED_DOT = re.compile(" ?@ ?"), re.compile(r" ?\. ?")
_DOT_BEFORE = re.compile(rf"(?:\.| (?:{DOT_NAMES}) )\Z", re.I)
_LABEL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_DOT_WORD = re.compile(rf" (?:{DOT_NAMES}) | ?\. ?", re.I)
#: Digits with spelled dots.
_DOT_NUMBER = re.compile(rf"(?<=[0-9]) (?:{DOT_NAMES}) (?=[0-9])", re.I)
_DOT_HINTS = tuple(DOT_NAMES.split("|"))


class Normal:
    """A text under rewriting. Piece i of the normal form stands for source characters starts[i] to ends[i]."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.edits: list[tuple[int, int, str]] = []
        self.map: list[tuple[int, int, int, int]] | None = None
        self.layers: list[tuple[list[int], list[int], list[int]]] = []

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Applies edits (start, end, new) of the present text, in order and apart from each other, as one layer."""
        if not edits:
            return
        out, at, place = [], 0, 0
        news, shifts, olds = [], [], []
        for s, e, new in edits:
            out += [self.text[at:s], new]
            place += s - at
            news.append(place)
            olds.append(s)
            shifts.append((e - s, len(new)))
            place += len(new)
            at = e
        out.append(self.text[at:])
        self.text = "".join(out)
        self.layers.append((news, olds, shifts))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Source characters of a span of the present text."""
        for news, olds, shifts in reversed(self.layers):
            def back(at: int, is_end: bool, news: list = news, olds: list = olds, shifts: list = shifts) -> int:
                i = bisect_right(news, at) - 1
                if i < 0:
                    return at
                old, new = shifts[i]
                inside = at - news[i]
                if inside >= new:
                    return olds[i] + old + inside - new
                if old == new:
                    return olds[i] + inside
                return olds[i] + (old if is_end else 0)

            start, end = back(start, False), back(end - 1, True)
            # the last character's own end
            end = end if self._ends_at_edit(end, news, olds, shifts) else end + 1
        return start, end

    @staticmethod
    def _ends_at_edit(end: int, news: list, olds: list, shifts: list) -> bool:
        i = bisect_left(olds, end) - 1
        return i >= 0 and shifts[i][0] != shifts[i][1] and olds[i] + shifts[i][0] == end


def _with_space_before(found: Iterator[re.Match], text: str, new: str) -> list[tuple[int, int, str]]:
    edits, free = [], 0
    for m in found:
        start = m.start()
        while start > free and text[start - 1] in " \t":
            start -= 1
        edits.append((start, m.end(), new))
        free = m.end()
    return edits


def _domain_end(text: str, at: int, dot: re.Pattern, spelled: bool) -> int:
    """End of the longest chain of labels from at on that ends in a top domain after a dot (a spelled one, if spelled); -1: none."""
    label, end = _LABEL.match(text, at), -1
    while label:
        sign = dot.match(text, label.end())
        label = _LABEL.match(text, sign.end()) if sign else None
        after = text[label.end() : label.end() + 1] if label else ""
        if label and label[0].lower() in TOP_DOMAINS and (not spelled or sign[0] != ".") and after != "@" and not after.isalnum():
            end = label.end()
    return end


def _local_start(text: str, end: int, floor: int, spelled: bool) -> int:
    """Start of the longest chain of labels that ends at end and begins at floor or later, after no sign of an address; -1: none."""
    start, best = end, -1
    while True:
        last = start
        while start > floor and text[start - 1] in _LABEL_SIGNS:
            start -= 1
        if start == last or text[start] in "_-":
            return best
        if start == 0 or not (text[start - 1] in ".%+-_" or text[start - 1].isalnum()):
            best = start
        m = _DOT_BEFORE.search(text, max(floor, start - 9), start) if spelled or text[start - 1 : start] == "." else None
        if not m:
            return best
        start = m.start()


def _addresses(text: str, sign: re.Pattern, dot: re.Pattern, spelled: bool) -> list[tuple[int, int, str]]:
    """Edits that turn disguised addresses into plain ones: each is read outwards from its sign."""
    edits, free = [], 0
    for m in sign.finditer(text):
        end = _domain_end(text, m.end(), dot, spelled) if m.start() > free else -1
        start = _local_start(text, m.start(), free, spelled) if end >= 0 else -1
        if start < 0:
            continue
        found = [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(text, start, m.start())] + [(*m.span(), "@")] + [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(text, m.end(), end)]
        edits += [(s, e, new) for s, e, new in found if text[s:e] != new]
        free = end
    return edits


def _digits(m: re.Match) -> list[tuple[int, int, str]]:
    """The words of a spelled number, each to its digit, and separators of single digits away, so that the digits are joined."""
    text, base = m[0], m.start()
    tokens = list(re.finditer(rf"{_NAME}|[0-9]+", text, re.I))
    values = [DIGIT_NAMES.get(t[0].lower(), t[0]) for t in tokens]
    if sum(map(len, values)) < 4 or not any(t[0].lower() in DIGIT_NAMES for t in tokens):
        return []
    edits, at = [], 0
    for t, v in zip(tokens, values, strict=True):
        gap = text[at : t.start()]
        new = "" if at == 0 else "." if "." in gap or re.search(DOT_NAMES, gap, re.I) else ""
        edits.append((base + at, base + t.end(), new + v))
        at = t.end()
    return edits


def normalised(text: str) -> Normal | None:
    """The normal form, or None if there is nothing to rewrite."""
    form = Normal(text)
    if not text.isascii():
        edits = []
        for run in _RUN.finditer(text):
            # in a word with plain letters, digits or address signs; not in words of another alphabet
            if re.search(r"[A-Za-z0-9@.+]", run[0]) or not run[0].isalpha():
                edits += [(run.start() + g.start(), run.start() + g.end(), HOMOGLYPHS.get(g[0], "")) for g in _GLYPH.finditer(run[0])]
        form.replace(edits)
    low = form.text.lower()
    if not _TELLING.isdisjoint(low.translate(_PARTS).split()):
        form.replace([e for m in _SPELLED.finditer(form.text) for e in _digits(m)])
        form.replace([(m.start(), m.end(), "+") for m in re.finditer(r"(?<!\w)plus[ -]?(?=[0-9])", form.text, re.I)])
    if any(c in low for c in "[({<"):
        form.replace(_with_space_before(_AT_BRACKET.finditer(form.text), form.text, "@"))
        form.replace(_with_space_before(_DOT_BRACKET.finditer(form.text), form.text, "."))
    hinted = any(n in low for n in _DOT_HINTS)
    if hinted:
        form.replace(_addresses(form.text, _SPELLED_AT, _SPELLED_DOT, True))
    if " @" in form.text or "@ " in form.text or "@" in form.text and " ." in form.text:
        form.replace(_addresses(form.text, _SPACED_AT, _SPACED_DOT, False))
    if hinted:
        form.replace([(m.start(), m.end(), ".") for m in _DOT_NUMBER.finditer(form.text)])
    return form if form.layers else None


def _goes_beyond(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a to b overlaps nothing in taken, or holds all it overlaps and is longer."""
    i = bisect_right(taken, (a, a))
    i -= i > 0 and taken[i - 1][1] > a
    while i < len(taken) and taken[i][0] < b:
        if not (a <= taken[i][0] and taken[i][1] <= b and (a, b) != taken[i]):
            return False
        i += 1
    return True


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    base = plain(text)
    form = normalised(text)
    if form is None:
        return base, base
    if len(base) == len(plain_again := plain(form.text)) == 0:
        return base, base
    # of one kind, spans come in order and apart from each other
    taken = [[(s, e) for k, s, e in found if k == kind] for found in (base, ()) for kind in KINDS]
    more = []
    for kind, s, e in plain_again:
        a, b = form.source(s, e)
        if all(_goes_beyond(spans_, a, b) for spans_ in taken):
            more.append((kind, a, b))
            taken[len(KINDS) + KINDS.index(kind)].append((a, b))
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of spans that overlap, the first one, and what of others lies beyond."""
    out, at = [], 0
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if e > at:
            out += [text[at : max(s, at)], f"[{k.upper()}]"]
            at = e
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                base, found = spans(text.as_py())
                kinds = [f[0] for f in found]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found) - len(base)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    ship(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind; null stays null. Other columns, of whatever name, are unchanged."""

    @F.pandas_udf("string")
    def clean(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: t if t is None else redact(t, spans(t)[1]))

    ship(docs.sparkSession)
    return docs.withColumn("text", clean("text"))
