"""Personal data with offset-preserving deobfuscation.

Base spans are emails, IP addresses, card and phone numbers as they stand. On
top, transducers rewrite a text step by step, carrying for each character where
it came from: look-alike characters become ASCII and invisible ones go,
disguised at and dot signs (in words, brackets, character references, percent
codes or set apart by spaces) become @ and ., spelled digits become digits. What
the same detectors find in the rewritten text is mapped back to the characters
of the source and added, if a rewrite touched it and no base span of its kind
already covers it.

To leave clean prose alone, a bare word "at", a sign set apart or a letter in
brackets only counts before a domain with a disguised dot; where none of that
domain's dots is in brackets, the domain must end in a well-known top-level label
and the name before must not be a function word, a verb of being or one of
meeting ("see us at", "we met at"). A domain whose last dot is a bare word must end
in such a label in any case, and the last part of every disguised domain must be
letters. A transducer is passed over where a text lacks a string that all
its matches hold; this changes no result.
Patterns run in linear time: no start is tried inside a run that failed.
Texts are handled one by one, whole; nothing is gathered.

Defined results: a null text has no spans. Rows are independent, so repeated
rows have equal results. Empty tables give empty results; other columns pass
through, save those named like the outputs, which are replaced. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ε": "e", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "օ": "o", "ո": "n", "ս": "u", "հ": "h",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", " ": " ", " ": " ", " ": " ",
}
# Characters that don't show.
INVISIBLE = "­​‌‍⁠᠎﻿"
# Digits in words, by language.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Character references and percent codes of the signs that identifiers need.
REFERENCES = {"commat": "@", "period": ".", "plus": "+", "hyphen": "-", "lowbar": "_", "lpar": "(", "rpar": ")", "num": "#", "nbsp": " "}
PERCENT = {"40": "@", "2e": ".", "2b": "+", "2d": "-", "5f": "_", "20": " "}
# Top-level labels that a domain in plain words may end in; none is a word of English.
TOP = frozenset("com org net edu gov mil info biz io uk de fr es eu ch nl pl dk fi cz ru jp cn br au ca nz mx ar cl pt gr tr kr tw hk sg za il ie hu ro ua".split())
# Words that stand before "at" in prose and are nobody's name.
NO_NAME = frozenset(
    "i you he she it we they me him her us them myself yourself himself herself itself ourselves themselves who whom which that this these those one ones someone anyone everyone all both each any some none "
    "a an the and or but if so as not no yes only just even still also again then now there here when where while is am are was were be been being has have had do does did done "
    "arrive arrived arrives look looked looks looking meet meets met meeting see sees saw seen visit visited stay stayed stays live lives lived work works worked working start starts started stop stopped "
    "sit sits sat stand stands stood wait waits waited stare stared shout shouted laugh laughed good best better bad home up down in on off out over back "
    "er sie es wir ihr mich mir uns euch ihn ihm ist war sind waren il elle nous vous ils elles moi lui est sont yo el ella nosotros ellos me te nos es son".split()
)
RAW, LOOKS, BRACKETED, BARE, SPELLED = range(5)


class _Fold(dict):
    """str.translate table: the ASCII character a character looks like; found once for each."""

    def __missing__(self, point: int) -> int:
        char = chr(point)
        plain = LOOKALIKES.get(char) or unicodedata.normalize("NFKC", char)
        if len(plain) != 1 or not plain.isascii():
            digit = unicodedata.digit(char, None)
            plain = str(digit) if digit is not None else char
        self[point] = ord(plain) if len(plain) == 1 else point
        return self[point]


_FOLD = _Fold({i: i for i in range(128)})
_UNSEEN = re.compile(f"[{INVISIBLE}]")
_AT = re.compile(r"(?:(?<!\s)\s++)?(?:\(\s*(?:at|@|arroba|ät)\s*\)|\[\s*(?:at|@|arroba|ät)\s*\]|\{\s*(?:at|@|arroba|ät)\s*\}|<\s*(?:at|@|arroba|ät)\s*>)\s*", re.I)
_DOT = re.compile(r"(?:(?<!\s)\s++)?(?:\(\s*(?:dot|\.|punkt|point|punto)\s*\)|\[\s*(?:dot|\.|punkt|point|punto)\s*\]|\{\s*(?:dot|\.|punkt|point|punto)\s*\}|<\s*(?:dot|\.|punkt|point|punto)\s*>)\s*", re.I)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])(?:\s+|_)(?:dot|punkt|point|punto)(?:\s+|_)(?=[A-Za-z0-9])", re.I)
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\s+|_)(?:at|arroba)(?:\s+|_)(?=[A-Za-z0-9])", re.I)
_LETTER_AT = re.compile(r"(?<=[A-Za-z0-9])\s*+(?:\(a\)|\[a\]|\{a\})\s*+(?=[A-Za-z0-9])", re.I)
_LETTER_DOT = re.compile(r"(?<=[A-Za-z0-9])\s*+(?:\(d\)|\[d\]|\{d\})\s*+(?=[A-Za-z0-9])", re.I)
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){2,3}\.[0-9]{1,7}(?![0-9.])")
_APART_DOT = re.compile(r"(?<=[A-Za-z0-9]) \. (?=[A-Za-z0-9])")
_APART_AT = re.compile(r"(?<=[A-Za-z0-9]) @ (?=[A-Za-z0-9])")
_REFERENCE = re.compile(rf"&(?:#(\d{{2,3}})|#[xX]([0-9A-Fa-f]{{2}})|({'|'.join(REFERENCES)}));")
_PERCENT = re.compile(rf"%({'|'.join(PERCENT)})", re.I)
_DOTS = ("dot", "punkt", "point", "punto")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORDS})(?:[\s,-]{{1,3}}(?:{_WORDS})(?![^\W_]))*+(?![^\W_])", re.I)
_ONE_WORD = re.compile(_WORDS, re.I)
_PLUS = re.compile(r"(?<![^\W_])plus\s+(?=[0-9])", re.I)
_MISREAD = re.compile(r"(?<=[0-9])(?:[Oo]|[Il|])(?=[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and _LOCAL.match(text, low - 1):
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at)):
            yield low, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def detect(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, number of the kind, end) of a text as it stands."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(s, 1, e) for s, e in _ips(text)]
        found += [(s, 2, e) for s, e in _cards(text)]
        if "+" in text:
            found += [(s, 3, e) for s, e in _phones(text)]
    return sorted(found)


@dataclass
class Rewritten:
    """A text after some transducers: of each character, the source's code points it stands for and how it came about."""

    text: str
    start: np.ndarray
    end: np.ndarray
    how: np.ndarray

    @staticmethod
    def of(text: str) -> Rewritten:
        at = np.arange(len(text))
        return Rewritten(text, at, at + 1, np.zeros(len(text), np.uint8))

    def fold(self) -> Rewritten:
        plain = self.text.translate(_FOLD)
        if plain == self.text:
            return self
        changed = np.frombuffer(plain.encode("utf-32-le"), "<u4") != np.frombuffer(self.text.encode("utf-32-le"), "<u4")
        return Rewritten(plain, self.start, self.end, np.where(changed, LOOKS, self.how).astype(np.uint8))

    def replace(self, pattern: re.Pattern, by: Callable[[re.Match], str], how: int) -> Rewritten:
        """Every match becomes by(match); a character of it stands for its part of the match, or the whole if there is one."""
        texts, starts, ends, hows, low = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            new, (a, b) = by(m), m.span()
            texts += [self.text[low:a], new]
            edges = np.linspace(a, b, len(new) + 1).astype(int)
            starts += [self.start[low:a], self.start[edges[:-1]]]
            ends += [self.end[low:a], self.end[edges[1:] - 1]]
            hows += [self.how[low:a], np.full(len(new), how, np.uint8)]
            low = b
        if not texts:
            return self
        return Rewritten("".join([*texts, self.text[low:]]), *(np.concatenate([*x, own[low:]]) for x, own in ((starts, self.start), (ends, self.end), (hows, self.how))))


def _referred(m: re.Match) -> str:
    """What a character reference stands for, if that is a printable ASCII character; else itself."""
    if m[3]:
        return REFERENCES[m[3]]
    point = int(m[1]) if m[1] else int(m[2], 16)
    return chr(point) if 32 <= point < 127 else m[0]


def deobfuscate(text: str, guarded: bool = True) -> Rewritten:
    """guarded: transducers that can't match, or whose matches can't matter, aren't tried."""
    out = Rewritten.of(text)
    if not (guarded and text.isascii()):
        out = out.replace(_UNSEEN, lambda m: "", RAW).fold()
    if not guarded or "&" in out.text:
        out = out.replace(_REFERENCE, _referred, BRACKETED)
    if not guarded or "%" in out.text:
        out = out.replace(_PERCENT, lambda m: PERCENT[m[1].lower()], BRACKETED)
    if not guarded or any(c in out.text for c in "([{<"):
        out = out.replace(_AT, lambda m: "@", BRACKETED).replace(_DOT, lambda m: ".", BRACKETED)
        out = out.replace(_LETTER_DOT, lambda m: ".", BARE).replace(_LETTER_AT, lambda m: "@", BARE)
    out = out.replace(_SPELLED, lambda m: "".join(DIGIT_WORDS[w[0].lower()] for w in _ONE_WORD.finditer(m[0])), SPELLED)
    low = out.text.lower()
    if not guarded or any(w in low for w in _DOTS):
        out = out.replace(_BARE_DOT, lambda m: ".", BARE)
    if not guarded or " . " in out.text:
        out = out.replace(_APART_DOT, lambda m: ".", BARE)
    if not guarded or out.how.any():  # an at sign in words asks for a dot in disguise
        out = out.replace(_BARE_AT, lambda m: "@", BARE)
        if not guarded or " @ " in out.text:
            out = out.replace(_APART_AT, lambda m: "@", BARE)
    if not guarded or "plus" in low:
        out = out.replace(_PLUS, lambda m: "+", SPELLED)
    if not guarded or "." in out.text:
        out = out.replace(_DOTTED, lambda m: m[0].replace(".", "-"), LOOKS)
    return out.replace(_MISREAD, lambda m: "0" if m[0] in "Oo" else "1", LOOKS)


def hidden(text: str, base: list[tuple[int, int, int]], guarded: bool = True) -> list[tuple[int, int, int]]:
    """Spans that only show once the text is deobfuscated, in code points of the text itself."""
    clear = deobfuscate(text, guarded)
    if clear.text == text:
        return []
    found = []
    for s, kind, e in detect(clear.text):
        source = int(clear.start[s]), kind, int(clear.end[e - 1])
        how = clear.how[s:e]
        if not how.any() and source[2] - source[0] == e - s:
            continue
        if kind == 0:
            at = clear.text.index("@", s, e)
            dots = [i for i in range(at, e) if clear.text[i] == "."]
            top = clear.text[dots[-1] + 1 : e]
            if not re.fullmatch("[A-Za-z]{2,}", top) or clear.how[dots[-1]] == BARE and top.lower() not in TOP:
                continue
            if clear.how[at] == BARE:
                ways = {int(clear.how[i]) for i in dots}
                if not ways & {BRACKETED, BARE} or BRACKETED not in ways and (top.lower() not in TOP or text[source[0] : int(clear.start[at])].strip().lower() in NO_NAME):
                    continue
        if not any(k == kind and a <= source[0] and source[2] <= b for a, k, b in base):
            found.append(source)
    return found


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, by start and kind."""
    if not text:
        return [], []
    base = detect(text)
    more = hidden(text, base)
    return base, sorted({*base, *more}) if more else base


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redact(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with each run of overlapping spans as its first kind in brackets."""
    if not found:
        return text
    out, low, end = [], 0, -1
    for s, kind, e in found:
        if s >= end:
            out += [text[low:s] if end < 0 else text[end:s], f"[{KINDS[kind].upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def find(docs: DataFrame, text_col: str = "text", redacted: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (of all spans), base_sha256 and spans.

    redacted: instead, docs with the spans in text_col replaced by their kind.
    """
    outputs = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    if not redacted:
        docs = docs.drop(*outputs)
    fields = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            if redacted:
                new = pa.array([redact(x, spans(x)[1]) for x in (t.as_py() for t in texts)], pa.string())
                at = batch.schema.get_field_index(text_col)
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)
                continue
            counts, digests, lists = [[] for _ in KINDS], [], []
            for t in texts:
                base, full = spans(t.as_py())
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in full))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                lists.append(written(full))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string())], [*batch.schema.names, *outputs])

    if redacted:
        return docs.mapInArrow(run, docs.schema)
    types = [T.LongType()] * len(KINDS) + [T.StringType()] * 2
    return docs.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, t) for n, t in zip(outputs, types, strict=True))]))
