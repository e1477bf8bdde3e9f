r"""Personal data in texts, also where it is disguised, with offsets into the source.

E-mail addresses, IP addresses, card and phone numbers are detected as they
stand (the *base* spans).  Then a chain of transducers rewrites the text:

* letters and digits that look like ASCII ones become these, invisible
  characters vanish,
* spelled digits become digits ("four double one" is ``411``), "plus" before
  one becomes ``+``,
* ``[at]``, ``(dot)`` and their spelled forms become ``@`` and ``.``.

Each replacement keeps the span of the source that it stands for, so what the
same detectors find in the rewritten text is mapped back to the source.  A bare
"at" is only an ``@`` where a disguised dot follows its next word.

All patterns are linear: a run of characters is looked at a bounded number of
times, however long it is.  Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# Base detectors

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Addresses, found from their ``@``: before it a run of local characters, after it labels with dots."""
    begin, at = 0, text.find("@")
    while at >= 0:
        start = begin + len(text[begin:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        begin = domain.end() if domain else at + 1
        if domain:
            yield start, begin
        at = text.find("@", begin)


def ips(text: str) -> Iterator[Span]:
    """Of each run of numbers with dots between, every four that follow each other, from the left."""
    for m in _DOTTED.finditer(text):
        numbers, start = m[0].split("."), m.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(part) <= 3 and int(part or "0") <= 255 for part in (part.lstrip("0") for part in four)):
                yield start, end
            start = end + 1


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


DETECTORS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))

# Transducers

# Letters of other alphabets and the ASCII letters that they look like, dashes, full stops, and characters without a width.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјкмнорсухԁһԛԝ", "ABESIJKMHOPCTYXaesijkmHopcyxdhqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABEZHIKMNOPTYXaiKvopux", strict=True))
DASHES_AND_DOTS = dict.fromkeys("‐‑‒–—―−", "-") | dict.fromkeys("。｡․", ".")
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
# How digits, "plus", "at" and "dot" are spelled in English, German, French and Spanish.
DIGIT_WORDS = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"), ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
TIMES = {"double": 2, "triple": 3}
PLUS, AT, DOT = ("plus", "más"), ("at", "arroba", "arobase"), ("dot", "punkt", "point", "punto")

_VALUES = {word: str(n) for n, words in enumerate(DIGIT_WORDS) for word in words}


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_GAP, _SOME = r"[ \t]{0,3}", r"[ \t]{1,3}"
_DIGIT_WORD = rf"(?:{_any(TIMES)}{_SOME})?{_any(_VALUES)}\b"


def _bracketed(inner: str) -> str:
    return rf"[\[({{<]{_GAP}{inner}{_GAP}[\])}}>]{_GAP}"


_HIDDEN_DOT = rf"(?:{_SOME}{_any(DOT)}{_SOME}|{_GAP}{_bracketed(_any((*DOT, re.escape('.'))))})"
#: Where a disguise may lie: its word, bracket or invisible character.
_CORE = re.compile(
    rf"\b(?:{'|'.join(sorted(w for words in (_VALUES, TIMES, PLUS, AT, DOT) for w in words))})\b"
    rf"|[\[({{<]{_GAP}{_any((*AT, *DOT, '@', re.escape('.')))}{_GAP}[\])}}>]|[{INVISIBLE}]+"
)
#: What it is, from its first character (of the blanks before it) on.
_DISGUISE = re.compile(
    rf"(?P<gone>[{INVISIBLE}]+)"
    rf"|(?P<digit>{_DIGIT_WORD})(?:(?:{_SOME}|-)(?={_DIGIT_WORD}))?"
    rf"|(?P<plus>{_any(PLUS)}){_SOME}(?=[0-9]|{_DIGIT_WORD})"
    rf"|(?P<at>(?<=[a-z0-9._%+-]){_GAP}{_bracketed(_any((*AT, '@')))}(?=[a-z0-9])"
    rf"|(?<=[a-z0-9._%+-]){_SOME}{_any(AT)}{_SOME}(?=[a-z0-9-]{{1,63}}{_HIDDEN_DOT}[a-z0-9]))"
    rf"|(?P<dot>(?<=[^\W_]){_HIDDEN_DOT}(?=[^\W_]))"
)


def _lower(text: str) -> str:
    """Lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def disguises(low: str) -> Iterator[re.Match]:
    """What is disguised in a text of lower-case letters, from left to right."""
    done = 0
    for core in _CORE.finditer(low):
        at = core.start()
        if at < done:
            continue
        before = low[max(done, at - 4) : at]
        blanks = len(before) - len(before.rstrip(" \t"))
        m = _DISGUISE.match(low, at - blanks) or (blanks and _DISGUISE.match(low, at)) or None
        if m:
            done = m.end()
            yield m


@lru_cache(maxsize=1)
def lookalikes() -> dict[int, str]:
    """One ASCII character for each character that stands for it: digits of any script, compatible forms, and the letters listed."""
    table = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        digit = unicodedata.decimal(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and plain.isprintable():
            table[code] = plain
    return table | {ord(c): plain for c, plain in (CYRILLIC | GREEK | DASHES_AND_DOTS).items()}


@lru_cache(maxsize=1)
def _sources() -> frozenset[str]:
    return frozenset(map(chr, lookalikes()))


def plain_letters(text: str) -> str:
    """The text with ASCII characters for those that look like them; its length stays."""
    return text if text.isascii() or _sources().isdisjoint(text) else text.translate(lookalikes())


def _replacement(m: re.Match) -> str:
    if m["digit"]:
        *times, word = m["digit"].split()
        return _VALUES[word] * (TIMES[times[0]] if times else 1)
    return {"gone": "", "plus": "+", "at": "@", "dot": "."}[m.lastgroup]


class Rewritten:
    """A text after all transducers, and where its characters come from."""

    def __init__(self, source: str):
        plain = plain_letters(source)
        parts, self.starts, self.ends, self.sources = [], [], [], []
        done = length = 0
        for m in disguises(_lower(plain)):
            new = _replacement(m)
            parts += [plain[done : m.start()], new]
            length += m.start() - done
            self.starts.append(length)
            length += len(new)
            self.ends.append(length)
            self.sources.append(m.span())
            done = m.end()
        self.text = "".join([*parts, plain[done:]])

    def _of(self, i: int) -> Span:
        """The span of the source that character ``i`` stands for."""
        k = bisect_right(self.starts, i) - 1
        if k < 0:
            return i, i + 1
        if i < self.ends[k]:
            return self.sources[k]
        start = self.sources[k][1] + i - self.ends[k]
        return start, start + 1

    def to_source(self, span: Span) -> Span:
        return self._of(span[0])[0], self._of(span[1] - 1)[1]


def _likely(kind: str, found: str) -> bool:
    """Of addresses out of a rewritten text, only those that end with a name of letters."""
    last = found.rsplit(".", 1)[-1]
    return kind != "email" or (2 <= len(last) <= 24 and last.isalpha())


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans ``(kind, start, end, base)``, by kind in the order of ``KINDS``, then by start, end."""
    base = {kind: list(detect(text)) for kind, detect in DETECTORS.items()}
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    rewritten = Rewritten(text)
    if rewritten.text != text:
        for kind, detect in DETECTORS.items():
            starts = [s for s, _ in base[kind]]
            for span in detect(rewritten.text):
                start, end = rewritten.to_source(span)
                found = rewritten.text[slice(*span)]
                k = bisect_right(starts, start) - 1
                known = k >= 0 and end <= base[kind][k][1]
                if not known and found != text[start:end] and _likely(kind, found):
                    added[kind].append((start, end))
    return [
        (kind, start, end, is_base) for kind in KINDS
        for start, end, is_base in sorted([(*s, True) for s in base[kind]] + [(*s, False) for s in added[kind]])
    ]


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with ``<KIND>`` in place of each span; spans that overlap become one, named after the first."""
    parts, done = [], 0
    for start, end, kind in sorted((start, end, kind) for kind, start, end, _ in spans):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


# Over tables


def with_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", redacted_col: str | None = None) -> DataFrame:
    """The rows with all spans of their texts; ``redacted_col`` names one more column for the redacted text.

    Texts are looked at whole, one at a time, where they lie; a very long one
    costs time in proportion to its length.  A null text has no spans and a
    null redacted text, an empty one none and an empty one.  Every other column
    is kept, a column of the same name is replaced; repeated rows stay.
    """
    kept = [c for c in docs.columns if c not in (spans_col, redacted_col)]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(kept.index(text_col))
            spans, redacted = [], []
            for value in texts:
                text = value.as_py()
                found = find(text or "")
                spans.append([{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in found])
                if redacted_col:
                    redacted.append(text and redact(text, found))
            columns, names = [*batch.columns, pa.array(spans, kind)], [*kept, spans_col]
            if redacted_col:
                columns.append(pa.array(redacted, pa.string()))
                names.append(redacted_col)
            yield pa.record_batch(columns, names)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    schema += f", `{spans_col}` {SPANS}" + (f", `{redacted_col}` string" if redacted_col else "")
    return docs.select(*kept).mapInArrow(run, schema)


def _written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base counts ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``, ``n_added``.

    ``base_sha256`` is the digest of the base spans as ``kind:start:end``, by
    kind and start, comma-joined; ``spans`` lists all spans in that form, those
    that the transducers add included; ``n_added`` counts these.  Null and
    empty texts have none.  A null id stays null, repeated rows are a row each,
    an empty table has none, and other columns take no part.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_spans(rows).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        F.col("id").alias(id_col),
        *[_count(base, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_written_out(base).cast("binary"), 256).alias("base_sha256"), _written_out(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
