"""Personal data (operator 6): expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rowloom.llm.common import pieces, with_row_key

THRESHOLD = 0.5
#: Characters before and after a span that are searched for context words.
CONTEXT = 60


def luhn(s: str) -> bool:
    """Digits whose Luhn sum is a multiple of 10, as on payment cards."""
    digits = [int(c) for c in s if c.isdigit()]
    total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and total % 10 == 0


def mod97(s: str) -> bool:
    """An IBAN whose rearranged number is 1 modulo 97."""
    s = re.sub(r"[\s-]", "", s).upper()
    return 15 <= len(s) <= 34 and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn_valid(s: str) -> bool:
    area, group, serial = re.split(r"[- ]", s)
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def ip_valid(s: str) -> bool:
    return all(part == str(int(part)) and int(part) < 256 for part in s.split("."))


def phone_valid(s: str) -> bool:
    return 7 <= sum(c.isdigit() for c in s) <= 15


def secret_valid(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


#: Kinds whose validator is a checksum: what fails it is no such number, whatever stands near.
CHECKSUMS = ("credit_card", "iban")
#: kind, expression, validator, score as proposed, score once confirmed, context words that add 0.3, words that take 0.4.
#: Where spans of two kinds overlap, the higher score stays; on equal scores the earlier kind.
KINDS: list[tuple[str, str, Callable[[str], bool] | None, float, float, str, str]] = [
    ("email", r"(?<![\w.+-])[\w+-][\w.+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*?\.[A-Za-z]{2,}+(?![\w-]|\.[A-Za-z0-9])", None, 0.9, 0.9, r"e-?mail|contact|kontakt|correo|courriel", r"(?!)"),
    ("credit_card", r"(?<![\w.+-])[2-6]\d{3}(?:[ -]?\d){8,14}\d(?![\w-])(?!\.\d)", luhn, 0.0, 0.9, r"card|visa|mastercard|amex|payment|carte|karte|tarjeta", r"order|isbn|sku|part no"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}\b", mod97, 0.0, 0.95, r"iban|account|bank|konto|compte|cuenta", r"(?!)"),
    ("ssn", r"(?<![\w.-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])(?!\.\d)", ssn_valid, 0.2, 0.6, r"ssn|social security|taxpayer", r"order|part no|sku"),
    ("ip", r"(?<![\w.-])(?:\d{1,3}\.){3}\d{1,3}(?![\w-])(?!\.\d)", ip_valid, 0.1, 0.6, r"\bip\b|host|server|address|adresse|direcci", r"version|section|release"),
    ("phone", r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{1,4}[ /-]\d{2,4}(?:[ -]?\d{2,4}){1,3})(?![\w-])(?!\.\d)", phone_valid, 0.3, 0.6, r"phone|tel\b|tel\.|mobile|call|fax|telefon|tél", r"order|isbn|version|part no"),
    ("secret", r"(?i)(?:\b(?:api[_-]?key|token|secret|passw(?:or)?d|access[_-]?key)[\"']?\s*[:=]\s*[\"']?)(?P<v>[A-Za-z0-9_\-/+=.]{8,}+)", secret_valid, 0.3, 0.9, r"key|token|secret|bearer", r"example|placeholder|changeme"),
]
_COMPILED = [(kind, re.compile(rx), valid, low, high, re.compile(plus, re.I), re.compile(minus, re.I)) for kind, rx, valid, low, high, plus, minus in KINDS]
_DIGITS = re.compile(r"\d[\d ().+/-]{5,}\d|\d(?:\.\d{1,3}){3}")
_SECRET = re.compile(r"(?i)key|token|secret|passw")
_IBAN = re.compile(r"[A-Z]{2}\d{2}")


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, confirmed) of the whole text, without overlaps, in order of start."""
    found = []
    numbers = _DIGITS.search(text) is not None
    for rank, (kind, rx, valid, low, high, plus, minus) in enumerate(_COMPILED):
        if kind == "email":
            if "@" not in text:
                continue
        elif kind == "secret":
            if not _SECRET.search(text):
                continue
        elif kind == "iban":
            if not _IBAN.search(text):
                continue
        elif not numbers:
            continue
        for m in rx.finditer(text):
            a, b = m.span("v") if kind == "secret" else m.span()
            ok = valid is None or valid(text[a:b])
            if not ok and kind == "iban":
                # the run may have swallowed words in capitals: the longest confirmed lead counts
                ends = [e for e in range(b, a + 14, -1) if text[e - 1].isalnum() and (e == b or not text[e].isalnum()) and mod97(text[a:e])]
                if ends:
                    b, ok = ends[0], True
            if not ok and kind in CHECKSUMS:
                continue
            score = high if ok else low
            near = text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]
            if plus.search(near):
                score += 0.3
            if minus.search(near):
                score -= 0.4
            score = round(min(1.0, max(0.0, score)), 4)
            if score >= threshold:
                found.append((-score, rank, a, b, kind, ok))
    found.sort()
    # spans taken so far, by start; they do not overlap, so only the neighbours of a new one can
    starts: list[int] = []
    taken: list[tuple[str, int, int, float, bool]] = []
    for s, _, a, b, kind, ok in found:
        i = bisect_left(starts, a)
        if (i == 0 or taken[i - 1][2] <= a) and (i == len(taken) or b <= taken[i][1]):
            starts.insert(i, a)
            taken.insert(i, (kind, a, b, -s, ok))
    return taken


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, kind, start, end, value, score, confirmed) for each span that scores ``threshold`` or more.

    Positions count characters of the whole text; ``end`` is exclusive.  A card number must meet Luhn's checksum and an
    IBAN modulo 97, else it is no finding.  The other validators (ranges of octets and areas, digit counts, letters and
    digits in a secret) only set the score: ``confirmed`` tells whether the validator accepted the span, and one that it
    did not needs context words to pass.  Kinds without a validator count as confirmed.  Overlaps go to the higher score, then to the kind listed first in ``KINDS``, then
    to the earlier start.  NULL, empty and blank texts give no row; rows with a NULL id are searched too and give a
    NULL doc_id.  Repeated rows give their spans each time.  Other columns are ignored.  It runs on each text by
    itself: no shuffle.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "k1"):
                rows = []
                for i, t in zip(part.column("k0").to_pylist(), part.column("k1").to_pylist()):
                    if t:
                        rows += [(i, k, a, b, t[a:b], s, ok) for k, a, b, s, ok in spans(t, threshold)]
                if rows:
                    c = list(zip(*rows))
                    yield pa.record_batch({"doc_id": pa.array(c[0], pa.int64()), "kind": pa.array(c[1], pa.string()), "start": pa.array(c[2], pa.int32()), "end": pa.array(c[3], pa.int32()), "value": pa.array(c[4], pa.string()), "score": pa.array(c[5], pa.float64()), "confirmed": pa.array(c[6], pa.bool_())})

    return with_row_key(docs, [id_col, text_col]).mapInArrow(search, "doc_id long, kind string, start int, end int, value string, score double, confirmed boolean")
