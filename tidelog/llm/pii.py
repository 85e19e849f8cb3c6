"""Personal data: patterns propose spans, checksums confirm them, context words near by adjust the score.

Null texts count as empty. Spans are (kind, start, end) in code points, end exclusive; spans of one kind never overlap.
Whole texts are searched; every pattern is linear in the text's length. The same text always gives the same spans, so
ties and repeated rows need no rule; other columns of the input are left alone.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import frugal, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Evidence from 0 to 1: what the pattern alone is worth, what a good checksum adds, what a context word adds or takes.
PATTERN_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.35}
CHECKSUM_GAIN, CONTEXT_GAIN, CONTEXT_LOSS = 0.4, 0.3, 0.3
ACCEPT = 0.6
CONTEXT_CHARS = 48
CONTEXT = {
    "card": ("card", "visa", "credit", "debit", "mastercard", "amex", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "iban": ("iban", "account", "bank", "transfer", "bic", "swift"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = ("order", "invoice", "isbn", "version", "part", "serial", "item")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins: a later start in the run ends at the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORDS = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each '@': walking back over the local part costs its length once."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield first, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What patterns and their checks find without context, by kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
    for m in _DIGITS.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def context(text: str, start: int, end: int, kind: str) -> float:
    """What the words just before and after the span say for or against it."""
    near = set(_WORDS.findall(text[max(0, start - CONTEXT_CHARS) : start].lower())) | set(_WORDS.findall(text[end : end + CONTEXT_CHARS // 2].lower()))
    return CONTEXT_GAIN * bool(near & set(CONTEXT.get(kind, ()))) - CONTEXT_LOSS * bool(near & set(AGAINST))


def _merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap made one, so that a place is looked up by bisection."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans that need context or another checksum: short cards, phones without '+', IBANs, social security numbers."""
    proposed: list[tuple[str, int, int, float]] = []
    for m in _DIGITS.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 15 and luhn(d):
            proposed.append(("card", m.start(), m.end(), CHECKSUM_GAIN - 0.3))
    proposed += [("phone", m.start(), m.end(), -0.25) for m in _LOCAL_PHONE.finditer(text)]
    for m in _IBAN.finditer(text):
        first, last = m.span()
        while last - first > 14:  # a following word in capitals may have been taken along
            s = text[first:last].replace(" ", "")
            if 15 <= len(s) <= 34 and mod97(s):
                proposed.append(("iban", first, last, CHECKSUM_GAIN))
                break
            cut = text.rfind(" ", first, last)
            if cut < 0:
                break
            last = cut
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            proposed.append(("ssn", m.start(), m.end(), 0.0))
    out: list[tuple[str, int, int, float]] = []
    taken = _merged((a, b) for _, a, b in base)
    for kind, a, b, extra in proposed:
        score = PATTERN_SCORE[kind] + extra + context(text, a, b, kind)
        if score >= ACCEPT - 1e-9:
            at = bisect.bisect_right(taken, (a, a)) if taken else 0
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                taken.insert(at, (a, b))
                out.append((kind, a, b, min(1.0, score)))
    return out


def find_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans); all spans hold the base ones, in order of kind and start."""
    text = text or ""
    base = base_spans(text)
    added = [x[:3] for x in added_spans(text, base)] if any(c in text for c in "0123456789") else []
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1])) if added else base


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span becomes its kind in brackets; where spans of two kinds overlap, the first to start covers both."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base, every = find_spans(text)
            n = [sum(s[0] == k for s in base) for k in KINDS[:4]]
            rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def span_report(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, the digest of the base spans, and all spans."""
    return docs.select("doc_id", "text").mapInArrow(frugal(_report), _SPANS)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind; n_chars, if there, follows. A null text stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t)[1]) for t in batch.column("text").to_pylist()]
            cols = {n: batch.column(n) for n in names}
            cols["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], schema=batch.schema)

    return docs.mapInArrow(frugal(run), docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(table(spark, sf_dir, "documents"))
