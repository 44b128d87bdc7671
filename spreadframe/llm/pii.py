"""Personal data in texts: patterns propose spans, checksums confirm them, context scores them.

Each kind's pattern proposes leftmost spans that do not overlap. A card number must pass
Luhn and an IBAN mod 97; an address part is at most 255 and a phone number has 10 to 15
digits. A confirmed kind starts from a score of its own, which words close by raise
or lower; added kinds stay only from ``KEEP`` on, the four base kinds always.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "key")
KEEP = 0.5
#: Code points before a span, and after it, in which context words count.
NEAR = 48

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")
_ASSIGNED = re.compile(
    r"(?<![A-Za-z0-9])(?:token|secret|passw(?:or)?d|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?)[\"']?[ \t]*(?::=|=>|[:=])[ \t]*[\"']?"
    r"((?=[A-Za-z0-9_/+=.-]{0,99}?[0-9])[A-Za-z0-9_/+.-]{16,}={0,2})",
    re.I,
)
_DIGITS = re.compile(r"[0-9]")
_START = {"email": 0.95, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "key": 0.7}
# context words of each kind; fixed values
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|ping|login|connect(?:ed|ion)?)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|payment|tarjeta|carte|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|call|tel|mobile|fax|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|transfer|cuenta|compte|konto)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|tax)\b", re.I),
    "key": re.compile(r"\b(?:key|token|secret|api|password)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|example|sample|isbn|part no|order|invoice)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _address(parts: str) -> bool:
    """Whether every part is at most 255, however many digits it has."""
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in parts.split(".")))


def _base(text: str) -> list[tuple[int, int, int]]:
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _address(m[0])] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _added(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 6, m.end()) for m in _KEY.finditer(text)] if "sk-" in text or "AKIA" in text or "ghp_" in text else []
    if _DIGITS.search(text):
        found += [(m.start(), 4, m.end()) for m in _IBAN.finditer(text) if mod97(m[0])]
        found += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)] if "-" in text else []
        found += [(m.start(1), 6, m.end(1)) for m in _ASSIGNED.finditer(text)] if "=" in text or ":" in text else []
    # an assigned value that is itself a known form of key is one span
    return sorted(set(found))


def _free(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``spans`` that overlap no base span, by one search each among the ordered base spans."""
    ordered = sorted(base)
    starts, ends = [a for a, _, _ in ordered], list(accumulate((b for _, _, b in ordered), max))
    return [x for x in spans if not (at := bisect_left(starts, x[2])) or ends[at - 1] <= x[0]]


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """Kind, start, end (code points, end exclusive) and score of each span, by start and kind."""
    if not text:
        return []
    base = _base(text)
    out = []
    for a, k, b in sorted(base + _free(_added(text), base)):
        kind, near = KINDS[k], f"{text[max(0, a - NEAR) : a]} {text[b : b + NEAR]}"
        score = _START[kind] + (0.3 if _CONTEXT[kind].search(near) else 0) - (0.2 if _AGAINST.search(near) else 0)
        if k < len(BASE) or score >= KEEP:
            out.append((kind, a, b, round(min(1.0, max(0.0, score)), 3)))
    return out


SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def pii_spans(text: Column) -> Column:
    """Spans of a text as an array of structs kind, start, end, score; empty for null."""

    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t)] for t in texts], dtype=object)

    return F.pandas_udf(found, SPAN)(text.cast("string"))


def _masked(text: str, found: list[tuple[str, int, int, float]]) -> str:
    out, done = [], 0
    for kind, a, b, _ in found:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(text: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap share the first's."""

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, f) if t and (f := spans(t)) else t for t in texts], dtype=object)

    return F.pandas_udf(clean, "string")(text.cast("string"))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with columns n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans and pii.

    ``docs`` has ``text``; columns of the new names are replaced and all others kept.
    The counts and base_sha256 cover the four base kinds; spans lists every kept span as
    kind:start:end, n_spans counts them and pii holds them with scores. Null and empty
    texts have none (the hash is that of the empty string). Very long texts and runs of
    digits are read whole, in time linear in their length but for sorting the spans.
    Repeated rows and texts give equal rows. Rows stay one to one; an empty table stays empty.
    """

    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = spans(t)
            base = [x for x in found if x[0] in BASE]
            counts = [sum(x[0] == k for x in base) for k in BASE]
            listed = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in xs)
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found), len(found), [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in found]))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "pii"])

    new = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "pii"]
    own = [c for c in docs.columns if c not in (*new, "_pii")]
    found = F.pandas_udf(digest, f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, pii {SPAN}")
    return docs.select(*own, found(F.col("text").cast("string")).alias("_pii")).select(*own, *(f"_pii.{c}" for c in new))
