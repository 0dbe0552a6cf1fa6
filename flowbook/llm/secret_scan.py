"""Secret scans (op2).

Fixed patterns find assignments, access keys and long hex runs.  Beside them, the
method looks at candidate strings: maximal runs of ``[A-Za-z0-9+/_=-]`` of at
least ``Entropy.window`` characters.  A window slides over each candidate, the
counts of its characters are kept incrementally, and the Shannon entropy is held
against the limit of the narrowest character class that the window fits (digits,
hex of either case, letters and digits, base64).  A candidate with a window above
the limit is one span, the whole of it.  The allow list (uuids, dates and numbers,
paths and words joined by signs) holds for parts of a candidate, between signs: a
window over allowed parts alone is none; base spans are not suppressed.

Spans are in code points, end exclusive, and are the whole matches.  Null text is
empty and has no span; repeated rows are scanned one by one; other columns pass
through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbook.llm.store import columns, lean

KINDS = ["assign", "access", "hex", "entropy"]
_DIGITS, _HEXA = frozenset("0123456789"), frozenset("0123456789abcdefABCDEF")

_ANY = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
ASSIGN = re.compile(f"({'|'.join(map(_ANY, ('password', 'passwd', 'secret', 'token')))}|{_ANY('api')}_?{_ANY('key')})"
                    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # as maximal runs: those of ``[0-9a-f]+`` with 16 or more
UUID = re.compile(r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])")
#: Parts between signs: numbers, also with a unit (3d, 10th), and words of any case (camelCase, iPhone, HTTPServer), also with a short number.
PLAIN = re.compile(r"[0-9]+|[0-9]{1,4}[a-z]{1,2}|[a-z]*(?:[A-Z]+[a-z]{2,})*[A-Z]*[0-9]{0,4}")
_PART = re.compile(r"[A-Za-z0-9]+")


def odd_parts(text: str) -> list[tuple[int, int]]:
    """The parts of a candidate that are not on the allow list."""
    if "-" in text:
        text = UUID.sub(lambda m: "-" * len(m[0]), text)
    return [m.span() for m in _PART.finditer(text) if not PLAIN.fullmatch(m[0])]


@dataclass(frozen=True)
class Entropy:
    """Window length and limits, in bits a character, by the window's character class."""

    window: int = 20
    digits: float = 4.0   # over log2(10): digits alone are never a secret
    hexadecimal: float = 3.0
    alnum: float = 3.6
    base64: float = 3.8


def is_secret(text: str, e: Entropy) -> bool:
    """Whether a window that touches an odd part has an entropy over its class's limit."""
    odd = odd_parts(text)
    if not odd:
        return False
    w = e.window
    counts: dict[str, int] = {}
    part = [0.0] + [k * math.log2(k) for k in range(1, w + 2)]  # a window and the next character
    total, d, h, a, at = 0.0, 0, 0, 0, 0  # sum of k log2 k; characters by class; the first odd part that ends in or after the window
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += part[k + 1] - part[k]
        d, h, a = d + (c in _DIGITS), h + (c in _HEXA), a + c.isalnum()
        if i >= w:
            c = text[i - w]
            k = counts[c]
            counts[c] = k - 1
            total += part[k - 1] - part[k]
            d, h, a = d - (c in _DIGITS), h - (c in _HEXA), a - c.isalnum()
        if i >= w - 1:
            while at < len(odd) and odd[at][1] <= i - w + 1:
                at += 1
            if at == len(odd):
                return False
            limit = e.digits if d == w else e.hexadecimal if h == w else e.alnum if a == w else e.base64
            if odd[at][0] <= i and math.log2(w) - total / w >= limit - 1e-9:
                return True
    return False


def find_spans(text: str | None, e: Entropy = Entropy()) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, in order."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in _candidates(e.window).finditer(text):
        if is_secret(m[0], e):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_made: dict[int, re.Pattern] = {}


def _candidates(window: int) -> re.Pattern:
    return _made.setdefault(window, re.compile(rf"[A-Za-z0-9+/_=-]{{{window},}}"))


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """``text`` with each run of overlapping spans replaced by ``mark``; in an
    assignment only the value goes."""
    if not spans:
        return text
    out, at, merged = [], 0, []
    for s, kind, end in spans:
        if kind == 0:
            m = ASSIGN.match(text, s)
            s = m.start(2)
        merged.append((s, end))
    for s, end in _union(sorted(merged)):
        out += [text[at:s], mark]
        at = end
    return "".join([*out, text[at:]])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, text_col: str = "text", entropy: Entropy = Entropy(), keep_text: bool = False) -> DataFrame:
    """``docs`` with ``secret_spans`` array<struct<kind, start, end>>; with
    ``keep_text`` false, without the text column."""
    own = [c for c in docs.columns if keep_text or c != text_col]
    schema = columns(docs.select(*[F.col(f"`{c}`") for c in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, entropy)]
                                  for t in part.column("flowbook_text").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(own))], spans], names=[*own, "secret_spans"])

    return docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").alias("flowbook_text")).mapInArrow(
        lean(run), f"{schema}secret_spans array<struct<kind: string, start: long, end: long>>")


def redacted(docs: DataFrame, text_col: str = "text", entropy: Entropy = Entropy()) -> DataFrame:
    """``docs`` with every found secret replaced; texts without one are as they were."""
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                cols = list(part.columns)
                cols[k] = pa.array([redact(t, find_spans(t, entropy)) for t in cols[k].to_pylist()], cols[k].type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(lean(run), columns(docs)[:-2])


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(join_spans(spans).encode()).hexdigest()
