"""Secret scan: named patterns, and windows of high entropy over candidate strings.

Candidates are maximal runs of the base64 alphabet (letters, digits, + / _ = -) of WINDOW characters or more that hold a digit.
A window of WINDOW characters slides over each; counts by character, and the sum of c*log2(c) over them, are kept
up to date by one character in and one out. The window's Shannon entropy is compared with the threshold of its
character class: hexadecimal, one-case letters with digits, or mixed. Windows over it are merged into spans,
and the allow list drops spans of known harmless shapes. A UUID, a date or a token with a stand-in cuts the run that holds it, so what
stands beside it is still scanned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelane.llm import textbytes as tb

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

WINDOW = 20
#: Bits a window of WINDOW characters must reach, by character class.
BITS = {"hex": 3.0, "one case": 3.7, "mixed": 3.9}
_UUID = rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_DATE = rb"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[Tt_-]?[0-9]{2}[_-]?[0-9]{2}(?:[_-]?[0-9]{2}(?:[0-9]{3}){0,3})?(?:[Zz]|[+-][0-9]{4})?)?"
#: Shapes of harmless strings: of a whole run or of a span.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        rb"[0-9]+",  # numbers
        _UUID,
        _DATE,  # dates and time stamps
        rb"(?:[A-Za-z]{2,}[_/=+-])*[A-Za-z]{2,}[0-9]{0,4}",  # identifiers and paths of words, perhaps numbered
    )
)
#: Harmless parts of a run, from one separator to another.
BOUNDED = re.compile(rb"(?<![A-Za-z0-9])(?:%s|%s)(?![A-Za-z0-9])" % (_UUID, _DATE))
#: Stand-ins, keyboard and alphabet runs; with one, the letters and digits around it are harmless up to a separator.
STAND_IN = re.compile(rb"(?i:example|sample|placeholder|changeme|dummy|your[_-]?(?:key|token|secret)|0123456789|1234567890|abcdefghij|qwertyuiop)")
_TOKEN_END = re.compile(rb"[A-Za-z0-9]*")

_HEX, _B64, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_HEX[[*b"0123456789abcdef"]] = True
_DIGIT[[*b"0123456789"]] = True
_B64[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"]] = True
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def character_class(has_lower: bool, has_upper: bool, has_digit: bool, has_other: bool, beyond_f: bool) -> str:
    if has_digit and not has_other and not beyond_f and not (has_lower and has_upper):
        return "hex"
    return "mixed" if has_other or has_lower and has_upper else "one case"


def hot_windows(text: bytes) -> list[tuple[int, int]]:
    """Merged spans of the windows of one candidate that reach the entropy threshold of their own class."""
    count, total, out = [0] * 256, 0.0, []
    kinds = [0, 0, 0, 0, 0]  # lower, upper, digits, others, letters beyond f

    def kind(b: int, by: int) -> None:
        if 97 <= b <= 122:
            kinds[0] += by
            kinds[4] += by * (b > 102)
        elif 65 <= b <= 90:
            kinds[1] += by
            kinds[4] += by * (b > 70)
        else:
            kinds[2 if 48 <= b <= 57 else 3] += by

    for i, b in enumerate(text):
        total += _CLOG[count[b] + 1] - _CLOG[count[b]]
        count[b] += 1
        kind(b, 1)
        if i >= WINDOW:
            gone = text[i - WINDOW]
            total += _CLOG[count[gone] - 1] - _CLOG[count[gone]]
            count[gone] -= 1
            kind(gone, -1)
        if i >= WINDOW - 1 and kinds[2]:
            bits = math.log2(WINDOW) - total / WINDOW
            if bits >= BITS[character_class(*(k > 0 for k in kinds))] - 1e-9:
                start = i - WINDOW + 1
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
    return out


def unknown_parts(text: bytes) -> list[tuple[int, int]]:
    """What is left of a run between its harmless parts."""
    harmless = [m.span() for m in BOUNDED.finditer(text)]
    end = 0
    for m in STAND_IN.finditer(text):
        if m.start() >= end:
            a = m.start()
            while a > end and text[a - 1 : a].isalnum():
                a -= 1
            end = _TOKEN_END.match(text, m.end()).end()
            harmless.append((a, end))
    out, at = [], 0
    for a, z in sorted(harmless):
        if a > at:
            out.append((at, a))
        at = max(at, z)
    return [*out, (at, len(text))] if at < len(text) else out


def runs(member: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of True of at least `least`, cut where documents begin."""
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    first = off[:-1][off[:-1] < len(member)]
    begins[first] = member[first]
    ends = member.copy()
    ends[:-1] &= ~member[1:]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = member[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start >= least
    return start[long], end[long]


def scan_block(raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(start, kind, end) in bytes of the texts in a block, by document; documents without finds are absent."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    data, low = raw.tobytes(), tb.LOWER[raw].tobytes()

    def of(position: int) -> int:
        return int(np.searchsorted(off, position, "right")) - 1

    def each(needle: bytes, hay: bytes) -> set[int]:
        docs, at = set(), hay.find(needle)
        while at >= 0:
            end = int(off[(d := of(at)) + 1])
            if inside := at + len(needle) <= end:  # else it spans two texts
                docs.add(d)
            at = hay.find(needle, end if inside else at + 1)
        return docs

    for d in set().union(*(each(x, low) for x in HINTS)):
        a, z = int(off[d]), int(off[d + 1])
        found.setdefault(d, []).extend((m.start(), 0, m.end()) for m in ASSIGN.finditer(data[a:z]) if len(m[2]) >= LEAST_VALUE)
    for d in each(b"AKIA", data):
        a, z = int(off[d]), int(off[d + 1])
        found.setdefault(d, []).extend((m.start(), 1, m.end()) for m in ACCESS.finditer(data[a:z]) if len(m[0]) >= LEAST_ACCESS)
    for s, e in zip(*runs(_HEX[raw], off, LEAST_HEX), strict=True):
        d = of(int(s))
        found.setdefault(d, []).append((int(s - off[d]), 2, int(e - off[d])))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw], dtype=np.int64)])
    for s, e in zip(*runs(_B64[raw], off, WINDOW), strict=True):
        if digits[e] == digits[s]:
            continue
        d = of(int(s))
        base = [x for x in found.get(d, []) if x[1] < 3]
        text = data[s:e]
        if any(p.fullmatch(text) for p in ALLOWED):
            continue
        for a, z in ((p + a, p + z) for p, q in unknown_parts(text) for a, z in hot_windows(text[p:q])):
            a, z = int(s - off[d]) + a, int(s - off[d]) + z
            if not any(x[0] <= a and z <= x[2] for x in base) and not any(p.fullmatch(data[off[d] + a : off[d] + z]) for p in ALLOWED):
                found.setdefault(d, []).append((a, 3, z))
    return {d: x for d, x in found.items() if x}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = tb.column_bytes(batch.column("text"))
        n = len(off) - 1
        counts = np.zeros((4, n), np.int64)
        digest, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + 4 * tb.BLOCK, "right")) - 1)
            for d, hits in scan_block(raw[off[i] : off[j]], off[i : j + 1] - off[i]).items():
                own = raw[off[i + d] : off[i + d + 1]]
                point = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # code points before each byte
                named = [(f"{KINDS[k]}:{point[s]}:{point[e]}", k) for s, k, e in sorted(hits)]
                for _, k in named:
                    counts[k, i + d] += 1
                digest[i + d] = hashlib.sha256(",".join(x for x, k in named if k < 3).encode()).hexdigest()
                spans[i + d] = ",".join(x for x, _ in named)
            i = j
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[k]) for k in range(3)), pa.array(digest), pa.array(spans), pa.array(counts[3])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Spans are kind:start:end in code points, by start, then kind. An entropy span inside a pattern's span isn't
    repeated. Null texts are empty. Every row, repeated or not, gives one row; extra columns are ignored; a very long text
    is one block of its own. An empty table gives an empty result.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, schema)
