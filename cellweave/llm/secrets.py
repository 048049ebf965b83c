"""Secret scanning with multipart credential linking.

Base spans are assignments, access identifiers and long hexadecimal runs. Besides, three
kinds of weak parts are looked for: identifiers (user or client names that are assigned),
secrets (short assigned values and unmarked mixed tokens) and endpoints (addresses and
assigned hosts). Within a scope (text between blank lines) parts are joined as intervals,
each widened by `reach`: a weak secret is reported if an identifier, access key or endpoint
lies near it; a weak identifier or endpoint if a secret does, weak or base. An unmarked
token within an address is a part of it, so an endpoint is no complement of it.

Offsets count code points, ends are exclusive. Defined cases: null text counts as empty;
an empty text has no spans; each row is scanned by itself, also where a doc_id repeats;
overlapping spans of different kinds are all kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, unused

KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMED = re.compile(r"""\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
ADDRESS = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::\d+)?""", re.I | re.A)
SCOPE = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base kinds, in order of start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def is_mixed(token: str) -> bool:
    """Upper and lower case letters and digits all occur."""
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


class Near:
    """Intervals of one kind of part in a scope; answers whether one lies within reach."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = sorted(s for s, _ in spans)
        self.ends = sorted(e for _, e in spans)

    def any(self, start: int, end: int, reach: int) -> bool:
        """Starts up to end + reach less ends before start - reach: those that overlap."""
        return bisect_right(self.starts, end + reach) > bisect_left(self.ends, start - reach)


def linked_spans(text: str, base: list[Span], reach: int = 200) -> list[Span]:
    """The weak parts whose complement lies within reach in the same scope."""
    if "=" not in text and ":" not in text and "AKIA" not in text:
        return []
    covered = [(s, e) for s, _, e in base]
    taken = Near(covered)
    apart = lambda s, e: not taken.any(s + 1, e - 1, 0)
    marked = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if 4 <= m.end() - m.start(2) < 8]
    names = [(m.start(), m.end()) for m in NAMED.finditer(text)]
    places = [(m.start(), m.end()) for m in ADDRESS.finditer(text)]
    access = [(s, e) for s, kind, e in base if kind == "access"]
    mixed = [(m.start(), m.end()) for m in MIXED.finditer(text) if is_mixed(m.group())] if names or access or places else []
    marked = [(s, e) for s, e in marked if apart(s, e)]
    mixed = [(s, e) for s, e in mixed if apart(s, e)]
    names = [(s, e) for s, e in names if apart(s, e)]
    strong = [(s, e) for s, kind, e in base if kind != "access"]
    out = []
    borders = [m.start() for m in SCOPE.finditer(text)]
    scope = lambda s: bisect_right(borders, s)

    def by_scope(spans: list[tuple[int, int]]) -> dict[int, Near]:
        groups: dict[int, list] = {}
        for s, e in spans:
            groups.setdefault(scope(s), []).append((s, e))
        return {k: Near(v) for k, v in groups.items()}

    def co_occurs(span: tuple[int, int], others: dict[int, Near]) -> bool:
        near = others.get(scope(span[0]))
        return near is not None and near.any(*span, reach)

    who, where, address = by_scope(names + access), by_scope(places), Near(places)
    found = [s for s in marked if co_occurs(s, who) or co_occurs(s, where)]
    found += [s for s in mixed if co_occurs(s, who) or not address.any(s[0] + 1, s[1] - 1, 0) and co_occurs(s, where)]
    secret = by_scope(found + strong)
    out += [(s, "secret", e) for s, e in found]
    out += [(s, "identifier", e) for s, e in names if co_occurs((s, e), secret)]
    out += [(s, "endpoint", e) for s, e in places if apart(s, e) and co_occurs((s, e), secret)]
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                linked = linked_spans(text or "", base, reach)
                kinds = [k for _, k, _ in base]
                row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(in_order(base + linked)), len(linked))
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact_text(text: str | None, reach: int = 200, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones merged, replaced by a mark."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted((s, e) for s, _, e in base + linked_spans(text, base, reach))
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end = spans[k]
        while k < len(spans) and spans[k][0] < end or k < len(spans) and spans[k][0] == start:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, reach: int = 200) -> DataFrame:
    """docs with secrets replaced in text, and n_chars counted anew for the rows that changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            k = b.schema.get_field_index("text")
            texts = pa.array([redact_text(t, reach) for t in b.column(k).to_pylist()], pa.string())
            yield pa.record_batch([texts if i == k else c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for i, c in enumerate(b.columns)], names=b.schema.names)

    (before,) = unused(docs, "before")
    out = docs.withColumn(before, F.xxhash64("text")).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {before} long")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.xxhash64("text") != F.col(before), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(before)
