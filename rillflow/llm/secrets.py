"""Secret scans: fixed patterns plus sliding-window entropy.

Patterns (``BASE``) are found leftmost and non-overlapping for each kind.  The
method adds spans of kind ``entropy``: in each candidate run of token characters
a window of ``WINDOW`` characters slides along, its Shannon entropy kept by
incremental counts (two counts change at each step); windows at or over the
threshold of the run's character class are joined into a span.  Spans that a
pattern has found already, alphabets and placeholders are cut out of the runs
first; what is left of a run is a run of its own.  Runs that the allow-list
knows (identifiers, paths, words, UUIDs) are suppressed.

Spans are (kind, start, end) in code points, end exclusive.  Null text counts
as empty and has no spans; texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

KINDS = ("assign", "access", "hex", "entropy")
# The patterns of the contract; letters of assign's group 1 in either case, ASCII only.
ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Characters in the window, and runs that are looked at at all.
WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits a character from which a window counts, by class of the run; log2(20) = 4.32 is the most.
THRESHOLD = {"hex": 3.1, "mixed": 3.7, "cased": 3.7, "alpha": 4.2}
#: Mixed case that words joined by capitals don't have: one small letter between capitals.
CASED = re.compile(r"[A-Z][a-z][A-Z]")
#: Runs that are no secrets however varied.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        r"(?!.*[A-Z][a-z][A-Z])[/_=+-]*(?:[A-Za-z]+[/_=+-]+)+[A-Za-z]*",
        r"[0-9/_=+-]+",
        r"[A-Za-z][a-z]*",
    )
)


def _alphabet(letters: str) -> str:
    """The first ten letters and as many of those after them as follow."""
    return letters[:10] + "".join(f"(?:{x}" for x in letters[10:]) + ")?" * len(letters[10:])


#: Stretches of a run that are no secrets; the rest of the run may be one.
FILLER = re.compile("|".join([_alphabet("abcdefghijklmnopqrstuvwxyz"), _alphabet("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "0123456789", "EXAMPLE", "example", "x{6,}", "X{6,}"]))
JOINTS = "/_=+-"
_TERM = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]
_WORDS = ("passw", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found


def run_class(run: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    if re.search(r"\d", run) and re.search(r"[A-Za-z]", run):
        return "mixed"
    return "cased" if CASED.search(run) else "alpha"


def entropy_windows(run: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of the run whose entropy is at or over least; counts are kept up incrementally."""
    counts: dict[str, int] = {}
    total, spans, full = 0.0, [], math.log2(window)
    bound = (full - least) * window + 1e-9
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if i >= window - 1:
            if total <= bound:
                a = i - window + 1
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((a, i + 1))
            out = run[i - window + 1]
            n = counts[out]
            counts[out] = n - 1
            total += _TERM[n - 1] - _TERM[n]
    return spans


def pieces(text: str, start: int, end: int, known: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What fillers and known spans leave of a run, without separators next to a cut."""
    cuts = [(a, e) for a, e in known if a < end and start < e] + [(m.start(), m.end()) for m in FILLER.finditer(text, start, end)]
    at, cut = start, False
    for a, e in [*sorted(cuts), (end, end)]:
        low, high = at, min(a, end)
        while cut and low < high and text[low] in JOINTS:
            low += 1
        while a < end and low < high and text[high - 1] in JOINTS:
            high -= 1
        if high - low >= WINDOW:
            yield low, high
        at, cut = max(at, e), True


def scan(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text, by start, then kind as listed, as (start, kind index, end)."""
    found = base_spans(text)
    if len(text) >= WINDOW and max(map(len, text.split()), default=0) >= WINDOW:  # no span without such a word
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        known = [(a, e) for a, _, e in found]
        for m in CANDIDATE.finditer(text):
            for at, end in pieces(text, m.start(), m.end(), known):
                run = text[at:end]
                if any(p.fullmatch(run) for p in ALLOW):
                    continue
                found += [(at + a, 3, at + e) for a, e in entropy_windows(run, THRESHOLD[run_class(run)])]
    return sorted(found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for text in texts_of(batch):
            spans = scan(text)
            n = [sum(k == i for _, k, _ in spans) for i in range(4)]
            row = (*n[:3], hashlib.sha256(spelled([s for s in spans if s[1] < 3]).encode()).hexdigest(), spelled(spans), n[3])
            for col, v in zip(cols, row, strict=True):
                col.append(v)
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])


def scan_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: counts by pattern, a digest of the pattern spans, all spans."""
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _kernel, SCANNED)


def redact(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with the spelled spans (overlaps joined) replaced by the mark."""
    out, at = [], 0
    for a, e in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",") if x):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_texts(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """docs with every span of its texts replaced by the mark, and a column of lengths brought in line; other columns and null texts as they are."""
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t and redact(t, spelled(scan(t)), mark) for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if length_at is not None:
                kept = cols[length_at].to_pylist()
                cols[length_at] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, old, new, strict=True)], batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return map_batches(docs, kernel, docs.schema)
