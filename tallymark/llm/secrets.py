"""Scans for secrets: fixed patterns, and windows of high entropy.

A candidate is a maximal run of the characters keys are written in. What is known not to be
secret (ids of known forms, names with "example", alphabets in order) is cut out of it. In what is
left, each character class has its own maximal runs, so a key joined to a name by one of "=_/-" is
measured alone. A window of fixed width slides over a run; leaving and entering characters change
the counts, and with them the sum of ``c log2 c`` that gives the window's Shannon entropy.
Windows at or above the class's threshold are united into spans. Runs without a digit or
without a letter, and spans that touch a sample from a manual, are passed over; what the patterns found stays.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm.tables import map_rows, map_whole, slices

#: The patterns of the base, in the order their kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Strings that are known not to be secrets, cut out of a candidate: ids of known forms, and names with "example".
KNOWN = re.compile(
    r"""(?<![A-Za-z0-9])(?:
    [0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}
    |(?=[a-z]*example|[A-Z][a-z]*example|Example|EXAMPLE)(?:[A-Za-z]?[a-z]*|EXAMPLES?)[0-9]*
    )(?![A-Za-z0-9])""",
    re.X,
)
#: Samples from manuals: "example" inside a string that is no name.
SAMPLE = re.compile(r"example", re.I | re.A)
ORDERED = "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Characters in order that are an alphabet, not a key.
ORDERED_LENGTH = 20
FOLLOWS = frozenset(row[i : i + 2] for row in ORDERED for i in range(len(row) - 1))


@dataclass(frozen=True)
class CharacterClass:
    """Windows of ``width`` characters of this class with at least ``bits`` of entropy count; ``run`` matches its maximal runs."""

    name: str
    run: re.Pattern[str]
    width: int
    bits: float


#: 99 of 100 windows of random keys of the class's alphabet reach its bits. "=" ends a base64 run: it pads or assigns.
CLASSES = (
    CharacterClass("hex", re.compile("[0-9a-f]{20,}"), 20, 2.86),
    CharacterClass("upper hex", re.compile("[0-9A-F]{20,}"), 20, 2.86),
    CharacterClass("lower", re.compile("[0-9a-z]{20,}"), 20, 3.38),
    CharacterClass("upper", re.compile("[0-9A-Z]{20,}"), 20, 3.38),
    CharacterClass("letters and digits", re.compile("[0-9A-Za-z]{20,}"), 20, 3.64),
    CharacterClass("base64", re.compile("[0-9A-Za-z+/_-]{20,}"), 20, 3.64),
)
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def entropy_windows(text: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Unions of the windows of ``text`` that reach ``bits``, as start and end."""
    n = len(text)
    if n < width:
        return
    counts: dict[str, int] = {}
    weight = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    held = 0.0
    most = math.log2(width) - bits + 1e-12
    opened = closed = -1
    for i, letter in enumerate(text):
        if i >= width:
            old = text[i - width]
            c = counts[old]
            held += weight[c - 1] - weight[c]
            counts[old] = c - 1
        c = counts.get(letter, 0)
        held += weight[c + 1] - weight[c]
        counts[letter] = c + 1
        if i >= width - 1 and held <= most * width:
            start = i - width + 1
            if opened >= 0 and start <= closed:
                closed = i + 1
            else:
                if opened >= 0:
                    yield opened, closed
                opened, closed = start, i + 1
    if opened >= 0:
        yield opened, closed


def ordered_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least ``ORDERED_LENGTH`` characters that follow each other in an alphabet."""
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or text[i - 1 : i + 1] not in FOLLOWS:
            if i - start >= ORDERED_LENGTH:
                yield start, i
            start = i


def _pieces(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """What is left of a candidate without the known strings in it."""
    run = text[start:stop]
    at = 0
    for a, b in sorted([m.span() for m in KNOWN.finditer(run)] + list(ordered_runs(run))):
        yield start + at, start + max(a, at)
        at = max(at, b)
    yield start + at, stop


def entropy_spans(text: str, classes: tuple[CharacterClass, ...] = CLASSES) -> list[tuple[int, int]]:
    """Spans of high entropy in the whole text, those that overlap as one."""
    found = []
    for match in CANDIDATE.finditer(text):
        for start, stop in _pieces(text, *match.span()):
            samples = [m.span() for m in SAMPLE.finditer(text, start, stop)]
            for kind in classes:
                for run in kind.run.finditer(text, start, stop):
                    if not (_DIGIT.search(run[0]) and _LETTER.search(run[0])):
                        continue
                    at = run.start()
                    spans = ((at + a, at + b) for a, b in entropy_windows(run[0], kind.width, kind.bits))
                    found += _untouched(spans, samples) if samples else spans
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a < joined[-1][1]:
            joined[-1] = joined[-1][0], max(b, joined[-1][1])
        else:
            joined.append((a, b))
    return joined


def _untouched(spans: Iterator[tuple[int, int]], samples: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that no sample touches; both are in order and apart."""
    i = 0
    for a, b in spans:
        while i < len(samples) and samples[i][1] <= a:
            i += 1
        if i == len(samples) or samples[i][0] >= b:
            yield a, b


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """All spans as (start, kind, end) in order, kinds numbered as in ``KINDS``."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(a, 3, b) for a, b in entropy_spans(text)]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, base counts, digest of the base spans, and all spans.

    Positions are code points, ends exclusive. A null or empty text has no spans: counts of
    0, the digest of the empty string, an empty ``spans``. Overlapping spans of different
    kinds are all listed; equal starts are ordered by kind. Null ids stay null, repeated
    rows are scanned each, further columns are left out.
    """

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 1):
            counts = [[], [], []]
            digests, listed = [], []
            for text in piece.column(1).to_pylist():
                spans = find_spans(text)
                base = [s for s in spans if s[1] < 3]
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                listed.append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_rows(df, [id_column, text_column], scan, schema)


#: What a secret is replaced by.
MASK = "[secret]"


def mask(text: str | None) -> str | None:
    """The text with every span replaced, overlapping spans as one; a null text stays null."""
    if not text or not (spans := find_spans(text)):
        return text
    parts, at = [], 0
    for start, _, stop in spans:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, stop)
    parts.append(text[at:])
    return "".join(parts)


def mask_documents(df: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The rows of ``df`` with secrets masked in ``text_column`` and ``length_column``, if there, counted anew.

    All rows and columns stay; null texts stay null with their length as it was.
    """
    at = df.columns.index(text_column)
    length_at = df.columns.index(length_column) if length_column in df.columns else None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, at):
            texts = piece.column(at).to_pylist()
            masked = [mask(t) for t in texts]
            columns = list(piece.columns)
            columns[at] = pa.array(masked, piece.schema.field(at).type)
            if length_at is not None:
                held = piece.column(length_at).to_pylist()
                held = [len(new) if new != old else n for new, old, n in zip(masked, texts, held)]
                columns[length_at] = pa.array(held, piece.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return map_whole(df, run)
