"""Fill-in-the-middle transformation cut at line ends.

Texts are cut into content-defined chunks by a rolling hash, so that passages
shared by many documents fall into equal chunks wherever they stand.  A chunk
has a boundary summary: where its lines end and how many code points it holds.
Workers remember summaries by the chunk's bytes (a dictionary compares the
whole content, so equal hashes can't mix up chunks); a document's lines are
counted by adding up the counts of its chunks, and a cut is found by the chunk
that holds its line end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, remembers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes the rolling hash looks at.
HASH_BYTES = 32
#: A chunk ends where the hash has this many low zero bits (4 KB on average).
CHUNK_BITS = 12
LEAST_CHUNK, MOST_CHUNK = 1 << 10, 1 << 16
#: Bytes of a text that are hashed at a time.
BLOCK_BYTES = 1 << 20
#: Bytes of chunks a worker remembers.
MEMO_BYTES = 16 << 20


def _gear() -> np.ndarray:
    """A pseudo-random number per byte value (splitmix64)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Sum of gear[byte] << distance over the last HASH_BYTES bytes at every
    place (fewer at the start), by doubling the window."""
    h = GEAR[data]
    width = 1
    while width < HASH_BYTES:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def candidate_ends(text: bytes) -> np.ndarray:
    """Places after which the hash of the bytes before ends a chunk."""
    found = []
    for at in range(0, len(text), BLOCK_BYTES):
        start = max(0, at - HASH_BYTES + 1)
        h = rolling_hash(np.frombuffer(text, np.uint8, min(BLOCK_BYTES, len(text) - at) + at - start, start))[at - start:]
        # the high bits depend on the whole window
        found.append(np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + at + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the content-defined chunks, LEAST_CHUNK to MOST_CHUNK
    bytes each (the last may be shorter)."""
    if len(text) <= LEAST_CHUNK:
        if text:
            yield 0, len(text)
        return
    ends = candidate_ends(text)
    start = i = 0
    while start < len(text):
        i = int(np.searchsorted(ends, start + LEAST_CHUNK))
        end = min(int(ends[i]) if i < len(ends) else len(text), start + MOST_CHUNK, len(text))
        yield start, end
        start = end


class Summary(NamedTuple):
    """What cuts need of a chunk: the places after its line feeds, and its
    code points."""

    line_ends: np.ndarray
    points: int


def code_points(data: bytes) -> int:
    """Characters that begin in ``data``: bytes that don't continue one."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def summarise(chunk: bytes) -> Summary:
    ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10).astype(np.int32) + 1
    return Summary(ends, code_points(chunk))


class Summaries:
    """Summaries by content, within MEMO_BYTES; when full, it starts anew."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.held, self.by_chunk, self.hits = most, 0, {}, 0

    def of(self, chunk: bytes) -> Summary:
        found = self.by_chunk.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        if self.held > self.most:
            self.by_chunk.clear()
            self.held = 0
        found = self.by_chunk[chunk] = summarise(chunk)
        self.held += len(chunk) + 4 * len(found.line_ends) + 200
        return found


class Outline:
    """The lines of one text, from its chunks' summaries."""

    def __init__(self, text: bytes, memo: Summaries):
        spans = list(chunks(text))
        self.text, self.starts = text, [s for s, _ in spans]
        self.parts = [memo.of(text[s:e]) for s, e in spans]
        self.lines = np.cumsum([len(p.line_ends) for p in self.parts], dtype=np.int64)
        self.points = np.cumsum([p.points for p in self.parts], dtype=np.int64)
        fed = int(self.lines[-1]) if spans else 0
        #: lines: each ends after a line feed, the last may lack one
        self.n = fed + bool(text and not text.endswith(b"\n"))

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` lines."""
        if units == 0:
            return 0, 0
        if not len(self.lines) or units > self.lines[-1]:
            return len(self.text), int(self.points[-1]) if len(self.points) else 0
        i = int(np.searchsorted(self.lines, units))
        before = int(self.lines[i - 1]) if i else 0
        start, inside = self.starts[i], int(self.parts[i].line_ends[units - before - 1])
        return start + inside, (int(self.points[i - 1]) if i else 0) + code_points(self.text[start:start + inside])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document: its SHA-256 under the seed."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(text: bytes, doc_id: int | None, seed: int, rate: int, spm_rate: int,
              memo: Summaries) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, prefix and middle code points, output) of one text."""
    outline = Outline(text, memo)
    a, b, apply, order = draws(seed, doc_id)
    n = outline.n
    if not text or apply % 100 >= rate or any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((a % (n + 1), b % (n + 1)))
    (i, i_points), (j, j_points) = outline.cut(first), outline.cut(last)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    spm = order % 100 < spm_rate
    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return n, "spm" if spm else "psm", i_points, j_points - i_points, out


@lru_cache(maxsize=1)
def _worker_memo() -> Summaries:
    return Summaries()


remembers(_worker_memo.cache_clear)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form, prefix_chars,
    middle_chars, output.

    ``rate`` per cent of the documents are cut, ``spm_rate`` per cent of these
    put the suffix first.  A null text counts as empty; empty texts, and those
    that hold one of the three marks, stay plain (null lengths).  A null id
    draws like an empty number; rows with the same id draw alike.  An empty
    table gives an empty result; other columns are not read."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _worker_memo()
        for b in batches:
            ids = b.column("doc_id")
            texts = b.column("text").cast(pa.binary()) if pa.types.is_string(b.column("text").type) else b.column("text")
            rows = [transform(t.as_py(), i, seed, rate, spm_rate, memo) for i, t in zip(ids.to_pylist(), texts)]
            n, form, prefix, middle, out = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()),
                "output": pa.array(out, pa.binary()).cast(pa.string())})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text before the transformation."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2]))
            .otherwise(F.concat(part[2], part[3], part[1])))
