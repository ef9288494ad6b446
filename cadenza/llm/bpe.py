"""Byte-level BPE encoding and decoding of a column of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bpe_core import CHUNK_LIMIT, ChunkCoder, PieceEncoder, Vocabulary
from cadenza.llm.common import BATCH_BYTES, bounded_batches, give_back, no_cycle_collector, remembers

#: Bytes of text that are encoded at a time.
SLICE_BYTES = 2 << 20


@lru_cache(maxsize=2)
def coder(path: str, pattern: str, words_kept: int = CHUNK_LIMIT) -> ChunkCoder:
    """One coder per Python worker: its memo serves all tasks of the worker."""
    return ChunkCoder(PieceEncoder(Vocabulary.read(path), pattern).encode_all, words_kept)


remembers(coder.cache_clear)
remembers(Vocabulary.read.cache_clear)

def decode_ids(vocab: Vocabulary, ids: bytes) -> bytes:
    return b"".join(map(vocab.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of texts of about ``most`` bytes (a longer text is alone)."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = True, words_kept: int = CHUNK_LIMIT, slice_bytes: int = SLICE_BYTES,
           batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (binary,
    little-endian unsigned 32-bit; left out without ``keep_ids``), ids_sha256,
    decoded_sha256 (of the bytes that decoding the ids gives).

    Null and empty texts have no ids.  ``path`` names a rank file that every
    executor has; ``pattern`` is its split pattern.  ``words_kept`` (words of a
    generation that a worker remembers), ``slice_bytes`` and ``batch_bytes``
    bound a worker's memory; smaller ones cost time, not results.  Special tokens' strings
    are ordinary text."""
    bounded_batches(docs.sparkSession, batch_bytes)
    schema = f"doc_id long, n_tokens long, {'ids binary, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        vocab, one = Vocabulary.read(path), coder(path, pattern, words_kept)
        for b in batches:
            at = 0
            for texts in _slices(b.column("text"), slice_bytes):
                with no_cycle_collector():
                    ids = one.encode(texts)
                out = {"doc_id": b.column("doc_id").slice(at, len(texts)),
                       "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                       **({"ids": pa.array(ids, pa.binary())} if keep_ids else {}),
                       "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                       "decoded_sha256": pa.array([hashlib.sha256(decode_ids(vocab, x)).hexdigest() for x in ids], pa.string())}
                at += len(texts)
                yield pa.RecordBatch.from_pydict(out)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary): the bytes of encoded ids; null ids: none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.read(path)
        for b in batches:
            data = [decode_ids(vocab, x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "bytes": pa.array(data, pa.binary())})

    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(run, "doc_id long, bytes binary")
