"""Fingerprints of texts (per-document helper of the near-dedup operator)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLOCK = 1 << 16          # shingles hashed at a time: bounds the memory of one very long text
_SEED = 42


def words_of(text: str) -> list[str]:
    """Words of a text: runs of anything but ASCII white space, A-Z lowered."""
    return _WORD.findall(text.translate(_LOWER))


def _shingles(words: list[str], k: int) -> Iterator[list[bytes]]:
    if len(words) <= k:
        yield [" ".join(words).encode()]
        return
    for a in range(0, len(words) - k + 1, _BLOCK):
        part = words[a:a + _BLOCK + k - 1]
        yield [" ".join(s).encode() for s in zip(*(part[i:] for i in range(k)))]


def fingerprint(text: str | None, k: int = 4) -> int:
    """64-bit SimHash: a bit is set when more than half of the shingles'
    XXH64 values (seed 42) have it; no words: zero."""
    words = words_of(text or "")
    if not words:
        return 0
    n, ones = 0, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for block in _shingles(words, k):
        h = np.fromiter((digest(s, _SEED) for s in block), dtype=np.uint64, count=len(block))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])
