"""Byte-pair encoding by dynamic programming over prefixes, and a memo of
encoded chunks (per-task helpers of the encoding operators).

For every byte prefix there is exactly one token that its encoding ends in.
A token t that ends at byte i is that token if it spans the whole prefix, or
if the last token p of the prefix before it and t stay two tokens when their
bytes are encoded together.  Storing the last token of each prefix makes
appends exact and cheap, and after an edit only the prefixes near it are
computed again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries of the pair memo, after which it starts anew, and of one
#: generation of a chunk memo (about 200 bytes each, two generations; a worker
#: keeps them between tasks, also while other stages run).
PAIR_LIMIT, CHUNK_LIMIT = 200_000, 200_000
#: Chunks longer than this many characters are encoded without being kept.
LONG_CHUNK = 200


class Vocabulary:
    """Tokens by id (= merge rank) and ids by token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}

    @classmethod
    @lru_cache(maxsize=4)
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, data: bytes) -> list[bytes]:
        """The plain merge loop, for the few bytes of a pair of tokens."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i:i + 1] for i in range(len(data))]
        found = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while found and (low := min(found)) < none:
            k = found.index(low)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k < len(found):
                found[k] = rank(parts[k] + parts[k + 1], none)
            if k:
                found[k - 1] = rank(parts[k - 1] + parts[k], none)
        return parts

    def stays_apart(self, p: int, t: int) -> bool:
        key = p << 32 | t
        known = self.pairs.get(key)
        if known is None:
            a, b = self.tokens[p], self.tokens[t]
            known = self.merge(a + b) == [a, b]
            if len(self.pairs) >= PAIR_LIMIT:
                self.pairs.clear()
            self.pairs[key] = known
        return known


class PrefixEncoder:
    """Encoding of one growing or edited byte string (one match of the split
    pattern): ``last[i]`` is the last token of the first i + 1 bytes."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", []
        self.append(data)

    def _extend(self, data: bytes, end: int, stop: int) -> None:
        """Last tokens of the prefixes from ``end`` to ``stop`` bytes, longest
        candidates first; known pairs are looked up in place."""
        last, longest, apart = self.last, self.vocab.longest, self.vocab.stays_apart
        rank, known = self.vocab.ranks.get, self.vocab.pairs.get
        while end <= stop:
            start = end - longest if end > longest else 0
            while start < end:
                t = rank(data[start:end])
                if t is not None:
                    if start == 0:
                        break
                    p = last[start - 1]
                    two = known(p << 32 | t)
                    if two or two is None and apart(p, t):
                        break
                start += 1
            else:
                raise ValueError(f"byte {data[end - 1]} has no token")
            last.append(t)
            end += 1

    def append(self, more: bytes) -> None:
        first = len(self.data)
        self.data += more
        self._extend(self.data, first + 1, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:end]; returns how many prefixes
        were computed.  Prefixes before the edit stay; after it, once as many
        last tokens in a row as the longest token has bytes equal the old
        ones, all later ones do too."""
        old, tail = self.last[end:], self.data[end:]
        self.data = self.data[:start] + new + tail
        del self.last[start:]
        done, equal = 0, 0
        for at in range(start + 1, len(self.data) + 1):
            self._extend(self.data, at, at)
            done += 1
            k = at - 1 - start - len(new)
            if k >= 0:
                equal = equal + 1 if self.last[-1] == old[k] else 0
                if equal >= self.vocab.longest:
                    self.last.extend(old[k + 1:])
                    break
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocab.tokens[self.last[at - 1]])
        return out[::-1]


class Memo:
    """Two generations of remembered results: when the young one is full it
    becomes the old one, and what is asked for again moves back."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, keys: list[str], compute: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Results of ``keys`` (best distinct), computed where not remembered;
        those of long keys are not kept."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out: list = list(map(young.get, keys))
        holes = [i for i, x in enumerate(out) if x is None]
        missing = []
        for i in holes:
            known = out[i] = old.get(keys[i])
            if known is None:
                missing.append(i)
            else:
                young[keys[i]] = known
        for a in range(0, len(missing), 50_000):
            part = missing[a:a + 50_000]
            for i, x in zip(part, compute([keys[i] for i in part])):
                out[i] = x
                if len(keys[i]) <= LONG_CHUNK:
                    young[keys[i]] = x
        return out


class PieceEncoder:
    """Ids of texts, each match of ``pattern`` encoded separately."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.find = vocab, regex.compile(pattern).findall

    def encode(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.find(text):
            data = piece.encode()
            whole = self.vocab.ranks.get(data)
            if whole is not None:
                ids.append(whole)
            else:
                ids += PrefixEncoder(self.vocab, data).ids()
        return np.array(ids, dtype="<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


#: Marks that may follow a word in its chunk (none is a letter, digit or space).
_MARKS = ".,;:!?%$#&*|"
#: A space before white space (Python's) or the end, in Arrow's pattern language.
_ODD = r" ([\t-\r\x1c-\x1f\x{85}\p{Z}]|$)"
_BOUNDARY = re.compile(r"(?= \S)")
_RUN = re.compile(r" (?:\s|$)")


def chunks_of(text: str) -> list[str]:
    """The text cut before every space that a non-space follows.  No match of
    a byte-level split pattern crosses such a place, so chunks can be encoded
    one by one."""
    if not text:
        return []
    if _RUN.search(text):
        return [c for c in _BOUNDARY.split(text) if c]
    first, *rest = text.split(" ")
    out = [" " + c for c in rest]
    return [first, *out] if first else out


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all entries one after another, where each starts, how many it has."""
    size = np.array([len(e) // 4 for e in entries], dtype=np.int64)
    return np.frombuffer(b"".join(entries), dtype="<u4"), np.cumsum(size) - size, size


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries numbered by ``at`` one after another, and where each ends."""
    n = size[at]
    ends = np.cumsum(n)
    return data[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


class ChunkCoder:
    """Ids (little-endian unsigned 32-bit) of many texts.  Texts are cut into
    chunks, and chunks into a word and the marks after it: letters and marks
    are different runs of a byte-level pattern, so no match holds both.
    Distinct words are encoded once while they are remembered."""

    def __init__(self, encode_parts: Callable[[list[str]], list[bytes]], limit: int = CHUNK_LIMIT):
        self.encode_parts = encode_parts
        self.memo = Memo(limit)

    def _ids(self, parts: list[str]) -> list[bytes]:
        return self.memo.look_up(parts, self.encode_parts)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of the chunks " " + word for distinct words."""
        core = pc.utf8_rtrim(words, characters=_MARKS)
        letter = pc.utf8_is_alpha(pc.utf8_slice_codeunits(core, -1))
        core = pc.if_else(letter, core, words)
        marked = pc.fill_null(pc.not_equal(core, words), False)
        ends = [w[len(c):] for w, c in zip(_strings(words.filter(marked)), _strings(core.filter(marked)))]
        number = {m: i for i, m in enumerate(dict.fromkeys(ends))}
        core = pc.dictionary_encode(core)
        spaced = pc.binary_join_element_wise("", core.dictionary, " ")
        entries = [*self._ids(_strings(spaced)), b"", *self._ids(list(number))]
        mark = np.full(len(words), len(core.dictionary), dtype=np.int64)
        mark[np.flatnonzero(marked.to_numpy(zero_copy_only=False))] += np.array([1 + number[m] for m in ends], dtype=np.int64)
        data, start, size = _table(entries)
        at = np.stack([core.indices.to_numpy().astype(np.int64), mark], axis=1)
        data, ends = _gather(data, start, size, at.ravel())
        ends = ends[1::2]
        return data, np.concatenate([[0], ends[:-1]]) if len(ends) else ends, np.diff(ends, prepend=0)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Arrow cuts the texts and numbers the chunks, Python sees each
        distinct word of the call once, and gathers put the ids together.
        Texts in which a space comes before white space or the end are cut by
        ``chunks_of`` instead."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, _ODD)
        parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        heads = offsets[:-1]                              # the first part of a text has no space before it
        first = _strings(pc.list_element(parts, 0))
        begin = self._ids([w for w in first if w])
        flat = parts.flatten()
        rest = np.ones(len(flat), dtype=bool)
        rest[heads] = False
        numbered = pc.dictionary_encode(flat.filter(pa.array(rest)))
        data, start, size = self._words(numbered.dictionary)
        head_data, head_start, head_size = _table([*begin, b""])
        has = np.array([bool(w) for w in first], dtype=bool)
        at = np.empty(len(flat), dtype=np.int64)
        at[rest] = numbered.indices.to_numpy()
        at[heads] = len(size) + np.where(has, np.cumsum(has) - 1, len(begin))
        ids, ends = _gather(np.concatenate([data, head_data]), np.concatenate([start, head_start + len(data)]),
                            np.concatenate([size, head_size]), at)
        raw = ids.tobytes()
        stop = (4 * np.concatenate([[0], ends])[offsets]).tolist()
        out = [raw[a:b] for a, b in zip(stop, stop[1:])]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[k] = b"".join(self._ids(chunks_of(texts[int(k)].as_py())))
        return out
