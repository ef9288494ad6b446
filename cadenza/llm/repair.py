"""Re-Pair grammar compression of a block of token ids (numpy helper).

A round counts all neighbouring pairs of the sequence and replaces the
frequent ones by new symbols (nonterminals); where two frequent pairs overlap
the more frequent one wins and the other waits for the next round.  Rounds go
on until no pair is frequent, the last ones by exact counts.  A grammar is the
rules (two symbols each, in the order they were made), the expansion length
of every rule, and the remaining sequence; a range of ids is decoded from the
symbols that cover it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MIN_COUNT = 16
RULES_PER_ROUND = 8192
#: After a round that shortens the sequence by less than this share all pairs
#: are counted exactly.
LEAST_GAIN = 0.01
_BITS = 20


@dataclass
class Grammar:
    base: int                    # symbols from here on are rules
    rules: np.ndarray            # (n, 2) uint32
    lengths: np.ndarray          # (n,) uint32, ids each rule expands to
    sequence: np.ndarray         # uint32

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def flat(self, symbols: np.ndarray) -> np.ndarray:
        """Expansion by one gather from a table of all rules' expansions."""
        if not len(self.rules):
            return symbols.astype(np.uint32)
        rules = np.arange(self.base, self.base + len(self.rules), dtype=np.uint32)
        known = np.concatenate([np.arange(self.base, dtype=np.uint32), self.expand(rules)])
        size = np.concatenate([np.ones(self.base, dtype=np.int64), self.lengths.astype(np.int64)])
        first = np.cumsum(size) - size
        n = size[symbols]
        ends = np.cumsum(n)
        return known[np.repeat(first[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        while len(symbols):
            rule = symbols >= self.base
            if not rule.any():
                break
            at = np.cumsum(rule + 1) - (rule + 1)
            out = np.empty(len(symbols) + int(rule.sum()), dtype=np.uint32)
            out[at[~rule]] = symbols[~rule]
            pair = self.rules[symbols[rule] - self.base]
            out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols.astype(np.uint32)

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop): only the symbols that cover them are expanded."""
        if start == 0 and stop is None:
            return self.flat(self.sequence)
        ends = np.cumsum(self.symbol_lengths(self.sequence))
        stop = int(ends[-1]) if stop is None and len(ends) else (stop or 0)
        if stop <= start:
            return np.empty(0, dtype=np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.sequence[a:b])[start - before:stop - before]


def _hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _BITS)).astype(np.int64)


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT, per_round: int = RULES_PER_ROUND) -> Grammar:
    """First every hash slot of pairs proposes one of its pairs, whose places
    are counted exactly; another pair of the slot has its chance in a later
    round.  When that gains little, all pairs of the slots that hold
    ``min_count`` places are counted, until none has as many."""
    seq = np.ascontiguousarray(ids, dtype=np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.empty(0, dtype=np.uint32)
    pair_of = np.empty(1 << _BITS, dtype=np.uint64)
    n_rules, exact = 0, False
    while len(seq) > 1:
        left, right = seq[:-1], seq[1:]
        h = _hash(left, right)
        codes = left.astype(np.uint64) << np.uint64(32) | right
        if exact:
            may = np.flatnonzero(np.bincount(h, minlength=1 << _BITS)[h] >= min_count)
            pairs, slots = np.unique(codes[may], return_inverse=True)
        else:
            pair_of[h] = codes
            may = np.flatnonzero(pair_of[h] == codes)
            pairs, slots = pair_of, h[may]
        counts = np.bincount(slots, minlength=len(pairs))
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            if exact:
                break
            exact = True
            continue
        often = often[np.argsort(-counts[often], kind="stable")][:per_round]
        rank_of = np.full(len(pairs), len(often), dtype=np.int32)
        rank_of[often] = np.arange(len(often), dtype=np.int32)
        full = np.full(len(seq) + 1, len(often), dtype=np.int32)
        full[may + 1] = rank_of[slots]
        mid = full[1:-1]
        # of overlapping pairs the more frequent one, of a run of equal ones every second
        take = np.flatnonzero((mid < len(often)) & (mid <= full[:-2]) & (mid <= full[2:]))
        k = np.arange(len(take))
        first = np.maximum.accumulate(np.where(np.diff(take, prepend=-2) == 1, 0, k)) if len(take) else k
        take = take[(k - first) % 2 == 0]
        exact = exact or len(take) < LEAST_GAIN * len(seq)
        ranks = mid[take]
        used = np.flatnonzero(np.bincount(ranks, minlength=len(often)))
        symbol = np.empty(len(often), dtype=np.uint32)
        symbol[used] = np.arange(len(used), dtype=np.uint32) + np.uint32(base + n_rules)
        made = pairs[often[used]]
        two = np.stack([(made >> np.uint64(32)).astype(np.uint32), made.astype(np.uint32)], axis=1)
        of = np.where(two >= base, two - np.uint32(base), np.uint32(len(lengths)))
        rules.append(two)
        lengths = np.concatenate([lengths, np.append(lengths, np.uint32(1))[of].sum(axis=1).astype(np.uint32)])
        seq = seq.copy()
        seq[take] = symbol[ranks]
        keep = np.ones(len(seq), dtype=bool)
        keep[take + 1] = False
        seq = seq[keep]
        n_rules += len(used)
    return Grammar(base, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), lengths, seq)
