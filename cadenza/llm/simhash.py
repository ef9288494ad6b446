"""SimHash near-dedup by the generalised pigeonhole principle.

The 64 fingerprint bits are cut into m parts that keep correlated bits
together.  If two fingerprints differ in at most d bits and the parts'
thresholds t_i add up to d - m + 1, some part differs in at most t_i bits
(t_i = -1 leaves a part out).  A dynamic programme over the parts spends that
sum where the estimated number of candidates and probes is least; m itself is
the cheapest of a few.  Each fingerprint is indexed once per used part and
probes all values of the part within t_i bits; candidates are verified by
their whole bit distance.  All of this runs on distinct fingerprints, so exact
copies never meet each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, components, lookup_join, release_memos, text_hash, without_rows, written
from cadenza.llm.simhash_core import fingerprint

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fingerprints of one part value beyond which the value is hot: its pairs are
#: searched in blocks that return a spanning forest, not pairs.
HOT_BUCKET = 512
#: Fingerprints a side of such a block.
BLOCK = 4096
#: Cost of a probe row against a candidate pair (a shuffled row against a compare).
PROBE_COST, PAIR_COST = 4.0, 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS, with_hash: bool = False) -> DataFrame:
    """(doc_id, fp bigint): one row per row of ``docs``; with th, the
    ``text_hash`` of the row, if asked for."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("_text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("_id"), "fp": pa.array(fp.view(np.int64)),
                                              **({"th": b.column("_th")} if with_hash else {})})

    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                      *([text_hash(F.col(text_col)).alias("_th")] if with_hash else []))
    return src.mapInArrow(run, "doc_id long, fp long" + (", th long" if with_hash else ""))


# ------------------------------------------------------------------ planning

def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 table of how often two bits are
    both set, over all of them (4,096 sums reach the driver)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            u = b["fp"].to_numpy(dtype=np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(u, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(b)
        i, j = np.indices((64, 64))
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "c": np.append(both, n)})

    rows = fps.select("fp").mapInPandas(run, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c")).collect()
    both, n = np.zeros((64, 64)), 0
    for i, j, c in rows:
        if i < 0:
            n = int(c)
        else:
            both[i, j] = c
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal width; each next bit joins the part (with room)
    whose bits it is most correlated with."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    order = np.argsort(-corr.max(axis=1), kind="stable")
    parts: list[list[int]] = [[] for _ in range(m)]
    for b in map(int, order):
        room = [i for i in range(m) if len(parts[i]) < widths[i]]
        best = max(room, key=lambda i: (corr[b, parts[i]].mean() if parts[i] else 0.02, -i))
        parts[best].append(b)
    return [sorted(x) for x in parts]


def part_distance(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0..most bits of a part,
    from the bits' own frequencies."""
    p = np.diag(both)[bits] / max(n, 1)
    dist = np.zeros(most + 2)
    dist[0] = 1.0
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist[:most + 1])


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and the least summed cost;
    ``cost[i][t + 1]`` is the cost of part i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(part) - 1):
                if s + t not in nxt or c + part[t + 1] < nxt[s + t][0]:
                    nxt[s + t] = (c + part[t + 1], [*ts, t])
        best = nxt
    return best[total]


def plan(n: int, both: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, the cheapest of 2 to max_bits + 1 parts."""
    choices = []
    for m in range(2, max_bits + 2):
        parts, total, cost = group_bits(n, both, m), max_bits - m + 1, []
        for bits in parts:
            top = min(max(total + m - 1, 0), 2)          # beyond two flipped bits probes outgrow any gain
            near = part_distance(n, both, bits, top)
            probes = np.cumsum([float(len(list(itertools.combinations(bits, e)))) for e in range(top + 1)])
            cost.append([0.0, *(PROBE_COST * n * probes + PAIR_COST * 0.5 * n * n * near)])
        if total <= sum(len(c) - 2 for c in cost):
            c, ts = allocate(cost, total)
            choices.append((c, [(b, t) for b, t in zip(parts, ts) if t >= 0]))
    if not choices or max_bits == 0:
        return [(list(range(64)), 0)] if max_bits == 0 else [(list(range(64)), max_bits)]
    return min(choices, key=lambda x: x[0])[1]


# ------------------------------------------------------------ probe and verify

def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def close_pairs(fps: DataFrame, max_bits: int = MAX_BITS, hot_bucket: int = HOT_BUCKET, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``, a written
    table) at ``max_bits`` or fewer differing bits: every link within cold
    part values, a spanning forest of the links within hot ones."""
    n, both = bit_moments(fps)
    parts = plan(n, both, max_bits)
    probe_lits = F.array(*[
        F.struct(F.lit(i).cast("byte").alias("part"), F.lit(_mask(bits)).cast("long").alias("mask"),
                 F.lit(_mask(flip)).cast("long").alias("flip"))
        for i, (bits, t) in enumerate(parts) for e in range(t + 1) for flip in itertools.combinations(bits, e)])
    index_lits = F.array(*[
        F.struct(F.lit(i).cast("byte").alias("part"), F.lit(_mask(bits)).cast("long").alias("mask"))
        for i, (bits, _) in enumerate(parts)])
    probes = fps.select(F.col("fp").alias("a"), F.explode(probe_lits).alias("x")).select(
        "a", F.col("x.part").alias("part"),
        F.col("a").bitwiseAND(F.col("x.mask")).bitwiseXOR(F.col("x.flip")).alias("key"))
    index = fps.select(F.col("fp").alias("b"), F.explode(index_lits).alias("x")).select(
        "b", F.col("x.part").alias("part"), F.col("b").bitwiseAND(F.col("x.mask")).alias("key"))
    hot = written(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
                  .filter(F.col("n") > hot_bucket), "hot-buckets")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (F.col("a") < F.col("b"))
    if hot.isEmpty():
        p, i = probes.alias("p"), index.alias("i")
        return p.join(i, (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & near).select(
            "a", "b").distinct()
    on = ["part", "key"]
    p, i = probes.join(hot, on, "left_anti").alias("p"), index.join(hot, on, "left_anti").alias("i")
    cold = p.join(i, (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & near).select("a", "b")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sized = hot.select(*on, blocks.alias("blocks"))
    pp = probes.join(sized, on).withColumn("pb", own("a")).withColumn("ib", every)
    ii = index.join(sized, on).withColumn("ib", own("b")).withColumn("pb", every)

    def forest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(spanning_links(left["a"].to_numpy(), right["b"].to_numpy(), max_bits), columns=["a", "b"])

    # renamed: both sides come from ``hot``, and a cogroup needs columns of their own
    left = pp.select("a", "part", "key", "pb", "ib").toDF("a", "p_part", "p_key", "p_pb", "p_ib")
    right = ii.select("b", "part", "key", "pb", "ib").toDF("b", "i_part", "i_key", "i_pb", "i_ib")
    dense = left.groupby(*left.columns[1:]).cogroup(right.groupby(*right.columns[1:])).applyInPandas(forest, "a long, b long")
    return cold.union(dense).distinct()


def spanning_links(a: np.ndarray, b: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints of ``a`` and
    of ``b`` (at most len(a) + len(b) - 1 of them)."""
    ua, ub = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out: list[tuple[int, int]] = []
    for start in range(len(a)):
        if not free_a[start]:
            continue
        free_a[start] = False
        stack = [(True, start)]
        while stack:
            left, k = stack.pop()
            other, free = (ub, free_b) if left else (ua, free_a)
            cand = np.flatnonzero(free)
            hit = cand[np.bitwise_count(other[cand] ^ (ua if left else ub)[k]) <= max_bits]
            free[hit] = False
            for h in hit.tolist():
                x, y = (int(a[k]), int(b[h])) if left else (int(a[h]), int(b[k]))
                if x != y:
                    out.append((min(x, y), max(x, y)))
                stack.append((not left, h))
    return out


# ------------------------------------------------------------------ operator

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, hot_bucket: int = HOT_BUCKET,
                    with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, fingerprint (16 hex digits),
    component_id (smallest id reachable over links of ``max_bits`` or fewer
    differing bits, its own included) and group_size (rows of the component).

    A null or empty text has fingerprint zero and links like any other; null
    ids take part but never name a component (a component of null ids only has
    a null component_id); an empty table gives an empty result.  ``with_hash``
    adds th, the ``text_hash`` of the row."""
    rows = written(fingerprints(docs, id_col, text_col, shingle, with_hash), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    linked = components(close_pairs(classes.select("fp"), max_bits, hot_bucket))
    named = classes.join(linked.withColumnRenamed("v", "fp"), "fp", "left").select(
        "fp", "n", "least", F.coalesce("label", "fp").alias("label"))
    named = written(named, "labels")
    per = written(named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"),
                                             F.count(F.lit(1)).alias("members")), "components")
    of = written(lookup_join(named, per, ["label"], "members").select("fp", "n", "component_id", "group_size"), "classes")
    return lookup_join(rows, of, ["fp"], "n").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size",
        *(["th"] if with_hash else []))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document (the smallest id) of every component, told
    by id and text, so that another text under a dropped id stays; rows with a
    null id stay, for nothing tells which of them is meant."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits, with_hash=True)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", "th")
    return without_rows(docs, gone, id_col, text_col)
