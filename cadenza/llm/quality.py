"""Quality classifier: a factorisation machine over hashed words, statistics
of the text's structure, and its length.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair
term is computed in linear time as half of the sum over factors of
(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.  MLlib fits the factors on a bounded
sample of labelled training rows; scoring reads every whole text once and
uses numpy in the tasks that read it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, release_memos, text_hash, written

#: Hash buckets of words; the structure features follow them.
WORD_BUCKETS = 1 << 13
#: Length of a document's word vector, against values of 1 for its statistics.
WORD_SCALE = 0.3
#: Labelled rows the model is fitted on at most: those with the smallest hash
#: of their id among the training rows.
TRAIN_ROWS = 16_000
FACTORS, ROUNDS, STEP, RIDGE = 4, 80, 0.05, 1e-5
#: A document is predicted good from this score on.
THRESHOLD = 0.3
#: One row in this many (crc32 of the id as text) is held out.
FOLDS = 5
#: Upper edges of the bins each statistic is cut into.
EDGES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
STATISTICS = ("upper", "digits", "symbols", "bare_marks", "marked_words", "caps_words", "repeated_next", "top_word", "distinct",
              "repeated_lines", "short_words", "long_words", "stops", "length", "line_length")
N_FEATURES = WORD_BUCKETS + len(STATISTICS) * (len(EDGES) + 2) + 1


_SPACE, _LETTER, _UPPER, _DIGIT, _SYMBOL = range(5)
#: Kind of every code point up to U+3000; later ones count as letters.
_KIND = np.array([_SPACE if c.isspace() else _UPPER if c.isupper() else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SYMBOL
                  for c in map(chr, range(0x3000))] + [_LETTER], dtype=np.int64)


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Shares in [0, 1], in the order of STATISTICS."""
    w = max(len(words), 1)
    kept = [x for x in text.split("\n") if x.strip()]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.bincount(_KIND[np.minimum(codes, len(_KIND) - 1)], minlength=5)
    again = sum(map(str.__eq__, words, words[1:]))
    caps = bare = marked = short = long = stops = 0
    for x, k in counts.items():
        end = x[-1]
        caps += k * x.isupper()
        bare += k * (not end.isalnum() and end not in ".,;:!?)\"'»")
        marked += k * (end in "!%#$&*?" and x[-2:-1] == end)
        short += k * (len(x) <= 3)
        long += k * (len(x) > 20)
        stops += k * (end in ".!?")
    n, size = max(len(text), 1), sum(map(len, words))
    return [kinds[_UPPER] / max(kinds[_UPPER] + kinds[_LETTER], 1), kinds[_DIGIT] / n, kinds[_SYMBOL] / n, bare / w, marked / w,
            caps / w, again / w, max(counts.values(), default=0) / w, len(counts) / w,
            1 - len(set(kept)) / max(len(kept), 1), short / w, long / w, stops / w,
            min(np.log2(1 + len(text)) / 20, 1.0), min(np.log2(1 + size / max(len(kept), 1)) / 16, 1.0)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (ascending) and values: hashed words weighted by 1 + log of
    their count and scaled to one length, each statistic as its value and as
    the bin it falls in, and a mark for texts without words."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    crc = zlib.crc32
    x = np.zeros(WORD_BUCKETS)
    if counts:
        at = np.fromiter((crc(k.encode()) for k in counts), dtype=np.int64, count=len(counts)) % WORD_BUCKETS
        np.add.at(x, at, 1 + np.log(np.fromiter(counts.values(), dtype=np.float64, count=len(counts))))
        x *= WORD_SCALE / np.linalg.norm(x)
    index = np.flatnonzero(x)
    values = x[index]
    stats = np.array(statistics(text, words, counts))
    k = len(EDGES) + 2
    base = WORD_BUCKETS + np.arange(len(STATISTICS)) * k
    extra = np.stack([base, base + 1 + np.searchsorted(EDGES, stats)], axis=1).ravel()
    weight = np.stack([stats, np.ones(len(stats))], axis=1).ravel()
    index, values = np.concatenate([index, extra]), np.concatenate([values, weight])
    if not words:
        index, values = np.append(index, N_FEATURES - 1), np.append(values, 1.0)
    keep = values != 0
    return index[keep], values[keep]


@dataclass
class Machine:
    intercept: float
    linear: np.ndarray
    factors: np.ndarray                  # (features, FACTORS)

    def score(self, index: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[index] * values[:, None]
        pairs = 0.5 * (v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum()
        z = self.intercept + self.linear[index] @ values + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(doc_id):
    """crc32 of the id as text, mod FOLDS, is 0 (null ids are held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = TRAIN_ROWS) -> Machine | float:
    """A machine fitted on at most ``rows`` labelled rows that are not held
    out; with no label, or only one of the two, the constant score they allow
    (0.5 without labels)."""
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample is chosen by ids alone; texts are read for it only
    chosen = written(d.select("id").join(y, "id").orderBy(F.xxhash64("id"), "id").limit(rows), "train-ids")
    seen = [r.y for r in chosen.select("y").distinct().collect()]
    if len(seen) < 2:
        return float(seen[0]) if seen else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "y": b.column("y"), "i": pa.array([a.tolist() for a, _ in x], pa.list_(pa.int32())),
                "v": pa.array([v.tolist() for _, v in x], pa.list_(pa.float64()))})

    # at most ``rows`` rows (of one id and one label): a proven bound
    sample = d.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(run, "id long, y int, i array<int>, v array<double>")
    vector = F.udf(lambda i, v: Vectors.sparse(N_FEATURES, i, v), VectorUDT())
    fit = written(sample.orderBy("id"), "train").coalesce(6).select(
        F.col("y").cast("double").alias("label"), vector("i", "v").alias("features")).persist()
    model = FMClassifier(factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=RIDGE, initStd=0.05, seed=7).fit(fit)
    fit.unpersist()
    return Machine(float(model.intercept), model.linear.toArray(), model.factors.toArray())


def score(docs: DataFrame, model: Machine | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    return scored_rows(docs, model, id_col, text_col).drop("th")


def scored_rows(docs: DataFrame, model: Machine | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` with th, the ``text_hash`` of the row, besides.  Null
    texts score like empty ones.  The model, N_FEATURES * (FACTORS + 1)
    numbers, goes to the tasks with the function."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        for b in batches:
            s = [model if isinstance(model, float) else model.score(*features(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "th": b.column("th"), "score": pa.array(s, pa.float64())})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                      text_hash(F.col(text_col)).alias("th"))
    return src.mapInArrow(run, "doc_id long, th long, score double").select(
        "doc_id", "th", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
