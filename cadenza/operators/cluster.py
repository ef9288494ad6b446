"""K-means segments of listener vectors.

The scaler uses the population standard deviation (zero variance -> 0), as
the matched behaviour does; the mean/sd of the 15 columns are one aggregate
row (bounded).  k is chosen by silhouette (``ClusteringEvaluator``, squared
Euclidean — Spark's default) over a table of diagnostics, one row per k from
several starts each; the final model is the lowest-cost fit of more starts.

Starts are k-means++ draws made from hashes of the ids, so a run can be
repeated by any engine, however the rows are dealt: a row at squared distance d
from the centres so far is next with probability d / sum(d), which is the
smallest of ``-ln(u) / d`` with u a uniform number made of (seed, start, step,
id).  A fit of k takes the first k centres of its start.  All starts and all k
take their rounds together: a job reads every row once, places it in every
fit that still moves, and gives the means by one aggregate.  The distances to
the centres of all fits (some hundreds) are one matrix product per Arrow batch,
with numpy in the tasks: as SQL expressions they took 1.3 ms a row.  Only
centres, costs, sizes and silhouettes, bounded by the number of fits and k,
reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.operators.rules import cluster_label
from cadenza.session import cut_lineage


ROWS_PER_PARTITION = 20_000  # listener vectors of a k-means task
ROWS_PER_CORE = 1_000        # vectors from which another core is worth a task
ROUNDS = 100                 # moves of the centres at most
STILL = 1e-9                 # a centre that moves by no more stands still
APART = 1e-12                # squared distance from which rows are different

Centre = tuple[float, ...]


@dataclass
class Fit:
    """Centres, the rows nearest to each, and the sum of squared distances."""
    centres: list[Centre]
    sizes: list[int]
    cost: float

    @property
    def used(self) -> int:
        return sum(size > 0 for size in self.sizes)


@dataclass
class Segmentation:
    status: str
    n_rows: int
    k: int | None
    silhouette: float | None
    diagnostics: list[dict]
    model: Fit | None
    scaler: dict[str, tuple[float, float]] | None
    assignments: DataFrame | None
    clusters: DataFrame | None


def scaler_stats(vectors: DataFrame, metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> dict[str, tuple[float, float]]:
    """Mean and population sd of every metric (one aggregate row)."""
    row = vectors.agg(*[F.avg(m).alias(f"m_{i}") for i, m in enumerate(metrics)],
                      *[F.stddev_pop(m).alias(f"s_{i}") for i, m in enumerate(metrics)]).first()
    return {m: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 0.0) for i, m in enumerate(metrics)}


def standardize(vectors: DataFrame, stats: dict[str, tuple[float, float]],
                metrics: Sequence[str] = tuple(C.METRIC_KEYS), out: str = "features") -> DataFrame:
    """C1+C2: ``(x - mean) / sd`` (0 where sd is 0), assembled in fixed order."""
    scaled = [
        (F.lit(0.0) if s == 0 else (F.col(m) - F.lit(mu)) / F.lit(s)).alias(f"_z{i}")
        for i, (m, (mu, s)) in enumerate((m, stats[m]) for m in metrics)
    ]
    d = vectors.select("*", *scaled)
    d = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(metrics))], outputCol=out).transform(d)
    return d.drop(*[f"_z{i}" for i in range(len(metrics))])


def _rows(scaled: DataFrame, id_cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The id as text and the scaled values as columns."""
    size = len(scaled.select("features").first()[0])
    z = [f"_z{i}" for i in range(size)]
    values = vector_to_array("features")
    return scaled.select(F.concat_ws("\x1f", *id_cols).alias("_id"), *[values[i].alias(c) for i, c in enumerate(z)]), z


def _values(batch: pa.RecordBatch, z: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in z])


def _draws(rows: DataFrame, z: list[str], k: int, starts: int, seed: int) -> list[list[Centre]]:
    """k-means++ centres of every start, fewer than k if the rows have fewer
    different values.  Ids should be unique."""
    drawn: list[list[Centre]] = [[] for _ in range(starts)]
    for step in range(k):
        centres = {s: np.array(c) for s, c in enumerate(drawn)}

        def run(batches: Iterator[pa.RecordBatch], step=step, centres=centres) -> Iterator[pa.RecordBatch]:
            """The row of the smallest key of each start in each batch."""
            for b in batches:
                x, ids, out = _values(b, z), b.column("_id").to_pylist(), []
                for s, c in centres.items():
                    d = np.ones(len(x))
                    if step:
                        d = np.min([((x - y) ** 2).sum(axis=1) for y in c], axis=0)
                    at = np.flatnonzero(d > APART)
                    if len(at):
                        u = np.array([int(md5(f"{seed}:{s}:{step}:{ids[i]}".encode()).hexdigest()[:13], 16) + 1 for i in at]) / float(1 << 52)
                        keys = -np.log(u) / d[at]
                        first = int(np.argmin(keys))
                        out.append((s, float(keys[first]), *x[at[first]].tolist()))
                if out:
                    yield pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(("_set", "_key", *z), zip(*out))}, schema=schema)

        schema = pa.schema([("_set", pa.int32()), ("_key", pa.float64()), *[(c, pa.float64()) for c in z]])
        found = rows.mapInArrow(run, f"_set int, _key double, {', '.join(f'{c} double' for c in z)}").groupBy("_set").agg(
            *[F.min_by(c, "_key").alias(c) for c in z]).collect()
        for r in found:
            drawn[r["_set"]].append(tuple(r[c] for c in z))
        if not found:
            break
    return drawn


def _moved(rows: DataFrame, z: list[str], sets: dict[int, list[Centre]]) -> list[Row]:
    """For each set and centre that is the nearest of a row (``_near``; the
    first among equals): n rows, the sum of their squared distances and their
    mean.  A task sends one row per set and centre of each batch."""
    every = np.concatenate([np.array(c) for c in sets.values()])
    square = (every ** 2).sum(axis=1)
    ends = np.cumsum([len(c) for c in sets.values()])
    names = list(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _values(b, z)
            if not len(x):
                continue
            own = (x ** 2).sum(axis=1)
            far = square - 2 * (x @ every.T)  # squared distance less the row's own square
            out = []
            for s, start, end in zip(names, np.r_[0, ends[:-1]], ends):
                near = far[:, start:end].argmin(axis=1)
                cost = np.maximum(own + far[np.arange(len(x)), start + near], 0.0)
                size = end - start
                n = np.bincount(near, minlength=size)
                costs = np.bincount(near, weights=cost, minlength=size)
                sums = (near[:, None] == np.arange(size)).T.astype(float) @ x
                out += [(s, j, int(n[j]), float(costs[j]), *sums[j].tolist()) for j in np.flatnonzero(n).tolist()]
            yield pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(("_set", "_near", "n", "cost", *z), zip(*out))}, schema=schema)

    schema = pa.schema([("_set", pa.int32()), ("_near", pa.int32()), ("n", pa.int64()), ("cost", pa.float64()),
                        *[(c, pa.float64()) for c in z]])
    parts = rows.mapInArrow(run, f"_set int, _near int, n long, cost double, {', '.join(f'{c} double' for c in z)}")
    return parts.groupBy("_set", "_near").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[
        (F.sum(c) / F.sum("n")).alias(c) for c in z]).collect()


def _fits(rows: DataFrame, z: list[str], starts: dict[int, list[Centre]], rounds: int = ROUNDS) -> dict[int, Fit]:
    """Every start moved until its centres stand still, ``rounds`` times at
    most.  A centre without rows is left out of the next round."""
    done: dict[int, Fit] = {}
    moving = dict(starts)
    for turn in range(rounds + 1):
        if not moving:
            break
        found: dict[int, dict] = {s: {} for s in moving}
        for r in _moved(rows, z, moving):
            found[r["_set"]][r["_near"]] = r
        for s, old in list(moving.items()):
            near = found[s]
            new = [tuple(near[j][c] for c in z) for j in sorted(near)]
            still = len(new) == len(old) and all(abs(x - y) <= STILL for a, b in zip(old, new) for x, y in zip(a, b))
            if still or turn == rounds:
                done[s] = Fit(old, [near[j]["n"] if j in near else 0 for j in range(len(old))], sum(r["cost"] for r in near.values()))
                del moving[s]
            else:
                moving[s] = new
    return done


def place(scaled: DataFrame, fit: Fit) -> DataFrame:
    """``scaled`` with the nearest centre of ``features`` as ``cluster``, the
    first among equals.  The centres are a folded literal of the plan."""
    centres = F.from_json(F.lit(json.dumps(fit.centres)), "array<array<double>>")
    far = F.transform(centres, lambda c: F.aggregate(
        F.zip_with(c, vector_to_array("features"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    return scaled.withColumn("_far", far).withColumn(
        "cluster", (F.array_position("_far", F.array_min("_far")) - 1).cast("int")).drop("_far")


def _lowest_cost(scaled: DataFrame, k: int, starts: int, seed: int, id_cols: Sequence[str]) -> Fit:
    """C4: the cheapest fit; clusters are numbered by their smallest id."""
    rows, z = _rows(scaled, id_cols)
    fits = _fits(rows, z, dict(enumerate(_draws(rows, z, k, max(1, starts), seed))))
    best = fits[min(fits, key=lambda s: (fits[s].cost, s))]
    first = place(scaled, best).groupBy("cluster").agg(F.min(F.struct(*id_cols)).alias("first"))
    order = [r.cluster for r in first.orderBy("first").collect()]
    order += [j for j in range(len(best.centres)) if j not in order]
    return Fit([best.centres[j] for j in order], [best.sizes[j] for j in order], best.cost)


def silhouette(assigned: DataFrame) -> float:
    """Mean silhouette of ``features`` under ``cluster``."""
    return float(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(assigned))


def sweep(scaled: DataFrame, n: int, k_min: int = C.KMEANS_K_MIN, k_max: int = C.KMEANS_K_MAX,
          starts: int = C.KMEANS_SWEEP_RESTARTS, seed: int = C.KMEANS_SEED, id_cols: Sequence[str] = ("user_id",)) -> list[dict]:
    """One record per k that ``n`` rows allow: k, clusters (non-empty
    ones), inertia and silhouette of the lowest-cost fit of ``starts`` fits
    (null where all rows fell into one cluster)."""
    sizes = [k for k in range(k_min, k_max + 1) if k == 2 or 2 < k < n]
    if not sizes:
        return []
    rows, z = _rows(scaled, id_cols)
    starts = max(1, starts)
    drawn = _draws(rows, z, max(sizes), starts, seed)
    fits = _fits(rows, z, {k * starts + s: centres[:k] for k in sizes for s, centres in enumerate(drawn)})
    table = []
    for k in sizes:
        fit = min((fits[k * starts + s] for s in range(starts)), key=lambda f: f.cost)
        table.append({"k": k, "clusters": fit.used, "inertia": float(fit.cost),
                      "silhouette": silhouette(place(scaled, fit)) if fit.used > 1 else None})
    return table


def choose_k(table: list[dict]) -> tuple[int, float | None]:
    """The k of the highest silhouette, the smallest k among equals; 2
    when no fit of the sweep split the rows."""
    split = sorted((-d["silhouette"], d["k"]) for d in table if d["silhouette"] is not None)
    return (split[0][1], -split[0][0]) if split else (2, None)


def prepare_vectors(vectors: DataFrame, id_cols: Sequence[str] = ("user_id",),
                    metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> tuple[DataFrame, int, dict, DataFrame]:
    """Null -> 0, materialised once (the vectors usually come from a
    long profile plan, and k-means runs many jobs over them), then scaled."""
    vec = cut_lineage(vectors.select(
        *id_cols, *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics]))
    n = vec.count()
    stats = scaler_stats(vec, metrics)
    # many short jobs follow: no more partitions than the rows need, but all
    # cores as soon as each has some thousand rows
    cores = vec.sparkSession.sparkContext.defaultParallelism
    parts = max(n // ROWS_PER_PARTITION, min(n // ROWS_PER_CORE, cores - 1)) + 1
    scaled = standardize(vec, stats, metrics).repartition(parts, *id_cols).persist(StorageLevel.MEMORY_AND_DISK)
    return vec, n, stats, scaled


def segment(vectors: DataFrame, id_cols: Sequence[str] = ("user_id",), k: int | None = None,
            restarts: int = C.KMEANS_RESTARTS, sweep_restarts: int = C.KMEANS_SWEEP_RESTARTS, k_min: int = C.KMEANS_K_MIN, k_max: int = C.KMEANS_K_MAX,
            seed: int = C.KMEANS_SEED, metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> Segmentation:
    """Choose k (unless given), fit, assign, summarise clusters."""
    vec, n, stats, scaled = prepare_vectors(vectors, id_cols, metrics)
    if n < C.KMEANS_MIN_ROWS:  # C10
        scaled.unpersist()
        return Segmentation("insufficient_data", n, None, None, [], None, None, None, None)
    diags: list[dict] = []
    sil = None
    if k is None:
        diags = sweep(scaled, n, k_min, k_max, sweep_restarts, seed, id_cols)
        k, sil = choose_k(diags)
    model = _lowest_cost(scaled, k, restarts, seed, id_cols)  # C4
    placed = place(scaled, model)
    pred = placed.drop("features")
    if sil is None and model.used > 1:
        sil = silhouette(placed)
    clusters = cluster_summary(pred, n, metrics)
    scaled.unpersist()
    return Segmentation("ok", n, k, sil, diags, model, stats, pred, clusters)


def status_row(spark: SparkSession, seg: Segmentation) -> DataFrame:
    """One row: status, rows needed, rows there."""
    return spark.createDataFrame([(seg.status, C.KMEANS_MIN_ROWS, seg.n_rows)],
                                 "status string, min_samples_required int, current_samples long")


def pool_status(vectors: DataFrame) -> DataFrame:
    """The status row of a pool without fitting it."""
    n = F.count(F.lit(1))
    return vectors.agg(F.when(n < C.KMEANS_MIN_ROWS, "insufficient_data").otherwise("ok").alias("status"),
                       F.lit(C.KMEANS_MIN_ROWS).alias("min_samples_required"), n.alias("current_samples"))


def cluster_summary(assigned: DataFrame, n: int | None = None,
                    metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> DataFrame:
    """Size, share %, centroid in original units (group means) and the
    centroid's rule label, per cluster."""
    g = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(m).alias(m) for m in metrics])
    total = F.lit(n) if n is not None else F.sum("size").over(Window.partitionBy())
    g = g.withColumn("share_pct", F.lit(100.0) * F.col("size") / total)
    return g.join(cluster_label(g, ["cluster"]), ["cluster"])


def assign(seg: Segmentation, new_vectors: DataFrame, id_cols: Sequence[str] = ("user_id",),
           metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> DataFrame:
    """Place new listeners with the fitted scaler and model (no refit)
    and attach their cluster's label, size and share."""
    if seg.model is None:
        raise ValueError("segmentation has no model (insufficient data)")
    vec = new_vectors.select(*id_cols, *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m)
                                         for m in metrics])
    pred = place(standardize(vec, seg.scaler, metrics), seg.model).select(*id_cols, "cluster")
    return pred.join(seg.clusters.select("cluster", "label", "size", "share_pct"), ["cluster"])
