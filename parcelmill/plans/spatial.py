"""Spatial errors at any size: y = c + Xb + u with u = lambda W u + e, by maximum likelihood over an edge table.

The likelihood needs two things.  The sums of squares come from one pass: products of the columns and of their spatial
lags are added up, and give the least-squares fit at every lambda by small matrices.  The log-determinant of I - lambda W
is the series -sum lambda^k tr(W^k) / k; the second trace is exact, by meeting edges with their opposites, and higher ones
are means over probe vectors of random signs, which a hash of row and probe gives, so that a lost task draws them again.
Each power is one join of the edges with the vectors before.  (Power moments, as weights of nearest neighbours are not
symmetric: their roots are complex, where Chebyshev polynomials grow.)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .trees import hashed

PROBES = 64
POWERS = 14
#: Lambda is sought between these.
LIMIT = 0.99


@dataclass(frozen=True)
class SpatialFit:
    intercept: float
    coefficients: list[float]
    lam: float
    variance: float
    rows: int


def standardised(weights: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (i, j, w) between rows of the table (i), each row's weights adding up to one.  Repeated edges add up; rows
    without weights have none."""
    held = weights.select("i", "j", F.col("w").cast("double").alias("w")).where("w <> 0")
    held = held.join(ids.select(F.col("i").alias("j")), "j", "left_semi").join(ids, "i", "left_semi")
    held = held.groupBy("i", "j").agg(F.sum("w").alias("w"))
    sums = held.groupBy(F.col("i").alias("_i")).agg(F.sum("w").alias("_sum")).where("_sum <> 0")
    return held.join(sums, F.col("i") == F.col("_i")).select("i", "j", (F.col("w") / F.col("_sum")).alias("w"))


def lagged(edges: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """i, v: the weighted sums over edges (i, j, w) of vectors (i, v: doubles as binary).  Rows without edges are absent.

    Terms of one row come together by its id and are added as they stream past.
    """

    def add(batches):
        now, total = None, None
        for batch in batches:
            ids, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(ids):
                continue
            terms = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, width) * w[:, None]
            cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            sums, names = np.add.reduceat(terms, cuts), ids[cuts]
            if now is not None and names[0] == now:
                sums[0] += total
            elif now is not None:
                sums, names = np.concatenate([total[None], sums]), np.append(now, names)
            now, total = names[-1], sums[-1]
            yield pa.RecordBatch.from_arrays([pa.array(names[:-1], pa.int64()), pa.array([s.tobytes() for s in sums[:-1]], pa.binary())], ["i", "v"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["i", "v"])

    terms = edges.join(vectors.withColumnRenamed("i", "j"), "j").select("i", "w", "v")
    return terms.repartition("i").sortWithinPartitions("i").mapInArrow(add, "i long, v binary")


def gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sum over rows (v: doubles as binary) of v v': a small matrix from each task, added up by place."""

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, width)
            total += v.T @ v
        places = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(total.reshape(-1))], ["at", "value"])

    found = np.zeros(width * width)
    for r in rows.select("v").mapInArrow(products, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        found[r["at"]] = r["value"]
    return found.reshape(width, width)


def signs(ids: np.ndarray, probes: int, seed: int) -> np.ndarray:
    """Random signs of each row and probe, from a hash."""
    return np.where(hashed(seed, np.asarray(ids)[:, None], np.arange(probes)[None]) & np.uint64(1), 1.0, -1.0)


def traces(edges: DataFrame, ids: DataFrame, probes: int = PROBES, powers: int = POWERS, seed: int = 0) -> list[float]:
    """tr(W), tr(W^2), ... : the first two exactly, the rest as means over probes."""
    opposite = edges.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("back"))
    first = edges.where("i = j").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    second = edges.join(opposite, ["i", "j"]).agg(F.coalesce(F.sum(F.col("w") * F.col("back")), F.lit(0.0))).first()[0]

    def start(batches):
        for batch in batches:
            drawn = signs(batch.column(0).to_numpy(), probes, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in drawn], pa.binary())], ["i", "v"])

    def against(batches):
        total = 0.0
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, probes)
            total += float((v * signs(batch.column(0).to_numpy(), probes, seed)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["t"])

    found = [first, second]
    vectors = ids.mapInArrow(start, "i long, v binary")
    for k in range(1, powers + 1):
        vectors = written(lagged(edges, vectors, probes), "powers")
        if k > 2:
            found.append((vectors.mapInArrow(against, "t double").agg(F.sum("t")).first()[0] or 0.0) / probes)
    return found[:powers]


def log_determinant(lam: float, found: Sequence[float], more: int = 400) -> float:
    """log |I - lam W| by its series; traces past the known ones fall by the ratio of the last even ones."""
    total = -sum(lam ** (k + 1) * t / (k + 1) for k, t in enumerate(found))
    if len(found) > 4 and found[-3] > 0 and found[-1] > 0:
        step = min(1.0, (found[-1] / found[-3]) ** 0.5)
        total -= sum((lam ** (len(found) + k)) * found[-1] * step**k / (len(found) + k) for k in range(1, more))
    return total


def spatial_error_fit(table: DataFrame, columns: Sequence[str], y: str, weights: DataFrame, key: str = "row_id", probes: int = PROBES, powers: int = POWERS, seed: int = 0) -> SpatialFit:
    """The fit over weights (i, j, w), which are standardised by row.  Rows with a missing value are left out, with their
    edges; keys are unique integers; a table without rows, or columns that depend on each other, are an error."""
    width = len(columns) + 2
    packed = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in columns], F.col(f"`{y}`").cast("double"))
    rows = table.select(F.col(key).cast("long").alias("i"), packed.alias("v")).where("NOT exists(v, x -> x IS NULL OR isnan(x))")

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v).tobytes() for v in batch.column(1).to_pylist()], pa.binary())], ["i", "v"])

    rows = written(rows.mapInArrow(pack, "i long, v binary"), "spatial-rows")
    ids = rows.select("i")
    edges = written(standardised(weights, ids), "edges")
    lags = lagged(edges, rows, width).withColumnRenamed("v", "lag")
    none = F.lit(bytes(8 * width))
    g = gram(rows.join(lags, "i", "left").select(F.concat("v", F.coalesce("lag", none)).alias("v")), 2 * width)
    n = int(round(g[0, 0]))
    if not n:
        raise ValueError("no rows to fit")
    own, cross, lag = g[:width, :width], g[:width, width:], g[width:, width:]
    found = traces(edges, ids, probes, powers, seed)

    def at(lam: float):
        m = own - lam * (cross + cross.T) + lam * lam * lag
        beta = np.linalg.solve(m[:-1, :-1], m[:-1, -1])
        variance = max((m[-1, -1] - beta @ m[:-1, -1]) / n, 1e-300)
        return -n / 2 * np.log(variance) + log_determinant(lam, found), beta, variance

    # The likelihood has one peak: golden section search.
    low, high, part = -LIMIT, LIMIT, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if at(a)[0] > at(b)[0] else (a, high)
    lam = (low + high) / 2
    _, beta, variance = at(lam)
    return SpatialFit(float(beta[0]), [float(b) for b in beta[1:]], float(lam), float(variance), n)
