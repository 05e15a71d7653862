"""Trees grown level by level over binned rows: second-order boosting, extremely random trees, and bagged forests.

Features become bins at sketched quantiles, once, in a table on shared storage.  A level is one pass: each task drops its
rows down the trees grown so far and adds them up by (tree, node, feature, bin); the sums meet by (tree, node,
feature), where splits are scored; one row a node, its best split, comes to the driver.  All trees of a forest grow
side by side.  Targets are summed as integers (fixed point) and whatever is random is a hash of row, tree, node or
feature, so the trees do not depend on how rows are dealt out, or dealt out again after a loss.

A model is held by the driver and sent to the tasks: most_nodes bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: The parameters of the boosted model and of the two forests.
BOOSTED = {"rounds": 3000, "max_depth": 60, "rate": 0.01, "reg_lambda": 10.0, "reg_alpha": 1.0, "gamma": 0.0, "min_child_weight": 4.0, "subsample": 0.5, "base_score": 0.5}
FOREST = {"trees": 3000, "max_depth": 60, "min_split": 2, "bootstrap": True}

BINS = 64
#: The bin of missing values: they go to the side that a split names.
MISSING = -1
#: Sums that one task keeps in a pass; more open nodes than fit are taken in several passes.
CELLS = 4_000_000
MOST_NODES = 2_000_000
#: Boosting writes the rows' margins anew after so many trees.
REFRESH = 16
U64 = np.uint64


def hashed(*parts) -> np.ndarray:
    """A 64-bit hash of integers (arrays or not), the same everywhere."""
    h = U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.int64).view(U64)) * U64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> U64(29))
            h = h * U64(0x94D049BB133111EB)
            h = h ^ (h >> U64(32))
    return h


def uniform(*parts) -> np.ndarray:
    """Hashes as numbers from 0 to 1."""
    return (hashed(*parts) >> U64(11)).astype(np.float64) / float(1 << 53)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bag_counts(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson counts of mean one, from the row's key and the tree alone."""
    return np.searchsorted(_POISSON, uniform(seed, 1, tree, keys), "right")


@dataclass
class Trees:
    """Nodes of all trees in one set of lists; roots says where each tree begins, feature is -1 at a leaf."""

    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def node(self, value: float, rows: int) -> int:
        for name, v in (("feature", -1), ("bin", 0), ("missing_left", True), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0), ("rows", rows)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: np.array(getattr(self, n)) for n in ("roots", "feature", "bin", "missing_left", "left", "right", "value")}


def leaves(trees: dict[str, np.ndarray], tree: int, bins: np.ndarray) -> np.ndarray:
    """The node of each row of bins in a tree."""
    at = np.full(len(bins), trees["roots"][tree])
    row = np.arange(len(bins))
    while len(row):
        here = at[row]
        f = trees["feature"][here]
        row, here, f = row[f >= 0], here[f >= 0], f[f >= 0]
        b = bins[row, f]
        left = np.where(b == MISSING, trees["missing_left"][here], b <= trees["bin"][here])
        at[row] = np.where(left, trees["left"][here], trees["right"][here])
    return at


# --- binned rows ---------------------------------------------------------------------------------------------------


def quantile_bounds(rows: DataFrame, features: int, bins: int) -> list[list[float]]:
    """For each of x0, x1, ... the values that its bins end with: all its values where they are no more than the bins,
    else values that divide its rows about evenly, from a quantile sketch.  Missing values have no bin of this kind."""

    def few(batches):
        seen: list[set] = [set() for _ in range(features)]
        for batch in batches:
            for i, own in enumerate(seen):
                if len(own) <= bins:
                    own.update(batch.column(batch.schema.get_field_index(f"x{i}")).drop_null().unique().to_pylist())
        # More than the bins are enough to show that there are too many.
        pairs = [(i, v) for i, own in enumerate(seen) for v in sorted(own)[: bins + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int32()), pa.array([v for _, v in pairs], pa.float64())], ["i", "v"])

    values = rows.select(*[f"x{i}" for i in range(features)]).mapInArrow(few, "i int, v double").distinct().where("v IS NOT NULL")
    small = values.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") <= bins)
    exact = {r["i"]: sorted(r["v"]) for r in values.join(small, "i").groupBy("i").agg(F.collect_list("v").alias("v")).collect()}
    steps = [k / bins for k in range(1, bins)] + [1.0]
    rest = [i for i in range(features) if i not in exact]
    found = rows.agg(*[F.percentile_approx(f"x{i}", steps, 10_000).alias(f"q{i}") for i in rest]).first() if rest else {}
    return [exact[i] if i in exact else sorted(set(found[f"q{i}"] or [])) for i in range(features)]


def as_columns(table: DataFrame, columns: Sequence[str] | str, y: str | None, row_id: str | None) -> tuple[DataFrame, int]:
    """x0, x1, ... as doubles with not-a-number as missing, with y and a hashed row key.  columns may be the name of one
    vector column."""
    if isinstance(columns, str):
        size = len(table.schema[columns].metadata.get("ml_attr", {}).get("attrs", {}).get("numeric", [])) or len(table.select(columns).first()[0])
        parts = [vector_to_array(F.col(columns))[i] for i in range(size)]
    else:
        parts = [F.col(f"`{c}`").cast("double") for c in columns]
    named = [F.when(~F.isnan(p), p).alias(f"x{i}") for i, p in enumerate(parts)]
    if y is not None:
        named.append(F.col(f"`{y}`").cast("double").alias("y"))
    if row_id is not None:
        named.append(F.xxhash64(f"`{row_id}`").alias("key"))
    return table.select(*named), len(parts)


def binned_table(rows: DataFrame, bounds: Sequence[Sequence[float]]) -> DataFrame:
    """key, y, margin and the bins of each row as one binary column, on shared storage.  Rows without y are left out."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f"x{i}")).to_numpy(zero_copy_only=False).astype(float) for i in range(len(bounds))]
            bins = bins_of(np.stack(columns, 1) if columns else np.empty((batch.num_rows, 0)), bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("y")), pa.array(np.zeros(batch.num_rows)), pa.array([r.tobytes() for r in bins], pa.binary())], ["key", "y", "margin", "bins"]
            )

    return written(rows.where(F.col("y").isNotNull() & ~F.isnan("y")).mapInArrow(run, "key long, y double, margin double, bins binary"), "binned")


def unpacked(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key, y, margin, bins = (batch.column(batch.schema.get_field_index(n)) for n in ("key", "y", "margin", "bins"))
    matrix = np.frombuffer(b"".join(bins.to_pylist()), np.int16).reshape(batch.num_rows, features)
    return key.to_numpy(), y.to_numpy(), margin.to_numpy(), matrix


# --- growing -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """How splits are scored and drawn.

    kind: "best" takes the best bin of every feature, "random" one bin a feature, drawn by hash between the values at a
    node.  features is the share of features that a node looks at (drawn by hash).
    """

    kind: str = "best"
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    least_weight: float = 1.0
    min_split: int = 2
    features: float = 1.0
    seed: int = 0


def strength(g: np.ndarray, n: np.ndarray, rule: Rule) -> np.ndarray:
    """G^2 / (H + lambda) with G brought nearer zero by alpha; zero where there are no rows."""
    g = np.sign(g) * np.maximum(np.abs(g) - rule.reg_alpha, 0)
    d = n + rule.reg_lambda
    return np.divide(g * g, d, out=np.zeros(np.broadcast(g, d).shape), where=d > 0)


def weight(g: float, n: float, rule: Rule) -> float:
    """The value of a leaf: what its gradients and L1 and L2 terms leave as the best step."""
    g = math.copysign(max(abs(g) - rule.reg_alpha, 0), g)
    return -g / (n + rule.reg_lambda) if n + rule.reg_lambda > 0 else 0.0


def best_splits(n: np.ndarray, g: np.ndarray, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, values: Sequence[Sequence[float]], rule: Rule) -> dict[str, np.ndarray]:
    """The best split of each row of histograms: n and g are rows by bins, the last bin for missing values.

    Of equal gains the smallest bin counts, and missing values go left before right.
    """
    bins = n.shape[1] - 1
    all_n, all_g = n.sum(1, keepdims=True), g.sum(1, keepdims=True)
    low_n, low_g = np.cumsum(n[:, :-1], 1), np.cumsum(g[:, :-1], 1)
    whole = strength(all_g, all_n, rule)
    gains = np.full((2, len(n), bins), -np.inf)
    for side in (0, 1):  # missing values left, then right
        left_n, left_g = (low_n + n[:, -1:], low_g + g[:, -1:]) if side == 0 else (low_n, low_g)
        right_n = all_n - left_n
        gain = 0.5 * (strength(left_g, left_n, rule) + strength(all_g - left_g, right_n, rule) - whole) - rule.gamma
        gains[side] = np.where((left_n >= rule.least_weight) & (right_n >= rule.least_weight), gain, -np.inf)
    if rule.kind == "random":
        drawn = np.zeros(len(n), np.int64)
        for i, f in enumerate(feature.tolist()):
            there = np.flatnonzero(n[i, :-1])
            if len(there):
                v = np.array(values[f])
                low, high = v[there[0]], v[there[-1]]
                cut = low + uniform(rule.seed, 2, tree[i], node[i], f) * (high - low)
                drawn[i] = max(0, np.searchsorted(v, cut, "right") - 1)
        gains = np.where(np.arange(bins) == drawn[:, None], gains, -np.inf)
    if rule.features < 1:
        gains[:, uniform(rule.seed, 3, tree, node, feature) >= rule.features] = -np.inf
    flat = gains.transpose(1, 2, 0).reshape(len(n), -1)  # by bin, then side
    at = flat.argmax(1)
    row, bin_, side = np.arange(len(n)), at // 2, at % 2
    left_n = low_n[row, bin_] + np.where(side == 0, n[:, -1], 0)
    left_g = low_g[row, bin_] + np.where(side == 0, g[:, -1], 0)
    return {"gain": flat[row, at], "bin": bin_, "missing_left": side == 0, "n": all_n[:, 0], "g": all_g[:, 0], "left_n": left_n, "left_g": left_g}


def grow(rows: DataFrame, trees: Trees, new: Sequence[int], values: Sequence[Sequence[float]], rule: Rule, max_depth: int, scale: float, draw: Callable, gradient: Callable, first: int, shrink: float = 1.0, most_nodes: int = MOST_NODES) -> None:
    """Grow the trees `new` (numbers; their roots are made here) to max_depth, a level at a time.

    draw(keys, tree) gives each row's count in a tree; gradient(y, margin, sent, first, bins) its gradient.
    """
    spark, features = rows.sparkSession, len(values)
    width = max((len(v) for v in values), default=0) + 1
    open_ = {}
    for t in new:
        trees.roots.append(trees.node(0.0, 0))
        open_[trees.roots[t]] = t
    for _ in range(max_depth):
        if not open_:
            break
        per_pass = max(1, CELLS // max(1, 2 * features * width))
        names = sorted(open_)
        nodes_next: dict[int, int] = {}
        for a in range(0, len(names), per_pass):
            wanted = names[a : a + per_pass]
            sent = spark.sparkContext.broadcast((trees.arrays(), wanted, sorted({open_[w] for w in wanted})))
            for r in _pass(rows, sent, values, width, rule, scale, draw, gradient, first).collect():
                at, t = r["node"], open_[r["node"]]
                trees.value[at], trees.rows[at] = shrink * weight(r["g"] / scale, r["n"], rule), r["n"]
                if r["gain"] is None or not r["gain"] > 0 or r["n"] < rule.min_split:
                    continue
                left = trees.node(shrink * weight(r["left_g"] / scale, r["left_n"], rule), r["left_n"])
                right = trees.node(shrink * weight((r["g"] - r["left_g"]) / scale, r["n"] - r["left_n"], rule), r["n"] - r["left_n"])
                trees.feature[at], trees.bin[at], trees.missing_left[at], trees.gain[at] = r["feature"], r["bin"], r["missing_left"], r["gain"]
                trees.left[at], trees.right[at] = left, right
                nodes_next |= {left: t, right: t}
            sent.destroy()
        if len(trees.feature) > most_nodes:
            raise ValueError(f"more than {most_nodes} nodes: grow fewer or shallower trees")
        open_ = nodes_next


def _pass(rows: DataFrame, sent, values, width: int, rule: Rule, scale: float, draw: Callable, gradient: Callable, first: int) -> DataFrame:
    """node, feature, bin, missing_left, gain, n, g, left_n, left_g: the best split of each wanted node."""
    features = len(values)

    def sums(batches):
        arrays, wanted, open_trees = sent.value
        place = {w: i for i, w in enumerate(wanted)}
        lut = np.full(len(arrays["feature"]), -1)
        lut[wanted] = np.arange(len(wanted))
        n = np.zeros(len(place) * features * width, np.int64)
        g = np.zeros(len(place) * features * width, np.int64)
        tree_of = np.zeros(len(place), np.int64)
        any_rows = False
        for batch in batches:
            key, y, margin, bins = unpacked(batch, features)
            for t in open_trees:
                times = draw(key, t)
                grad = np.rint(gradient(y, margin, arrays, first, bins) * scale).astype(np.int64)
                at = lut[leaves(arrays, t, bins)]
                use = (at >= 0) & (times > 0)
                if not use.any():
                    continue
                any_rows = True
                at, times, grad = at[use], times[use].astype(np.int64), grad[use]
                tree_of[at] = t
                for f in range(features):
                    b = bins[use, f].astype(np.int64)
                    cell = (at * features + f) * width + np.where(b == MISSING, width - 1, b)
                    np.add.at(n, cell, times)
                    np.add.at(g, cell, times * grad)
        if any_rows:
            n, g = n.reshape(len(place), features, width), g.reshape(len(place), features, width)
            some = np.flatnonzero(n.any(axis=(1, 2)))
            for i in some.tolist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(tree_of[i])] * features, pa.int64()), pa.array([wanted[i]] * features, pa.int64()), pa.array(range(features), pa.int32()), pa.array([x.tobytes() for x in n[i]], pa.binary()), pa.array([x.tobytes() for x in g[i]], pa.binary())],
                    ["tree", "node", "feature", "n", "g"],
                )

    def splits(batches):
        held: dict[tuple[int, int, int], list[np.ndarray]] = {}
        for batch in batches:
            for t, node, f, n, g in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tree", "node", "feature", "n", "g")], strict=True):
                n, g = np.frombuffer(n, np.int64), np.frombuffer(g, np.int64)
                if (t, node, f) in held:
                    both = held[t, node, f]
                    both[0] = both[0] + n
                    both[1] = both[1] + g
                else:
                    held[t, node, f] = [n, g]
        if held:
            tree, node, f = (np.array(x) for x in zip(*held, strict=True))
            n, g = (np.stack([v[i] for v in held.values()]) for i in (0, 1))
            # Nodes are told apart by where they lie in their tree, so that trees grown together or alone are the same.
            places = sent.value[0]
            found = best_splits(n, g / scale, tree, positions(places, tree, node), f, values, rule)
            exact_left = _left_sums(g, found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(f, pa.int32()), pa.array(found["bin"], pa.int32()), pa.array(found["missing_left"], pa.bool_()), pa.array(np.where(np.isfinite(found["gain"]), found["gain"], -1.0)), pa.array(n.sum(1), pa.int64()), pa.array(g.sum(1), pa.int64()), pa.array(found["left_n"].astype(np.int64), pa.int64()), pa.array(exact_left, pa.int64())],
                ["node", "feature", "bin", "missing_left", "gain", "n", "g", "left_n", "left_g"],
            )

    parts = rows.mapInArrow(sums, "tree long, node long, feature int, n binary, g binary").repartition("node", "feature")
    each = parts.mapInArrow(splits, "node long, feature int, bin int, missing_left boolean, gain double, n long, g long, left_n long, left_g long")
    return each.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "missing_left", "gain", "n", "g", "left_n", "left_g"), F.struct("gain", -F.col("feature"))).alias("s")).select("node", "s.*")


def _left_sums(g: np.ndarray, found: dict[str, np.ndarray]) -> np.ndarray:
    row = np.arange(len(g))
    return np.cumsum(g[:, :-1], 1)[row, found["bin"]] + np.where(found["missing_left"], g[:, -1], 0)


def positions(trees: dict[str, np.ndarray], tree: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where nodes lie in their trees, as hashes of the turns from the root: not by the order of making."""
    parent, turn = np.full(len(trees["feature"]), -1), np.zeros(len(trees["feature"]), np.int64)
    for side, name in ((1, "left"), (2, "right")):
        inner = np.flatnonzero(trees["feature"] >= 0)
        parent[trees[name][inner]], turn[trees[name][inner]] = inner, side
    out = []
    for v in node.tolist():
        path = []
        while v >= 0:
            path.append(int(turn[v]))
            v = int(parent[v])
        h = 0
        for step in reversed(path):
            h = int(hashed(h, step).view(np.int64))
        out.append(h)
    return np.array(out, np.int64)


# --- models --------------------------------------------------------------------------------------------------------


@dataclass
class TreeModel:
    """Grown trees with the bounds of their bins.  The prediction is base plus the trees' values, added or averaged."""

    trees: Trees
    bounds: list[list[float]]
    columns: Sequence[str] | str
    base: float
    average: bool
    seed: int = 0

    def transform(self, table: DataFrame, name: str = "prediction") -> DataFrame:
        """The table with its predictions; missing features go where the splits say."""
        base, average = self.base, self.average
        sent = table.sparkSession.sparkContext.broadcast((self.trees.arrays(), self.bounds))

        @F.pandas_udf("double")
        def predicted(xs):
            trees, bounds = sent.value
            matrix = np.array(xs.tolist(), float).reshape(len(xs), len(bounds))
            bins = bins_of(matrix, bounds)
            total = np.zeros(len(xs))
            for t in range(len(trees["roots"])):
                total += trees["value"][leaves(trees, t, bins)]
            return pd.Series(base + (total / max(1, len(trees["roots"])) if average else total))

        return table.withColumn(name, predicted(F.array(*self._parts())))

    def _parts(self) -> list:
        if isinstance(self.columns, str):
            return [vector_to_array(F.col(self.columns))[i] for i in range(len(self.bounds))]
        return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in self.columns]

    def importances(self) -> list[float]:
        """Each feature's share of the gain of all splits."""
        found = [0.0] * len(self.bounds)
        for f, g in zip(self.trees.feature, self.trees.gain, strict=True):
            if f >= 0:
                found[f] += g
        total = sum(found)
        return [v / total if total else 0.0 for v in found]

    def importance_table(self, spark) -> DataFrame:
        names = self.columns if not isinstance(self.columns, str) else [f"{self.columns}[{i}]" for i in range(len(self.bounds))]
        return spark.createDataFrame(list(zip(names, self.importances(), strict=True)), "feature string, importance double")

    def split_table(self, spark) -> DataFrame:
        """A row for each node: what it asks, or the value of a leaf."""
        t, rows = self.trees, []
        for n, root in enumerate(t.roots):
            stack = [(root, "")]
            while stack:
                at, path = stack.pop()
                inner = t.feature[at] >= 0
                rows.append((n, path, t.feature[at] if inner else None, self.bounds[t.feature[at]][t.bin[at]] if inner else None, t.missing_left[at] if inner else None, t.gain[at] if inner else None, int(t.rows[at]), float(t.value[at])))
                if inner:
                    stack += [(t.left[at], path + "L"), (t.right[at], path + "R")]
        return spark.createDataFrame(rows, "tree int, path string, feature int, threshold double, missing_left boolean, gain double, n long, value double")

    def out_of_bag(self, table: DataFrame, y: str, row_id: str) -> DataFrame:
        """row_id, y, estimate, n_trees: the mean of the trees that did not see the row, by its bag counts drawn again.

        Rows that every tree saw have no estimate.
        """
        trees, seed = self.trees.arrays(), self.seed
        sent = table.sparkSession.sparkContext.broadcast((trees, self.bounds))
        base = self.base

        @F.pandas_udf("struct<estimate: double, n_trees: int>")
        def judged(xs, keys):
            trees, bounds = sent.value
            bins = bins_of(np.array(xs.tolist(), float).reshape(len(xs), len(bounds)), bounds)
            total, n = np.zeros(len(xs)), np.zeros(len(xs), int)
            for t in range(len(trees["roots"])):
                unseen = bag_counts(keys.to_numpy(), t, seed) == 0
                total[unseen] += trees["value"][leaves(trees, t, bins[unseen])]
                n += unseen
            return pd.DataFrame({"estimate": np.where(n > 0, base + total / np.maximum(n, 1), np.nan), "n_trees": n})

        found = table.withColumn("_j", judged(F.array(*self._parts()), F.xxhash64(f"`{row_id}`")))
        return found.select(row_id, F.col(f"`{y}`").cast("double").alias("y"), F.when(F.col("_j.n_trees") > 0, F.col("_j.estimate")).alias("estimate"), F.col("_j.n_trees").alias("n_trees"))


def bins_of(matrix: np.ndarray, bounds: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins of values, not-a-number as missing."""
    out = np.empty(matrix.shape, np.int16)
    for i, b in enumerate(bounds):
        x = matrix[:, i]
        missing = np.isnan(x) | (len(b) == 0)
        out[:, i] = np.where(missing, MISSING, np.minimum(np.searchsorted(np.array(b), np.where(missing, 0.0, x)), max(0, len(b) - 1)))
    return out


def _prepared(table: DataFrame, columns: Sequence[str] | str, y: str, row_id: str, bins: int) -> tuple[DataFrame, list[list[float]], dict]:
    rows, features = as_columns(table, columns, y, row_id)
    bounds = quantile_bounds(rows, features, bins)
    found = binned_table(rows, bounds)
    stats = found.agg(F.count("*").alias("n"), F.max(F.abs("y")).alias("most"), F.avg("y").alias("mean")).first()
    return found, bounds, {"n": stats["n"], "most": stats["most"] or 0.0, "mean": stats["mean"] or 0.0}


def _scale(n: int, most: float) -> float:
    """Fixed point: sums of n gradients, drawn a dozen times at most, stay below 2^62."""
    return 2.0 ** min(32, math.floor(62 - math.log2(max(1.0, 12 * n * max(most, 1e-300) * 2))))


def boosted_trees(
    table: DataFrame, columns: Sequence[str] | str, y: str, row_id: str = "row_id", rounds: int = BOOSTED["rounds"], max_depth: int = BOOSTED["max_depth"], rate: float = BOOSTED["rate"], reg_lambda: float = BOOSTED["reg_lambda"],
    reg_alpha: float = BOOSTED["reg_alpha"], gamma: float = BOOSTED["gamma"], min_child_weight: float = BOOSTED["min_child_weight"], subsample: float = BOOSTED["subsample"], base_score: float = BOOSTED["base_score"], bins: int = BINS, seed: int = 0,
) -> TreeModel:
    """Boosting on squared error by gradients and Hessians, with L1 and L2 terms on the leaves.

    Rows without y are left out; missing features are split off to the better side; equal rows count each; a table
    without rows gives a model of its base score.
    """
    rows, bounds, stats = _prepared(table, columns, y, row_id, bins)
    rule = Rule("best", reg_lambda, reg_alpha, gamma, min_child_weight, 2, 1.0, seed)
    trees, first = Trees(), 0
    scale = _scale(stats["n"], stats["most"] + abs(base_score))

    def draw(keys, tree):
        return (uniform(seed, 4, tree, keys) < subsample).astype(np.int64) if subsample < 1 else np.ones(len(keys), np.int64)

    def margins(margin, arrays, start, bins):
        total = margin.copy()
        for t in range(start, len(arrays["roots"])):
            total += arrays["value"][leaves(arrays, t, bins)]
        return total

    def gradient(y_, margin, arrays, start, bins):
        # The tree that grows has no say yet: it is the last.
        older = {**arrays, "roots": arrays["roots"][:-1]}
        return base_score + margins(margin, older, start, bins) - y_

    for t in range(rounds if stats["n"] else 0):
        grow(rows, trees, [t], bounds, rule, max_depth, scale, draw, gradient, first, rate)
        if (t + 1) % REFRESH == 0 and t + 1 < rounds:
            rows = _with_margins(rows, trees, first, len(bounds), margins)
            first = t + 1
    return TreeModel(trees, bounds, columns, base_score, False, seed)


def _with_margins(rows: DataFrame, trees: Trees, first: int, features: int, margins: Callable) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(trees.arrays())

    def run(batches):
        for batch in batches:
            key, y, margin, bins = unpacked(batch, features)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(y), pa.array(margins(margin, sent.value, first, bins)), batch.column(batch.schema.get_field_index("bins"))], ["key", "y", "margin", "bins"])

    return written(rows.mapInArrow(run, rows.schema), "margins")


def _forest(table, columns, y, row_id, kind, trees, max_depth, min_split, bootstrap, features, bins, seed) -> TreeModel:
    rows, bounds, stats = _prepared(table, columns, y, row_id, bins)
    grown, mean = Trees(), stats["mean"]
    rule = Rule(kind, min_split=min_split, features=features, seed=seed)

    def draw(keys, tree):
        return bag_counts(keys, tree, seed) if bootstrap else np.ones(len(keys), np.int64)

    def gradient(y_, margin, arrays, start, bins):
        return mean - y_

    if stats["n"]:
        grow(rows, grown, range(trees), bounds, rule, max_depth, _scale(stats["n"], 2 * stats["most"]), draw, gradient, 0)
    return TreeModel(grown, bounds, columns, mean, True, seed)


def extra_trees(table: DataFrame, columns: Sequence[str] | str, y: str, row_id: str = "row_id", trees: int = FOREST["trees"], max_depth: int = FOREST["max_depth"], min_split: int = FOREST["min_split"], bootstrap: bool = FOREST["bootstrap"], features: float = 1.0, bins: int = BINS, seed: int = 0) -> TreeModel:
    """Trees whose thresholds are drawn by a hash of tree, node and feature; the best feature splits.  The same trees
    come of any partitioning.  Nulls and repeats as for boosted_trees."""
    return _forest(table, columns, y, row_id, "random", trees, max_depth, min_split, bootstrap, features, bins, seed)


def bagged_forest(table: DataFrame, columns: Sequence[str] | str, y: str, row_id: str = "row_id", trees: int = FOREST["trees"], max_depth: int = FOREST["max_depth"], min_split: int = FOREST["min_split"], bootstrap: bool = FOREST["bootstrap"], features: float = 1.0, bins: int = BINS, seed: int = 0) -> TreeModel:
    """Trees of best splits on bagged rows; out_of_bag judges rows by the trees that did not see them."""
    return _forest(table, columns, y, row_id, "best", trees, max_depth, min_split, bootstrap, features, bins, seed)
