"""Mergeable quantile summaries of integers by adaptive radix histograms.

Rows become exact counts of distinct values first.  A summary with few distinct values keeps each of them.  For the
others, counting passes go down the values' bits, some bits a pass: a prefix with no more than the error share of its
summary's rows is a leaf, a heavier one (or one with many of the distinct values) is split by the next pass, and no
other row is looked at again.  A leaf becomes a point at its largest value, whose rank is known exactly; between two
points ranks are known up to one leaf.

Summaries are merged by their bounds: at any point of any of them each summary bounds how many of its rows lie below
and up to it, and the bounds add up.  The error of a merged summary is the share of the merged rows, whatever the
number of summaries.

exact_ranks() holds answers against the rows: counts of prefixes of 16 bits give where each prefix starts, so no window
has more than 65 536 rows, however many rows one group has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, prepare, release, tidied

#: Leaves hold at most this share of their summary's rows; passes split prefixes by so many bits.
SHARE = 0.02
RADIX_BITS = 7
#: A summary with up to so many distinct values keeps them all; prefixes with over this share of the distinct values are
#: split also, so that a summary with one heavy value keeps points elsewhere too.
KEPT_WHOLE = 100
DISTINCT_SHARE = 0.125
#: A summary keeps at most this many points: past it, those at steps of rank and of place.
MOST_POINTS = 400
RANK_STEPS = 250
PLACE_STEPS = 100
#: Bits of the values that one window of the exact count goes over.
WINDOW_BITS = 16

POINTS = "array<struct<x: long, below_lo: long, below_hi: long, upto_lo: long, upto_hi: long>>"
_FIELDS = ("x", "below_lo", "below_hi", "upto_lo", "upto_hi")


def counted(rows: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """keys, x, c: the distinct values of each group and how many rows (or what sum of weights) have them.  Rows without
    a value are left out."""
    return rows.where(F.col("x").isNotNull()).groupBy(*keys, "x").agg((F.sum(weight) if weight else F.count("*")).alias("c"))


def _ordered(x: str = "x") -> Column:
    """Signed values as unsigned ones of the same order."""
    return F.col(x).bitwiseXOR(F.lit(-(1 << 63)))


def summarise(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, points of every group.  values: keys, x, c with n and d, the group's rows and distinct values.

    Null keys are groups of their own; an empty table gives no rows.
    """
    keys = list(keys)
    small = values.where(F.col("d") <= KEPT_WHOLE).select(*keys, "n", F.struct("x", "c", F.col("c").alias("top")).alias("leaf"))
    found, done = [small], []
    large = materialise(values.where(F.col("d") > KEPT_WHOLE), "quantile-large")
    low, high = large.agg(F.min("x"), F.max("x")).first()
    if low is not None:
        shift = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64
        rows = large
        while True:
            shift = max(0, shift - RADIX_BITS)
            prefix = F.shiftrightunsigned(_ordered(), shift).alias("prefix")
            cells = rows.groupBy(*keys, "n", "d", prefix).agg(F.sum("c").alias("c"), F.count("*").alias("w"), F.max("x").alias("x"), F.max_by("c", "x").alias("top"))
            light = (F.col("w") == 1) | ((F.col("c") <= F.col("n") * SHARE) & (F.col("w") <= F.col("d") * DISTINCT_SHARE))
            cells = materialise(cells.withColumn("light", light), "quantile-cells")
            done.append(cells)
            found.append(cells.where("light").select(*keys, "n", F.struct("x", "c", "top").alias("leaf")))
            heavy = cells.where(~F.col("light")).select(*keys, "prefix")
            if shift == 0 or heavy.isEmpty():
                break
            rows = _kept(large.withColumn("prefix", prefix), heavy, [*keys, "prefix"])
    leaves = found[0]
    for more in found[1:]:
        leaves = leaves.unionByName(more)
    gathered = leaves.groupBy(*keys, "n").agg(F.collect_list("leaf").alias("leaves"))
    out = materialise(_with_points(gathered, keys), "quantile-summaries")
    release(large, *done)
    return out


def _kept(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows whose columns `by` are among the groups, nulls equal; a further hash lets large groups be split."""
    mark = F.xxhash64(*by)
    right = groups.select(*[F.col(c).alias(f"_{c}") for c in by], mark.alias("_mark"))
    match = F.col("_here") == F.col("_mark")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.withColumn("_here", mark).join(right, match, "left_semi").drop("_here", "prefix")


def measured(values: DataFrame, keys: Sequence[str], stats: DataFrame) -> DataFrame:
    """values with the columns that stats has besides the keys; nulls equal."""
    keys = list(keys)
    mark = F.xxhash64(*keys)
    right = stats.select(*[F.col(c).alias(f"_{c}") if c in keys else c for c in stats.columns], mark.alias("_mark"))
    match = F.col("_here") == F.col("_mark")
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return values.withColumn("_here", mark).join(right, match).drop("_here", "_mark", *[f"_{c}" for c in keys])


def _lists(offsets: np.ndarray, columns: Sequence[np.ndarray]) -> pa.Array:
    """A list column of points from flat columns and the offsets of its lists."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_FIELDS)))


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    lists = pa.concat_arrays([lists]) if lists.offset else lists
    flat = lists.flatten()
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64), flat


def _numbers(flat: pa.StructArray, name: str) -> np.ndarray:
    return flat.field(flat.type.get_field_index(name)).to_numpy(zero_copy_only=False)


def thinned(upto: np.ndarray, size: int) -> np.ndarray:
    """Places of the points that stay: all, or those first to reach each step of rank, those at steps of place, and
    both ends."""
    if len(upto) <= MOST_POINTS:
        return np.arange(len(upto))
    by_rank = np.searchsorted(upto, np.ceil(np.arange(1, RANK_STEPS + 1) * (size / RANK_STEPS)))
    by_place = np.linspace(0, len(upto) - 1, PLACE_STEPS).astype(np.int64)
    return np.unique(np.concatenate([np.minimum(by_rank, len(upto) - 1), by_place]))


def _thin_lists(offsets: np.ndarray, columns: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    many = np.diff(offsets)
    if (many <= MOST_POINTS).all():
        return offsets, columns
    kept = [a + thinned(columns[3][a:b], n) if b - a > MOST_POINTS else np.arange(a, b) for a, b, n in zip(offsets[:-1], offsets[1:], sizes, strict=True)]
    at = np.concatenate(kept)
    return np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64), [c[at] for c in columns]


def _with_points(gathered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, points from each group's leaves, whose number is bounded by the share and the passes."""

    def run(batches):
        for batch in batches:
            offsets, flat = _flat(batch.column(batch.schema.get_field_index("leaves")))
            group = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            x, c, top = (_numbers(flat, f) for f in ("x", "c", "top"))
            order = np.lexsort((x, group))
            x, c, top = x[order], c[order], top[order]
            upto = np.cumsum(c)
            upto = upto - np.concatenate([[0], upto])[offsets[:-1]][group]
            sizes = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
            offsets, columns = _thin_lists(offsets, [x, upto - top, upto - top, upto, upto], sizes)
            own = [batch.column(batch.schema.get_field_index(k)) for k in [*keys, "n"]]
            yield pa.RecordBatch.from_arrays([*own, _lists(offsets, columns)], [*keys, "n", "points"])

    types = dict(gathered.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n long", f"points {POINTS}"])
    return gathered.mapInArrow(tidied(run), schema)


def merge(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, points: all summaries of a group merged into one, from their points and sizes alone.

    A group's summaries are brought together: their number should be bounded (merge in rounds where it is not).
    """
    by = list(by)
    gathered = summaries.groupBy(*by).agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "points")).alias("parts"))

    def run(batches):
        for batch in batches:
            outer, parts = _flat(batch.column(batch.schema.get_field_index("parts")))
            inner, flat = _flat(parts.field(parts.type.get_field_index("points")))
            part_sizes = _numbers(parts, "n")
            group_of_part = np.repeat(np.arange(batch.num_rows), np.diff(outer))
            turn_of_part = np.arange(len(part_sizes)) - outer[:-1][group_of_part]
            part = np.repeat(np.arange(len(part_sizes)), np.diff(inner))
            group, turn = group_of_part[part], turn_of_part[part]
            x, *bounds = (_numbers(flat, f) for f in _FIELDS)
            order = np.lexsort((x, group))
            gx, xx = group[order], x[order]
            new = np.ones(len(xx), bool)
            new[1:] = (gx[1:] != gx[:-1]) | (xx[1:] != xx[:-1])
            slot_of = np.empty(len(xx), np.int64)
            slot_of[order] = np.cumsum(new) - 1
            px, pg = xx[new], gx[new]
            offsets = np.searchsorted(pg, np.arange(batch.num_rows + 1))
            sums = [np.zeros(len(px), np.int64) for _ in range(4)]
            first, last = offsets[:-1][pg], offsets[1:][pg]
            for t in range(int(turn.max(initial=-1)) + 1):
                mine = np.flatnonzero(turn == t)
                has = np.full(len(px), -1, np.int64)
                has[slot_of[mine]] = mine
                places = np.where(has >= 0, np.arange(len(px)), -1)
                before = np.maximum.accumulate(places)
                before = np.where(before >= first, before, -1)
                after = np.where(has >= 0, np.arange(len(px)), len(px))
                after = np.minimum.accumulate(after[::-1])[::-1]
                after = np.where(after < last, after, -1)
                size = np.zeros(batch.num_rows, np.int64)
                ours = turn_of_part == t
                size[group_of_part[ours]] = part_sizes[ours]
                b_lo, b_hi, u_lo, u_hi = bounds
                here = has >= 0
                low = np.where(before >= 0, u_lo[has[before]], 0) if len(px) else np.zeros(0, np.int64)
                high = np.where(after >= 0, b_hi[has[after]], size[pg]) if len(px) else low
                sums[0] += np.where(here, b_lo[has], low)
                sums[1] += np.where(here, b_hi[has], high)
                sums[2] += np.where(here, u_lo[has], low)
                sums[3] += np.where(here, u_hi[has], high)
            sizes = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
            offsets, columns = _thin_lists(offsets.astype(np.int64), [px, *sums], sizes)
            own = [batch.column(batch.schema.get_field_index(k)) for k in [*by, "n"]]
            yield pa.RecordBatch.from_arrays([*own, _lists(offsets, columns)], [*by, "n", "points"])

    types = dict(summaries.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in by], "n long", f"points {POINTS}"])
    return gathered.mapInArrow(tidied(run), schema)


def estimates(summaries: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """keys, n, i, target, points (their number), answer for i in 1 to parts - 1: target is ceil(i n / parts), and the
    answer is the first point up to which at least that many rows surely lie."""
    keys = list(keys)

    def run(batches):
        for batch in batches:
            offsets, flat = _flat(batch.column(batch.schema.get_field_index("points")))
            sizes = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
            x, upto = _numbers(flat, "x"), _numbers(flat, "upto_lo")
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            line = upto + np.repeat(start, np.diff(offsets))
            i = np.tile(np.arange(1, parts), batch.num_rows)
            row = np.repeat(np.arange(batch.num_rows), parts - 1)
            target = -(-(i * sizes[row]) // parts)
            answer = x[np.searchsorted(line, start[row] + target)]
            own = [batch.column(batch.schema.get_field_index(k)).take(pa.array(row)) for k in keys]
            made = [sizes[row], i, target, np.diff(offsets)[row], answer]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(m, t) for m, t in zip(made, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], [*keys, "n", "i", "target", "points", "answer"])

    types = dict(summaries.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n long, i int, target long, points long, answer long"])
    return summaries.mapInArrow(tidied(run), schema)


def _starts(rows: DataFrame, keys: Sequence[str], name: str, bits: int) -> DataFrame:
    """keys, `name`, start: how many rows of the group lie before each prefix, for prefixes of the given width in bits.

    Windows go over the prefixes that share all but their last bits, and start where those longer prefixes start.
    """
    totals = rows.groupBy(*keys, name).agg(F.sum("c").alias("c"))
    if bits <= WINDOW_BITS:
        over = Window.partitionBy(*keys).orderBy(name)
        return totals.select(*keys, name, (F.sum("c").over(over) - F.col("c")).alias("start"))
    totals = materialise(totals.withColumn(f"_{name}", F.shiftrightunsigned(name, WINDOW_BITS)), "quantile-prefixes")
    above = _starts(totals, keys, f"_{name}", bits - WINDOW_BITS).withColumnRenamed("start", "_above")
    over = Window.partitionBy(*keys, f"_{name}").orderBy(name)
    inside = totals.withColumn("_inside", F.sum("c").over(over) - F.col("c"))
    return measured(inside, [*keys, f"_{name}"], above).select(*keys, name, (F.col("_above") + F.col("_inside")).alias("start"))


def exact_ranks(values: DataFrame, answers: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """answers (keys, n, i, answer, fits) with exact_x, the target-th smallest value of the group, and n_below and
    n_upto, its rows below and up to the answer.

    values: keys, n, fits, x, c; n is the group's number of rows, and `fits` whether its distinct values fit one window.
    Groups that do not are cut by the values' upper bits.
    """
    keys = list(keys)
    asked = answers.select(*keys, "n", "fits", F.col("answer").alias("x"), F.lit(0).cast("long").alias("c"), "i")
    both = values.select(*keys, "n", "fits", "x", "c", F.lit(None).cast("int").alias("i")).unionByName(asked)

    def ranked(found: DataFrame, by: Sequence[str]) -> DataFrame:
        # Rows of equal values are counted together; those that ask count nothing.
        found = found.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy("x")) + F.col("start")).withColumn("at", F.sum("c").over(Window.partitionBy(*by, "x")))
        # The targets in a value's rows: ceil(i n / parts) <= r holds just when i <= floor(parts r / n).
        first, last = F.expr(f"CAST(((upto - at) * {parts}) div n AS INT)"), F.expr(f"CAST((upto * {parts}) div n AS INT)")
        asks = F.col("c") == 0
        hit = F.when(asks, F.array("i")).when(first < last, F.sequence(first + 1, last))
        found = found.withColumn("i", F.explode(hit)).where(F.col("i") < parts)
        return found.select(*keys, "i", F.when(~asks, F.col("x")).alias("exact_x"), F.when(asks, F.col("upto") - F.col("at")).alias("n_below"), F.when(asks, F.col("upto")).alias("n_upto"))

    small = ranked(both.where("fits").withColumn("start", F.lit(0).cast("long")), keys)
    parted = materialise(both.where(~F.col("fits")).withColumn("cell", F.shiftrightunsigned(_ordered(), WINDOW_BITS)), "quantile-cells")
    starts = materialise(_starts(parted, keys, "cell", 64 - WINDOW_BITS), "quantile-starts")
    large = ranked(measured(parted, [*keys, "cell"], starts), [*keys, "cell"])
    ranks = small.unionByName(large).groupBy(*keys, "i").agg(*[F.max(c).alias(c) for c in ("exact_x", "n_below", "n_upto")])
    return measured(answers, [*keys, "i"], ranks)


def judged(values: DataFrame, group: Sequence[str], batch: str, parts: int, least: int, error: float) -> DataFrame:
    """Quantiles of every batch and of each group's batches merged (batch -1), held against the rows.

    values: group, batch, x, c, the distinct values as by `counted`.  Returns group, batch, i, n, target, exact_x,
    points, answer, n_below, n_upto, rank_error and within (rank_error <= error n) for summaries of `least` rows or
    more.  Null groups are groups of their own; an empty table gives no rows.
    """
    prepare(values.sparkSession)
    group, keys = list(group), [*group, batch]
    stats = values.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    stats = materialise(stats, "quantile-sizes")
    whole = materialise(stats.groupBy(*group).agg(F.sum("n").alias("all_n"), (F.sum("d") <= 1 << WINDOW_BITS).alias("fits")), "quantile-groups")
    sized = materialise(measured(values, keys, measured(stats, group, whole)), "quantile-values")
    own = summarise(sized, keys)
    merged = merge(own, group).withColumn(batch, F.lit(-1))
    answers = estimates(own.where(F.col("n") >= least), keys, parts).unionByName(estimates(merged.where(F.col("n") >= least).select(*keys, "n", "points"), keys, parts))
    answers = materialise(measured(answers, group, whole.drop("all_n")), "quantile-answers")
    totals = sized.where(F.col("all_n") >= least).groupBy(*group, F.col("all_n").alias("n"), "fits", "x").agg(F.sum("c").alias("c")).withColumn(batch, F.lit(-1))
    rows = sized.where(F.col("n") >= least).select(*keys, "n", "fits", "x", "c").unionByName(totals)
    found = exact_ranks(rows, answers, keys, parts)
    miss = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    found = found.withColumn("rank_error", miss).withColumn("within", F.col("rank_error") <= F.col("n") * error)
    return found.select(*keys, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within")
