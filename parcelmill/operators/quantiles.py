"""Exact quantiles by selection: counted passes narrow the range that holds a rank, so no task holds all values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that a range is cut into by one pass.
PARTS = 256


def ranked_values(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at 0-based ranks among a column's values, missing and not-a-number ones aside.

    A pass counts, for every range that still holds a rank, its rows by equal parts of the range, with the least and
    most value of each part; a rank's range becomes its part, until that holds one value.  Ranks past the last are left
    out.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    open_ = {r: (low, high, 0) for r in ranks if 0 <= r < n}
    found: dict[int, float] = {}
    while open_:
        for r, (a, b, _) in list(open_.items()):
            if a == b:
                found[r] = a
                del open_[r]
        if not open_:
            break
        ranges = sorted({(a, b) for a, b, _ in open_.values()})
        cells = []
        for i, (a, b) in enumerate(ranges):
            # Halves first, so that the width of the widest range stays finite.
            share = (F.col("v") / 2 - a / 2) / (b / 2 - a / 2)
            part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")
            cells.append(F.when(F.col("v").between(a, b), F.struct(F.lit(i).alias("i"), part.alias("part"))))
        counted = values.select("v", F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").groupBy("c.i", "c.part")
        rows = counted.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # PARTS for each rank at most
        parts: dict[int, list] = {}
        for row in sorted(rows, key=lambda x: (x["i"], x["part"])):
            parts.setdefault(row["i"], []).append(row)
        for r, (a, b, before) in open_.items():
            for row in parts[ranges.index((a, b))]:
                if r < before + row["n"]:
                    open_[r] = (row["low"], row["high"], before)
                    break
                before += row["n"]
    return found


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, linear between the two values nearest; None for a column without values."""
    n = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * s for s in shares]
    values = ranked_values(df, column, sorted({r for x in at for r in (math.floor(x), math.ceil(x))}))
    return [values[math.floor(x)] + (values[math.ceil(x)] - values[math.floor(x)]) * (x - math.floor(x)) for x in at]
