"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token totals are summed per cell (source, language, topic).  Raking gives every source, every language and every topic a
factor, so that the totals weighted by the three factors have the target share of each.  A round is one pass over the
sources' cells: each source's factor follows from the pairs of language and topic that it holds, and the pairs' new
totals, a small table, are raked to their two targets.  Sources stay a table, however many there are.  A document is
drawn with probability min(1, c * weight), with c set so that the expected tokens meet the budget; the draw is a hash
of its id.

Where documents have no topic column, topics are clusters: spherical k-means over words of five characters and more, by
hashed tf-idf, fitted on all documents.  Tokens are words unless a column of counts is named.
"""

from __future__ import annotations

import math
import warnings
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, prepare, release, tidied, unused, worker_cache

DIMENSIONS = ("source", "lang", "topic")
#: Clusters, least length of their words, places of a document's vector, rounds of the clusters' means.
TOPICS = 8
TOPIC_CHARS = 5
PLACES = 512
TOPIC_ROUNDS = 12
#: Vectors are in whole parts of this.
STEPS = 1 << 20
#: Bytes of a word that are hashed side by side with those of others; longer words are hashed each.
NEAR = 48
#: Largest count in 16 bits beside a place; texts whose vectors are made at once.
MOST_COUNT = (1 << 16) // PLACES - 1
BLOCK = 256
#: Share of the tokens to draw; exponent of the default targets (1 keeps the shares there are, 0 makes them equal).
BUDGET = 0.5
TEMPER = 0.5
TOLERANCE = 1e-9
MAX_ROUNDS = 200
#: Pairs of language and topic that the driver rakes; more are raked as tables.  Sources that are broadcast; more are
#: joined.
MOST_PAIRS = 100_000
BROADCAST_SOURCES = 100_000
#: Values of c tried in one pass, and passes.
SCALES, SCALE_PASSES = 48, 6
MISSING = "(none)"
CACHE_ENTRIES = 150_000


class Places(dict):
    """Place of each word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        place = self[word] = zlib.crc32(word) % PLACES
        return place


def place_counts(split: list[list[bytes]], places: Places) -> np.ndarray:
    """How often the long words of each text come, by place."""
    found = [[places[w] for w in words if len(w) >= TOPIC_CHARS] for words in split]
    sizes = list(map(len, found))
    flat = np.fromiter((p for own in found for p in own), np.int64, sum(sizes))
    return np.bincount(np.repeat(np.arange(len(found)) * PLACES, sizes) + flat, minlength=len(found) * PLACES).reshape(-1, PLACES)


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of zeros by their number, and what each lower-cased byte adds to it by its distance from a word's end."""
    zeros = np.array([zlib.crc32(bytes(n)) for n in range(NEAR + 1)], np.uint32)
    adds = np.array([[zlib.crc32(bytes([b]).lower() + bytes(d)) for b in range(256)] for d in range(NEAR)], np.uint32)
    return zeros, adds ^ zeros[1:, None]


def text_counts(texts: pa.Array, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and its place_counts as a sparse row, for a whole column: words are cut by
    comparing bytes, and as CRC-32 is linear, that of all words is summed byte by byte from byte_tables.  Null is empty."""
    end, blank = (pa.scalar(x, pa.large_binary()) for x in (b"", b" "))
    joined = pc.binary_join_element_wise(texts.cast(pa.large_binary()), end, blank, null_handling="replace")
    n = len(joined)
    offsets = np.frombuffer(joined.buffers()[1], "<i8")[joined.offset : joined.offset + n + 1]
    raw = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    blanks = (raw == 32) | (raw - np.uint8(9) < 5)
    bounds = np.flatnonzero(np.diff(blanks, prepend=True))
    starts, ends = bounds[::2], bounds[1::2]
    words = np.diff(np.searchsorted(starts, offsets))

    held = ends - starts >= TOPIC_CHARS
    starts, ends = starts[held], ends[held]
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offsets)))
    # Longest first: those that reach to a distance are the first ones.
    sizes = np.minimum(ends - starts, NEAR + 1).astype(np.uint8)
    order = np.argsort(NEAR + 1 - sizes, kind="stable")
    reach = len(sizes) - np.cumsum(np.bincount(sizes, minlength=NEAR + 2))
    zeros, adds = tables
    found, last, far = zeros[np.minimum(sizes[order], NEAR)], ends[order] - 1, int(reach[NEAR])
    for d in range(NEAR):
        if reach[d] == far:
            break
        found[far : reach[d]] ^= adds[d].take(raw.take(last[far : reach[d]] - d))
    for i, k in enumerate(order[:far].tolist()):
        found[i] = zlib.crc32(raw[starts[k] : ends[k]].tobytes().lower())
    keys = np.sort(row[order] * PLACES + found % PLACES)
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return words, encoded(n, *np.divmod(keys[heads], PLACES), np.diff(heads, append=len(keys)))


def encoded(n: int, row: np.ndarray, place: np.ndarray, count: np.ndarray) -> pa.Array:
    """Sparse rows: 16 bits for each place that a row holds, count * PLACES + place; counts over MOST_COUNT take several."""
    if count.max(initial=0) > MOST_COUNT:
        parts = -(-count // MOST_COUNT)
        rest = count - (parts - 1) * MOST_COUNT
        row, place, count = np.repeat(row, parts), np.repeat(place, parts), np.full(parts.sum(), MOST_COUNT)
        count[np.cumsum(parts) - 1] = rest
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=n)) * 2).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer((count * PLACES + place).astype("<u2"))])


def sparse(counts: np.ndarray) -> list[bytes]:
    """place_counts as sparse rows."""
    row, place = np.nonzero(counts)
    return encoded(len(counts), row, place, counts[row, place]).to_pylist()


class Block(NamedTuple):
    """What some texts hold: how many texts, and for each place held text * PLACES + place and count * PLACES + place."""

    n: int
    at: np.ndarray
    codes: np.ndarray

    def marks(self) -> np.ndarray:
        """A hash of each text's counts."""
        found = np.zeros(self.n, np.uint64)
        np.add.at(found, self.at // PLACES, mix64(self.codes.astype(np.uint64)))
        return mix64(found).view(np.int64)


def blocks(column: pa.Array) -> Iterator[Block]:
    """A column of sparse rows, BLOCK rows at a time: their vectors stay in the processor's cache."""
    ends = np.frombuffer(column.buffers()[1] or bytes(4), "<i4")[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for first in range(0, len(column), BLOCK):
        cut = ends[first : first + BLOCK + 1]
        n, codes = len(cut) - 1, held[cut[0] : cut[-1]].view("<u2")
        at = codes % PLACES + np.repeat(np.arange(n) * PLACES, np.diff(cut) // 2)
        if codes.max(initial=0) >= MOST_COUNT * PLACES:
            more = np.flatnonzero(at[1:] == at[:-1]) + 1
            first, counts = np.ones(len(at), bool), codes[more] // PLACES
            first[more] = False
            at, codes = at[first], codes[first].astype(np.int64)
            np.add.at(codes, more - np.arange(1, len(more) + 1), counts.astype(np.int64) * PLACES)
        yield Block(n, at, codes)


def pointing(idf: np.ndarray) -> Callable[[Block], np.ndarray]:
    """The units of a block's texts."""
    table = np.outer(np.log1p(np.arange(MOST_COUNT + 1)), idf).ravel()

    def points(block: Block) -> np.ndarray:
        weights = table.take(block.codes, mode="clip")
        large = np.flatnonzero(block.codes >= len(table))
        weights[large] = np.log1p(block.codes[large] // PLACES) * idf[block.codes[large] % PLACES]
        found = np.zeros(block.n * PLACES)
        found[block.at] = weights
        return whole_steps(found.reshape(-1, PLACES))

    return points


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return normed(np.log1p(counts) * idf)


def normed(found: np.ndarray) -> np.ndarray:
    """found, which is overwritten, with rows of length 1."""
    found /= np.maximum(np.sqrt((found * found).sum(1, keepdims=True)), 1e-12)
    return found


def whole_steps(found: np.ndarray) -> np.ndarray:
    """Rows of length 1 in whole steps of 1 / STEPS: their products and sums are exact, in whatever order they are added."""
    found = normed(found)
    found *= STEPS
    return np.rint(found, out=found)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fit_topics(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """idf of every place, and the unit centres of the clusters, from texts' place_counts that are at hand."""

    def farthest(idf, centres):
        points = units(counts, idf)
        return points[np.argmin(likeness(points, centres))]

    return _fitted(lambda: (len(counts), (counts > 0).sum(0)), farthest, lambda idf, middle: cluster_sums(units(counts, idf), middle))


def units(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The vectors of place_counts in whole steps."""
    return whole_steps(np.log1p(counts) * idf)


def likeness(points: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    """How like each point is to the centre it is most like."""
    return np.zeros(len(points)) if centres is None else (points @ centres.T).max(1)


def cluster_sums(points: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Sums of the points that are nearest to each centre."""
    own = np.eye(len(middle))[(points @ middle.T).argmax(1)]
    return (own.T @ points).astype(np.int64)


def _fitted(frequencies: Callable, farthest: Callable, sums: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first seeds, then rounds of assignment and means.  Each step is a sum or a least over all texts."""
    n, held = frequencies()
    idf = np.log((n + 1) / (held + 1))
    if not n:
        return idf, np.zeros((1, PLACES))
    middle = farthest(idf, None)[None]
    for _ in range(min(TOPICS, n) - 1):
        middle = np.vstack([middle, farthest(idf, middle)])
    for _ in range(TOPIC_ROUNDS):
        total = sums(idf, middle)
        norm = np.linalg.norm(total.astype(float), axis=1, keepdims=True)
        before, middle = middle, np.where(norm > 0, np.rint(total / np.maximum(norm, 1) * STEPS), middle)
        if (before == middle).all():
            break
    return idf, middle / STEPS


def fit_all_topics(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """fit_topics over a table of sparse rows (`places`), all of them: each step is a pass whose sums meet by place.  Of
    texts that are equally far the one with the smallest mark is taken."""

    def summed(make, size: int) -> np.ndarray:
        def run(batches):
            total = np.zeros(size, np.int64)
            for batch in batches:
                for block in blocks(batch.column(0)):
                    total += make(block).ravel()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

        found = np.zeros(size, np.int64)
        for r in texts.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            found[r["at"]] = r["n"]
        return found

    def frequencies():
        found = summed(lambda block: np.append(np.bincount(block.at % PLACES, minlength=PLACES), block.n), PLACES + 1)
        return int(found[-1]), found[:-1]

    def farthest(idf, centres):
        def run(batches):
            best, points = None, pointing(idf)
            for batch in batches:
                for k, block in enumerate(blocks(batch.column(0))):
                    alike = np.zeros(block.n) if centres is None else likeness(points(block), centres)
                    least = float(alike.min())
                    if best is None or least <= best[0]:
                        marks = np.where(alike == least, block.marks(), np.iinfo(np.int64).max)
                        at = int(marks.argmin())
                        own = (least, int(marks[at]), batch.column(0)[k * BLOCK + at].as_py())
                        best = own if best is None else min(best, own)
            yield pa.RecordBatch.from_arrays([pa.array([b] if best else [], t) for b, t in zip(best or [None] * 3, (pa.float64(), pa.int64(), pa.binary()), strict=True)], ["alike", "mark", "places"])

        found = texts.mapInArrow(run, "alike double, mark long, places binary").agg(F.min(F.struct("alike", "mark", "places")).alias("s")).first()["s"]
        return pointing(idf)(next(blocks(pa.array([bytes(found["places"])], pa.binary()))))[0]

    def sums(idf, middle):
        points = pointing(idf)
        return summed(lambda block: cluster_sums(points(block), middle), len(middle) * PLACES).reshape(len(middle), PLACES)

    return _fitted(frequencies, farthest, sums)


def described(docs: DataFrame, topic: str, size: str, topic_col: str | None, tokens_col: str | None) -> DataFrame:
    """docs with the columns topic (text) and size (tokens) added; a topic is missing where a text has no long word.

    Where topics are clusters, texts are read once: their counts by place are written with the rows, the clusters are
    fitted on the counts of all rows, and each row's topic follows from its own.
    """
    wanted = [*(["places"] if topic_col is None else []), *([size] if tokens_col is None else [])]
    names, at = docs.columns, docs.columns.index("text")
    if wanted:
        # By position: mapInArrow does not take names with a dot.
        places_of = [f"c{i}" for i in range(len(names))]
        more_names = [f"d{i}" for i in range(len(wanted))]

        def run(batches):
            cache = worker_cache("mixing")
            if "tables" not in cache:
                cache["tables"] = byte_tables()
            for batch in batches:
                words, counts = text_counts(batch.column(at), cache["tables"])
                more = [*([counts] if topic_col is None else []), *([pa.array(words, pa.int64())] if tokens_col is None else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*places_of, *more_names])

        types = [*(f"{c} {t}" for c, (_, t) in zip(places_of, docs.dtypes, strict=True)), *(f"{d} {'binary' if w == 'places' else 'long'}" for d, w in zip(more_names, wanted, strict=True))]
        rows = docs.toDF(*places_of).mapInArrow(tidied(run), ", ".join(types))
        if topic_col is None:
            rows = materialise(rows, "described")
            idf, middle = fit_all_topics(rows.where(F.octet_length("d0") > 0).select("d0"))

            points = pointing(idf)

            @F.arrow_udf("string")
            def nearest(places: pa.Array) -> pa.Array:
                near = [k for block in blocks(places) for k in (points(block) @ np.rint(middle * STEPS).T).argmax(1).tolist()]
                return pa.array([str(k) if size else None for k, size in zip(near, pc.binary_length(places).to_pylist(), strict=True)], pa.string())

            rows = rows.withColumn("d0", nearest("d0"))
        docs = rows.toDF(*names, *[topic if w == "places" else w for w in wanted])
    if topic_col is not None:
        docs = docs.withColumn(topic, F.col(topic_col).cast("string"))
    return docs if tokens_col is None else docs.withColumn(size, F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0)))


def target_shares(totals: Mapping[str, float], wanted: Mapping[str, float] | None) -> dict[str, float]:
    """Shares that sum to 1 over the values that have tokens; by default tempered from the shares there are."""
    raw = {k: (float(wanted.get(k, 0.0)) if wanted is not None else float(n) ** TEMPER) for k, n in totals.items() if n > 0}
    total = sum(raw.values())
    if not total:
        return {k: 1 / len(raw) for k in raw}
    return {k: v / total for k, v in raw.items()}


def rake(totals: np.ndarray, rows: np.ndarray, columns: np.ndarray, tolerance: float = TOLERANCE, rounds: int = 500) -> np.ndarray:
    """Factors of the cells of a matrix by which its row and column sums become those wanted, as far as they can."""
    factor = np.ones(totals.shape)
    scale = max(float(rows.sum()), 1e-300)
    for _ in range(rounds):
        now = (totals * factor).sum(1)
        factor *= np.where(now > 0, rows / np.where(now > 0, now, 1), 0)[:, None]
        now = (totals * factor).sum(0)
        factor *= np.where(now > 0, columns / np.where(now > 0, now, 1), 0)[None]
        if np.abs((totals * factor).sum(1) - rows).max(initial=0) / scale < tolerance:
            break
    return factor


def rake_sources(sources: DataFrame, pairs: list[tuple[str, str]], total: float, shares: Mapping[str, Mapping[str, float]]) -> tuple[Column, np.ndarray]:
    """A source's factor as a column over sources (wanted, cells: pair and tokens), and the factors of the pairs.

    Rounds go on until the languages' and topics' totals are met to TOLERANCE of all tokens.
    """
    langs, topics = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    at = np.array([(langs.index(lang), topics.index(topic)) for lang, topic in pairs])
    rows = np.array([shares["lang"].get(v, 0.0) for v in langs]) * total
    columns = np.array([shares["topic"].get(v, 0.0) for v in topics]) * total
    factors = np.ones(len(pairs))
    off = math.inf
    for _ in range(MAX_ROUNDS):
        held = F.array(*[F.lit(float(f)) for f in factors])
        mine = F.aggregate("cells", F.lit(0.0), lambda total, c: total + c["tokens"] * held[c["pair"]])
        source = F.when(mine > 0, F.col("wanted") / mine).otherwise(0.0)
        cells = sources.select(source.alias("factor"), F.explode("cells").alias("cell")).select("cell.pair", (F.col("factor") * F.col("cell.tokens") * held[F.col("cell.pair")]).alias("now"))
        now = np.zeros((len(langs), len(topics)))
        for r in cells.groupBy("pair").agg(F.sum("now").alias("now")).collect():
            now[tuple(at[r["pair"]])] = r["now"]
        before, off = off, max(np.abs(now.sum(1) - rows).max(initial=0), np.abs(now.sum(0) - columns).max(initial=0)) / max(total, 1)
        if off < TOLERANCE or abs(before - off) < TOLERANCE * 1e-3:
            break
        factors *= rake(now, rows, columns)[at[:, 0], at[:, 1]]
    if off >= 1e3 * TOLERANCE:
        warnings.warn(f"raking stopped with a language or topic off its target by {off:.2g} of all tokens", stacklevel=2)
    return source, factors


def rake_tables(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, total: float, tolerance: float = 1e-7) -> dict[str, DataFrame]:
    """Factors of every source, language and topic (`value`, `factor`) as tables, for any number of them.

    One dimension after the other is brought to its totals, until all three are met at once.
    """
    wanted, factors = {}, {}
    for d in DIMENSIONS:
        asked = (targets or {}).get(d)
        if asked is None:
            raw = F.col("n").cast("double") ** TEMPER
        else:
            raw = F.coalesce(F.create_map(*[F.lit(x) for k, v in asked.items() for x in (k, float(v))])[F.col("value")], F.lit(0.0)) if asked else F.lit(0.0)
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("n")).withColumn("raw", F.when(F.col("n") > 0, raw).otherwise(0.0))
        s = sums.agg(F.sum("raw").alias("raw"), F.count_if(F.col("n") > 0).alias("held")).first()
        share = F.col("raw") / F.lit(s["raw"]) if s["raw"] else F.when(F.col("n") > 0, 1 / F.lit(max(s["held"], 1))).otherwise(0.0)
        wanted[d] = materialise(sums.select("value", (share * total).alias("wanted")), "raking-targets")
        factors[d] = wanted[d].select("value", F.lit(1.0).alias("factor"))
    for _ in range(MAX_ROUNDS):
        off = 0.0
        for d in DIMENSIONS:
            now = weighted_cells(cells, factors).groupBy(F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            joined = wanted[d].join(factors[d], "value").join(now, "value", "left")
            new = materialise(joined.select("value", F.when(F.col("now") > 0, F.col("factor") * F.col("wanted") / F.col("now")).otherwise(0.0).alias("factor"), F.abs(F.coalesce("now", F.lit(0.0)) - F.col("wanted")).alias("off")), "raking")
            off = max(off, (new.agg(F.max("off")).first()[0] or 0.0) / max(total, 1))
            release(factors[d])
            factors[d] = new
        if off < tolerance:
            break
    else:
        warnings.warn(f"raking stopped with a source, language or topic off its target by {off:.2g} of all tokens", stacklevel=2)
    return {d: f.select("value", "factor") for d, f in factors.items()}


def weighted_cells(cells: DataFrame, factors: Mapping[str, DataFrame]) -> DataFrame:
    """cells with weight, the product of the factors of their values."""
    found, weight = cells, F.lit(1.0)
    for d, f in factors.items():
        found = found.join(f.select(F.col("value").alias(d), F.col("factor").alias(f"f_{d}")), d)
        weight = weight * F.col(f"f_{d}")
    return found.withColumn("weight", weight)


def scale_for(cells: DataFrame, budget: float) -> float:
    """The c at which sum(tokens * min(1, c * weight)) is the budget's share of the tokens (of cells with a weight), or
    the largest useful c.  Each pass tries many values between the two that enclose it."""
    held = cells.where("tokens > 0 and weight > 0")
    s = held.agg(F.sum("tokens").alias("n"), F.min("weight").alias("least"), F.max("weight").alias("most")).first()
    if not s["n"]:
        return 0.0
    wanted = budget * s["n"]
    low, high = 0.0, 1 / s["least"]
    met = {low: 0.0, high: float(s["n"])}
    for number in range(SCALE_PASSES):
        # Weights may lie orders of magnitude apart: the first pass is spread by ratios.
        tried = np.geomspace(min(budget, 1) / s["most"] / 2, high, SCALES) if not number else np.linspace(low, high, SCALES + 2)[1:-1]
        sums = held.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(c)) * F.col("weight"))).alias(f"c{i}") for i, c in enumerate(tried)]).first()
        met |= {float(c): float(x) for c, x in zip(tried, sums, strict=True)}
        low = max((c for c, x in met.items() if x <= wanted), default=low)
        high = min((c for c, x in met.items() if x >= wanted and c >= low), default=high)
        if met[high] - met[low] <= 1e-12 * s["n"]:
            break
    # Between the two the sum is a straight line, or nearly.
    return low + (wanted - met[low]) / (met[high] - met[low]) * (high - low) if met[high] > met[low] else high


def _raked(cells: DataFrame, small: list, targets: Mapping[str, Mapping[str, float]] | None, budget: float) -> tuple[DataFrame, DataFrame, float]:
    """Factors of sources and of pairs of language and topic, and the scale, where the driver can hold the pairs."""
    spark = cells.sparkSession
    pairs, total = [(r["lang"], r["topic"]) for r in small], float(sum(r["tokens"] for r in small))
    shares = {}
    for d in ("lang", "topic"):
        sums: Counter[str] = Counter()
        for r in small:
            sums[r[d]] += r["tokens"]
        shares[d] = target_shares(sums, (targets or {}).get(d))
    wanted = (targets or {}).get("source")
    if wanted is None:
        raw = F.when(F.col("n") > 0, F.col("n").cast("double") ** TEMPER).otherwise(0.0)
    else:
        raw = F.coalesce(F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, float(v))])[F.col("source")], F.lit(0.0)) if wanted else F.lit(0.0)
    places = spark.createDataFrame([(lang, topic, i) for i, (lang, topic) in enumerate(pairs)], "lang string, topic string, pair int")
    sources = cells.join(F.broadcast(places), ["lang", "topic"]).groupBy("source").agg(F.sum("tokens").alias("n"), F.array_sort(F.collect_list(F.struct("pair", "tokens"))).alias("cells"))
    sources = materialise(sources.withColumn("raw", F.when(F.col("n") > 0, raw).otherwise(0.0)), "sources")
    s = sources.agg(F.sum("raw").alias("raw"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("held")).first()
    share = F.col("raw") / F.lit(s["raw"]) if s["raw"] else F.when(F.col("n") > 0, 1 / F.lit(max(s["held"] or 0, 1))).otherwise(0.0)
    sources = sources.withColumn("wanted", share * total)

    factor, factors = rake_sources(sources, pairs, total, shares)
    by_source = materialise(sources.select(F.col("source").alias("_source"), factor.alias("_factor"), "cells"), "source-factors")
    table = F.array(*[F.lit(float(f)) for f in factors])
    c = scale_for(by_source.select("_factor", F.explode("cells").alias("cell")).select("cell.tokens", (F.col("_factor") * table[F.col("cell.pair")]).alias("weight")), budget)

    by_pair = F.broadcast(spark.createDataFrame([(*p, float(f)) for p, f in zip(pairs, factors, strict=True)], "_lang string, _topic_value string, _pair_factor double"))
    return by_source, by_pair, c


ADDED = ("topic", "n_tokens", "weight", "probability", "selected")


def mixed(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, seed: int = 17, topic_col: str | None = None, tokens_col: str | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """mix, with the added columns under names that docs does not have: the table, and the name of each."""
    spark = docs.sparkSession
    prepare(spark)
    names = dict(zip(ADDED, unused(docs, *(f"_{a}" for a in ADDED)), strict=True))
    rows = described(docs, names["topic"], names["n_tokens"], topic_col, tokens_col)
    value = {d: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for d, c in zip(DIMENSIONS, ("source", "lang", names["topic"]), strict=True)}
    cells = materialise(rows.select(*[c.alias(d) for d, c in value.items()], F.col(names["n_tokens"]).alias("n")).groupBy(*DIMENSIONS).agg(F.sum("n").alias("tokens")), "cells")

    small = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("lang", "topic").limit(MOST_PAIRS + 1).collect()
    if len(small) > MOST_PAIRS:
        total = float(cells.agg(F.sum("tokens")).first()[0])
        factors = rake_tables(cells, targets, total)
        weighted = materialise(weighted_cells(cells, factors), "weighted-cells")
        c = scale_for(weighted.select("tokens", "weight"), budget)
        by_source = factors["source"].select(F.col("value").alias("_source"), F.col("factor").alias("_factor"))
        by_pair = materialise(weighted.groupBy(F.col("lang").alias("_lang"), F.col("topic").alias("_topic_value")).agg((F.max("f_lang") * F.max("f_topic")).alias("_pair_factor")), "pair-factors")
    else:
        by_source, by_pair, c = _raked(cells, small, targets, budget)
    by_source = by_source.select("_source", "_factor")
    if by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    marked = rows.select(F.struct(*[F.col(f"`{x}`") for x in rows.columns]).alias("_row"), *[v.alias(f"_of_{d}") for d, v in value.items()])
    marked = marked.join(by_source, F.col("_of_source") == F.col("_source"), "left").join(by_pair, (F.col("_of_lang") == F.col("_lang")) & (F.col("_of_topic") == F.col("_topic_value")), "left")
    weight = F.coalesce(F.col("_factor") * F.col("_pair_factor"), F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("_row.doc_id").cast("string"), F.col("_row.text")), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    marked = marked.withColumn("_w", weight).withColumn("_p", F.least(F.lit(1.0), F.col("_w") * c)).withColumn("_s", draw < F.col("_p"))
    release(cells)
    added = {"topic": F.coalesce(F.col(f"_row.{names['topic']}"), F.lit(MISSING)), "n_tokens": F.col(f"_row.{names['n_tokens']}"), "weight": F.col("_w"), "probability": F.col("_p"), "selected": F.col("_s")}
    return marked.select(*[F.col(f"_row.`{x}`").alias(x) for x in docs.columns], *[v.alias(names[a]) for a, v in added.items()]), names


def mix(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, seed: int = 17, topic_col: str | None = None, tokens_col: str | None = None
) -> DataFrame:
    """The columns of docs with topic, n_tokens, weight, probability and selected added; every row is kept.

    targets: shares by value for any of source, lang, topic; a dimension without them gets its own shares to the power
    TEMPER.  topic_col and tokens_col name columns that hold topics and token counts; without them topics are clusters
    and tokens words.  Null sources, languages and topics are the value "(none)".  Texts that are null or without words
    have no tokens; they get the weight and probability of their cell's factors.  Rows of one doc_id are drawn by the
    same number; a null doc_id is drawn by its text.  Columns of docs with an added one's name are replaced (after they
    are read).  An empty table gives no rows.  Targets that cannot be met give a warning.
    """
    found, names = mixed(docs, targets, budget, seed, topic_col, tokens_col)
    return found.select(*[f"`{c}`" for c in docs.columns if c not in ADDED], *[F.col(names[a]).alias(a) for a in ADDED])
