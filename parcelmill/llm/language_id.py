"""Language identification by rank-order profiles.

Each language's profile ranks its most frequent character n-grams (one to four, over letters, with a mark at word
edges).  A document's own most frequent n-grams are ranked the same way, and the language with the least out-of-place
distance wins.  An n-gram is four code points of 16 bits in one integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, column, prepare, signed

ORDERS = 4
#: N-grams ranked in a profile.
RANKS = 400
#: At most about this many training documents of each language are counted: a hash of the id and text picks them.
SAMPLE_DOCS = 3000
UNKNOWN = "und"
#: The mark at word edges; letters beyond 16 bits fold into the private use area, which holds no letters.
EDGE = 1
PRIVATE, PRIVATE_SIZE = 0xE000, 6400
#: Distinct n-grams that a task holds before it sends their counts.
HELD_GRAMS = 1 << 20

_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """A text's distinct n-grams, in order, and their counts; or None where it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(codes < 1 << 16, codes, PRIVATE + codes % PRIVATE_SIZE)
    codes = np.where(is_letter, codes, EDGE)
    # One mark between words, and one at either end.
    codes = np.concatenate([[EDGE], codes, [EDGE]]).astype(U64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != EDGE) | (codes[:-1] != EDGE)
    codes = codes[keep]
    edge = codes == EDGE
    packed, found = codes, [codes[~edge]]
    over = np.zeros(len(codes), bool)
    for n in range(2, ORDERS + 1):
        packed = packed[:-1] << U64(16) | codes[n - 1 :]
        # No n-gram reaches over the mark between two words.
        over = over[:-1] | edge[n - 2 : len(codes) - 1] if n > 2 else over[:-1]
        found.append(packed[~over])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties to the smaller."""
    if len(keys) > ranks:
        most = counts >= np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        keys, counts = keys[most], counts[most]
    return keys[np.argsort(-counts, kind="stable")][:ranks]


def learn(train: DataFrame, sample_docs: int = SAMPLE_DOCS, ranks: int = RANKS) -> dict[str, np.ndarray]:
    """Profiles by language: RANKS n-grams each, from a bounded sample of the labelled documents of each language."""
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = [(lang, min(1.0, sample_docs / n)) for lang, n in sizes.items()]
    if not shares:
        return {}
    share = F.create_map(*[F.lit(x) for pair in shares for x in pair])[F.col("lang")]
    sample = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def count(batches):
        totals: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def emit():
            for lang, parts in totals.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
                for at in range(0, len(keys), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part]), pa.string()), pa.array(signed(keys[part])), pa.array(sums[part])], ["lang", "gram", "n"])
            totals.clear()

        for batch in batches:
            for lang, text in zip(column(batch, "lang"), column(batch, "text"), strict=True):
                found = grams(text) if text else None
                if found is not None:
                    totals.setdefault(lang, []).append(found)
                    held += len(found[0])
                    if held > HELD_GRAMS:
                        yield from emit()
                        held = 0
        yield from emit()

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Packed n-grams are unsigned: those with the top bit set sort last.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram"))
    rows = counts.withColumn("rank", place).where(F.col("rank") <= ranks).select("lang", "rank", "gram").collect()
    found: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(top, np.int64).view(U64) for lang, top in found.items()}


def rank_table(profiles: dict[str, np.ndarray], ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """All profiles' n-grams in order, and the rank of each in every profile; absent ones get the most, as does the row
    after the last for n-grams of no profile."""
    known = np.unique(np.concatenate(list(profiles.values()))) if profiles else np.zeros(0, U64)
    ranks_of = np.full((len(known) + 1, len(profiles)), ranks, np.int32)
    for i, top in enumerate(profiles.values()):
        ranks_of[np.searchsorted(known, top), i] = np.arange(len(top))
    return known, ranks_of


def predict(text: str | None, names: list[str], table: tuple[np.ndarray, np.ndarray], ranks: int) -> tuple[str, float]:
    """Language and score: the margin of the nearest profile over the next, from 0 (none) to 1."""
    found = grams(text) if text and names else None
    if found is None:
        return UNKNOWN, 0.0
    own, (known, ranks_of) = ranked(*found, ranks), table
    at = np.searchsorted(known, own)
    at[known[np.minimum(at, len(known) - 1)] != own] = len(known)
    distance = np.abs(ranks_of[at] - np.arange(len(own), dtype=np.int32)[:, None]).sum(0)
    order = np.argsort(distance, kind="stable")
    best = float(distance[order[0]])
    following = float(distance[order[1]]) if len(order) > 1 else float(ranks * len(own))
    return names[order[0]], max(0.0, min(1.0, 1.0 - best / following)) if following else 0.0


def identify(docs: DataFrame, train: DataFrame, ranks: int = RANKS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, lang_pred and score of every document.

    A text that is null or has no letter is ``und`` with score 0, as is every text where no language was learned.
    Equal distances go to the language that sorts first.  Rows are judged one by one: repeats are kept, and an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    profiles = learn(train.where("lang is not null and text is not null"), sample_docs, ranks)
    sent = spark.sparkContext.broadcast(profiles)

    def judge(batches):
        names, known = list(sent.value), rank_table(sent.value, ranks)
        for batch in batches:
            found = [predict(t, names, known, ranks) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column(batch, "doc_id"), pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")
