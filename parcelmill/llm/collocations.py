"""Phrase collocation mining over dictionary-encoded texts.

1. Texts become chunks of word codes, each with a dictionary page of its own (as in a columnar file), so texts are read
   once.  Word counts are summed over the pages; words that occur often enough get ids, 1 and up, and all others, and
   the ends of pieces, break what follows.
2. Each place's window of up to five ids is one key of five 32-bit ids, absent ones zero: counts of all its prefixes
   follow from the sorted keys.  Equal keys of a chunk are merged at once.
3. Keys are dealt by range.  A word owns a stretch of a line as long as its count, and inside it the next two words
   split the stretch by their own shares, so a key's place on the line rises with the key, and a stretch of fixed
   length is a range.  No sample of keys is needed, and a frequent first word or pair is spread over many ranges.
4. Each range is sorted by radix passes over 16-bit digits and its runs are counted for every prefix length.  All
   windows that share three ids lie in one range; a pair of words can lie in neighbouring ones, so the first and last
   pair of each range are passed on whatever their counts, and added up.
5. Scores need the counts of a phrase's parts, which are candidates or words themselves: a join of small tables.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, materialise, prepare, release, texts, tidied

#: Words of the longest phrase.
LONGEST = 5
#: Words of a chunk, which is of one language, words of all chunks that a task has open, and places of a range before
#: equal keys are merged.
CHUNK_WORDS = 2_000_000
OPEN_WORDS = 6_000_000
RANGE_PLACES = 500_000
#: The dictionary is numbered in so many parts.
DICTIONARY_PARTS = 64
#: A dictionary of at most so many words, none longer than this, is sent to the tasks; a larger one is joined.
SENT_WORDS = 300_000
SENT_CHARS = 200
#: Fixed by the contract: marks and line ends that end a piece.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"

_TO_LINE_END = bytes.maketrans(BREAKS, b"\n" * len(BREAKS))


def words_and_breaks(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8, with b"." at the end of each piece: a word never holds that byte."""
    return text.encode().lower().translate(_TO_LINE_END).replace(b"\n", b" . ").split()


class Codes(dict):
    """Codes by word, in order of first sight."""

    def __missing__(self, word):
        self[word] = found = len(self)
        return found


def planes(values: np.ndarray) -> bytes:
    """32-bit values (any shape) byte plane by byte plane, packed: codes and ids are small where words are frequent, so
    the upper planes are mostly zeros."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def encode_chunks(docs: DataFrame) -> DataFrame:
    """chunk, lang, words, counts, codes: the codes (planes) refer to the words from 1, 0 is the end of a piece."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        open_: dict[str, tuple[Codes, list[np.ndarray]]] = {}
        size: Counter[str] = Counter()

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number
            codes, parts = open_.pop(lang)
            del size[lang]
            found = np.concatenate(parts)
            words = list(codes)[1:]
            counts = np.bincount(found, minlength=len(words) + 1)[1:]
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), pa.array([lang], pa.string()), pa.array([[w.decode() for w in words]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([planes(found)], pa.binary())],
                ["chunk", "lang", "words", "counts", "codes"],
            )

        for batch in batches:
            for lang, text in zip(column(batch, "_lang"), texts(batch, "_text"), strict=True):
                if lang not in open_:
                    open_[lang] = Codes({b".": 0}), []
                codes, parts = open_[lang]
                found = words_and_breaks(text)
                found.append(b".")
                parts.append(np.fromiter(map(codes.__getitem__, found), np.uint32, len(found)))
                size[lang] += len(found)
                if size[lang] >= CHUNK_WORDS:
                    yield closed(lang)
                elif size.total() >= OPEN_WORDS:
                    yield closed(size.most_common(1)[0][0])
        for lang in list(open_):
            yield closed(lang)

    return docs.mapInArrow(tidied(run), "chunk long, lang string, words array<string>, counts array<long>, codes binary")


def numbered(words: DataFrame) -> DataFrame:
    """lang, word, f with id (from 1, without gaps, frequent words first) and place (the sum of f over smaller ids).

    Numbers are given inside ranges of the table, and each range starts where the totals of those before it end.
    """
    ranged = words.repartitionByRange(DICTIONARY_PARTS, F.desc("f"), "word", "lang").withColumn("part", F.spark_partition_id())
    parted = materialise(ranged, "collocation-words")
    inside = Window.partitionBy("part").orderBy(F.desc("f"), "word", "lang").rowsBetween(Window.unboundedPreceding, 0)
    own = parted.withColumn("i", F.count("*").over(inside)).withColumn("p", F.sum("f").over(inside) - F.col("f"))
    totals = {r["part"]: (r["n"], r["f"]) for r in parted.groupBy("part").agg(F.count("*").alias("n"), F.sum("f").alias("f")).collect()}
    starts, ids, places = [], 0, 0
    for part in sorted(totals):
        starts.append((part, ids, places))
        ids, places = ids + totals[part][0], places + totals[part][1]
    if ids >= 1 << 32:
        raise ValueError("more than 2^32 frequent words: raise the least count")
    starts = words.sparkSession.createDataFrame(starts, "part int, ids long, places long")
    return own.join(F.broadcast(starts), "part").select("lang", "word", "f", (F.col("ids") + F.col("i")).alias("id"), (F.col("places") + F.col("p")).alias("place"))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys, rows of 32-bit ids: stable passes over 16-bit digits, the last digit first (numpy sorts those
    by radix).  Digits that are all equal are passed over."""
    order = np.arange(len(keys))
    for at in range(keys.shape[1] - 1, -1, -1):
        for shift in (0, 16):
            digit = (keys[:, at] >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def merged(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, with their summed counts (one a row if None)."""
    order = radix_order(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    summed = np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts
    return keys[at], summed


def windows(ids: np.ndarray, longest: int) -> np.ndarray:
    """A row for each place from which two words or more go on without a break: ids, cut by zeros at the break."""
    size = len(ids)
    out = np.zeros((size, longest), np.uint32)
    out[:, 0] = ids
    alive = ids != 0
    for n in range(1, longest):
        out[: size - n, n] = np.where(alive[: size - n], ids[n:], 0) if n < size else 0
        alive = out[:, n] != 0
    return out[out[:, 1] != 0]


def range_keys(chunks: DataFrame, total: int, longest: int, sent=None) -> DataFrame:
    """bucket, keys, counts: the merged windows of each chunk, a row for each range they lie in.

    What a chunk's words are numbered comes with the chunk (codes, pages), or from the whole dictionary as sent to the
    tasks (lang, words, codes).
    """

    def pages(batch):
        """codes, and for each word that counts its code, id, count and place."""
        if sent is None:
            for codes, words in zip(column(batch, "codes"), column(batch, "pages"), strict=True):
                yield codes, *[np.array([w[k] for w in words], np.int64) for k in ("code", "id", "f", "place")]
            return
        rows, numbers = sent.value
        for lang, words, codes in zip(column(batch, "lang"), column(batch, "words"), column(batch, "codes"), strict=True):
            known = rows.get(lang, {})
            at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
            code = np.flatnonzero(at >= 0)
            yield codes, code + 1, *numbers[at[code]].T

    def run(batches):
        for batch in batches:
            for codes, code, own, f, place in pages(batch):
                if not len(code):
                    continue
                found = from_planes(codes)
                lut = np.zeros(int(found.max(initial=0)) + 1, np.uint32)
                lut[code] = own
                keys, counts = merged(windows(lut[found], longest), None)
                if not len(keys):
                    continue
                order = np.argsort(own)
                own, f, place = own[order], f[order].astype(np.float64), place[order].astype(np.float64)
                # The place on the line: the second and third word split the stretches before them.
                at = np.searchsorted(own, keys[:, 0])
                where, width = place[at], f[at]
                for n in range(1, min(3, longest)):
                    at = np.minimum(np.searchsorted(own, keys[:, n]), len(own) - 1)
                    absent = keys[:, n] == 0
                    where = where + np.where(absent, 0, width * (place[at] / total))
                    width = np.where(absent, 0, width * (f[at] / total))
                bucket = (where / RANGE_PLACES).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cuts[1:], len(bucket))
                for a in range(0, len(cuts), 64):
                    group = list(zip(cuts[a : a + 64], ends[a : a + 64], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[cuts[a : a + 64]]), pa.array([planes(keys[x:y].T) for x, y in group], pa.binary()), pa.array([planes(counts[x:y]) for x, y in group], pa.binary())],
                        ["bucket", "keys", "counts"],
                    )

    return chunks.select(*(["codes", "pages"] if sent is None else ["lang", "words", "codes"])).mapInArrow(tidied(run), "bucket long, keys binary, counts binary")


def as_sent(words: DataFrame):
    """The dictionary for broadcasting: rows by language and word, and (id, count, place) by row."""
    rows: dict[str, dict[str, int]] = {}
    numbers = []
    for r in words.select("lang", "word", "id", "f", "place").collect():
        rows.setdefault(r["lang"], {})[r["word"]] = len(numbers)
        numbers.append((r["id"], r["f"], r["place"]))
    return words.sparkSession.sparkContext.broadcast((rows, np.array(numbers, np.int64).reshape(-1, 3)))


def prefix_counts(ranges: DataFrame, least: int, longest: int) -> DataFrame:
    """gram, a: for each range the prefixes of at least two ids and at least that count, and the pairs at its ends."""

    def counted(keys: np.ndarray, counts: np.ndarray):
        keys, counts = merged(keys, counts)
        grams, sums = [], []
        new = np.ones(len(keys), bool)
        differs = keys[1:] != keys[:-1]
        new[1:] = differs[:, 0]
        for n in range(2, longest + 1):
            new[1:] |= differs[:, n - 1]
            at = np.flatnonzero(new)
            found = np.add.reduceat(counts, at)
            wanted = (found >= least) & (keys[at, n - 1] != 0)
            if n == 2:
                # Two at either end, as places on the line are rounded.
                wanted[:2] = wanted[-2:] = True
            grams += keys[at[wanted], :n].tolist()
            sums += found[wanted].tolist()
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.list_(pa.int64())), pa.array(sums, pa.int64())], ["gram", "a"])

    def run(batches):
        now, held, rows = None, [], 0

        def closed():
            return np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])

        for batch in batches:
            for bucket, keys, counts in zip(column(batch, "bucket"), column(batch, "keys"), column(batch, "counts"), strict=True):
                if bucket != now and held:
                    yield counted(*closed())
                    held, rows = [], 0
                now = bucket
                held.append((np.ascontiguousarray(from_planes(keys).reshape(longest, -1).T), from_planes(counts).astype(np.int64)))
                rows += len(held[-1][1])
                if rows > 4 * RANGE_PLACES and rows > 2 * len(held[0][1]):
                    # Equal keys of many chunks are merged as they come, so a range holds its distinct keys alone.
                    held = [merged(*closed())]
                    rows = len(held[0][1])
        if held:
            yield counted(*closed())

    dealt = ranges.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidied(run), "gram array<long>, a long").groupBy("gram").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, top: int | None = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to `longest` words that occur `least` times
    or more, by the lowest score floor(1000 a n / (l r)) over their cuts in two parts, highest first.

    A phrase inside a longer one of the same count is left out.  A null text is empty and has no words; a null language
    is `und`; repeated rows count each time; equal scores are ordered by count and then by the phrase's bytes; an empty
    table gives no rows.  Without `top` all phrases are ranked.
    """
    prepare(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("_lang"), F.col(f"`{text}`").alias("_text"))
    chunks = materialise(encode_chunks(plain), "collocation-chunks")
    pages = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("chunk", "lang", (F.col("code") + 1).alias("code"), F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    counted = pages.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counted = materialise(counted, "collocation-counts")
    sums = materialise(counted.groupBy("lang").agg(F.sum("f").alias("n"), F.sum(F.when(F.col("f") >= least, F.col("f"))).alias("often")), "collocation-sums")
    total = sums.agg(F.sum("often")).first()[0] or 1
    words = materialise(numbered(counted.where(F.col("f") >= least).select("lang", "word", "f")), "collocation-dictionary")
    if words.where(F.length("word") <= SENT_CHARS).limit(SENT_WORDS + 1).count() <= SENT_WORDS and words.where(F.length("word") > SENT_CHARS).isEmpty():
        ranges = range_keys(chunks, total, longest, as_sent(words))
    else:
        # Each chunk gets a page of its own words' ids, so no dictionary is held whole.
        coded = pages.select("chunk", "lang", "code", "word").join(words, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("code", "id", "f", "place")).alias("pages"))
        ranges = range_keys(chunks.select("chunk", "codes").join(coded, "chunk"), total, longest)
    grams = materialise(prefix_counts(ranges, least, longest), "collocation-grams")
    scored = _scored(grams, words, sums)
    release(chunks, counted, grams)
    return _ranked(scored, words, top)


def _scored(grams: DataFrame, words: DataFrame, sums: DataFrame) -> DataFrame:
    """gram, lang, a, l, r, n, score of the phrases that no longer one of their count holds."""
    counts = grams.select("gram", F.col("a").alias("f")).unionByName(words.select(F.array("id").alias("gram"), "f"))
    m = F.size("gram")
    cuts = grams.select("gram", "a", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    parts = cuts.select("gram", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.slice("gram", 1, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k")).alias("part")))).alias("p"))
    parts = parts.select("gram", "a", "k", "p.side", "p.part")
    met = materialise(parts.join(counts.withColumnRenamed("gram", "part"), "part"), "collocation-parts")
    # A longer phrase of the same count is reached by single words at either end, all of them candidates.
    held = met.where((F.col("f") == F.col("a")) & (F.size("part") == F.size("gram") - 1) & (F.size("part") > 1)).select(F.col("part").alias("gram")).distinct()
    cut = met.groupBy("gram", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    langs = words.select(F.col("id").alias("first"), "lang").join(F.broadcast(sums.select("lang", "n")), "lang")
    cut = cut.join(held, "gram", "left_anti").withColumn("first", F.col("gram")[0]).join(langs, "first")
    # Products pass 64 bits and stay below 38 digits; the quotient is at most 1000 n.
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    lowest = F.min(F.struct("score", "k", "l", "r"))
    best = cut.withColumn("score", score.cast("long")).groupBy("gram", "a", "lang", "n").agg(lowest.alias("best"))
    found = best.select("gram", "lang", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    found = materialise(found, "collocation-scores")
    release(met)
    return found


def _ranked(scored: DataFrame, words: DataFrame, top: int | None) -> DataFrame:
    """Phrases in words, ranked; those that cannot be among the first are left before they are spelt out."""
    if top is not None:
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        scored = scored.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place")
    spelt = scored.select("*", F.posexplode("gram").alias("at", "id")).join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    spelt = spelt.groupBy("lang", "gram", "a", "l", "r", "n", "score").agg(phrase.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
