"""N-gram Jaccard join: which texts share at least 75 % of their distinct word five-grams.

1. Every text becomes a sorted array of 64-bit shingle hashes; texts with equal sets become one node.
2. Nodes meet only under a shared key.  With shingles in one global order, common ones last, two sets over the
   threshold share a shingle among the first n - ceil(t n) + 1 of the larger and the first n - ceil(2t n / (1 + t)) + 1
   of the smaller, so only those are posted.
3. Under a key, nodes are compared in size-banded tiles by hashed bitmaps: bits of one that the other lacks bound the
   overlap from above.  What the bound leaves is checked by exact intersection of the sorted arrays.
4. Nodes under a key that are already connected are not compared: star links to the hub of each key and size band are
   checked first; then nodes outside a key's largest component are compared with the key's nodes of other components
   in tiles of bounded size.
5. Rows of keys that stand out in the sketch are never brought together by key: they are counted, joined with their
   key's hub and dealt to tiles, all of which split over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import U64, column, ints, materialise, mix64, prepare, release, signed, tidied, worker_cache
from .components import connected

WORDS = 5
#: Sets that a task remembers having posted.
SEEN_SETS = 1 << 18
#: The threshold as a fraction: links need DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Groups under a key of up to this many nodes give their pairs at once.
SMALL_GROUP = 6
#: Nodes of one key on a side of a tile.
TILE = 512
#: Counters of the shingle frequency sketch, and those in one of its rows.
COUNTERS = 1 << 18
COUNTER_ROW = 4096
#: Partitions' sketches added up by one task, and times that this is done (enough for MERGED ** MERGES partitions).
MERGED = 512
MERGES = 2
#: Counters that stand out and hold more than this mark heavy keys, whose rows are never brought together in one task.
HEAVY = 4096
HEAVY_MARK = 128
#: Bits of the narrowest bitmap.
LEAST_WIDTH = 2048

_COEFFICIENTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], U64)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words: A-Z lower-cased, split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of fewer words, one of the whole sequence; of none, empty."""
    words = word_hashes(text) if text else np.zeros(0, U64)
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        mixed = np.zeros(1, U64) + U64(n)
        for word in words:
            mixed = mix64(mixed * _COEFFICIENTS[0] + word)
        return mixed
    total = np.zeros(n - WORDS + 1, U64)
    for i in range(WORDS):
        total += words[i : n - WORDS + 1 + i] * _COEFFICIENTS[i]
    return np.unique(mix64(total))


def set_id(found: np.ndarray) -> int:
    """A signed 64-bit name for a shingle set."""
    value = xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found))
    return value - (1 << 64) if value >> 63 else value


def probe_size(n):
    """Shingles a set posts: n - ceil(t n) + 1."""
    return n - -(-NUM * n // DEN) + 1


def index_size(n):
    """Shingles a set posts towards larger sets: n - ceil(2 t n / (1 + t)) + 1."""
    return n - -(-2 * NUM * n // (DEN + NUM)) + 1


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id and bits of every text; and the partitions' frequency sketches in rows with a chunk."""
    names = ["doc_id", "n_shingles", "set_id", "bits", "chunk", "counts"]

    def run(batches):
        worker_cache("ngram_join")
        sketch = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sizes, sets, maps = [], [], []
            for text in column(batch, "text"):
                found = shingles(text)
                sizes.append(len(found))
                sets.append(set_id(found))
                maps.append(bitmap(found) if len(found) else None)
                np.add.at(sketch, (found & U64(COUNTERS - 1)).astype(np.int64), 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column(batch, "doc_id"), pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
            )
        if sketch.any():
            rows = COUNTERS // COUNTER_ROW
            parts = [sketch[i * COUNTER_ROW : (i + 1) * COUNTER_ROW].astype(np.int64).tobytes() for i in range(rows)]
            none = pa.nulls(rows, pa.int64())
            # n_shingles of a sketch row is the partition that it comes from.
            origin = pa.array(np.full(rows, TaskContext.get().partitionId(), np.int64))
            yield pa.RecordBatch.from_arrays([none, origin, none, pa.nulls(rows, pa.binary()), pa.array(range(rows), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, n_shingles long, set_id long, bits binary, chunk int, counts binary")


def common_classes(scanned: DataFrame) -> np.ndarray:
    """Class of each sketch counter: 0, or more the further it stands out.  Common shingles are put last by it.

    Partitions' sketches are merged MERGED at a time, so no task adds up those of a whole large table.
    """

    def add(key, part):
        total = sum(np.frombuffer(b, np.int64) for b in part.column("counts").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "origin": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = scanned.where("chunk is not null").select("chunk", F.col("n_shingles").alias("origin"), "counts")
    for _ in range(MERGES):
        rows = rows.withColumn("origin", F.floor(F.col("origin") / MERGED)).groupBy("chunk", "origin").applyInArrow(add, "chunk int, origin long, counts binary")
    total = np.zeros(COUNTERS, np.int64)
    for row in rows.collect():
        total[row["chunk"] * COUNTER_ROW : (row["chunk"] + 1) * COUNTER_ROW] += np.frombuffer(row["counts"], np.int64)
    usual = 2 * np.median(total) + 16
    classes = np.where(total > usual, 1 + np.log2(np.maximum(total / usual, 1)), 0).astype(np.uint8)
    return np.where(total > max(usual, HEAVY), classes | HEAVY_MARK, classes)


def posted(docs: DataFrame, classes) -> DataFrame:
    """key, set_id, meta and route of every set's first shingles.

    meta is 4 * size + 2 * (the key is heavy) + (the key is also posted towards larger sets).  Rows are dealt by route:
    the key, or for a heavy key the key with the set.
    """

    def run(batches):
        held = classes.value
        seen: set[int] = set()
        for batch in batches:
            keys, names, metas = [], [], []
            for text in column(batch, "text"):
                found = shingles(text)
                n = len(found)
                if not n or (name := set_id(found)) in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(name)
                of = held[(found & U64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((found, of))[: probe_size(n)] if n > 1 else np.zeros(1, np.int64)
                meta = 4 * n + 2 * (of[order] >= HEAVY_MARK).astype(np.int64)
                meta[: index_size(n)] += 1
                keys.append(found[order])
                names.append(np.full(len(order), name, np.int64))
                metas.append(meta)
            if keys:
                key, name, meta = np.concatenate(keys), np.concatenate(names), np.concatenate(metas)
                route = np.where(meta & 2, mix64(key ^ mix64(name.view(U64))), key)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(name), pa.array(meta), pa.array(signed(route))], ["key", "set_id", "meta", "route"])

    return docs.select("text").mapInArrow(tidied(run), "key long, set_id long, meta long, route long")


def may_link(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Whether sizes allow the threshold at all."""
    return DEN * small >= NUM * large


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def whole_runs(batches, names: list[str]):
    """Batches of sorted rows regrouped so that no run of equal keys is cut.  Callers bound the runs."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [ints(batch, n) if not pa.types.is_binary(batch.schema.field(n).type) else np.array(column(batch, n), object) for n in names]
        held.append(new)
        size += len(new[0])
        last = int(np.searchsorted(new[0], new[0][-1], "left"))
        # Rows up to the last run are whole once it begins inside this batch.
        if last and size >= 20_000:
            whole = [np.concatenate(parts) for parts in zip(*held[:-1], [x[:last] for x in new], strict=True)]
            yield whole
            held = [[x[last:] for x in new]]
            size = len(held[0][0])
    if held:
        yield [np.concatenate(parts) for parts in zip(*held, strict=True)]


def candidate_rows(posts: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a key of a small group; and the rows (key, a, meta) of large groups and heavy keys.

    Heavy keys' rows come in anywhere and pass on as they are; a run of another key has HEAVY rows, or as many as an
    unremarkable key has.
    """

    def run(batches):
        for keys, names, metas in whole_runs(batches, ["key", "set_id", "meta"]):
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
            keys, names, metas = keys[fresh], names[fresh], metas[fresh]
            bounds = runs_of(keys)
            sizes = np.diff(bounds)
            run_of = np.repeat(np.arange(len(sizes)), sizes)
            n, indexed, heavy = metas >> 2, (metas & 1).astype(bool), (metas & 2).astype(bool)
            large = heavy | (sizes[run_of] > SMALL_GROUP)
            left, right = [], []
            # Pairs at distance 1 .. SMALL_GROUP - 1 inside small runs.
            for gap in range(1, SMALL_GROUP):
                i = np.flatnonzero((run_of[gap:] == run_of[:-gap]) & ~large[gap:]) if len(keys) > gap else np.zeros(0, np.int64)
                j = i + gap
                first_small = n[i] <= n[j]
                small, big = np.where(first_small, i, j), np.where(first_small, j, i)
                equal = n[i] == n[j]
                ok = may_link(n[small], n[big]) & (indexed[small] | (equal & indexed[big]))
                left.append(names[i[ok]])
                right.append(names[j[ok]])
            left, right = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0) if len(left) else np.zeros((0, 2), np.int64)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none], ["key", "a", "b", "meta"])
            big = np.flatnonzero(large)
            if len(big):
                yield pa.RecordBatch.from_arrays([pa.array(keys[big]), pa.array(names[big]), pa.nulls(len(big), pa.int64()), pa.array(metas[big] & ~2)], ["key", "a", "b", "meta"])

    return posts.repartition("route").sortWithinPartitions("key", "set_id").mapInArrow(tidied(run), "key long, a long, b long, meta long")


def banded(groups: DataFrame) -> DataFrame:
    """Add the size band: sets over the threshold are in the same band or in neighbouring ones."""
    return groups.withColumn("band", F.floor(F.log("n") / float(np.log(DEN / NUM))))


def told_apart(groups: DataFrame) -> DataFrame:
    """The groups (key, a, meta) without keys that hold the same nodes as another key, or one node only.

    A passage that documents share gives them many common keys; one of them finds the same pairs.  Keys are equal where
    their counts and two 64-bit sums of their rows' hashes are.
    """
    marks = groups.groupBy("key").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("a", "meta")).alias("x"), F.bit_xor(F.xxhash64("meta", "a")).alias("y"))
    kept = materialise(marks.where("rows > 1").groupBy("rows", "x", "y").agg(F.min("key").alias("key")).select("key"), "kept-keys")
    return groups.join(kept, "key", "left_semi")


def star_pairs(groups: DataFrame) -> DataFrame:
    """One pair (a, b) at most for each node of the groups (key, a, degree, n, band): with the hub of a key.

    The hub of a key and size band is its node with most rows in large groups.  Copies edited apart share less with
    each other than with what they were made from, which has no rare shingles of its own and so has most such rows.
    """
    # Written apart from the join, so that a large key's rows can be split over tasks there.
    hubs = materialise(groups.groupBy("key", "band").agg(F.max(F.struct("degree", "a")).alias("hub")), "hubs")
    met = groups.join(hubs, ["key", "band"]).where("a <> hub.a")
    best = met.groupBy("a").agg(F.max("hub").alias("hub")).select("a", F.col("hub.a").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bitmap(found: np.ndarray) -> bytes:
    """A hashed bitmap of two to four bits a shingle, its width a power of two from LEAST_WIDTH bits up."""
    width = max(LEAST_WIDTH, 1 << int(2 * len(found) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(found >> U64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to a narrower width."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def overlap_bound(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of sets with bitmaps a and b, row by row (broadcast)."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def enough(overlap: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """DEN * overlap >= NUM * union."""
    return (DEN + NUM) * overlap >= NUM * (n_a + n_b)


def set_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """set_id and items (sorted hashes) of the named nodes (set_id, doc_id of one text that has the set).

    A bounded Bloom filter of the doc ids spares other texts the hashing; the join on set_id makes it exact, also where
    documents of several texts share an id.
    """
    spark = docs.sparkSession
    id_hashes = lambda batch: mix64(ints(batch, "doc_id").astype(np.int64).view(U64))
    wanted = bloom.build(nodes.select("doc_id"), nodes.count(), id_hashes)
    sent = spark.sparkContext.broadcast((wanted.n_blocks, wanted.data.tobytes()))

    def run(batches):
        n_blocks, data = sent.value
        mine = bloom.BlockedBloom(n_blocks, data)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            passed = np.flatnonzero(mine.might_hold(id_hashes(batch))) if batch.num_rows else ()
            bodies = batch.column(1)
            rows: list[list] = [[], []]
            for i in passed:
                found = shingles(bodies[int(i)].as_py())
                rows[0].append(set_id(found))
                rows[1].append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], ["set_id", "items"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "set_id long, items binary").join(nodes.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def words_of(maps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(maps), U64).reshape(len(maps), -1)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets pass: first by the bitmaps' bound, then by exact intersection.

    nodes: set_id, doc_id, n, bits.  Shingles are hashed anew for the nodes that the bound leaves, and only for them.
    """

    def bound(batches):
        for batch in batches:
            a, b = column(batch, "bits_a"), column(batch, "bits_b")
            n_a, n_b = ints(batch, "n_a"), ints(batch, "n_b")
            keep = np.zeros(len(a), bool)
            shapes: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                shapes.setdefault((len(x), len(y)), []).append(i)
            for (x, y), at in shapes.items():
                words = min(x, y) // 8
                found = overlap_bound(fold(words_of([a[i] for i in at]), words), fold(words_of([b[i] for i in at]), words), n_a[at], n_b[at])
                keep[at] = enough(found, n_a[at], n_b[at])
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "items_a"), column(batch, "items_b"), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(bool(enough(np.count_nonzero(y[at] == x), len(x), len(y))))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    side = lambda df, s, *cols: df.select(F.col("set_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    near = pairs.select("a", "b").join(side(nodes, "a", "n", "bits"), "a").join(side(nodes, "b", "n", "bits"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(tidied(bound), "a long, b long")
    near = materialise(near, "near")
    named = near.select(F.col("a").alias("set_id")).union(near.select("b")).distinct()
    sets = materialise(set_table(docs, materialise(nodes.select("set_id", "doc_id").join(named, "set_id"), "named")), "sets")
    full = near.join(side(sets, "b", "items"), "b").join(side(sets, "a", "items"), "a").select("a", "b", "items_a", "items_b")
    return full.mapInArrow(tidied(exact), "a long, b long")


def tile_plan(groups: DataFrame) -> DataFrame:
    """key, main (its largest component), and, for each of its size bands, the nodes and those of other components.

    groups: key, band, component of each node.  A key's nodes that lie outside its largest component are compared with
    all of the key's nodes in the same or a neighbouring band; those inside it need no comparison.
    """
    counts = materialise(groups.groupBy("key", "component", "band").agg(F.count("*").alias("rows")), "tile-counts")
    whole = counts.groupBy("key", "component").agg(F.sum("rows").alias("rows")).groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.sum("rows").alias("total"), F.count("*").alias("parts"))
    # Written apart from the join, so that a large key's rows can be split over tasks there.
    counts = counts.join(materialise(whole.where("parts > 1").drop("parts"), "open-keys"), "key")
    return counts.groupBy("key", "band", "main", "total").agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("component") != F.col("main"), F.col("rows")).otherwise(0)).alias("others"))


def tiled(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """tile, side (0: left, 1: right, 2: both), a, component and meta: every node in the tiles that it belongs to."""
    chunk = lambda many: F.pmod(F.xxhash64("a"), F.col(many))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
    side = lambda n: F.lit(n).cast("long").alias("side")
    # A key that fits one tile is one.
    small = materialise(plan.where(F.col("total") <= TILE).select("key").distinct(), "small-keys")
    whole = groups.join(small, "key").select(F.xxhash64("key").alias("tile"), side(2), "a", "component", "meta")

    large = plan.where(F.col("total") > TILE)
    left = large.where("others > 0").select("key", "main", F.col("band").alias("left_band"), F.ceil(F.col("others") / TILE).alias("left_chunks"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("right_band"))
    tiles = materialise(left.join(large.select("key", F.col("band").alias("right_band"), F.ceil(F.col("rows") / TILE).alias("right_chunks")), ["key", "right_band"]), "large-tiles")
    name = F.xxhash64("key", "left_band", "right_band", "left", "right").alias("tile")
    lefts = groups.withColumnRenamed("band", "left_band").join(tiles, ["key", "left_band"]).where("component <> main")
    lefts = lefts.withColumn("left", chunk("left_chunks")).withColumn("right", every("right_chunks")).select(name, side(0), "a", "component", "meta")
    rights = groups.withColumnRenamed("band", "right_band").join(tiles, ["key", "right_band"])
    rights = rights.withColumn("right", chunk("right_chunks")).withColumn("left", every("left_chunks")).select(name, side(1), "a", "component", "meta")
    return whole.unionByName(lefts).unionByName(rights)


def tile_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components in a tile that the bitmaps' bound passes.

    rows: tile, side, a, component, meta, bits.  A tile holds about TILE nodes a side.
    """

    def run(batches):
        for keys, names, parts, metas, sides, maps in whole_runs(batches, ["tile", "a", "component", "meta", "side", "bits"]):
            for lo, hi in zip(runs_of(keys)[:-1], runs_of(keys)[1:], strict=True):
                pairs = within(names[lo:hi], parts[lo:hi], metas[lo:hi], sides[lo:hi], maps[lo:hi])
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return rows.repartition("tile").sortWithinPartitions("tile", "a").mapInArrow(tidied(run), "a long, b long")


def within(names, parts, metas, sides, maps) -> np.ndarray:
    """Pairs (smaller name first) of a tile's left and right nodes, by equal bitmap widths and in order of size."""
    found = [np.zeros((0, 2), np.int64)]
    if (parts == parts[0]).all():
        return found[0]
    n, indexed = metas >> 2, (metas & 1).astype(bool)
    widths = np.fromiter((len(m) // 8 for m in maps), np.int64, len(maps))
    ends = {}
    for side in (0, 1):
        at = np.flatnonzero((sides == side) | (sides == 2))
        at = at[np.argsort(n[at], kind="stable")]
        ends[side] = {int(w): at[widths[at] == w] for w in np.unique(widths[at])}
    for w, left in ends[0].items():
        for v, right in ends[1].items():
            if v not in (w // 2, w, 2 * w):
                continue
            low = min(v, w)
            mine, theirs = fold(words_of(list(maps[left])), low), fold(words_of(list(maps[right])), low)
            for k, i in enumerate(left.tolist()):
                lo = int(np.searchsorted(n[right], -(-NUM * n[i] // DEN), "left"))
                hi = int(np.searchsorted(n[right], DEN * n[i] // NUM, "right"))
                j = right[lo:hi]
                first = (n[i] < n[j]) | ((n[i] == n[j]) & indexed[i])
                once = (sides[i] != 2) | (names[i] < names[j])
                rows = np.flatnonzero((parts[j] != parts[i]) & once & np.where(first, indexed[i], indexed[j]))
                if len(rows):
                    most = overlap_bound(mine[k][None], theirs[lo:hi][rows], n[i], n[j[rows]])
                    good = j[rows][enough(most, n[i], n[j[rows]])]
                    if len(good):
                        x, y = np.full(len(good), names[i]), names[good]
                        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
    return np.unique(np.concatenate(found), axis=0)


def shared_ids(known: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of documents that share a doc_id: such documents are one node of the join."""
    ids = known.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a < b")
    ids = materialise(ids.select("doc_id", "a"), "shared-ids")
    return known.select("doc_id", F.col("set_id").alias("b")).join(ids, "doc_id").where("a <> b").select("a", "b").distinct()


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Two documents link when 100 * intersection >= 75 * union of their shingle sets; component_id is the smallest
    doc_id reachable by links, the document's own included.  A null text, or one without words, has an empty set and
    links with nothing.  Equal sets are one node.  Rows with a null doc_id are kept, and link with nothing; repeated
    rows are kept each; rows that share a doc_id have their own sets, and a path through one of them goes on from the
    others (a row with an empty set stays apart).  An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialise(scan(docs), "scan")
    documents = scanned.where("chunk is null").select("doc_id", "n_shingles", "set_id", "bits")
    known = documents.where("doc_id is not null and n_shingles > 0")
    classes = spark.sparkContext.broadcast(common_classes(scanned))

    rows = materialise(candidate_rows(posted(docs.where("doc_id is not null"), classes)), "keys")
    tried = materialise(rows.where("key is null").select("a", "b").distinct(), "pairs")
    groups = materialise(rows.where("key is not null").select("key", "a", "meta").distinct(), "large-groups")
    groups = banded(told_apart(groups).withColumn("n", F.shiftright("meta", 2)))
    degrees = groups.groupBy("a").agg(F.count("*").alias("degree"))

    nodes = known.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    named = tried.select(F.col("a").alias("set_id")).union(tried.select("b")).union(degrees.select("a")).distinct()
    mapped = known.select("set_id", F.col("n_shingles").alias("n"), "bits").join(named, "set_id", "left_semi").dropDuplicates(["set_id"])
    near_nodes = materialise(nodes.join(mapped, "set_id").select("set_id", "doc_id", "n", "bits"), "nodes")

    # Small groups' pairs and the stars.
    groups = materialise(groups.join(materialise(degrees, "degrees"), "a"), "groups")
    new = materialise(star_pairs(groups).join(tried, ["a", "b"], "left_anti").unionByName(tried), "stars")
    release(tried)
    links, tried = materialise(verified(new, near_nodes, docs).unionByName(shared_ids(known)), "links"), new
    joined = connected(links)
    # What these left unconnected under a key: tiles of those outside its largest component.
    labelled = groups.drop("degree").join(joined.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    labelled = materialise(labelled, "labelled")
    release(groups)
    plan = materialise(tile_plan(labelled), "tile-plan")
    rows = tiled(labelled, plan).join(near_nodes.select(F.col("set_id").alias("a"), "bits"), "a")
    more = materialise(tile_pairs(rows).distinct().join(tried, ["a", "b"], "left_anti"), "tile-pairs")
    release(labelled, plan)
    if not more.isEmpty():
        links = materialise(links.unionByName(verified(more, near_nodes, docs)), "links-all")
        joined = connected(links)

    placed = materialise(nodes.join(joined.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "placed")
    least = materialise(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    placed = materialise(placed.join(least, "component").select("set_id", "component_id"), "components")
    release(near_nodes, links, tried, more, least)
    keyed = documents.withColumn("join_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_id")))
    return keyed.join(placed.withColumnRenamed("set_id", "join_id"), "join_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
