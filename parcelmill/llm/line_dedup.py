"""Line dedup by a segment-partition edit join.

Equal lines are one class by their hash.  Different lines are linked when they are at most as many edits apart as the
length of the shorter allows (EDIT_BANDS).  Every line is cut into threshold-plus-one segments: a line within that many
edits holds one of them unchanged, at a start that the two lengths and the segment's number bound.  Segments of the
shorter line and the matching substrings of the longer one meet under one key that holds the indexed length; pairs are
verified by a banded bit-parallel edit distance.  Of every class of linked lines the first in document order stays,
and the others are cut out.

A key that many lines share is not paired, nor are its lines brought together.

* For one edit its lines meet anew under keys that hold all but an eighth of them, and where those are crowded too, by
  their deletion neighbourhoods: lines one edit apart agree when the edited character is left out, so all partners of a
  line meet it under an exact key and a star links them.
* For more edits each line is first held against a hub of its key, and then those outside the key's largest component
  against the key's other lines, in tiles of bounded size whose character counts bound the distance from below.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import U64, column, ints, materialise, mix64, prepare, release, signed, tidied, unused, worker_cache
from .components import connected
from .ngram_join import runs_of, star_pairs, tile_plan, tiled, told_apart, whole_runs

#: (least length, edits): lines of that length and more may be that many edits from a longer one, or from one as long.
EDIT_BANDS = ((40, 1), (200, 2))
#: Lines of fewer characters than this are left alone (blank ones always are).  Those below the first band's length take
#: part by exact repeats alone.
LEAST_CHARS = 1
#: Lines under one key that are paired at once.
SMALL_GROUP = 8
#: Segments of lines under larger keys.
REFINED = 8
#: Lengths in a size band; neighbouring bands hold all lengths that any band of edits allows.
BAND_CHARS = 64

#: Characters hashed at a time, rows that a task reduces before it sends them, and lines it remembers having posted.
GROUP_CHARS = 1 << 20
POSTED_ROWS = 1 << 18
SEEN_LINES = 1 << 18
BASE = 0x9E3779B97F4A7C15
#: Bits of a row's info, below its line's length: edits of the key, and what the row is.
INFO = 256
INDEXED, CROWD, MARK = 1, 2, 4
EDITS_AT = 8
#: Characters of a line's positions held in one integer.
BLOCK = 1024


def line_key(line: str) -> int:
    value = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def edits_of(lengths: np.ndarray, bands) -> np.ndarray:
    """Edits allowed at each length; -1 where a line takes part by exact repeats alone."""
    found = np.full(np.shape(lengths), -1, np.int64)
    for least, edits in bands:
        found[lengths >= least] = edits
    return found


def segment(length: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of edits + 1 segments of almost equal size, the longer ones last."""
    size, longer = length // (edits + 1), length % (edits + 1)
    over = np.maximum(i - (edits + 1 - longer), 0)
    return size * i + over, size + (i >= edits + 1 - longer)


def probe_shifts(edits: int, longer: int, i: int) -> range:
    """How far segment i of an indexed line can have moved, unchanged, in a line that is `longer` characters longer.

    At most i edits lie before it and at most edits - i after it; if more lay on either side, an earlier or a later
    segment would be unchanged as well, and the pair would meet under that one.
    """
    return range(max(-i, longer - (edits - i)), min(i, longer + (edits - i)) + 1)


def common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: bit-parallel steps over a band of 2 * most + 1 diagonals.

    Bit k of row[e] says that, with e edits, the prefix of a read so far can be matched to a prefix of b that is
    k - most longer.  Positions of b's characters are held in blocks, so a step costs the same in lines of any length.
    """
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    start = common_prefix(a, b)
    a, b = a[start:], b[start:]
    end = common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    width = 2 * most + 1
    full = (1 << width) - 1
    # Character i of b is bit i + most over all blocks.
    ends: list[dict[str, int]] = [{} for _ in range((len(b) + most) // BLOCK + 2)]
    for i, c in enumerate(b):
        block, bit = divmod(i + most, BLOCK)
        held = ends[block]
        held[c] = held.get(c, 0) | 1 << bit
    rows = [sum(1 << k for k in range(most, min(most + e, most + len(b)) + 1)) for e in range(most + 1)]
    for i, c in enumerate(a):
        # Diagonal k after reading a[: i + 1] ends at b position i + 1 + k - most, from 0 to len(b).
        block, bit = divmod(i, BLOCK)
        same = ends[block].get(c, 0) >> bit if block < len(ends) else 0
        if bit + width > BLOCK and block + 1 < len(ends):
            same |= ends[block + 1].get(c, 0) << (BLOCK - bit)
        low, high = max(0, most - i - 1), len(b) - i - 1 + most
        inside = (full >> max(0, width - 1 - high) if high >= 0 else 0) & ~((1 << low) - 1)
        new: list[int] = []
        for e, row in enumerate(rows):
            reach = row & same & full
            if e:
                old = rows[e - 1]
                reach |= old | (old >> 1) | ((new[e - 1] << 1) & full)
            new.append(reach & inside)
        rows = new
        if not rows[most]:
            return False
    return bool(rows[most] >> (len(b) - len(a) + most) & 1)


class SubstringHashes:
    """Polynomial hashes of substrings of lines laid end to end."""

    _powers = np.ones(1, U64)
    _inverses = np.ones(1, U64)

    def __init__(self, lines: list[str]):
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        self.lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.lengths) - self.lengths
        n = len(codes) + 1
        if n > len(SubstringHashes._powers):
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("_powers", BASE), ("_inverses", inverse)):
                row = np.full(n, base, U64)
                row[0] = 1
                setattr(SubstringHashes, name, np.multiply.accumulate(row))
        self.sums = np.zeros(n, U64)
        np.cumsum((codes + U64(1)) * SubstringHashes._powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray, lines: np.ndarray | None = None) -> np.ndarray:
        """Hash of the substring at start (within each line, or each of the lines given) of each size."""
        at = (self.starts if lines is None else self.starts[lines]) + start
        return mix64((self.sums[at + size] - self.sums[at]) * SubstringHashes._inverses[at] + size.astype(U64))


def eligible(text: str | None, least: int) -> list[tuple[int, str]]:
    """(number, line) of the lines that take part: those of at least `least` characters that hold more than blanks."""
    return [(i, line) for i, line in enumerate(text.split("\n")) if len(line) >= least and not line.isspace()] if text else []


def line_groups(batches, least: int):
    """Distinct lines that take part, in groups of about GROUP_CHARS characters.  A task remembers SEEN_LINES lines, so a
    common one comes once or a few times."""
    seen: set[int] = set()
    for batch in batches:
        group, size = [], 0
        for line in {line for text in column(batch, "text") for _, line in eligible(text, least)}:
            name = line_key(line)
            if name in seen:
                continue
            if len(seen) >= SEEN_LINES:
                seen.clear()
            seen.add(name)
            group.append((name, line))
            size += len(line)
            if size >= GROUP_CHARS:
                yield group
                group, size = [], 0
        if group:
            yield group


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """line, doc_id, row (a hash of the text) and line_no of every line that takes part."""

    def run(batches):
        for batch in batches:
            rows: list[list[int]] = [[], [], [], []]
            for doc_id, row, text in zip(column(batch, "doc_id"), column(batch, "row"), column(batch, "text"), strict=True):
                for number, line in eligible(text, least):
                    for values, value in zip(rows, (line_key(line), doc_id, row, number), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["line", "doc_id", "row", "line_no"])

    return docs.select("doc_id", "row", "text").mapInArrow(tidied(run), "line long, doc_id long, row long, line_no long")


def posts(docs: DataFrame, bands) -> DataFrame:
    """key, line, info and route: segments of every line, and the substrings of it that may equal a shorter line's.

    A task reduces its rows before it sends them: the lines of a key that is crowded already there are marked as such
    and dealt anywhere, and one row that bears the mark goes by the key.
    """

    def rows_of(group):
        names = np.fromiter((n for n, _ in group), np.int64, len(group))
        hashes = SubstringHashes([line for _, line in group])
        lengths = hashes.lengths
        for shorter in range(max(e for _, e in bands) + 1):
            indexed = lengths - shorter
            allowed = edits_of(indexed, bands)
            for edits in np.unique(allowed[allowed >= shorter]).tolist():
                at = np.flatnonzero(allowed == edits)
                own, tag = indexed[at], U64(edits * 64)
                for i in range(edits + 1):
                    start, size = segment(own, edits, i)
                    for shift in probe_shifts(edits, shorter, i):
                        first = np.clip(start + shift, 0, lengths[at] - size)
                        key = signed(mix64(hashes.of(first, size, at) + mix64(own.astype(U64) * U64(4096) + tag + U64(i))))
                        yield key, names[at], lengths[at] * INFO + edits * EDITS_AT + (INDEXED if shorter == shift == 0 else 0)

    def run(batches):
        worker_cache("line_dedup")
        held, size = [], 0
        for group in line_groups(batches, bands[0][0]):
            for part in rows_of(group):
                held.append(part)
                size += len(part[0])
            if size >= POSTED_ROWS:
                yield reduced(held)
                held, size = [], 0
        if held:
            yield reduced(held)

    return docs.select("text").mapInArrow(tidied(run), "key long, line long, info long, route long")


def reduced(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of a task without repeats, lines of crowded keys marked."""
    keys, names, infos = (np.concatenate(x) for x in zip(*held, strict=True))
    keys, names, infos = once(keys, names, infos)
    bounds = runs_of(keys)
    counts = np.diff(bounds)
    crowded = np.repeat(counts, counts) > SMALL_GROUP
    route = np.where(crowded, signed(mix64(keys.view(U64) ^ mix64(names.view(U64)))), keys)
    infos = infos | np.where(crowded, CROWD, 0)
    first = bounds[:-1][counts > SMALL_GROUP]
    mark = infos[first] & ~(CROWD | INDEXED) | MARK
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x)) for x in ((keys, keys[first]), (names, names[first]), (infos, mark), (route, keys[first]))], ["key", "line", "info", "route"]
    )


def once(keys: np.ndarray, names: np.ndarray, infos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of key and line, one for each, indexed if any is."""
    order = np.lexsort((-(infos & INDEXED), names, keys))
    keys, names, infos = keys[order], names[order], infos[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
    return keys[fresh], names[fresh], infos[fresh]


def candidate_rows(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines under small keys; and, with b null, the rows (key, a, info) of larger and marked keys."""

    def run(batches):
        for keys, names, infos in whole_runs(batches, ["key", "line", "info"]):
            marked = np.unique(keys[(infos & MARK) > 0])
            alone = (infos & (MARK | CROWD)) == 0
            crowd = (infos & CROWD) > 0
            big = [keys[crowd]], [names[crowd]], [infos[crowd]]
            keys, names, infos = once(keys[alone], names[alone], infos[alone])
            counts = np.diff(runs_of(keys))
            run_of = np.repeat(np.arange(len(counts)), counts)
            large = np.repeat(counts, counts) > SMALL_GROUP
            if len(marked):
                large |= np.isin(keys, marked)
            sizes, edits, indexed = infos // INFO, infos % INFO // EDITS_AT, (infos & INDEXED) > 0
            left, right = [], []
            for gap in range(1, SMALL_GROUP):
                i = np.flatnonzero((run_of[gap:] == run_of[:-gap]) & ~large[gap:]) if len(keys) > gap else np.zeros(0, np.int64)
                i = i[(np.abs(sizes[i] - sizes[i + gap]) <= edits[i]) & (indexed[i] | indexed[i + gap])]
                left.append(names[i])
                right.append(names[i + gap])
            left, right = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0) if len(left) else np.zeros((0, 2), np.int64)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none], ["key", "a", "b", "info"])
            for held, own in zip(big, (keys, names, infos), strict=True):
                held.append(own[large])
            keys, names, infos = map(np.concatenate, big)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names), pa.nulls(len(keys), pa.int64()), pa.array(infos & ~CROWD)], ["key", "a", "b", "info"])

    return rows.repartition("route").sortWithinPartitions("key").mapInArrow(tidied(run), "key long, a long, b long, info long")


def refined_posts(lines: DataFrame) -> DataFrame:
    """key, line, info and route of lines under crowded keys of one edit: all of the line but one of REFINED segments,
    from both ends.

    Lines one edit apart agree outside the segment that holds it.  Lines that only share a half meet no more.
    """

    def run(batches):
        for batch in batches:
            texts = column(batch, "line_text")
            if not texts:
                continue
            hashes, names = SubstringHashes(texts), ints(batch, "line")
            lengths, held = hashes.lengths, []
            for shorter in range(2):
                indexed = lengths - shorter
                for j in range(REFINED):
                    start, end = indexed * j // REFINED, indexed * (j + 1) // REFINED
                    tail = indexed - end
                    key = hashes.of(np.zeros_like(start), start) * U64(3) + hashes.of(lengths - tail, tail)
                    held.append((signed(mix64(key + indexed.astype(U64) * U64(REFINED) + U64(j))), names, lengths * INFO + EDITS_AT + (INDEXED if not shorter else 0)))
            yield reduced(held)

    return lines.select("line", "line_text").mapInArrow(tidied(run), "key long, line long, info long, route long")


def named_lines(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """line and line_text of the wanted lines.  A bounded Bloom filter spares the others the shuffle."""
    hashes_of = lambda batch: mix64(ints(batch, "line").astype(np.int64).view(U64))
    listed = bloom.build(wanted, wanted.count(), hashes_of)
    sent = docs.sparkSession.sparkContext.broadcast((listed.n_blocks, listed.data.tobytes()))

    def run(batches):
        mine = bloom.BlockedBloom(*sent.value)
        for group in line_groups(batches, least):
            names = np.fromiter((n for n, _ in group), np.int64, len(group))
            passed = np.flatnonzero(mine.might_hold(mix64(names.view(U64))))
            yield pa.RecordBatch.from_arrays([pa.array(names[passed]), pa.array([group[i][1] for i in passed], pa.string())], ["line", "line_text"])

    return docs.select("text").mapInArrow(tidied(run), "line long, line_text string").join(wanted, "line", "left_semi").groupBy("line").agg(F.min("line_text").alias("line_text"))


def allowed_between(x: str, y: str, bands) -> int:
    return int(edits_of(np.array([min(len(x), len(y))]), bands)[0])


def verified(pairs: DataFrame, lines: DataFrame, bands) -> DataFrame:
    def run(batches):
        for batch in batches:
            kept = [within_edits(x, y, allowed_between(x, y, bands)) for x, y in zip(column(batch, "text_a"), column(batch, "text_b"), strict=True)]
            kept = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    a = lines.select(F.col("line").alias("a"), F.col("line_text").alias("text_a"))
    b = lines.select(F.col("line").alias("b"), F.col("line_text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long")


def neighbourhood_links(lines: DataFrame) -> DataFrame:
    """Links (a, b) among lines one edit apart, by their deletion neighbourhoods: no pairs are tried.

    Lines of one length that differ at character k agree without it; a line that lacks a character of another equals
    that one without it.  Either way the rows of one key are all one edit from its first (or whole) line.
    """

    def run(batches):
        for batch in batches:
            for line, text in zip(column(batch, "line"), column(batch, "line_text"), strict=True):
                n = len(text)
                own = SubstringHashes([text]).sums
                for at in range(0, n, POSTED_ROWS):
                    k = np.arange(at, min(n, at + POSTED_ROWS))
                    # Sum of the line without character k: what is before it, and what is after it one place earlier.
                    without = mix64(own[k] + (own[n] - own[k + 1]) * SubstringHashes._inverses[1] + U64(n - 1))
                    both = signed(np.concatenate([mix64(without + k.astype(U64) + U64(1)), without]))
                    yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(np.full(2 * len(k), line, np.int64)), pa.array(np.repeat(np.arange(2), len(k)))], ["key", "line", "kind"])
                yield pa.RecordBatch.from_arrays([pa.array(signed(mix64(own[n:] + U64(n)))), pa.array([line], pa.int64()), pa.array([2], pa.int64())], ["key", "line", "kind"])

    rows = materialise(lines.mapInArrow(tidied(run), "key long, line long, kind long").distinct(), "neighbours")
    same = rows.where("kind = 0")
    # Written apart from the join, so that a large key's rows can be split over tasks there.
    first = materialise(same.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("last")).where("a < last").select("key", "a"), "neighbour-hubs")
    stars = same.join(first, "key").where("line <> a").select("a", F.col("line").alias("b"))
    whole = rows.where("kind = 2").select("key", F.col("line").alias("a"))
    return stars.union(rows.where("kind = 1").join(whole, "key").where("line <> a").select("a", F.col("line").alias("b"))).distinct()


def character_counts(texts: list[str]) -> np.ndarray:
    """Counts of 64 classes of characters in each line."""
    found = np.zeros((len(texts), 64), np.int32)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found[i] = np.bincount(codes & 63, minlength=64)
    return found


def tile_links(rows: DataFrame, bands) -> DataFrame:
    """Links (a, b) between lines of different components in a tile (tile, side, a, component, meta, line_text).

    One edit changes one count, or moves one: half of the counts' total difference bounds the distance from below.
    """

    def links(names, parts, sides, texts):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = character_counts(texts)
        allowed = edits_of(lengths, bands)
        right = np.flatnonzero(sides != 0)
        for i in np.flatnonzero(sides != 1).tolist():
            once = (sides[right] != 2) | (names[i] < names[right])
            most = np.where(lengths[right] < lengths[i], allowed[right], allowed[i])
            j = right[once & (parts[right] != parts[i]) & (np.abs(lengths[right] - lengths[i]) <= most)]
            if len(j):
                apart = np.abs(counts[j] - counts[i]).sum(1)
                most = np.where(lengths[j] < lengths[i], allowed[j], allowed[i])
                for k, edits in zip(j[apart <= 2 * most].tolist(), most[apart <= 2 * most].tolist(), strict=True):
                    if within_edits(texts[i], texts[k], edits):
                        yield min(names[i], names[k]), max(names[i], names[k])

    def run(batches):
        held: dict[int, list] = {}
        last = None

        def tile():
            if last is not None and len(set(held["component"])) > 1:
                pairs = set(links(np.array(held["a"]), np.array(held["component"]), np.array(held["side"]), held["line_text"]))
                a, b = zip(*pairs, strict=True) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        names = ["a", "component", "side", "line_text"]
        for batch in batches:
            tiles = ints(batch, "tile") if batch.num_rows else np.zeros(0, np.int64)
            values = {n: column(batch, n) for n in names}
            for lo, hi in zip(runs_of(tiles)[:-1], runs_of(tiles)[1:], strict=True):
                if tiles[lo] != last:
                    yield from tile()
                    held, last = {n: [] for n in names}, tiles[lo]
                for n in names:
                    held[n] += values[n][lo:hi]
        yield from tile()

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(tidied(run), "a long, b long")


def crowd_links(groups: DataFrame, lines: DataFrame, bands) -> DataFrame:
    """Links of lines under crowded keys (key, a, info) of more than one edit: with hubs first, then in tiles."""
    groups = materialise(told_apart(groups.select("key", "a", F.col("info").alias("meta")).distinct()), "crowds")
    groups = groups.withColumn("band", F.floor(F.col("meta") / (INFO * BAND_CHARS)))
    degrees = materialise(groups.groupBy("a").agg(F.count("*").alias("degree")), "degrees")
    stars = materialise(verified(star_pairs(groups.join(degrees, "a")), lines, bands), "star-links")
    joined = connected(stars)
    labelled = groups.join(joined.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    labelled = materialise(labelled, "labelled")
    rows = tiled(labelled, materialise(tile_plan(labelled), "tile-plan")).join(lines.select(F.col("line").alias("a"), "line_text"), "a")
    return stars.unionByName(tile_links(rows, bands)).distinct()


def repeated_lines(docs: DataFrame, least: int = LEAST_CHARS, bands=EDIT_BANDS) -> tuple[DataFrame, DataFrame]:
    """Occurrences (line, doc_id, row, line_no), and the classes with more than one: line, class_id and the first."""
    prepare(docs.sparkSession)
    seen = occurrences(docs, least)
    rows = materialise(candidate_rows(posts(docs, bands)), "line-pairs")
    pairs = rows.where("b is not null").select("a", "b").distinct()
    crowd = rows.where("b is null").select("key", "a", "info", F.expr(f"info % {INFO} div {EDITS_AT}").alias("edits"))
    single = materialise(crowd.where("edits = 1").select(F.col("a").alias("line")).distinct(), "crowded-lines")
    wanted = materialise(pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(crowd.select("a")).distinct(), "line-names")
    lines = materialise(named_lines(docs, wanted, bands[0][0]), "lines")
    finer = materialise(candidate_rows(refined_posts(lines.join(single, "line", "left_semi"))), "line-pairs")
    pairs = pairs.unionByName(finer.where("b is not null").select("a", "b")).distinct()
    single = finer.where("b is null").select(F.col("a").alias("line")).distinct()
    links = verified(pairs, lines, bands).unionByName(neighbourhood_links(lines.join(single, "line", "left_semi")))
    several = crowd.where("edits > 1")
    if not several.isEmpty():
        links = links.unionByName(crowd_links(several, lines, bands))
    classes = connected(links)
    own = seen.groupBy("line").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("first"), F.count("*").alias("n"))
    own = materialise(own.join(classes.select(F.col("node").alias("line"), F.col("component").alias("class_id")), "line", "left").withColumn("class_id", F.coalesce("class_id", "line")), "line-classes")
    firsts = materialise(own.groupBy("class_id").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n"), "line-firsts")
    found = materialise(own.select("line", "class_id").join(firsts, "class_id"), "repeated-lines")
    release(rows, finer, lines, wanted, own, firsts)
    return seen, found


def cut_lines(docs: DataFrame, least: int = LEAST_CHARS, bands=EDIT_BANDS) -> tuple[DataFrame, str, str]:
    """dedup_lines, with the two counts under names that docs does not have: the table and these names."""
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    seen, classes = repeated_lines(known, least, bands)
    place = F.struct("doc_id", "row", "line_no")
    doc, row, cut, lines, n_cut = unused(docs, "cut_doc", "cut_row", "cut_lines", "n_lines", "n_cut")
    cuts = seen.join(classes, "line").where(place != F.col("first")).groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set(F.col("line_no").cast("int")).alias(cut))
    joined = docs.join(materialise(cuts, "cuts"), (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(row)), "left")

    @F.pandas_udf("string")
    def left(texts, numbers):
        def one(text, gone):
            if text is None or gone is None:
                return None
            gone = set(gone)
            return "\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone])

        return texts.combine(numbers, one)

    joined = joined.withColumns({lines: F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)), n_cut: F.coalesce(F.size(cut), F.lit(0))})
    joined = joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(left(F.when(F.col(cut).isNotNull(), F.col("text")), F.col(cut))))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(*docs.columns, lines, n_cut), lines, n_cut


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, bands=EDIT_BANDS) -> DataFrame:
    """The documents' columns with repeated lines cut from text (n_chars follows), and n_lines, n_cut of each.

    Of each class of equal or nearly equal lines, the one with the smallest (doc_id, line number) stays.  Blank lines,
    and those of fewer than `least` characters, are left alone; lines below the first band's length are compared
    exactly.  A document that loses every line that takes part keeps the rest as its text.  Null texts stay null and
    empty ones empty; rows with a null doc_id take no part and are left alone.  Rows that share a doc_id are documents
    of their own (in order of a hash of their texts); rows equal in doc_id and text lose the same lines.  Further
    columns are kept, but for any of the names n_lines and n_cut.  An empty table gives no rows.
    """
    found, lines, cut = cut_lines(docs.drop("n_lines", "n_cut"), least, bands)
    return found.withColumnsRenamed({lines: "n_lines", cut: "n_cut"})
