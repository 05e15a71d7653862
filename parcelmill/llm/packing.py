"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document's ids (with the separator) are first cut into full windows; the rest is one piece.  Pieces are dealt into
shards of bounded size, and each shard is packed by best-fit decreasing: a segment tree over remaining capacities
finds the tightest open window that a piece fits.  Every shard is packed alone, so padding is what its last few
windows leave open.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, materialise, prepare, tidied, worker_cache

WINDOW = 4096
#: Numbers of sequences that one full window fills; those of shards lie below.
FULL_FROM = 1 << 62
#: Documents a shard is sized for.  A shard's rows are six numbers each.
SHARD_DOCS = 25_000
#: Entries of a worker's cache of word ids, some 40 bytes each; longer words are encoded anew.
CACHE_ENTRIES = 400_000
CACHE_BYTES = 48
#: Bytes of the batches that are encoded together.
CHUNK_BYTES = 8 << 20
#: Marks that the tokenizer splits off the end of a word as one run: not the apostrophe, which begins short words, nor
#: what its added tokens are made of.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Lower-case letters that normalising leaves as they are.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c.islower())
#: What the tokenizer's added tokens start with.
ADDED = "<|"

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: The 256 byte symbols of a byte-level vocabulary: printable bytes stand for themselves, the rest follow from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SYMBOLS = {b: b for b in _PRINTABLE} | {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


_four: list[bytes] = []


def four_bytes(whole) -> list[bytes]:
    """Each id of the vocabulary as little-endian unsigned 32 bits."""
    if not _four:
        _four.extend(i.to_bytes(4, "little") for i in range(max(whole.get_vocab().values()) + 1))
    return _four


def id_bytes(path: str, words: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of words.

    Words of lower-case Latin-1 letters, which normalising and splitting leave as they are, go straight to the
    tokenizer's model; all others take its whole way.
    """
    whole = tokenizer(path)
    merge, four = whole.model.tokenize, four_bytes(whole)
    found: list[bytes] = [b""] * len(words)
    others = []
    for i, word in enumerate(words):
        if not (word.isalpha() and word.islower()):
            if word:
                others.append(i)
            continue
        if word.isascii():
            found[i] = b"".join([four[t.id] for t in merge(word)])
        else:
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                others.append(i)
                continue
            found[i] = b"".join([four[t.id] for t in merge(word.encode().decode("latin-1").translate(_SYMBOLS))])
    for i, x in zip(others, whole.encode_batch_fast([words[i] for i in others], add_special_tokens=False) if others else [], strict=True):
        found[i] = packed(x.ids)
    return found


def lowered(words: pa.Array) -> pa.Array:
    """Words of Latin-1 characters in lower case, as the tokenizer would make them letter by letter, so that more of
    them repeat.  Others stay, as characters may combine there, and so do words that may hold one of its added tokens,
    which it looks for before it lower-cases."""
    plain = pc.string_is_ascii(words)
    other = pc.invert(plain)
    plain = pc.replace_with_mask(plain, other, pc.invert(pc.match_substring_regex(words.filter(other), r"[^\x00-\x{FF}]")))
    return pc.if_else(pc.and_not(plain, pc.match_substring(words, ADDED)), pc.utf8_lower(words), words)


def stems_and_marks(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words of lower-case Latin-1 letters and marks after them fall into the letters and the marks, which the tokenizer
    takes as one word more; others stay whole, with no marks."""
    stems, marks = pc.utf8_rtrim(words, MARKS), pc.utf8_ltrim(words, LETTERS)
    sizes = pc.binary_length(stems)
    apart = pc.and_(pc.greater(sizes, 0), pc.equal(pc.add(sizes, pc.binary_length(marks)), pc.binary_length(words)))
    return pc.if_else(apart, stems, words), pc.if_else(apart, marks, pa.scalar("", words.type))


def stem_ids(path: str, stems: pa.Array) -> pa.Array:
    """The ids of different stems as bytes.  A worker keeps those of the stems it has met last."""
    cache = worker_cache("packing", path)
    known, known_ids = cache.get("stems", stems[:0]), cache.get("ids", pa.array([], pa.large_binary()))
    at = pc.index_in(stems, value_set=known)
    missing = at.is_null()
    new = stems.filter(missing)
    places = np.arange(len(known), len(known) + len(new), dtype=np.int32)
    ids = pa.concat_arrays([known_ids, pa.array(id_bytes(path, strings(new)), pa.large_binary())])
    found = ids.take(pc.replace_with_mask(at, missing, pa.array(places)))
    older = np.ones(len(known), bool)
    older[at.drop_null().to_numpy()] = False
    older, short = pa.array(older), pc.less_equal(pc.binary_length(stems), CACHE_BYTES)
    cache["stems"] = pa.concat_arrays([stems.filter(short), known.filter(older)])[:CACHE_ENTRIES]
    cache["ids"] = pa.concat_arrays([found.filter(short), known_ids.filter(older)])[:CACHE_ENTRIES]
    return found


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def encode_docs(path: str, docs: list[str] | pa.Array) -> list[bytes]:
    """Little-endian 32-bit ids of each text.

    The tokenizer drops white space between words and merges nothing across it, so a text's ids are those of its
    pieces between spaces and line ends.  Pieces repeat: each different one is looked at once, and taken where it comes.
    """
    split = pc.split_pattern(pc.replace_substring(pa.array(docs, pa.large_string()), "\n", " "), " ")
    words = split.flatten().dictionary_encode()
    stems, marks = (x.dictionary_encode() for x in stems_and_marks(lowered(words.dictionary)))
    ids = stem_ids(path, stems.dictionary).take(stems.indices)
    ends = pa.array(id_bytes(path, strings(marks.dictionary)), pa.large_binary()).take(marks.indices)
    nothing = pa.scalar(b"", pa.large_binary())
    each = pc.binary_join_element_wise(ids, ends, nothing).take(words.indices)
    return pc.binary_join(pa.ListArray.from_arrays(split.offsets, each), nothing).to_pylist()


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to CHUNK_BYTES, so that more words repeat in each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def cut_pieces(docs: DataFrame, tokenizer_path: str, separator: int, window: int = WINDOW) -> DataFrame:
    """One row per piece: full windows of each document, then what is left (documents always end in the separator).

    repeat tells a piece from equal ones before it in its task: 0 for the first.
    """
    end = packed([separator])
    step = 4 * window
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "repeat"]

    def cut(batches):
        seen: Counter[tuple[int | None, int]] = Counter()
        task = TaskContext.get().partitionId() << 32
        for chunk in chunks(batches):
            rows: list[list] = [[] for _ in names]
            docs_here = pc.fill_null(chunk["text"].cast(pa.large_string()), "").combine_chunks()
            for doc_id, ids in zip(chunk["doc_id"].to_pylist(), encode_docs(tokenizer_path, docs_here), strict=True):
                ids += end
                name = (doc_id, zlib.crc32(ids))
                repeat = task + seen[name] if seen[name] else 0
                seen[name] += 1
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    for values, value in zip(rows, (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, repeat), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows], names)

    return docs.select("doc_id", "text").mapInArrow(tidied(cut), ", ".join(f"{n} long" for n in names))


class OpenWindows:
    """A segment tree over capacities 1..window: which capacities some open window has left."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.at: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, sequence: int, offset: int) -> None:
        if room <= 0:
            return
        self.at.setdefault(room, []).append((sequence, offset))
        node = self.base + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int, int] | None:
        """(room, sequence, offset) of the open window with the least room of at least size, or None."""
        count, node = self.count, self.base + size
        if not count[node]:
            # Up until a right sibling holds a window, then down its left edge.
            while True:
                if node <= 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.base:
                node <<= 1
                if not count[node]:
                    node += 1
        room = node - self.base
        sequence, offset = self.at[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, sequence, offset


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length; lengths come longest first."""
    open_windows, n = OpenWindows(window), 0
    sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        found = open_windows.take(size)
        if found is None:
            found, n = (window, n, 0), n + 1
        room, sequence, offset = found
        sequences[i], offsets[i] = sequence, offset
        open_windows.put(room - size, sequence, offset + size)
    return sequences, offsets


def pack(docs: DataFrame, tokenizer_path: str, separator: int = 2, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the separator alone.  Pieces of equal length are placed by doc_id, then start, so the
    result is the same on every run; repeated rows are packed as often as they come; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    pieces = materialise(cut_pieces(docs, tokenizer_path, separator, window), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # A full window shares with nothing: it is a sequence of its own, and is not moved.
    full = pieces.where(F.col("length") == window).withColumns({"sequence_id": F.monotonically_increasing_id() + FULL_FROM, "offset": F.lit(0).cast("long")})
    parts = pieces.where(F.col("length") < window)
    n_shards = max(1, ceil_div(parts.count(), shard_docs))
    # Equal rows are dealt apart, so one that comes very often is spread over all shards.
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "repeat"), F.lit(n_shards)).cast("long").alias("shard")

    def place(key, rows):
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequences, offsets = best_fit_decreasing(rows["length"].to_numpy(), window)
        rows["sequence_id"] = (int(key[0]) << 32) + sequences
        rows["offset"] = offsets
        return rows[columns]

    packed_parts = parts.select("*", shard).repartition(n_shards, "shard").groupBy("shard").applyInPandas(place, ", ".join(f"{c} long" for c in columns))
    return packed_parts.unionByName(full.select(*columns))
