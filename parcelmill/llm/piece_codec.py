"""Exact encoding and decoding by a merge-type sentence-piece model, through backtracking.

The library merges the adjacent pair of best score, leftmost first, until none is left.  The same pieces are found
without a queue: a sequence of pieces is the library's exactly when each of them re-merges from its own characters and
every two neighbours are compatible, that is when merging would not have joined across their border first.  So a
text is read from left to right: an Aho-Corasick automaton gives the longest piece from each place, a piece that
does not go with the one before gives way to its next shorter prefix, and if none is left the piece before is taken
back and the place is marked in a bitfield, so that no place fails twice.

A text is cut before each run of spaces, which no piece of such a model crosses (checked when the model is read; a model
with other pieces is encoded without cuts).  Pieces are looked up in the worker's cache; what is new is encoded as above.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, texts, worker_cache
from .token_counts import MARK, RUNS, model

#: Entries of a worker's caches: stretches with their ids, and neighbours known to go together or not.
CACHE_ENTRIES = 500_000
PAIR_ENTRIES = 400_000
#: Characters of the longest stretch that is kept.
ENTRY_CHARS = 48
#: Characters of the longest stretch that is encoded beside others, and how many go side by side.
SHORT_CHARS = 64
SIDE_BY_SIDE = 20_000


class Vocabulary:
    """What a model says: pieces by id, their scores, and the bytes that stand for unknown characters."""

    def __init__(self, path: str):
        found = model(path)
        self.pieces: list[str] = [found.id_to_piece(i) for i in range(found.get_piece_size())]
        self.scores: list[float] = [found.get_score(i) for i in range(len(self.pieces))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if found.is_byte(i)}
        special = {i for i in range(len(self.pieces)) if found.is_unknown(i) or found.is_control(i) or found.is_byte(i)}
        self.unknown = found.unk_id()
        if any(found.is_unused(i) for i in range(len(self.pieces))):
            raise ValueError("models with unused pieces are not supported")
        if len(self.byte_ids) not in (0, 256):
            raise ValueError("a model has all bytes or none")
        self.normal: dict[str, int] = {self.pieces[i]: i for i in range(len(self.pieces)) if i not in special}


class Codec:
    """Encodes stretches of text, space marks in place, and decodes ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        normal, scores = vocabulary.normal, vocabulary.scores
        #: Places of the pieces in the order in which merging prefers them: a smaller rank is merged first.
        ranked = sorted(normal.values(), key=lambda i: (-scores[i], i))
        self.rank = [0] * len(scores)
        for r, i in enumerate(ranked):
            self.rank[i] = r
        self.crossed = any(MARK in p.lstrip(MARK) for p in normal)
        #: Pieces of equal score are merged by their place, which ranks cannot tell: stretches with one of them inside
        #: are merged step by step.  (In common models these are runs of two and of four spaces.)
        tied: dict[float, list[str]] = {}
        for p, i in normal.items():
            if len(p) > 1:
                tied.setdefault(scores[i], []).append(p)
        self.tied = sorted((p for same in tied.values() if len(same) > 1 for p in same), key=len)
        self.tied = [p for n, p in enumerate(self.tied) if not any(q in p for q in self.tied[:n])]
        self.split: dict[int, tuple[int, int]] = {}
        reached = {p: i for p, i in normal.items() if self._reached(p, i)}
        self.whole = reached
        self.characters = {p for p in normal if len(p) == 1}
        self.lines = not any("\n" in p for p in normal)
        self.decimals = [str(i) for i in range(len(scores))]
        self.automaton = ahocorasick.Automaton()
        for p, i in reached.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = [len(p) for p in vocabulary.pieces]
        #: The longest shorter piece that a piece begins with.
        self.shorter = {i: next((reached[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), -1) for p, i in reached.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._lengths = np.array(self.length, np.int64)
        self._shorter = np.full(len(self.length), -1, np.int64)
        self._shorter[list(self.shorter)] = list(self.shorter.values())
        self._known = np.empty(0, np.int64), np.empty(0, bool)
        self.byte_of = {i: b for b, i in vocabulary.byte_ids.items()}

    def _reached(self, piece: str, i: int) -> bool:
        """Whether merging the piece's own characters gives the piece; its last merge is kept."""
        if len(piece) == 1:
            return True
        last = self._merge(piece, self.split, i)
        return len(last) == 1

    def _merge(self, text: str, splits: dict | None = None, whole: int | None = None) -> list[int]:
        """The library's own order: best score first, then leftmost; ids of the symbols that remain."""
        normal, scores, parts = self.v.normal, self.v.scores, list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                joined = parts[a] + parts[b]
                found = normal.get(joined)
                if found is not None:
                    heapq.heappush(queue, (-scores[found], a, b, joined))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if not parts[a] or not parts[b] or right[a] != b or parts[a] + parts[b] != joined:
                continue
            if splits is not None and len(joined) == len(text):
                splits[whole] = (normal[parts[a]], normal[parts[b]])
            parts[a], parts[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self._symbol(p) for p in parts if p]

    def _symbol(self, symbol: str) -> int:
        return self.v.normal.get(symbol, self.v.unknown)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b together leaves exactly a and b.

        The two are taken apart again, the later merge first.  At each stage the symbols beside the border may
        themselves be a pair that merges; if that merge comes before the one just taken apart, it would have been
        made.  Of two merges of one rank the left one comes first.
        """
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            found = self.pairs[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        rank, split, pieces, normal = self.rank, self.split, self.v.pieces, self.v.normal
        undone = len(rank) * 2
        # Merges are timed by twice their rank, plus one where they lie right of the border's own.
        while True:
            joined = normal.get(pieces[a] + pieces[b])
            if joined is not None and 2 * rank[joined] + 0 < undone:
                return False
            at_a = 2 * rank[a] if a in split else -1
            at_b = 2 * rank[b] + 1 if b in split else -1
            if at_a < 0 and at_b < 0:
                return True
            if at_a > at_b:
                undone, a = at_a, split[a][1]
            else:
                undone, b = at_b, split[b][0]

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        longest = [0] * len(text)
        for end, i in self.automaton.iter(text):
            longest[end - self.length[i] + 1] = i  # ends come in order: the last one is the longest
        length, shorter, pairs, compatible = self.length, self.shorter, self.pairs, self.compatible
        found: list[int] = []
        size, place, failed = len(text), 0, 0
        piece = longest[0] if text else -1
        while place < size:
            before = found[-1] if found else -1
            while piece >= 0:
                end = place + length[piece]
                if not failed >> end & 1:
                    good = before < 0 or pairs.get((before, piece))
                    if good is None:
                        good = compatible(before, piece)
                    if good:
                        break
                piece = shorter[piece]
            if piece >= 0:
                found.append(piece)
                place = end
                if place < size:
                    piece = longest[place]
            else:
                failed |= 1 << place
                piece = found.pop()
                place -= length[piece]
                piece = shorter[piece]
        return found

    def encode_side_by_side(self, many: Sequence[str]) -> list[list[int]]:
        """_backtrack over many short texts at once: each round moves every text that is not done by one step.

        A text's pieces are kept at the places where they end, so that the piece before a place is always at hand.
        """
        sizes = np.fromiter(map(len, many), np.int64, len(many))
        joined = "\0".join(many)  # matches must not cross from one text to the next: places after each one are never read
        stop = np.cumsum(sizes + 1) - 1
        start = stop - sizes
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        longest = np.full(len(joined) + 1, -1, np.int64)
        begins = found[:, 0] - self._lengths[found[:, 1]] + 1
        inside = found[:, 0] < stop[np.searchsorted(stop, begins)]
        longest[begins[inside]] = found[inside, 1]
        ending = np.full(len(joined) + 1, -1, np.int64)
        failed = np.zeros(len(joined) + 1, bool)
        lengths, shorter = self._lengths, self._shorter
        row = np.flatnonzero(sizes > 0)
        place, first, end = start[row].copy(), start[row], stop[row]
        piece = longest[place]
        while len(row):
            there = piece >= 0
            to = place + lengths[piece]
            good = there & ~failed[np.where(there, to, 0)]
            check = np.flatnonzero(good & (place > first))
            good[check] = self._compatible_side_by_side(ending[place[check]], piece[check])
            back = ~good
            step = np.where(there, shorter[piece], -1)
            taken = back & (step < 0)
            if taken.any():
                at = place[taken]
                failed[at] = True
                last = ending[at]
                place[taken] = at - lengths[last]
                step[taken] = shorter[last]
            ahead = to[good]
            ending[ahead] = piece[good]
            place[good] = ahead
            piece = np.where(good, longest[np.where(good, to, 0)], step)
            open_ = place < end
            if not open_.all():
                row, place, first, end, piece = row[open_], place[open_], first[open_], end[open_], piece[open_]
        used = np.zeros(len(joined) + 1, bool)
        place, first = stop[sizes > 0], start[sizes > 0]
        while len(place):
            used[place] = True
            place = place - lengths[ending[place]]
            more = place > first
            place, first = place[more], first[more]
        at = np.flatnonzero(used)
        ids, bounds = ending[at].tolist(), np.searchsorted(at, stop, "right").tolist()
        return [ids[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]

    def _compatible_side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many neighbours, through a sorted table of those met before."""
        key = a * len(self.length) + b
        known, says = self._known
        at = np.searchsorted(known, key)
        at[at == len(known)] = 0
        new = known[at] != key if len(known) else np.ones(len(key), bool)
        if new.any():
            keys = np.unique(key[new])
            more = np.fromiter((self._compatible(*divmod(k, len(self.length))) for k in keys.tolist()), bool, len(keys))
            if len(known) + len(keys) > PAIR_ENTRIES:
                # Start anew from what is asked for now.
                keys = np.unique(key)
                more = np.fromiter((self._compatible(*divmod(k, len(self.length))) for k in keys.tolist()), bool, len(keys))
                known, says = np.empty(0, np.int64), np.empty(0, bool)
            known, says = np.concatenate([known, keys]), np.concatenate([says, more])
            order = np.argsort(known, kind="stable")
            known, says = self._known = known[order], says[order]
            at = np.searchsorted(known, key)
        return says[at]

    def encode(self, stretch: str) -> list[int]:
        """Ids of a stretch whose spaces are marks already."""
        alone = self.whole.get(stretch)
        if alone is not None:
            return [alone]
        known = self._merge if any([t in stretch for t in self.tied]) else self._backtrack
        if self.characters.issuperset(stretch):
            return known(stretch)
        normal, out, start = self.v.normal, [], 0
        for n, char in enumerate(stretch):
            if char not in normal:
                if n > start:
                    out += known(stretch[start:n])
                out += [self.v.byte_ids[b] for b in char.encode()] if self.v.byte_ids else [self.v.unknown]
                start = n + 1
        return out + known(stretch[start:]) if start < len(stretch) else out

    def encode_all(self, many: Sequence[str]) -> list[list[int]]:
        """encode() of many stretches, the short plain ones side by side."""
        plain = [n for n, t in enumerate(many) if len(t) <= SHORT_CHARS and self.characters.issuperset(t) and not any([p in t for p in self.tied])]
        out: list = [None] * len(many)
        for a in range(0, len(plain), SIDE_BY_SIDE):
            group = plain[a : a + SIDE_BY_SIDE]
            for n, ids in zip(group, self.encode_side_by_side([many[n] for n in group]), strict=True):
                out[n] = ids
        return [ids if ids is not None else self.encode(many[n]) for n, ids in enumerate(out)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids, with the space that the model puts before a text still there."""
        byte_of, pieces, unknown = self.byte_of, self.v.pieces, self.v.unknown
        if byte_of.keys().isdisjoint(ids) and unknown not in ids:
            return "".join([pieces[i] for i in ids]).replace(MARK, " ")
        parts, run = [], bytearray()
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(" ⁇ " if i == unknown else pieces[i].replace(MARK, " "))
        parts.append(run.decode("utf-8", "replace"))
        return "".join(parts)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(Vocabulary(path))
    return _codecs[path]


def stretches(text: str, found: Codec) -> list[str]:
    """The parts of a text that are encoded apart, each without one space before it.

    Line ends, which are in no piece of such a model, get a space before them, so that each begins a part.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    if found.crossed:
        return [text]
    if found.lines:
        text = text.replace("\n", " \n")
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    return [run[1:] for run in RUNS.findall(" " + text)]


def as_encoded(stretch: str, found: Codec) -> str:
    """What of the text a part stands for, with marks for spaces: a line end had no space of its own before it."""
    marked = stretch.replace(" ", MARK)
    return marked if found.lines and stretch.lstrip(" ")[:1] == "\n" else MARK + marked


def encode_texts(path: str, batch: Sequence[str]) -> Iterable[tuple[str, str]]:
    """For each text its ids, in decimal and joined by commas, and the text that they decode to."""
    found, cache = codec(path), worker_cache("piece_codec", path)
    split = [stretches(t, found) for t in batch]
    here = set().union(*split)
    missing = here - cache.keys()
    if len(cache) + len(missing) > CACHE_ENTRIES:
        kept = {w: cache[w] for w in here - missing}
        cache.clear()
        if len(kept) + len(missing) <= CACHE_ENTRIES:
            cache.update(kept)
        else:
            missing = here
    once, odd = {}, {}
    words = list(missing)
    marked = [as_encoded(w, found) for w in words]
    ids = found.encode_all(marked)
    # Decoded together first: only where that differs from what was encoded are stretches decoded one by one.
    alike = found.decode(list(chain.from_iterable(ids))) == "".join(marked).replace(MARK, " ")
    for word, stands_for, own in zip(words, marked, ids, strict=True):
        text = ",".join([found.decimals[i] for i in own])
        if not alike and (back := found.decode(own)) != stands_for.replace(MARK, " "):
            odd[word], once[word] = back, text
        else:
            (cache if len(word) <= ENTRY_CHARS and len(cache) < CACHE_ENTRIES else once)[word] = text
    for words in split:
        parts = list(map(cache.get, words))
        if None in parts:
            parts = [p if p is not None else once[w] for p, w in zip(parts, words, strict=True)]
        if odd:
            back = "".join([odd[w] if w in odd else as_encoded(w, found).replace(MARK, " ") for w in words])[1:]
        else:
            back = " ".join(words)
            back = back.replace(" \n", "\n") if found.lines else back
        yield ",".join(parts), back


def encode_documents(docs: DataFrame, model_path: str, name: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with `ids` (array of int) and `decoded` of every text, whole.

    A null or empty text has no ids and decodes to the empty text; repeated rows and null ids are kept as they come; an
    empty table gives no rows.
    """
    return _each(docs, model_path, name, keep, [("ids", "array<int>"), ("decoded", "string")], lambda ids, back: ([int(i) for i in ids.split(",")] if ids else [], back))


def digest_documents(docs: DataFrame, model_path: str, name: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""

    def digests(ids: str, back: str):
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    return _each(docs, model_path, name, keep, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], digests)


def _each(docs: DataFrame, path: str, name: str, keep: Sequence[str], made: Sequence[tuple[str, str]], of) -> DataFrame:
    """One pass over the texts, without a shuffle; kept columns go through as they are."""
    prepare(docs.sparkSession)
    kept = {c: t for c, t in docs.dtypes if c in keep}
    schema = ", ".join(f"`{c}` {t}" for c, t in [*kept.items(), *made])
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches):
        for batch in batches:
            rows = [of(ids, back) for ids, back in encode_texts(path, texts(batch, "_text"))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array([r[n] for r in rows], types[t]) for n, (_, t) in enumerate(made)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *[c for c, _ in made]])

    return docs.select(*[f"`{c}`" for c in kept], docs[f"`{name}`"].alias("_text")).mapInArrow(run, schema)
