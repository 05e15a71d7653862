"""Counts of whole columns of texts equal those of texts one by one, and cost less."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from parcelmill.llm import mixing

ODD = [
    None, "", " ", "\x0b\x0c\r\t\n", "abcd", "abcde", " abcde", "abcde\n", "ABCDEfGH abcdefgh", "a\x00bcdef \x1c\x1d\x85words", "Straße ÀÉÎõü İSTANBUL 漢字漢字漢 　 wide",
    " ".join("x" * n for n in range(mixing.NEAR - 2, mixing.NEAR + 4)), "Y" * 5000 + "\tz" + "é" * 200, "words " * mixing.MOST_COUNT, "words " * (mixing.MOST_COUNT + 1) + "others " * 1000,
]


def plain(texts):
    split = [mixing.words_of(t) for t in texts]
    return [len(w) for w in split], mixing.place_counts(split, mixing.Places()) if split else np.zeros((0, mixing.PLACES), np.int64)


def read(column):
    size = mixing.PLACES
    return np.vstack([np.zeros((0, size)), *[np.bincount(b.at, b.codes // size, b.n * size).reshape(-1, size) for b in mixing.blocks(column)]])


@pytest.mark.parametrize("column", [pa.array(ODD), pa.array(ODD[::-1]), pa.array(ODD).slice(3, 9), pa.array(ODD, pa.large_string()), pa.array([], pa.string()), pa.array([None], pa.string())])
def test_columns_count_as_texts_do(column, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    words, counts = plain(column.to_pylist())
    got_words, got = mixing.text_counts(column, mixing.byte_tables())
    assert got_words.tolist() == words and got.to_pylist() == mixing.sparse(counts)
    assert np.array_equal(read(got), counts) and np.array_equal(read(got.slice(1)), counts[1:])


def test_vectors_of_blocks_are_those_of_counts():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (700, mixing.PLACES)) * rng.integers(0, 2, (700, mixing.PLACES)) * rng.integers(1, 200, (700, 1))
    counts[5] = 0
    idf = rng.random(mixing.PLACES)
    column, points = pa.array(mixing.sparse(counts), pa.binary()), mixing.pointing(idf)
    assert np.array_equal(np.vstack([points(b) for b in mixing.blocks(column)]), mixing.units(counts, idf))
    marks = np.concatenate([b.marks() for b in mixing.blocks(column)])
    assert len(set(marks.tolist())) == len(marks)


def test_words_that_seldom_repeat_cost_less_than_by_a_dictionary():
    """Counts word by word took some nine times as long; rows took eight bytes for each place."""
    rng = random.Random(1)
    texts = [" ".join(f"{rng.getrandbits(rng.choice((8, 16, 36))):x}" for _ in range(500)) for _ in range(600)]
    columns, tables, places = [pa.array(texts[i : i + 300]) for i in (0, 300)], mixing.byte_tables(), mixing.Places()

    def cpu(work):
        took = []
        for _ in range(3):
            places.clear()
            began = time.process_time()
            found = [work(c) for c in columns]
            took.append(time.process_time() - began)
        return min(took), found

    new, found = cpu(lambda c: mixing.text_counts(c, tables)[1])
    old, _ = cpu(lambda c: mixing.place_counts([mixing.words_of(t) for t in c.to_pylist()], places))
    assert new < old / 2, (new, old)
    assert max(len(b) for c in found for b in c.to_pylist()) <= 2 * mixing.PLACES
