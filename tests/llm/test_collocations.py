"""Phrases against counting in plain Python, and the pieces of the method by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, odd_rows

from parcelmill.llm import collocations as c


def brute(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = set()
    for lang, f in counts.items():
        cands = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in cands.items():
            if any(len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in cands.items()):
                continue
            score, _, k = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k, k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return out


def texts_of(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "c", "D", "é", "\x01x", "x", "long-word", "日本"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! "]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 30)))) for _ in range(n)]
    return rows + [("en", "very hot pair " * 200), ("en", None), ("fr", ""), (None, " \t ")]


@pytest.mark.parametrize("least, longest, top, sent", [(3, 5, 20, 0), (2, 3, 2000, 10**6), (6, 5, 5, 10**6), (4, 2, 50, 0)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, longest, top, sent):
    monkeypatch.setattr(c, "SENT_WORDS", sent)  # 0: the dictionary is joined
    monkeypatch.setattr(c, "CHUNK_WORDS", 400)
    monkeypatch.setattr(c, "RANGE_PLACES", 37)  # many ranges: pairs lie in several
    rows = texts_of(least, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {tuple(r) for r in c.collocations(docs, least, longest, top).collect()}
    want = brute(rows, least, longest, top)
    assert got == want and len(want) > 10


def test_odd_rows_and_clashing_names(spark):
    """Null and empty texts have no words, repeated rows count each time, an empty table gives no rows."""
    docs = documents(spark, odd_rows()).withColumnRenamed("source", "chunk").withColumnRenamed("n_chars", "a.b")
    got = {tuple(r) for r in c.collocations(docs, 2, 5, 50).collect()}
    assert got == brute([("en" if i is None or i % 2 else "fr", t) for i, t in odd_rows()], 2, 5, 50)
    assert c.collocations(docs.limit(0)).count() == 0
    assert c.collocations(docs, least=10**9).count() == 0


def test_scores_past_64_bits(spark):
    grams = spark.createDataFrame([([1, 2], 10**12)], "gram array<long>, a long")
    words = spark.createDataFrame([("en", "x", 3 * 10**12, 1, 0), ("en", "y", 7 * 10**12, 2, 0)], "lang string, word string, f long, id long, place long")
    sums = spark.createDataFrame([("en", 10**15, 10**13)], "lang string, n long, often long")
    assert [r["score"] for r in c._scored(grams, words, sums).collect()] == [1000 * 10**12 * 10**15 // (21 * 10**24)]


def test_radix_order_and_merging():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**32, (5000, 3), dtype=np.uint32)
    keys[::2, 0] = 7
    keys[::5] = keys[0]
    assert (keys[c.radix_order(keys)] == np.array(sorted(keys.tolist()), np.uint32)).all()
    found, counts = c.merged(keys, None)
    want = Counter(map(tuple, keys.tolist()))
    assert dict(zip(map(tuple, found.tolist()), counts.tolist(), strict=True)) == want


def test_planes_round_trip():
    values = np.array([0, 1, 255, 256, 2**24, 2**32 - 1], np.uint32)
    assert (c.from_planes(c.planes(values)) == values).all()
    assert c.from_planes(c.planes(values[:0])).size == 0


def test_windows_stop_at_breaks():
    assert c.windows(np.array([1, 2, 3, 0, 4, 5, 0, 6]), 3).tolist() == [[1, 2, 3], [2, 3, 0], [4, 5, 0]]
    assert c.windows(np.array([1]), 5).tolist() == []
