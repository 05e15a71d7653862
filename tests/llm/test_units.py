"""Parts of the operators against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from parcelmill.llm import bloom, line_dedup, mixing, ngram_join, packing, token_counts, toxicity  # noqa: E402
from parcelmill.llm.common import U64, mix64  # noqa: E402

ALPHABET = ["a", "b", "th", "é", " ", "  ", "\n", "\t", "\r", "▁", "日", "ß", "İ", "Σ", "ΑΣ", "'s", "'", "12", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "Word,", "word.", "...", "́", "H̱", "x" * 60, "\x1c", " ", "ﬁ", "🙂"]


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_pretoken_lengths_are_the_librarys():
    path = public_tokenizers.path("piece_bpe_32k.model")
    for text in strings(1500, 1):
        found = sum(token_counts.encode_lengths(path, token_counts.pretokens(text)))
        assert found == len(token_counts.model(path).encode(text)), repr(text)


def test_word_ids_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = strings(1500, 2)
    whole = [np.array(x.ids, "<u4").tobytes() for x in packing.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    for text, a, b in zip(texts, packing.encode_docs(path, texts), whole, strict=True):
        assert a == b, repr(text)


def test_look_alikes_of_added_tokens_stay_as_they_are():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a <|ENDOFTEXT|> b", "One <|EndOfText|>Two, É<|endoftext|>É\nTHREE", "A <| B |> C <|STARTOFTEXT|>"]
    whole = [np.array(x.ids, "<u4").tobytes() for x in packing.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    assert packing.encode_docs(path, texts) == whole
    assert np.frombuffer(whole[0], "<u4").tolist() == [320, 27, 347, 40786, 4160, 91, 285, 321]


def test_words_are_encoded_once_whatever_their_case_and_marks(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Größe, größe. GRÖSSE; \u201cbolder\u201d Größe!", "\u2013 Bolder, größe: BOLDER... bolder", "größe\nbolder"]
    whole = [np.array(x.ids, "<u4").tobytes() for x in packing.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    asked, encode = [], packing.id_bytes
    monkeypatch.setattr(packing, "id_bytes", lambda path, words: asked.extend(words) or encode(path, words))
    packing.worker_cache("packing", path).clear()
    assert packing.encode_docs(path, texts) == whole
    assert sorted(w for w in asked if any(c.isalpha() for c in w)) == ["bolder", "grösse", "größe", "\u201cbolder\u201d"]
    asked.clear()
    assert packing.encode_docs(path, texts[::-1]) == whole[::-1]
    assert not [w for w in asked if any(c.isalpha() for c in w)]


def test_a_full_cache_keeps_the_last_words_and_changes_no_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 5)
    packing.worker_cache("packing", path).clear()
    texts = strings(600, 4) + ["".join(map(chr, range(256))), " ".join(map(chr, range(256)))]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        assert packing.encode_docs(path, part) == [np.array(x.ids, "<u4").tobytes() for x in packing.tokenizer(path).encode_batch(part, add_special_tokens=False)]
        assert len(packing.worker_cache("packing", path)["stems"]) <= 5
    for text in ["one two three four", "one five six", "seven " + "x" * 60]:
        packing.encode_docs(path, [text])
    assert packing.worker_cache("packing", path)["stems"].to_pylist() == ["seven", "one", "five", "six", "two"]


def test_batches_are_encoded_together(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": ["x" * 10]}) for i in range(10)]
    assert [t["doc_id"].to_pylist() for t in packing.chunks(iter(batches))] == [[*range(10)]]
    monkeypatch.setattr(packing, "CHUNK_BYTES", 3 * batches[0].nbytes)
    assert [t["doc_id"].to_pylist() for t in packing.chunks(iter(batches))] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]
    assert list(packing.chunks(iter([]))) == []


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 60))), reverse=True)
        got = packing.best_fit_decreasing(np.array(sizes, np.int64), 64)[0].tolist()
        rooms: list[int] = []
        fits = []
        for s in sizes:
            open_rooms = [r for r in rooms if r >= s]
            if open_rooms:
                fits.append(min(open_rooms))
                rooms.remove(min(open_rooms))
            else:
                fits.append(64)
            rooms.append(fits[-1] - s)
        left = {}
        mine = []
        for s, q in zip(sizes, got, strict=True):
            mine.append(left.get(q, 64))
            left[q] = left.get(q, 64) - s
        assert mine == fits and all(v >= 0 for v in left.values())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randint(0, len(chars))
        kind = rng.random()
        if kind < 0.4 and chars:
            chars.pop(min(k, len(chars) - 1))
        elif kind < 0.7 and chars:
            chars[min(k, len(chars) - 1)] = rng.choice("abc")
        else:
            chars.insert(k, rng.choice("abc"))
    return "".join(chars)


def test_banded_distance():
    rng = random.Random(4)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b = edited(rng, a, rng.randint(0, 4))
        for most in (0, 1, 2, 3):
            assert line_dedup.within_edits(a, b, most) == (distance(a, b) <= most)
    for _ in range(12):
        a = "".join(rng.choice("ab") for _ in range(2600))
        b = edited(rng, a, rng.randint(1, 5))
        for most in (2, 4):
            assert line_dedup.within_edits(a, b, most) == (distance(a, b) <= most)


def test_segments_meet():
    """Lines within the threshold share a segment at a start that is probed."""
    rng = random.Random(14)
    for _ in range(3000):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 30)))
        edits = rng.randint(1, 4)
        b = edited(rng, a, rng.randint(1, edits))
        short, long = sorted((a, b), key=len)
        parts = [tuple(int(x[0]) for x in line_dedup.segment(np.array([len(short)]), edits, i)) for i in range(edits + 1)]
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(edits + 1)] and sum(q[1] for q in parts) == len(short)
        longer = len(long) - len(short)
        if distance(a, b) <= edits:
            assert any(short[s : s + n] == long[s + x : s + x + n] and s + x >= 0 for i, (s, n) in enumerate(parts) for x in line_dedup.probe_shifts(edits, longer, i))


def test_bloom_has_no_false_negatives_and_few_positives():
    keys = mix64(np.arange(1, 20_001, dtype=U64))
    held = bloom.BlockedBloom.sized(10_000)
    held.add(keys[:10_000])
    assert held.might_hold(keys[:10_000]).all()
    assert held.might_hold(keys[10_000:]).mean() < 0.01


def test_bitmap_bound_is_an_upper_bound():
    rng = np.random.default_rng(5)
    for n in (1, 3, 50, 900, 5000):
        a = np.unique(mix64(rng.integers(1, 1 << 60, n).astype(U64)))
        b = np.unique(np.concatenate([a[: n // 2], mix64(rng.integers(1, 1 << 60, n).astype(U64))]))
        x, y = ngram_join.words_of([ngram_join.bitmap(a)]), ngram_join.words_of([ngram_join.bitmap(b)])
        words = min(x.shape[1], y.shape[1])
        most = ngram_join.overlap_bound(ngram_join.fold(x, words), ngram_join.fold(y, words), np.array([len(a)]), np.array([len(b)]))[0]
        assert most >= len(np.intersect1d(a, b))


def test_prefixes_meet():
    """Sets over the threshold share a posted key: the smaller's index part and the larger's probe part."""
    rng = random.Random(6)
    for _ in range(3000):
        n = rng.randint(1, 40)
        x = set(rng.sample(range(100), n))
        y = set(x)
        for _ in range(rng.randint(0, n // 3 + 1)):
            y.discard(rng.choice(sorted(x)))
            y.add(rng.randint(0, 100))
        if not y or 100 * len(x & y) < 75 * len(x | y):
            continue
        small, large = sorted((x, y), key=len)
        assert set(sorted(small)[: ngram_join.index_size(len(small))]) & set(sorted(large)[: ngram_join.probe_size(len(large))])


def test_raking_a_matrix_meets_both_targets():
    rng = np.random.default_rng(7)
    totals = rng.integers(1, 1000, (5, 4)).astype(float)
    rows, columns = rng.dirichlet(np.ones(5)) * 100, rng.dirichlet(np.ones(4)) * 100
    found = totals * mixing.rake(totals, rows, columns)
    assert np.allclose(found.sum(1), rows) and np.allclose(found.sum(0), columns)


def test_topics_part_vocabularies():
    rng = random.Random(19)
    words = [[f"{x}word{k}" for k in range(30)] for x in ("alpha", "beta", "gamma")]
    texts = [" ".join(rng.choices(words[i % 3], k=40)) for i in range(300)]
    counts = mixing.place_counts([mixing.words_of(t) for t in texts], mixing.Places())
    idf, middle = mixing.fit_topics(counts)
    own = (mixing.vectors(counts, idf) @ middle.T).argmax(1)
    assert all(not set(own[i::3]) & set(own[j::3]) for i, j in ((0, 1), (0, 2), (1, 2)))


def kneser_ney(words, order, shared):
    """Plain dictionaries, for models of two classes: log-likelihood ratios of words."""
    import math
    from collections import Counter

    top = [Counter(), Counter()]
    for k in (0, 1):
        for w, n in words[k].items():
            x = "\x01" + w + "\x02"
            for i in range(1, len(x)):
                top[k][x[max(0, i - order + 1) : i + 1]] += n
    tables = {order: [Counter({g: n for g, n in top[k].items() if len(g) == order}) for k in (0, 1)]}
    for size in range(order - 1, 0, -1):
        tables[size] = [Counter(), Counter()]
        for k in (0, 1):
            for g in tables[size + 1][k]:
                tables[size][k][g[1:]] += 1
            for g, n in top[k].items():
                if len(g) == size:
                    tables[size][k][g] += n
    for size in range(1, shared + 1):
        tables[size] = [tables[size][0] + tables[size][1]] * 2
    sums = {s: [(Counter(), Counter()), (Counter(), Counter())] for s in tables}
    for s in tables:
        for k in (0, 1):
            for g, n in tables[s][k].items():
                sums[s][k][0][g[:-1]] += n
                sums[s][k][1][g[:-1]] += 1
    base = 1 / (len(tables[1][0]) + 1)

    def p(k, gram):
        found = base
        for s in range(1, len(gram) + 1):
            g = gram[-s:]
            total = sums[s][k][0][g[:-1]]
            if total:
                found = (max(tables[s][k][g] - 0.75, 0) + min(0.75 * sums[s][k][1][g[:-1]], total) * found) / total
        return found

    def ratio(w):
        x = "\x01" + w + "\x02"
        grams = [x[max(0, i - order + 1) : i + 1] for i in range(1, len(x))]
        return sum(math.log(p(1, g)) - math.log(p(0, g)) for g in grams)

    return ratio


def test_gram_hashes_are_of_whole_code_points():
    grams, contexts, index = toxicity.hashed(["ab", "日本語", "日本誤", "ab"])
    assert len(index) == 3 + 4 + 4 + 3 and (grams[:, :3] == grams[:, -3:]).all()
    assert (grams[1][[3, 4]] == grams[1][[7, 8]]).all() and grams[1][5] != grams[1][9]
    assert (contexts[2] == np.where(index >= 0, contexts[2], 0)).all() and contexts[3][5] == contexts[3][9]


def test_set_ids_are_of_sets():
    a = ngram_join.shingles("One two THREE four five six")
    b = ngram_join.shingles("one two three four five six")
    assert (a == b).all() and len(a) == 2
    assert len(ngram_join.shingles("one two")) == 1 and not len(ngram_join.shingles(" \n")) and not len(ngram_join.shingles(None))
    assert zlib.crc32(a.tobytes()) == zlib.crc32(b.tobytes())


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from parcelmill.llm.common import shared_dir

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("spark://host:7077", "hdfs://shared")) == "hdfs://shared"
