"""Encoding and decoding against the library itself."""

import hashlib
import random

import pytest
from helpers import documents, odd_rows

public_tokenizers = pytest.importorskip("public_tokenizers")

from parcelmill.llm import piece_codec  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def fuzzed(n, seed=1):
    rng = random.Random(seed)
    parts = [*"aaabbbeeett  \n\t▁.,<>/0123456789éüßあ漢́\x00\U0001f600", "the", "ing", "  ", "    ", "<s>", "er", "aa", "--", "==", "//", " \n", "\n\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_and_decoded_texts_are_the_librarys(library):
    cases = fuzzed(6000) + [c * n for c in "ae-=.*/#01 \n" for n in range(1, 140, 3)] + [t or "" for _, t in odd_rows()]
    for text, (ids, back) in zip(cases, piece_codec.encode_texts(PATH, cases), strict=True):
        want = library.encode(text)
        assert ids == ",".join(map(str, want)), text
        assert back == library.decode(want), text


def test_every_piece_alone_and_side_by_side(library):
    found = piece_codec.codec(PATH)
    pieces = [p for p in found.v.normal if not any(t in p for t in found.tied)]
    assert found.encode_all(pieces) == [found._merge(p) for p in pieces]
    rng = random.Random(2)
    pairs = ["".join(rng.sample(pieces, 3))[:60] for _ in range(5000)]
    pairs = [p for p in pairs if not any(t in p for t in found.tied)]
    merged = [found._merge(p) for p in pairs]
    assert [found._backtrack(p) for p in pairs] == merged
    assert found.encode_side_by_side(pairs) == merged


def test_compatible_neighbours_are_those_that_merging_leaves_apart():
    found = piece_codec.codec(PATH)
    rng = random.Random(3)
    ids = [i for p, i in found.whole.items() if not any(t in p for t in found.tied)]
    for _ in range(4000):
        a, b = rng.choice(ids), rng.choice(ids)
        text = found.v.pieces[a] + found.v.pieces[b]
        if not any(t in text for t in found.tied):
            assert found._compatible(a, b) == (found._merge(text) == [a, b])


def test_a_long_stretch_without_spaces(library):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(50_000))
    (ids, back), = piece_codec.encode_texts(PATH, [text])
    assert ids == ",".join(map(str, library.encode(text))) and back == text


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(piece_codec, "PAIR_ENTRIES", 20)
    cases = fuzzed(400, 5)
    for a in range(0, 400, 40):
        for text, (ids, _) in zip(cases[a : a + 40], piece_codec.encode_texts(PATH, cases[a : a + 40]), strict=True):
            assert ids == ",".join(map(str, library.encode(text)))


def test_documents_of_any_kind(spark, library):
    """Null and empty texts have no ids; repeated rows and null ids stay; further columns may have any name."""
    docs = documents(spark, odd_rows()).withColumnRenamed("source", "n_tokens").withColumnRenamed("lang", "a.b")
    want = sorted((str(i), len(library.encode(t or "")), hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest(), hashlib.sha256(library.decode(library.encode(t or "")).encode()).hexdigest()) for i, t in odd_rows())
    got = piece_codec.digest_documents(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    whole = piece_codec.encode_documents(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in whole) == sorted((str(i), tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in odd_rows())
    assert piece_codec.digest_documents(docs.limit(0), PATH).count() == 0
