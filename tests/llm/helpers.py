"""Small tables for the training-data operators' tests."""

import random

WORDS = [a + b + c for a in ("th", "re", "lo", "mi") for b in ("an", "er", "is") for c in ("ing", "ed", "ly", "on")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows, extra=""):
    """rows: (doc_id, text) with a language, a source and a length."""
    full = [(i, t, "en" if i is None or i % 2 else "fr", "s" + str((i or 0) % 3), len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def odd_rows(seed=0):
    """Nulls, empty and blank texts, repeats, ties, a long text, odd characters."""
    rng = random.Random(seed)
    long = sentence(rng, 20_000)
    base = sentence(rng, 60)
    return [(0, base), (1, base), (2, base + " tail"), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (8, "ONE two"), (9, long), (10, long), (11, "é Ünï 日本語 <s> </s> <unk> <|endoftext|> ▁▁ a  b\n\n c\r\nd\x0be"), (None, base), (2, base + " tail")]
