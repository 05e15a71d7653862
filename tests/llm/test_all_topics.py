"""Topics are fitted on every document."""

import random

import numpy as np
from pyspark.sql import functions as F

from parcelmill.llm import mixing


def test_topics_are_fitted_on_all_documents(spark):
    """6000 texts, dealt over three partitions."""
    rng = random.Random(5)
    words = [[f"{x}word{k}" for k in range(40)] for x in ("alpha", "beta", "gamma", "delta")]
    texts = [" ".join(rng.choices(words[i % 4], k=rng.randint(5, 40))) for i in range(6000)] + ["a b c", "", None]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").repartition(3)
    counts = mixing.place_counts([mixing.words_of(t) for t in texts], mixing.Places())
    held = counts[counts.any(1)]
    seen = spark.createDataFrame([(bytearray(b),) for b in mixing.sparse(held)], "d0 binary").repartition(3)
    idf, middle = mixing.fit_all_topics(seen)
    assert np.array_equal(idf, np.log((6000 + 1) / ((held > 0).sum(0) + 1)))
    got = {r["doc_id"]: (r["topic"], r["n_tokens"]) for r in mixing.mix(docs).collect()}
    own = (mixing.units(counts, idf) @ np.rint(middle * mixing.STEPS).T).argmax(1)
    for i, t in enumerate(texts):
        assert got[i] == (str(own[i]) if counts[i].any() else mixing.MISSING, len(mixing.words_of(t)))
    by = {(t, i % 4) for i, (t, _) in got.items() if t != mixing.MISSING}
    assert len({t for t, _ in by}) == len(by)


def test_no_texts_have_no_topics(spark):
    docs = spark.createDataFrame([(1, None, "s", "en"), (2, "a b", "s", "en")], "doc_id long, text string, source string, lang string")
    assert {r["topic"] for r in mixing.mix(docs).collect()} == {mixing.MISSING} and mixing.mix(docs.limit(0)).count() == 0
