"""Connected components of long chains, stars and odd links."""

import random

from parcelmill.llm.components import connected


def test_long_chain_settles(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 1000)
    star = [(20_000, i) for i in range(20_001, 20_200)]
    links = [*zip(ids, ids[1:], strict=False), *star, (30_001, 30_000), (30_000, 30_001), (40_000, 40_000)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**dict.fromkeys(ids, min(ids)), **dict.fromkeys(range(20_000, 20_200), 20_000), 30_000: 30_000, 30_001: 30_000}
    assert got == want
