"""URL filter: a blocked Bloom filter over listed keys passes possible hits to an exact hash join.

A listed key is a canonical address prefix, ``host + path``.  A key fits a page's url when its host is the url's
host or a parent domain of it and the url's path starts with the key's path; the longest fitting key decides.
Every url is therefore expanded, map-side, into (parent domain, path prefix) candidates whose path lengths occur in
the list.  The filter, 512-bit blocks with eight probes each, drops nearly all of them before the shuffle; the join
on the full key removes the false positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import U64, column, materialise, prepare

#: Path lengths in the list are broadcast only up to this many; past it, every prefix of a path is probed.
MAX_LENGTHS = 4096


def key_hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), U64, len(keys))


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path of the url; both are empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    lower = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lower, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def candidates(host: str, path: str, lengths: np.ndarray | None) -> tuple[list[tuple[int, int]], list[int]]:
    """(start of the parent domain in host, length of the path prefix) of every key that could fit, and the keys' hashes.

    A path's prefixes are hashed one after the other, each from the one before it: no prefix is written out.
    """
    starts, at = [0], host.find(".")
    while at >= 0:
        starts.append(at + 1)
        at = host.find(".", at + 1)
    sizes = range(len(path) + 1) if lengths is None else lengths[lengths <= len(path)].tolist()
    places, hashes = [], []
    for start in starts:
        running, done = xxhash.xxh64(f"{host[start:]}\u0001"), 0
        for size in sizes:
            running.update(path[done:size].encode())
            done = size
            places.append((start, size))
            hashes.append(running.intdigest())
    return places, hashes


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, the longest fitting rule (host + path) or null, and the verdict.

    rules: host, path, verdict.  A null or malformed url, or one that no rule fits, gets ``default``.  Of fitting
    rules of equal length the one with the longer host wins, then the smaller verdict string; repeated rules count
    once.  Pages keep their multiplicity; an empty page or rule table gives no or only default verdicts.
    """
    spark = pages.sparkSession
    prepare(spark)
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat(F.col("host"), F.lit("\u0001"), F.col("path")).alias("listed_key"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict"
    )
    rules = rules.groupBy("listed_key", "host_size", "rule").agg(F.min("verdict").alias("verdict"))
    listed = bloom.build(rules.select("listed_key"), rules.count(), lambda batch: key_hashes(column(batch, "listed_key")))
    found = [r[0] for r in rules.select((F.length("rule") - F.col("host_size")).alias("n")).distinct().orderBy("n").limit(MAX_LENGTHS + 1).collect()]
    sent = spark.sparkContext.broadcast((listed.n_blocks, listed.data.tobytes(), np.array(found, np.int64) if len(found) <= MAX_LENGTHS else None))

    parsed = with_host_path(pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url")), "url").select("page_id", "host", "path")

    def probe(batches):
        n_blocks, data, lengths = sent.value
        mine = bloom.BlockedBloom(n_blocks, data)
        for batch in batches:
            rows: list[list[str]] = [[], [], []]
            for host, path in dict.fromkeys(zip(column(batch, "host"), column(batch, "path"), strict=True)):
                places, hashes = candidates(host, path, lengths) if host else ([], [])
                for i in np.flatnonzero(mine.might_hold(np.array(hashes, U64))):
                    start, size = places[i]
                    for values, value in zip(rows, (host, path, f"{host[start:]}\u0001{path[:size]}"), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.string()) for r in rows], ["host", "path", "listed_key"])

    # Distinct (host, path) pairs carry the hits, so a url that a third of the pages share is judged once.
    hits = parsed.select("host", "path").mapInArrow(probe, "host string, path string, listed_key string").distinct()
    best = (
        hits.join(rules, "listed_key")
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), -F.col("host_size"), F.col("verdict"))).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    # Written apart from the join, so that a hot url's pages can be split over tasks there.
    best = materialise(best, "url-verdicts")
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
