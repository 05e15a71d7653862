"""Token counts by a two-tier map-side lookup.

A sentence-piece BPE model whose pieces hold the space mark only at their start never merges across the boundary
before a run of spaces, so a text's token count is the sum over its pre-tokens (a run of spaces with the word after
it).  Tier one is a broadcast hash table of the corpus's most frequent pre-tokens and their lengths, gathered as
bounded per-partition summaries; tier two is a cache in each Python worker, filled by encoding the misses of a batch
together.  No pre-token is shuffled: only the summaries are, and they steer speed alone, never the counts.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare, texts, worker_cache

#: Entries each partition reports, entries broadcast, characters of the longest such entry, entries of a worker's cache.
SUMMARY_ENTRIES = 1024
TABLE_ENTRIES = 32768
ENTRY_CHARS = 48
CACHE_ENTRIES = 400_000
#: A partition's running counter is cut back to half when it reaches this size.
COUNTER_ENTRIES = 200_000

MARK = "▁"
RUNS = re.compile(r" *[^ ]+| +$")

_models: dict[str, object] = {}


def model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text without their first space mark; a trailing run of k spaces gives k - 1 spaces and a mark."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    # The model puts one mark before the text, so every pre-token begins with at least one space.
    return [run[1:] if run.strip(" ") else MARK + run[1:] for run in RUNS.findall(" " + text)]


def encode_lengths(path: str, words: list[str]) -> list[int]:
    """Lengths of pre-tokens: the encoder adds the mark taken off; a run of spaces alone is encoded as it is."""
    spaces = [w.startswith(MARK) for w in words]
    sizes = [len(x) for x in model(path).encode(["" if s else w for w, s in zip(words, spaces, strict=True)], num_threads=1)]
    for i, alone in enumerate(spaces):
        if alone:
            # "x" followed by k spaces, less the tokens of "x".
            sizes[i] = len(model(path).encode("x" + " " * len(words[i]))) - len(model(path).encode("x"))
    return sizes


def frequent_pretokens(docs: DataFrame) -> dict[str, int]:
    """The corpus's most frequent pre-tokens, from bounded summaries of every partition."""

    def summarise(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in texts(batch):
                counts.update(pretokens(text))
                if len(counts) > COUNTER_ENTRIES:
                    counts = Counter(dict(counts.most_common(COUNTER_ENTRIES // 2)))
        top = [(w, n) for w, n in counts.most_common(SUMMARY_ENTRIES) if len(w) <= ENTRY_CHARS and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    summaries = docs.select("text").mapInArrow(summarise, "word string, n long")
    top = summaries.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE_ENTRIES)
    return {r["word"]: r["n"] for r in top.collect()}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every text.

    A null or empty text counts zero bytes and zero tokens; repeated rows and null ids are kept as they come; an empty
    table gives no rows.  Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    words = list(frequent_pretokens(docs))
    sent = spark.sparkContext.broadcast(dict(zip(words, encode_lengths(model_path, words), strict=True)))

    def count(batches):
        frequent = sent.value
        cache = worker_cache("token_counts", model_path)
        for batch in batches:
            docs_here = texts(batch)
            split = [pretokens(t) for t in docs_here]
            missing = set().union(*split) - frequent.keys()
            long = [w for w in missing if len(w) > ENTRY_CHARS]
            missing.difference_update(long)
            missing -= cache.keys()
            if len(cache) + len(missing) > CACHE_ENTRIES:
                cache.clear()
                missing = set().union(*split) - frequent.keys() - set(long)
            new = list(missing)
            cache.update(zip(new, encode_lengths(model_path, new), strict=True))
            once = dict(zip(long, encode_lengths(model_path, long), strict=True))
            totals = []
            for words_here in split:
                # The frequent table answers first; None marks what the worker's tier holds.
                sizes = list(map(frequent.get, words_here))
                if None in sizes:
                    sizes = [n if n is not None else cache[w] if w in cache else once[w] for n, w in zip(sizes, words_here, strict=True)]
                totals.append(sum(sizes))
            n_bytes = [len(t.encode()) for t in docs_here]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column(batch, "doc_id"), pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
