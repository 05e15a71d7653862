"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary training texts each get an interpolated Kneser-Ney model of the characters of their words, up to
five at a time.  The two lowest orders are shared: they count both classes together, so an expression that is rare in
either class falls back to the same probability in both.  A word's evidence is its log-likelihood under the toxic
model less that under the ordinary one.  Documents are compared on length-normalised evidence: the mean over words, and
the mean of what stands out from the document's own median word by a margin (the median cancels the class's mixture of
languages).  A logistic curve, fitted on training rows kept out of the counts, maps these to a score from 0 to 1.

Counts, continuation counts, discounts and probabilities of all n-grams are tables, keyed by 64-bit hashes of whole code
points; what is gathered grows with the training texts and nothing is cut.  The weightiest rows are broadcast, up to a
bound, with a filter of the others' keys; a word that may need others is scored by a join.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import U64, column, ints, materialise, mix64, prepare, tidied, worker_cache

ORDER = 5
SHARED_ORDERS = 2
DISCOUNT = 0.75
START, END = 1, 2
#: Rows of the model that are broadcast at most, 12 bytes each: the weightiest.  The others stay a table, which is joined
#: with the words that need them.
HEAD_ROWS = 3_000_000
#: About one training row in CALIBRATION_PART fits the curve, CALIBRATION_ROWS of them at most; with fewer than
#: LEAST_CALIBRATION, or one class, counted rows fit it.
CALIBRATION_PART = 6
CALIBRATION_ROWS = 20_000
LEAST_CALIBRATION = 20
MARGINS = (2.0, 3.0)
CACHE_ENTRIES = 150_000
CACHE_CHARS = 48
GROUP_CHARS = 50_000

WORD = re.compile(r"[^\W_]+")
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], U64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at every character event of the words, for the orders 1 .. ORDER (0 where the word
    has begun later); hashes of their contexts, the n-gram without its last character; and the event's word.

    Code points count whole.  A context of order n is the gram of order n - 1 that ends one character earlier.
    """
    text = chr(START) + (chr(END) + chr(START)).join(words) + chr(END)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    starts = codes == START
    index = np.cumsum(starts) - 1
    grams = np.zeros((ORDER + 1, len(codes)), U64)
    total, alive = np.zeros(len(codes), U64), np.ones(len(codes), bool)
    for n in range(1, ORDER + 1):
        # The character n - 1 places back counts while the word has not started after it.
        back = n - 1
        total[back:] += (codes[: len(codes) - back] + U64(1)) * PLACES[back]
        alive[:back] = False
        grams[n] = np.where(alive, mix64(total + U64(n)) | U64(1), U64(0))
        alive[back:] &= ~starts[: len(codes) - back]
    contexts = np.zeros_like(grams)
    contexts[1:, 1:] = grams[:-1, :-1]
    contexts[1] = 2
    contexts[grams == 0] = 0
    events = ~starts
    return grams[:, events], contexts[:, events], index[events]


def groups_of(words: list[str]):
    """Words in groups of about GROUP_CHARS characters: what is worked out of them takes some hundred bytes a character."""
    group, size = [], 0
    for word in words:
        group.append(word)
        size += len(word) + 1
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def gram_counts(train: DataFrame) -> DataFrame:
    """g1 .. g5, c2 .. c5, ordinary and toxic: the longest n-gram of every event with its suffixes and contexts, and how
    often it comes in either class, over all training texts (text, toxic); summed in each partition first."""
    names = [*(f"g{n}" for n in range(1, ORDER + 1)), *(f"c{n}" for n in range(2, ORDER + 1)), "ordinary", "toxic"]

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def emit():
            # Words in order of their letters share n-grams with their neighbours.
            every = sorted(counts[0].keys() | counts[1].keys())
            for words in groups_of(every):
                grams, contexts, index = hashed(words)
                weights = [np.fromiter((c[w] for w in words), np.float64, len(words))[index] for c in counts]
                # Equal longest grams have equal suffixes and contexts.
                longest = grams[(grams > 0).sum(0), np.arange(grams.shape[1])]
                _, first, inverse = np.unique(longest, return_index=True, return_inverse=True)
                columns = [*grams[1:, first], *contexts[2:, first]]
                sums = [np.bincount(inverse, w, len(first)).astype(np.int64) for w in weights]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns] + [pa.array(x) for x in sums], names)
            counts[0].clear()
            counts[1].clear()

        for batch in batches:
            for text, toxic in zip(column(batch, "text"), column(batch, "toxic"), strict=True):
                counts[1 if toxic else 0].update(words_of(text))
            if len(counts[0]) + len(counts[1]) > CACHE_ENTRIES:
                yield from emit()
        yield from emit()

    rows = train.select("text", "toxic").mapInArrow(tidied(run), ", ".join(f"{c} long" for c in names))
    return rows.groupBy(*names[:-2]).agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def model_rows(counts: DataFrame) -> DataFrame:
    """key, value and weight of the Kneser-Ney models of both classes, as a table: the log-likelihood ratio of every
    n-gram above the shared orders, and that of falling back from every context (keys of contexts are turned over).

    Every n-gram counted is in it, whatever its count, and in the continuation counts of the orders below.  A lower
    order counts the distinct characters before a gram, and plainly where the word starts.
    """
    counts = materialise(counts, "gram-counts")
    levels, above = {}, None
    for n in range(ORDER, 0, -1):
        chain = [*(f"g{k}" for k in range(1, n)), *(f"c{k}" for k in range(2, n + 1))]
        gram = F.col(f"g{n}")
        rows = counts.where(gram != 0)
        if n < ORDER:
            rows = rows.where(F.col(f"g{n + 1}") == 0)
        rows = rows.select(gram.alias("gram"), *chain, F.col("ordinary").alias("v0"), F.col("toxic").alias("v1"))
        if above is not None:
            kinds = [F.when(F.col(v) > 0, 1).otherwise(0).cast("long").alias(v) for v in ("v0", "v1")]
            rows = rows.unionByName(above.select(F.col(f"g{n}").alias("gram"), *chain, *kinds))
        rows = rows.groupBy("gram").agg(*[F.first(c).alias(c) for c in chain], F.sum("v0").alias("v0"), F.sum("v1").alias("v1"))
        levels[n] = above = materialise(rows, "grams")

    found, lower = [], None
    for n in range(1, ORDER + 1):
        rows = levels[n].withColumn("context", F.col(f"c{n}") if n > 1 else F.lit(2).cast("long")).withColumn("weight", F.col("v0") + F.col("v1"))
        if n <= SHARED_ORDERS:
            rows = rows.withColumns({"v0": F.col("weight"), "v1": F.col("weight")})
        sums = [x for k in (0, 1) for x in (F.sum(f"v{k}").alias(f"total{k}"), F.sum(F.when(F.col(f"v{k}") > 0, 1).otherwise(0)).alias(f"kinds{k}"))]
        contexts = rows.groupBy("context").agg(*sums, F.sum("weight").alias("weight"))
        spared = {k: F.when(F.col(f"total{k}") > 0, F.least(F.lit(1.0), DISCOUNT * F.col(f"kinds{k}") / F.col(f"total{k}"))).otherwise(1.0) for k in (0, 1)}
        contexts = materialise(contexts.select("context", "weight", "total0", "total1", spared[0].alias("spared0"), spared[1].alias("spared1")), "contexts")
        rows = rows.join(contexts.drop("weight"), "context")
        if lower is None:
            base = 1.0 / (levels[1].count() + 1)
            rows = rows.withColumns({"b0": F.lit(base), "b1": F.lit(base)})
        else:
            rows = rows.join(lower.select(F.col("gram").alias(f"g{n - 1}"), F.col("p0").alias("b0"), F.col("p1").alias("b1")), f"g{n - 1}")
        p = [(F.greatest(F.col(f"v{k}") - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"total{k}").cast("double"), F.lit(1e-9)) + F.col(f"spared{k}") * F.col(f"b{k}")).alias(f"p{k}") for k in (0, 1)]
        lower = materialise(rows.select("gram", "weight", *p), "probabilities")
        if n > SHARED_ORDERS:
            found.append(lower.select(F.col("gram").alias("key"), (F.log("p1") - F.log("p0")).cast("float").alias("value"), "weight"))
            found.append(contexts.select(F.bitwise_not(F.col("context") + n).alias("key"), (F.log("spared1") - F.log("spared0")).cast("float").alias("value"), "weight"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return materialise(whole, "model")


def context_keys(contexts: np.ndarray, n: int) -> np.ndarray:
    return ~(contexts + U64(n))


class EvidenceModel:
    """The part of the model that is broadcast, in sorted arrays, and a filter of the keys of the rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, rest: bloom.BlockedBloom | None = None):
        order = np.argsort(keys.view(U64))
        self.keys, self.values, self.rest = keys.view(U64)[order], values[order].astype(np.float32), rest
        self.name = uuid.uuid4().hex

    def _find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, whether they are held, and whether they may be among the rest."""
        if not len(self.keys):
            held = np.zeros(len(wanted), bool)
            values = np.zeros(len(wanted))
        else:
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            held = self.keys[at] == wanted
            values = np.where(held, self.values[at], 0.0)
        unsure = np.zeros(len(wanted), bool)
        if self.rest is not None and len(wanted):
            out = np.flatnonzero(~held)
            unsure[out] = self.rest.might_hold(mix64(wanted[out]))
        return values, held, unsure

    def evidence(self, words: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word; nan where the rest of the model may have a say."""
        return np.concatenate([np.zeros(0), *(self._evidence(group) for group in groups_of(words))])

    def _evidence(self, words: list[str]) -> np.ndarray:
        grams, contexts, index = hashed(words)
        total, left = np.zeros(grams.shape[1]), np.arange(grams.shape[1])
        for n in range(ORDER, SHARED_ORDERS, -1):
            here = left[grams[n][left] != 0]
            values, held, unsure = self._find(grams[n][here])
            total[here] += np.where(unsure, np.nan, values)
            out = here[~held & ~unsure]
            values, _, doubt = self._find(context_keys(contexts[n][out], n))
            total[out] += np.where(doubt, np.nan, values)
            alive = np.ones(len(total), bool)
            alive[here[held | unsure]] = False
            left = left[alive[left]]
        return np.bincount(index, total, len(words))


def word_evidence(words: DataFrame, model: DataFrame) -> DataFrame:
    """word and its evidence under the whole model: a join of the words' n-grams and contexts with the model's rows."""

    def run(batches):
        for batch in batches:
            for names in groups_of(column(batch, "word")):
                grams, contexts, index = hashed(names)
                for n in range(ORDER, SHARED_ORDERS, -1):
                    at = np.flatnonzero(grams[n])
                    for kind, keys in ((0, grams[n][at]), (1, context_keys(contexts[n][at], n))):
                        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in index[at]], pa.string()), pa.array(at), pa.array(np.full(len(at), 2 * n + kind)), pa.array(keys.view(np.int64))], ["word", "event", "role", "key"])

    rows = words.mapInArrow(tidied(run), "word string, event long, role long, key long").join(model.select("key", "value"), "key")
    value = {(n, kind): F.max(F.when(F.col("role") == 2 * n + kind, F.col("value"))) for n in range(SHARED_ORDERS + 1, ORDER + 1) for kind in (0, 1)}
    events = rows.groupBy("word", "event").agg(*[v.alias(f"v{n}_{kind}") for (n, kind), v in value.items()])
    total = F.lit(0.0)
    for n in range(SHARED_ORDERS + 1, ORDER + 1):
        total = F.when(F.col(f"v{n}_0").isNotNull(), F.col(f"v{n}_0").cast("double")).otherwise(total + F.coalesce(F.col(f"v{n}_1"), F.lit(0.0)))
    return events.groupBy("word").agg(F.sum(total).alias("evidence"))


def split_model(model: DataFrame, most: int) -> tuple[EvidenceModel, bool]:
    """The model's weightiest rows, `most` at most, and a bounded filter of the keys of all others, if there are any."""
    size = F.floor(F.log2(F.greatest(F.col("weight"), F.lit(1)).cast("double"))).cast("int")
    sizes = {r["size"]: r["n"] for r in model.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
    least, n = max(sizes, default=0) + 1, 0
    while least - 1 in range(max(sizes, default=-1) + 1) and n + sizes.get(least - 1, 0) <= most:
        least -= 1
        n += sizes.get(least, 0)
    head = model.where(size >= least).select("key", "value").toArrow()
    n_rest, rest = sum(sizes.values()) - n, None
    if n_rest:
        rest = bloom.build(model.where(size < least).select("key"), n_rest, lambda batch: mix64(ints(batch, "key").astype(np.int64).view(U64)))
    return EvidenceModel(head.column("key").to_numpy().astype(np.int64), head.column("value").to_numpy(), rest), bool(n_rest)


def features(evidence: np.ndarray) -> np.ndarray:
    """Length-normalised evidence of a document's words: its mean, and the means of what stands out from its median."""
    n = len(evidence)
    if not n:
        return np.zeros(len(MARGINS) + 3)
    clear = evidence - np.median(evidence)
    top = np.partition(clear, n - 2)[-2:].mean() if n > 2 else clear.mean()
    beyond = [np.log(np.maximum(clear - m, 0).mean() + 1e-3) - np.log(1e-3) for m in MARGINS]
    return np.array([*beyond, evidence.mean(), clear.mean(), top])


def featured(docs: DataFrame, model, keep: list[str], whole: DataFrame | None = None) -> DataFrame:
    """The columns keep (long or int), and features of the text, of every row.

    model is the broadcast part.  Where it is not all of the model, whole is: words that the rest may have a say in are
    then scored by a join with it, and only documents that hold such words are put together anew.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + ["evidence array<double>", "open array<string>", "features array<double>"])

    def run(batches):
        held: EvidenceModel = model.value
        cache = worker_cache("toxicity", held.name)
        for batch in batches:
            split = [words_of(t) for t in column(batch, "text")]
            wanted = set().union(*split) if split else set()
            long = [w for w in wanted if len(w) > CACHE_CHARS]
            wanted.difference_update(long)
            missing = wanted - cache.keys()
            if len(cache) + len(missing) > CACHE_ENTRIES:
                cache.clear()
                missing = wanted
            new = list(missing)
            cache.update(zip(new, held.evidence(new).tolist(), strict=True))
            once = dict(zip(long, held.evidence(long).tolist(), strict=True))
            found, known, open_words = [], [], []
            for words in split:
                if long:
                    values = np.array([cache[w] if w in cache else once[w] for w in words], float)
                else:
                    values = np.fromiter(map(cache.__getitem__, words), float, len(words))
                unsure = np.isnan(values) if held.rest is not None else None
                if unsure is not None and unsure.any():
                    found.append(None)
                    known.append(values[~unsure].tolist())
                    open_words.append([words[i] for i in np.flatnonzero(unsure)])
                else:
                    found.append(features(values).tolist())
                    known.append(None)
                    open_words.append(None)
            many = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(known, many), pa.array(open_words, pa.list_(pa.string())), pa.array(found, many)], [*keep, "evidence", "open", "features"]
            )

    rows = docs.select(*keep, "text").mapInArrow(tidied(run), schema)
    if whole is None:
        return rows.select(*keep, "features")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "evidence")
    waiting = rows.where("open is not null").select("row", F.explode("open").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    scores = materialise(word_evidence(waiting.select("word").distinct(), whole), "word-evidence")
    values = waiting.join(scores, "word", "left").select("row", F.explode(F.array_repeat(F.coalesce("evidence", F.lit(0.0)), F.col("times").cast("int"))).alias("more")).groupBy("row").agg(F.collect_list("more").alias("more"))

    def finish(batches):
        for batch in batches:
            found = [features(np.array(a + b, float)).tolist() for a, b in zip(column(batch, "evidence"), column(batch, "more"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(found, pa.list_(pa.float64()))], [*keep, "features"])

    joined = rows.where("open is not null").join(materialise(values, "open-evidence"), "row").select(*keep, "evidence", "more")
    closed = joined.mapInArrow(tidied(finish), ", ".join([f"{c} {kinds[c]}" for c in keep] + ["features array<double>"]))
    return rows.where("open is null").select(*keep, "features").unionByName(closed)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2):
    """Mean and scale of the features, and logistic weights, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], 1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the labelled documents.  A Bloom filter of the labelled ids keeps the other texts
    out of the join's shuffle."""
    spark = docs.sparkSession
    id_hashes = lambda batch: mix64(ints(batch, "doc_id").astype(np.int64).view(U64))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    listed = bloom.build(known.select("doc_id"), labels.count(), id_hashes)
    sent = spark.sparkContext.broadcast((listed.n_blocks, listed.data.tobytes()))

    def run(batches):
        mine = bloom.BlockedBloom(*sent.value)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if batch.num_rows:
                yield batch.filter(pa.array(mine.might_hold(id_hashes(batch))))

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(tidied(run), "doc_id long, text string").join(known, "doc_id")


def score_documents(docs: DataFrame, labels: DataFrame, head_rows: int = HEAD_ROWS, keep: str = "doc_id") -> DataFrame:
    """The column `keep` (long) and the score of every document; labels (doc_id, toxic) are the rows to learn from.

    Scores run from 0 to 1, higher where toxic is likelier.  Null and empty texts get the score of a text without
    evidence.  Where labels hold only one class, every score is 0 or 1 accordingly (0 without labels).  Repeated
    labels of one id count as toxic if any is; repeated and null ids of documents are scored row by row.  An empty
    table gives no rows.  head_rows bounds what is broadcast, and changes no score.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(keep).cast("long").alias(keep)] if keep != "doc_id" else []))
    train = materialise(labelled(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))), "labelled")
    classes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return docs.select(keep, F.lit(1.0 if classes.get(1) else 0.0).alias("score"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION_PART))
    model = model_rows(gram_counts(train.where(part != 0)))
    head, split = split_model(model, head_rows)
    sent, whole = spark.sparkContext.broadcast(head), model if split else None

    share = min(1.0, CALIBRATION_ROWS * CALIBRATION_PART / sum(classes.values()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    rows = featured(train.where(part == 0).where(drawn < share * 1_000_000), sent, ["toxic"], whole).collect()
    if len(rows) < LEAST_CALIBRATION or len({r["toxic"] for r in rows}) < 2:
        rows = featured(train.where(drawn < share / CALIBRATION_PART * 1_000_000) if share < 1 else train, sent, ["toxic"], whole).collect()
    rows.sort(key=lambda r: (r["toxic"], r["features"]))
    x, y = np.array([r["features"] for r in rows], float), np.array([r["toxic"] for r in rows], float)
    mean, scale, weights = fit_curve(x, y)
    scored = featured(docs, sent, [keep], whole)
    terms = [F.lit(float(w)) * (F.col("features")[i] - F.lit(float(m))) / F.lit(float(s)) for i, (w, m, s) in enumerate(zip(weights[1:], mean, scale, strict=True))]
    total = F.lit(float(weights[0]))
    for term in terms:
        total = total + term
    return scored.select(keep, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))).alias("score"))
