"""The operators on small tables, against brute force, and on odd rows."""

import math
import random
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, held_against_sql
from pyspark.sql import functions as F

from helpers import WORDS, documents, odd_rows, sentence
from test_units import kneser_ney

public_tokenizers = pytest.importorskip("public_tokenizers")

from parcelmill.llm import language_id, line_dedup, mixing, ngram_join, packing, permutation_index, queries, token_counts, topk_search, toxicity, url_filter  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, spark, duck):
    held_against_sql(queries.QUERIES[name], queries.ORACLES[name], spark, duck)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_empty_tables(name, spark, tmp_path):
    for t in ("documents", "embeddings", "pages", "labels", "clicks", "sale_lines", "items"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


# --- nearest neighbours --------------------------------------------------------------------------------------------


def test_neighbours_equal_brute_force_on_a_small_table(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8))
    vectors[50:80] = vectors[50]  # copies: ties by id
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 8, 0), (903, [None] + [1.0] * 7, 0), (904, [float("nan")] * 8, 0), (905, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (906, [1.0, 2.0], 0), (907, [1.0, 2.5], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in permutation_index.search(df, df.where("vec_id % 10 = 0 or vec_id > 899"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 300, 10), 906, 907}
    for q in range(0, 300, 10):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(300), d)).tolist() if i != q][:5]
        assert [v for v, _ in got[q]] == best
        assert np.allclose([s for _, s in got[q]], d[best])
    assert [v for v, _ in got[906]] == [907]


def random_vectors(rng, n):
    return rng.normal(size=(n, 64))


def clustered_vectors(rng, n):
    centres = rng.normal(size=(40, 64))
    return centres[rng.integers(0, 40, n)] + 0.35 * rng.normal(size=(n, 64))


@pytest.mark.parametrize("make", [random_vectors, clustered_vectors])
def test_neighbour_recall_on_a_full_shard(make):
    """With the query's own settings: a few hundredths of the vectors are reranked."""
    rng = np.random.default_rng(2)
    vectors = make(rng, permutation_index.SHARD_VECTORS)
    pivots = permutation_index.spread(vectors[rng.choice(len(vectors), permutation_index.PIVOT_SAMPLE, replace=False)], permutation_index.PIVOTS)
    files, ids = permutation_index.PivotFiles(vectors, pivots, permutation_index.ORDER), np.arange(len(vectors))
    hits = reranked = 0
    asked = list(range(0, len(vectors), 163))
    for q in asked:
        order = permutation_index.orders(vectors[q : q + 1], pivots, files.order)[0]
        reranked += len(files.candidates(order, permutation_index.CANDIDATE_SHARE, 100))
        found, _ = permutation_index.nearest(files, ids, vectors, q, vectors[q], order, 10, permutation_index.CANDIDATE_SHARE)
        d = ((vectors - vectors[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(found.tolist()) & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * len(asked)) >= 0.9
    assert reranked / (len(asked) * len(vectors)) < 0.05


def test_neighbours_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD_VECTORS", 1500)
    monkeypatch.setattr(permutation_index, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(3)
    vectors = random_vectors(rng, 6000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in permutation_index.search(df, df.where("vec_id % 100 = 0"), k=10).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 6000, 100):
        d = ((vectors - vectors[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.9


def test_nearness_is_the_footrule():
    rng = np.random.default_rng(4)
    vectors, pivots = rng.normal(size=(200, 6)), rng.normal(size=(30, 6))
    files = permutation_index.PivotFiles(vectors, pivots, 12)
    found = permutation_index.orders(vectors, pivots, 12)
    place = lambda order, p: int(np.flatnonzero(order == p)[0]) if p in order else 12
    for q in range(5):
        footrule = [sum(abs(place(found[q], p) - place(found[v], p)) for p in range(30)) for v in range(200)]
        assert (2 * (12 * 13 // 2) - np.array(footrule) == 2 * files.nearness(found[q])).all()


def test_queries_of_one_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, [0.1, 0.9])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in permutation_index.search(df, df.where("vec_id = 1"), k=2).collect())
    assert got == [(1, 2), (1, 3), (2, 2), (2, 3)]


# --- urls ----------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("org", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "http://notexample.org/es/", "http://x.com/de/#/fr/", "http://x.com", "example.org/es/", None, "", "ftp://org/", "http://x.net/a", "http://example.org/en/2", "a://b.example.org?/es/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "y")], "page_id long, url string, rule string")
    rows = url_filter.filter_urls(pages, rules).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow")
    assert got[3] == ("x.com", "/de/", "com/de/", "block")
    assert got[4] == ("x.com", "", None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2] == "org/" and got[9][2:] == (None, "allow") and got[10][2] == "org/" and got[11] == ("b.example.org", "", None, "allow")


def test_url_filter_of_many_keys(spark):
    rules = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(0, 6000, 7).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit("/p")).alias("url"))
    got = url_filter.filter_urls(pages, rules)
    assert got.where("verdict = 'block' and page_id >= 3000 or verdict = 'allow' and page_id < 3000").count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == pages.count()


@pytest.mark.parametrize("most", [4096, 2])
def test_long_paths_and_a_hot_url(spark, most, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LENGTHS", most)
    long = "/" + "a" * 100_000
    rules = spark.createDataFrame([("a.com", long, "block"), ("a.com", "/", "allow"), ("b.com", "/hot", "block"), ("b.com", "/é", "block")], "host string, path string, verdict string")
    urls = [f"http://x.a.com{long}z", f"http://a.com{long[:-1]}", "http://b.com/él"] + ["http://b.com/hot/page"] * 500
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got[0] == (f"a.com{long}", "block") and got[1] == ("a.com/", "allow") and got[2] == ("b.com/é", "block")
    assert len(got) == 503 and {got[i] for i in range(3, 503)} == {("b.com/hot", "block")}


# --- toxicity ------------------------------------------------------------------------------------------------------


def toxic_corpus(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = sentence(rng, rng.randint(10, 60)).split(" ")
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["zuxa", "zuxo", "kweb"]) + rng.choice(["", "s"]))
        rows.append((i, " ".join(words)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    docs = documents(spark, toxic_corpus())
    labels = docs.where("doc_id % 5 <> 0").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"), F.lit("x").alias("text"))
    scored = toxicity.score_documents(docs, labels).where("doc_id % 5 = 0").collect()
    right = sum((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in scored)
    assert right / len(scored) > 0.95
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_models_equal_a_plain_version(spark):
    rng = random.Random(8)
    words = [{"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for _ in range(60)} for _ in range(2)]
    train = spark.createDataFrame([(" ".join(w for w, n in words[k].items() for _ in range(n)), k) for k in (0, 1)], "text string, toxic int")
    model = toxicity.model_rows(toxicity.gram_counts(train))
    ratio = kneser_ney(words, toxicity.ORDER, toxicity.SHARED_ORDERS)
    asked = [w for w in list(words[0])[:20] + list(words[1])[:20]] + ["abab", "dddd", "a"]
    head, split = toxicity.split_model(model, 10**6)
    assert not split
    for w, got in zip(asked, head.evidence(asked), strict=True):
        assert abs(got - ratio(w)) < 1e-4, w
    joined = {r["word"]: r["evidence"] for r in toxicity.word_evidence(spark.createDataFrame([(w,) for w in set(asked)], "word string"), model).collect()}
    part, split = toxicity.split_model(model, 200)
    assert split and 0 < len(part.keys) <= 200
    for w, got in zip(asked, part.evidence(asked), strict=True):
        assert abs(joined.get(w, 0.0) - ratio(w)) < 1e-4, w
        assert np.isnan(got) or abs(got - ratio(w)) < 1e-4, w


def test_scores_do_not_hang_on_what_is_broadcast(spark):
    docs = documents(spark, [*toxic_corpus(200), *[(None if i is None else i + 1000, t) for i, t in odd_rows()]])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    runs = [sorted((str(r["doc_id"]), round(r["score"], 9)) for r in toxicity.score_documents(docs, labels, rows).collect()) for rows in (toxicity.HEAD_ROWS, 300, 0)]
    assert runs[0] == runs[1] == runs[2]


def test_toxicity_odd_rows_and_labels(spark):
    docs = documents(spark, [*toxic_corpus(), *[(None if i is None else i + 1000, t) for i, t in odd_rows()]])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    scored = toxicity.score_documents(docs, labels)
    assert scored.count() == docs.count() and scored.where("score is null").count() == 0
    for only, expected in ((0, 0.0), (1, 1.0)):
        assert {r["score"] for r in toxicity.score_documents(docs, labels.where(f"toxic = {only}")).collect()} == {expected}


# --- tokens and packing --------------------------------------------------------------------------------------------


def test_token_counts(spark):
    rows = odd_rows()
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(documents(spark, rows), PIECES, 4096).collect())
    sizes = [len(x) for x in token_counts.model(PIECES).encode([t or "" for _, t in rows])]
    want = sorted((i is None, i, len((t or "").encode()), n, n > 4096) for (i, t), n in zip(rows, sizes, strict=True))
    assert [g[2:] for g in sorted(got, key=str)] == [w[2:] for w in sorted(want, key=str)]


def test_packing_round_trip(spark):
    rows = [r for r in odd_rows() if r[0] is not None][:-1]
    found = packing.pack(documents(spark, rows), WORD_BPE, window=4096, shard_docs=5).collect()
    whole = {i: np.array(packing.tokenizer(WORD_BPE).encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for i, ids in whole.items():
        spans = sorted((r["start"], r["length"]) for r in by_doc[i])
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) == len(ids)
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 4096


def test_repeated_rows_are_packed_each(spark):
    rows = odd_rows()
    assert packing.pack(documents(spark, rows), WORD_BPE).where("start = 0").count() == len(rows)


def test_rows_repeated_by_the_thousand_are_dealt_apart(spark):
    docs = documents(spark, [(None, None)] * 2000 + [(1, "same")] * 2000).coalesce(2)
    found = packing.pack(docs, WORD_BPE, shard_docs=100)
    sizes = [r["count"] for r in found.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 400
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()
    assert found.groupBy("sequence_id", "offset").count().where("count > 1").isEmpty()


# --- mixing --------------------------------------------------------------------------------------------------------


def plain_raking(rows, targets):
    """Weights of cells by turns of plain proportional fitting."""
    tokens = Counter()
    for r in rows:
        tokens[(r["source"], r["lang"], r["topic"])] += r["n_tokens"]
    weight, total = {c: 1.0 for c in tokens}, sum(tokens.values())
    for _ in range(500):
        for d in range(3):
            now = Counter()
            for c, n in tokens.items():
                now[c[d]] += weight[c] * n
            for c in tokens:
                weight[c] *= targets[d][c[d]] * total / now[c[d]]
    return weight


@pytest.mark.parametrize("broadcast, pairs", [(100_000, 100_000), (0, 100_000), (0, 1)])
def test_mixing_equals_plain_raking(spark, broadcast, pairs, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    monkeypatch.setattr(mixing, "MOST_PAIRS", pairs)  # 1: everything is raked as tables
    rng = random.Random(9)
    docs = documents(spark, [(i, sentence(rng, rng.randint(5, 80))) for i in range(400)])
    rows = mixing.mix(docs, {"lang": {"en": 0.3, "fr": 0.7}}, budget=0.4).collect()
    assert len(rows) == 400
    totals = [Counter(), Counter()]
    for r in rows:
        totals[0][r["source"]] += r["n_tokens"]
        totals[1][r["topic"]] += r["n_tokens"]
    source, topic = ({k: n**0.5 / sum(m**0.5 for m in t.values()) for k, n in t.items()} for t in totals)
    want = plain_raking(rows, [source, {"en": 0.3, "fr": 0.7}, topic])
    assert all(abs(r["weight"] / want[(r["source"], r["lang"], r["topic"])] - 1) < 1e-5 for r in rows)
    size = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["probability"] * r["n_tokens"] for r in rows) / size - 0.4) < 1e-6
    assert abs(sum(r["n_tokens"] for r in rows if r["selected"]) / size - 0.4) < 0.12


def test_mixing_by_stated_columns_and_targets_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(i, "x y", "en" if i % 2 else "fr", f"s{i % 2}", f"t{i % 3}", i) for i in range(60)], "doc_id long, text string, lang string, source string, topic string, n long")
    with pytest.warns(UserWarning, match="off its target"):
        rows = mixing.mix(docs, {"lang": {"en": 0.9, "fr": 0.1}, "source": {"s0": 0.9, "s1": 0.1}}, topic_col="topic", tokens_col="n").collect()
    assert {r["topic"] for r in rows} == {"t0", "t1", "t2"} and all(r["n_tokens"] == r["n"] for r in rows)


def test_mixing_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumns({c: F.lit("mine") for c in ("weight", "topic", "selected", "tokens", "wanted", "_topic", "_weight", "_source", "_row", "a.b")})
    docs = docs.unionByName(docs.limit(1).withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd_rows()) + 1 and all(0 <= r["probability"] <= 1 for r in rows)
    same = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            same[(r["doc_id"], r["probability"])].add(r["selected"])
    assert all(len(v) == 1 for v in same.values())


# --- language ------------------------------------------------------------------------------------------------------


def test_languages_apart(spark):
    rng = random.Random(10)
    make = {"en": ["the", "and", "thing", "with"], "fr": ["les", "été", "où", "avec"], "de": ["der", "über", "und", "schön"]}
    rows = [(i, " ".join(rng.choice(make[k]) for _ in range(rng.randint(3, 40))), k) for i in range(150) for k in [sorted(make)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 ... !", "en"), (902, "", None), (None, "the and the", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, docs.where("doc_id % 2 = 0")).collect()}
    assert all(got[i][0] == k for i, _, k in rows)
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[None][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in language_id.identify(docs, docs.limit(0)).collect()} == {"und"}


def plain_grams(text):
    counts = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        counts.update(word)
        marked = f"\x01{word}\x01"
        for n in (2, 3, 4):
            counts.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return counts


def test_languages_equal_a_plain_version(spark):
    rng = random.Random(18)
    letters = {"en": "eeeeetttaaoinshr", "fr": "eeessaaitnruléèù", "ja": "のにるをはがとでし日本"}
    rows = [(i, " ".join("".join(rng.choices(letters[k], k=rng.randint(1, 9))) for _ in range(rng.randint(1, 30))), k) for i in range(90) for k in [sorted(letters)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:60]
    totals = defaultdict(Counter)
    for i, t, k in rows:
        if i % 2 == 0:
            totals[k] += plain_grams(t)
    profiles = {k: {g: n for n, g in enumerate(order(totals[k]))} for k in sorted(totals)}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, docs.where("doc_id % 2 = 0"), ranks=60).collect()}
    for i, t, _ in rows:
        own = order(plain_grams(t))
        far = sorted((sum(abs(p.get(g, 60) - n) for n, g in enumerate(own)), k) for k, p in profiles.items())
        assert got[i][0] == far[0][1] and abs(got[i][1] - max(0, 1 - far[0][0] / far[1][0])) < 1e-12


# --- lines ---------------------------------------------------------------------------------------------------------


def brute_lines(rows, least=line_dedup.LEAST_CHARS, bands=line_dedup.EDIT_BANDS):
    """Text left of every document, by comparing all lines with all."""
    rows = sorted(r for r in rows if r[0] is not None and r[1] is not None)
    first = {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            if len(line) >= least and not line.isspace():
                first.setdefault(line, (i, k))
    lines = list(first)
    group = {x: x for x in lines}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            most = max([-1, *(e for n, e in bands if min(len(lines[a]), len(lines[b])) >= n)])
            if abs(len(lines[a]) - len(lines[b])) <= most and line_dedup.within_edits(lines[a], lines[b], most):
                group[find(lines[a])] = find(lines[b])
    best = {}
    for x in lines:
        best[find(x)] = min(best.get(find(x), first[x]), first[x])
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if x not in first or best[find(x)] == (i, k)) for i, t in rows}


def line_rows():
    rng = random.Random(11)
    base = [sentence(rng, 8) for _ in range(12)]
    crowd = sentence(rng, 8)  # many lines that share one half, most of them one edit from others
    rows = []
    for i in range(40):
        lines = [rng.choice(base) for _ in range(3)]
        lines[0] = lines[0][:20] + rng.choice("xyz") + lines[0][21:]
        lines.append(crowd + f" end {i:02d}")
        lines.append(crowd[: len(crowd) // 2] + sentence(rng, 4))
        lines += ["short", "", " " * 50]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("small", [8, 2])
def test_lines_equal_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", small)
    rows = line_rows()
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute_lines(rows)


@pytest.mark.parametrize("bands", [((30, 2),), ((30, 1), (45, 3)), ((30, 1), (45, 2))])
def test_lines_more_edits_apart_equal_brute_force(spark, bands, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", 3)
    rng = random.Random(14)
    base = [sentence(rng, rng.randint(6, 9)) for _ in range(8)]
    template = sentence(rng, 7)
    rows = []
    for i in range(50):
        lines = []
        for _ in range(2):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(line))
                line[k] = rng.choice(["", "x", line[k] + "y"])
            lines.append("".join(line))
        lines.append(f"{template} {rng.randint(0, 9999):04d}")
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows), bands=bands).collect()}
    assert got == brute_lines(rows, bands=bands)


def test_lines_of_a_hot_key(spark):
    """Half of all lines are one line, a quarter share one half: no unique line is lost."""
    rng = random.Random(15)
    half = sentence(rng, 5)
    rows = [(i, f"{sentence(rng, 8)}\n{half} {sentence(rng, 4)}\n{half} the very same line\n{half} the very same line") for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_of_documents_that_share_an_id(spark):
    common, one, two = (x * 12 for x in ("boiler ", "first ", "second "))
    rows = [(1, common), (2, f"{common}\n{one}"), (2, f"{two}\n{common}"), (3, one)]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect())
    assert got == [(1, common), (2, one), (2, two), (3, "")]


def test_short_lines_repeat_exactly(spark):
    line = "a line of thirty characters..."
    rows = [(1, f"{line}\nshort"), (2, f"{line}\nshort"), (3, line[:-1] + "!")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1]}


def test_line_of_a_hundred_thousand_characters(spark):
    long = "".join(random.Random(16).choices("abcdef ", k=100_000))
    rows = [(1, long), (2, long[:50_000] + "x" + long[50_001:]), (3, long[::-1])]
    got = {r["doc_id"]: len(r["text"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: 100_000, 2: 0, 3: 100_000}


def test_line_neighbourhoods(spark):
    rng = random.Random(12)
    lines = ["abcdefghij" * 5]
    for _ in range(40):
        lines.append(rng.choice([lines[0], lines[-1]]))
        k = rng.randint(0, 48)
        lines[-1] = rng.choice([lines[-1][:k] + "x" + lines[-1][k + 1 :], lines[-1][:k] + lines[-1][k + 1 :], lines[-1][:k] + "y" + lines[-1][k:]])
    lines = sorted(set(lines))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line long, line_text string")
    group = list(range(len(lines)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    links = [(r["a"], r["b"]) for r in line_dedup.neighbourhood_links(df).collect()]
    assert all(line_dedup.within_edits(lines[a], lines[b], 1) for a, b in links)
    for a, b in links:
        group[find(a)] = find(b)
    for a in range(len(lines)):
        for b in range(a):
            if line_dedup.within_edits(lines[a], lines[b], 1):
                assert find(a) == find(b)


def test_lines_odd_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows).withColumns({c: F.lit("mine") for c in ("line", "cut_lines", "_n_cut", "_n_lines", "row", "cut_doc", "first_doc", "class_id")})
    found = line_dedup.dedup_lines(docs.withColumn("n_cut", F.lit("mine")))
    assert found.columns == [*docs.columns, "n_lines", "n_cut"]
    got = defaultdict(list)
    for r in found.collect():
        got[r["doc_id"]].append((r["text"], r["n_cut"], r["n_chars"]))
    assert sum(map(len, got.values())) == len(rows)
    assert got[0][0][1] == 0 and got[1] == [("", 1, 0)] and got[3] == [(None, 0, None)] and got[4] == [("", 0, 0)]
    assert got[None][0][1] == 0 and got[10][0][1] == 1 and len(got[2]) == 2 and got[2][0] == got[2][1]


# --- search --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("entries", [1_000_000, 300])
def test_search_equals_brute_force(spark, entries, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 64)
    rng = random.Random(13)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    rows = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 60)))) for i in range(500)] + [(i + 1000, t) for i, t in odd_rows() if i is not None]
    rows = [(i, t) for i, t in dict(rows).items()] + [(None, "x")]
    docs = documents(spark, rows).coalesce(1)
    got = defaultdict(list)
    for r in topk_search.search(docs, docs.where("doc_id % 25 = 0"), k=7, query_entries=entries).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 6)))
    held = {i: Counter((t or "").encode().lower().split()) for i, t in rows if i is not None}
    n, mean = len(held), sum(sum(c.values()) for c in held.values()) / len(held)
    df = Counter(w for c in held.values() for w in c)
    for q in (i for i in held if i % 25 == 0):
        scored = []
        for i, c in held.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in held[q] if w in c)
            if s > 0:
                scored.append((-round(s, 9), i))
        assert got[q] == [(i, round(-s, 6)) for s, i in sorted(scored)[:7]], q


def searched(rows, queries, first_blocks=None):
    """Best of all rows, in shards of 512, and the share of blocks skipped."""
    ids, counted = np.array([i for i, _ in rows]), [topk_search.term_counts(t) for _, t in rows]
    keys, df = np.unique(np.concatenate([k for k, _ in counted]), return_counts=True)
    mean = sum(int(c.sum()) for _, c in counted) / len(rows)
    held = [topk_search.term_counts(q)[0] for q in queries]
    terms = np.concatenate(held)
    of_term = df[np.searchsorted(keys, terms)]
    idf = np.log(1 + (len(rows) - of_term + 0.5) / (of_term + 0.5))
    block = topk_search.QueryBlock(np.arange(len(queries)), np.repeat(np.arange(len(queries)), [len(h) for h in held]), terms, idf)
    best = topk_search.Best(len(queries), 10)
    for at in range(0, len(rows), 512):
        part = counted[at : at + 512]
        topk_search.Shard(block, ids[at : at + 512], [k for k, _ in part], [c for _, c in part], mean).search(best)
    return best


def test_pruning_skips_blocks_and_changes_no_result(monkeypatch):
    rng = random.Random(17)
    vocabularies = [[f"{w}{k}" for w in WORDS for _ in range(1)] for k in range(6)]
    rows = []
    for i in range(3000):
        words = vocabularies[i % 6]
        rows.append((i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(5, 80)))))
    for queries, least in (([t for _, t in rows[:30]], 0.5), ([f"{WORDS[k]}0 {WORDS[-k]}1" for k in range(1, 20)], 0.5)):
        found = searched(rows, queries)
        monkeypatch.setattr(topk_search, "FIRST_BLOCKS", 10**6)  # every block is scored
        whole = searched(rows, queries)
        monkeypatch.undo()
        assert (found.ids == whole.ids).all() and np.allclose(found.scores, whole.scores)
        assert found.skipped / found.blocks > least


def test_floors_leave_out_what_cannot_be_best(spark, monkeypatch):
    rng = random.Random(19)
    rows = [(i, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.randint(5, 60)))) for i in range(2000)]
    counted = [topk_search.term_counts(t) for _, t in rows]
    keys, df = np.unique(np.concatenate([k for k, _ in counted]), return_counts=True)
    terms = np.concatenate([k for k, _ in counted[:40]])
    block = topk_search.QueryBlock(np.arange(80).reshape(40, 2), np.repeat(np.arange(40), [len(k) for k, _ in counted[:40]]), terms, 1 / df[np.searchsorted(keys, terms)])
    assert (block.terms[block.places(block.terms)] == block.terms).all() and (block.places(block.terms + np.uint64(1)) == -1).all()
    columns = [[i for i, _ in rows], [k.tobytes() for k, _ in counted], [c.astype(np.uint32).tobytes() for _, c in counted]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "terms", "counts"])

    def hits(part, floors=None):
        search = topk_search.shard_search(types.SimpleNamespace(value=block), 30.0, 5, floors)
        return {(r["query_id"], r["doc_id"]): r["score"] for found in search([part]) for r in found.to_pylist()}

    few = defaultdict(list)
    for (q, _), score in hits(batch.slice(0, 1000)).items():
        few[q].append(score)
    floors = {q: min(scores) for q, scores in few.items()}
    whole, found = hits(batch.slice(1000)), hits(batch.slice(1000), np.array([floors[q] for q in block.ids[:, 0].tolist()]))
    assert found == {pair: score for pair, score in whole.items() if score >= floors[pair[0]]} and len(found) < len(whole)

    # Searching in parts that grow gives what one search gives, and tasks return less.
    made = []
    keep = topk_search.materialise
    monkeypatch.setattr(topk_search, "materialise", lambda df, label: made.append((label, keep(df, label))) or made[-1][1])
    n_hits = lambda: sum(df.count() for label, df in made if label == "hits")
    docs = documents(spark, rows[:600]).repartition(16)
    monkeypatch.setattr(topk_search, "SHARD", 601)
    once = topk_search.search(docs, docs.where("doc_id % 25 = 0"), k=7).orderBy("query_id", "rank").collect()
    before = n_hits()
    made.clear()
    monkeypatch.setattr(topk_search, "FLOOR_SHARE", 2)
    monkeypatch.setattr(topk_search, "SHARD", 64)
    twice = topk_search.search(docs, docs.where("doc_id % 25 = 0"), k=7).orderBy("query_id", "rank").collect()
    assert once == twice and len(once) == 24 * 7
    assert sum(label == "term-counts" for label, _ in made) == 5 and n_hits() <= before


def test_search_queries_of_one_id(spark):
    docs = documents(spark, [(1, "aa bb"), (2, "cc dd"), (3, "aa"), (4, "dd")])
    queries = documents(spark, [(7, "aa"), (7, "dd"), (7, "dd")])
    got = sorted((r["rank"], r["doc_id"]) for r in topk_search.search(docs, queries, k=1).collect())
    assert got == [(1, 3), (1, 4)]


# --- n-gram join ---------------------------------------------------------------------------------------------------


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        words = (t or "").encode("utf-8").lower().split()
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed):
    """Families of edited copies, a passage that many share, and a large family."""
    rng = random.Random(seed)
    passage = sentence(rng, 30)
    rows = []
    for family in range(12):
        base = sentence(rng, rng.randint(20, 120)).split(" ")
        for _ in range(40 if family == 0 else rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
            rows.append(" ".join(words))
    rows += [f"{passage} {sentence(rng, rng.randint(1, 90))}" for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, small, tile", [(1, 6, 1024), (2, 2, 1024), (3, 2, 16)])
def test_groups_equal_brute_force(spark, seed, small, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = near_rows(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(documents(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_documents_that_share_an_id_are_one_node(spark):
    rng = random.Random(21)
    x, y = sentence(rng, 60), sentence(rng, 60)
    rows = [(5, x), (5, y), (7, x + " tail"), (8, y + " tail"), (9, sentence(rng, 40)), (6, None), (6, "one two")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(documents(spark, rows)).collect())
    assert [(i, c) for i, _, c in got] == [(5, 5), (5, 5), (6, 6), (6, 6), (7, 5), (8, 5), (9, 9)]


@pytest.mark.parametrize("heavy", [4096, 8])
def test_groups_under_a_hot_key(spark, heavy, monkeypatch):
    """Half of the rows share most words but not enough of them; the rest are copies of one text."""
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rng = random.Random(22)
    passage = sentence(rng, 40)
    rows = [(i, f"{passage} {sentence(rng, 25)}") for i in range(60)]
    base = sentence(rng, 50).split(" ")
    for i in range(60, 120):
        words = list(base)
        words[rng.randrange(50)] = rng.choice(WORDS) + "x"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(documents(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_groups_odd_rows(spark):
    rows = odd_rows()
    found = ngram_join.join_documents(documents(spark, rows).withColumn("set_id", F.lit("mine"))).collect()
    assert len(found) == len(rows)
    want = brute_groups([r for r in rows if r[0] is not None])
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        else:
            assert r["component_id"] is None
