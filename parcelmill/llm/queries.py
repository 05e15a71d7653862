"""Queries over the supplied tables, one for each training-data operator, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, language_id, line_dedup, mixing, ngram_join, packing, permutation_index, piece_codec, quantile_summaries, token_counts, topk_search, toxicity, url_filter
from .common import materialise, table

#: (host, path, verdict) rules of the url query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Score from which a document counts as toxic.
TOXIC_SCORE = 0.3


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def in_fold(modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; null ids are in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~in_fold(4, 2))
    found = toxicity.score_documents(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", in_fold(4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "selected")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, docs.where(~in_fold(3, 1)))
    return found.select("doc_id", in_fold(3, 1).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_cut", F.col("n_chars").alias("chars_left"), F.md5("text").alias("text_md5"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), separator=2, window=4096)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return topk_search.search(docs, docs.where(F.col("doc_id") % 100 == 0), k=10)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op11_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a click are one row: of copies that differ, the smallest client and value count."""
    keys = ["stream", "grp", "batch"]
    cents = lambda money: F.floor(100 * money + F.lit(0.5))
    batch = lambda name: (F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % 8).cast("int").alias("batch")
    finite = lambda money: money.isNotNull() & ~F.isnan(money) & (F.abs(money) != float("inf"))
    clicks = table(spark, sf_dir, "clicks").groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min("value").alias("money"))
    clicks = clicks.where(F.col("client_id").isNotNull() & finite(F.col("money")))
    clicks = clicks.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), batch("click_id"), cents(F.col("money")).alias("x"), F.lit(1).cast("long").alias("w"))
    # A line's batch and item are all that counts, so a hot item meets its price once for each batch.
    lines = table(spark, sf_dir, "sale_lines").where("item_id IS NOT NULL").groupBy("item_id", batch("vendor_id")).agg(F.count("*").alias("w"))
    items = table(spark, sf_dir, "items").where(F.col("brand").isNotNull() & finite(F.col("price"))).select("item_id", "brand", "price")
    lines = lines.join(items, "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", cents(F.col("price")).alias("x"), "w")
    rows = clicks.unionByName(lines).withColumn("x", F.col("x") + 1000 * F.col("batch"))
    values = materialise(quantile_summaries.counted(rows, keys, "w"), "quantile-counts")
    return quantile_summaries.judged(values, keys[:2], "batch", parts=10, least=20, error=0.05)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_permutation_index": op1_permutation_index,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_topk_search": op9_topk_search,
    "op10_ngram_join": op10_ngram_join,
    "op11_quantile_summaries": op11_quantile_summaries,
    "op12_collocations": op12_collocations,
    "op13_piece_codec": op13_piece_codec,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parsed AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), rules(host, path, verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), fits AS (
            SELECT p.page_id, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
            FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1
    """,
    "op7_line_dedup": """
        WITH RECURSIVE raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
        l AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM raw),
        d AS (SELECT line, length(line) AS n, min(row(doc_id, line_no)) AS first FROM l WHERE regexp_matches(line, '[^\\s]') GROUP BY line),
        e AS (SELECT line, n FROM d WHERE n >= 40),
        own AS (SELECT line, n AS size, 0 AS side, left(line, n // 2) AS part FROM e UNION ALL SELECT line, n, 1, right(line, n - n // 2) FROM e),
        longer AS (SELECT line, n - 1 AS size, 0 AS side, left(line, (n - 1) // 2) AS part FROM e UNION ALL SELECT line, n - 1, 1, right(line, n - 1 - (n - 1) // 2) FROM e),
        pairs AS (SELECT DISTINCT a.line AS a, b.line AS b FROM own a JOIN (SELECT * FROM own UNION ALL SELECT * FROM longer) b USING (size, side, part) WHERE a.line <> b.line),
        wide AS (SELECT a.line AS a, b.line AS b FROM e a JOIN e b ON a.n >= 200 AND b.n BETWEEN a.n AND a.n + 2 AND a.line <> b.line),
        near AS (SELECT a, b FROM pairs WHERE levenshtein(a, b) <= 1 UNION SELECT a, b FROM wide WHERE levenshtein(a, b) <= 2),
        links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
        reach(a, b) AS (SELECT line, line FROM d UNION SELECT r.a, k.b FROM reach r JOIN links k ON k.a = r.b),
        firsts AS (SELECT r.a AS line, min(d.first) AS first FROM reach r JOIN d ON d.line = r.b GROUP BY r.a),
        kept AS (SELECT l.doc_id, l.line_no, l.line, f.line IS NULL OR f.first = row(l.doc_id, l.line_no) AS stays FROM l LEFT JOIN firsts f ON f.line = l.line),
        out AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (NOT stays) AS INTEGER) AS n_cut, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (stays), '') AS text FROM kept GROUP BY doc_id)
        SELECT doc_id, n_lines, n_cut, CAST(length(text) AS BIGINT) AS chars_left, md5(text) AS text_md5 FROM out
    """,
    "op9_topk_search": f"""
        WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
        size AS (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS size FROM tf GROUP BY 1),
        total AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(size) FROM size) / (SELECT count(*) FROM documents) AS mean),
        idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, total GROUP BY term),
        scored AS (
            SELECT q.doc_id AS query_id, t.doc_id, round(sum(i.idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * s.size / total.mean))), 9) AS score
            FROM tf q JOIN tf t ON t.term = q.term JOIN idf i ON i.term = q.term JOIN size s ON s.doc_id = t.doc_id, total
            WHERE q.doc_id % 100 = 0 GROUP BY 1, 2),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op10_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
        e AS (SELECT doc_id, unnest(s) AS shingle FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        half AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * k >= 75 * (len(x.s) + len(y.s) - k)),
        links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
        reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, k.b FROM reach r JOIN links k ON k.a = r.b)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
    """,
    "op12_collocations": r"""
        WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cut AS (SELECT c.*, x.i, array_to_string(w[1:x.i], ' ') AS left_, array_to_string(w[x.i + 1:], ' ') AS right_ FROM c, (VALUES (1), (2), (3), (4)) x(i) WHERE x.i < k),
        s AS (SELECT cut.lang, cut.phrase, cut.a, cut.i, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * cut.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
              FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = left_ JOIN f r ON r.lang = cut.lang AND r.phrase = right_ JOIN total ON total.lang = cut.lang),
        best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        held AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.k > x.k AND y.a >= x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best ANTI JOIN held USING (lang, phrase))
        SELECT * FROM ranked WHERE rank <= 2000
    """,
}
