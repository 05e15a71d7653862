"""The corpus pipeline: five stages from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  Every stage works on all that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.llm import line_dedup, mixing, ngram_join, packing, toxicity
from parcelmill.llm.common import materialise, row_names, table
from parcelmill.llm.queries import TOXIC_SCORE, in_fold, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity models score at TOXIC_SCORE or more go; others stay, whatever ids they share.

    The models learn from the labelled documents outside the held-out fold.  Rows with a null doc_id are judged like all
    others; null and empty texts have no evidence and stay; repeated rows stay or go together.
    """
    rows, name, _ = row_names(docs)
    scores = toxicity.score_documents(rows, table(spark, sf_dir, "labels").where(~in_fold(4, 2)), keep=name)
    toxic = scores.where(F.col("score") >= TOXIC_SCORE).select(name).distinct()
    return rows.join(toxic, name, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal to, or a few edits from, a line of an earlier document or place are cut.

    A document from which lines were cut, and that has nothing but blanks left, goes: every line that it held stands in
    others or nearly so.  Null and empty texts, and those of blanks alone, stay; rows without an id are left alone.
    """
    found, _, n_cut = line_dedup.cut_lines(docs)
    own = F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")
    return found.where((F.col(n_cut) == 0) | own).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of rows linked by five-word shingles (Jaccard 0.75 or more) the one of smallest doc_id stays.

    Rows are told apart by id and text: of rows that share an id each is judged by its own text, and of equal rows (id
    and text) one stays.  A missing id comes after all others.  Null and empty texts, and those without words, link with
    nothing.
    """
    rows, name, shared = row_names(docs)
    groups = ngram_join.join_documents(rows.select(F.col(name).alias("doc_id"), "text")).withColumnRenamed("doc_id", name)
    if shared is None:
        others = groups.where(F.col(name) != F.col("component_id")).select(name).distinct()
        return rows.join(others, name, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    members = rows.select(name, "doc_id").distinct().join(groups.select(name, "component_id").distinct(), name)
    members = materialise(members, "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", name)).alias("first"))
    first = materialise(first.select(F.col("component_id").alias("group"), F.col(f"first.{name}").alias("kept")), "firsts")
    others = members.join(first, F.col("component_id") == F.col("group")).where(F.col(name) != F.col("kept")).select(name).distinct()
    kept = rows.join(others, name, "left_anti")
    single, columns = kept.where(F.col(shared).isNull()), [f"`{c}`" for c in docs.columns]
    again = kept.where(F.col(shared)).select(name, F.struct(*columns).alias("row"))
    once = again.groupBy(name).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return single.select(*columns).unionByName(once.select(*columns))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities raked to tempered source, language and topic shares, half of the tokens.

    A null source or language is one of its own; null and empty texts have no tokens and weigh as one; rows that share
    an id are drawn alike.
    """
    found, names = mixing.mixed(docs)
    return found.where(F.col(names["selected"])).select(*[f"`{c}`" for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit decreasing packing into windows of 4096 ids; the columns of packing.pack.

    Null and empty texts are the separator alone; repeated rows and rows that share an id are packed each.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("source_mixing", draw_mixture),
    ("packing", pack_windows),
]

#: Models, components and packing are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
