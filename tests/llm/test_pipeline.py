"""The pipeline, stage by stage, on small tables."""

import pytest
from pyspark.sql import functions as F

from helpers import documents, odd_rows
from test_operators import brute_groups, brute_lines, line_rows, near_rows, toxic_corpus

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [*toxic_corpus(), *[(i + 1000, t) for i, t in near_rows(4)], *[(i + 2000, t) for i, t in line_rows()], *[(None if i is None else i + 3000, t) for i, t in odd_rows()]]
    documents(spark, rows).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(i, 1, 0) for i in range(1000, 1060)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit("mine") for c in ("weight", "selected", "n_cut", "score", "shard", "set_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        assert out.where("weight <> 'mine' or n_cut <> 'mine' or selected <> 'mine'").isEmpty(), name


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    toxic = [i for i in range(400) if i % 4 == 0]
    assert sum(i in kept for i in toxic) <= 4
    assert sum(i not in kept for i in range(400) if i % 4) <= 6


def test_lines_stage(spark):
    rows = line_rows() + [(99, line_rows()[0][1].split("\n")[0])]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_lines(spark, documents(spark, rows), "").collect()}
    want = brute_lines(rows)
    assert 99 not in got
    assert all(want[i] == t for i, t in got.items())
    for i in set(want) - set(got):
        assert not any(len(x) >= 40 and x.strip() for x in want[i].split("\n"))


def test_lines_stage_keeps_short_lines_of_their_own(spark):
    shared = "this line of a licence stands at the top of many files"
    rows = [(1, shared + "\nfirst of all"), (2, shared + "\nroses are red\nviolets are blue"), (3, shared + "\n\t\n" + shared + " "), (4, shared)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_lines(spark, documents(spark, rows), "").collect()}
    assert got == {1: rows[0][1], 2: "roses are red\nviolets are blue"}


def test_groups_stage(spark):
    rows = near_rows(5)
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, documents(spark, rows), "").collect()}
    assert got == {i for i, (_, c) in brute_groups(rows).items() if i == c}


def test_run_equals_its_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
    assert docs.count() > 0


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_pass_the_filters(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id").isNull() | (F.col("doc_id") < 100))
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, sf_dir).where("doc_id is null").count() == 1, name


def test_groups_stage_tells_rows_by_id_and_text(spark):
    """A text of its own stays whatever ids it shares; of equal rows one stays; missing ids come last."""
    x = "one two three four five six seven eight nine ten eleven twelve thirteen"
    own = "red orange yellow green blue indigo violet black white grey"
    other = "monday tuesday wednesday thursday friday saturday sunday and again"
    rows = [(5, x), (7, x + " tail"), (7, own), (9, other), (9, other), (None, x), (None, own + " end"), (3, None), (3, ""), (3, ""), (None, None), (11, "alone"), (12, "alone")]
    docs = documents(spark, rows).withColumn("row_name", F.lit("mine"))
    got = sorted((r["doc_id"] or -1, r["text"]) if r["text"] is not None else (r["doc_id"] or -1, "-") for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())
    assert got == sorted([(5, x), (7, own), (9, other), (3, "-"), (3, ""), (-1, "-"), (11, "alone")])
    assert corpus_pipeline.keep_one_of_each_group(spark, docs.where("doc_id = 9"), "").count() == 1


def test_toxic_rows_go_alone(spark, sf_dir):
    """A clean row that shares its id with a toxic one stays, and so does one without an id; a toxic one without id goes."""
    texts = dict(toxic_corpus())
    toxic, clean = next(texts[i] for i in range(0, 400, 4)), next(texts[i] for i in range(1, 400, 4))
    rows = [(9001, toxic), (9001, clean), (None, toxic), (None, clean), (9002, None)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(documents(spark, rows))
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert sorted(str(r["text"]) for r in kept.where("doc_id > 9000").collect()) == sorted([clean, "None"])
    assert {r["text"] for r in kept.where("doc_id IS NULL").collect()} >= {clean} and toxic not in {r["text"] for r in kept.where("doc_id IS NULL").collect()}
