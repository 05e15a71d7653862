"""Readers and writers: typed CSV, Parquet, JSON pages, saved matrices, and a versioned store.

A store that is read cannot be overwritten by the same plan, so each version is a folder of its own, and a pointer file
names the current one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMES = ("first_encounted", "last_encounted", "date_scraped")
PRICES = ("price_min", "price_max")
PATTERN = "yyyy-MM-dd HH:mm:ss"
KINDS = ("csv", "parquet")


def without_nan(df: DataFrame) -> DataFrame:
    """Not-a-number values as missing ones."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV store: the first column is the row id, prices are double, and times have one pattern."""
    reader = spark.read.option("header", True).option("timestampFormat", PATTERN).option("timestampNTZFormat", PATTERN)
    if schema is not None:
        return without_nan(reader.schema(schema).csv(path))
    df = reader.option("inferSchema", True).csv(path)
    df = df.withColumnRenamed(df.columns[0], "row_id")
    typed = {c: F.col(c).cast("double") for c in PRICES if c in df.columns}
    typed |= {c: F.col(c).cast("timestamp_ntz") for c in TIMES if c in df.columns}
    return without_nan(df.withColumns(typed))


def check_kind(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown file type {kind}: use one of {', '.join(KINDS)}")


def read_table(spark: SparkSession, kind: str, path: str) -> DataFrame:
    check_kind(kind)
    return read_csv(spark, path) if kind == "csv" else without_nan(spark.read.parquet(path))


def write_table(df: DataFrame, kind: str, path: str, mode: str = "overwrite") -> None:
    check_kind(kind)
    if kind == "csv":
        first = [c for c in ("row_id",) if c in df.columns]
        df.select(*first, *[c for c in df.columns if c not in first]).write.mode(mode).option("header", True).option("timestampFormat", PATTERN).option("timestampNTZFormat", PATTERN).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_html(df: DataFrame, most_rows: int = 1000, wrap: bool = True, path: str | None = None) -> str:
    """A small table as HTML, its cells kept on one line unless `wrap`, and written to a local file if a path is given;
    larger tables are an error, since a page is made on the driver."""
    rows = df.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    page = rows.to_html(index=False)
    page = page if wrap else page.replace("<table ", '<table style="white-space: nowrap" ', 1)
    if path is not None:
        write_text(page, path)
    return page


def write_text(text: str, path: str) -> None:
    with open(path, "w") as f:
        f.write(text)


class Store:
    """A table kept as numbered versions under one folder, on any file system Spark writes to.

    The current version is the complete one with the largest number: Spark marks a folder complete as the last step of
    its write, so a write that breaks off at any point leaves the version before it current.  The versions before the
    last `kept` are removed after a write.
    """

    def __init__(self, spark: SparkSession, path: str, kept: int = 3):
        self.spark, self.path, self.kept = spark, path.rstrip("/"), kept
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        """Numbers of all versions, complete or not."""
        if not self._fs.exists(self._root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit())

    def _complete(self) -> list[int]:
        return [n for n in self._numbers() if self._fs.exists(self._path(f"v-{n:012d}/_SUCCESS"))]

    def exists(self) -> bool:
        return bool(self._complete())

    def current(self) -> str:
        found = self._complete()
        if not found:
            raise FileNotFoundError(f"no complete version in {self.path}")
        return f"{self.path}/v-{found[-1]:012d}"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.current())

    def write(self, df: DataFrame) -> None:
        """Write the next version.  Two writers of one number cannot both succeed: the second finds the folder there."""
        number = max(self._numbers(), default=0) + 1
        df.write.parquet(f"{self.path}/v-{number:012d}")
        for old in self._complete()[: -self.kept]:
            self._fs.delete(self._path(f"v-{old:012d}"), True)

    def create_unless_exists(self, df: DataFrame) -> None:
        if not self.exists():
            self.write(df)


def update_store(store: Store, batch: DataFrame, scrape_time, days: int = 31) -> None:
    """Read, bring to today's layout, upsert, and write as a new version."""
    from ..operators.records import upgrade_layout
    from ..operators.sequences import upsert

    store.write(upsert(upgrade_layout(store.read()), batch, scrape_time, days))


def load_json(path: str):
    with open(path) as f:
        return json.load(f)


def dump_json(data, path: str) -> None:
    with open(path, "w") as f:
        json.dump(data, f, indent=4)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages of a dump (htmls, search_description): one row each, with its place."""
    raw = spark.read.schema("htmls array<string>, search_description string").option("multiLine", True).json(path)
    return raw.select("search_description", F.posexplode("htmls").alias("page", "html"))


def write_pages(df: DataFrame, path: str) -> None:
    """Pages (page, html, search_description) as one JSON document per search."""
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page", "html"))), lambda p: p["html"])
    df.groupBy("search_description").agg(pages.alias("htmls")).write.mode("overwrite").json(path)


def write_matrix(matrix, path: str) -> None:
    """X and y side by side; column names that Parquet would not take are numbered.  Names, groups of columns and the
    encoders' values are kept beside."""
    names = {c: f"x{i}" for i, c in enumerate(matrix.columns)}
    matrix.table.select(*[c for c in ("row_id",) if c in matrix.table.columns], *[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{matrix.y}`").alias("y")).write.mode("overwrite").parquet(f"{path}/table")
    notes = {"columns": matrix.columns, "categorical_groups": matrix.categorical_groups, "interaction_groups": matrix.interaction_groups, "encoded_columns": matrix.encoded_columns, "encoders": matrix.encoders}
    matrix.table.sparkSession.createDataFrame([(json.dumps(notes),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/notes")


def read_matrix(spark: SparkSession, path: str):
    from ..plans.design_matrix import DesignMatrix

    notes = json.loads(spark.read.text(f"{path}/notes", wholetext=True).first()[0])
    table = spark.read.parquet(f"{path}/table")
    table = table.select(*[c for c in ("row_id",) if c in table.columns], *[F.col(f"x{i}").alias(c) for i, c in enumerate(notes["columns"])], "y")
    groups = {k: [tuple(g) for g in notes[k]] for k in ("categorical_groups", "interaction_groups", "encoded_columns")}
    return DesignMatrix(table, notes["columns"], "y", encoders=notes["encoders"], **groups)


def write_xy_csv(matrix, path: str) -> None:
    """X and y as two CSV tables with the row id, headers on."""
    for name, columns in (("x", matrix.columns), ("y", [matrix.y])):
        matrix.table.select("row_id", *[F.col(f"`{c}`") for c in columns]).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_failures(log: DataFrame, path: str) -> None:
    log.select("error_number", "error_type", "sale_type", "address", "details").orderBy("error_number").write.mode("overwrite").option("header", True).csv(path)


def append_scores(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Add a run's rows to a log of scores.  A run has a folder of its own, so one that is repeated replaces what it
    wrote before; without a name it gets a new one."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/run={run or uuid.uuid4().hex}")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a log of scores, with the run's name."""
    return spark.read.option("header", True).csv(path)
