"""A listing store that is merged when it is read: a batch writes its own rows and nothing else.

Rows lie in buckets by a hash of their id columns.  Each batch adds one layer: the sequences that it refreshed, in
their new state, and those that it began.  A manifest names the layers of each bucket; making the next manifest is the
commit, so readers see a batch whole or not at all, and of two writers of one number only the first succeeds.

What a scrape does to sequences that it did not see, breaking those unseen for too long, is not written: a row says at
which batch its state was made, and the scrapes since then tell whether it has been broken.  Compaction writes a
bucket's present state as one layer.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import dense_index, null_safe
from ..operators.sequences import EXPIRY_DAYS, STORE, as_sequences, expire, id_columns, refresh, unbroken, unmatched
from .shared import Files

MADE, BUCKET = "_made", "_bucket"


class ConflictError(RuntimeError):
    """Another writer made the next version first: read again and repeat."""


class MergingStore:
    """One store under a folder.  ids are the columns that tell sequences apart, missing values equal.

    buckets is fixed when the store is made.  A bucket with more than most_layers layers is compacted by the next
    write; files that none of the last `kept` manifests names are removed then.
    """

    def __init__(self, spark: SparkSession, path: str, days: int = EXPIRY_DAYS, most_layers: int = 8, kept: int = 3):
        self.spark, self.path, self.days, self.most_layers, self.kept = spark, path.rstrip("/"), days, most_layers, kept
        self._files = Files(spark, self.path)

    # --- manifests -------------------------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._files.names("manifests") if n.endswith(".json") and not n.startswith(".")]

    def exists(self) -> bool:
        return bool(self._numbers())

    def manifest(self) -> dict:
        found = self._numbers()
        if not found:
            raise FileNotFoundError(f"no store in {self.path}")
        return self._files.read_json(f"manifests/{found[-1]:012d}.json")

    def _commit(self, manifest: dict) -> None:
        if not self._files.commit_json(f"manifests/{manifest['number']:012d}.json", manifest):
            raise ConflictError(f"version {manifest['number']} of {self.path} was made by another writer")

    def create(self, rows: DataFrame, ids: list[str], buckets: int = 64) -> None:
        """Make the store from rows with row_id, the ids, first and last sight and the flag, in any order of columns."""
        kept = rows.select("row_id", *ids, *STORE)
        largest = kept.agg(F.max("row_id")).first()[0]
        manifest = {"number": 1, "ids": ids, "buckets": buckets, "schema": kept.schema.json(), "next_row": -1 if largest is None else largest, "layers": {}, "scrapes": [], "batches": {}}
        manifest["layers"] = self._write(kept, manifest, 1, {})
        self._commit(manifest)

    # --- reading ---------------------------------------------------------------------------------------------------

    def _bucket_of(self, manifest: dict, typed: dict[str, str]) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast(typed[c]) for c in manifest["ids"]]), F.lit(manifest["buckets"])).cast("int")

    def _types(self, manifest: dict) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self._schema(manifest).fields}

    def _schema(self, manifest: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(manifest["schema"]))

    def _layer(self, manifest: dict, paths: list[str]) -> DataFrame:
        schema = T.StructType([*self._schema(manifest).fields, T.StructField(MADE, T.LongType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def _state(self, manifest: dict, wanted: list[int] | None) -> DataFrame:
        """Rows of the wanted buckets (all if None) with the batch at which their state was made: the last of each row
        id counts.  Only rows of later layers are grouped; a bucket's first layer has each row id once."""
        layers = {b: ls for b, ls in manifest["layers"].items() if wanted is None or int(b) in wanted}
        first = self._layer(manifest, [ls[0] for ls in layers.values()])
        more = [p for ls in layers.values() for p in ls[1:]]
        if not more:
            return first
        later = self._layer(manifest, more)
        last = later.groupBy("row_id").agg(F.max_by(F.struct(*later.columns), MADE).alias("_row")).select("_row.*")
        return first.join(last, "row_id", "left_anti").select(*last.columns).unionByName(last)

    def _broken_since(self, manifest: dict) -> Column:
        """Whether a scrape after the row's batch broke it.  scrapes are the (number, time) with the latest time of all
        from that number on, so the first one after the row's batch decides."""
        limit = F.lit(None).cast("string")
        for number, time in reversed(manifest["scrapes"]):
            limit = F.when(F.col(MADE) < number, F.lit(time)).otherwise(limit)
        kind = self._types(manifest)["last_encounted"]
        late = F.col("last_encounted") <= limit.cast(kind) - F.make_dt_interval(F.lit(self.days))
        return F.coalesce(late, F.lit(False)) if manifest["scrapes"] else F.lit(False)

    def _present(self, manifest: dict, wanted: list[int] | None = None) -> DataFrame:
        rows = self._state(manifest, wanted)
        return rows.withColumn("sequence_broken", F.when(unbroken(), self._broken_since(manifest)).otherwise(F.col("sequence_broken"))).drop(MADE)

    def read(self) -> DataFrame:
        """The store as it is: what rewriting it whole after each batch would have left."""
        return self._present(self.manifest())

    # --- writing ---------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, manifest: dict, number: int, layers: dict[str, list[str]]) -> dict[str, list[str]]:
        """A new layer of the rows; returns the layers of all buckets with it."""
        folder = f"layers/{number:012d}-{uuid.uuid4().hex[:8]}"
        typed = self._types(manifest)
        placed = rows.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in typed.items()]).withColumn(MADE, F.lit(number).cast("long")).withColumn(BUCKET, self._bucket_of(manifest, typed))
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        new = {n.split("=")[1]: f"{folder}/{n}" for n in self._files.names(folder) if n.startswith(f"{BUCKET}=")}
        return {**layers, **{b: [*layers.get(b, []), p] for b, p in new.items()}}

    def upsert(self, batch: DataFrame, scrape_time: datetime, source: str | None = None, place: int | None = None) -> None:
        """Apply a batch (batch_row_id, ids, date_scraped).

        Only buckets that hold the batch's ids are read, and only sequences that it refreshed or began are written.
        With a source and the batch's place in it, a batch that was applied before is passed over.
        """
        manifest = self.manifest()
        if source is not None and manifest["batches"].get(source, -1) >= place:
            return
        manifest = self._compacted(manifest)
        ids, typed, number = manifest["ids"], self._types(manifest), manifest["number"] + 1
        if sorted(id_columns(batch)) != sorted(ids):
            raise ValueError(f"the batch has {sorted(id_columns(batch))}, the store {sorted(ids)}")
        batch = batch.withColumns({c: F.col(f"`{c}`").cast(typed[c]) for c in ids})
        wanted = [r[0] for r in batch.select(self._bucket_of(manifest, typed)).distinct().collect()]  # one for each bucket at most
        aged = expire(self._present(manifest, wanted), scrape_time, self.days)
        seen = batch.select(*[F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(ids)]).distinct()
        met = null_safe([F.col(f"`{c}`") for c in ids], [F.col(f"_b{i}") for i in range(len(ids))])
        held = aged.where(unbroken() & F.col("first_encounted").isNotNull() & F.col("last_encounted").isNotNull()).join(seen, met, "left_semi")
        new = dense_index(as_sequences(unmatched(aged, batch)), "batch_row_id", "_place").withColumn("row_id", F.lit(manifest["next_row"] + 1).cast("long") + F.col("_place"))
        columns = ["row_id", *ids, *STORE]
        layers = self._write(refresh(held, batch).select(*columns).unionByName(new.select(*columns)), manifest, number, manifest["layers"])
        largest = self._layer(manifest, [ls[-1] for b, ls in layers.items() if ls != manifest["layers"].get(b)]).agg(F.max("row_id")).first()[0]
        time = scrape_time.strftime("%Y-%m-%d %H:%M:%S.%f")
        scrapes = [s for s in manifest["scrapes"] if s[1] > time] + [[number, time]]
        self._commit({
            **manifest, "number": number, "layers": layers, "scrapes": scrapes, "next_row": max(manifest["next_row"], -1 if largest is None else largest),
            "batches": {**manifest["batches"], source: place} if source is not None else manifest["batches"],
        })
        self._clean()

    def _compacted(self, manifest: dict) -> dict:
        full = [int(b) for b, ls in manifest["layers"].items() if len(ls) > self.most_layers]
        return self._rewritten(manifest, full) if full else manifest

    def compact(self) -> None:
        """Write the present state of every bucket that has more than one layer as one layer."""
        manifest = self.manifest()
        full = [int(b) for b, ls in manifest["layers"].items() if len(ls) > 1]
        if full:
            self._rewritten(manifest, full)
            self._clean()

    def _rewritten(self, manifest: dict, full: list[int]) -> dict:
        number = manifest["number"] + 1
        others = {b: ls for b, ls in manifest["layers"].items() if int(b) not in full}
        found = {**manifest, "number": number, "layers": self._write(self._present(manifest, full), manifest, number, others)}
        if not any(p for b, ls in others.items() for p in ls):
            found["scrapes"] = []  # no row is older than its state
        self._commit(found)
        return found

    def _clean(self) -> None:
        """Remove manifests before the last ones kept, and layers that none of those names and that are not newer."""
        numbers = self._numbers()
        for n in numbers[: -self.kept]:
            self._files.delete(f"manifests/{n:012d}.json")
        named = set()
        for n in numbers[-self.kept :]:
            named |= {p.split("/")[1] for ls in self._files.read_json(f"manifests/{n:012d}.json")["layers"].values() for p in ls}
        for folder in self._files.names("layers"):
            if folder not in named and int(folder.split("-")[0]) < numbers[-1]:
                self._files.delete(f"layers/{folder}")

    def layer_bytes(self) -> dict[str, int]:
        """Bytes of each layer's folder."""
        return {n: self._files.size(f"layers/{n}") for n in self._files.names("layers")}
