"""The store's upsert over a stream of scrape batches.

Every micro-batch is one scrape: its scrape time is its latest date, and late batches overwrite as they do in batch mode
(no watermark drops them).  Versions make a repeated micro-batch harmless: the upsert of the same batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import as_sequences
from ..operators.sequences import EXPIRY_DAYS, id_columns, upsert
from ..functions.ordering import dense_index
from ..sources.io import Store
from ..sources.merging_store import MergingStore


def apply_batch(store: Store | MergingStore, batch: DataFrame, days: int = EXPIRY_DAYS, batch_id: int | None = None) -> None:
    """Upsert one micro-batch; the first one makes the store.

    A merging store (whose own days count) writes the batch's rows alone and passes over a batch_id it has seen.
    """
    latest = batch.agg(F.max("date_scraped")).first()[0]
    if latest is None:
        return
    if isinstance(store, MergingStore):
        if not store.exists():
            rows = as_sequences(batch.limit(0).withColumn("row_id", F.lit(0).cast("long"))).drop("batch_row_id")
            store.create(rows, id_columns(batch))
        store.upsert(batch, latest, "stream" if batch_id is not None else None, batch_id)
    elif store.exists():
        store.write(upsert(store.read(), batch, latest, days))
    else:
        rows = dense_index(as_sequences(batch), "batch_row_id", "row_id")
        store.write(rows.select("row_id", *[c for c in rows.columns if c not in ("row_id", "batch_row_id")]))


def stream_upserts(batches: DataFrame, store: Store | MergingStore, checkpoint: str, days: int = EXPIRY_DAYS, **trigger) -> StreamingQuery:
    """Start the query; trigger as for DataStreamWriter.trigger (availableNow by default)."""
    writer = batches.writeStream.foreachBatch(lambda df, n: apply_batch(store, df, days, n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
