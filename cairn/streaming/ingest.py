"""Streams into collections: each micro-batch is one bulk upsert, so one revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.collection import Collection
from cairn.schema import PK


def stream_into(stream: DataFrame, collection: Collection, checkpoint: str, order: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Upsert a streaming DataFrame with the collection's columns. Of rows with one key in a batch the
    last by ``order`` counts (any, without one). A batch that runs again puts the same rows again."""

    def put(batch: DataFrame, _: int) -> None:
        last = Window.partitionBy(PK).orderBy(F.col(order).desc() if order else F.lit(0))
        collection.upsert_frame(batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n"))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
