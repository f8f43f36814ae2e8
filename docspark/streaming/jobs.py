"""Documents that arrive as files are analysed as they come; a document analysed again replaces its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def analyse_stream(spark: SparkSession, folder: str, schema: str, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Reads new Parquet files of folder, analyses each batch and writes its results under the batch's own folder, so a
    batch that is run again after a failure overwrites itself."""
    rows = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(query: StreamingQuery) -> dict:
    """processing, done or error, and what the last batch read."""
    failed, last = query.exception(), query.lastProgress
    state = "error" if failed else "processing" if query.isActive else "done"
    return {"state": state, "error": str(failed) if failed else None, "rows": last["numInputRows"] if last else 0}
