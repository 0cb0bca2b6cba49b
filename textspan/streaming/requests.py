"""Requests that keep coming: the same matchers over a stream, results upserted by request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textspan.plans import best
from textspan.sources.stored import dropped

SCHEMA = "req_id long, html string, copied string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of requests from a folder of JSON files."""
    return spark.readStream.schema(SCHEMA).json(folder)


def placed(requests: DataFrame, method: str = "token", **settings) -> DataFrame:
    """One method over a stream: a row for a row, so no watermark or state is needed."""
    return best.attempt(best.prepared(requests), method, **settings)


def start(requests: DataFrame, sink: str, checkpoint: str, **settings) -> StreamingQuery:
    """The fallback chain over each batch, appended to ``sink``/batch=N: a batch that is run again
    replaces its own results."""

    def write(batch: DataFrame, number: int) -> None:
        made: list[DataFrame] = []
        best.best(best.prepared(batch), made=made, **settings).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        for t in made:
            dropped(t)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
