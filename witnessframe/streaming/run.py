"""Run a streaming query over files to its end and hand back what it wrote."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, shared_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream of one table's file(s); naive timestamps become UTC instants, which watermarks need."""
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    naive = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({n: F.col(n).cast("timestamp") for n in naive})


# Later than any event (and within the range of nanosecond clocks), so a watermark that has seen it closes everything before.
END_OF_TIME = "2250-01-01 00:00:00"


def closable(stream: DataFrame, time: str = "ts") -> tuple[DataFrame, Callable[[], None]]:
    """``stream`` with a sentinel source beside it, and what sends the sentinel: a row with nothing but an end-of-time ``time``.

    Windows, sessions and timers that only wait for the watermark come out once it is sent.
    It must be sent after all events, or they count as late.
    """
    spark = stream.sparkSession
    folder = os.path.join(shared_folder(spark), f"sentinel-{uuid.uuid4().hex}")
    spark.createDataFrame([], stream.schema).write.parquet(folder)
    ends = [F.lit(END_OF_TIME if f.name == time else None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    sentinel = spark.readStream.schema(stream.schema).parquet(folder)
    return stream.unionByName(sentinel), lambda: spark.range(1).select(*ends).write.mode("append").parquet(folder)


def run_to_end(stream: DataFrame, name: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Append everything available to a parquet table in the shared folder and read it.

    ``close`` (of ``closable``) is called once all input is read; the query then goes on from its checkpoint.
    """
    spark = stream.sparkSession
    base = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")

    def run() -> None:
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    if close:
        close()
        run()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, write, name: str, base: str | None = None) -> str:
    """Run a ``foreachBatch`` sink to the end of the available input; returns its checkpoint folder."""
    spark = stream.sparkSession
    base = base or os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return base
