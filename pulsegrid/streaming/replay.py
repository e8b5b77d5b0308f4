"""Running a bounded stream to its end through a file sink."""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.session import ROCKSDB, shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CLOSING = "9000-01-01 00:00:00"

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """Event samples of a table (one file, or a folder of part files of any names) as a stream with an instant ``ts``.

    Without a limit all files that are there make one batch, so their order and borders do not matter.
    """
    s = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        s = s.option("maxFilesPerTrigger", files_per_trigger)
    s = s.parquet(f"{table[:-1]}[{table[-1]}]")       # as a pattern the path may be a file or a folder
    return s.withColumns({"ts": F.col("ts").cast("timestamp"), "valid": F.col("event_type") != "error"})


def run_to_end(stream: DataFrame, name: str, mode: str = "append", base: str | None = None, provider: str | None = None,
               progress: list | None = None) -> DataFrame:
    """Process everything available into Parquet files and return them as a table; a ``base`` folder used again goes on from its state.

    ``provider`` names the state store of this query only: the session's own setting is put back once the query has started. The reports of
    the run's batches are added to ``progress``.
    """
    spark = stream.sparkSession
    base = base or shared_folder(spark, name)
    writer = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
              .outputMode(mode).trigger(availableNow=True))
    before = spark.conf.get(PROVIDER, None)
    try:
        if provider:
            spark.conf.set(PROVIDER, provider)
        q = writer.start()
    finally:
        if provider:
            spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)
    q.awaitTermination()
    if progress is not None:
        progress += [json.loads(p.json) for p in q.recentProgress]
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drained(events: DataFrame, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run ``build`` over a bounded event stream and then close it: one row at ``CLOSING`` joins the stream after all others are through, so
    the watermark passes everything that waits in state. ``build`` has to leave out rows from ``CLOSING`` on behind its watermark."""
    spark = events.sparkSession
    base = shared_folder(spark, name)
    end = f"{base}/closing"
    closing = spark.range(1).select(*[F.lit(CLOSING if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in events.schema])
    closing.where("false").write.parquet(end)
    whole = build(events.union(spark.readStream.schema(events.schema).parquet(end)))
    run_to_end(whole, name, base=base, provider=ROCKSDB)
    closing.write.mode("append").parquet(end)
    return run_to_end(whole, name, base=base, provider=ROCKSDB)
