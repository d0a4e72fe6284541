"""Streams: incremental ingest of what was not seen, windowed counts with late data, and interview sessions as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import append_new
from ..session import forget_at_end, scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A table's Parquet file, or the files of its folder, as a stream; ``files`` a micro-batch."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def ingest_new(stream: DataFrame, log: str, key: str, order: str, checkpoint: str) -> None:
    """Append to ``log`` each micro-batch's rows with keys it does not hold; stops when the stream is used up.

    Restarted with the same ``checkpoint`` it goes on where it stopped; a batch replayed after a failure adds nothing twice,
    because its keys are then known.
    """
    q = stream.writeStream.foreachBatch(lambda b, _: append_new(b, log, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """n and total of ``value`` by window and ``by``; rows later than ``late`` are dropped with their closed window."""
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(F.window("_t", size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_updates(result: DataFrame, spark: SparkSession, keys: list[str], name: str) -> DataFrame:
    """Run an aggregate stream to its end in update mode and give the last state of each of its groups.

    In this mode the watermark holds: late rows are dropped, and the state of closed windows is freed.  Each micro-batch writes the groups it
    changed under its own number, so a batch that is replayed replaces itself.
    """
    out, checkpoint = scratch(spark, name), scratch(spark, name + "-state")
    for path in (out, checkpoint):
        forget_at_end(spark, path)
    q = result.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(result.schema.add("batch", "long")).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*result.columns), "batch").alias("_r")).select("_r.*")


def sessions(stream: DataFrame, key: str, wants_more: str, most: int = 2) -> DataFrame:
    """Interview sessions as keyed state: ``key``, turns, answered; state is two counters a session.

    ``wants_more``: boolean column of a turn; after ``most`` follow-ups the next turn moves on.  Turns of one micro-batch are
    taken in order of their ``turn`` column.
    """

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, answered, followups = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("turn")
        for more in rows[wants_more].fillna(False):
            turns += 1
            if more and followups < most:
                followups += 1
            else:
                answered, followups = answered + 1, 0
        state.update((turns, answered, followups))
        yield pd.DataFrame({key: [k[0]], "turns": [turns], "answered": [answered]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, turns long, answered long", "turns long, answered long, followups long", "update", GroupStateTimeout.NoTimeout)
