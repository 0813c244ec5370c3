"""Incremental loads as Structured Streaming: the same operators, fed by what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(stream: DataFrame, keys: Sequence[str], time: str, lateness: str) -> DataFrame:
    """Each key once, even if delivered again within ``lateness``."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def bucket_last(stream: DataFrame, keys: Sequence[str], time: str, value: str, tiebreak: str, width: str, lateness: str) -> DataFrame:
    """The last value in each time bucket, emitted when the bucket is over."""
    g = stream.withWatermark(time, lateness).groupBy(*keys, F.window(time, width))
    return g.agg(F.max_by(value, F.struct(time, tiebreak)).alias(value)).select(*keys, F.col("window.start").alias("bucket"), value)


def sliding_vwap(stream: DataFrame, keys: Sequence[str], time: str, price: str, size: str, width: str, slide: str, lateness: str) -> DataFrame:
    g = stream.withWatermark(time, lateness).groupBy(*keys, F.window(time, width, slide))
    total = F.sum(size)
    return g.agg(F.when(total != 0, F.sum(F.col(price) * F.col(size)) / total).alias("vwap"), total.alias("volume")).select(*keys, F.col("window.end").alias("at"), "vwap", "volume")


def sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str, lateness: str) -> DataFrame:
    g = stream.withWatermark(time, lateness).groupBy(*keys, F.session_window(time, gap))
    return g.agg(F.count("*").alias("events")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def latest_values(stream: DataFrame, keys: Sequence[str], vendor: str, time: str, value: str, tiebreak: str) -> DataFrame:
    """Each key's newest value by vendor, kept as state; to be written in update mode, where a late value changes
    nothing that a newer one has set."""
    newest = F.max_by(F.struct(F.col(time).alias("at"), F.col(value).alias("value")), F.struct(time, tiebreak)).alias("n")
    return stream.filter(F.col(value).isNotNull()).groupBy(*keys, vendor).agg(newest).select(*keys, vendor, "n.*")


def append_new(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Rows whose key the table at ``path`` doesn't have yet; each batch is written under its own number, so a
    batch that runs again writes the same folder over."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(list(keys))
        jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            have = spark.read.parquet(path).filter(F.col("batch") != number).select(*keys)
            new = new.join(have, list(keys), "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def high_water(df: DataFrame, loaded: DataFrame, time: str, replay_all: bool = False) -> DataFrame:
    """Rows after the newest one that is loaded; all rows on a replay or when nothing is."""
    if replay_all:
        return df
    mark = loaded.agg(F.max(time).alias("__mark"))
    return df.join(F.broadcast(mark)).filter(F.col("__mark").isNull() | (F.col(time) > F.col("__mark"))).drop("__mark")
