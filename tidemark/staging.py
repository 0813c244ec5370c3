"""Tables that are written once in the folder all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where none is set, a temporary one on a single machine, as in
    tests; on a cluster that is an error, as a machine's own folder goes with the machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Actions on frames made within it delete what they have shuffled when they end."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _goes_with_the_driver(spark: SparkSession, path: str) -> None:
    """What is at ``path`` is deleted when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here, nothing runs twice,
    and Spark forgets how the rows were dealt, so that joins on them get exchanges it can split.  The table is there
    as long as the driver is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # Instants as whole numbers: Spark's default for them is an array of bytes.
    with shuffles_dropped(spark), _held(spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
        df.select("*").write.parquet(path)
    _goes_with_the_driver(spark, path)
    return spark.read.schema(df.schema).parquet(path)
