"""Incremental runs: new datasets as a stream of files, each processed once by the batch transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from outlyr.sources.outputs import write_checkpoint


def undone(batch: DataFrame, out: str, key: str = "dtag") -> DataFrame:
    """Rows of datasets that the output folder has no partition for yet."""
    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return batch
    return batch.join(spark.read.parquet(out).select(key).distinct(), key, "left_anti")


def process_new(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], out: str, state: str, key: str = "dtag") -> StreamingQuery:
    """Run ``transform`` over files as they arrive in ``source`` and keep its rows by dataset in ``out``.

    A batch that is repeated after a failure finds its datasets done, or overwrites just their
    partitions, so the result is the same. Runs until all that is there is processed.
    """

    def each(batch: DataFrame, _: int) -> None:
        write_checkpoint(transform(undone(batch, out, key)), out)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_outliers(stream: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, mean and population deviation of a value by window and group, with late rows bounded by a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("peak"))
