"""Evidence as a stream: repeats dropped, arrivals counted, each batch matched with what came before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

#: How late a repeat or a late row may come.
LATENESS = "7 days"


def read(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_of_each(stream: DataFrame, key: str, time: str = "loaded_at", lateness: str = LATENESS) -> DataFrame:
    """The stream without repeats of a key within the lateness; the state kept is bounded by it. Null keys are left out."""
    return stream.where(F.col(key).isNotNull()).withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, time: str = "loaded_at", window: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """(day, evidence_type, units): units of each kind by day of arrival; a day is complete once the watermark passes it."""
    w = stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), "evidence_type").agg(F.count(F.lit(1)).alias("units"))
    return w.select(F.col("w.start").alias("day"), "evidence_type", "units")


def match_batches(facts: DataFrame, store: str, checkpoint: str, match: Callable[[DataFrame, DataFrame], DataFrame], found: str) -> StreamingQuery:
    """Each batch is matched with itself and all earlier facts, then stored. A batch that is run again replaces its own files."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            # Earlier batches only: one that is run again may have stored its facts before it failed.
            kept = spark._jvm.org.apache.hadoop.fs.Path(store)
            there = kept.getFileSystem(spark._jsc.hadoopConfiguration()).exists(kept)
            old = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", IntegerType())])).parquet(store).where(F.col("batch") < n).drop("batch") if there else batch.limit(0)
            match(batch, old).write.mode("overwrite").parquet(f"{found}/batch={n}")
            batch.write.mode("overwrite").parquet(f"{store}/batch={n}")
        finally:
            batch.unpersist()

    return facts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
