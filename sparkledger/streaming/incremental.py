"""Incremental scans: classes that arrive are looked up in the cache, and only unknown contents are asked about."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.suggestions import classified
from ..schemas import CACHE_ENTRY

CLASSES = StructType([StructField("fqcn", StringType()), StructField("source", StringType())])
#: Answers as they are kept.
KEPT = StructType([CACHE_ENTRY["contentHash"], CACHE_ENTRY["promptSignature"], StructField("fqcn", StringType()), StructField("response", StringType())])


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(KEPT).option("recursiveFileLookup", True).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], KEPT)


def is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a write to a folder was committed."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def ask_unknown(batch: DataFrame, batch_id: int, path: str, model: Callable[[str, str], str], signature: str) -> int:
    """Asks about contents of a batch that the cache lacks, each once, writes the answers to the batch's own folder, and returns how many were asked.

    A batch that comes again after it was committed does nothing; one that failed half-way finds no committed
    folder and overwrites what it left. Classes of one content share an answer by design: it is kept under the content's digest and the prompt's signature.
    """
    spark, folder = batch.sparkSession, f"{path}/batch={batch_id}"
    if is_written(spark, folder):
        return 0
    hashed = batch.withColumn("content_hash", F.sha2("source", 256)).dropDuplicates(["content_hash"])
    known = read_kept(spark, path).where(F.col("promptSignature").isNull() | (F.col("promptSignature") == signature)).select(F.col("contentHash").alias("content_hash"))
    unknown = hashed.join(known, "content_hash", "left_anti").persist()
    try:
        n = unknown.count()
        answers = classified(unknown.select(F.col("content_hash").alias("fqcn"), "source"), model).withColumnRenamed("fqcn", "content_hash")
        rows = unknown.select("content_hash", "fqcn").join(answers, "content_hash")
        rows.select(F.col("content_hash").alias("contentHash"), F.lit(signature).alias("promptSignature"), "fqcn", "response").write.mode("overwrite").json(folder)
        return n
    finally:
        unknown.unpersist()


def scan_stream(spark: SparkSession, source: str, cache: str, checkpoint: str, model: Callable[[str, str], str], signature: str) -> StreamingQuery:
    """Follows a folder of classes (JSON lines) until what is there is done; a restart goes on from the checkpoint."""
    classes = spark.readStream.schema(CLASSES).json(source)
    return classes.writeStream.foreachBatch(lambda df, n: ask_unknown(df, n, cache, model, signature)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restart_counts(events: DataFrame, window: str = "60 seconds", late: str = "5 minutes", at: str = "ts", group: str = "user_id") -> DataFrame:
    """Restarts of each worker in tumbling windows, with late events up to a bound: a stream's form of the circuit breaker's count."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), group).agg(F.count("*").alias("n"))
