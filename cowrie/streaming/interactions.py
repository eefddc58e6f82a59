"""Streams of exchanges: the rules on arriving questions, and windowed metrics with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cowrie.operators.guard import Rules, outcome


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def judged(questions: DataFrame, rules: Rules, question: str = "question") -> DataFrame:
    """Stateless: the same columns as on a table."""
    return questions.withColumn("outcome", outcome(F.col(question), rules))


def tumbling(events: DataFrame, at: str, kind: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, total) per window; rows later than the watermark are dropped on a stream, kept on a table."""
    marked = events.withWatermark(at, late)
    return marked.groupBy(F.window(at, width).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n) of a user's exchanges without a pause of `gap`."""
    marked = events.withWatermark(at, late)
    return marked.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique_within(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, write Parquet, and stop; restarts go on from the checkpoint."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_complete(grouped: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and keep the whole aggregate of the last batch at out."""
    query = grouped.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
