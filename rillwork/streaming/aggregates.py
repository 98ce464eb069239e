"""Windowed and running aggregates over event streams, and a bounded drain for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.session import work_folder


def gauge_daily(readings: DataFrame, delay: str = "2 days") -> DataFrame:
    """Sum and count per gauge and day as readings arrive; late ones count until the watermark."""
    return (readings.withWatermark("ts", delay).groupBy("site", F.window("ts", "1 day"))
            .agg(F.sum("value").alias("total"), F.count("*").alias("n"))
            .select("site", F.col("window.start").alias("day"), "total", "n"))


_MONTH_DAYS = 31


def _month_clock(ts):
    """An event time in which every month takes 31 days, so that months are windows of one width.

    It runs with the calendar and leaps over the days that a month has not got, three at most.
    """
    months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    seconds = F.unix_seconds(ts) - F.unix_seconds(F.date_trunc("day", ts))
    return F.timestamp_seconds((months * _MONTH_DAYS + F.dayofmonth(ts) - 1).cast("bigint") * 86_400 + seconds)


def _calendar_month(clock):
    months = F.floor(F.unix_seconds(clock) / (_MONTH_DAYS * 86_400)).cast("int")
    return F.make_date(1970 + F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))


def gauge_monthly(readings: DataFrame, delay_days: int = 2) -> DataFrame:
    """Mean of the daily means per gauge and month, put out once the month is closed (append mode).

    Two windows in one query: readings to days, days to months. State holds the open days
    and months only. A reading may come ``delay_days`` late (and up to three days less at
    the end of a month, which is why three are added to the watermark); later ones are left out.
    """
    timed = readings.where("ts IS NOT NULL").withColumn("clock", _month_clock(F.col("ts"))).withWatermark("clock", f"{delay_days + 3} days")
    days = timed.groupBy("site", F.window("clock", "1 day").alias("day")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    months = days.groupBy("site", F.window(F.window_time("day"), f"{_MONTH_DAYS} days").alias("month")).agg(
        F.avg("mean").alias("mean"), F.count("*").alias("days"), F.sum("n").alias("readings"))
    return months.select("site", _calendar_month(F.col("month.start")).alias("month"), "mean", "days", "readings")


def gauge_running(readings: DataFrame) -> DataFrame:
    """Running mean of all readings per gauge and month (update mode); months are never closed."""
    month = F.date_trunc("month", "ts")
    return readings.groupBy("site", month.alias("month")).agg((F.sum("value") / F.count("*")).alias("mean"), F.count("*").alias("n"))


def product_counters(events: DataFrame) -> DataFrame:
    """Running counts per product and event (update mode)."""
    return events.groupBy("product", "event").agg(F.count("*").alias("n"), F.sum("duration_s").alias("duration_s"))


def event_rate(events: DataFrame, size: str = "2 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events per sliding window."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "event").agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("start"), "event", "n"))


def table_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = 64) -> DataFrame:
    """A staged table, one file or a folder of part files, read as a stream of its files.

    Without ``files_per_trigger`` all available files come in one trigger.
    """
    name = f"{table}.parquet"
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        rows = reader.parquet(f"{folder}/{name}")
    else:
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    # event time needs zoned timestamps
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in rows.dtypes])


def time_span(spark: SparkSession, folder: str, table: str, time: str) -> str:
    """A delay that covers a staged table, so that no row is late in whatever order its files come."""
    days = spark.read.parquet(f"{folder}/{table}.parquet").agg(F.date_diff(F.max(time), F.min(time))).first()[0]
    return f"{(days or 0) + 1} days"


def drained(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over everything available and returns what it put out.

    In update mode every batch holds new versions of changed keys; the last version
    of each key is kept. A replayed batch replaces its own output.
    """
    spark = stream.sparkSession
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    put_out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not put_out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(put_out):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    out = spark.read.schema(full).option("basePath", f"{base}/out").parquet(f"{base}/out")
    if mode != "update":
        return out.drop("batch")
    rest = [c for c in out.columns if c not in keys and c != "batch"]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])
