"""Realtime counts of a stream, open windows included, with late rows counted apart (RT-1, RT-4).

Every epoch writes one small table of its own: counts by pane (one slide of time), dimensions and lateness. The
folder's name is the epoch, so an epoch that is run again replaces what it wrote, and nothing is counted twice.
Windows are sums of panes, made when they are read: an event is one row of a pane, not one of each window.

A row is late if its time is more than `lateness` minutes before the latest time of all earlier epochs. Late rows, and
those without a time, are in no window. A null dimension is a value like others. A stream without rows has no table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minutes(n):
    return F.make_dt_interval(mins=n if not isinstance(n, int) else F.lit(n))


def write_epoch(batch: DataFrame, epoch: int, path: str, dims=("event_name",), slide: int = 1, lateness: int = 10):
    """Adds one epoch's counts by pane; the same epoch again writes the same table."""
    spark, kind = batch.sparkSession, batch.schema["ts"].dataType
    late = F.isnull("ts")
    if epoch > 0:
        latest = spark.read.parquet(f"{path}/marks").where(F.col("epoch") < epoch).agg(F.max("latest").cast("string")).first()[0]
        late = late if latest is None else late | (F.col("ts") < F.lit(latest).cast(kind) - minutes(lateness))
    at = F.date_trunc("MINUTE", "ts").cast(kind)
    minute = (F.unix_micros(at.cast("timestamp")) / 60_000_000).cast("long")
    pane = at - minutes((minute % slide).cast("int"))
    rows = batch.groupBy(pane.alias("pane"), *dims, late.alias("late")).agg(F.count("*").alias("event_count"), F.max("ts").alias("latest"))
    rows.write.mode("overwrite").parquet(f"{path}/panes/epoch={epoch}")
    spark.read.schema(rows.schema).parquet(f"{path}/panes/epoch={epoch}").agg(F.max("latest").alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")


def realtime_table(stream: DataFrame, path: str, checkpoint: str, dims=("event_name",), slide: int = 1, lateness: int = 10, **trigger):
    """Starts the query that keeps the panes of `stream` (ts and `dims`) under `path`, a folder of its own that driver
    and executors share; `trigger` as for a stream writer."""
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, path, dims, slide, lateness))
    return writer.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windows(spark, path: str, dims=("event_name",), window: int = 30, slide: int = 1, lateness: int = 10) -> DataFrame:
    """All windows with an event as of now: window_start, window_end, dims, event_count, and whether `closed`: no row that
    is still to come can be counted in it."""
    if window % slide:
        raise ValueError(f"{window} minutes are no whole number of slides of {slide}")
    panes = spark.read.parquet(f"{path}/panes")
    summed = panes.where("NOT late").groupBy("pane", *dims).agg(F.sum("event_count").alias("n"))
    back = F.explode(F.sequence(F.lit(0), F.lit(window - slide), F.lit(slide)))
    each = summed.select("*", back.alias("back")).withColumn("window_start", F.col("pane") - minutes(F.col("back")))
    out = each.groupBy("window_start", *dims).agg(F.sum("n").alias("event_count")).withColumn("window_end", F.col("window_start") + minutes(window))
    mark = spark.read.parquet(f"{path}/marks").agg((F.max("latest") - minutes(lateness)).alias("mark"))  # one row
    return out.crossJoin(F.broadcast(mark)).select("window_start", "window_end", *dims, "event_count", (F.col("window_end") <= F.col("mark")).alias("closed"))


def late_counts(spark, path: str, dims=("event_name",)) -> DataFrame:
    """Rows that came too late or have no time: dims, late."""
    return spark.read.parquet(f"{path}/panes").where("late").groupBy(*dims).agg(F.sum("event_count").alias("late"))
