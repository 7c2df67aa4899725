"""Streams of changes: quiet-period batches, event-time counts, running degrees, graph upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.incremental import merge_graph


def debounce_batches(events: DataFrame, quiet_seconds: float, key: str | None = None) -> DataFrame:
    """``batch_start, batch_end, n``: runs of events with gaps up to the quiet period. The batch twin of the stream.

    Events are summed up by time slot, and slots by hour; no gap within a slot can end a batch, so a window over one
    row a slot finds the starts. Without a key the slots of each hour are windowed apart and the hours' ends are put
    together in a window over one row an hour: no task holds the events, however many there are.
    """
    part = [key] if key else []
    second = lambda c: c.cast("timestamp").cast("double")
    slots = events.where("ts is not null").groupBy(*part, "ts").agg(F.count(F.lit(1)).alias("k"))
    slots = slots.withColumn("hour", F.date_trunc("hour", "ts"))
    inner = Window.partitionBy(*part, "hour").orderBy("ts")
    gap = second(F.col("ts")) - second(F.lag("ts").over(inner))
    local = slots.withColumn("step", F.coalesce((gap > quiet_seconds).cast("long"), F.lit(0).cast("long")))
    local = local.withColumn("local", F.sum("step").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    runs = local.groupBy(*part, "hour", "local").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("k").alias("k"))
    hours = runs.groupBy(*part, "hour").agg(F.min("first").alias("h_first"), F.max("last").alias("h_last"), F.max("local").alias("breaks"))
    outer = Window.partitionBy(*part).orderBy("hour")  # one row an hour
    since = second(F.col("h_first")) - second(F.lag("h_last").over(outer))
    hours = hours.withColumn("starts", F.coalesce((since > quiet_seconds).cast("long"), F.lit(1).cast("long")))
    hours = hours.withColumn("before", F.sum(F.col("starts") + F.col("breaks")).over(outer.rowsBetween(Window.unboundedPreceding, 0)) - F.col("breaks"))
    whole = runs.join(hours.select(*part, "hour", "before"), [*part, "hour"]).withColumn("run", F.col("before") + F.col("local"))
    return whole.groupBy(*part, "run").agg(F.min("first").alias("batch_start"), F.max("last").alias("batch_end"), F.sum("k").alias("n")).drop("run")


def debounce_stream(events: DataFrame, quiet: str = "3 seconds", late: str = "10 seconds", key: str = "path") -> DataFrame:
    """Session windows of a stream of (ts, key): one row for each quiet period's end."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), key).agg(F.count(F.lit(1)).alias("n"))


def tumbling_counts(events: DataFrame, size: str, late: str, by: str) -> DataFrame:
    """``start, end, by, n`` of a batch or a stream; late rows beyond the watermark are dropped by a stream."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    g = src.groupBy(F.window("ts", size), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def distinct_paths(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A queue without repeats: blanks go, each path comes once within the watermark."""
    src = events.where("path is not null and trim(path) <> ''")
    return src.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path"]) if src.isStreaming else src.dropDuplicates(["path"])


def running_degree(edges: DataFrame) -> DataFrame:
    """``id, degree`` of a stream of edges (or of a table): a stateful count of the ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def upsert_graph(path: str):
    """A function for ``foreachBatch``: replaces the nodes and edges of the files that a batch holds.

    A batch has (kind, id, label, source_file, src, dst, relation). Each batch writes the snapshot named by its number
    from the one before, so that a batch that is run again gives the same snapshot.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        n = batch.where("kind = 'node'").select("id", "label", "source_file")
        e = batch.where("kind = 'edge'").select("src", "dst", "relation", "source_file")
        if epoch > 0:
            old = [spark.read.parquet(f"{path}/{x}/{epoch - 1}") for x in ("nodes", "edges")]
            n, e = merge_graph(*old, n, e)
        n.write.mode("overwrite").parquet(f"{path}/nodes/{epoch}")
        e.write.mode("overwrite").parquet(f"{path}/edges/{epoch}")

    return apply


class Reloaded:
    """A table that is read again once its files have changed: by newest time, bytes and number of files."""

    def __init__(self, spark: SparkSession, path: str, read):
        self.spark, self.path, self.read = spark, path, read
        self._version, self._table = None, None

    def version(self) -> tuple:
        # names, times and sizes only: the scan doesn't open the files
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path)
        return tuple(files.agg(F.max("modificationTime"), F.sum("length"), F.count(F.lit(1))).first())

    def get(self) -> DataFrame:
        now = self.version()
        if now != self._version:
            self._table, self._version = self.read(self.path), now
        return self._table
