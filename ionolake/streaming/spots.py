"""The spot operators on Structured Streaming: watermarked counts, the anchor dedup as keyed state, and micro-batch delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters


def tumbling_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """window_start, by..., n: counts of event-time windows; rows later than the watermark drop."""
    x = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = x.groupBy(F.window("_ts", width), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), *by, "n")


def anchor_dedup(spots: DataFrame, keys: list[str], window: int, expire_ms: int | None = None, prefer_stronger: bool = True, pass_through: str | None = None) -> DataFrame:
    """The anchor dedup on a stream: keys..., event_id of what is forwarded, by the batch operator's rule: a row without a report counts as 0, the first report after such an anchor passes. pass_through: SQL of rows that are always
    forwarded (they touch no state). State is one anchor a key, dropped when the key has been silent for expire_ms of processing time (None: kept, so state grows with the keys; a query that runs what is there and stops needs
    that, since such a timeout asks for batches without end). Rows of a micro-batch are taken in order of (t, event_id) and a key's batches follow each other; over one batch the result equals the batch operator's."""
    kinds = dict(spots.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", event_id long"

    def step(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        anchor, value, reported = state.get if state.exists else (None, 0, False)
        kept = []
        for t, i, r, has in zip(rows["t"].tolist(), rows["event_id"].tolist(), rows["r"].tolist(), rows["has"].tolist(), strict=True):
            if anchor is None or abs(t - anchor) >= window or (has and not reported) or (prefer_stronger and r > value):
                anchor, value, reported = t, r, has
                kept.append(i)
        state.update((anchor, value, reported))
        if expire_ms:
            state.setTimeoutDuration(expire_ms)
        if kept:
            yield pd.DataFrame({**{k: [v] * len(kept) for k, v in zip(keys, key, strict=True)}, "event_id": kept})

    report = F.col("report").cast("long")
    passes = F.expr(f"coalesce({pass_through}, false)") if pass_through else F.lit(False)
    x = spots.where(~passes).select(*keys, "t", "event_id", F.coalesce(report, F.lit(0)).alias("r"), report.isNotNull().alias("has"))
    kept = x.groupBy(*keys).applyInPandasWithState(step, out, "t long, r long, has boolean", "append", "ProcessingTimeTimeout" if expire_ms else "NoTimeout")
    return kept.unionByName(spots.where(passes).select(*keys, "event_id")) if pass_through else kept


def deliver_to(spots: DataFrame, subscribers: Callable[[], list[tuple[str, filters.Filter]]], path: str, trigger: str = "250 milliseconds"):
    """A writer that appends each micro-batch's deliveries as Parquet by subscriber; the filters are read anew for each batch."""

    def write(batch: DataFrame, _: int) -> None:
        filters.deliver(batch, subscribers()).write.mode("append").partitionBy("subscriber").parquet(path)

    return spots.writeStream.foreachBatch(write).trigger(processingTime=trigger)


def with_memory(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], window: int, out: str, memory: str, checkpoint: str, once: bool = True):
    """Runs a batch operator whose result for a spot depends on the spots of the window before it (votes and decisions, harmonics, averages, the whole pipeline) on a stream of spots (event_id, t, ...).

    Each micro-batch is joined by what memory holds of the window before its first spot; the operator runs on both, and its rows for the new spots (by event_id) go to out. The batch then becomes a part of memory, and parts that lie before the window are
    deleted, so state is one window of spots, in the shared store. Parts are written by batch number: a batch that is repeated after a failure replaces its own parts. Spots that come later than the window see what is left of it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{memory}/part={number}")
        new = spark.read.parquet(f"{memory}/part={number}")
        first = new.agg(F.min("t")).first()[0]
        if first is None:
            return
        held = spark.read.option("basePath", memory).parquet(f"{memory}/part=*").where(F.col("part") <= number)
        spans = {r["part"]: r["last"] for r in held.groupBy("part").agg(F.max("t").alias("last")).collect()}  # one row a part
        rows = held.where(F.col("t") >= first - window).drop("part")
        operator(rows).join(new.select("event_id"), "event_id", "left_semi").write.mode("overwrite").parquet(f"{out}/part={number}")
        gone = [p for p, last in spans.items() if last is not None and last < first - window and p != number]
        for p in gone:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{memory}/part={p}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()
    if once:
        q.awaitTermination()
    return q


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there now as Parquet, and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
