"""Sinks: the decision log by day, fixed-width lines, merged call stores and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import lookups
from ..plans.store import stored


def write_decisions(decisions: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends decisions by day (dt), so readers prune days and retention drops whole folders."""
    decisions.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)


def recent_decisions(spark: SparkSession, path: str, today: str, days: int = 3) -> DataFrame:
    """What retention keeps: the last days, today included, by partition pruning."""
    return spark.read.parquet(path).where(F.col("dt") > F.date_sub(F.lit(today).cast("date"), days))


def write_lines(spots: DataFrame, line: str, path: str) -> None:
    spots.select(F.col(line).alias("value")).write.mode("append").text(path)


def merge_store(spark: SparkSession, path: str, new: DataFrame, version: str) -> str:
    """Merges new rows into the call store at path/<old version> and writes path/<version>; the old version stays until the caller drops it, so a failed write loses nothing. Returns the new place."""
    old = spark.read.parquet(path)
    place = f"{path.rstrip('/')}-{version}"
    lookups.merge_calls(old, new).write.mode("overwrite").parquet(place)
    return place


def report_lines(summary: dict, reasons: list[tuple[str, int]], bands: list[tuple]) -> list[str]:
    """The daily report as text lines, from aggregates of a few rows."""
    out = [f"Decisions: {summary['decisions']}  applied: {summary['applied']}  pairs: {summary['applied_pairs']}"]
    out += [f"  {reason or '(none)':<20}{n:>8}" for reason, n in sorted(reasons, key=lambda x: (-x[1], x[0]))]
    return out + [f"  {b[0]:<6} total {b[1]} matched {b[2]}" for b in sorted(bands)]


def append_history(spots: DataFrame, path: str, order: tuple[str, str] = ("t", "event_id")) -> None:
    """Appends spots with spot_id, which goes on from the largest one stored, in order of time, and by hour, so that readers prune. Ids come from counts of each hour: no window over all rows."""
    spark = spots.sparkSession
    hour = F.floor(F.col(order[0]) / 3600).cast("long")
    try:
        last = spark.read.parquet(path).agg(F.max("spot_id")).first()[0]
    except AnalysisException:
        last = None
    held = spots.drop("spot_id").withColumn("hour", hour)
    counts = held.groupBy("hour").agg(F.count("*").alias("n"))
    # a row an hour
    starts = counts.select("hour", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("hour")) - F.col("n") + F.lit((last or 0) + 1)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("hour").orderBy(*order)) - 1
    held.withColumn("_rank", rank).join(starts, "hour").withColumn("spot_id", (F.col("_start") + F.col("_rank")).cast("long")).drop("_start", "_rank").write.mode("append").partitionBy("hour").parquet(path)


#: Rows of a skew file.
SKEW_ROWS = 1 << 18


def write_skew_json(skew: DataFrame, path: str) -> None:
    """The skew table (call, skew_hz, spots, factor) as a JSON array, by call: a row for each reporter. A table of more than SKEW_ROWS rows becomes several files, written side by side, each an array of the calls between those of the files before and after
    it. Without rows: an error, as such a file can't be used."""
    rows = skew.select(F.col("call").alias("callsign"), "skew_hz", "spots", F.col("factor").alias("correction_factor"))
    n = -(-rows.count() // SKEW_ROWS)
    if n == 0:
        raise ValueError("no skew entries to write")

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = "["  # the line that is followed by a comma, or by the end
        for b in batches:
            if b.num_rows:
                lines = pc.binary_join_element_wise("  ", b.column(0), ",", "")
                yield pa.RecordBatch.from_pydict({"value": pa.concat_arrays([pa.array([held], lines.type), lines[:-1]])})
                held = lines[-1].as_py()
        yield pa.RecordBatch.from_pydict({"value": pa.array(["[]"] if held == "[" else [held[:-1], "]"])})

    dealt = rows.coalesce(1) if n == 1 else rows.repartitionByRange(n, "callsign")
    lines = dealt.sortWithinPartitions("callsign").select(F.to_json(F.struct("*")).alias("value"))
    lines.mapInArrow(array, "value string").write.mode("overwrite").text(path)


def refresh_skew(spark: SparkSession, source: str, target: str, min_spots: int = 0) -> None:
    """A skew CSV as the JSON that a service reads."""
    from .feeds import read_skew

    write_skew_json(read_skew(spark, source, min_spots), target)


def append_aggregate(rows: DataFrame, path: str) -> None:
    """Appends an aggregated feed by minute; recent_aggregate() reads what retention keeps."""
    rows.withColumn("minute", F.date_trunc("minute", "ts")).write.mode("append").partitionBy("minute").parquet(path)


def recent_aggregate(spark: SparkSession, path: str, now: str, seconds: int = 900) -> DataFrame:
    return spark.read.parquet(path).where(F.col("ts") > F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) - seconds)).drop("minute")


def upsert_calls(stream: DataFrame, path: str, checkpoint: str, trigger: str = "60 seconds", once: bool = False, buckets: int = 64):
    """A writer that merges each micro-batch into the call store at path, which lies in buckets of calls: only those that the micro-batch touches are written anew (Spark's dynamic partition overwrite). Rows carry the number of the
    micro-batch that wrote them, so one that is repeated leaves the buckets alone that it has written already."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = stored(batch.withColumn("bucket", F.pmod(F.xxhash64("call"), F.lit(buckets)).cast("int")), "calls")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        old = _call_store(spark, path)
        if old is not None:
            held = old.where(F.col("bucket").isin(touched))
            done = [r["bucket"] for r in held.groupBy("bucket").agg(F.max("batch").alias("n")).where(F.col("n") >= number).collect()]
            touched = [b for b in touched if b not in done]
            new, old = new.where(F.col("bucket").isin(touched)), held.where(F.col("bucket").isin(touched)).drop("batch", "bucket")
        if not touched:
            return
        rows = new.drop("bucket")
        merged = lookups.merge_calls(old if old is not None else rows.limit(0), rows)
        merged = stored(merged.withColumns({"batch": F.lit(number).cast("long"), "bucket": F.pmod(F.xxhash64("call"), F.lit(buckets)).cast("int")}), "merged")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=trigger)).start()


def _call_store(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path)


def newest_calls(spark: SparkSession, path: str) -> DataFrame | None:
    """The call store that upsert_calls() keeps; None if there is none yet."""
    held = _call_store(spark, path)
    return held.drop("batch", "bucket") if held is not None else None
