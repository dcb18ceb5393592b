"""Spots projected from the events table: the data that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "spot_id long, dx_call string, de_call string, freq_khz double, band string, mode string, report int, has_report boolean, ts timestamp, comment string, source_type string, source_node string, "
    "is_human boolean, is_beacon boolean, confidence string, dx struct<continent:string,country:string,cq_zone:int,grid:string,itu_zone:int,adif:int>, de struct<continent:string,country:string,cq_zone:int,grid:string,itu_zone:int,adif:int>"
)

#: The same projection in DuckDB SQL, as the head of a WITH clause.
SPOTS_SQL = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
spots AS (SELECT event_id, event_id AS t, k, user_id, 14000.0::DOUBLE + CAST(k % 20 AS DOUBLE) / 10 AS freq_khz,
  'W' || CAST(user_id % 10 AS VARCHAR) || 'S' || CAST(user_id AS VARCHAR) AS de_call,
  'K' || CAST(k % 10 AS VARCHAR) || CASE WHEN user_id % 5 = 0 THEN 'AB8' WHEN user_id % 5 = 1 AND k % 3 = 0 THEN 'A88' WHEN user_id % 7 = 2 THEN 'Z88' WHEN user_id % 11 = 3 THEN 'QRST' ELSE 'ABC' END AS dx_call,
  CAST(FLOOR(value / 10) AS BIGINT) AS report,
  CASE event_type WHEN 'click' THEN 'CW' WHEN 'view' THEN 'RTTY' WHEN 'purchase' THEN 'FT8' WHEN 'signup' THEN 'FT4' ELSE 'USB' END AS mode,
  event_type = 'error' AS is_human, CAST(user_id % 25 AS BIGINT) AS adif
  FROM e)"""


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, t (seconds), k, user_id, freq_khz, de_call, dx_call, report, mode, is_human, adif."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    u, k = F.col("user_id"), F.col("k")
    tail = F.when(u % 5 == 0, "AB8").when((u % 5 == 1) & (k % 3 == 0), "A88").when(u % 7 == 2, "Z88").when(u % 11 == 3, "QRST").otherwise("ABC")
    mode = F.when(F.col("event_type") == "click", "CW").when(F.col("event_type") == "view", "RTTY").when(F.col("event_type") == "purchase", "FT8").when(F.col("event_type") == "signup", "FT4").otherwise("USB")
    return e.select(
        "event_id", F.col("event_id").alias("t"), "k", "user_id", (F.lit(14000.0) + (k % 20).cast("double") / 10).alias("freq_khz"),
        F.concat(F.lit("W"), (u % 10).cast("string"), F.lit("S"), u.cast("string")).alias("de_call"), F.concat(F.lit("K"), (k % 10).cast("string"), tail).alias("dx_call"),
        F.floor(F.col("value") / 10).cast("long").alias("report"), mode.alias("mode"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("is_human"), (u % 25).cast("long").alias("adif"),
    )
