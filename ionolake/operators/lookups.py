"""Enrichment joins: prefixes, skew, known calls, licences, grids, allotments, quality and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import radio

#: Rows up to which a look-up table is broadcast by hint; a larger one is left to Spark's own choice of join.
BROADCAST_ROWS = 200_000


def _small(table: DataFrame, rows: int | None) -> DataFrame:
    """table with a broadcast hint, where the caller says that it is small and it is: a larger one isn't read past the bound."""
    if rows is None or rows > BROADCAST_ROWS or table.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return table
    return F.broadcast(table)


def longest_prefix(df: DataFrame, call: Column | str, prefixes: DataFrame, prefix: str = "prefix", out: str = "entity", rows: int | None = None) -> DataFrame:
    """df with struct out: the row of prefixes whose key equals the call, or else is its longest prefix; null without a match.

    Distinct calls only are spread into their prefixes (a call's length many rows) and met in an equi-join, so a busy call costs one look-up. rows: how many
    prefixes there are, if known."""
    named = df.withColumn("_call", radio.prefix_call(call))
    calls = named.select("_call").where("_call is not null").distinct()
    spread = calls.select("_call", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_call"), F.lit(1))), lambda n: F.substring(F.col("_call"), F.lit(1), n))).alias("_key"))
    keyed = prefixes.select(F.col(prefix).alias("_key"), F.struct(*[F.col(c) for c in prefixes.columns]).alias("_entity"))
    found = spread.join(_small(keyed, rows), "_key").groupBy("_call").agg(F.max_by("_entity", F.length("_key")).alias(out))
    return named.join(found, "_call", "left").drop("_call")


def effective_prefix(df: DataFrame, call: str, prefixes: DataFrame, prefix: str = "prefix", out: str = "entity", rows: int | None = None) -> DataFrame:
    """longest_prefix() of the licence's base call, or of the call itself where that has none."""
    own = longest_prefix(df, call, prefixes, prefix, "_own", rows)
    both = longest_prefix(own, radio.base_call(call), prefixes, prefix, "_base", rows)
    return both.withColumn(out, F.coalesce("_base", "_own")).drop("_own", "_base")


def apply_skew(df: DataFrame, skew: DataFrame, rows: int | None = None) -> DataFrame:
    """df with freq_khz times the reporter's factor (skew: call, factor; factors of 1 or below 0 do nothing; of several rows of a call the largest factor), rounded to 0.1 where one applies."""
    table = skew.where("factor > 0 and factor <> 1").groupBy(F.upper("call").alias("_skimmer")).agg(F.max("factor").alias("factor"))
    joined = df.withColumn("_skimmer", F.upper("de_call")).join(_small(table, rows), "_skimmer", "left")
    return joined.withColumn("freq_khz", F.when(F.col("factor").isNotNull(), radio.half_up_tenth(F.col("freq_khz") * F.col("factor"))).otherwise(F.col("freq_khz"))).drop("_skimmer", "factor")


def flag_known(df: DataFrame, known: DataFrame, call: str = "dx_call", out: str = "is_known", rows: int | None = None) -> DataFrame:
    """df with a flag: the call is in known (column call)."""
    table = known.select(F.upper(F.trim("call")).alias("_known")).distinct().withColumn("_hit", F.lit(True))
    return df.withColumn("_known", F.upper(call)).join(_small(table, rows), "_known", "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_known", "_hit")


def active_calls(hd: DataFrame, am: DataFrame) -> DataFrame:
    """Calls of the amateur table whose licence header is active; hd: id, status; am: id, call."""
    return am.join(hd.where(F.upper("status") == "A").select("id"), "id", "left_semi")


def drop_unlicensed(df: DataFrame, licensed: DataFrame | None, adif: str, call: str, us_adif: int = 291) -> DataFrame:
    """Rows whose side is not of the US, or whose base call is licensed (column call); without a table all pass."""
    if licensed is None:
        return df
    return flag_unlicensed(df, licensed, adif, call, us_adif, "_unlicensed").where("not _unlicensed").drop("_unlicensed")


def flag_unlicensed(df: DataFrame, licensed: DataFrame, adif: str, call: str, us_adif: int = 291, out: str = "unlicensed") -> DataFrame:
    """df with a flag: the side is of the US and its base call isn't licensed. One join; sides of elsewhere keep a key each, which meets nothing."""
    us = F.coalesce(F.col(adif) == us_adif, F.lit(False))
    base = F.coalesce(radio.base_call(call), F.lit(""))
    table = licensed.select(F.upper("call").alias("_base")).distinct().withColumn("_licensed", F.lit(True))
    joined = df.withColumns({"_us": us, "_base": F.when(us, base).otherwise(F.concat(F.lit("-"), base))}).join(table, "_base", "left")
    return joined.withColumn(out, F.col("_us") & F.col("_licensed").isNull()).drop("_us", "_base", "_licensed")


def backfill_grid(df: DataFrame, store: DataFrame, call: str, grid: str) -> DataFrame:
    """df with missing grids taken from store (call, grid); of several rows of a call the one updated last, where store says when (updated_at), else the largest grid."""
    grids = store.where("grid is not null").groupBy(F.col("call").alias("_call"))
    table = grids.agg(F.max(F.struct("updated_at", "grid"))["grid"].alias("_grid") if "updated_at" in store.columns else F.max("grid").alias("_grid"))
    filled = F.coalesce(F.when(F.trim(F.col(grid)) != "", F.col(grid)), F.col("_grid"))
    return df.join(table, df[call] == F.col("_call"), "left").withColumn(grid, filled).drop("_call", "_grid")


def allotted_mode(df: DataFrame, segments: DataFrame, out: str = "allotted") -> DataFrame:
    """df with the mode of the first segment (pos, lower_khz, upper_khz, cw_end_khz, voice) that holds freq_khz: CW up to cw_end_khz, else the segment's voice mode.
    Segments and frequencies meet by whole MHz, so the range test runs on few pairs."""
    cut = segments.withColumn("_mhz", F.explode(F.sequence(F.floor(F.col("lower_khz") / 1000).cast("long"), F.floor(F.col("upper_khz") / 1000).cast("long"))))
    freqs = df.select("freq_khz").distinct().withColumn("_mhz", F.floor(F.col("freq_khz") / 1000).cast("long"))
    met = freqs.join(cut, "_mhz").where(F.col("freq_khz").between(F.col("lower_khz"), F.col("upper_khz")))
    mode = F.when(F.col("freq_khz") <= F.col("cw_end_khz"), F.lit("CW")).otherwise(F.col("voice"))
    return df.join(met.groupBy("freq_khz").agg(F.min_by(mode, "pos").alias(out)), "freq_khz", "left")


def quality_of(df: DataFrame, scores: DataFrame, call: str, khz: str, bin_hz: int = 1000, out: str = "quality") -> DataFrame:
    """df with the score (call, bin, score) of the call in the frequency's bin, or of all frequencies (bin -1), or 0."""
    table = scores.groupBy(F.col("call").alias("_call"), F.col("bin").alias("_bin")).agg(F.sum("score").alias("_s"))
    keyed = df.withColumn("_bin", radio.freq_bin(khz, bin_hz))
    one = keyed.join(table, (keyed[call] == table["_call"]) & (keyed["_bin"] == table["_bin"]), "left").drop(table["_call"], table["_bin"]).withColumnRenamed("_s", "_own").drop("_bin")
    every = table.where("_bin = -1").select("_call", F.col("_s").alias("_all"))
    return one.join(every, one[call] == every["_call"], "left").withColumn(out, F.coalesce("_own", "_all", F.lit(0)).cast("long")).drop("_own", "_all", "_call")


def reliability_of(df: DataFrame, weights: DataFrame, call: str = "de_call", out: str = "reliability") -> DataFrame:
    """df with the reporter's weight (call, weight; of several rows of a call the largest weight), 1 for the unknown."""
    table = weights.groupBy(F.upper("call").alias("_call")).agg(F.max("weight").alias("weight"))
    return df.withColumn("_call", F.upper(call)).join(table, "_call", "left").withColumn(out, F.coalesce("weight", F.lit(1.0))).drop("_call", "weight")


def merge_calls(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both (call, is_known, grid, observations, first_seen, updated_at, expires_at) as one row a call: known if either is, grid and expiry of the new rows where they have one (the newest that is not null), whatever the stored row's time,
    observations added, first and last times. New rows of the same time count by their order of observations and grid."""
    rows = stored.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", "updated_at", "observations", c)))
    return rows.groupBy("call").agg(F.max("is_known").alias("is_known"), newest("grid").alias("grid"), F.sum("observations").alias("observations"), F.min("first_seen").alias("first_seen"), F.max("updated_at").alias("updated_at"), newest("expires_at").alias("expires_at"))


def purge_calls(stored: DataFrame, cutoff: int) -> DataFrame:
    return stored.where(F.col("updated_at") >= cutoff)


def seed_known(stored: DataFrame, known: DataFrame, now: int) -> DataFrame:
    """stored with is_known for the calls of known only; calls it lacks are added without observations."""
    none = lambda t: F.lit(None).cast(t)
    new = known.select(F.upper(F.trim("call")).alias("call")).distinct().select("call", F.lit(1).alias("is_known"), none("string").alias("grid"), F.lit(0).cast("long").alias("observations"), F.lit(now).cast("long").alias("first_seen"), F.lit(now).cast("long").alias("updated_at"), none("long").alias("expires_at"))
    return merge_calls(stored.withColumn("is_known", F.lit(0)), new)


def grid_changes(df: DataFrame, call: str, grid: str, order: tuple[str, str] = ("t", "event_id"), stored: DataFrame | None = None) -> DataFrame:
    """Rows whose grid (four characters or more) is not the last one known of the call, from the rows before or else from stored (call, grid)."""
    rows = df.where((F.trim(F.col(call)) != "") & (F.length(F.trim(F.col(grid))) >= 4))
    last = F.lag(grid).over(Window.partitionBy(call).orderBy(*order))
    if stored is None:
        return rows.withColumn("_last", last).where(~F.col("_last").eqNullSafe(F.col(grid))).drop("_last")
    known = stored.select(F.col("call").alias("_call"), F.col("grid").alias("_stored"))
    held = rows.withColumn("_last", last).join(known, F.col(call) == F.col("_call"), "left")
    return held.where(~F.coalesce("_last", "_stored").eqNullSafe(F.col(grid))).drop("_last", "_call", "_stored")


def with_prefix(table: DataFrame, start: str, prefix: str = "prefix") -> DataFrame:
    """Rows of a prefix table whose key begins so."""
    return table.where(F.col(prefix).startswith(start.strip().upper()))


METADATA = "struct<continent:string,country:string,cq_zone:int,itu_zone:int,adif:int,grid:string>"


def metadata(df: DataFrame, call: str, prefixes: DataFrame, out: str, rows: int | None = None) -> DataFrame:
    """df with struct out (continent, country, cq_zone, itu_zone, adif, grid) of the call's licence prefix, null fields without one; a grid that out had already stays. Again after a correction: the same refreshes it."""
    grid = F.col(f"{out}.grid") if out in df.columns else F.lit(None).cast("string")
    held = df.withColumn("_grid", grid).drop(out)
    # distinct calls meet the prefixes, and df is joined once
    calls = held.select(F.col(call).alias("_of")).where("_of is not null").distinct()
    found = effective_prefix(calls, "_of", prefixes, out="_entity_of", rows=rows)
    fields = [F.col(f"_entity_of.{c}").cast(t).alias(c) for c, t in (("continent", "string"), ("country", "string"), ("cq_zone", "int"), ("itu_zone", "int"), ("adif", "int"))]
    done = held.join(found, F.col(call) == F.col("_of"), "left")
    return done.withColumn(out, F.struct(*fields, F.col("_grid").alias("grid"))).drop("_entity_of", "_grid", "_of")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: how many rows each table has."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
