"""Harmonic suppression, frequency averaging, band maps, activity rates and adaptive thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import radio


def _before(t: str = "_t", row_id: str = "_id") -> F.Column:
    """The other spot came first: at an earlier time, or at the same with a smaller id."""
    return (F.col(t) < F.col("t")) | ((F.col(t) == F.col("t")) & (F.col(row_id) < F.col("event_id")))


def harmonics(spots: DataFrame, window: int = 120, max_multiple: int = 4, tolerance_khz: float = 0.025, min_delta: float = 6.0, step: float = 0.0, modes: tuple[str, ...] | None = None, levels: int = 1) -> DataFrame:
    """event_id, fundamental, multiple, delta, corroborators of spots that are a multiple of an earlier, stronger spot of the same call within window: of the first such spot (by time and id), and how many of
    them lie within the tolerance of its frequency. modes: what takes part (None: all).

    A spot looks for its k-th part in the 0.1 kHz buckets around freq/k and in its own and the last time bucket, so the self-join stays an equi-join. What is itself a harmonic is no fundamental: with levels of 2
    or more, spots found are taken out of the fundamentals and the rest judged anew; each level settles spots twice as high, so log2 of the widest ratio of frequencies are enough for the exact result."""
    rows = spots if modes is None else spots.where(F.upper(F.trim("mode")).isin(*modes))
    tick = F.floor(F.col("t") / window).cast("long")
    k = F.col("multiple")
    looks = rows.select("event_id", "dx_call", "t", "freq_khz", "report", tick.alias("_tick"), F.explode(F.sequence(F.lit(2), F.lit(max_multiple))).alias("multiple"))
    b = radio.bucket(F.col("freq_khz") / k)
    looks = looks.withColumn("_b", F.explode(F.sequence(b - 1, b + 1)))
    base = rows.select("dx_call", F.col("t").alias("_t"), F.col("event_id").alias("_id"), F.col("freq_khz").alias("fundamental"), F.col("report").alias("_r"), radio.bucket("freq_khz").alias("_b"), F.explode(F.array(tick, tick + 1)).alias("_tick"))
    need = F.lit(min_delta) + F.lit(step) * F.greatest(k - 2, F.lit(0))
    hit = _before() & (F.col("t") - F.col("_t") <= window) & (F.col("fundamental") < F.col("freq_khz")) & (F.abs(F.col("fundamental") * k - F.col("freq_khz")) <= tolerance_khz + 1e-9) & (F.col("_r") - F.col("report") >= need)
    met = looks.join(base, ["dx_call", "_b", "_tick"]).where(hit).select("event_id", "_t", "_id", "fundamental", "multiple", (F.col("_r") - F.col("report")).alias("delta"))
    left = met
    for _ in range(levels - 1):
        left = met.join(left.select(F.col("event_id").alias("_id")).distinct(), "_id", "left_anti")
    first = F.min(F.struct("_t", "_id", "fundamental", "multiple", "delta")).over(Window.partitionBy("event_id"))
    near = F.abs(F.col("fundamental") - F.col("x.fundamental")) <= tolerance_khz + 1e-9
    g = left.withColumn("x", first).groupBy("event_id", "x").agg(F.count_if(near).alias("corroborators"))
    return g.select("event_id", F.col("x.fundamental").alias("fundamental"), F.col("x.multiple").alias("multiple"), F.abs("x.delta").alias("delta"), "corroborators")


def average_frequency(spots: DataFrame, window: int = 600, tolerance_khz: float = 0.3, min_corroborators: int = 1, modes: tuple[str, ...] | None = None) -> DataFrame:
    """event_id, n, mean_khz, applied, new_khz: the mean frequency of the call's spots in the window up to each spot (those of the same second with a smaller id among them), within the tolerance of it; the spot's own counts in.
    Applied where enough others agree and the rounded mean moves it. Frequencies are summed in whole 0.1 kHz steps, so the order doesn't matter. modes: what is averaged (None: all)."""
    rows = spots if modes is None else spots.where(F.upper(F.trim("mode")).isin(*modes))
    tick = F.floor(F.col("t") / window).cast("long")
    reach = int(tolerance_khz * 10 + 0.5)
    b = radio.bucket("freq_khz")
    look = rows.select("event_id", "dx_call", "t", "freq_khz", tick.alias("_tick"), F.explode(F.sequence(b - reach, b + reach)).alias("_b"))
    base = rows.select(F.col("event_id").alias("_id"), "dx_call", F.col("t").alias("_t"), b.alias("_b"), F.explode(F.array(tick, tick + 1)).alias("_tick"))
    met = look.join(base, ["dx_call", "_b", "_tick"]).where((F.col("_t") >= F.col("t") - window) & (_before() | (F.col("_id") == F.col("event_id"))))
    g = met.groupBy("event_id", "freq_khz").agg(F.count("*").alias("n"), F.sum("_b").alias("_sum"))
    mean = F.col("_sum").cast("double") / F.col("n") / 10
    new = radio.half_up_tenth(mean)
    g = g.select("event_id", "freq_khz", "n", mean.alias("mean_khz"), new.alias("new_khz"))
    return g.withColumn("applied", (F.col("n") - 1 >= min_corroborators) & (F.abs(F.col("new_khz") - F.col("freq_khz")) >= 0.05)).drop("freq_khz")


def band_map(spots: DataFrame, khz: float, half_width: float, per_bin: int = 50) -> DataFrame:
    """The newest per_bin spots of each mode and 100 Hz bin within half_width of a frequency."""
    near = spots.where(F.col("freq_khz").between(khz - half_width, khz + half_width)).withColumn("bin", radio.bucket("freq_khz"))
    rank = F.row_number().over(Window.partitionBy("mode", "bin").orderBy(F.desc("t"), F.desc("event_id")))
    return near.withColumn("_rn", rank).where(F.col("_rn") <= per_bin).drop("_rn")


def active_reporters(spots: DataFrame, groups: DataFrame, period: int = 600, window: int | None = None) -> DataFrame:
    """slot, grp, mean_reporters: for each period from the first spot to the last and each group, the distinct reporters by band within the window that ends with the period (the period itself without), averaged over the
    group's bands (groups: grp, band). A band or group without any counts 0."""
    window = window or period
    slot = F.floor(F.col("t") / period).cast("long")
    ends = F.sequence(slot, F.floor((F.col("t") + window - 1) / period).cast("long"))
    heard = spots.select("t", "de_call", radio.band("freq_khz").alias("band"), F.explode(ends).alias("slot")).where((F.col("slot") + 1) * period - F.col("t") <= window)
    seen = heard.groupBy("slot", "band").agg(F.countDistinct("de_call").alias("n"))
    size = groups.groupBy("grp").agg(F.count("*").alias("bands"))
    counts = seen.join(groups, "band").groupBy("slot", "grp").agg(F.sum("n").alias("_n"))
    # a row for each period and group: both are few, and the periods come from one row of bounds
    slots = spots.agg(F.min(slot).alias("lo"), F.max(slot).alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("slot"))
    grid = slots.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return grid.join(counts, ["slot", "grp"], "left").select("slot", "grp", (F.coalesce("_n", F.lit(0)).cast("double") / F.col("bands")).alias("mean_reporters"))


def state_of(mean, quiet_below: int = 10, busy_above: int | None = None):
    """quiet, normal or busy."""
    m = F.col(mean) if isinstance(mean, str) else mean
    return F.when(m < quiet_below, "quiet").when(m > (busy_above if busy_above and busy_above > 0 else 2 * quiet_below), "busy").otherwise("normal")


def hysteresis(series: DataFrame, repeats: int = 2, key: str = "grp", at: str = "slot", raw: str = "raw_state") -> DataFrame:
    """key, at, raw, state: the state changes only after raw has been another one, the same, for repeats evaluations in a row; it starts as normal.

    A change needs repeats equal values in a row, so only those positions matter: the state is the last value that stood repeats times in a row."""
    w = Window.partitionBy(key).orderBy(at)
    stood = F.lit(True)
    for k in range(1, repeats):
        stood = stood & F.coalesce(F.lag(raw, k).over(w) == F.col(raw), F.lit(False))
    held = series.withColumn("_set", F.when(stood, F.col(raw)))
    return held.withColumn("state", F.coalesce(F.last("_set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("normal"))).drop("_set")


def highest_state(states: DataFrame, at: str = "slot") -> DataFrame:
    """The highest state of all groups at each time: busy over normal over quiet."""
    rank = F.when(F.col("state") == "busy", 2).when(F.col("state") == "normal", 1).otherwise(0)
    return states.groupBy(at).agg(F.element_at(F.array(F.lit("quiet"), F.lit("normal"), F.lit("busy")), F.max(rank) + 1).alias("state"))


def rates(events: DataFrame, ts: str = "ts", minutes: int = 15, busy_above: float = 50.0) -> DataFrame:
    """minute (epoch minutes), n, rate (per minute over the last minutes), busy: for each minute with events."""
    minute = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / 60).cast("long")
    counts = events.groupBy(minute.alias("minute")).agg(F.count("*").alias("n"))
    # spread each count to the minutes that see it: a sum by key, not one window over all rows
    spread = counts.select(F.explode(F.sequence(F.col("minute"), F.col("minute") + minutes - 1)).alias("minute"), F.col("n").alias("_n"))
    sums = spread.groupBy("minute").agg(F.sum("_n").alias("_sum"))
    rate = F.col("_sum").cast("double") / minutes
    return counts.join(sums, "minute").select("minute", "n", rate.alias("rate"), (rate > busy_above).alias("busy"))


def counter_deltas(counters: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """counters with delta: growth since the last reading; after a reset the reading itself."""
    last = F.lag(value).over(Window.partitionBy(key).orderBy(at))
    return counters.withColumn("delta", F.when(last.isNotNull() & (F.col(value) >= last), F.col(value) - last).otherwise(F.col(value)))


def activity(series: DataFrame, quiet_after: int = 3, at: str = "minute", busy: str = "busy", slice_: int = 1440) -> DataFrame:
    """series (at, busy) with state: busy from a busy evaluation on, until quiet_after evaluations in a row were not busy; quiet before the first. The last evaluation that was busy is near enough or it isn't.

    A prefix scan in two passes: each slice of a day's worth of at is numbered by itself, a row for each slice says how many evaluations and which last busy one lie before it, and a slice needs no more than that."""
    held = series.withColumn("_slice", F.floor(F.col(at) / slice_).cast("long"))
    w = Window.partitionBy("_slice").orderBy(at)
    held = held.withColumn("_n", F.row_number().over(w))
    summary = held.groupBy("_slice").agg(F.count("*").alias("_count"), F.max(F.when(F.col(busy), F.col("_n"))).alias("_busy"))
    # a row for each slice that has evaluations
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    summary = summary.select("_slice", "_before", F.max(F.col("_before") + F.col("_busy")).over(before).alias("_busy_before"))
    held = held.join(summary, "_slice").withColumn("_n", F.col("_n") + F.col("_before"))
    last = F.max(F.when(F.col(busy), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_last", F.coalesce(last, "_busy_before")).drop("_slice", "_before", "_busy_before")
    return held.withColumn("state", F.when(F.coalesce(F.col("_n") - F.col("_last") < quiet_after, F.lit(False)), "busy").otherwise("quiet")).drop("_n", "_last")


def event_counts(spots: DataFrame) -> DataFrame:
    """corrected, freq_corrected, harmonics, unlicensed: one row of sums over the flags of a composed run (plans.pipeline)."""
    return spots.agg(*[F.count_if(c).alias(c) for c in ("corrected", "freq_corrected", "harmonic", "unlicensed")])
