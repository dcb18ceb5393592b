"""Keyed state with event-time timers: spots and their voters by frequency zone, adaptive states of band groups, and the anchor dedup with expiry; and late rows set apart.

All results are those of the batch operators, whatever the order of rows within the lateness that the watermark allows: a row takes effect when the watermark has passed it, in order of time. State is what the
window still needs; timers drop the rest. transformWithState wants the RocksDB state store, which start() sets for its query.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import radio
from ..operators import correction
from ..operators.correction import Settings

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append", once: bool = True):
    """Starts a query with keyed state, to a function of its micro-batches or as Parquet under path. once: what is there now, and stop."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        w = w.foreachBatch(write) if write else w.format("parquet").option("path", path)
        q = (w.trigger(availableNow=True) if once else w).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    if once:
        q.awaitTermination()
    return q


# ---- votes

_SPOT = "event_id long, t long, freq_khz double, b long, de_call string, dx_call string, mode string, tolerance double, reliable boolean, loud boolean, own boolean"
_READY = "bucket long, span long, event_id long, t long, freq_khz double, b long, rep string, dx_call string, mode string, tolerance double, reliable boolean, loud boolean, ready boolean"
#: Windows that a key of keyed_spots() spans.
SPAN = 8


class _Zone(StatefulProcessor):
    """The spots of a zone in one span (some windows), and those of its neighbours' edges and of the window before that can vote on them, however much a micro-batch brings. When the watermark has passed some of its own spots, it gives them, and those that
    can vote on them; all goes when the watermark has passed the span. What a micro-batch brings is one value of the state, its columns, and the time up to which its own spots were given."""

    def __init__(self, s: Settings, windows: int = 1) -> None:
        self.s, self.span = s, windows * s.window

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "block binary, given long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = None
        for pdf in rows:
            columns = [pdf[c.split()[0]].to_numpy() for c in _SPOT.split(", ")]
            self.held.appendList([(pickle.dumps(columns, protocol=5), _NEVER)])
            own = columns[1][columns[-1].astype(bool)]
            first = min(x for x in (first, int(own.min())) if x is not None) if len(own) else first
        end = (key[1] + 1) * self.span
        self.handle.registerTimer(max((end if first is None else first) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np
        import pandas as pd

        window, passed, end = self.s.window, timerValues.getCurrentWatermarkInMs() // 1000, (key[1] + 1) * self.span
        blocks = [(pickle.loads(block), given) for block, given in self.held.get()]
        own = [(x[1], x[-1].astype(bool)) for x, _ in blocks]
        ready = [mine & (t <= passed) & (t > given) for (t, mine), (_, given) in zip(own, blocks, strict=True)]
        waiting = min((int(t[mine & (t > passed)].min()) for t, mine in own if (mine & (t > passed)).any()), default=end)
        since = min((int(t[r].min()) for (t, _), r in zip(own, ready, strict=True) if r.any()), default=None)
        left = []
        for x, _ in blocks if passed < end else []:
            stay = x[1] >= passed - window
            if stay.any():
                left.append((pickle.dumps(x if stay.all() else [c[stay] for c in x], protocol=5), passed))
        self.held.put(left) if left else self.held.clear()
        if left:
            self.handle.registerTimer(waiting * 1000)
        if since is not None:
            near = [(t >= since - window) & (t <= passed) for t, _ in own]
            out = [np.concatenate([c[n] for c, n in zip(cs, near, strict=True)]) for cs in zip(*(x[:-1] for x, _ in blocks), strict=True)]
            out.append(np.concatenate([r[n] for r, n in zip(ready, near, strict=True)]))
            names = [c.split()[0] for c in _READY.split(", ")]
            yield pd.DataFrame(dict(zip(names, [np.full(len(out[0]), key[0]), np.full(len(out[0]), key[1]), *out], strict=True)))

    def close(self) -> None:
        pass


#: Before any time.
_NEVER = -(1 << 62)


def keyed_spots(stream: DataFrame, s: Settings, lateness: str = "10 minutes") -> DataFrame:
    """Of a stream of spots (t in seconds; no nulls in t, freq_khz and calls): each spot once the watermark has passed it (ready), and with it, in its own zone and span, those that can vote on it; votes_of() joins them. A spot stands in its own zone and span,
    and as a voter in those it can reach."""
    rows = correction.eligible(stream, s)
    rows = rows if "reliability" in rows.columns else rows.withColumn("reliability", F.lit(1.0))
    rows = rows if "tolerance_hz" in rows.columns else rows.withColumn("tolerance_hz", F.lit(s.tolerance_hz))
    rows = rows.withColumn("_ts", F.timestamp_seconds("t")).withWatermark("_ts", lateness)
    floor = F.lit(None).cast("long")
    for mode, least in s.min_snr:
        floor = F.when(F.col("mode") == mode, F.lit(least).cast("long")).otherwise(floor)
    b, step = radio.bucket("freq_khz"), max(1, s.bucket_reach)
    wide = lambda x: F.floor(x / step).cast("long")
    loud = F.coalesce(F.col("report") >= floor, F.lit(True)) & (F.trim("de_call") != "")
    keyed = rows.select("_ts", F.explode(F.sequence(wide(b - s.bucket_reach), wide(b + s.bucket_reach))).alias("zone"), "event_id", F.col("t").cast("long").alias("t"), "freq_khz", b.alias("b"), "de_call", "dx_call", "mode", F.col("tolerance_hz").alias("tolerance"), (F.col("reliability") >= s.min_reliability).alias("reliable"), loud.alias("loud"))
    span = lambda t: F.floor(t / (SPAN * s.window)).cast("long")
    at = span(F.col("t"))
    keyed = keyed.withColumn("span", F.explode(F.array_distinct(F.array(at, span(F.col("t") + s.window))))).withColumn("own", (F.col("zone") == wide(F.col("b"))) & (F.col("span") == at))
    return keyed.groupBy("zone", "span").transformWithStateInPandas(statefulProcessor=_Zone(s, SPAN), outputStructType=_READY, outputMode="Append", timeMode="EventTime")


def votes_of(batch: DataFrame, s: Settings) -> DataFrame:
    """correction.votes() of the spots that are ready in a micro-batch of keyed_spots(), which is read several times. Zone and window are the buckets of the join; a voter meets a span's subjects by its copy in that span."""
    tick = F.floor(F.col("t") / s.window).cast("long")
    subject = batch.where("ready").select("bucket", F.col("b").alias("_b"), tick.alias("tick"), "event_id", F.col("dx_call").alias("subject"), "freq_khz", "t", "mode", F.col("rep").alias("_de"), F.col("tolerance").alias("_tolerance"))
    ticks = F.filter(F.array(tick, tick + 1), lambda k: F.floor(k / SPAN) == F.col("span"))
    voter = batch.select(
        F.col("event_id").alias("_id"), F.col("t").alias("seen"), F.col("freq_khz").alias("vote_khz"), F.col("mode").alias("_mode"), "rep", F.col("dx_call").alias("_own"), F.col("dx_call").alias("_voted"), F.col("b").alias("_vote_b"),
        "reliable", F.col("loud").alias("_loud"), "bucket", F.explode(ticks).alias("tick"),
    )
    # one scan, the first: the state's results are made once, wherever they are kept
    counts = batch.select("bucket", "ready", tick.alias("_own"), F.explode(ticks).alias("tick")).select("bucket", "tick", (F.col("ready") & (F.col("tick") == F.col("_own"))).cast("long").alias("n"), F.lit(1).cast("long").alias("m"))
    n = correction.parts_of(counts)
    return correction.met(subject, voter, s, n)


def consensus(stream: DataFrame, s: Settings, out: str, checkpoint: str, lateness: str = "10 minutes", once: bool = True):
    """Decisions on a stream, as Parquet under out by micro-batch (part): spots and their voters from keyed state, and the batch operators on what each micro-batch completes. A repeated micro-batch replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        correction.decide(correction.tallies(votes_of(held, s)), s).write.mode("overwrite").parquet(f"{out}/part={number}")
        held.unpersist()

    return start(keyed_spots(stream, s, lateness), checkpoint, write, once=once)


# ---- adaptive states

_STATES = "slot long, grp string, mean_reporters double, raw_state string, state string"


class _Group(StatefulProcessor):
    """A band group: what its bands have counted for slots to come, and its state with the change that is pending. A timer at the end of each slot evaluates it, whether anything came or not."""

    def __init__(self, bands: dict[str, list[str]], period: int, quiet_below: int, busy_above: int, repeats: int) -> None:
        self.bands, self.period, self.quiet_below, self.busy_above, self.repeats = bands, period, quiet_below, busy_above, repeats

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "slot long, n long")
        self.state = handle.getValueState("state", "next long, state string, pending string, streak long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = None
        for pdf in rows:
            mine = pdf[pdf["band"].isin(self.bands[key[0]])]
            if len(mine):
                self.counts.appendList([(int(a), int(n)) for a, n in zip(mine["slot"], mine["n"], strict=True)])
            first = int(pdf["slot"].min()) if first is None else min(first, int(pdf["slot"].min()))
        if first is not None and not self.state.exists():
            self.state.update((first, "normal", "", 0))
        at, *rest = self.state.get()
        if first is not None and first < at:  # counts of an earlier slot, before the first evaluation
            at = first
            self.state.update((at, *rest))
        self.handle.registerTimer(max(((at + 1) * self.period) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        at, state, pending, streak = self.state.get()
        last = timerValues.getCurrentWatermarkInMs() // 1000 // self.period - 1  # the last whole slot
        counts = list(self.counts.get())
        by_slot: dict[int, int] = {}
        for slot, n in counts:
            by_slot[slot] = by_slot.get(slot, 0) + n
        out = []
        for slot in range(at, last + 1):
            mean = by_slot.get(slot, 0) / len(self.bands[key[0]])
            raw = "quiet" if mean < self.quiet_below else "busy" if mean > self.busy_above else "normal"
            if raw == state:
                pending, streak = "", 0
            else:
                pending, streak = raw, streak + 1 if raw == pending else 1
                if streak >= self.repeats:
                    state, pending, streak = raw, "", 0
            out.append((slot, key[0], mean, raw, state))
        at = max(at, last + 1)
        left = [c for c in counts if c[0] >= at]
        self.counts.put(left) if left else self.counts.clear()
        self.state.update((at, state, pending, streak))
        self.handle.registerTimer((at + 1) * self.period * 1000)
        if out:
            yield pd.DataFrame(out, columns=["slot", "grp", "mean_reporters", "raw_state", "state"])

    def close(self) -> None:
        pass


def adaptive_states(stream: DataFrame, groups: dict[str, list[str]], period: int = 600, window: int | None = None, quiet_below: int = 10, busy_above: int | None = None, repeats: int = 2, lateness: str = "10 minutes") -> DataFrame:
    """slot, grp, mean_reporters, raw_state, state on a stream of spots (t, freq_khz, de_call): signals.active_reporters(), state_of() and hysteresis() of each whole slot that the watermark has passed, silent ones among them.

    Distinct reporters are counted by Spark's own windowed aggregates, spread over bands and reporters; a group's state sees a row for each band and slot."""
    window = window or period
    x = stream.select(F.timestamp_seconds("t").alias("_ts"), "de_call", radio.band("freq_khz").alias("band")).withWatermark("_ts", lateness)
    # windows end where slots do
    once = x.groupBy(F.window("_ts", f"{window} seconds", f"{period} seconds", f"{-window % period} seconds"), "band", "de_call").agg(F.count("*").alias("_n"))
    seen = once.groupBy("window", "band").agg(F.count("*").alias("n"))
    slot = (F.unix_timestamp(F.col("window.end")) / period).cast("long") - 1
    rows = seen.select(F.window_time("window").alias("_ts"), slot.alias("slot"), "band", "n", F.explode(F.array(*[F.lit(g) for g in groups])).alias("grp"))
    processor = _Group(groups, period, quiet_below, busy_above if busy_above and busy_above > 0 else 2 * quiet_below, repeats)
    return rows.groupBy("grp").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_STATES, outputMode="Append", timeMode="EventTime")


# ---- anchors with expiry


class _Anchor(StatefulProcessor):
    """A key's anchor, and its rows that the watermark has not passed. The anchor goes when its window has."""

    def __init__(self, window: int, prefer_stronger: bool, keys: list[str]) -> None:
        self.window, self.prefer_stronger, self.keys = window, prefer_stronger, keys

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, event_id long, r long")
        self.anchor = handle.getValueState("anchor", "t long, r long, reported boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = None
        for pdf in rows:
            r = pdf["r"].astype(object).where(pdf["r"].notna(), None)
            new = [(int(t), int(i), None if v is None else int(v)) for t, i, v in zip(pdf["t"], pdf["event_id"], r, strict=True)]
            self.waiting.appendList(new)
            first = min(t for t, *_ in new) if first is None else min(first, min(t for t, *_ in new))
        self.handle.registerTimer(max(first * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() // 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[:2])
        at, value, reported = self.anchor.get() if self.anchor.exists() else (None, 0, False)
        kept = []
        for t, i, r in rows:
            if t > passed:
                break
            v, has = r or 0, r is not None
            if at is None or t - at >= self.window or (has and not reported) or (self.prefer_stronger and v > value):
                at, value, reported = t, v, has
                kept.append((i, t))
        left = [r for r in rows if r[0] > passed]
        self.waiting.put(left) if left else self.waiting.clear()
        if at is None or passed - at >= self.window:
            self.anchor.clear()
        else:
            self.anchor.update((at, value, reported))
            self.handle.registerTimer((at + self.window) * 1000)
        if left:
            self.handle.registerTimer(left[0][0] * 1000)
        if kept:
            yield pd.DataFrame({**{k: [v] * len(kept) for k, v in zip(self.keys, key, strict=True)}, "event_id": [i for i, _ in kept], "t": [t for _, t in kept], "ts": pd.to_datetime([t for _, t in kept], unit="s")})

    def close(self) -> None:
        pass


def expiring_dedup(stream: DataFrame, keys: list[str], window: int, lateness: str = "10 minutes", prefer_stronger: bool = True) -> DataFrame:
    """keys..., event_id, t, ts of what dedup.secondary() forwards, on a stream (t, event_id, report), in order of event time; a key that is silent for its window holds no state. ts is the event time for stateful operators that follow."""
    kinds = dict(stream.dtypes)
    x = stream.withColumn("_ts", F.timestamp_seconds("t")).withWatermark("_ts", lateness).select("_ts", *keys, "t", "event_id", F.col("report").cast("long").alias("r"))
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", event_id long, t long, ts timestamp"
    return x.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Anchor(window, prefer_stronger, keys), outputStructType=out, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")


# ---- late rows


def split_late(stream: DataFrame, lateness: int, on_time: str, late: str, marks: str, checkpoint: str, t: str = "t", once: bool = True):
    """Deals a stream's rows to two tables, by micro-batch (part): those at least as late as lateness seconds before the latest row of earlier micro-batches, which a watermark would drop, and the others. A row a micro-batch is kept under marks;
    a repeated micro-batch replaces its own parts."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        newest = _newest(spark, marks, number)
        after = F.lit(True) if newest is None else F.col(t) > newest - lateness
        held.where(after).write.mode("overwrite").parquet(f"{on_time}/part={number}")
        held.where(~after).write.mode("overwrite").parquet(f"{late}/part={number}")
        held.agg(F.max(t).alias("t")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/part={number}")
        held.unpersist()

    return start(stream, checkpoint, write, once=once)


def _newest(spark: SparkSession, marks: str, before: int) -> int | None:
    """The latest time of the micro-batches before this one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(marks)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema("t long, part int").option("basePath", marks).parquet(marks).where(F.col("part") < before).agg(F.max("t")).first()[0]
