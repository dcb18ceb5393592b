"""The spot pipeline as one plan: stale drop, skew, first dedup, reporters' weights, correction with feedback, harmonics, averages, metadata, grids, licences, second dedup and the output line."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import radio
from ..operators import correction, dedup, feedback, lookups, signals
from .store import stored

#: Modes whose frequencies are averaged.
AVERAGED = ("CW", "RTTY")


@dataclass(frozen=True)
class Plan:
    """What a run does; tables that are None leave their step out. prefixes: prefix, country, continent, cq_zone, itu_zone, adif. known, licensed: call. skew: call, factor. scores: call, bin, score. states, groups and levels: as
    correction.adaptive_min_reports() takes them; overrides: as band_state_params() does. weights: call, weight of reporters. grids: call, grid of the call store. votes_back, quality_back: as feedback.settle() takes them; with
    neither, correction is one pass on the calls as reported."""

    settings: correction.Settings = field(default_factory=correction.Settings)
    prefixes: DataFrame | None = None
    known: DataFrame | None = None
    licensed: DataFrame | None = None
    skew: DataFrame | None = None
    scores: DataFrame | None = None
    states: DataFrame | None = None
    groups: DataFrame | None = None
    levels: dict | None = None
    overrides: list | None = None
    weights: DataFrame | None = None
    grids: DataFrame | None = None
    votes_back: bool = True
    quality_back: bool = False
    max_age: int | None = None
    first_window: int = 120
    second_window: int = 60
    prefer_stronger: bool = True
    harmonic_window: int = 120
    harmonic_levels: int = 3
    average_window: int = 45
    us_adif: int = 291
    suppress: bool = False
    keyed_distance: bool = True


def fresh(spots: DataFrame, now: int, max_age: int) -> DataFrame:
    """Beacons, and what is at most max_age seconds old."""
    return spots.where(F.coalesce("is_beacon", F.lit(False)) | (F.lit(now) - F.col("t") <= max_age))


def judged(spots: DataFrame, p: Plan, now: int | None = None) -> DataFrame:
    """spots (event_id, t, de_call, dx_call, freq_khz, mode, report, and is_beacon or comment) after correction and averaging, with confidence, dx and de metadata and the flags corrected, freq_corrected, harmonic and unlicensed.
    Rows that a dedup or the stale drop takes out are gone; harmonics and unlicensed spots are flagged."""
    if "is_beacon" not in spots.columns:
        spots = spots.withColumn("is_beacon", radio.is_beacon("dx_call", F.col("comment") if "comment" in spots.columns else F.lit("")))
    rows = fresh(spots, now, p.max_age) if p.max_age and now is not None else spots
    if p.skew is not None:
        raw = ~F.upper("mode").isin("CW", "RTTY")
        rows = lookups.apply_skew(rows.where(~raw), p.skew).unionByName(rows.where(raw))
    keyed = rows.withColumns({"_minute": F.floor(F.col("t") / 60), "_khz": F.floor("freq_khz"), "_de12": F.substring("de_call", 1, 12), "_dx12": F.substring("dx_call", 1, 12)})
    keyed = dedup.primary(keyed, ["_minute", "_khz", "_de12", "_dx12"], p.prefer_stronger) if p.first_window >= 60 else dedup.secondary(keyed, ["_minute", "_khz", "_de12", "_dx12"], p.first_window, p.prefer_stronger)
    # used by each of the joins below
    rows = stored(keyed.drop("_minute", "_khz", "_de12", "_dx12"), "spots")
    plain = rows.where(~F.coalesce("is_beacon", F.lit(False)))

    s = p.settings
    if p.weights is not None:
        plain = lookups.reliability_of(plain, p.weights)
    if p.overrides and p.states is not None:
        plain = correction.band_state_params(plain, p.states, p.groups, p.overrides, s)
    least = correction.adaptive_min_reports(plain, p.states, p.groups, p.levels) if p.states is not None and p.levels else None
    valid = None
    if p.prefixes is not None:  # a winner is a call that someone reported
        calls = plain.select(F.col("dx_call").alias("call")).distinct()
        valid = stored(lookups.longest_prefix(calls, "call", p.prefixes).where("entity is not null").select("call"), "valid")
    settled = feedback.settle(plain, s, p.votes_back, p.quality_back, p.scores, valid, least, p.keyed_distance, keep_tallies=False)
    decisions = stored(settled.decisions, "decisions")
    glyphs = correction.glyphs(decisions, F.lit(p.known is not None))
    if p.known is not None:  # a single report counts by whether its call is known
        flagged = lookups.flag_known(glyphs, p.known, "subject", "is_known")
        glyphs = flagged.withColumn("glyph", F.when((F.col("glyph") == "S") & ~F.col("is_known"), "?").otherwise(F.col("glyph")))
    before = rows.withColumn("_was", F.col("dx_call"))
    done = correction.apply_to(before, decisions, glyphs, valid, p.suppress)
    done = done.withColumns({"confidence": F.when(F.col("is_beacon"), "V").otherwise(F.col("confidence")), "corrected": F.col("dx_call") != F.col("_was")}).drop("_was")
    done = stored(done, "corrected")

    plain = done.where(~F.coalesce("is_beacon", F.lit(False)))
    # read as often as there are levels
    harmonic = signals.harmonics(plain, p.harmonic_window, modes=correction.ELIGIBLE, levels=p.harmonic_levels).select("event_id").withColumn("harmonic", F.lit(True))
    done = done.join(harmonic, "event_id", "left").withColumn("harmonic", F.coalesce("harmonic", F.lit(False)))
    heard = done.where("not harmonic and not coalesce(is_beacon, false)")
    mean = signals.average_frequency(heard, p.average_window, modes=AVERAGED).where("applied").select("event_id", "new_khz")
    done = done.join(mean, "event_id", "left").withColumns({"freq_khz": F.coalesce("new_khz", "freq_khz"), "freq_corrected": F.col("new_khz").isNotNull()}).drop("new_khz")
    if p.prefixes is not None:
        done = lookups.metadata(lookups.metadata(done, "dx_call", p.prefixes, "dx"), "de_call", p.prefixes, "de")
        if p.grids is not None:
            for side, call in (("dx", "dx_call"), ("de", "de_call")):
                filled = lookups.backfill_grid(done.withColumn("_own_grid", F.col(f"{side}.grid")), p.grids, call, "_own_grid")
                done = filled.withColumn(side, F.col(side).withField("grid", F.col("_own_grid"))).drop("_own_grid")
    if p.licensed is not None and p.prefixes is not None:
        done = lookups.flag_unlicensed(done.withColumn("_adif", F.col("de.adif")), p.licensed, "_adif", "de_call", p.us_adif)
        done = done.withColumn("unlicensed", F.col("unlicensed") & ~F.coalesce("is_beacon", F.lit(False))).drop("_adif")
    else:
        done = done.withColumn("unlicensed", F.lit(False))
    return stored(done, "judged")


def call_updates(judged_spots: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What a run tells the call store (sinks.upsert_calls(), lookups.merge_calls()): a row for each DX call, with the last grid of four characters or more that its spots carry."""
    rows = judged_spots.where(F.trim("dx_call") != "")
    grid = F.when(F.length(F.trim("dx.grid")) >= 4, F.col("dx.grid")) if "dx" in rows.columns else F.lit(None).cast("string")
    rows = rows.select("dx_call", "t", "event_id", grid.alias("_grid"))
    last = F.max_by("_grid", F.when(F.col("_grid").isNotNull(), F.struct("t", "event_id")))
    out = rows.groupBy(F.col("dx_call").alias("call")).agg(last.alias("grid"), F.count("*").alias("observations"), F.min("t").alias("first_seen"), F.max("t").alias("updated_at"))
    out = lookups.flag_known(out, known, "call", "_flag").withColumn("is_known", F.col("_flag").cast("int")) if known is not None else out.withColumn("is_known", F.lit(0))
    return out.select("call", "is_known", "grid", "observations", "first_seen", "updated_at", F.lit(None).cast("long").alias("expires_at"))


def delivered(judged_spots: DataFrame, p: Plan) -> DataFrame:
    """What goes out: without harmonics and unlicensed spots, after the second dedup by kHz, reporter's country and zone, and call; reporters without either always pass."""
    out = judged_spots.where("not harmonic and not unlicensed")
    if p.prefixes is None or p.second_window <= 0:
        return out
    keyed = out.withColumns({"_khz": F.floor("freq_khz"), "_adif": F.coalesce("de.adif", F.lit(0)), "_zone": F.coalesce("de.cq_zone", F.lit(0)), "_dx12": F.substring("dx_call", 1, 12)})
    return dedup.secondary(keyed, ["_khz", "_adif", "_zone", "_dx12"], p.second_window, p.prefer_stronger, pass_through="_adif <= 0 or _zone <= 0").drop("_khz", "_adif", "_zone", "_dx12")


def broadcast_view(spots: DataFrame) -> DataFrame:
    """The projection that goes to subscribers: reporters' numbered suffixes collapsed, and only the columns that filters and lines read."""
    wanted = ("event_id", "t", "de_call", "dx_call", "freq_khz", "mode", "report", "comment", "confidence", "is_beacon", "is_human", "source_type", "dx", "de")
    return spots.withColumn("de_call", radio.collapse_ssid("de_call")).select(*[c for c in wanted if c in spots.columns])


def run(spots: DataFrame, p: Plan, now: int | None = None) -> DataFrame:
    """The delivered spots with their line of 78 characters."""
    out = broadcast_view(delivered(judged(spots, p, now), p))
    hhmm = F.format_string("%02d%02d", F.floor(F.col("t") / 60 / 60) % 24, F.floor(F.col("t") / 60) % 60)
    grid = F.col("dx.grid") if p.prefixes is not None else F.lit("")
    comment = F.col("comment") if "comment" in out.columns else F.lit("")
    return out.withColumn("line", radio.fixed_line("de_call", "freq_khz", "dx_call", "mode", "report", comment, grid, "confidence", hhmm))
