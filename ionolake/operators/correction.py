"""Consensus correction of calls: what independent reporters of one frequency say decides.

Batch form, one pass on the reported calls (operators.feedback settles corrections that vote in their turn): each spot's votes come from one join. Both sides are bucketed by frequency and by time, so the join is an equi-join whatever its window,
and a busy frequency is spread over its time buckets. A spot stands in one bucket pair only, so all its votes meet in one partition of the join: tallies and decisions keep the
bucket columns in their keys and need no further shuffle. What a task holds is what the join gives, not what is shuffled, so partitions are dealt by the pairs that meet, counted first (parts()). Only modes that are corrected take part. Nothing is gathered by key."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import radio

#: Modes that are corrected.
ELIGIBLE = ("CW", "RTTY", "SSB")
#: What names a spot in votes and tallies: the join's buckets, and the spot's own columns.
SPOT = ("bucket", "tick", "event_id", "subject", "freq_khz", "t", "mode")

#: Pairs of subject and voter that a partition of the votes' join is dealt; a tenth to a half of them are votes, which take some hundred bytes each in each of the aggregates.
PAIRS = 1 << 20
#: Up to so many of them Spark deals the partitions itself.
FEW = 8


@dataclass(frozen=True)
class Settings:
    """Thresholds of a correction; the defaults hold where a service sets none. modes: what is corrected (None: every mode)."""

    window: int = 45
    min_reports: int = 4
    min_advantage: int = 1
    min_confidence: int = 70
    max_distance: int = 2
    tolerance_hz: float = 500.0
    bucket_reach: int = 5
    min_snr: tuple[tuple[str, int], ...] = ()
    extra_reports_d3: int = 0
    extra_advantage_d3: int = 0
    extra_confidence_d3: int = 0
    guard_separation_khz: float = 0.1
    guard_ratio: float = 0.5
    min_reliability: float = 0.0
    same_mode: bool = True
    strategy: str = "majority"
    modes: tuple[str, ...] | None = ELIGIBLE
    quality_bin_hz: int = 1000
    good_quality: int = 2


def eligible(spots: DataFrame, s: Settings) -> DataFrame:
    """The spots whose mode is corrected."""
    return spots if s.modes is None else spots.where(F.upper(F.trim("mode")).isin(*s.modes))


def _sides(spots: DataFrame, s: Settings, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The spots as subjects and as voters, with the buckets in which they meet. tasks: where voters are copied to their buckets (None: where they are read; a task that reads a large file then holds all their copies). A spot without a frequency or a time has a bucket of its own: it meets itself alone, and counts for nothing."""
    rows = eligible(spots, s)
    for name, value in (("reliability", F.lit(1.0)), ("tolerance_hz", F.lit(s.tolerance_hz)), ("voted", F.col("dx_call"))):
        rows = rows if name in rows.columns else rows.withColumn(name, value)
    floor = F.lit(None).cast("long")
    for mode, least in s.min_snr:
        floor = F.when(F.col("mode") == mode, F.lit(least).cast("long")).otherwise(floor)
    placed = F.col("freq_khz").isNotNull() & F.col("t").isNotNull()
    loud = F.coalesce(F.col("report") >= floor, F.lit(True)) & (F.trim("de_call") != "") & placed
    b = radio.bucket("freq_khz")
    alone = -1 - F.pmod(F.xxhash64("event_id"), F.lit(1 << 40))
    tick = F.coalesce(F.floor(F.col("t") / s.window).cast("long"), F.lit(0).cast("long"))
    # buckets of reach steps: a voter meets subjects of two or three of them
    step = max(1, s.bucket_reach)
    wide = lambda x: F.floor(x / step).cast("long")
    reach = F.when(placed, F.sequence(wide(b - s.bucket_reach), wide(b + s.bucket_reach))).otherwise(F.array(alone))
    ticks = F.when(placed, F.array(tick, tick + 1)).otherwise(F.array(tick))
    subject = rows.select(F.when(placed, wide(b)).otherwise(alone).alias("bucket"), b.alias("_b"), tick.alias("tick"), "event_id", F.col("dx_call").alias("subject"), "freq_khz", "t", "mode", F.col("de_call").alias("_de"), F.col("tolerance_hz").alias("_tolerance"))
    voter = (rows.repartition(tasks, "event_id") if tasks else rows).select(
        F.col("event_id").alias("_id"), F.col("t").alias("seen"), F.col("freq_khz").alias("vote_khz"), F.col("mode").alias("_mode"), F.col("de_call").alias("rep"), F.col("dx_call").alias("_own"), F.col("voted").alias("_voted"), b.alias("_vote_b"),
        (F.col("reliability") >= s.min_reliability).alias("reliable"), loud.alias("_loud"), F.explode(reach).alias("bucket"), ticks.alias("_ticks"),
    ).withColumn("tick", F.explode("_ticks")).drop("_ticks")
    return subject, voter


def _near(s: Settings) -> Column:
    """The voter is an earlier spot near the subject, of its mode or its reporter."""
    earlier = F.col("seen").between(F.col("t") - s.window, F.col("t")) & ((F.col("seen") < F.col("t")) | (F.col("_id") < F.col("event_id")))
    near = (F.abs(F.col("_b") - F.col("_vote_b")) <= s.bucket_reach) & (F.abs(F.col("freq_khz") - F.col("vote_khz")) * 1000 <= F.col("_tolerance") + 1e-6)
    mode_ok = (F.upper("mode") == F.upper("_mode")) if s.same_mode else F.lit(True)
    return earlier & near & ((F.col("rep") == F.col("_de")) | mode_ok)


def parts(spots: DataFrame, s: Settings) -> int:
    """Partitions for votes() of these spots: one for each PAIRS pairs of a subject and a voter that meet in a bucket pair. One pass that counts spots by bucket and tick; the cells meet their neighbours, not the spots."""
    step, tick = max(1, s.bucket_reach), F.floor(F.col("t") / s.window).cast("long")
    side = -(-s.bucket_reach // step)  # buckets to either side that a voter reaches
    cells = eligible(spots, s).groupBy(F.floor(radio.bucket("freq_khz") / step).cast("long").alias("bucket"), tick.alias("tick")).agg(F.count("*").alias("n"))
    own = lambda dw, dt: F.col("n") if (dw, dt) == (0, 0) else F.lit(0).cast("long")
    reach = F.array(*[F.struct((F.col("bucket") + dw).alias("bucket"), (F.col("tick") + dt).alias("tick"), own(dw, dt).alias("n"), F.col("n").alias("m")) for dw in range(-side, side + 1) for dt in (0, 1)])
    return parts_of(cells.select(F.explode(reach).alias("x")).select("x.*"))  # each cell's spots as subjects at home, and as voters where they reach


def parts_of(counts: DataFrame) -> int:
    """Partitions by how many subjects (n) and voters (m) stand in each bucket and tick; rows of one add up."""
    pairs = counts.groupBy("bucket", "tick").agg((F.sum("n").cast("double") * F.sum("m")).alias("x")).agg(F.sum("x")).first()[0]
    return max(1, math.ceil((pairs or 0) / PAIRS))


def votes(spots: DataFrame, s: Settings, of: DataFrame | None = None, n_parts: int | None = None, narrow: bool = True) -> DataFrame:
    """SPOT columns, cand, rep, seen, vote_khz, reliable, heard: the votes on each spot, its own among them (heard is false where it is too weak to count, or has no reporter, frequency or time; a spot has this row in any case).

    spots: event_id, t, freq_khz, de_call, dx_call, report, mode (and reliability, 1 if absent, tolerance_hz, the settings' if absent, and voted, the call that a spot votes for when it isn't judged itself: its dx_call if absent). of: event_id of the
    spots wanted (None: all). n_parts: partitions of the join (None: parts()). narrow: voters too are cut to those that the spots wanted can meet; False where spots holds hardly any others. A spot's voters are the spots within the window before it; those of the same second count if their event_id is smaller, as they came first."""
    n_parts = n_parts or parts(spots, s)
    subject, voter = _sides(spots, s, n_parts if n_parts > FEW else None)
    if of is not None:
        subject = subject.join(of.select("event_id"), "event_id", "left_semi")
        voter = voter.join(subject.select("bucket", "tick").distinct(), ["bucket", "tick"], "left_semi") if narrow else voter
    return met(subject, voter, s, n_parts)


def met(subject: DataFrame, voter: DataFrame, s: Settings, n_parts: int) -> DataFrame:
    """The votes of both sides (as _sides() gives them), in n_parts partitions."""
    mine = F.col("_id") == F.col("event_id")
    cand = F.when(mine, F.col("_own")).otherwise(F.col("_voted"))
    heard = F.col("_loud") & (F.trim(cand) != "")
    others = heard & _near(s) & F.when(F.col("rep") == F.col("_de"), cand == F.col("subject")).otherwise(F.lit(True))
    if n_parts > FEW:
        subject, voter = (x.repartition(n_parts, "bucket", "tick") for x in (subject, voter))
    # a spot's own row meets it in its own bucket and tick, once
    # merged, not broadcast, whatever the sizes look like: the copies of voters are not in Spark's estimate, and what follows relies on the partitioning
    return subject.join(voter.hint("merge"), ["bucket", "tick"]).where(mine | others).select(*SPOT, cand.alias("cand"), "rep", "seen", "vote_khz", "reliable", heard.alias("heard"))


def reached(spots: DataFrame, voters: DataFrame, s: Settings) -> DataFrame:
    """event_id of the spots that these voters (event_id) can reach, whatever they vote for."""
    subject, voter = _sides(spots, s)
    voter = voter.join(voters.select(F.col("event_id").alias("_id")), "_id", "left_semi")
    return subject.join(voter, ["bucket", "tick"]).where(_near(s)).select("event_id").distinct()


def tallies(vote_rows: DataFrame) -> DataFrame:
    """SPOT columns, cand, n (reliable reporters), last_seen, last_khz (of the latest vote, of those the highest frequency, to the Hz), rn (1: most reporters, then latest, then call), total (reporters of the spot), subject_support,
    next_n and next_khz (of the call next in rank).

    A vote's time and frequency are one number, so that the aggregates stay in hash tables: its age before the spot, which the window bounds, and the frequency in Hz."""
    hz = 1 << 32  # above any frequency in Hz
    place = (F.col("seen") - F.col("t")) * F.lit(hz) + radio.to_hz("vote_khz")
    once = vote_rows.groupBy(*SPOT, "cand", "rep").agg(F.max(place).alias("x"), F.max(F.col("reliable") & F.col("heard")).alias("ok"), F.max("heard").alias("heard"))
    # a reporter may have named several calls and counts once in the total: with the first of them
    first = F.row_number().over(Window.partitionBy("bucket", "tick", "event_id", "rep").orderBy(F.desc("heard"), "cand")) == 1
    by_call = once.withColumn("first", first & F.col("heard")).groupBy(*SPOT, "cand").agg(F.count_if("ok").alias("n"), F.max("x").alias("x"), F.count_if("first").alias("first"))
    w = Window.partitionBy("bucket", "tick", "event_id")
    x = by_call.select(*SPOT, "cand", "n", (F.col("t") + F.floor(F.col("x") / F.lit(hz))).alias("last_seen"), (F.pmod("x", F.lit(hz)) / 1000).alias("last_khz"), "first")
    order = w.orderBy(F.desc("n"), F.desc("last_seen"), "cand")
    x = x.withColumns({"rn": F.row_number().over(order), "next_n": F.lead("n").over(order), "next_khz": F.lead("last_khz").over(order)})
    return x.withColumns({"total": F.sum("first").over(w), "subject_support": F.max(F.when(F.col("cand") == F.col("subject"), F.col("n")).otherwise(0)).over(w)}).drop("first")


def decide(tally: DataFrame, s: Settings, distance: Column | None = None, by_mode: bool = False, min_reports: DataFrame | None = None, anchored: DataFrame | None = None) -> DataFrame:
    """A row a spot: event_id, t, mode, subject, winner, winner_support, subject_support, runner_up_support, total, conf, distance, decision, reason, path.

    distance: over subject and winner; Levenshtein without, and by_mode: as the mode confuses characters (radio's keyed distances). min_reports: event_id, min_reports where they differ from the settings'.
    anchored: event_id, anchor of anchors(): such a spot is corrected to its anchor without thresholds (path `anchor`, else `consensus`)."""
    w = tally.where("rn = 1").select("event_id", "t", "mode", "subject", "freq_khz", "subject_support", "total", F.col("cand").alias("winner"), F.col("n").alias("winner_support"), F.coalesce("next_n", F.lit(0).cast("long")).alias("runner_up_support"), F.col("next_khz").alias("_runner_khz"), F.col("last_khz").alias("_winner_khz"))
    w = w.withColumn("path", F.lit("consensus"))
    if anchored is not None:
        # the most reporters among the other calls: the next in rank if the anchor leads, else the leader's
        support = tally.select("event_id", F.col("cand").alias("anchor"), F.col("n").alias("_n"), F.when(F.col("rn") == 1, F.coalesce("next_n", F.lit(0))).alias("_other")).join(anchored, ["event_id", "anchor"])
        leader = tally.where("rn = 1").select("event_id", F.col("n").alias("_most"))
        held = support.join(leader, "event_id").select("event_id", "anchor", "_n", F.coalesce("_other", "_most").alias("_other"))
        w = w.join(held, "event_id", "left").withColumn("_set", F.col("anchor").isNotNull())
        take = lambda new, old: F.when(F.col("_set"), F.col(new)).otherwise(F.col(old))
        w = w.withColumns({"winner": take("anchor", "winner"), "winner_support": take("_n", "winner_support"), "runner_up_support": take("_other", "runner_up_support"), "path": F.when(F.col("_set"), "anchor").otherwise("consensus")}).drop("anchor", "_n", "_other", "_set")
    w = w.withColumn("conf", F.when(F.col("total") > 0, F.floor(F.col("winner_support") * 100 / F.col("total"))).otherwise(0).cast("long"))
    if by_mode:
        from ..functions.distance import with_distance

        w = with_distance(w, "subject", "winner", "mode")
    else:
        w = w.withColumn("distance", distance if distance is not None else radio.edit_distance("subject", "winner"))
    if min_reports is None:
        w = w.withColumn("_least", F.lit(s.min_reports))
    else:
        w = w.join(min_reports.select("event_id", F.col("min_reports").alias("_least")), "event_id", "left").withColumn("_least", F.coalesce("_least", F.lit(s.min_reports)))
    far = F.col("distance") >= 3
    more = lambda base, extra: base + F.when(far, extra).otherwise(0)
    guarded = (F.col("runner_up_support") > 0) & (F.abs(F.col("_runner_khz") - F.col("_winner_khz")) >= s.guard_separation_khz - 1e-9) & (F.col("runner_up_support") >= s.guard_ratio * F.col("winner_support"))
    reason = (
        F.when(F.col("path") == "anchor", "")
        .when(F.col("total") == 0, "no_reporters")
        .when((F.col("winner") == F.col("subject")) | (F.col("winner_support") == 0), "no_winner")
        .when(F.col("distance") > s.max_distance, "max_edit_distance")
        .when(F.col("winner_support") < more(F.col("_least"), s.extra_reports_d3), "min_reports")
        .when(F.col("winner_support") < F.col("subject_support") + more(F.lit(s.min_advantage), s.extra_advantage_d3), "advantage")
        .when(F.col("conf") < more(F.lit(s.min_confidence), s.extra_confidence_d3), "confidence")
        .when(guarded, "freq_guard")
        .otherwise("")
    )
    return w.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason") == "", "applied").otherwise("rejected")).drop("_runner_khz", "_winner_khz", "_least")


def anchors(tally: DataFrame, scores: DataFrame | None, s: Settings, good: int | None = None, bin_hz: int | None = None, by_mode: bool = False) -> DataFrame:
    """event_id, anchor: the nearest call of the votes (by the mode's distance if by_mode), other than the subject and within the largest distance, whose quality (scores: call, bin, score; None: tally has a column quality) is good; ties to the
    smaller call."""
    from .lookups import quality_of

    known = tally if scores is None else quality_of(tally, scores, "cand", "freq_khz", bin_hz or s.quality_bin_hz)
    scored = known.where((F.col("quality") >= (s.good_quality if good is None else good)) & (F.col("cand") != F.col("subject")))
    if by_mode:
        from ..functions.distance import with_distance

        near = with_distance(scored, "subject", "cand", "mode", "_d")
    else:
        near = scored.withColumn("_d", radio.edit_distance("subject", "cand"))
    return near.where(F.col("_d") <= s.max_distance).groupBy("event_id").agg(F.min(F.struct("_d", "cand"))["cand"].alias("anchor"))


def adaptive_min_reports(spots: DataFrame, states: DataFrame, groups: DataFrame, levels: dict[str, dict[str, int]], period: int = 600) -> DataFrame:
    """event_id, min_reports of CW and RTTY spots whose band is in a group: by the group's state at the end of the last whole period (states: slot, grp, state; normal before the first).

    groups: grp, band. levels: group to the reports wanted when quiet, normal and busy. A level of 0 or less is none."""
    rows = [(g, state, n) for g, of in levels.items() for state, n in of.items() if n > 0]
    wanted = F.broadcast(spots.sparkSession.createDataFrame(rows, "grp string, state string, min_reports int"))  # three rows a group of the settings
    band = spots.where(F.upper(F.trim("mode")).isin("CW", "RTTY")).select("event_id", radio.band("freq_khz").alias("band"), (F.floor(F.col("t") / period).cast("long") - 1).alias("slot"))
    named = band.join(groups, "band")
    return named.join(states.select("slot", "grp", "state"), ["slot", "grp"], "left").withColumn("state", F.coalesce("state", F.lit("normal"))).join(wanted, ["grp", "state"]).select("event_id", "min_reports")


def band_state_params(spots: DataFrame, states: DataFrame, groups: DataFrame, overrides: list[tuple[str, str, float, int]], s: Settings, period: int = 600) -> DataFrame:
    """spots with tolerance_hz and quality_bin_hz: those of the band and its state (overrides: band, state, tolerance_hz, quality_bin_hz; not positive: none), or the settings'. Bands without a group are normal."""
    table = F.broadcast(spots.sparkSession.createDataFrame(overrides, "_band string, _state string, _tolerance double, _bin int"))  # of the settings
    slot = F.floor(F.col("t") / period).cast("long") - 1
    keyed = spots.withColumns({"_band": radio.band("freq_khz"), "_slot": slot})
    of_band = groups.join(states, "grp").select(F.col("band").alias("_band"), F.col("slot").alias("_slot"), F.col("state").alias("_state"))
    held = keyed.join(of_band, ["_band", "_slot"], "left").withColumn("_state", F.coalesce("_state", F.lit("normal"))).join(table, ["_band", "_state"], "left")
    positive = lambda c, default: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(default))
    return held.withColumns({"tolerance_hz": positive("_tolerance", s.tolerance_hz), "quality_bin_hz": positive("_bin", s.quality_bin_hz)}).drop("_band", "_slot", "_state", "_tolerance", "_bin")


def quality_updates(vote_rows: DataFrame, decisions: DataFrame, gain: int = 1, loss: int = 1, bin_hz: int = 1000) -> DataFrame:
    """call, bin, score: of applied decisions, the winner gains and every other call of the votes loses."""
    calls = vote_rows.where("heard").select("event_id", "cand", "freq_khz").distinct().join(decisions.where("decision = 'applied'").select("event_id", "winner"), "event_id")
    delta = F.when(F.col("cand") == F.col("winner"), F.lit(gain)).otherwise(F.lit(-loss))
    return calls.groupBy(F.col("cand").alias("call"), radio.freq_bin("freq_khz", bin_hz).alias("bin")).agg(F.sum(delta).cast("long").alias("score"))


def traces(vote_rows: DataFrame, decisions: DataFrame, s: Settings) -> DataFrame:
    """decisions with subject_conf, the thresholds that held, and votes: (call, reporters) of each call of the cluster, most reporters first: a decision as a log keeps it."""
    per_call = vote_rows.where("heard").groupBy("event_id", "cand").agg(F.countDistinct("rep").alias("reporters"))
    # a spot's distinct calls, at most one for each of its reporters
    listed = per_call.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("reporters")).alias("rank"), F.col("cand").alias("call"), "reporters"))).alias("_x"))
    votes_ = F.transform("_x", lambda x: F.struct(x["call"].alias("call"), x["reporters"].alias("reporters")))
    far = F.col("distance") >= 3
    out = decisions.join(listed, "event_id", "left").withColumn("votes", F.coalesce(votes_, F.array().cast("array<struct<call:string,reporters:bigint>>"))).drop("_x")
    return out.withColumns({
        "subject_conf": F.when(F.col("total") > 0, F.floor(F.col("subject_support") * 100 / F.col("total"))).otherwise(0).cast("long"),
        "min_reports": F.lit(s.min_reports) + F.when(far, s.extra_reports_d3).otherwise(0), "min_advantage": F.lit(s.min_advantage) + F.when(far, s.extra_advantage_d3).otherwise(0),
        "min_confidence": F.lit(s.min_confidence) + F.when(far, s.extra_confidence_d3).otherwise(0), "max_distance": F.lit(s.max_distance), "strategy": F.lit(s.strategy),
    })


def glyphs(tally: DataFrame, known: Column) -> DataFrame:
    """event_id, subject, glyph by the subject's own share of reporters; from tallies() or, a row a spot as they are, decide()."""
    own = tally.where("rn = 1") if "rn" in tally.columns else tally
    share = F.floor(F.col("subject_support") * 100 / F.greatest(F.col("total"), F.lit(1)))
    return own.select("event_id", "subject", radio.confidence_glyph(share, F.col("total"), known).alias("glyph"))


def apply_to(spots: DataFrame, decisions: DataFrame, glyph_rows: DataFrame, valid: DataFrame | None = None, suppress: bool = False) -> DataFrame:
    """spots with dx_call and confidence after correction: C where the winner replaced the call; a winner that is not in valid (column call) drops the spot (suppress) or leaves it with B."""
    won = decisions.where("decision = 'applied'").select("event_id", "winner")
    won = won.withColumn("_ok", F.lit(True)) if valid is None else won.join(valid.select(F.col("call").alias("winner")).distinct().withColumn("_ok", F.lit(True)), "winner", "left")
    out = spots.join(won, "event_id", "left").join(glyph_rows.select("event_id", "glyph"), "event_id", "left")
    hit, ok = F.col("winner").isNotNull(), F.coalesce("_ok", F.lit(False))
    corrected = F.upper(F.trim("mode")).isin(*ELIGIBLE)
    if suppress:
        out = out.where(~hit | ok | ~corrected)
    confidence = F.when(~corrected, "").when(hit & ok, "C").when(hit, "B").otherwise(F.coalesce("glyph", F.lit("?")))
    return out.withColumns({"dx_call": F.when(hit & ok & corrected, F.col("winner")).otherwise(F.col("dx_call")), "confidence": confidence}).drop("winner", "_ok", "glyph")


def with_settings(s: Settings, **changes) -> Settings:
    return replace(s, **changes)
