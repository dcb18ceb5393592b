"""Analytics over the decision log (event_id, t, freq_khz, subject, winner, winner_support, subject_support, total, conf, distance, decision, reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import radio

_applied = "decision = 'applied'"


def _count(cond) -> F.Column:
    return F.count_if(cond)


def summary(d: DataFrame) -> DataFrame:
    """min_t, max_t, decisions, applied, applied_pairs, oscillation (distinct pairs by applied): one row."""
    pair = F.when(F.col("decision") == "applied", F.struct("subject", "winner"))
    x = d.agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.count("*").alias("decisions"), _count(F.col("decision") == "applied").alias("applied"), F.countDistinct(pair).alias("applied_pairs"))
    return x.withColumn("oscillation", F.when(F.col("applied") > 0, F.col("applied_pairs").cast("double") / F.col("applied")).otherwise(0.0))


def by_decision(d: DataFrame) -> DataFrame:
    return d.groupBy("decision").agg(F.count("*").alias("n"))


def reject_reasons(d: DataFrame, distance: int | None = None) -> DataFrame:
    r = d.where("decision = 'rejected'")
    if distance is not None:
        r = r.where(F.col("distance") == distance)
    return r.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def most_first(counts: DataFrame, by: str = "reason", n: str = "n") -> DataFrame:
    """A report's lines of counts: the largest first, equal ones by name."""
    return counts.orderBy(F.desc(n), by)


def headroom(d: DataFrame) -> DataFrame:
    """Confidence rejects in all, of distance to 2 at 55 to 59, of distance 3 at 60 to 64: one row."""
    r, dist, conf = F.col("reason") == "confidence", F.col("distance"), F.col("conf")
    return d.agg(_count(r).alias("confidence_rejects"), _count(r & (dist <= 2) & conf.between(55, 59)).alias("near_d2"), _count(r & (dist == 3) & conf.between(60, 64)).alias("near_d3"))


def recall_by_band(reference: DataFrame, d: DataFrame) -> DataFrame:
    """reference: subject, correct, freq_khz. band, total, matched (pair applied), present_miss (subject seen, pair not), absent."""
    pairs = d.where(_applied).select("subject", F.col("winner").alias("correct")).distinct().withColumn("_pair", F.lit(True))
    seen = d.select("subject").distinct().withColumn("_seen", F.lit(True))
    x = reference.join(pairs, ["subject", "correct"], "left").join(seen, "subject", "left")
    hit, here = F.col("_pair").isNotNull(), F.col("_seen").isNotNull()
    return x.groupBy(radio.report_band("freq_khz").alias("band")).agg(F.count("*").alias("total"), _count(hit).alias("matched"), _count(~hit & here).alias("present_miss"), _count(~hit & ~here).alias("absent"))


def pair_recall(reference: DataFrame, d: DataFrame) -> DataFrame:
    """Distinct reference pairs, how many were applied, and percent: one row."""
    pairs = d.where(_applied).select("subject", F.col("winner").alias("correct")).distinct().withColumn("_pair", F.lit(True))
    x = reference.select("subject", "correct").distinct().join(pairs, ["subject", "correct"], "left").agg(F.count("*").alias("pairs"), _count(F.col("_pair").isNotNull()).alias("matched"))
    return x.withColumn("recall", radio.percent("matched", "pairs"))


def follow_on(d: DataFrame, spots: DataFrame, horizon: int, tolerance_khz: float = 0.5, least: int = 2) -> DataFrame:
    """Applied decisions with n (spots of the winner in [t, t + horizon] within the tolerance) and stable (n at least least). Joined by call and time bucket."""
    tick = F.floor(F.col("t") / horizon).cast("long")
    a = d.where(_applied).select("event_id", "t", "freq_khz", "winner", F.explode(F.array(tick, tick + 1)).alias("_tick"))
    s = spots.select(F.col("dx_call").alias("winner"), F.col("t").alias("_t"), F.col("freq_khz").alias("_f"), tick.alias("_tick"))
    n = a.join(s, ["winner", "_tick"]).where(F.col("_t").between(F.col("t"), F.col("t") + horizon) & (F.abs(F.col("_f") - F.col("freq_khz")) <= tolerance_khz + 1e-9)).groupBy("event_id").agg(F.count("*").alias("n"))
    out = d.where(_applied).join(n, "event_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("stable", F.col("n") >= least)


def stability_by_bucket(flags: DataFrame, seconds: int) -> DataFrame:
    """bucket_start (from the first decision on), total, stable, percent. flags are counted by second first, in one pass; the first second is then the least of those, at most one row a second."""
    per_second = flags.groupBy("t").agg(F.count("*").alias("total"), _count(F.col("stable")).alias("stable"))
    first = F.min("t").over(Window.partitionBy(F.lit(1)))
    start = first + F.floor((F.col("t") - first) / seconds).cast("long") * seconds
    x = per_second.select(start.alias("bucket_start"), "total", "stable").groupBy("bucket_start").agg(F.sum("total").alias("total"), F.sum("stable").alias("stable"))
    return x.withColumn("percent", radio.percent("stable", "total"))


def stability_by_band(flags: DataFrame) -> DataFrame:
    x = flags.groupBy(radio.report_band("freq_khz").alias("band")).agg(F.count("*").alias("total"), _count(F.col("stable")).alias("stable"))
    return x.withColumn("percent", radio.percent("stable", "total"))


def stability_by_horizon(d: DataFrame, spots: DataFrame, horizons: list[int], tolerance_khz: float = 0.5, least: int = 2) -> DataFrame:
    """horizon, total, stable, percent for several horizons at once: one join over the longest, counted for each."""
    longest = max(horizons)
    tick = F.floor(F.col("t") / longest).cast("long")
    a = d.where(_applied).select("event_id", "t", "freq_khz", "winner")
    spread = a.withColumn("_tick", F.explode(F.array(tick, tick + 1)))
    s = spots.select(F.col("dx_call").alias("winner"), F.col("t").alias("_t"), F.col("freq_khz").alias("_f"), tick.alias("_tick"))
    met = spread.join(s, ["winner", "_tick"]).where(F.col("_t").between(F.col("t"), F.col("t") + longest) & (F.abs(F.col("_f") - F.col("freq_khz")) <= tolerance_khz + 1e-9))
    counts = met.groupBy("event_id").agg(*[_count(F.col("_t") <= F.col("t") + h).alias(f"n{h}") for h in horizons])
    flags = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.coalesce(F.col(f"n{h}"), F.lit(0)) >= least).alias("stable")) for h in horizons]))
    x = a.select("event_id").join(counts, "event_id", "left").select(flags.alias("x")).groupBy("x.horizon").agg(F.count("*").alias("total"), _count(F.col("x.stable")).alias("stable"))
    return x.withColumn("percent", radio.percent("stable", "total"))


def reappearance(d: DataFrame, horizon: int) -> DataFrame:
    """Applied decisions with winner_again and subject_again: a later decision within the horizon whose winner or subject is the winner, and among those one whose subject is the subject."""
    tick = F.floor(F.col("t") / horizon).cast("long")
    a = d.where(_applied).select("event_id", "t", "subject", "winner", "distance", F.explode(F.array(tick, tick + 1)).alias("_tick"))
    calls = F.explode(F.array_distinct(F.array("subject", "winner")))
    later = d.select(calls.alias("_call"), F.col("t").alias("_t"), F.col("subject").alias("_s"), F.col("winner").alias("_w"), tick.alias("_tick"))
    met = a.join(later, (a.winner == later._call) & (a._tick == later._tick)).where((F.col("_t") > F.col("t")) & (F.col("_t") <= F.col("t") + horizon))
    flags = met.groupBy("event_id").agg(F.max(F.lit(True)).alias("winner_again"), F.max((F.col("_s") == F.col("subject")) | (F.col("_w") == F.col("subject"))).alias("subject_again"))
    out = d.where(_applied).select("event_id", "t", "subject", "winner", "distance").join(flags, "event_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("winner_again", "subject_again")})


def stability_by_distance(flags: DataFrame) -> DataFrame:
    """distance, total, stable (the winner came again and the subject did not), percent."""
    ok = F.col("winner_again") & ~F.col("subject_again")
    x = flags.groupBy("distance").agg(F.count("*").alias("total"), _count(ok).alias("stable"))
    return x.withColumn("percent", radio.percent("stable", "total"))


def verdict(percent: str) -> F.Column:
    p = F.col(percent)
    return F.when(p >= 80, "excellent").when(p >= 60, "good").when(p >= 40, "fair").otherwise("poor")


def by_distance(d: DataFrame) -> DataFrame:
    """distance, total, applied, rejected, mean and median confidence of the applied, apply rate."""
    ok = F.col("decision") == "applied"
    conf = F.when(ok, F.col("conf"))
    x = d.groupBy("distance").agg(F.count("*").alias("total"), _count(ok).alias("applied"), _count(~ok).alias("rejected"), (F.sum(conf).cast("double") / F.count(conf)).alias("mean_conf"), F.median(conf).alias("median_conf"))
    return x.withColumn("apply_rate", radio.percent("applied", "total"))


def reason_share(d: DataFrame) -> DataFrame:
    """distance, reason, n, share (percent of the distance's rejects)."""
    x = d.where("decision = 'rejected'").groupBy("distance", "reason").agg(F.count("*").alias("n"))
    return x.withColumn("share", radio.percent("n", F.sum("n").over(Window.partitionBy("distance"))))


def distance_gap(d: DataFrame) -> DataFrame:
    """Apply rates and mean confidence of distance 1 against 3, their differences: one row."""
    ok = F.col("decision") == "applied"
    rate = lambda k: radio.percent(_count(ok & (F.col("distance") == k)), _count(F.col("distance") == k))
    conf = lambda k: F.sum(F.when(ok & (F.col("distance") == k), F.col("conf"))).cast("double") / _count(ok & (F.col("distance") == k))
    x = d.agg(rate(1).alias("rate_d1"), rate(3).alias("rate_d3"), conf(1).alias("conf_d1"), conf(3).alias("conf_d3"))
    x = x.withColumns({"rate_gap": F.col("rate_d1") - F.col("rate_d3"), "conf_gap": F.col("conf_d1") - F.col("conf_d3")})
    return x


def rate_class(percent: str) -> F.Column:
    """What an overall apply rate says of the thresholds: below 30 percent low, above 60 high."""
    p = F.col(percent)
    return F.when(p < 30, "low").when(p > 60, "high").otherwise("balanced")


def gap_class(gap: str) -> F.Column:
    """How much lower the apply rate of distance 3 is than that of distance 1."""
    return F.when(F.col(gap) > 30, "conservative").otherwise("balanced")


def simulate(d: DataFrame, grid: list[tuple[int, int]], max_distance: int = 3, extra_advantage_d3: int = 1, extra_confidence_d3: int = 5) -> DataFrame:
    """min_reports, min_conf, passed, rescued (rejected now, would pass), rescued_d1, rescued_d2, rescued_d3 for each pair of thresholds, over decisions with a winner; distance 3 wants more advantage and confidence. The grid is exploded
    within each row: one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("min_reports"), F.lit(b).alias("min_conf")) for a, b in grid]))
    x = d.where((F.col("winner") != F.col("subject")) & (F.col("distance") <= max_distance)).select("decision", "winner_support", "subject_support", "conf", "distance", cells.alias("g"))
    more = lambda n: F.when(F.col("distance") == 3, n).otherwise(0)
    ok = (F.col("winner_support") >= F.col("g.min_reports")) & (F.col("winner_support") - F.col("subject_support") >= 1 + more(extra_advantage_d3)) & (F.col("conf") >= F.col("g.min_conf") + more(extra_confidence_d3))
    saved = ok & (F.col("decision") == "rejected")
    return x.groupBy("g.min_reports", "g.min_conf").agg(_count(ok).alias("passed"), _count(saved).alias("rescued"), *[_count(saved & (F.col("distance") == k)).alias(f"rescued_d{k}") for k in (1, 2, 3)])


#: Scenario, extra reports, extra advantage, extra confidence for decisions of distance 3.
SCENARIOS = (("current", 0, 1, 5), ("relaxed advantage", 0, 0, 5), ("relaxed confidence", 0, 1, 3), ("relaxed both", 0, 0, 3), ("strict", 1, 1, 5), ("very strict", 1, 2, 7))


def distance3_scenarios(d: DataFrame, min_reports: int = 3, min_advantage: int = 1, min_conf: int = 60) -> DataFrame:
    """scenario, passed, rescued, lost over the decisions of distance 3, and least and mean advantage of what passes."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("r"), F.lit(b).alias("a"), F.lit(c).alias("c")) for n, a, b, c in SCENARIOS]))
    adv = F.col("winner_support") - F.col("subject_support")
    x = d.where("distance = 3").select("decision", "winner_support", "conf", adv.alias("adv"), cells.alias("g"))
    ok = (F.col("winner_support") >= F.col("g.r") + min_reports) & (F.col("adv") >= F.col("g.a") + min_advantage) & (F.col("conf") >= F.col("g.c") + min_conf)
    now = F.col("decision") == "applied"
    return x.groupBy("g.scenario").agg(_count(ok).alias("passed"), _count(ok & ~now).alias("rescued"), _count(~ok & now).alias("lost"), F.min(F.when(ok, F.col("adv"))).alias("least_adv"), (F.sum(F.when(ok, F.col("adv"))).cast("double") / _count(ok)).alias("mean_adv"))


def distance3_list(d: DataFrame) -> DataFrame:
    """The decisions of distance 3 with winner_share and subject_share (percent of the reporters) and advantage, by decision downwards, then confidence downwards."""
    x = d.where("distance = 3").withColumns({"winner_share": radio.percent("winner_support", "total"), "subject_share": radio.percent("subject_support", "total"), "advantage": F.col("winner_support") - F.col("subject_support")})
    return x.orderBy(F.desc("decision"), F.desc("conf"), "event_id")


def separation_classes(gaps: DataFrame, khz: float = 0.5) -> DataFrame:
    """pairs, near (both calls came again within khz of each other, as one signal does), apart, near_percent: one row over both_reappear()."""
    near = F.col("gap_khz") < khz
    x = gaps.agg(F.count("*").alias("pairs"), _count(near).alias("near"), _count(~near).alias("apart"))
    return x.withColumn("near_percent", radio.percent("near", "pairs"))


def both_reappear(d: DataFrame, horizon: int, first: int = 100) -> DataFrame:
    """Applied decisions after which, among the first 100 later decisions on either call, both calls came again as subjects: event_id, subject_khz and winner_khz of their first, gap_khz."""
    tick = F.floor(F.col("t") / horizon).cast("long")
    a = d.where(_applied).select("event_id", "t", "subject", "winner", F.explode(F.array(tick, tick + 1)).alias("_tick")).withColumn("_call", F.explode(F.array_distinct(F.array("subject", "winner"))))
    later = d.select(F.col("subject").alias("_call"), F.col("t").alias("_t"), F.col("event_id").alias("_id"), F.col("freq_khz").alias("_f"), tick.alias("_tick"))
    met = a.join(later, ["_call", "_tick"]).where((F.col("_t") > F.col("t")) & (F.col("_t") <= F.col("t") + horizon))
    rn = F.row_number().over(Window.partitionBy("event_id").orderBy("_t", "_id"))
    top = met.withColumn("_rn", rn).where(F.col("_rn") <= first)
    side = lambda c: F.min_by("_f", F.when(F.col("_call") == F.col(c), F.col("_rn")))
    x = top.groupBy("event_id").agg(side("subject").alias("subject_khz"), side("winner").alias("winner_khz"))
    return x.where("subject_khz is not null and winner_khz is not null").withColumn("gap_khz", F.abs(F.col("subject_khz") - F.col("winner_khz")))


def match_reference(d: DataFrame, reference: DataFrame, minutes: int = 5, khz: float = 1.0) -> DataFrame:
    """Applied decisions with ref_row and class: the first reference row (row, t, freq_khz, bad, correct) of the same subject within the minutes of the day and kHz; CORRECT_FIX if it has the winner, WRONG_FIX
    if not, POSSIBLE_FALSE_POSITIVE without a row. Calls count without dashes and slashes; the join is by call and minute bucket."""
    plain = lambda c: F.regexp_replace(F.col(c), "[-/]", "")
    minute = F.floor((F.col("t") % 86400) / 60).cast("long")
    a = d.where(_applied).select("event_id", "freq_khz", plain("subject").alias("_s"), plain("winner").alias("_w"), minute.alias("_m"))
    spread = a.withColumn("_slot", F.explode(F.sequence(F.floor((F.col("_m") - minutes) / (minutes + 1)), F.floor((F.col("_m") + minutes) / (minutes + 1)))))
    r = reference.select("row", plain("bad").alias("_s"), plain("correct").alias("_c"), F.col("freq_khz").alias("_f"), minute.alias("_rm")).withColumn("_slot", F.floor(F.col("_rm") / (minutes + 1)))
    met = spread.join(r, ["_s", "_slot"]).where((F.abs(F.col("_m") - F.col("_rm")) <= minutes) & (F.abs(F.col("freq_khz") - F.col("_f")) <= khz + 1e-9))
    best = met.groupBy("event_id", "_w").agg(F.min(F.struct("row", "_c")).alias("x")).select("event_id", F.col("x.row").alias("ref_row"), F.when(F.col("x._c") == F.col("_w"), "CORRECT_FIX").otherwise("WRONG_FIX").alias("class"))
    return d.where(_applied).select("event_id").join(best, "event_id", "left").withColumn("class", F.coalesce("class", F.lit("POSSIBLE_FALSE_POSITIVE")))


def missed_reference(reference: DataFrame, matched: DataFrame) -> DataFrame:
    """Reference rows that no decision matched."""
    return reference.join(matched.where("ref_row is not null").select(F.col("ref_row").alias("row")).distinct(), "row", "left_anti")


def accuracy(matched: DataFrame) -> DataFrame:
    """class, n."""
    return matched.groupBy("class").agg(F.count("*").alias("n"))


def precision(matched: DataFrame, missed: DataFrame) -> DataFrame:
    """applied, correct, wrong, possible_false, missed, accuracy (correct of the applied), precision (correct of those with a reference row), recall (correct of those and the missed), in percent: one row."""
    of = lambda c: _count(F.col("class") == c)
    x = matched.agg(F.count("*").alias("applied"), of("CORRECT_FIX").alias("correct"), of("WRONG_FIX").alias("wrong"), of("POSSIBLE_FALSE_POSITIVE").alias("possible_false"))
    x = x.crossJoin(missed.agg(F.count("*").alias("missed")))  # one row by one row
    return x.withColumns({"accuracy": radio.percent("correct", "applied"), "precision": radio.percent("correct", F.col("correct") + F.col("wrong")), "recall": radio.percent("correct", F.col("correct") + F.col("missed"))})


def top_rejections(d: DataFrame, n: int = 10) -> DataFrame:
    return d.where("decision = 'rejected' and winner <> subject").orderBy(F.desc("winner_support"), F.desc("conf"), "event_id").limit(n).select("event_id", "subject", "winner", "winner_support", "conf", "reason")


def frequent_pairs(d: DataFrame, more_than: int = 10, n: int = 20) -> DataFrame:
    x = d.where(_applied).groupBy("subject", "winner").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return x.orderBy(F.desc("n"), "subject", "winner").limit(n)
