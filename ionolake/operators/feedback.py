"""Correction whose results count in later corrections: a corrected spot votes for its new call, and an applied decision raises the quality of its winner and lowers that of the calls that lost.

In order of time (and event_id within a second) a spot's decision depends on earlier spots only, so there is exactly one result that agrees with itself: the one a service reaches by taking spots one by one.

Votes are settled by rounds. The first decides all spots on the calls as reported; each further one takes the votes anew only of the spots that a change of the last round can reach, those with a voter that now votes otherwise. A round
settles at least the earliest spot that was not settled, in fact all whose voters were; it ends when nothing changes. Changes are few, so rounds shrink fast.

Quality is a fold in order: an anchor depends on all decisions before it in its kHz, and makes the next. Each bin's time is cut into slices of about SLICE spots, which are folded side by side, each from the scores that the slices before it are
thought to leave. A slice's anchors hold for any start that leaves each of its comparisons of a score with the threshold as it was, so a slice also tells how far each call's start may move. Where the sums of what the slices before gave and took
move it further, the slice is folded again. Each round settles at least the first such slice; when there is none, all starts are those of the fold in one go. With both kinds of feedback each round of votes folds again.

Plan: a round reads the spots of the cells (wide bucket and tick) around what changed, picked by a small table of cells, and joins the votes of those. It writes the cells, the spots taken anew, their decisions (and tallies where someone reads them)
and the changed calls so far; nothing else is rewritten, the latest round of a spot counts. A round's plan doesn't grow with the rounds before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import radio
from ..plans.store import stored
from . import correction
from .correction import Settings

#: Changed spots of a round up to which the cells around them (at most fifteen for each) are broadcast.
SMALL = 10_000
#: Spots of a slice of a bin that is folded by itself.
SLICE = 1 << 15


@dataclass
class Settled:
    """decisions (with call: what the spot votes for afterwards) and tallies of each spot (None if they were not kept), and how many were decided in each round."""

    decisions: DataFrame
    tallies: DataFrame | None
    rounds: list[int] = field(default_factory=list)


_FOLDED = "bin long, slice long, event_id long, anchor string, call string, own long, every long, delta long, touched boolean, base long, seen long, down long, up long"
#: How far a start may move that no comparison depends on.
_ANY = 1 << 60


def _fold(gain: int, loss: int, good: int, farthest: int):
    """Of a slice of a bin (spots: t, event_id, subject, winner, applied, calls; starts: call, base, seen): a row of event_id and anchor for each spot with a good call near, and a row for each call: what the slice gives it, whether it was touched,
    the starts that were taken, and how far down and up they may move.

    calls: call, distance to the subject, prior in this bin, prior of all bins. base: what changes are added to; seen: what the call is judged by until its first change."""

    def fold(key: tuple, spots: pa.Table, starts: pa.Table) -> pa.Table:
        begin = {r["call"]: (r["base"], r["seen"]) for r in starts.to_pylist()}
        held: dict[str, list] = {}  # own, every, delta, touched, base, seen, down, up
        ids, anchors = [], []
        for b in spots.sort_by([("t", "ascending"), ("event_id", "ascending")]).select(["event_id", "subject", "winner", "applied", "calls"]).to_batches(max_chunksize=2000):
            for i, subject, winner, applied, calls in zip(*(c.to_pylist() for c in b.columns), strict=True):
                best = None
                for x in calls:
                    call, d = x["call"], x["d"]
                    of = held.get(call)
                    if of is None:
                        own, every = x["own"], x["every"]
                        base, seen = begin.get(call) or (own or 0, own if own is not None else every or 0)
                        of = held[call] = [own, every, 0, False, base, seen, _ANY, _ANY]
                    if call == subject or d > farthest:
                        continue
                    over = (of[4] + of[2] if of[3] else of[5]) - good
                    if over >= 0:
                        of[6] = min(of[6], over)
                        if best is None or (d, call) < best:
                            best = (d, call)
                    else:
                        of[7] = min(of[7], -1 - over)
                if best:
                    ids.append(i)
                    anchors.append(best[1])
                    winner, applied = best[1], True
                for x in calls if applied else []:
                    of = held[x["call"]]
                    of[2] += gain if x["call"] == winner else -loss
                    of[3] = True
        n, m = len(ids), len(held)
        columns = list(zip(*held.values(), strict=True)) if m else [()] * 8
        at = [pa.array([k.as_py()] * (n + m), pa.int64()) for k in key]
        calls_ = [pa.array([None] * n + list(c), t) for c, t in zip([held, *columns], [pa.string(), *[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 4], strict=True)]
        return pa.Table.from_arrays([*at, pa.array(ids + [None] * m, pa.int64()), pa.array(anchors + [None] * m, pa.string()), *calls_], names=[x.split()[0] for x in _FOLDED.split(", ")])

    return fold


def _sliced(spots: DataFrame, size: int) -> tuple[DataFrame, int]:
    """spots with their slice, and how many slices there are: spans of a bin's time with about size spots, cut at one of 4,096 equal steps of the whole time."""
    lo, hi = spots.agg(F.min("t"), F.max("t")).first()
    step = max(1, ((hi or 0) - (lo or 0)) // 4096 + 1)
    spots = spots.withColumn("_step", F.floor((F.col("t") - (lo or 0)) / step).cast("long"))
    counts = spots.groupBy("bin", "_step").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("bin").orderBy("_step")) - F.col("_n")  # at most 4,096 rows a bin
    cuts = stored(counts.withColumn("slice", F.floor(before / size).cast("long")).select("bin", "_step", "slice"), "cuts")
    n = cuts.select("bin", "slice").distinct().count()
    return spots.join(cuts, ["bin", "_step"]).drop("_step"), n


def learned_anchors(tally: DataFrame, decisions: DataFrame, s: Settings, priors: DataFrame | None = None, gain: int = 1, loss: int = 1, by_mode: bool = False, size: int = SLICE) -> DataFrame:
    """event_id, anchor by qualities as of each spot: priors (call, bin, score; bin -1: of all bins, where the call has none in its own) and what earlier decisions, anchored ones among them, gave and took. decisions: without anchors. size: spots of a slice."""
    x = tally.select("event_id", "t", "subject", "mode", F.col("cand").alias("call"), radio.freq_bin("freq_khz", s.quality_bin_hz).alias("bin"))
    if by_mode:
        from ..functions.distance import with_distance

        x = with_distance(x, "subject", "call", "mode", "d")
    else:
        x = x.withColumn("d", radio.edit_distance("subject", "call"))
    if priors is None:
        x = x.withColumns({"own": F.lit(None).cast("long"), "every": F.lit(None).cast("long")})
    else:
        table = priors.groupBy("call", "bin").agg(F.sum("score").cast("long").alias("own"))
        x = x.join(table, ["call", "bin"], "left").join(table.where("bin = -1").select("call", F.col("own").alias("every")), "call", "left")
    # a spot's calls, at most one for each of its reporters
    spots = x.groupBy("bin", "t", "event_id", "subject").agg(F.collect_list(F.struct("call", F.col("d").cast("long").alias("d"), "own", "every")).alias("calls"))
    spots = spots.join(decisions.select("event_id", "winner", (F.col("decision") == "applied").alias("applied")), "event_id")
    # the others neither find an anchor nor change a score; a spot without frequency or time has its own call only
    near = F.exists("calls", lambda c: (c["call"] != F.col("subject")) & (c["d"] <= s.max_distance))
    sliced, n = _sliced(stored(spots.where("bin is not null and t is not null").where(F.col("applied") | near), "folds"), size)
    sliced = stored(sliced.select("bin", "slice", "t", "event_id", "subject", "winner", "applied", "calls"), "slices")
    fold = _fold(gain, loss, s.good_quality, s.max_distance)

    def folded(rows: DataFrame, starts: DataFrame) -> DataFrame:
        if n > correction.FEW:  # a task sorts a slice or two, whatever the bin
            rows, starts = (x.repartition(n, "bin", "slice") for x in (rows, starts))
        return rows.groupBy("bin", "slice").cogroup(starts.groupBy("bin", "slice")).applyInArrow(fold, _FOLDED)

    none = sliced.sparkSession.createDataFrame([], "bin long, slice long, call string, base long, seen long")
    now = stored(folded(sliced, none), "folded")
    while True:
        w = Window.partitionBy("bin", "call").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
        x = now.where("event_id is null").withColumns({"_sum": F.coalesce(F.sum("delta").over(w), F.lit(0)), "_was": F.coalesce(F.max("touched").over(w), F.lit(False))})
        base = F.coalesce("own", F.lit(0)) + F.col("_sum")
        x = x.withColumns({"_base": base, "_seen": F.when(F.col("_was"), base).otherwise(F.coalesce("own", "every", F.lit(0)))})
        off = lambda new, old: ~(F.col(new) - F.col(old)).between(-F.col("down"), F.col("up"))
        starts = stored(x.select("bin", "slice", "call", F.col("_base").alias("base"), F.col("_seen").alias("seen"), (off("_base", "base") | off("_seen", "seen")).alias("_off")), "starts")
        again = starts.where("_off").select("bin", "slice").distinct()
        if again.isEmpty():
            return now.where("event_id is not null").select("event_id", "anchor")
        pick = lambda rows, how: rows.join(again, ["bin", "slice"], how)
        new = folded(pick(sliced, "left_semi"), pick(starts.drop("_off"), "left_semi"))
        now = stored(pick(now, "left_anti").unionByName(new), "folded")


class _Log:
    """A table of each round, of which a spot's latest counts."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def add(self, table: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(table, name))
        return self.tables[-1]

    def latest(self, ids: list[DataFrame]) -> DataFrame:
        """ids: event_id of what each round decided. The first table without the spots of later rounds, and of the others, which are small, what no later one has."""
        if len(self.tables) == 1:
            return self.tables[0]
        named = reduce(DataFrame.unionByName, [x.select("event_id", F.lit(k).alias("_round")) for k, x in enumerate(ids[1:], 1)]).groupBy("event_id").agg(F.max("_round").alias("_round"))
        later = reduce(DataFrame.unionByName, [x.withColumn("_round", F.lit(k)) for k, x in enumerate(self.tables[1:], 1)]).join(named, ["event_id", "_round"], "left_semi").drop("_round")
        return self.tables[0].join(named, "event_id", "left_anti").unionByName(later.select(*self.tables[0].columns))


def settle(spots: DataFrame, s: Settings, votes_back: bool = True, quality_back: bool = False, priors: DataFrame | None = None, valid: DataFrame | None = None, min_reports: DataFrame | None = None, by_mode: bool = False, gain: int = 1, loss: int = 1, keep_tallies: bool = True) -> Settled:
    """Decisions and tallies of all spots (as votes() takes them) with feedback. votes_back: a corrected spot votes for its new call, if that is in valid (column call; None: any). quality_back: decisions change the quality that anchors go by.
    priors: call, bin, score, from which qualities start; without it and without quality_back there are no anchors. With neither kind of feedback: the one-pass result.
    keep_tallies: False where only the decisions are wanted."""
    step, side = max(1, s.bucket_reach), -(-s.bucket_reach // max(1, s.bucket_reach))
    placed = {"_wide": F.floor(radio.bucket("freq_khz") / step).cast("long"), "_tick": F.floor(F.col("t") / s.window).cast("long")}
    rows = stored(correction.eligible(spots, s).drop("voted").withColumns(placed), "spots")
    n_parts, keep = correction.parts(rows, s), keep_tallies or quality_back or priors is not None
    known = None if valid is None else valid.select(F.col("call").alias("winner")).distinct().withColumn("_ok", F.lit(True))

    def judged(tally: DataFrame) -> DataFrame:
        found = None
        if quality_back:
            plain = correction.decide(tally, s, by_mode=by_mode, min_reports=min_reports)
            found = stored(learned_anchors(tally, plain, s, priors, gain, loss, by_mode), "anchors")
        elif priors is not None:
            found = correction.anchors(tally, priors, s, by_mode=by_mode)
        d = correction.decide(tally, s, by_mode=by_mode, min_reports=min_reports, anchored=found)
        d = d.withColumn("_ok", F.lit(True)) if known is None else d.join(known, "winner", "left")
        return d.withColumn("call", F.when((F.col("decision") == "applied") & F.coalesce("_ok", F.lit(False)), F.col("winner")).otherwise(F.col("subject"))).drop("_ok")

    def around(changed: DataFrame, n: int) -> DataFrame:
        """The spots that these n can reach, and their voters: those of the cells around, two reaches to either side."""
        few = n <= SMALL
        at = rows.join(F.broadcast(changed) if few else changed, "event_id", "left_semi").select("_wide", "_tick").distinct()
        near = F.array(*[F.struct((F.col("_wide") + w).alias("_wide"), (F.col("_tick") + k).alias("_tick")) for w in range(-2 * side, 2 * side + 1) for k in (-1, 0, 1)])
        cells = at.select(F.explode(near).alias("x")).select("x.*").distinct()
        return rows.join(F.broadcast(cells) if few else stored(cells, "cells"), ["_wide", "_tick"], "left_semi")

    def counted(log: _Log | None, table: DataFrame, name: str, of) -> tuple[DataFrame, int]:
        """The table, stored, and how many of its rows are such: counted as it is written."""
        seen = Observation()
        table = table.observe(seen, F.count_if(of).alias("n"))
        out = log.add(table, name) if log else stored(table, name)
        return out, seen.get["n"]

    tallies, decisions, taken = _Log(), _Log(), []
    held = lambda tally: tallies.add(tally, "tallies") if keep else tally
    tally = held(correction.tallies(correction.votes(rows, s, n_parts=n_parts)))
    now, n = counted(decisions, judged(tally), "decisions", F.lit(True))
    taken.append(now.select("event_id"))
    rounds = [n]
    # what changed its vote at some time, and whether in the last round
    calls, moved = counted(None, now.where("call <> subject").select("event_id", "call", F.lit(True).alias("_last")), "calls", F.lit(True)) if votes_back else (None, 0)
    while moved:
        changed = calls.where("_last").select("event_id")
        part = around(changed, moved)
        again = correction.reached(part, changed, s)
        if keep:
            again = stored(again, "again")
            n = again.count()
            if n == 0:
                break
            taken.append(again)
        before = calls.select("event_id", F.col("call").alias("_before"))
        voting = part.join(before, "event_id", "left").withColumn("voted", F.coalesce("_before", "dx_call")).drop("_before")
        tally = held(correction.tallies(correction.votes(voting, s, again, max(1, n_parts * moved * 8 // rounds[0]), narrow=False)))
        if quality_back:  # any spot's anchor may change: all decisions are of this round
            now = stored(judged(tallies.latest(taken)), "decisions")
        else:
            now, decided = counted(decisions, judged(tally), "decisions", F.lit(True))
            if not keep:
                n = decided
                taken.append(now.select("event_id"))
        rounds += [n] if n else []
        one = now.join(before, "event_id", "left").select("event_id", "call", (F.coalesce("_before", "subject") != F.col("call")).alias("_last"), F.col("_before").isNotNull().alias("_known")).where("_last or _known").drop("_known")
        kept = calls.join(now.select("event_id"), "event_id", "left_anti").withColumn("_last", F.lit(False))
        calls, moved = counted(None, kept.unionByName(one), "calls", F.col("_last"))
    return Settled(now if quality_back else decisions.latest(taken), tallies.latest(taken) if keep else None, rounds)
