"""Corrections with feedback against a loop over the spots in order."""

import collections
import random

import pytest

from ionolake.operators import correction, feedback
from ionolake.operators.correction import Settings

SPOT = "event_id long, t long, freq_khz double, de_call string, dx_call string, report long, mode string"
S = Settings(window=60, min_reports=2, min_advantage=1, min_confidence=40, max_distance=3, tolerance_hz=300.0, bucket_reach=5, min_snr=(("CW", 1),), extra_reports_d3=1)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def loop(rows, s, votes_back=True, quality_back=False, priors=(), valid=None):
    """Each spot in order of time and id, with an index of the calls as they went out, and a store of qualities."""
    out, index, quality = {}, [], {}
    for c, b, n in priors:
        quality[c, b] = quality.get((c, b), 0) + n

    def score(call, b):
        return quality.get((call, b), quality.get((call, -1), 0))

    for i, t, khz, de, dx, report, mode in sorted(rows, key=lambda r: (r[1], r[0])):
        if mode not in correction.ELIGIBLE:
            continue
        least = dict(s.min_snr).get(mode)
        loud = (least is None or report is None or report >= least) and de.strip() != ""
        stats, seen, total = collections.defaultdict(set), {}, set()
        place = lambda time, f: (time, int(f * 1000 + 0.5))
        stats[dx] |= {de} if loud and dx.strip() else set()
        seen[dx] = place(t, khz)
        total |= stats[dx]
        for t2, f2, de2, mode2, call2, loud2 in index:
            if t2 < t - s.window or not loud2 or not call2.strip() or abs(int(khz * 10 + 0.5) - int(f2 * 10 + 0.5)) > s.bucket_reach or abs(khz - f2) * 1000 > s.tolerance_hz + 1e-6:
                continue
            if (call2 != dx) if de2 == de else mode2 != mode:
                continue
            stats[call2].add(de2)
            total.add(de2)
            seen[call2] = max(seen.get(call2, (0, 0)), place(t2, f2))
        order = sorted(stats, key=lambda c: (-len(stats[c]), -seen[c][0], c))
        win, own, n_total = order[0], len(stats[dx]), len(total)
        support, runner = len(stats[win]), len(stats[order[1]]) if len(order) > 1 else 0
        conf, d = support * 100 // n_total if n_total else 0, levenshtein(dx, win)
        far = d >= 3
        if not n_total:
            reason = "no_reporters"
        elif win == dx or not support:
            reason = "no_winner"
        elif d > s.max_distance:
            reason = "max_edit_distance"
        elif support < s.min_reports + far * s.extra_reports_d3:
            reason = "min_reports"
        elif support < own + s.min_advantage + far * s.extra_advantage_d3:
            reason = "advantage"
        elif conf < s.min_confidence + far * s.extra_confidence_d3:
            reason = "confidence"
        elif runner and abs(seen[order[1]][1] - seen[win][1]) / 1000 >= s.guard_separation_khz - 1e-9 and runner >= s.guard_ratio * support:
            reason = "freq_guard"
        else:
            reason = ""
        path, b = "consensus", int(khz * 1000 + 0.5) // s.quality_bin_hz
        if quality_back or priors:
            good = sorted((levenshtein(dx, c), c) for c in stats if c != dx and score(c, b) >= s.good_quality and levenshtein(dx, c) <= s.max_distance)
            if good:
                win, path, reason = good[0][1], "anchor", ""
        if quality_back and not reason:
            for c in stats:
                quality[c, b] = quality.get((c, b), 0) + (1 if c == win else -1)
        call = win if not reason and (valid is None or win in valid) else dx
        out[i] = (win, n_total, path, reason, call)
        index.append((t, khz, de, mode, call if votes_back else dx, loud))
    return out


def inputs(n=20, size=60):
    """n independent inputs, 50 kHz from each other, of which wrong calls are corrected and vote on."""
    rng, rows = random.Random(12), []
    for k in range(n):
        right = [f"K{rng.randint(1, 9)}{a}" for a in ("ABC", "XYZ")]
        wrong = [c[:-1] + rng.choice("DEF8") for c in right] + [right[0].replace("A", "4"), right[0] + "QQ"]
        for _ in range(size):
            call = rng.choice(right * 3 + wrong)
            rows.append((len(rows), rng.randrange(120), 14000.0 + 50 * k + rng.randrange(5) / 10, f"W{rng.randint(0, 9)}AA", call, rng.choice([None, 0, 5, 9]), rng.choice(["CW", "CW", "CW", "RTTY", "FT8"])))
    return [*rows, (len(rows), 9, 14000.1, " ", "K1ABC", 5, "CW")]


@pytest.mark.parametrize("options", [{}, {"votes_back": False}, {"quality_back": True, "priors": True}, {"votes_back": False, "quality_back": True}, {"valid": True}], ids=str)
def test_settled_decisions_are_those_of_a_loop(spark, options):
    rows = inputs()
    options = dict(options)
    valid = {r[4] for r in rows if r[4][-1] in "CZ"} if options.pop("valid", None) else None
    priors = [("K1ABC", -1, 3), ("K5XYZ", -1, 2), ("K3ABC", 14150, 2)] if options.pop("priors", None) else []
    want = loop(rows, S, priors=priors, valid=valid, **options)
    got = feedback.settle(spark.createDataFrame(rows, SPOT), S, priors=spark.createDataFrame(priors, "call string, bin long, score long") if priors else None, valid=spark.createDataFrame([(c,) for c in valid], "call string") if valid else None, **options)
    assert {r["event_id"]: (r["winner"], r["total"], r["path"], r["reason"], r["call"]) for r in got.decisions.collect()} == want
    if options.get("votes_back", True):
        once = loop(rows, S, votes_back=False, quality_back=options.get("quality_back", False), priors=priors, valid=valid)
        assert sum(once[i] != want[i] for i in want) > 5 and len(got.rounds) > 2
    assert got.tallies.select("event_id").distinct().count() == len(want)
    assert got.rounds[0] == len(want) and (len(got.rounds) == 1 or got.rounds[-1] < len(want))


def test_a_corrected_call_votes_for_its_winner(spark):
    """One reporter says it wrong; with his vote for what he was corrected to, a later wrong call finds enough reporters."""
    good = [(i, 10 + i, 14020.0, f"W{i}AA", "K1ABC", 9, "CW") for i in range(3)]
    rows = [*good, (3, 20, 14020.0, "W8ZZ", "K1ABD", 9, "CW"), (4, 21, 14020.0, "W9ZZ", "K1ABE", 9, "CW")]
    s = Settings(window=60, min_reports=3, min_confidence=70, max_distance=2)
    t = spark.createDataFrame(rows, SPOT)
    assert {r["event_id"]: r["reason"] for r in correction.decide(correction.tallies(correction.votes(t, s)), s).collect()}[4] == "confidence"
    got = {r["event_id"]: r for r in feedback.settle(t, s).decisions.collect()}
    assert got[3]["call"] == got[4]["call"] == "K1ABC" and got[4]["winner_support"] == 4


def test_spots_without_frequency_time_or_reporter(spark):
    rows = [(i, 10 + i, 14020.0, f"W{i}AA", "K1ABC", 9, "CW") for i in range(4)] + [(7, 14, None, "W7AA", "K1ABD", 9, "CW"), (8, None, 14020.0, "W8AA", "K1ABD", 9, "CW"), (9, 14, 14020.0, " ", "K1ABD", 9, "CW"), (10, 14, 14020.0, "W9AA", None, 9, "CW")]
    got = {r["event_id"]: r["reason"] for r in correction.decide(correction.tallies(correction.votes(spark.createDataFrame(rows, SPOT), S)), S).collect()}
    assert set(got) == {0, 1, 2, 3, 7, 8, 9, 10} and got[7] == got[8] == "no_reporters"
    assert feedback.settle(spark.createDataFrame([], SPOT), S).decisions.count() == 0


def test_a_log_of_rounds_takes_one_anti_join(spark):
    """The latest row of each spot, by a plan that doesn't grow with the square of the rounds."""
    log, ids = feedback._Log(), []
    for k, of in enumerate(([0, 1, 2, 3, 4], [1, 2, 3], [2, 3], [3, 1], [3])):
        log.tables.append(spark.createDataFrame([(i, k) for i in of], "event_id long, k int"))
        ids.append(log.tables[-1].select("event_id"))
    out = log.latest(ids)
    assert sorted(map(tuple, out.collect())) == [(0, 0), (1, 3), (2, 2), (3, 4), (4, 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1


@pytest.mark.parametrize("start", [0, 3], ids=str)
def test_qualities_by_slices_of_time_are_those_in_one_go(spark, start):
    """A crowded bin is cut into slices that are folded side by side, again where a start moved a comparison; a loop over the spots gives the same anchors."""
    rng, tally, decided, want, scores = random.Random(5 + start), [], [], {}, {}
    names = ["K1ABC", "K1ABD", "K1ABE", "K1XYZ"]
    for i in range(400):
        subject, calls = rng.choice(names), rng.sample(names, 3)
        winner, applied, khz = rng.choice(calls), rng.random() < 0.6, 14000.2 + i % 2
        tally += [(i, i // 3, subject, "CW", c, khz) for c in calls]
        decided.append((i, winner, "applied" if applied else "rejected"))
        priors = {"K1ABD": start}
        near = sorted((levenshtein(subject, c), c) for c in calls if c != subject and levenshtein(subject, c) <= 2 and scores.get((i % 2, c), priors.get(c, 0)) >= 2)
        if near:
            want[i] = winner = near[0][1]
        for c in calls if applied or near else []:
            scores[i % 2, c] = scores.get((i % 2, c), 0) + (2 if c == winner else -1)
    t = spark.createDataFrame(tally, "event_id long, t long, subject string, mode string, cand string, freq_khz double")
    d = spark.createDataFrame(decided, "event_id long, winner string, decision string")
    p = spark.createDataFrame([("K1ABD", -1, start)], "call string, bin long, score long")
    s = Settings(max_distance=2, good_quality=2)
    for size in (11, 1000):
        got = feedback.learned_anchors(t, d, s, p, gain=2, size=size).collect()
        assert {r["event_id"]: r["anchor"] for r in got} == want and len(got) == len(want) > 20
