import random

import pytest
from pyspark.sql import functions as F

from ionolake.operators import analytics, correction, dedup, filters, lookups, signals
from ionolake.operators.correction import Settings


@pytest.mark.parametrize("prefer", [True, False])
def test_anchor_dedup_against_a_loop(spark, prefer):
    rng = random.Random(4)
    rows = [(i, rng.randrange(2000), rng.choice("ABC"), rng.choice([None, 1, 5, 9, 12])) for i in range(900)]
    want, state = set(), {}
    for i, t, k, r in sorted(rows, key=lambda x: (x[1], x[0])):
        a = state.get(k)
        stronger = a and ((r is not None and a[1] is None) or (prefer and (r or 0) > (a[1] or 0)))
        if a is None or abs(t - a[0]) >= 60 or stronger:
            state[k] = (t, r)
            want.add(i)
    got = dedup.secondary(spark.createDataFrame(rows, "event_id long, t long, k string, report long"), ["k"], 60, prefer)
    assert {r["event_id"] for r in got.collect()} == want


def test_slices_of_a_busy_key(spark, monkeypatch):
    """One key, whatever the slices' length: few rows wait for earlier slices, and rows without a time go on."""
    rng = random.Random(6)
    rows = [(i, 2 * i + rng.randrange(3), "A", rng.choice([None, *range(40)]), {"x": i}) for i in range(20_000)]
    rows += [(100_000 + i, i, "B", 5, None) for i in range(3000)] + [(200_000, None, "A", 1, None)]
    schema = "event_id long, t long, k string, report long, more struct<x:long>"
    want, state = {200_000}, {}
    for i, t, k, r, _ in sorted((r for r in rows if r[1] is not None), key=lambda x: (x[1], x[0])):
        a = state.get(k)
        if a is None or t - a[0] >= 60 or (r is not None and a[1] is None) or (r or 0) > (a[1] or 0):
            state[k] = (t, r)
            want.add(i)
    tables = []
    plain = dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, name: tables.append(plain(df, name)) or tables[-1])
    for slice_ in (1, 7, 20):
        monkeypatch.setattr(dedup, "_SLICE", slice_)
        got = dedup.secondary(spark.createDataFrame(rows, schema), ["k"], 60)
        assert got.columns == ["event_id", "t", "k", "report", "more"] and {r["event_id"] for r in got.collect()} == want
        assert all(r["more"]["x"] == r["event_id"] for r in got.where("more is not null").collect())
    assert tables[-1].where("_kind > 0 and _key0 = 'A'").count() < 1500 and tables[-1].where("_key0 = 'A'").select("_slice").distinct().count() > 30


def test_pass_through_rows(spark):
    t = spark.createDataFrame([(1, 1, "a", 5, 0), (2, 2, "a", 5, 0), (3, 3, "a", 5, 3), (4, 4, "a", 5, 3)], "event_id long, t long, k string, report long, adif int")
    assert {r["event_id"] for r in dedup.secondary(t, ["k"], 60, pass_through="adif <= 0").collect()} == {1, 2, 3}


def decide(spark, votes, khz=14074.0, **settings):
    rows = [(0, 1000, khz, "W1AAA", "K1ABC", 10, "CW", 1.0)] + [(i + 1, t, f, r, c, 10, "CW", 1.0) for i, (c, r, f, t) in enumerate(votes)]
    t = spark.createDataFrame(rows, "event_id long, t long, freq_khz double, de_call string, dx_call string, report int, mode string, reliability double")
    s = Settings(window=30, **settings)
    return correction.decide(correction.tallies(correction.votes(t, s)), s).where("event_id = 0").first()


def test_consensus_cases(spark):
    near = [("K1A8C", "W1AAA", 14074.0, 995), ("K1A8C", "W2BBB", 14074.0, 995), ("K1A8C", "W3CCC", 14074.1, 995), ("K1A8C", "W4DDD", 14074.0, 990)]
    base = {"min_reports": 3, "min_advantage": 1, "min_confidence": 50, "max_distance": 2}
    got = decide(spark, near, **base)
    assert (got["winner"], got["winner_support"], got["decision"]) == ("K1A8C", 3, "applied")
    assert decide(spark, [(c, r, f, t - 120) for c, r, f, t in near], **base)["reason"] == "no_winner"
    assert decide(spark, [("K1XYZ", "W2BBB", 14074.0, 990 + i) for i in range(3)], **base)["decision"] == "rejected"
    assert decide(spark, [("ZZ9ZZA", f"W{i}B", 14074.0, 995) for i in range(3)], **{**base, "max_distance": 1})["reason"] == "max_edit_distance"
    two = [("K1XYZ", "W2B", 14074.0, 995), ("K1XYZ", "W3C", 14074.0, 995), ("K1XYZ", "W5E", 14074.0, 995), ("K1ABC", "W4D", 14074.0, 995)]
    assert decide(spark, two, **{**base, "min_reports": 2, "min_advantage": 2, "max_distance": 3})["reason"] == "advantage"
    lone = [("K1XYZ", "W2B", 14074.0, 995), ("K1XYZ", "W3C", 14074.0, 995), ("K1A8C", "W4D", 14074.0, 995)]
    assert decide(spark, lone, **{**base, "min_reports": 2, "min_confidence": 70, "max_distance": 3})["reason"] == "confidence"
    split = [("K1A8C", f"W{i}B", 14074.0, 995) for i in range(4)] + [("K1AXC", f"W{i}C", 14074.3, 996) for i in range(3)]
    assert decide(spark, split, **{**base, "min_confidence": 40})["reason"] == "freq_guard"


def test_reports_of_one_minute_correct_a_call(spark):
    """Lines of a feed carry minutes only: the spots of one moment vote for those after them."""
    from ionolake.sources import feeds

    lines = [f"DX de W{i}AA-#:  14025.0  K1ABC  CW  {20 + i} dB  25 WPM  CQ  1200Z" for i in range(1, 7)] + ["DX de W8ZZ-#:  14025.0  K1A8C  CW  9 dB  25 WPM  CQ  1200Z"]
    p = feeds.parse_lines(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, n long").coalesce(1), F.lit("2025-12-04 12:00:30").cast("timestamp"))
    s = p.withColumns({"event_id": F.monotonically_increasing_id(), "t": F.unix_timestamp("ts")})
    d = correction.decide(correction.tallies(correction.votes(s, Settings())), Settings()).collect()
    assert len(d) == 7 and {(r["subject"], r["winner"], r["winner_support"], r["total"]) for r in d if r["decision"] == "applied"} == {("K1A8C", "K1ABC", 6, 7)}
    assert correction.votes(s.withColumn("mode", F.lit("FT8")), Settings()).count() == 0


def test_weak_and_adaptive_spots(spark):
    schema = "event_id long, t long, freq_khz double, de_call string, dx_call string, report int, mode string"
    t = spark.createDataFrame([(0, 1000, 14010.0, "W1", "K1ABC", 1, "CW")] + [(i, 1000, 14010.0, f"W{i + 2}", "K1ABD", 20, "CW") for i in range(1, 4)] + [(9, 1001, 14010.0, "W1", "K1ABC", 1, "CW")], schema)
    s = Settings(min_snr=(("CW", 5),), min_reports=4)
    d = {r["event_id"]: r for r in correction.decide(correction.tallies(correction.votes(t, s)), s).collect()}
    assert len(d) == 5 and d[0]["reason"] == "no_reporters" and d[0]["total"] == 0 and d[9]["reason"] == "min_reports" and d[9]["total"] == 3
    least = spark.createDataFrame([(9, 3)], "event_id long, min_reports int")
    assert {r["event_id"]: r["decision"] for r in correction.decide(correction.tallies(correction.votes(t, s)), s, min_reports=least).collect()}[9] == "applied"


def test_applying_corrections(spark):
    s = spark.createDataFrame([(1, "A", "CW"), (2, "B", "CW"), (3, "C", "FT8")], "event_id long, dx_call string, mode string")
    d = spark.createDataFrame([(1, "applied", "A1"), (2, "applied", "B1")], "event_id long, decision string, winner string")
    g = spark.createDataFrame([(1, "P"), (2, "V"), (3, "V")], "event_id long, glyph string")
    ok = spark.createDataFrame([("A1",)], "call string")
    rows = {r["event_id"]: (r["dx_call"], r["confidence"]) for r in correction.apply_to(s, d, g, ok).collect()}
    assert rows == {1: ("A1", "C"), 2: ("B", "B"), 3: ("C", "")} and correction.apply_to(s, d, g, ok, suppress=True).count() == 2


def test_anchor_calls(spark):
    tally = spark.createDataFrame([(1, "K1ABC", 14000.0, "K1A8C"), (1, "K1ABC", 14000.0, "K9ZZZ"), (1, "K1ABC", 14000.0, "K1ABC")], "event_id long, subject string, freq_khz double, cand string")
    scores = spark.createDataFrame([("K1A8C", -1, 2), ("K9ZZZ", 14000, 9), ("K1ABC", -1, 9)], "call string, bin long, score long")
    assert [tuple(r) for r in correction.anchors(tally, scores, Settings()).collect()] == [(1, "K1A8C")]


def test_prefixes(spark):
    keys = spark.createDataFrame([("K1ABC",), ("K1",), ("XM3",), ("W6",), ("FO/",)], "prefix string")
    t = spark.createDataFrame([(c,) for c in ("K1ABC", "K1XYZ", "K1ABC/M", "XM3A", "W6/UT5UF", "FO/ABC", "ZZ9ZZA", "")] + [(None,)], "call string")
    got = {r["call"]: r["entity"] and r["entity"]["prefix"] for r in lookups.longest_prefix(t, "call", keys).collect()}
    assert got == {"K1ABC": "K1ABC", "K1XYZ": "K1", "K1ABC/M": "K1ABC", "XM3A": "XM3", "W6/UT5UF": "W6", "FO/ABC": "FO/", "ZZ9ZZA": None, "": None, None: None}
    e = {r["call"]: r["entity"] and r["entity"]["prefix"] for r in lookups.effective_prefix(spark.createDataFrame([("W6/K1XYZ",)], "call string"), "call", keys).collect()}
    assert e == {"W6/K1XYZ": "K1"}


def test_licences_and_store(spark):
    t = spark.createDataFrame([("K1A", 291), ("K2B", 291), ("G3X", 223), ("Z", None)], "call string, adif int")
    lic = spark.createDataFrame([("K1A",)], "call string")
    assert {r["call"] for r in lookups.drop_unlicensed(t, lic, "adif", "call").collect()} == {"K1A", "G3X", "Z"} and lookups.drop_unlicensed(t, None, "adif", "call").count() == 4
    schema = "call string, is_known int, grid string, observations long, first_seen long, updated_at long, expires_at long"
    old, new = spark.createDataFrame([("A", 1, "FN20", 3, 1, 5, None)], schema), spark.createDataFrame([("A", 0, None, 1, 9, 9, 7), ("B", 0, "JO22", 1, 2, 2, None)], schema)
    rows = {r["call"]: tuple(r) for r in lookups.merge_calls(old, new).collect()}
    assert rows == {"A": ("A", 1, "FN20", 4, 1, 9, 7), "B": ("B", 0, "JO22", 1, 2, 2, None)}
    assert {r["call"]: r["is_known"] for r in lookups.seed_known(old, spark.createDataFrame([("c",)], "call string"), 10).collect()} == {"A": 0, "C": 1} and lookups.purge_calls(old, 6).count() == 0


def test_harmonics(spark):
    schema = "event_id long, t long, freq_khz double, de_call string, dx_call string, report int"
    near = spark.createDataFrame([(1, 0, 7011.0, "W1", "K1ABC", 20), (2, 0, 7011.0, "W2", "K1ABC", 30), (3, 0, 14022.0, "W1", "K1ABC", 10), (4, 1, 4674.0, "W1", "K1ABC", 30), (5, 1, 14022.0, "W4", "K1ABC", 5), (6, 1, 28044.0, "W4", "K1ABC", -9)], schema)
    got = {r["event_id"]: (r["fundamental"], r["delta"], r["corroborators"]) for r in signals.harmonics(near).collect()}
    assert got == {3: (7011.0, 10, 2), 5: (7011.0, 15, 2), 6: (7011.0, 29, 2)}
    assert {r["event_id"]: r["corroborators"] for r in signals.harmonics(near.where("event_id > 2"), levels=2).collect()} == {5: 1, 6: 1}
    t = spark.createDataFrame([(1, 0, 7011.0, "W1", "K1ABC", 20), (2, 5, 14022.0, "W1", "K1ABC", 10), (3, 5, 15000.0, "W1", "K1ABC", 1), (4, 500, 14022.0, "W1", "K1ABC", 1)], schema)
    got = signals.harmonics(t).collect()
    assert [(r["event_id"], r["fundamental"], r["multiple"], r["delta"], r["corroborators"]) for r in got] == [(2, 7011.0, 2, 10, 1)]
    step = spark.createDataFrame([(1, 0, 7000.0, "W1", "K1", 20), (2, 5, 21000.0, "W1", "K1", 12), (3, 6, 21000.0, "W1", "K1", 8)], schema)
    assert [r["event_id"] for r in signals.harmonics(step, step=3.5).collect()] == [3]


def test_hysteresis(spark):
    raw = ["quiet", "busy", "busy", "busy", "quiet", "normal", "quiet", "quiet", "quiet"]
    t = spark.createDataFrame([("g", i, s) for i, s in enumerate(raw)], "grp string, slot long, raw_state string")
    got = [r["state"] for r in signals.hysteresis(t, 2).orderBy("slot").collect()]
    assert got == ["normal", "normal", "busy", "busy", "busy", "busy", "busy", "quiet", "quiet"]
    assert signals.highest_state(signals.hysteresis(t, 2)).where("slot = 3").first()["state"] == "busy"


def test_silent_groups_and_sliding_windows(spark):
    s = spark.createDataFrame([(0, "A", 14010.0), (650, "B", 14010.0), (1900, "C", 14010.0)], "t long, de_call string, freq_khz double")
    g = spark.createDataFrame([("hf", "20m"), ("hf", "10m"), ("night", "160m")], "grp string, band string")
    got = {(r["slot"], r["grp"]): r["mean_reporters"] for r in signals.active_reporters(s, g, 600, 1200).collect()}
    assert got == {(k, "hf"): n / 2 for k, n in enumerate((1, 2, 1, 1))} | {(k, "night"): 0.0 for k in range(4)}


def test_busy_until_three_quiet_minutes(spark):
    t = spark.createDataFrame([(i, b) for i, b in enumerate([False, True, False, False, True, False, False, False, False])], "minute long, busy boolean")
    assert [r["state"][0] for r in signals.activity(t, 3).orderBy("minute").collect()] == list("qbbbbbbqq")


@pytest.mark.parametrize("prefer", [True, False])
def test_first_dedup_against_a_loop(spark, prefer):
    rng = random.Random(5)
    rows = [(i, i // 3, rng.randrange(60), rng.choice([None, -9, -5, -1, 0, 3, 8])) for i in range(1500)]
    want, state = set(), {}
    for i, t, k, r in rows:
        a = state.get(k)
        if a is None or (r is not None and not a[1]) or (prefer and (r or 0) > a[0]):
            state[k] = (r or 0, r is not None)
            want.add(i)
    got = dedup.primary(spark.createDataFrame(rows, "event_id long, t long, k long, report long"), ["k"], prefer)
    assert {r["event_id"] for r in got.collect()} == want and got.columns == ["event_id", "t", "k", "report"]


def test_deliveries_by_table_equal_compiled_filters(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["20m", "40m", "160m", "???"]), rng.choice(["CW", "FT8", "USB", ""]), rng.choice(["HUMAN", "SKIMMER"]), rng.choice(["EU", "NA", None]), "NA", rng.choice([0, 3, 14, None]), 5, rng.choice([0, 291, 1]), 291, rng.choice(["FN", "", None]), "JO", rng.choice(["V", "", "30", "?"]), rng.choice(["K1ABC", "K1XY", "G4AB", None]), "W2X", rng.random() < 0.3) for i in range(500)]
    schema = "event_id long, band string, mode string, source string, dx_continent string, de_continent string, dx_zone int, de_zone int, dx_adif int, de_adif int, dx_grid2 string, de_grid2 string, confidence string, dx_call string, de_call string, is_beacon boolean"
    t = spark.createDataFrame(rows, schema)
    lines = ["PASS BAND 20M,40M", "REJECT BAND 40M", "PASS MODE CW,FT8", "REJECT MODE FT8", "PASS DXCONT EU", "REJECT DXCONT EU", "PASS DXZONE 3,14", "REJECT DXZONE 14", "PASS DXDXCC 291", "PASS DXGRID2 FN", "REJECT DXGRID2 FN", "PASS CONFIDENCE V", "REJECT CONFIDENCE ?", "PASS CONFIDENCE ALL", "PASS DXCALL K1*", "REJECT DXCALL *AB", "REJECT BEACON", "REJECT BAND ALL", "REJECT MODE ALL", "PASS SOURCE HUMAN"]
    subs = []
    for k in range(25):
        f = filters.OPEN if k % 2 else filters.Filter()
        for line in rng.sample(lines, rng.randrange(1, 5)):
            f, _ = filters.command(f, line)
        subs.append(("K1ABC" if k == 3 else f"S{k}", f))
    want = sorted((r["subscriber"], r["event_id"]) for r in filters.deliver(t, subs).collect())
    got = sorted((r["subscriber"], r["event_id"]) for r in filters.deliver_by_table(t, filters.filter_table(spark, subs)).collect())
    assert got == want and len(want) > 500


def test_typed_lines():
    assert filters.typed("PASS DXCALL K1*,*AB\r\n") == "PASS DXCALL K1*,*AB" and filters.typed("PASS \x00") is None


def test_rule_truth_table(spark):
    """Every set of flags against the rule written out."""
    t = spark.createDataFrame([("CW",), ("FT4",), ("",), (None,)], "mode string")
    for allow in ((), ("CW",)):
        for block in ((), ("CW",)):
            for every in (True, False):
                for none in (True, False):
                    r = filters.Rule(frozenset(allow), frozenset(block), every, none)
                    got = [x["mode"] for x in t.where(filters._rule_column("MODE", r)).collect()]

                    def passes(m):
                        if none or (m in block):
                            return False
                        if allow:
                            return bool(m) and m in allow
                        return every

                    assert got == [m for m in ("CW", "FT4", "", None) if passes(m)], r


def test_commands():
    f, reply = filters.command(filters.Filter(), "PASS BAND 20M,40M")
    assert f.rule("BAND").allow == {"20m", "40m"} and not f.rule("BAND").all and "20m" in reply
    f, _ = filters.command(f, "REJECT BAND 20m 40m")
    assert f.rule("BAND").all and f.rule("BAND").block == {"20m", "40m"}
    assert filters.command(f, "PASS BAND ALL")[0].rule("BAND") == filters.Rule()
    assert filters.command(f, "REJECT BAND ALL")[0].rule("BAND").block_all and filters.Filter().rule("MODE").allow == filters.NEW_USER_MODES
    assert filters.command(f, "REJECT ALL")[0] == filters.OPEN and "PASS" in filters.command(f, "SET/FILTER BAND 20M".replace("/", " "))[1]
    assert filters.command(f, "PASS DXZONE 41")[0] is f and filters.command(f, "HELLO")[1] == "Unknown command" and "MODE" in filters.command(f, "SHOW FILTER MODE")[1]


def test_reference_classes(spark):
    d = spark.createDataFrame([(1, 600, 14000.0, "K1-A", "K1B", "applied"), (2, 600, 14000.0, "K2A", "K2B", "applied"), (3, 86399, 14000.0, "K3A", "K3B", "applied")], "event_id long, t long, freq_khz double, subject string, winner string, decision string")
    ref = spark.createDataFrame([(1, 700, 14000.5, "K1A", "K1B"), (2, 640, 14000.0, "K2A", "K2X"), (3, 1, 14000.0, "K3A", "K3B")], "row long, t long, freq_khz double, bad string, correct string")
    m = analytics.match_reference(d, ref)
    assert {r["event_id"]: r["class"] for r in m.collect()} == {1: "CORRECT_FIX", 2: "WRONG_FIX", 3: "POSSIBLE_FALSE_POSITIVE"}
    assert [r["row"] for r in analytics.missed_reference(ref, m).collect()] == [3] and analytics.accuracy(m).count() == 3


def test_streams_equal_batch(spark, sf):
    import __spark_entry__ as entry

    q = entry.queries()
    assert {r["event_id"] for r in q["stream_dedup"](spark, sf).collect()} == {r["event_id"] for r in q["secondary_dedup"](spark, sf).collect()}
    assert q["stream_tumbling"](spark, sf).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_sinks(spark, tmp_path):
    from ionolake.sources import sinks

    t = spark.sql("SELECT timestamp'2025-12-01 10:00:00' AS ts, 1 AS id UNION ALL SELECT timestamp'2025-12-04 10:00:00', 2")
    sinks.write_decisions(t, str(tmp_path / "log"))
    assert [r["id"] for r in sinks.recent_decisions(spark, str(tmp_path / "log"), "2025-12-04").collect()] == [2]
    assert sinks.report_lines({"decisions": 3, "applied": 1, "applied_pairs": 1}, [("a", 1), ("b", 2)], [("20m", 3, 1)])[1].split() == ["b", "2"]


def test_votes_partitions_follow_the_pairs(spark, monkeypatch):
    rows = [(i, i // 4, f"W{i % 9}S{i % 50}", f"K{i % 3}ABC", 14000.0 + i % 20 / 10, "CW", 10) for i in range(4000)]
    t = spark.createDataFrame(rows, "event_id long, t long, de_call string, dx_call string, freq_khz double, mode string, report int")
    s = Settings(window=90, bucket_reach=5)
    subject, voter = correction._sides(t, s)
    pairs = subject.join(voter, ["bucket", "tick"]).count()
    for size in (1000, 50_000):
        monkeypatch.setattr(correction, "PAIRS", size)
        assert correction.parts(t, s) == -(-pairs // size)
    monkeypatch.setattr(correction, "PAIRS", 50_000)
    got = correction.votes(t, s)
    assert got.rdd.getNumPartitions() == correction.parts(t, s) > 4 and correction.parts(t.limit(0), s) == 1
    monkeypatch.setattr(correction, "PAIRS", 1 << 40)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, correction.votes(t, s).collect()))
    tally = correction.tallies(got)
    known = F.lit(True)
    assert sorted(map(tuple, correction.glyphs(tally, known).collect())) == sorted(map(tuple, correction.glyphs(correction.decide(tally, s), known).collect()))
