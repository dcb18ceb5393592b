"""Keyed state on streams against the batch operators: unordered micro-batches, silent periods, late rows."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from ionolake.operators import correction, dedup, signals
from ionolake.streaming import states
from tests.test_feedback import SPOT, S, inputs


def stream_of(spark, tmp_path, parts, schema):
    """A stream of one micro-batch for each list of rows."""
    place = str(tmp_path / uuid.uuid4().hex)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)


def shuffled_parts(rows, n, reach, seed=3):
    """n parts of about equal spans of time, between which rows up to reach seconds apart change places."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(reach))
    size = -(-len(late) // n)
    return [rng.sample(late[k : k + size], len(late[k : k + size])) for k in range(0, len(late), size)]


def test_consensus_by_keyed_state_in_unordered_batches(spark, tmp_path):
    rows = [r for r in inputs(4) if r[6] != "FT8"]
    last = max(r[1] for r in rows)
    parts = [*shuffled_parts(rows, 5, 40), [(10**6, last + 1000, 14000.0, "W1END", "K0END", 9, "CW")], [(10**6 + 1, last + 3000, 14000.0, "W1END", "K0END", 9, "CW")]]
    states.consensus(stream_of(spark, tmp_path, parts, SPOT), S, str(tmp_path / "out"), str(tmp_path / "progress"), lateness="60 seconds")
    columns = ("event_id", "winner", "winner_support", "runner_up_support", "subject_support", "total", "conf", "distance", "reason")
    got = spark.read.parquet(str(tmp_path / "out")).where("event_id < 1000000").select(*columns)
    want = correction.decide(correction.tallies(correction.votes(spark.createDataFrame(rows, SPOT), S)), S).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(rows)


def state_rows(query):
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def test_state_of_many_windows_stays_bounded(spark, tmp_path):
    rows = [(i, 10 * i, 14000.0, f"W{i % 7}AA", "K1ABC", 9, "CW") for i in range(600)]
    parts = [rows[k : k + 60] for k in range(0, 600, 60)]
    q = states.consensus(stream_of(spark, tmp_path, parts, SPOT), S, str(tmp_path / "out"), str(tmp_path / "progress"), lateness="30 seconds")
    held = state_rows(q)
    assert len(held) >= 9 and max(held[3:]) <= 1.3 * max(held[:3]) + 10  # list rows of one micro-batch and a window, not of the stream


def test_adaptive_states_with_silent_periods(spark, tmp_path):
    rng = random.Random(5)
    busy = {0: 9, 1: 30, 2: 30, 3: 2, 4: 31, 5: 40, 11: 12, 12: 13, 13: 45, 14: 44, 15: 44}  # nothing from 6 to 10
    rows = [(slot * 600 + rng.randrange(600), rng.choice([14010.0, 7010.0]) if slot % 4 else 7010.0, f"W{k}A") for slot, n in busy.items() for k in range(n)]
    rows.sort()
    schema = "t long, freq_khz double, de_call string"
    parts = [rows[k : k + 90] for k in range(0, len(rows), 90)] + [[(30 * 600, 14010.0, "W1A")], [(60 * 600, 14010.0, "W1A")]]
    groups = {"mid": ["20m", "40m"], "high": ["10m"], "low": ["40m"]}
    s = states.adaptive_states(stream_of(spark, tmp_path, parts, schema), groups, repeats=2, lateness="60 seconds")
    states.start(s, str(tmp_path / "progress"), path=str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    table = spark.createDataFrame([(g, b) for g, bs in groups.items() for b in bs], "grp string, band string")
    series = signals.active_reporters(spark.createDataFrame(rows + parts[-2] + parts[-1], schema), table).withColumn("raw_state", signals.state_of("mean_reporters"))
    want = signals.hysteresis(series).where("slot < 29").select("slot", "grp", "mean_reporters", "raw_state", "state")
    have = got.where("slot < 29").select("slot", "grp", "mean_reporters", "raw_state", "state")
    assert sorted(map(tuple, have.collect())) == sorted(map(tuple, want.collect()))
    assert {r["state"] for r in want.collect()} == {"quiet", "normal", "busy"} and have.count() == 29 * 3


def test_late_rows_and_expiring_anchors(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.randrange(3000), rng.choice("ABC"), rng.choice([None, 0, 3, 7, 9])) for i in range(500)]
    schema = "event_id long, t long, k string, report long"
    parts = shuffled_parts(rows, 6, 200)
    parts[4] = parts[4] + [(9001, 5, "A", 9), (9002, 40, "B", None)]  # far too late
    parts += [[(9100, 9000, "Z", 1)], [(9101, 20000, "Z", 1)]]
    late_ids, newest = set(), None
    for p in parts:
        late_ids |= {r[0] for r in p if newest is not None and r[1] <= newest - 150}
        newest = max(newest or 0, *(r[1] for r in p))
    at = lambda n: str(tmp_path / n)
    states.split_late(stream_of(spark, tmp_path, parts, schema), 150, at("main"), at("late"), at("marks"), at("p1"))
    assert {r["event_id"] for r in spark.read.parquet(at("late")).collect()} == late_ids >= {9001, 9002}
    main = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).option("basePath", at("main")).parquet(at("main"))
    kept = states.expiring_dedup(main, ["k"], 60, lateness="10 minutes")
    counts = kept.groupBy(F.window("ts", "10 minutes"), "k").agg(F.count("*").alias("n")).select(F.unix_timestamp(F.col("window.start")).alias("start"), "k", "n")
    q = states.start(counts, at("p2"), path=at("counts"))
    batch = dedup.secondary(spark.createDataFrame([r for p in parts for r in p if r[0] not in late_ids], schema), ["k"], 60).where("t < 3000")
    want = batch.groupBy((F.floor(F.col("t") / 600) * 600).alias("start"), "k").agg(F.count("*").alias("n"))
    got = spark.read.parquet(at("counts")).where("start < 3000")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10
    assert state_rows(q)[-1] <= 8


def test_a_zone_holds_a_window_and_goes_with_its_tick():
    """Voters alone leave a timer, by which they go; a spot of the zone is judged by what its own tick and the one before hold."""
    import pandas as pd

    class Held(list):
        appendList = list.extend

        def get(self):
            return list(self)

        def put(self, rows):
            self[:] = rows

    class Handle:
        def __init__(self):
            self.timers, self.held = [], Held()

        def getListState(self, name, schema):
            return self.held

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    zone, handle = states._Zone(S), Handle()
    zone.init(handle)
    columns = [c.split()[0] for c in states._SPOT.split(", ")]
    tick, end = 7, 8 * S.window
    row = (1, end - 5, 14000.0, 140000, "W1A", "K1ABC", "CW", 500.0, True, True, False)
    list(zone.handleInputRows((28000, tick), iter([pd.DataFrame([row], columns=columns)]), Times(0)))
    assert handle.timers == [end * 1000]
    own = (2, end - 4, 14000.0, 140000, "W2A", "K2ABC", "CW", 500.0, True, True, True)
    list(zone.handleInputRows((28000, tick), iter([pd.DataFrame([own], columns=columns)]), Times(0)))
    out = pd.concat(list(zone.handleExpiredTimer((28000, tick), Times((end - 4) * 1000), None)))
    assert sorted(out["rep"]) == ["W1A", "W2A"] and len(handle.held) == 2 and handle.timers[-1] == end * 1000
    assert not list(zone.handleExpiredTimer((28000, tick), Times(end * 1000), None)) and not handle.held


def test_a_crowded_zone_gives_its_spots_once(spark):
    """No pair of spots is made in Python, and what a micro-batch brings is one value of the state."""
    import pandas as pd

    class Held(list):
        appendList = list.extend
        get = list.copy

        def put(self, rows):
            self[:] = rows

    class Handle:
        held = Held()
        getListState = lambda self, name, schema: self.held
        registerTimer = lambda self, at: None

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    zone = states._Zone(S)
    zone.init(Handle())
    rows = [(i, 420 + i % 59, 14000.0, 140000, f"W{i % 9}A", "K1ABC", "CW", 500.0, True, True, i % 3 > 0) for i in range(600)]
    list(zone.handleInputRows((28000, 7), iter([pd.DataFrame(rows, columns=[c.split()[0] for c in states._SPOT.split(", ")])]), Times(0)))
    assert len(zone.held) == 1
    first = pd.concat(zone.handleExpiredTimer((28000, 7), Times(450_000), None))
    second = pd.concat(zone.handleExpiredTimer((28000, 7), Times(479_000), None))
    assert len(first) <= 600 and len(second) == 600
    ready = [set(x.loc[x["ready"], "event_id"]) for x in (first, second)]
    assert ready[0] == {r[0] for r in rows if r[-1] and r[1] <= 450} and ready[1] == {r[0] for r in rows if r[-1] and r[1] > 450}
    assert not list(zone.handleExpiredTimer((28000, 7), Times(479_500), None))


def test_spots_at_the_edges_of_spans(spark, tmp_path, monkeypatch):
    from dataclasses import replace

    monkeypatch.setattr(states, "SPAN", 2, raising=False)
    s, rows = replace(S, window=20), [r for r in inputs(4) if r[6] != "FT8"]
    parts = [*shuffled_parts(rows, 3, 40), [(10**6, 2000, 14000.0, "W1END", "K0END", 9, "CW")], [(10**6 + 1, 4000, 14000.0, "W1END", "K0END", 9, "CW")]]
    states.consensus(stream_of(spark, tmp_path, parts, SPOT), s, str(tmp_path / "out"), str(tmp_path / "progress"), lateness="60 seconds")
    columns = ("event_id", "winner", "winner_support", "runner_up_support", "subject_support", "total", "conf", "distance", "reason")
    got = spark.read.parquet(str(tmp_path / "out")).where("event_id < 1000000").select(*columns)
    want = correction.decide(correction.tallies(correction.votes(spark.createDataFrame(rows, SPOT), s)), s).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(rows)
