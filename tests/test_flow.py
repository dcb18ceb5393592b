import random

import pytest
from pyspark.sql import functions as F

from ionolake.operators import correction, lookups
from ionolake.plans import pipeline, report
from ionolake.sources import feeds, sinks

SCHEMA = "event_id long, t long, freq_khz double, de_call string, dx_call string, report int, mode string, comment string"
PREFIXES = [("K", "US", "NA", 5, 8, 291), ("W", "US", "NA", 4, 7, 291), ("G", "England", "EU", 14, 27, 223)]


def test_every_step_of_the_pipeline(spark):
    now, khz = 100_000, 14025.0
    rows = [(i, now - 60, khz, f"W{i}AA", "K1ABC", 20, "CW", "CQ") for i in range(1, 6)]
    rows += [
        (10, now - 50, khz, "G4ZZ", "K1A8C", 20, "CW", "CQ"),  # corrected
        (11, now - 9000, khz, "W1AA", "K9OLD", 20, "CW", "CQ"),  # stale
        (12, now - 9000, khz, "W1AA", "K9OLD/B", 20, "CW", "BEACON"),  # stale, but a beacon
        (13, now - 49, khz + 0.2, "G4ZZ", "K1A8C", 10, "CW", "CQ"),  # weaker copy of 10 within its minute
        (14, now - 48, 2 * khz, "W1AA", "K1ABC", 2, "CW", "CQ"),  # second harmonic
        (15, now - 47, 21000.0, "W9NO", "G3XYZ", 5, "FT8", "CQ"),  # reporter without a licence
        (16, now - 46, 21000.0, "G4ZZ", "G3XYZ", 5, "FT8", "CQ"),
        (17, now - 45, 21000.4, "G5YY", "G3XYZ", 4, "FT8", "CQ"),  # same country, zone and call as 16: second duplicate
        (18, now - 44, khz + 0.3, "W2AA", "K1ABC", 30, "CW", "CQ"),  # averaged to the others
    ]
    t = spark.createDataFrame(rows, SCHEMA)
    calls = lambda *c: spark.createDataFrame([(x,) for x in c], "call string")
    p = pipeline.Plan(settings=correction.Settings(window=120, min_reports=4), prefixes=spark.createDataFrame(PREFIXES, "prefix string, country string, continent string, cq_zone int, itu_zone int, adif int"), known=calls("K1ABC"), licensed=calls(*(f"W{i}AA" for i in range(1, 6))), max_age=600, average_window=120)
    got = {r["event_id"]: r for r in pipeline.judged(t, p, now).collect()}
    assert 11 not in got and 13 not in got and got[12]["confidence"] == "V"
    assert (got[10]["dx_call"], got[10]["confidence"], got[10]["corrected"]) == ("K1ABC", "C", True) and got[1]["confidence"] == "S" and got[16]["confidence"] == ""
    assert {i for i, r in got.items() if r["harmonic"]} == {14} and {i for i, r in got.items() if r["unlicensed"]} == {15}
    assert got[18]["freq_corrected"] and got[18]["freq_khz"] == 14025.0 and got[10]["dx"]["country"] == "US" and got[10]["de"]["cq_zone"] == 14
    out = {r["event_id"]: r for r in pipeline.run(t, p, now).collect()}
    assert {14, 15, 17} & set(out) == set() and {10, 12, 16} <= set(out) and all(len(r["line"]) == 78 for r in out.values())
    assert out[10]["line"].startswith("DX de G4ZZ:") and " K1ABC " in out[10]["line"]
    from ionolake.operators.signals import event_counts

    assert tuple(event_counts(pipeline.judged(t, p, now)).first()) == (1, 1, 1, 1)


def test_metadata_is_refreshed_and_keeps_the_grid(spark):
    p = spark.createDataFrame(PREFIXES, "prefix string, country string, continent string, cq_zone int, itu_zone int, adif int")
    a = lookups.metadata(spark.createDataFrame([("G4AB", ("FN20",)), ("ZZ1A", (None,))], "call string, dx struct<grid:string>"), "call", p, "dx")
    b = lookups.metadata(a.withColumn("call", F.lit("K1ABC")), "call", p, "dx").collect()
    assert {(r["dx"]["country"], r["dx"]["grid"]) for r in b} == {("US", "FN20"), ("US", None)} and a.where("call = 'ZZ1A'").first()["dx"]["country"] is None


def test_daily_report(spark):
    rng = random.Random(1)
    rows = [(i, 60 * i, 14000.0, f"K{i % 9}A", f"K{i % 9}B" if i % 2 else f"K{i % 9}A", 5, 1, 6, 83, i % 3 + 1, "applied" if i % 2 else "rejected", "" if i % 2 else rng.choice(["confidence", "min_reports"])) for i in range(200)]
    d = spark.createDataFrame(rows, "event_id long, t long, freq_khz double, subject string, winner string, winner_support long, subject_support long, total long, conf long, distance long, decision string, reason string")
    ref = spark.createDataFrame([(1, 60, 14000.0, "K1A", "K1B"), (2, 60, 14000.0, "K5A", "K5X")], "row long, t long, freq_khz double, subject string, correct string")
    s = spark.createDataFrame([(60 * i + 5, f"K{i % 9}B", 14000.1) for i in range(200)], "t long, dx_call string, freq_khz double")
    import datetime

    day = datetime.date(2025, 12, 4)
    tables = report.daily(d, ref, s, day, spark.sql("select date'2025-12-04' as date"))
    text = report.text(tables)
    assert any(x.startswith("precision:") for x in text) and tables["contest"].first()["contest"] and tables["summary"].first()["applied"] == 100
    assert [r["n"] for r in tables["reasons"].collect()] == sorted((r["n"] for r in tables["reasons"].collect()), reverse=True)
    assert report.dated("logs/{yyyy}/{mm}-{dd}-{Mon}.txt", day) == "logs/2025/12-04-Dec.txt" and report.distance3(d)["list"].count() == 66 and set(report.reappearances(d)) == {"gaps", "classes"}


def test_delay_to_the_next_refresh():
    import datetime

    now = datetime.datetime(2025, 12, 4, 22, 30, 15)
    assert report.delay_to(now, "22:31").total_seconds() == 45 and report.delay_to(now, " 02:00").total_seconds() == 3.5 * 3600 - 15 and report.delay_to(now.replace(second=0), "22:30").days == 1


def test_calls_merged_from_a_stream(spark, tmp_path):
    schema = "call string, is_known int, grid string, observations long, first_seen long, updated_at long, expires_at long"
    table = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([("A", 0, f"FN{k}0", 1, k, k, None), (f"B{k}", 1, None, 1, k, k, None)], schema).coalesce(1).write.mode("append").parquet(table)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(table)
    sinks.upsert_calls(stream, str(tmp_path / "store"), str(tmp_path / "progress"), once=True).awaitTermination()
    got = {r["call"]: r for r in sinks.newest_calls(spark, str(tmp_path / "store")).collect()}
    assert set(got) == {"A", "B0", "B1", "B2"} and (got["A"]["grid"], got["A"]["observations"]) == ("FN20", 3)
    assert sinks.newest_calls(spark, str(tmp_path / "none")) is None


def test_only_touched_buckets_of_the_call_store_are_written(spark, tmp_path):
    schema = "call string, is_known int, grid string, observations long, first_seen long, updated_at long, expires_at long"
    table, store = tmp_path / "in", tmp_path / "store"

    def files():
        return {str(p.relative_to(store)) for p in store.rglob("part-*.parquet")}

    def run(rows, progress):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(table))
        sinks.upsert_calls(spark.readStream.schema(schema).parquet(str(table)), str(store), str(tmp_path / progress), once=True).awaitTermination()

    run([(f"K{i}A", 0, None, 1, 1, 1, None) for i in range(500)], "p")
    first = files()
    assert len({f.split("/")[0] for f in first}) == 64
    run([("K7A", 0, "FN20", 1, 0, 0, None), ("K8A", 0, "FN30", 2, 5, 5, None)], "p")
    second = files()
    assert 1 <= len(first - second) <= 2 and len(second - first) == len(first - second)
    got = {r["call"]: (r["grid"], r["observations"], r["first_seen"]) for r in sinks.newest_calls(spark, str(store)).collect()}
    assert len(got) == 500 and got["K7A"] == ("FN20", 2, 0) and got["K8A"] == ("FN30", 3, 1)
    # the same micro-batches again, as after a failure: nothing changes
    sinks.upsert_calls(spark.readStream.schema(schema).parquet(str(table)), str(store), str(tmp_path / "again"), once=True).awaitTermination()
    assert files() == second


def test_skew_files_are_read_as_they_are_written(spark, tmp_path):
    import json

    t = spark.createDataFrame([("w3lpl", 1.5, 30, 1.00001), ("K1AA", -2.0, 9, 0.99999), ("N0ONE", 0.0, 5, 1.0)], "call string, skew_hz double, spots long, factor double")
    path = tmp_path / "skew"
    sinks.write_skew_json(t, str(path))
    (part,) = path.glob("part-*")
    assert [r["callsign"] for r in json.loads(part.read_text())] == ["K1AA", "N0ONE", "w3lpl"]
    (tmp_path / "lines.json").write_text('{"callsign": "w3lpl", "skew_hz": 1.5, "spots": 30, "correction_factor": 1.00001}\n{"callsign": "K1AA", "skew_hz": -2.0, "spots": 9, "correction_factor": 0.99999}\n')
    for p in (path, tmp_path / "lines.json"):
        assert {tuple(r) for r in feeds.read_skew_json(spark, str(p)).collect()} == {("W3LPL", 1.5, 30, 1.00001), ("K1AA", -2.0, 9, 0.99999)}
    with pytest.raises(ValueError):
        sinks.write_skew_json(t.limit(0), str(path))


def test_composed_run_with_all_its_tables(spark):
    s = spark.createDataFrame([(i, 100 + i, 14020.0, f"W{i}AA", "K1ABC", 9, "CW", "") for i in range(4)] + [(5, 130, 14020.0, "W8ZZ", "K1ABD", 9, "CW", ""), (6, 131, 14020.0, "W9BAD", "K1ABD", 9, "CW", ""), (7, 600, 7010.0, "W8ZZ", "K9ZZ", 9, "CW", "")], "event_id long, t long, freq_khz double, de_call string, dx_call string, report int, mode string, comment string")
    prefixes = spark.createDataFrame([("K", "US", "NA", 5, 8, 291), ("W", "US", "NA", 4, 7, 291)], "prefix string, country string, continent string, cq_zone int, itu_zone int, adif int")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    plan = pipeline.Plan(settings=correction.Settings(window=60, min_reports=3, min_confidence=60, min_reliability=0.5), prefixes=prefixes, weights=table([("W9BAD", 0.1), ("W9BAD", 0.2)], "call string, weight double"), grids=table([("K1ABC", "FN20"), ("K1ABC", "FN21"), ("W8ZZ", "EN80")], "call string, grid string"), second_window=0)
    judged = pipeline.judged(s, plan)
    got = {r["event_id"]: r for r in judged.collect()}
    assert len(got) == 7 and got[5]["dx_call"] == "K1ABC" == got[6]["dx_call"] and got[5]["confidence"] == "C"
    assert got[6]["dx"]["grid"] == "FN21" and got[7]["de"]["grid"] == "EN80" and got[7]["dx"]["grid"] is None
    updates = {r["call"]: r for r in pipeline.call_updates(judged, table([("K9ZZ",)], "call string")).collect()}
    assert updates["K1ABC"]["grid"] == "FN21" and updates["K1ABC"]["observations"] == 6 and updates["K9ZZ"]["is_known"] == 1 and updates["K9ZZ"]["grid"] is None


def test_large_skew_tables_are_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    import json

    monkeypatch.setattr(sinks, "SKEW_ROWS", 100, raising=False)
    t = spark.range(1000).selectExpr("concat('K', 1000 + id) as call", "id / 2D as skew_hz", "id as spots", "1 + id / 1000000D as factor")
    path = tmp_path / "skew"
    sinks.write_skew_json(t, str(path))
    arrays = [[r["callsign"] for r in json.loads(p.read_text())] for p in sorted(path.glob("part-*"))]
    assert len(arrays) >= 8 and max(map(len, arrays)) <= 300 and sum(arrays, []) == [f"K{1000 + i}" for i in range(1000)]
    got = feeds.read_skew_json(spark, str(path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, t.where("factor <> 1").collect()))
    (tmp_path / "large.json").write_text("[\n" + ",\n".join("  " + json.dumps({"callsign": f"K{i}", "correction_factor": 1.5}) for i in range(3000)) + "\n]\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = feeds.read_skew_json(spark, str(tmp_path / "large.json"))
        assert got.rdd.getNumPartitions() > 4 and {r["call"] for r in got.collect()} == {f"K{i}" for i in range(3000)} and got.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_skew_files_of_all_forms(spark, tmp_path):
    """Entries over several lines as the source's writer indents them, all in one line, and those that can't be cut at braces."""
    import json

    rows = [{"callsign": "w3lpl", "correction_factor": 1.5}, {"callsign": "K1A}B", "correction_factor": 1.25}, {"callsign": "N0ONE", "correction_factor": 1.0}, {"callsign": "K2A", "skew_hz": 2.0, "correction_factor": 0.5, "more": {"a": 1}}]
    for k, (text, want) in enumerate([(json.dumps(rows[::2], indent=2), {"W3LPL"}), (json.dumps(rows[::2]), {"W3LPL"}), (json.dumps(rows), {"W3LPL", "K1A}B", "K2A"}), (json.dumps(rows, indent=2), {"W3LPL", "K1A}B", "K2A"}), ("\n".join(map(json.dumps, rows)) + "\n", {"W3LPL", "K1A}B", "K2A"}), ("[]", set())]):
        (tmp_path / f"{k} x").mkdir()
        (tmp_path / f"{k} x" / "skew file.json").write_text(text)
        (tmp_path / f"{k} x" / "other.json").write_text(json.dumps([{"callsign": "K9Z", "correction_factor": 2.5}]))
        assert sorted(r["call"] for r in feeds.read_skew_json(spark, str(tmp_path / f"{k} x")).collect()) == sorted(want | {"K9Z"}), text
