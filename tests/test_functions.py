import pytest
from pyspark.sql import functions as F

from ionolake.functions import distance, radio
from ionolake.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want, valid", [("W6.UT5UF", "W6/UT5UF", True), ("K1ABC/", "K1ABC", True), ("KWS/NM", "KWS/NM", False), ("JA1CTC.P", "JA1CTC/P", True), ("ABC/DEF", "ABC/DEF", False)])
def test_calls(spark, raw, want, valid):
    assert one(spark, radio.normal_call(F.lit(raw))) == want and one(spark, radio.valid_call(F.lit(raw))) == valid


def test_small_functions(spark):
    cases = [
        (radio.skimmer_call(F.lit("K1ABC")), "K1ABC-#"), (radio.skimmer_call(F.lit("K1ABC-1")), "K1ABC-1"), (radio.skimmer_call(F.lit("AB2CDEFGHI")), "AB2CDEFGHI"), (radio.collapse_ssid(F.lit("W3LPL-1-#")), "W3LPL-#"),
        (radio.base_call(F.lit("VE3/K1ABC/P")), "K1ABC"), (radio.base_call(F.lit("W3LPL-1-#")), "W3LPL"), (radio.prefix_call(F.lit("k1abc/M ")), "K1ABC"), (radio.half_up_tenth(F.lit(14.25)), 14.3), (radio.band(F.lit(14350.0)), "20m"),
        (radio.band(F.lit(1.0)), "???"), (radio.report_band(F.lit(1799.9)), "LF"), (radio.band_label(F.lit("20 Meters")), "20m"), (radio.band_label(F.lit("40")), "40m"), (radio.band_label(F.lit("70 centimetres")), "70cm"),
        (radio.final_mode(F.lit(""), F.lit(144350.0)), "USB"), (radio.final_mode(F.lit("SSB"), F.lit(7000.0)), "LSB"), (radio.final_mode(F.lit("SSB"), F.lit(14074.0)), "USB"), (radio.grid_label(F.lit("fn20aa")), "FN20"), (radio.zone_label(F.lit(0)), "??"),
        (radio.report_text(F.lit("CW"), F.lit(23)), "CW 23 dB"), (radio.report_text(F.lit("FT8"), F.lit(0)), "FT8 +0 dB"), (radio.report_text(F.lit("LSB"), F.lit(-3)), "LSB -3 dB"), (radio.normal_glyph(F.lit("76%")), "V"), (radio.normal_glyph(F.lit("")), "?"),
        (radio.sanitize(F.lit("a\tb\n c é")), "a b c ?"), (radio.sanitize(F.lit("a  b")), "a  b"), (radio.percent(F.lit(1), F.lit(0)), 0.0), (radio.snr(F.lit("up -7 dB")), -7),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [row[i] for i in range(len(cases))] == [w for _, w in cases]


def test_fixed_line(spark):
    for call, comment in (("K1ABC", "x" * 80), ("VERYLONGSPOTTERCALL", "a\tb\nc"), ("W1AW", "")):
        line = one(spark, radio.fixed_line(F.lit(call), F.lit(14074.0), F.lit("DX1ABCDEFGHIJKLMNOP"), F.lit("FT8"), F.lit(-5), F.lit(comment), F.lit("fn20"), F.lit("V"), F.lit("0454")))
        assert len(line) == 78 and line.endswith("FN20 V 0454Z") and line[65] == " " and line[:25].endswith("14074.0") and line[39:].startswith("FT8 -5 dB")


def test_keyed_distances_read_their_rows_once(spark, tmp_path):
    rows = [("CW", "E1A", "H1A"), ("RTTY", "K1AB6C", "K1A86C"), ("SSB", "E1A", "H1A"), ("CW", None, "H1A"), ("RTTY", "E1A", None), (None, "E1A", "H1A")] * 3
    spark.createDataFrame(rows, "mode string, a string, b string").write.parquet(str(tmp_path / "t"))
    t = distance.with_distance(spark.read.parquet(str(tmp_path / "t")), "a", "b", "mode")
    models = {"CW": "morse", "RTTY": "baudot"}
    want = [(m, a, b, None if a is None or b is None else distance.call_distance(a, b, models.get(m, "plain"))) for m, a, b in rows]
    assert sorted(map(repr, (tuple(r) for r in t.collect()))) == sorted(map(repr, want))
    plan = t._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1 and "Join" not in plan.toString()


def test_distances(spark):
    d = distance.call_distance
    assert d("E1A", "H1A", "morse") == 2 and d("E1A", "H1A") == 1 and d("K1ABC", "K1A8C") == 1 and d("K1AB6C", "K1A86C", "baudot") > d("K1AB6C", "K1A86C")
    assert [(d(a, b, "morse"), d(a, b, "baudot")) for a, b in (("K1ABC", "K1A8C"), ("N2JP", "N2JPR"), ("K4VSU", "K4VSV"), ("W1AW", "W1AJ"), ("S50", "H50"))] == [(1, 2), (1, 1), (1, 2), (1, 1), (1, 2)]
    chars = list(distance.MORSE)
    pairs = [(a, b) for i, a in enumerate(chars) for b in chars[:i]]
    assert [sum(distance.code_cost("morse", a, b) == k for a, b in pairs) for k in (1, 2, 3, 4)] == [303, 329, 33, 1]
    assert [sum(distance.code_cost("baudot", a, b) == k for a, b in pairs) for k in (1, 2, 3)] == [170, 464, 32]
    t = spark.createDataFrame([("E1A", "H1A", "CW"), ("E1A", "H1A", "SSB"), (None, "H1A", "CW")], "a string, b string, mode string")
    assert sorted((r["mode"], r["distance"]) for r in distance.with_distance(t, "a", "b", "mode").collect() if r["a"]) == [("CW", 2), ("SSB", 1)]


LINES = [
    ("DX de OK2XA: 144174.0 G4TRA IO80AB<MS>JN89 MSK144 +3 dB 1800Z", {"mode": "MSK144", "report": 3, "hhmm": "1800", "dx_call": "G4TRA", "comment": "IO80AB<MS>JN89"}),
    ("DX de N5AA: 21024.7 ZL2BB TX 2201Z", {"report": None, "comment": "TX", "dx_call": "ZL2BB"}),
    ("DX de VE7QQ: 28444.0 VE7QQ Spring 10-Band Sprint 0907Z", {"comment": "Spring 10-Band Sprint"}),
    ("DX de SM3TT: 50313.0 9A1CC MSK144 +11 dB LOUD 0631Z", {"mode": "MSK144", "report": 11, "comment": "LOUD"}),
    ("DX de PY2ZZ: 7074.0 LU4DD FT8 -17dB from FF92 1140Hz 0102Z", {"mode": "FT8", "report": -17, "comment": "from FF92 1140Hz"}),
    ("DX de HA5KK: 144360.0 YO2LL MSK144 +1 dB 0633Z", {"report": 1, "comment": ""}),
    ("DX de I5WW: 144360.0 OE3MM MSK144 +8 dB RIG", {"report": 8, "comment": "RIG", "hhmm": None}),
    ("DX de F6YY: 144360.0 EA3GG MSK144 RIG", {"report": None}),
    ("DX de MM0AB: 28471.5 MM0AB USB Spring 10m Sprint 1322ZIO86 1322Z", {"hhmm": "1322", "mode": "USB", "comment": "Spring 10m Sprint IO86"}),
    ("DX de CT1EE: 14074.0 DK7EASTER FT8 -9 db SES EGG AWARD 1133Z", {"mode": "FT8", "report": -9}),
    ("DX de 7N1PRD-#:1295210.4 K1ABC CW 14 dB 25 WPM CQ 1133Z", {"de_call": "7N1PRD-#", "khz": 1295210.4, "comment": "25 WPM CQ"}),
]


@pytest.mark.parametrize("line, want", LINES)
def test_feed_line(line, want):
    got = feeds.parse_line(line)
    assert {k: got[k] for k in want} == want


def test_feed_lines_that_are_no_spots():
    assert all(feeds.parse_line(x) is None for x in ("", "WWV de K1ABC 14000", "DX de K1ABC: nothing here", "DX de"))


def test_feed_frame(spark):
    t = spark.createDataFrame([(x,) for x, _ in LINES] + [(None,), ("",)], "value string")
    rows = feeds.parse_lines(t, F.lit("2025-12-04 00:30:00").cast("timestamp"), minimal=True).collect()
    assert len(rows) == len(LINES) and all(r["is_human"] and r["source_type"] == "UPSTREAM" for r in rows)
    late = [r for r in rows if r["dx_call"] == "G4TRA"][0]
    assert str(late["ts"]) == "2025-12-03 18:00:00" and [r["mode"] for r in rows if r["dx_call"] == "VE7QQ"] == ["USB"] and {r["source_node"] for r in rows} == {"UPSTREAM"}


def test_reference_files(spark, tmp_path):
    (tmp_path / "skew.csv").write_text("callsign,skew,spots,factor\n# c\nW3LPL,1.2,900,1.000012\nK1A,0,5,1.00001\nK2B,0,900,1\n\n")
    assert [tuple(r) for r in feeds.read_skew(spark, str(tmp_path / "skew.csv"), 10).collect()] == [("W3LPL", 1.2, 900, 1.000012)]
    lines = spark.createDataFrame([("K1A 1.5", 1), ("K1A 0.4", 2), ("# x", 3), ("K2B bad", 4), ("K3C -1", 5)], "value string, line_no long")
    assert {r["call"]: r["weight"] for r in feeds.read_reliability(lines).collect()} == {"K1A": 0.4, "K3C": 0.0}
    priors = spark.createDataFrame([("K1A 2",), ("K1A 3 14000.4",), ("K1A 1",), ("K2B 0",)], "value string")
    assert {(r["call"], r["bin"]): r["score"] for r in feeds.read_priors(priors).collect()} == {("K1A", -1): 3, ("K1A", 14000): 3}
    busted = spark.createDataFrame([("04-Dec 1830Z K1A8C 14025.1 K1ABC 17 W3LPL CW",), ("04-Dec 1831Z K1A8C 14025.1 K1ABC P W3LPL CW",), ("junk",), ("99-Dec 1831Z A 1 B 1 C D",)], "value string")
    assert [(r["bad"], r["correct"], r["band"]) for r in feeds.read_busted(busted, 2025).orderBy("ts").collect()] == [("K1A8C", "K1ABC", "20m"), ("K1A8C", "K1ABC P", "20m")]
    marked = spark.createDataFrame([("04-Dec 1830Z K1A8C 14025.1 x ? K1ABC W3LPL",), ("no mark at all here six seven",)], "value string")
    assert [tuple(r) for r in feeds.read_marked(marked).collect()] == [("K1A8C", 14025.1, "K1ABC")]
    logs = spark.createDataFrame([('t {"decision":"applied","subject":"A","winner":"B"}',), ('t {"decision":"applied","sub',), ("x",)], "value string")
    assert [r["winner"] for r in feeds.read_decisions(logs).collect()] == ["B"]
    import plistlib

    (tmp_path / "p.plist").write_bytes(plistlib.dumps({"k1": {"Country": "US", "ADIF": 291, "CQZone": 5, "ITUZone": 8, "Continent": "NA"}}))
    assert [tuple(r) for r in feeds.read_prefixes(spark, str(tmp_path / "p.plist")).collect()] == [("K1", "US", "NA", 5, 8, 291)]
    assert feeds.generate(spark, 10).select("mode").distinct().count() == 5


def test_more_files(spark, tmp_path):
    from ionolake.sources import sinks

    (tmp_path / "skew.csv").write_text("W3LPL,1.2,900,1.000012\nK1A,0,5,1\n")
    sinks.refresh_skew(spark, str(tmp_path / "skew.csv"), str(tmp_path / "skew.json"))
    lines = [x for f in (tmp_path / "skew.json").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == ["[", '  {"callsign":"W3LPL","skew_hz":1.2,"spots":900,"correction_factor":1.000012}', "]"]
    (tmp_path / "one.json").write_text('[{"callsign": "w3lpl", "skew_hz": 1.2, "spots": 9, "correction_factor": 1.1}, {"callsign": "K1A", "skew_hz": 0, "spots": 1, "correction_factor": 1.0}]')
    assert [tuple(r) for r in feeds.read_skew_json(spark, str(tmp_path / "one.json")).collect()] == [("W3LPL", 1.2, 9, 1.1)]
    (tmp_path / "contests.txt").write_text("# list\n2025-12-06\n2025-12-06\nnone\n2025-11-29\n")
    assert {str(r["date"]) for r in feeds.read_contest_dates(spark, str(tmp_path / "contests.txt")).collect()} == {"2025-12-06", "2025-11-29"}
    t = spark.createDataFrame([("DX de W3LPL-2-#: 14074.1  K1ABC FT8 -3 dB", 1), ("DX de W3LPL-#: 7047.5  ea1zz FT4 +5 dB", 2), ("DX de K2XX-#: 7047.5  EA1ZZ FT4 +5 dB", 3), ("DX de W3LPL-#: 7047.5  EA1ZZ CW 5 dB", 4)], "value string, ts int").withColumn("ts", F.timestamp_seconds("ts"))
    got = feeds.aggregate_feed(t, "W3LPL-#")
    assert [(r["freq_khz"], r["dx_call"], r["report"]) for r in got.orderBy("ts").collect()] == [(14074.1, "K1ABC", -3), (7047.5, "EA1ZZ", 5)]
    sinks.append_aggregate(got, str(tmp_path / "agg"))
    assert sinks.recent_aggregate(spark, str(tmp_path / "agg"), "1970-01-01 00:15:01").count() == 1
    assert feeds.topics(["ft8", " "]) == ["pskr/filter/v2/+/FT8/#"] and feeds.topics([]) == ["pskr/filter/v2/+/+/#"]


def test_history_ids_go_on(spark, tmp_path):
    from ionolake.sources import sinks

    path = str(tmp_path / "history")
    sinks.append_history(spark.createDataFrame([(7, 100), (8, 50), (9, 9000)], "event_id long, t long"), path)
    sinks.append_history(spark.createDataFrame([(1, 9100), (2, 20000)], "event_id long, t long"), path)
    assert [(r["spot_id"], r["event_id"]) for r in spark.read.parquet(path).orderBy("spot_id").collect()] == [(1, 8), (2, 7), (3, 9), (4, 1), (5, 2)]


def test_skewed_messages_and_sql_distance(spark):
    m = spark.createDataFrame([('{"f": 14000000, "md": "CW", "t": 1764850000, "sc": "K1ABC", "rc": "W3LPL"}',), ('{"f": 14000000, "md": "FT8", "t": 1764850000, "sc": "K1ABC", "rc": "W3LPL"}',)], "value string")
    rows = feeds.parse_psk(m, F.lit("2025-12-04 12:30:00").cast("timestamp"), spark.createDataFrame([("W3LPL-#", 1.0001)], "call string, factor double")).collect()
    assert {r["mode"]: r["freq_khz"] for r in rows} == {"CW": 14001.4, "FT8": 14000.0}
    distance.register(spark)
    assert [r["d"] for r in spark.sql("select call_distance(a, b, m) as d from values ('E1A', 'H1A', 'morse'), ('E1A', 'H1A', 'plain'), (null, 'x', 'plain') t(a, b, m)").collect()] == [2, 1, None]
    assert distance.code_cost("morse", "E", "H", distance.Weights(scale=4)) > distance.code_cost("morse", "E", "H")
