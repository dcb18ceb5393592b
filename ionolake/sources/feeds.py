"""Feeds and reference files as DataFrames: text lines, JSON messages, prefix and skew tables, logs and generators. Readers take what spark.read or spark.readStream give."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio

#: Mode words of a line and what they mean.
MODE_WORDS = {"CW": "CW", "CWT": "CW", "RTTY": "RTTY", "FT8": "FT8", "FT-8": "FT8", "FT4": "FT4", "FT-4": "FT4", "MSK": "MSK144", "MSK144": "MSK144", "MSK-144": "MSK144", "USB": "USB", "LSB": "LSB", "SSB": "SSB"}
PSK_SCHEMA = "sq long, f long, md string, rp int, t long, sc string, sl string, rc string, rl string, sa int, ra int, b string"
_TIME = re.compile(r"[0-9]{4}Z")
_NUMBER = re.compile(r"[-+]?[0-9]{1,3}")
_CALL = re.compile(radio.VALID_CALL)


def _khz(word: str) -> float | None:
    try:
        f = float(word)
    except ValueError:
        return None
    return f if 100 <= f <= 3_000_000 else None


def _signed(word: str) -> int | None:
    return int(word) if _NUMBER.fullmatch(word) and abs(int(word)) <= 200 else None


def _is_call(word: str) -> bool:
    w = word.strip().upper().replace(".", "/").removesuffix("/")
    return 3 <= len(w) <= 10 and any(c.isdigit() for c in w) and bool(_CALL.match(w))


def parse_line(line: str) -> dict | None:
    """A line of a feed as its parts; None if it isn't a spot. Words are taken left to right, each by the first role it fits: time, frequency, mode or unit, report, call, number."""
    words = [w.strip(",;:!.") for w in line.split()]
    raw = line.split()
    if len(words) < 3 or [w.upper() for w in words[:2]] != ["DX", "DE"]:
        return None
    de, _, glued = raw[2].partition(":")
    got: dict = {"de_call": de if ":" in raw[2] else words[2], "khz": _khz(glued.strip(",;:")), "dx_call": None, "mode": None, "hhmm": None, "report": None}
    if not got["de_call"].strip():
        return None
    rest: list[str | None] = [None] * 3
    number: tuple[int, int] | None = None  # place and value of a number that waits for its unit
    wpm = None
    for word in words[3:]:
        at = len(rest)
        rest.append(None)
        if got["hhmm"] is None and _TIME.match(word):
            got["hhmm"], word = word[:4], word[5:].strip()
            if not word:
                number = None
        if not word:
            continue
        upper = word.upper()
        if got["khz"] is None and _khz(word) is not None:
            got["khz"] = _khz(word)
        elif upper in MODE_WORDS and got["mode"] is None:
            got["mode"] = MODE_WORDS[upper]
        elif upper == "DB":
            if got["report"] is None and number:
                got["report"], rest[number[0]], number = number[1], None, None
        elif upper == "WPM" and wpm is None and number:
            wpm, rest[number[0]], number = words[number[0]], None, None
        elif upper in ("DX", "DE"):
            pass
        elif got["report"] is None and upper.endswith("DB") and _signed(word[:-2]) is not None:
            got["report"] = _signed(word[:-2])
        elif got["khz"] is not None and got["dx_call"] is None and _is_call(word):
            got["dx_call"] = word
        else:
            rest[at] = word
            if number is None and _signed(word) is not None:
                number = (at, _signed(word))
    if got["khz"] is None or got["dx_call"] is None:
        return None
    comment = " ".join(w for w in rest if w and not _TIME.fullmatch(w.upper()))
    for text in (comment, line) if got["report"] is None else ():
        if m := re.search(r"([-+]?[0-9]{1,3})\s*[dD][bB]", text):
            got["report"] = int(m[1])
            break
    got["comment"] = " ".join(x for x in (f"{wpm} WPM" if wpm else "", comment) if x)
    return got


def parse_lines(lines: DataFrame, now: Column | None = None, minimal: bool = False, allotments: DataFrame | None = None, node: str = "") -> DataFrame:
    """Spots of a feed's lines (column value): de_call, dx_call, freq_khz, mode, report, ts, comment, is_human, source_type. The walk over words runs in Arrow batches; the rest is native.
    A line's time of day becomes the moment within 12 hours of now. minimal: lines of people, which pass as they are; their source_node is node, or the source's type where that is blank."""

    @F.pandas_udf("de_call string, khz double, dx_call string, mode string, hhmm string, report int, comment string")
    def parse(values):
        import pandas as pd

        names = ["de_call", "khz", "dx_call", "mode", "hhmm", "report", "comment"]
        rows = [(parse_line(v) or {}) if v else {} for v in values]
        out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)
        return out.astype({"report": "Int32"})

    x = lines.where(F.col("value").startswith("DX de")).select(parse("value").alias("p")).select("p.*").where("dx_call is not null")
    de, dx = radio.normal_call("de_call"), radio.collapse_ssid(radio.normal_call("dx_call"))
    x = x.withColumns({"de_call": de if minimal else radio.collapse_ssid(de), "dx_call": dx, "freq_khz": radio.half_up_tenth("khz")}).where(radio.valid_call("dx_call") & radio.valid_call("de_call"))
    if allotments is not None:
        from ..operators.lookups import allotted_mode

        x = allotted_mode(x, allotments)
    mode = radio.final_mode("mode", "freq_khz", "allotted" if allotments is not None else None)
    at = now if now is not None else F.current_timestamp()
    day = F.unix_timestamp(F.date_trunc("day", at)) + F.substring("hhmm", 1, 2).cast("long") * 3600 + F.substring("hhmm", 3, 2).cast("long") * 60
    gap = day - F.unix_timestamp(at)
    ts = F.coalesce(F.timestamp_seconds(day - F.when(gap > 43200, 86400).when(gap < -43200, -86400).otherwise(0)), at)
    out = x.withColumns({"mode": mode, "ts": ts})
    kind = F.lit("UPSTREAM") if minimal else radio.source_type("mode")
    return out.select("de_call", "dx_call", "freq_khz", "mode", "report", "ts", "comment", F.lit(minimal).alias("is_human"), kind.alias("source_type"), F.when(F.trim(F.lit(node)) != "", F.lit(node)).otherwise(kind).alias("source_node"))


def topics(modes: list[str], root: str = "pskr/filter/v2") -> list[str]:
    """The topics of a message feed that hold these modes' reports; all of them without modes."""
    return [f"{root}/+/{m.strip().upper()}/#" for m in modes if m.strip()] or [f"{root}/+/+/#"]


def parse_psk(messages: DataFrame, now: Column | None = None, skew: DataFrame | None = None) -> DataFrame:
    """Spots of reception-report JSON (column value); malformed, incomplete and badly dated messages drop. skew (call, factor) corrects the frequencies of CW and RTTY."""
    at = F.unix_timestamp(now if now is not None else F.current_timestamp())
    m = messages.select(F.from_json("value", PSK_SCHEMA).alias("m")).where("m is not null").select("m.*")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    ok = ~blank("sc") & ~blank("rc") & ~blank("md") & (F.col("f") != 0) & (F.col("t") != 0) & (at - F.col("t")).between(-3600, 86400)
    dx, de = radio.normal_call("sc"), radio.skimmer_call(radio.normal_call("rc"))
    x = m.where(ok).select(dx.alias("dx_call"), de.alias("de_call"), radio.half_up_tenth(F.col("f") / 1000).alias("freq_khz"), F.upper(F.trim("md")).alias("mode"), F.col("rp").alias("report"), F.timestamp_seconds("t").alias("ts"), F.concat(F.coalesce("sl", F.lit("")), F.lit(">"), F.coalesce("rl", F.lit(""))).alias("comment"), F.lit(False).alias("is_human"), F.lit("PSKREPORTER").alias("source_type"))
    x = x.where(radio.valid_call("dx_call") & radio.valid_call("de_call"))
    if skew is None:
        return x
    from ..operators.lookups import apply_skew

    keyed = F.col("mode").isin("CW", "RTTY")
    return apply_skew(x.where(keyed), skew).unionByName(x.where(~keyed))


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """prefix, country, continent, cq_zone, itu_zone, adif of a prefix property list, a small reference file."""
    import plistlib

    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    rows = [(k.strip().upper(), v.get("Country"), v.get("Continent"), int(v.get("CQZone", 0)), int(v.get("ITUZone", 0)), int(v.get("ADIF", 0))) for k, v in plistlib.loads(raw).items()]
    return spark.createDataFrame(rows, "prefix string, country string, continent string, cq_zone int, itu_zone int, adif int")


def read_skew(spark: SparkSession, path: str, min_spots: int = 0) -> DataFrame:
    """call, skew_hz, spots, factor of a skew CSV; comments, headers, blank lines, factor 1 and rarely seen skimmers drop. A row of fewer than four columns is an error."""
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(#.*|callsign.*|)$"))
    p = F.split("value", ",")
    checked = lines.select(F.when(F.size(p) < 4, F.raise_error(F.concat(F.lit("bad skew row: "), F.col("value"))).cast("array<string>")).otherwise(p).alias("p"))
    x = checked.select(F.upper(F.trim(F.col("p")[0])).alias("call"), F.col("p")[1].try_cast("double").alias("skew_hz"), F.col("p")[2].try_cast("long").alias("spots"), F.col("p")[3].try_cast("double").alias("factor"))
    return x.where((F.col("factor") != 1) & (F.col("spots") >= min_spots))


def read_skew_json(spark: SparkSession, path: str) -> DataFrame:
    """call, skew_hz, spots, factor of skew files, JSON arrays or JSON lines; factors of 1 drop. Entries are flat, so files are cut at closing braces, wherever their lines end, and read by many tasks. A file where that doesn't give whole entries (a brace in
    a name, a nested field) is read in one piece; which these are takes a pass over all."""
    one = "callsign:string,skew_hz:double,spots:bigint,correction_factor:double"
    piece = F.regexp_replace("value", r"^[\s,\[\]]+", "")
    entry = F.from_json(F.concat(piece, F.lit("}")), f"struct<{one},_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    x = spark.read.text(path, lineSep="}").where(piece != "").select(F.col("_metadata.file_path").alias("_file"), entry.alias("x")).select("_file", "x.*")
    odd = [r["_file"] for r in x.where("_bad is not null").select("_file").distinct().collect()]  # names of files
    if odd:
        text = F.trim("value")
        lines = F.transform(F.filter(F.split(text, "\\R"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{one}>"))
        rows = F.when(text.startswith("["), F.from_json(text, f"array<struct<{one}>>")).otherwise(lines)
        whole = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path").isin(odd)).select(F.explode(rows).alias("x")).select("x.*")
        x = x.where(~F.col("_file").isin(odd)).drop("_file", "_bad").unionByName(whole)
    return x.select(F.upper(F.trim("callsign")).alias("call"), "skew_hz", "spots", F.col("correction_factor").alias("factor")).where("call is not null and factor <> 1")


def read_contest_dates(spark: SparkSession, path: str) -> DataFrame:
    """date: the distinct dates of a list, one a line; comments and what is no date drop."""
    day = F.try_to_date(F.trim("value"), "yyyy-MM-dd")
    return spark.read.text(path).select(day.alias("date")).where("date is not null").distinct()


def read_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of a feed's text lines (column value), for parse_lines(). Spark runs the connection and its restarts."""
    x = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return x.where(F.col("value").startswith("DX de"))


def aggregate_feed(lines: DataFrame, reporter: str, now: Column | None = None) -> DataFrame:
    """freq_khz, dx_call, report, ts of one reporter's FT4 and FT8 lines (columns value and ts, now if absent)."""
    at = F.col("ts") if "ts" in lines.columns else (now if now is not None else F.current_timestamp())
    line = r"^DX de ([^\s:]+):\s*([0-9]+(?:\.[0-9]+)?)\s+(\S+)\s+(FT[48])\s+([-+]?[0-9]+)"
    part = lambda k: F.regexp_extract("value", line, k)
    x = lines.select(part(1).alias("de_call"), part(2).try_cast("double").alias("freq_khz"), F.upper(part(3)).alias("dx_call"), part(5).try_cast("int").alias("report"), at.alias("ts"))
    return x.where((radio.collapse_ssid("de_call") == reporter) | (F.regexp_replace("de_call", "-#$", "") == reporter)).select("freq_khz", "dx_call", "report", "ts")


def read_known(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.text(path).select(F.upper(F.trim("value")).alias("call"))
    return x.where("call <> '' and not startswith(call, '#')").distinct()


def read_reliability(lines: DataFrame) -> DataFrame:
    """call, weight (0 to 1) of lines CALL WEIGHT (columns value, line_no); the last of a call holds, bad lines drop."""
    p = F.split(F.trim("value"), r"\s+")
    x = lines.where(~F.trim("value").startswith("#")).select(F.upper(p[0]).alias("call"), F.get(p, F.lit(1)).try_cast("double").alias("w"), "line_no").where("w is not null")
    return x.groupBy("call").agg(F.max_by(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("w"))), "line_no").alias("weight"))


def read_priors(lines: DataFrame, bin_hz: int = 1000) -> DataFrame:
    """call, bin, score of lines CALL SCORE [KHZ]; scores of a call and bin add up, bin -1 is all frequencies."""
    p = F.split(F.trim("value"), r"\s+")
    x = lines.where(~F.trim("value").startswith("#")).select(F.upper(p[0]).alias("call"), F.get(p, F.lit(1)).try_cast("int").alias("s"), F.get(p, F.lit(2)).try_cast("double").alias("khz")).where("s <> 0")
    return x.groupBy("call", radio.freq_bin(F.coalesce("khz", F.lit(0.0)), bin_hz).alias("bin")).agg(F.sum("s").alias("score"))


def read_licences(hd_lines: DataFrame, am_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header (id, status) and amateur (id, call) rows of pipe-separated licence files; short rows drop."""
    h, a = F.split("value", r"\|"), F.split("value", r"\|")
    hd = hd_lines.where(F.size(h) >= 43).select(h[1].alias("id"), F.upper(h[5]).alias("status"))
    return hd, am_lines.where(F.size(a) >= 5).select(a[1].alias("id"), F.upper(F.trim(a[4])).alias("call"))


def read_busted(lines: DataFrame, year: int, min_ts: int | None = None, max_ts: int | None = None) -> DataFrame:
    """ts, bad, correct, freq_khz, band of a reference log: DD-Mon HHMMZ BAD KHZ CORRECT... [SNR] REPORTER MODE."""
    p = F.split(F.trim("value"), r"\s+")
    n = F.size(p)
    tail = F.when((n >= 7) & F.get(p, n - 3).try_cast("int").isNotNull(), n - 3).otherwise(n - 2)
    x = lines.where(n >= 6).select(F.get(p, F.lit(0)).alias("day"), F.get(p, F.lit(1)).alias("hm"), F.upper(F.get(p, F.lit(2))).alias("bad"), F.get(p, F.lit(3)).try_cast("double").alias("freq_khz"), F.upper(F.array_join(F.slice(p, F.lit(5), F.greatest(tail - 4, F.lit(0))), " ")).alias("correct"))
    stamp = F.concat("day", F.lit(f"-{int(year)} "), F.regexp_replace("hm", "Z$", ""))
    x = x.withColumn("ts", F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("dd-MMM-yyyy HHmm")))).where("ts is not null and freq_khz is not null and correct <> ''")
    if min_ts is not None:
        x = x.where(F.col("ts") >= min_ts)
    if max_ts is not None:
        x = x.where(F.col("ts") <= max_ts)
    return x.select("ts", "bad", "correct", "freq_khz", radio.report_band("freq_khz").alias("band"))


def read_marked(lines: DataFrame) -> DataFrame:
    """bad, freq_khz, correct of a log whose correct call stands after a question mark."""
    p = F.split(F.trim("value"), r"\s+")
    at = F.array_position(p, "?")
    return lines.where((at > 0) & (F.size(p) >= 7) & (F.size(p) > at)).select(F.get(p, F.lit(2)).alias("bad"), F.get(p, F.lit(3)).try_cast("double").alias("freq_khz"), F.element_at(p, (at + 1).cast("int")).alias("correct"))


def read_decisions(lines: DataFrame, schema: str = "ts long, subject string, winner string, freq_khz double, decision string") -> DataFrame:
    """Applied decisions written as JSON within log lines; malformed ones drop."""
    x = lines.where(F.col("value").contains('"decision":"applied"')).select(F.from_json(F.expr("substring(value, instr(value, '{'))"), schema).alias("d"))
    return x.where("d.decision is not null").select("d.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """freq_khz, dx_call, ts of a day's history CSV (third, fifth and tenth column after the first); bad rows drop."""
    p = F.split("value", ",")
    x = spark.read.text(path).where(F.size(p) >= 11).select(p[3].try_cast("double").alias("freq_khz"), F.upper(F.trim(p[5])).alias("dx_call"), F.try_to_timestamp(p[10], F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"))
    return x.where("freq_khz is not null and ts is not null")


def generate(spark: SparkSession, n: int, base_khz: float = 14000.0) -> DataFrame:
    """n synthetic spots, all from their number."""
    i = F.col("id")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("FT8", "FT4", "CW", "RTTY", "SSB")]), (i % 5 + 1).cast("int"))
    return spark.range(n).select(i.alias("event_id"), i.alias("t"), F.format_string("DX%05d", i % 100000).alias("dx_call"), F.format_string("DE%05d", i * 7 % 50000).alias("de_call"), (F.lit(base_khz) + (i % 1000).cast("double") / 10).alias("freq_khz"), (i % 30 - 10).alias("report"), mode.alias("mode"))
