"""Scalar functions over spots as Column expressions; no Python code runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Band, lowest and highest kHz (both inside).
BANDS: tuple[tuple[str, float, float], ...] = (
    ("2200m", 135.7, 137.8), ("630m", 472.0, 479.0), ("160m", 1800.0, 2000.0), ("80m", 3500.0, 4000.0), ("60m", 5330.0, 5405.0), ("40m", 7000.0, 7300.0), ("30m", 10100.0, 10150.0),
    ("20m", 14000.0, 14350.0), ("17m", 18068.0, 18168.0), ("15m", 21000.0, 21450.0), ("12m", 24890.0, 24990.0), ("10m", 28000.0, 29700.0), ("6m", 50000.0, 54000.0), ("2m", 144000.0, 148000.0),
    ("1.25m", 222000.0, 225000.0), ("70cm", 420000.0, 450000.0), ("33cm", 902000.0, 928000.0), ("23cm", 1240000.0, 1300000.0), ("13cm", 2300000.0, 2310000.0),
)
#: Band names of the daily report, each with the kHz it ends before.
REPORT_BANDS: tuple[tuple[str, float], ...] = (("LF", 1800.0), ("160m", 2000.0), ("80m", 4000.0), ("40m", 8000.0), ("30m", 11000.0), ("20m", 15000.0), ("17m", 19000.0), ("15m", 22000.0), ("12m", 25000.0), ("10m", 30000.0))
#: Fixed values.
MODES = ("CW", "FT4", "FT8", "LSB", "USB", "RTTY", "MSK144")
CONTINENTS = ("AF", "AN", "AS", "EU", "NA", "OC", "SA")
GLYPHS = ("?", "S", "C", "P", "V", "B")
BEACON_WORDS = ("NCDXF", "BEACON")
VALID_CALL = "^[A-Z0-9]+(?:[/-][A-Z0-9#]+)*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up_tenth(khz: Column | str) -> Column:
    """kHz rounded half up to 0.1."""
    return F.floor(_c(khz) * 10 + F.lit(0.5)).cast("double") / 10


def bucket(khz: Column | str) -> Column:
    """The 0.1 kHz bucket of a frequency."""
    return F.floor(_c(khz) * 10 + F.lit(0.5)).cast("long")


def to_hz(khz: Column | str) -> Column:
    return F.floor(_c(khz) * 1000 + F.lit(0.5)).cast("long")


def freq_bin(khz: Column | str, bin_hz: int) -> Column:
    """The bin of a frequency for call quality; -1 (the bin of all frequencies) without a positive one."""
    x = _c(khz)
    return F.when(x > 0, F.floor(to_hz(x) / bin_hz).cast("long")).otherwise(F.lit(-1).cast("long"))


def band(khz: Column | str) -> Column:
    """The band of a frequency, ??? outside all."""
    x = _c(khz)
    return F.coalesce(*[F.when(x.between(lo, hi), F.lit(name)) for name, lo, hi in BANDS], F.lit("???"))


def report_band(khz: Column | str) -> Column:
    """The coarser band of the daily report: every frequency is in one."""
    x = _c(khz)
    return F.coalesce(*[F.when(x < end, F.lit(name)) for name, end in REPORT_BANDS], F.lit("6m+"))


def band_label(label: Column | str) -> Column:
    """A band as people write it (20 Meters, 70 CM, 20) as its name."""
    x = F.lower(F.trim(_c(label)))
    x = F.regexp_replace(F.regexp_replace(x, "met(er|re)s?", "m"), "centim", "cm")
    x = F.regexp_replace(x, " ", "")
    return F.when(x.rlike("[0-9]$"), F.concat(x, F.lit("m"))).otherwise(x)


def normal_call(call: Column | str) -> Column:
    """Upper case, dots as slashes, without one slash at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.trim(_c(call))), r"\.", "/"), "/$", ""))


def valid_call(call: Column | str) -> Column:
    x = normal_call(call)
    return F.length(x).between(3, 10) & x.rlike("[0-9]") & x.rlike(VALID_CALL)


def collapse_ssid(call: Column | str) -> Column:
    """W3LPL-1-# as W3LPL-#."""
    return F.regexp_replace(_c(call), "^(.*)-[^-]*-#$", "$1-#")


def base_call(call: Column | str) -> Column:
    """The call that a licence is issued for: without -#, the longest part between slashes that has a digit (the first of equal ones; the first part if none has), up to its first dash."""
    parts = F.split(F.regexp_replace(normal_call(call), "-#$", ""), "/")
    ranked = F.transform(parts, lambda p, i: F.struct(F.when(p.rlike("[0-9]"), -F.length(p)).otherwise(1).alias("rank"), i.alias("i"), p.alias("p")))
    best = F.array_min(ranked)["p"]
    return F.regexp_replace(best, "^(.+?)-.*$", "$1")


def prefix_call(call: Column | str) -> Column:
    """A call for the prefix look-up: without a portable suffix."""
    return F.regexp_replace(F.upper(F.trim(_c(call))), "/(QRP|P|M|MM|AM)$", "")


def skimmer_call(call: Column | str) -> Column:
    """A reporter of an automatic feed: -# added if it has no dash and stays within ten characters."""
    x = _c(call)
    return F.when(~x.contains("-") & (F.length(x) + 2 <= 10), F.concat(x, F.lit("-#"))).otherwise(x)


def snr(comment: Column | str) -> Column:
    """The first number before dB in a comment; null without."""
    return F.regexp_extract(_c(comment), r"([-+]?\d{1,3})\s*[dD][bB]", 1).try_cast("int")


def is_beacon(call: Column | str, comment: Column | str) -> Column:
    c = F.upper(F.coalesce(_c(comment), F.lit("")))
    out = F.upper(_c(call)).endswith("/B")
    for w in BEACON_WORDS:
        out = out | c.contains(w)
    return out


def final_mode(mode: Column | str, khz: Column | str, allotted: Column | str | None = None) -> Column:
    """SSB by its sideband, a blank mode by the allotment of its frequency, else by 10 MHz: USB above, CW below."""
    m, f = F.upper(F.trim(F.coalesce(_c(mode), F.lit("")))), _c(khz)
    side = F.when(f >= 10000, F.lit("USB")).otherwise("LSB")
    blank = F.when(f >= 10000, F.lit("USB")).otherwise("CW")
    if allotted is not None:
        a = _c(allotted)
        blank = F.coalesce(F.when(a == "SSB", side).otherwise(a), blank)
    return F.when(m == "SSB", side).when(m == "", blank).otherwise(m)


def source_type(mode: Column | str, port: Column | str | None = None) -> Column:
    m = F.upper(_c(mode))
    out = F.when(m.isin("FT8", "FT4"), m)
    if port is not None:
        out = out.when(_c(port) == 7001, F.lit("RBN-DIGITAL"))
    return out.otherwise("RBN")


def sanitize(comment: Column | str) -> Column:
    """Printable ASCII only: white space runs become one space, other control characters go, other characters become ?; a comment of printable ASCII stays as it is."""
    x = _c(comment)
    clean = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"[\x00-\x1F\x7F]", "")
    return F.when(x.rlike(r"^[\x20-\x7E]*$"), x).otherwise(F.trim(F.regexp_replace(clean, r"[^\x20-\x7E]", "?")))


def grid_label(grid: Column | str) -> Column:
    return F.substring(F.upper(F.trim(F.coalesce(_c(grid), F.lit("")))), 1, 4)


def grid_field(grid: Column | str) -> Column:
    """The first two characters of a grid; blank for a shorter one."""
    x = F.upper(F.trim(F.coalesce(_c(grid), F.lit(""))))
    return F.when(F.length(x) >= 2, F.substring(x, 1, 2)).otherwise("")


def zone_label(zone: Column | str) -> Column:
    z = _c(zone)
    return F.when(z > 0, F.lpad(z.cast("string"), 2, "0")).otherwise("??")


def percent(part: Column | str, whole: Column | str) -> Column:
    """part of whole in percent; 0 for an empty whole."""
    return F.when(_c(whole) > 0, _c(part).cast("double") * 100 / _c(whole)).otherwise(F.lit(0.0))


def confidence_glyph(share: Column | str, reporters: Column | str, known: Column | str) -> Column:
    """From the percentage of reporters that agree; a single report counts by whether its call is known."""
    return F.when(_c(reporters) <= 1, F.when(_c(known), F.lit("S")).otherwise("?")).when(_c(share) >= 51, "V").when(_c(share) >= 25, "P").otherwise("?")


def normal_glyph(glyph: Column | str) -> Column:
    """A confidence as a glyph: numbers by bounds (to 25 ?, to 75 P, above V), blank as ?."""
    x = F.upper(F.trim(F.coalesce(_c(glyph), F.lit(""))))
    n = F.regexp_replace(x, "%$", "").try_cast("int")
    return F.when(x == "", F.lit("?")).when(x.isin(*GLYPHS), x).when(n <= 25, "?").when(n <= 75, "P").when(n > 75, "V").otherwise(x)


def report_text(mode: Column | str, report: Column | str) -> Column:
    """Mode and report as the line has them: a plus sign except for CW and RTTY; no report, mode only."""
    m, r = _c(mode), _c(report)
    sign = F.when(~F.upper(m).isin("CW", "RTTY") & (r >= 0), F.lit("+")).otherwise("")
    return F.when(r.isNull(), m).otherwise(F.concat(m, F.lit(" "), sign, r.cast("string"), F.lit(" dB")))


def fixed_line(de: Column | str, khz: Column | str, dx: Column | str, mode: Column | str, report: Column | str, comment: Column | str, grid: Column | str, glyph: Column | str, hhmm: Column | str) -> Column:
    """The line of 78 characters: frequency ends at column 25, mode begins at 40, grid at 67, glyph at 72, time at 74."""
    freq = F.format_string("%.1f", half_up_tenth(khz))
    start = F.concat(F.lit("DX de "), F.substring(_c(de), F.lit(1), F.greatest(F.lit(1), F.lit(18) - F.length(freq))), F.lit(":"))
    left = F.concat(start, F.lpad(freq, F.lit(25) - F.length(start), F.lit(" ")), F.lit("  "))
    left = F.rpad(F.concat(left, F.substring(_c(dx), F.lit(1), F.lit(39) - F.length(left))), 39, " ")
    body = F.concat(left, report_text(mode, report))
    note = F.trim(sanitize(F.coalesce(_c(comment), F.lit(""))))
    body = F.when(note == "", body).otherwise(F.concat(body, F.lit(" "), note))
    return F.concat(F.rpad(F.substring(body, 1, 65), 66, " "), F.rpad(grid_label(grid), 4, " "), F.lit(" "), F.rpad(F.substring(F.trim(F.coalesce(_c(glyph), F.lit(""))), 1, 1), 1, " "), F.lit(" "), _c(hhmm), F.lit("Z"))


def edit_distance(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(_c(a), _c(b)).cast("long")


def is_spot(dx: Column | str, de: Column | str, khz: Column | str, mode: Column | str) -> Column:
    """Both calls and the mode are there, and the frequency is from 100 kHz to 3 GHz."""
    filled = lambda x: F.trim(F.coalesce(_c(x), F.lit(""))) != ""
    return filled(dx) & filled(de) & filled(mode) & F.coalesce(_c(khz).between(100, 3_000_000), F.lit(False))


def spot_text(de: Column | str, khz: Column | str, dx: Column | str, mode: Column | str) -> Column:
    """A spot in a few words, for logs."""
    return F.format_string("%s on %.1f kHz (%s) by %s", _c(dx), _c(khz), _c(mode), _c(de))
