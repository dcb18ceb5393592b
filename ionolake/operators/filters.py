"""The subscriber filter: allow and block sets by dimension, commands that change it, and its compilation to one Column predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio

#: Dimension, the column it tests, and whether its values are numbers.
DIMENSIONS: dict[str, tuple[str, bool]] = {
    "BAND": ("band", False), "MODE": ("mode", False), "SOURCE": ("source", False), "DXCONT": ("dx_continent", False), "DECONT": ("de_continent", False), "DXZONE": ("dx_zone", True), "DEZONE": ("de_zone", True),
    "DXDXCC": ("dx_adif", True), "DEDXCC": ("de_adif", True), "DXGRID2": ("dx_grid2", False), "DEGRID2": ("de_grid2", False), "CONFIDENCE": ("confidence", False), "DXCALL": ("dx_call", False), "DECALL": ("de_call", False),
}
PATTERNED = ("DXCALL", "DECALL")
NEW_USER_MODES = frozenset({"CW", "LSB", "USB", "RTTY"})


@dataclass(frozen=True)
class Rule:
    """One dimension: nothing that is blocked passes; where something is allowed, only that; with neither, everything if all is set, else nothing."""

    allow: frozenset = frozenset()
    block: frozenset = frozenset()
    all: bool = True
    block_all: bool = False

    def passed(self, values: frozenset) -> Rule:
        return Rule(self.allow | values, self.block - values, False, False)

    def rejected(self, values: frozenset) -> Rule:
        """Blocked; a dimension whose last allowed value goes is open again."""
        left = self.allow - values
        return Rule(left, self.block | values, self.all or (bool(self.allow) and not left), False)


@dataclass(frozen=True)
class Filter:
    rules: tuple[tuple[str, Rule], ...] = tuple((d, Rule(allow=NEW_USER_MODES, all=False) if d == "MODE" else Rule()) for d in DIMENSIONS)
    beacons: bool | None = None
    call: str = ""

    def rule(self, dimension: str) -> Rule:
        return dict(self.rules)[dimension]

    def with_rule(self, dimension: str, rule: Rule) -> Filter:
        return replace(self, rules=tuple((d, rule if d == dimension else r) for d, r in self.rules))


OPEN = Filter(rules=tuple((d, Rule()) for d in DIMENSIONS), beacons=True)


def _values(dimension: str, text: str) -> frozenset:
    words = [w for w in text.replace(",", " ").upper().split() if w]
    number = DIMENSIONS[dimension][1]
    out = set()
    for w in words:
        if number:
            if not w.isdigit() or (dimension.endswith("ZONE") and not 1 <= int(w) <= 40):
                raise ValueError(f"{w} is no value of {dimension}")
            out.add(int(w))
        elif dimension == "BAND":
            band = w.lower() + ("m" if w[-1].isdigit() else "")
            if band not in {b for b, _, _ in radio.BANDS}:
                raise ValueError(f"{w} is no band")
            out.add(band)
        else:
            known = {"MODE": radio.MODES, "SOURCE": ("HUMAN", "SKIMMER"), "DXCONT": radio.CONTINENTS, "DECONT": radio.CONTINENTS, "CONFIDENCE": radio.GLYPHS}.get(dimension)
            if known and w not in known:
                raise ValueError(f"{w} is no value of {dimension}")
            out.add(w)
    if not out:
        raise ValueError("a list of values or ALL is wanted")
    return frozenset(out)


def command(f: Filter, line: str) -> tuple[Filter, str]:
    """The filter after a command, and the reply. PASS|REJECT <dimension> <list>|ALL, PASS|REJECT BEACON, REJECT ALL (everything passes), SHOW FILTER [dimension]."""
    words = line.strip().upper().split(None, 2)
    verb, what, rest = (words + ["", "", ""])[:3]
    if verb in ("SET", "UNSET", "FILTER") or (verb == "SHOW" and what == "SET"):
        return f, "use PASS, REJECT or SHOW FILTER"
    if verb == "SHOW" and what.startswith("FILTER"):
        return f, describe(f, rest.strip() or None)
    if verb not in ("PASS", "REJECT"):
        return f, "Unknown command"
    if what == "ALL" and verb == "REJECT":
        return replace(OPEN, call=f.call), "all filters reset"
    if what == "BEACON":
        return replace(f, beacons=verb == "PASS"), "beacons " + ("pass" if verb == "PASS" else "rejected")
    if what not in DIMENSIONS:
        return f, f"unknown filter type {what}"
    try:
        if rest.strip() == "ALL":
            rule = Rule() if verb == "PASS" else Rule(all=False, block_all=True)
        else:
            values = _values(what, rest)
            rule = f.rule(what).passed(values) if verb == "PASS" else f.rule(what).rejected(values)
    except ValueError as e:
        return f, str(e)
    out = f.with_rule(what, rule)
    return out, describe(out, what)


def describe(f: Filter, dimension: str | None = None) -> str:
    def one(d: str, r: Rule) -> str:
        if r.block_all:
            return f"{d}: none"
        parts = ["all" if r.all and not r.allow else "allow " + ",".join(map(str, sorted(r.allow)))]
        if r.block:
            parts.append("block " + ",".join(map(str, sorted(r.block))))
        return f"{d}: " + " ".join(parts)

    return "; ".join(one(d, r) for d, r in f.rules if dimension in (None, d))


def _pattern(x: Column, p: str) -> Column:
    if p.endswith("*"):
        return x.startswith(p[:-1])
    return x.endswith(p[1:]) if p.startswith("*") else x == p


def _rule_column(dimension: str, r: Rule) -> Column:
    name, number = DIMENSIONS[dimension]
    x = F.col(name)
    if r.block_all:
        return F.lit(False)
    if dimension in PATTERNED:
        any_of = lambda ps: reduce(lambda a, b: a | b, [_pattern(F.coalesce(x, F.lit("")), p) for p in sorted(ps)], F.lit(False))
        return ~any_of(r.block) & (any_of(r.allow) if r.allow else F.lit(r.all))
    if number:
        valid = x.between(1, 40) if dimension.endswith("ZONE") else x > 0
    else:
        x = radio.normal_glyph(x) if dimension == "CONFIDENCE" else x
        valid = F.trim(x) != ""
    inside = lambda s: x.isin(*sorted(s)) if s else F.lit(False)
    out = F.lit(True)
    if r.block:
        out = out & ~F.coalesce(inside(r.block), F.lit(False))
    if not r.all and not r.allow:
        return F.lit(False)
    if r.allow:
        out = out & F.coalesce(valid & inside(r.allow), F.lit(False))
    if dimension == "CONFIDENCE":
        return F.col("mode").isin("FT8", "FT4") | out
    return out


def compile_filter(f: Filter) -> Column:
    """One predicate over DIMENSIONS' columns and is_beacon; plain columns are pushed into scans. A spot of the subscriber's own call always passes."""
    out = reduce(lambda a, b: a & b, [_rule_column(d, r) for d, r in f.rules if r != Rule()], F.lit(True))
    if f.beacons is False:
        out = out & ~F.coalesce(F.col("is_beacon"), F.lit(False))
    return (F.upper("dx_call") == f.call.upper()) | out if f.call else out


def deliver(spots: DataFrame, subscribers: list[tuple[str, Filter]]) -> DataFrame:
    """subscriber, and the columns of spots, for each spot that a subscriber's filter passes. All filters are tested in one pass over a spot, whose copies are only those that pass: no join."""
    hits = F.array_compact(F.array(*[F.when(compile_filter(replace(f, call=f.call or name)), F.lit(name)) for name, f in subscribers]))
    return spots.withColumn("subscriber", F.explode(hits))


#: The columns of a table of filters: the subscriber, their own call, whether beacons pass, and for each dimension what is allowed and blocked (as text), and the flags all and block_all.
TABLE_SCHEMA = "subscriber string, call string, beacons boolean, " + ", ".join(f"{d.lower()} struct<allow:array<string>,block:array<string>,every:boolean,none:boolean>" for d in DIMENSIONS)


def filter_table(spark: SparkSession, subscribers: list[tuple[str, Filter]]) -> DataFrame:
    """Filters as a table, a row for each subscriber; a service keeps such a table and reads it from its store."""
    rows = [(name, f.call or name, f.beacons, *(([*map(str, sorted(r.allow))], [*map(str, sorted(r.block))], r.all, r.block_all) for d in DIMENSIONS for r in [f.rule(d)])) for name, f in subscribers]
    return spark.createDataFrame(rows, TABLE_SCHEMA)


def _by_table(dimension: str) -> Column:
    """The dimension's rule, read from the table's row."""
    name, number = DIMENSIONS[dimension]
    rule, x = F.col(f"_filter.{dimension.lower()}"), F.col(name)
    allow, block = rule["allow"], rule["block"]
    if dimension in PATTERNED:
        text = F.coalesce(x, F.lit(""))
        match = lambda p: F.when(p.endswith("*"), F.startswith(text, F.substring(p, F.lit(1), F.length(p) - 1))).when(p.startswith("*"), F.endswith(text, F.substring(p, F.lit(2), F.length(p)))).otherwise(text == p)
        allowed, blocked = F.exists(allow, match), F.exists(block, match)
    else:
        if number:
            valid = x.between(1, 40) if dimension.endswith("ZONE") else x > 0
            text = x.cast("string")
        else:
            text = radio.normal_glyph(x) if dimension == "CONFIDENCE" else x
            valid = F.trim(text) != ""
        allowed, blocked = F.coalesce(valid & F.array_contains(allow, text), F.lit(False)), F.coalesce(F.array_contains(block, text), F.lit(False))
    out = ~rule["none"] & ~blocked & F.when(F.size(allow) > 0, allowed).otherwise(rule["every"])
    return out | (F.col("mode").isin("FT8", "FT4") & ~rule["none"] & (rule["every"] | (F.size(allow) > 0))) if dimension == "CONFIDENCE" else out


def deliver_by_table(spots: DataFrame, table: DataFrame) -> DataFrame:
    """What deliver() gives, for any number of subscribers: spots meet filters by band (a filter stands under each band that it can pass, so a spot meets only those), the other rules are read from the filter's row, and a subscriber's own call is a second
    join by call. The plan's size doesn't grow with the subscribers."""
    bands = F.array(*[F.lit(b) for b, _, _ in radio.BANDS], F.lit("???"))
    wanted = F.array_except(F.when(F.size("band.allow") > 0, F.col("band.allow")).otherwise(F.when(F.col("band.every"), bands).otherwise(F.array().cast("array<string>"))), F.col("band.block"))
    packed = table.select("subscriber", F.struct(*[c for c in table.columns if c != "subscriber"]).alias("_filter"), F.when(F.col("band.none"), F.array().cast("array<string>")).otherwise(wanted).alias("_bands"))
    rest = reduce(lambda a, b: a & b, [_by_table(d) for d in DIMENSIONS if d != "BAND"], F.lit(True))
    passes = rest & (F.coalesce(F.col("_filter.beacons"), F.lit(True)) | ~F.coalesce(F.col("is_beacon"), F.lit(False)))
    keyed = packed.select("subscriber", "_filter", F.explode("_bands").alias("_band"))
    by_band = spots.withColumn("_band", F.col("band")).join(keyed, "_band").where(passes)
    mine = packed.withColumn("_call", F.upper("_filter.call"))
    in_band = F.array_contains("_bands", F.col("band"))
    by_call = spots.withColumn("_call", F.upper("dx_call")).join(mine, "_call").where(~F.coalesce(in_band & passes, F.lit(False)))
    return by_band.select(*spots.columns, "subscriber").unionByName(by_call.select(*spots.columns, "subscriber"))


#: Dimensions that can't stand for a filter: what they let through is more than their list.
_UNLISTED = {"CONFIDENCE"}


def _pairs(spots: DataFrame) -> Column:
    """Of a spot: its (dimension, value) pairs, and the pair that every spot has."""
    own = [F.struct(F.lit(d).alias("dim"), F.col(name).cast("string").alias("value")) for d, (name, _) in DIMENSIONS.items() if d not in _UNLISTED]
    return F.filter(F.array(*own, F.struct(F.lit("").alias("dim"), F.lit("").alias("value"))), lambda p: p["value"].isNotNull())


def shares(spots: DataFrame) -> DataFrame:
    """dim, value, n: how many spots have each value, by which rules are compared; of a day's spots, say, for a stream."""
    return spots.select(F.explode(_pairs(spots)).alias("p")).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))


def rarest_rules(table: DataFrame, counts: DataFrame) -> DataFrame:
    """subscriber, dim, value: the allow list that fewest spots meet, for each filter of a table: an inverted index of filters. Without such a list a filter stands under the pair that every spot has; one that lets nothing through has no row."""
    lists = []
    for d in DIMENSIONS:
        if d in _UNLISTED:
            continue
        rule = F.col(d.lower())
        exact = ~F.exists(rule["allow"], lambda p: p.contains("*")) if d in PATTERNED else F.lit(True)
        lists.append(F.when((F.size(rule["allow"]) > 0) & exact, F.struct(F.lit(d).alias("dim"), rule["allow"].alias("values"))))
    none = reduce(lambda a, b: a | b, [F.col(d.lower())["none"] for d in DIMENSIONS])
    rules = table.where(~none).select("subscriber", F.array_compact(F.array(*lists, F.struct(F.lit("").alias("dim"), F.array(F.lit("")).alias("values")))).alias("_lists"))
    flat = rules.select("subscriber", F.explode("_lists").alias("l")).select("subscriber", "l.dim", F.explode(F.array_distinct("l.values")).alias("value"))
    cost = flat.join(counts, ["dim", "value"], "left").groupBy("subscriber", "dim").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    best = cost.groupBy("subscriber").agg(F.min(F.struct("n", "dim"))["dim"].alias("dim"))
    return flat.join(best, ["subscriber", "dim"]).select("subscriber", "dim", "value")


def deliver_by_rarest(spots: DataFrame, table: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """What deliver_by_table() gives, where most filters ask for little: each stands under its most selective allow list (call, zone, grid, band and so on; counts: shares() of such spots, these themselves without), so a spot meets the filters
    that name one of its values, and those without any list, and not all that are open to its band. The rest of a filter is read from its row."""
    counts = counts if counts is not None else shares(spots)
    packed = table.select("subscriber", F.struct(*[c for c in table.columns if c != "subscriber"]).alias("_filter"))
    index = rarest_rules(table, counts).join(packed, "subscriber")
    passes = reduce(lambda a, b: a & b, [_by_table(d) for d in DIMENSIONS], F.lit(True)) & (F.coalesce(F.col("_filter.beacons"), F.lit(True)) | ~F.coalesce(F.col("is_beacon"), F.lit(False)))
    met = spots.withColumn("_p", F.explode(_pairs(spots))).withColumns({"dim": F.col("_p.dim"), "value": F.col("_p.value")}).drop("_p").join(index, ["dim", "value"])
    by_rule = met.where(passes)
    mine = packed.withColumn("_call", F.upper("_filter.call"))
    by_call = spots.withColumn("_call", F.upper("dx_call")).join(mine, "_call").where(~F.coalesce(passes, F.lit(False)))
    return by_rule.select(*spots.columns, "subscriber").unionByName(by_call.select(*spots.columns, "subscriber"))


#: Characters that a command line may hold.
_TYPED = re.compile(r"[A-Za-z0-9/#@*_,.:;?!+ -]*")


def typed(line: str) -> str | None:
    """A command line as it is taken: without its end, None if it holds a character that no command has."""
    line = line.rstrip("\r\n")
    return line if _TYPED.fullmatch(line) else None


def show_dx(spots: DataFrame, n: int = 10, order: str = "event_id") -> DataFrame:
    """The newest n spots, 1 to 100."""
    return spots.orderBy(F.desc(order)).limit(max(1, min(100, n)))
