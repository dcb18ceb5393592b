"""The daily report and the analysis programs: each a set of aggregates over one day's stored decisions, and text lines of a few rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics


def dated(template: str, day: datetime.date) -> str:
    """A path template's {date}, {yyyy}, {mm}, {dd} and {Mon} filled in."""
    values = {"{date}": day.isoformat(), "{yyyy}": f"{day.year:04d}", "{mm}": f"{day.month:02d}", "{dd}": f"{day.day:02d}", "{Mon}": day.strftime("%b")}
    for k, v in values.items():
        template = template.replace(k, v)
    return template


def delay_to(now: datetime.datetime, hhmm: str) -> datetime.timedelta:
    """How long until it is HH:MM, the next day's if that is now or has been: what a daily refresh waits."""
    hour, minute = map(int, hhmm.strip().split(":"))
    then = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return (then if then > now else then + datetime.timedelta(days=1)) - now


def daily(decisions: DataFrame, reference: DataFrame, spots: DataFrame, day: datetime.date | None = None, contests: DataFrame | None = None, horizon: int = 300, bucket: int = 900, least: int = 2) -> dict[str, DataFrame]:
    """The tables of the daily report; decisions are read by each of them, so they come from a stored table. reference: row, t, freq_khz, subject, correct."""
    flags = analytics.follow_on(decisions, spots, horizon, least=least)
    matched = analytics.match_reference(decisions, reference.withColumnRenamed("subject", "bad"))
    missed = analytics.missed_reference(reference.withColumnRenamed("subject", "bad"), matched)
    out = {
        "summary": analytics.summary(decisions), "reasons": analytics.most_first(analytics.reject_reasons(decisions)), "reasons_d3": analytics.most_first(analytics.reject_reasons(decisions, 3)), "headroom": analytics.headroom(decisions),
        "recall": analytics.recall_by_band(reference, decisions).orderBy("band"), "pairs": analytics.pair_recall(reference, decisions), "stability": analytics.stability_by_bucket(flags, bucket).orderBy("bucket_start"),
        "stability_band": analytics.stability_by_band(flags).orderBy("band"), "precision": analytics.precision(matched, missed), "distance": analytics.by_distance(decisions.where("distance between 1 and 3")).orderBy("distance"),
    }
    if day is not None and contests is not None:
        out["contest"] = contests.agg(F.count_if(F.col("date") == F.lit(day)).alias("n")).select((F.col("n") > 0).alias("contest"))
    return out


def distance3(decisions: DataFrame) -> dict[str, DataFrame]:
    return {"list": analytics.distance3_list(decisions), "reasons": analytics.most_first(analytics.reject_reasons(decisions, 3)), "scenarios": analytics.distance3_scenarios(decisions), "gap": analytics.distance_gap(decisions)}


def reappearances(decisions: DataFrame, horizon: int = 300) -> dict[str, DataFrame]:
    gaps = analytics.both_reappear(decisions, horizon)
    return {"gaps": gaps, "classes": analytics.separation_classes(gaps)}


def text(tables: dict[str, DataFrame], title: str = "Daily report", most: int = 100) -> list[str]:
    """The tables as lines: their first rows, most at most, under their names. Only what is printed reaches the driver."""
    lines = [title]
    for name, table in tables.items():
        lines.append(f"{name}: " + " ".join(table.columns))
        for r in table.limit(most).collect():
            lines.append("  " + "  ".join(f"{x:.2f}" if isinstance(x, float) else str(x) for x in r))
    return lines
