"""Registered queries whose results depend on the order of spots: corrections that vote in their turn, qualities that learn, and the keyed states of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as base
from .flow_queries import _COLUMNS, _FEED_VOTES, _FOLD, FEED, _feed
from .operators import correction, feedback
from .plans.spots import SPOTS_SQL, spots
from .plans.store import new_place
from .streaming import states

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Rounds of the oracles: each settles the spots whose voters are settled; tests hold the result against a loop over the spots.
_ROUNDS = 24
_RECURSIVE = "WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), " + SPOTS_SQL.split("),\n", 1)[1]
_F = ", f AS (SELECT event_id, t // 4 AS t, freq_khz, CAST(FLOOR(freq_khz * 10 + 0.5) AS BIGINT) AS b, de_call, dx_call, mode, report >= 1 AS heard FROM spots WHERE mode IN ('CW', 'RTTY', 'SSB'))"
_NEAR = """pairs AS MATERIALIZED (SELECT a.event_id, a.t, a.freq_khz, a.mode, a.dx_call AS subject, a.de_call AS own, b.event_id AS voter, b.de_call AS rep, b.t AS seen, b.freq_khz AS khz, b.heard FROM f a JOIN f b
    ON b.t BETWEEN a.t - 90 AND a.t AND (b.t < a.t OR b.event_id < a.event_id) AND abs(a.b - b.b) <= 5 AND abs(a.freq_khz - b.freq_khz) * 1000 <= 300 + 1e-6 AND b.heard AND (a.de_call = b.de_call OR a.mode = b.mode)
  UNION ALL SELECT event_id, t, freq_khz, mode, dx_call, de_call, event_id, de_call, t, freq_khz, heard FROM f)"""
#: From v (k, event_id, t, freq_khz, mode, subject, cand, rep, seen, khz, heard): the decisions of round k.
_JUDGE = """g AS (SELECT k, event_id, t, freq_khz, mode, subject, cand, COUNT(DISTINCT CASE WHEN heard THEN rep END) AS n, MAX(seen) AS last_seen, MAX({'a': seen, 'c': khz}).c AS last_khz FROM v GROUP BY ALL),
tt AS (SELECT event_id, COUNT(DISTINCT CASE WHEN heard THEN rep END) AS total FROM v GROUP BY event_id),
x AS (SELECT g.*, ROW_NUMBER() OVER w AS rn, COALESCE(LEAD(n) OVER w, 0) AS runner_up_support, LEAD(last_khz) OVER w AS runner_khz, MAX(CASE WHEN cand = subject THEN n ELSE 0 END) OVER (PARTITION BY event_id) AS subject_support FROM g WINDOW w AS (PARTITION BY event_id ORDER BY n DESC, last_seen DESC, cand)),
d AS (SELECT x.k, x.event_id, t, freq_khz, mode, subject, cand AS winner, n AS winner_support, runner_up_support, subject_support, total, last_khz, runner_khz, CASE WHEN total > 0 THEN n * 100 // total ELSE 0 END AS conf, CAST(levenshtein(subject, cand) AS BIGINT) AS distance FROM x JOIN tt ON tt.event_id = x.event_id WHERE rn = 1),
dd AS (SELECT *, CASE WHEN total = 0 THEN 'no_reporters' WHEN winner = subject OR winner_support = 0 THEN 'no_winner' WHEN distance > 3 THEN 'max_edit_distance' WHEN winner_support < CASE WHEN distance >= 3 THEN 4 ELSE 3 END THEN 'min_reports'
    WHEN winner_support < subject_support + CASE WHEN distance >= 3 THEN 2 ELSE 1 END THEN 'advantage' WHEN conf < CASE WHEN distance >= 3 THEN 55 ELSE 50 END THEN 'confidence'
    WHEN runner_up_support > 0 AND abs(runner_khz - last_khz) >= 0.1 - 1e-9 AND runner_up_support >= 0.5 * winner_support THEN 'freq_guard' ELSE '' END AS reason FROM d)"""


@_query(
    _RECURSIVE + _F + ", " + _NEAR + f""", r AS (SELECT 0 AS k, event_id, t, dx_call AS subject, dx_call AS winner, 0::BIGINT AS winner_support, 0::BIGINT AS subject_support, 0::BIGINT AS runner_up_support, 0::BIGINT AS total, 0::BIGINT AS conf, 0::BIGINT AS distance, 'none' AS reason, dx_call AS call FROM f
  UNION ALL SELECT k, event_id, t, subject, winner, winner_support, subject_support, runner_up_support, total, conf, distance, reason, CASE WHEN reason = '' THEN winner ELSE subject END FROM (
    WITH v AS (SELECT r.k + 1 AS k, p.event_id, p.t, p.freq_khz, p.mode, p.subject, CASE WHEN p.voter = p.event_id THEN p.subject ELSE r.call END AS cand, p.rep, p.seen, p.khz, p.heard FROM pairs p JOIN r ON r.event_id = p.voter WHERE r.k < {_ROUNDS} AND (p.voter = p.event_id OR p.rep <> p.own OR r.call = p.subject)),
    {_JUDGE} SELECT * FROM dd))
SELECT {_COLUMNS} FROM r WHERE k = {_ROUNDS}"""
)
def fed_back_decisions(spark, sf_dir):
    """The consensus where corrected spots vote for their new calls."""
    return feedback.settle(_feed(spark, sf_dir), FEED, keep_tallies=False).decisions.select(*_COLUMNS.split(", "))


_PRIORS = [("K1ABC", -1, 3), ("K3ABC", -1, 2), ("K5AB8", -1, 4), ("K7ABC", 14001, 2), ("K9ABC", -1, 1)]
_LEARNED = "event_id, winner, winner_support, runner_up_support, total, path, reason"


@_query(
    _RECURSIVE + _FEED_VOTES + ", sc(call, bin, score) AS (VALUES " + ", ".join(f"('{c}', {b}, {n})" for c, b, n in _PRIORS) + f"""),
cs AS (SELECT event_id, t, subject, CAST(FLOOR(FLOOR(freq_khz * 1000 + 0.5) / 1000) AS BIGINT) AS bin, list({{'c': cand, 'd': levenshtein(subject, cand), 'o': o.score, 'e': a.score}}) AS cs FROM fr LEFT JOIN sc o ON o.call = cand AND o.bin = CAST(FLOOR(FLOOR(freq_khz * 1000 + 0.5) / 1000) AS BIGINT) LEFT JOIN sc a ON a.call = cand AND a.bin = -1 GROUP BY ALL),
sp AS MATERIALIZED (SELECT cs.*, fd.winner, fd.reason, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY cs.t, cs.event_id) AS rn FROM cs JOIN fd ON fd.event_id = cs.event_id),
st AS (SELECT bin, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS anchor, MAP {{'': 0::BIGINT}} AS q FROM sp GROUP BY bin
  UNION ALL SELECT bin, rn, event_id, anchor, CASE WHEN anchor IS NOT NULL OR reason = '' THEN map_concat(q, map_from_entries([{{'k': x.c, 'v': (COALESCE(q[x.c], x.o, 0) + CASE WHEN x.c = COALESCE(anchor, winner) THEN 1 ELSE -1 END)::BIGINT}} FOR x IN cs])) ELSE q END
  FROM (SELECT sp.bin, sp.rn, sp.event_id, sp.reason, sp.winner, sp.cs, st.q, list_min([{{'d': x.d, 'c': x.c}} FOR x IN sp.cs IF COALESCE(st.q[x.c], x.o, x.e, 0) >= 2 AND x.c <> sp.subject AND x.d <= 3]).c AS anchor FROM st JOIN sp ON sp.bin = st.bin AND sp.rn = st.rn + 1))
SELECT fd.event_id, COALESCE(anchor, winner) AS winner, COALESCE(fr.n, winner_support) AS winner_support, CASE WHEN anchor IS NULL OR fr.rn = 1 THEN runner_up_support ELSE winner_support END AS runner_up_support, total, CASE WHEN anchor IS NULL THEN 'consensus' ELSE 'anchor' END AS path,
  CASE WHEN anchor IS NULL THEN reason ELSE '' END AS reason FROM fd JOIN st ON st.event_id = fd.event_id LEFT JOIN fr ON fr.event_id = fd.event_id AND fr.cand = anchor"""
)
def learning_decisions(spark, sf_dir):
    """The consensus where decisions change the quality that later anchors go by."""
    priors = spark.createDataFrame(_PRIORS, "call string, bin long, score long")
    return feedback.settle(_feed(spark, sf_dir), FEED, votes_back=False, quality_back=True, priors=priors, keep_tallies=False).decisions.select(*_LEARNED.split(", "))


# ---- streams with keyed state: micro-batches whose spots are out of order

#: The tables' times begin at 0, which is where watermarks begin; on streams they are a day later.
_DAY = 86_400


def _by_parts(spark: SparkSession, s: DataFrame, part: Column, parts: int, run: Callable[[DataFrame], None]) -> tuple[int, int]:
    """Runs a stream over s (t in seconds), a run and a micro-batch for each part, and one more with a spot of id -1, long after all others, which closes them. Returns the first and the last time."""
    place = new_place(spark, "parts")
    lo, hi = s.agg(F.min("t"), F.max("t")).first()
    held = s.withColumn("_part", part)
    last = s.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "t": F.lit((hi or 0) + 100_000).cast("long")})
    for k in range(parts + 1):
        (held.where(F.col("_part") == k).drop("_part") if k < parts else last).write.mode("append").parquet(place)
        run(spark.readStream.schema(s.schema).parquet(place))
    return lo, hi


def _part_of(s: DataFrame, parts: int, jitter: int) -> Column:
    """Parts of equal spans of time, between which spots of up to jitter seconds change places."""
    lo, hi = s.agg(F.min("t"), F.max("t")).first()
    return F.least(F.lit(parts - 1), F.floor((F.col("t") - (lo or 0) + F.pmod(F.hash("event_id"), F.lit(jitter))) * parts / ((hi or 0) - (lo or 0) + 1))).cast("int")


@_query(SPOTS_SQL + _FEED_VOTES + f" SELECT {_COLUMNS} FROM fd")
def stream_keyed_decisions(spark, sf_dir):
    """The consensus from keyed state by frequency zone: the batch's rows, whatever the order within a minute."""
    s = correction.eligible(_feed(spark, sf_dir), FEED).withColumn("t", F.col("t").cast("long") + _DAY)
    place = new_place(spark, "keyed")
    _by_parts(spark, s, _part_of(s, 4, 40), 4, lambda stream: states.consensus(stream, FEED, f"{place}/out", f"{place}/progress", lateness="60 seconds"))
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out").where("event_id >= 0").withColumn("t", F.col("t") - _DAY).select(*_COLUMNS.split(", "))


@_query(SPOTS_SQL + base._STATE_SQL + " SELECT slot, grp, st.raw_state, st.state, a.mean_reporters FROM st JOIN a USING (slot, grp)")
def stream_adaptive_states(spark, sf_dir):
    """States of band groups from timers, one group without any reporter among them."""
    k = F.col("k")
    s = spots(spark, sf_dir).withColumns({"freq_khz": F.when(k % 2 == 0, 14010.0).when(k % 4 == 1, 28010.0).otherwise(50010.0), "t": F.col("t").cast("long") + _DAY}).select("event_id", "t", "freq_khz", "de_call")
    place, groups = new_place(spark, "states"), {}
    for g, band in base._GROUPS:
        groups.setdefault(g, []).append(band)
    _, hi = _by_parts(spark, s, _part_of(s, 3, 40), 3, lambda stream: states.start(states.adaptive_states(stream, groups, 600, 900, 70, 93, lateness="60 seconds"), f"{place}/progress", path=f"{place}/out"))
    return spark.read.schema(states._STATES).parquet(f"{place}/out").where(F.col("slot") <= (hi or 0) // 600).withColumn("slot", F.col("slot") - _DAY // 600).select("slot", "grp", "raw_state", "state", "mean_reporters")


_LATE_SQL = """, d AS (SELECT event_id, event_id // 4 AS t, dx_call, CAST(FLOOR(freq_khz) AS BIGINT) AS khz, CASE WHEN k % 3 = 0 THEN NULL ELSE report - 2 END AS report FROM spots), b AS (SELECT MIN(t) AS lo, MAX(t) AS hi FROM d),
p AS (SELECT d.*, LEAST(3, (t - lo) * 4 // (hi - lo + 1) + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END) AS part FROM d, b), m AS (SELECT part, MAX(t) AS t FROM p GROUP BY part),
n AS (SELECT part, MAX(t) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM m), lt AS (SELECT p.*, COALESCE(p.t <= newest - 30, FALSE) AS late FROM p JOIN n ON n.part = p.part), lk AS (SELECT * FROM lt WHERE NOT late)"""


@_query(_RECURSIVE + _LATE_SQL + _FOLD.format(keys="khz, dx_call", okeys="y.khz, y.dx_call", window=20, join="o.khz = w.khz AND o.dx_call = w.dx_call").replace("SELECT event_id FROM w WHERE keep", "SELECT 'kept' AS kind, event_id FROM w WHERE keep UNION ALL SELECT 'late', event_id FROM lt WHERE late"))
def stream_late_rows(spark, sf_dir):
    """Every seventeenth spot comes two parts late: what a watermark of half a minute would drop is set apart, and the rest deduplicated by anchors that expire."""
    k = F.col("k")
    s = _feed(spark, sf_dir).select("event_id", (F.col("t").cast("long") + _DAY).alias("t"), "dx_call", F.floor("freq_khz").alias("khz"), F.when(k % 3 != 0, F.col("report") - 2).alias("report"))
    place = new_place(spark, "late")
    part = F.least(F.lit(3), _part_of(s, 4, 1) + F.when(F.col("event_id") % 17 == 0, 2).otherwise(0))
    _by_parts(spark, s, part, 4, lambda stream: states.split_late(stream, 30, f"{place}/main", f"{place}/late", f"{place}/marks", f"{place}/p1"))
    main = spark.readStream.schema(s.schema).parquet(f"{place}/main/part=*")
    states.start(states.expiring_dedup(main, ["khz", "dx_call"], 20, lateness="60 seconds"), f"{place}/p2", path=f"{place}/kept")
    kept = spark.read.schema("event_id long").parquet(f"{place}/kept").where("event_id >= 0").select(F.lit("kept").alias("kind"), "event_id")
    return kept.unionByName(spark.read.schema(s.schema).parquet(f"{place}/late/part=*").select(F.lit("late").alias("kind"), "event_id"))
