"""Further registered queries: the consensus at a feed's settings (several spots a second, neighbouring frequencies, one mode), its anchors, traces and keyed distances, duplicates without reports, filters as a table,
the same operators on streams, and the composed pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as base
from .functions import distance
from .operators import correction, dedup, filters, lookups, signals
from .operators.correction import Settings
from .plans import pipeline
from .plans.spots import SPOTS_SQL, spots
from .plans.store import new_place, stored

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


#: Four spots a second; votes from half a kHz around within 300 Hz, of the same mode, from reports of 1 or more; distance 3 wants more.
FEED = Settings(window=90, min_reports=3, min_advantage=1, min_confidence=50, max_distance=3, tolerance_hz=300.0, bucket_reach=5, min_snr=(("CW", 1), ("RTTY", 1)), extra_reports_d3=1, extra_advantage_d3=1, extra_confidence_d3=5)
_FEED_VOTES = """, f AS (SELECT event_id, t // 4 AS t, freq_khz, CAST(FLOOR(freq_khz * 10 + 0.5) AS BIGINT) AS b, de_call, dx_call, mode, report >= 1 AS heard FROM spots WHERE mode IN ('CW', 'RTTY', 'SSB')),
fv AS (SELECT a.event_id, a.t, a.freq_khz, a.mode, a.dx_call AS subject, b.dx_call AS cand, b.de_call AS rep, b.t AS seen, b.freq_khz AS khz, b.heard FROM f a JOIN f b
    ON b.t BETWEEN a.t - 90 AND a.t AND (b.t < a.t OR b.event_id < a.event_id) AND abs(a.b - b.b) <= 5 AND abs(a.freq_khz - b.freq_khz) * 1000 <= 300 + 1e-6 AND b.heard AND CASE WHEN a.de_call = b.de_call THEN a.dx_call = b.dx_call ELSE a.mode = b.mode END
  UNION ALL SELECT event_id, t, freq_khz, mode, dx_call, dx_call, de_call, t, freq_khz, heard FROM f),
fg AS (SELECT event_id, t, freq_khz, mode, subject, cand, COUNT(DISTINCT CASE WHEN heard THEN rep END) AS n, MAX(seen) AS last_seen, MAX({'a': seen, 'c': khz}).c AS last_khz FROM fv GROUP BY ALL),
ft AS (SELECT event_id, COUNT(DISTINCT CASE WHEN heard THEN rep END) AS total FROM fv GROUP BY event_id),
fr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY n DESC, last_seen DESC, cand) AS rn FROM fg),
fw AS (SELECT x.event_id, x.t, x.mode, x.subject, x.cand AS winner, x.n AS winner_support, COALESCE(y.n, 0) AS runner_up_support, (SELECT n FROM fg WHERE fg.event_id = x.event_id AND fg.cand = x.subject) AS subject_support, ft.total, x.last_khz, y.last_khz AS runner_khz,
    CASE WHEN total > 0 THEN x.n * 100 // total ELSE 0 END AS conf, CAST(levenshtein(x.subject, x.cand) AS BIGINT) AS distance
  FROM fr x JOIN ft ON ft.event_id = x.event_id LEFT JOIN fr y ON y.event_id = x.event_id AND y.rn = 2 WHERE x.rn = 1),
fd AS (SELECT event_id, t, mode, subject, winner, winner_support, subject_support, runner_up_support, total, conf, distance, CASE WHEN total = 0 THEN 'no_reporters' WHEN winner = subject OR winner_support = 0 THEN 'no_winner' WHEN distance > 3 THEN 'max_edit_distance'
    WHEN winner_support < CASE WHEN distance >= 3 THEN 4 ELSE 3 END THEN 'min_reports' WHEN winner_support < subject_support + CASE WHEN distance >= 3 THEN 2 ELSE 1 END THEN 'advantage' WHEN conf < CASE WHEN distance >= 3 THEN 55 ELSE 50 END THEN 'confidence'
    WHEN runner_up_support > 0 AND abs(runner_khz - last_khz) >= 0.1 - 1e-9 AND runner_up_support >= 0.5 * winner_support THEN 'freq_guard' ELSE '' END AS reason FROM fw)"""
_COLUMNS = "event_id, t, subject, winner, winner_support, subject_support, runner_up_support, total, conf, distance, reason"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 4))


@_query(SPOTS_SQL + _FEED_VOTES + f" SELECT {_COLUMNS} FROM fd")
def feed_decisions(spark, sf_dir):
    d = correction.decide(correction.tallies(correction.votes(_feed(spark, sf_dir), FEED)), FEED)
    return d.select(*_COLUMNS.split(", "))


_GOOD = [("K1ABC", -1, 3), ("K3ABC", -1, 2), ("K5AB8", -1, 4), ("K7ABC", 14001, 2), ("K9ABC", -1, 1)]
_ANCHOR_SQL = (
    _FEED_VOTES
    + ", sc(call, bin, score) AS (VALUES "
    + ", ".join(f"('{c}', {b}, {n})" for c, b, n in _GOOD)
    + """), q AS (SELECT fr.*, COALESCE(o.score, e.score, 0) AS score FROM fr LEFT JOIN sc o ON o.call = cand AND o.bin = CAST(FLOOR(FLOOR(freq_khz * 1000 + 0.5) / 1000) AS BIGINT) LEFT JOIN sc e ON e.call = cand AND e.bin = -1),
an AS (SELECT event_id, cand AS anchor, n, rn FROM q WHERE score >= 2 AND cand <> subject AND levenshtein(subject, cand) <= 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY levenshtein(subject, cand), cand) = 1)
SELECT fd.event_id, COALESCE(an.anchor, fd.winner) AS winner, COALESCE(an.n, fd.winner_support) AS winner_support, CASE WHEN an.anchor IS NULL THEN fd.runner_up_support WHEN an.rn = 1 THEN fd.runner_up_support ELSE fd.winner_support END AS runner_up_support,
  CASE WHEN an.anchor IS NOT NULL OR fd.reason = '' THEN 'applied' ELSE 'rejected' END AS decision, CASE WHEN an.anchor IS NULL THEN 'consensus' ELSE 'anchor' END AS path FROM fd LEFT JOIN an ON an.event_id = fd.event_id"""
)


@_query(SPOTS_SQL + _ANCHOR_SQL)
def anchored_decisions(spark, sf_dir):
    tally = stored(correction.tallies(correction.votes(_feed(spark, sf_dir), FEED)), "tallies")
    found = correction.anchors(tally, spark.createDataFrame(_GOOD, "call string, bin long, score long"), FEED)
    return correction.decide(tally, FEED, anchored=found).select("event_id", "winner", "winner_support", "runner_up_support", "decision", "path")


@_query(SPOTS_SQL + _FEED_VOTES + """, pc AS (SELECT event_id, cand, COUNT(DISTINCT rep) AS n FROM fv WHERE heard GROUP BY event_id, cand), ls AS (SELECT event_id, string_agg(cand || ':' || CAST(n AS VARCHAR), ' ' ORDER BY n DESC, cand) AS votes FROM pc GROUP BY event_id)
SELECT fd.event_id, CASE WHEN total > 0 THEN subject_support * 100 // total ELSE 0 END AS subject_conf, CASE WHEN distance >= 3 THEN 4 ELSE 3 END AS min_reports, CASE WHEN distance >= 3 THEN 55 ELSE 50 END AS min_confidence, COALESCE(votes, '') AS votes FROM fd LEFT JOIN ls ON ls.event_id = fd.event_id""")
def decision_traces(spark, sf_dir):
    v = stored(correction.votes(_feed(spark, sf_dir), FEED), "votes")
    x = correction.traces(v, correction.decide(correction.tallies(v), FEED), FEED)
    line = F.array_join(F.transform("votes", lambda x: F.concat(x["call"], F.lit(":"), x["reporters"].cast("string"))), " ")
    return x.select("event_id", "subject_conf", "min_reports", "min_confidence", line.alias("votes"))


def _cells(name: str, pairs: str, cost: str) -> str:
    """A recursive query over the cells of edit-distance tables, row by row: name(id, d) of the pairs (id, m, a, b); cost: SQL of what a[i] costs for b[j]."""
    v = f"least(prev[j + 1] + 1, cur[j] + 1, prev[j] + ({cost}))"
    return f""", {name}_cells AS (SELECT id, m, a, b, 1 AS i, 1 AS j, [x::BIGINT for x in range(length(b) + 1)] AS prev, [1::BIGINT] AS cur FROM {pairs}
  UNION ALL SELECT id, m, a, b, CASE WHEN j = length(b) THEN i + 1 ELSE i END, CASE WHEN j = length(b) THEN 1 ELSE j + 1 END, CASE WHEN j = length(b) THEN list_append(cur, v) ELSE prev END, CASE WHEN j = length(b) THEN [i + 1] ELSE list_append(cur, v) END
  FROM (SELECT *, {v} AS v FROM {name}_cells WHERE i <= length(a))), {name} AS (SELECT id, prev[length(b) + 1] AS d FROM {name}_cells WHERE i = length(a) + 1)"""


_CODES = ", ".join(f"('{m}', '{c}', '{code}')" for m, table in (("morse", distance.MORSE), ("baudot", distance.BAUDOT)) for c, code in table.items())
_KEYED_SQL = (
    "WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), "
    + SPOTS_SQL.split("),\n", 1)[1]
    + _FEED_VOTES
    + f""", code(m, c, s) AS (VALUES {_CODES}), cp AS (SELECT x.m || x.c || y.c AS id, x.m, x.s AS a, y.s AS b FROM code x JOIN code y ON x.m = y.m AND x.c <> y.c)"""
    + _cells("sign", "cp", "CASE WHEN a[i] = b[j] THEN 0 ELSE 2 END")
    + """, costs AS (SELECT map_from_entries(list((cp.id, greatest(1, CAST(ceil(d * 2.0 / (greatest(length(a), length(b)) + 1)) AS BIGINT))))) AS c FROM cp JOIN sign ON sign.id = cp.id),
pr AS (SELECT DISTINCT subject || '>' || winner || CASE mode WHEN 'CW' THEN 'morse' ELSE 'baudot' END AS id, CASE mode WHEN 'CW' THEN 'morse' ELSE 'baudot' END AS m, subject AS a, winner AS b FROM fd WHERE subject <> winner)"""
    + _cells("keyed", "pr", "CASE WHEN a[i] = b[j] THEN 0 ELSE (SELECT c FROM costs)[m || a[i] || b[j]] END")
    + " SELECT fd.event_id, fd.mode, keyed.d AS distance FROM fd JOIN keyed ON keyed.id = fd.subject || '>' || fd.winner || CASE mode WHEN 'CW' THEN 'morse' ELSE 'baudot' END"
)


@_query(_KEYED_SQL)
def keyed_distances(spark, sf_dir):
    d = correction.decide(correction.tallies(correction.votes(_feed(spark, sf_dir), FEED)), FEED, by_mode=True)
    return d.where("subject <> winner").select("event_id", "mode", "distance")


_SQL["consensus_keyed_distance"] = (
    "WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), "
    + SPOTS_SQL.split("),\n", 1)[1]
    + base._DECISIONS_SQL
    + f""", dm AS (SELECT d.subject, d.winner, s.mode, CASE s.mode WHEN 'CW' THEN 'morse' WHEN 'RTTY' THEN 'baudot' ELSE 'plain' END AS m FROM decisions d JOIN spots s ON s.event_id = d.event_id WHERE d.winner <> d.subject),
code(m, c, s) AS (VALUES {_CODES}), cp AS (SELECT x.m || x.c || y.c AS id, x.m, x.s AS a, y.s AS b FROM code x JOIN code y ON x.m = y.m AND x.c <> y.c)"""
    + _cells("sign", "cp", "CASE WHEN a[i] = b[j] THEN 0 ELSE 2 END")
    + """, costs AS (SELECT map_from_entries(list((cp.id, greatest(1, CAST(ceil(d * 2.0 / (greatest(length(a), length(b)) + 1)) AS BIGINT))))) AS c FROM cp JOIN sign ON sign.id = cp.id),
pr AS (SELECT DISTINCT subject || '>' || winner || m AS id, m, subject AS a, winner AS b FROM dm)"""
    + _cells("keyed", "pr", "CASE WHEN a[i] = b[j] THEN 0 WHEN m = 'plain' THEN 1 ELSE (SELECT c FROM costs)[m || a[i] || b[j]] END")
    + " SELECT dm.mode, keyed.d AS distance, COUNT(*) AS n FROM dm JOIN keyed ON keyed.id = dm.subject || '>' || dm.winner || dm.m GROUP BY ALL"
)


# ---- duplicates whose rows may lack a report

_LOOSE = """, l AS (SELECT event_id, event_id // 4 AS t, dx_call, CAST(FLOOR(freq_khz) AS BIGINT) AS khz, CASE WHEN k % 3 = 0 THEN NULL ELSE report - 2 END AS report FROM spots)"""
_FOLD = """, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY t, event_id) AS rn FROM lk),
w AS (SELECT {keys}, rn, event_id, t AS wt, COALESCE(report, 0) AS v, report IS NOT NULL AS has, TRUE AS keep FROM o WHERE rn = 1
  UNION ALL SELECT {okeys}, y.rn, y.event_id, CASE WHEN y.go THEN y.t ELSE y.wt END, CASE WHEN y.go THEN COALESCE(y.report, 0) ELSE y.v END, CASE WHEN y.go THEN y.report IS NOT NULL ELSE y.has END, y.go
  FROM (SELECT o.*, w.wt, w.v, w.has, o.t - w.wt >= {window} OR (o.report IS NOT NULL AND NOT w.has) OR COALESCE(o.report, 0) > w.v AS go FROM w JOIN o ON {join} AND o.rn = w.rn + 1) y)
SELECT event_id FROM w WHERE keep"""


def _loose_sql(keys: tuple[str, ...], more: str, window: int) -> str:
    head = "WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), " + SPOTS_SQL.split("),\n", 1)[1]
    return head + _LOOSE + f", lk AS (SELECT *, {more} FROM l)" + _FOLD.format(keys=", ".join(keys), okeys=", ".join(f"y.{k}" for k in keys), window=window, join=" AND ".join(f"o.{k} = w.{k}" for k in keys))


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _feed(spark, sf_dir).select("event_id", "t", "dx_call", F.floor("freq_khz").alias("khz"), F.when(k % 3 != 0, F.col("report") - 2).alias("report"))


@_query(_loose_sql(("minute", "khz", "dx_call"), "t // 60 AS minute", 60))
def primary_dedup_loose(spark, sf_dir):
    return dedup.primary(_loose(spark, sf_dir).withColumn("minute", F.floor(F.col("t") / 60)), ["minute", "khz", "dx_call"]).select("event_id")


@_query(_loose_sql(("khz", "dx_call"), "0 AS none", 20))
def secondary_dedup_loose(spark, sf_dir):
    return dedup.secondary(_loose(spark, sf_dir), ["khz", "dx_call"], 20).select("event_id")


@_query(_loose_sql(("khz", "dx_call"), "0 AS none", 20))
def stream_dedup_loose(spark, sf_dir):
    from .streaming import spots as streams

    s = _loose(spark, sf_dir)
    table, out = new_place(spark, "spots"), new_place(spark, "dedup")
    s.write.parquet(table)
    streams.run_once(streams.anchor_dedup(spark.readStream.schema(s.schema).parquet(table), ["khz", "dx_call"], 20), f"{out}/out", f"{out}/progress")
    return spark.read.schema("event_id long").parquet(f"{out}/out")


# ---- filters as a table


@_query(base.oracle_sql()["subscribers_theta"])
def subscribers_by_table(spark, sf_dir):
    subs = [("K3ABC", base._filter("PASS MODE CW")), ("W1AW", base._filter("REJECT DXCONT EU", "REJECT MODE FT8")), ("N0NE", base._filter("REJECT BAND ALL"))]
    return filters.deliver_by_table(base._wide(spots(spark, sf_dir)), filters.filter_table(spark, subs)).select("subscriber", "event_id")


@_query(base.oracle_sql()["subscribers_theta"])
def subscribers_by_rarest(spark, sf_dir):
    subs = [("K3ABC", base._filter("PASS MODE CW")), ("W1AW", base._filter("REJECT DXCONT EU", "REJECT MODE FT8")), ("N0NE", base._filter("REJECT BAND ALL"))]
    return filters.deliver_by_rarest(base._wide(spots(spark, sf_dir)), filters.filter_table(spark, subs)).select("subscriber", "event_id")


@_query(SPOTS_SQL + " SELECT event_id FROM spots WHERE mode IN ('CW') AND mode NOT IN ('FT8') AND k % 41 IN (3, 14)")
def filter_allow_with_all(spark, sf_dir):
    """An allow list holds even where everything else is let through."""
    f = filters.OPEN.with_rule("MODE", filters.Rule(frozenset({"CW"}), frozenset({"FT8"}), True)).with_rule("DXZONE", filters.Rule(frozenset({3, 14}), frozenset(), True))
    return base._wide(spots(spark, sf_dir)).where(filters.compile_filter(f)).select("event_id")


@_query("SELECT 'customer' AS name, COUNT(*) AS n FROM customer UNION ALL SELECT 'events', COUNT(*) FROM events UNION ALL SELECT 'orders', COUNT(*) FROM orders")
def row_counts(spark, sf_dir):
    return lookups.row_counts({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "events", "orders")})


@_query(SPOTS_SQL + ", p(prefix, country, zone, adif) AS (VALUES ('K1', 'one', 5, 291), ('K2', 'two', 4, 292), ('K', 'all', 3, 290)), c AS (SELECT DISTINCT dx_call FROM spots), m AS (SELECT dx_call, arg_max(country, length(prefix)) AS country, arg_max(zone, length(prefix)) AS zone, arg_max(adif, length(prefix)) AS adif FROM c JOIN p ON starts_with(dx_call, prefix) GROUP BY dx_call) SELECT event_id, m.country, CAST(m.zone AS INTEGER) AS cq_zone, CAST(m.adif AS INTEGER) AS adif, CASE WHEN k % 2 = 0 THEN 'FN20' END AS grid FROM spots s JOIN m ON m.dx_call = s.dx_call")
def prefix_metadata(spark, sf_dir):
    table = spark.createDataFrame([("K1", "one", "NA", 5, 8, 291), ("K2", "two", "NA", 4, 7, 292), ("K", "all", "NA", 3, 6, 290)], "prefix string, country string, continent string, cq_zone int, itu_zone int, adif int")
    s = spots(spark, sf_dir).withColumn("dx", F.struct(F.when(F.col("k") % 2 == 0, "FN20").alias("grid")))
    return lookups.metadata(s, "dx_call", table, "dx", rows=3).select("event_id", "dx.country", "dx.cq_zone", "dx.adif", "dx.grid")


# ---- operators with a memory on streams


def _in_parts(spark: SparkSession, s: DataFrame, parts: int) -> DataFrame:
    """s as a stream of some micro-batches, in order of time."""
    place = new_place(spark, "parts")
    bounds = s.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    width = (bounds["hi"] - bounds["lo"]) // parts + 1
    for k in range(parts):
        lo = bounds["lo"] + k * width
        s.where((F.col("t") >= lo) & (F.col("t") < lo + width)).coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(place)


def _streamed(spark: SparkSession, s: DataFrame, operator, window: int, parts: int = 3) -> DataFrame:
    from .streaming import spots as streams

    place = new_place(spark, "memory")
    streams.with_memory(_in_parts(spark, s, parts), operator, window, f"{place}/out", f"{place}/memory", f"{place}/progress")
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out/part=*").drop("part")


@_query(SPOTS_SQL + _FEED_VOTES + f" SELECT {_COLUMNS} FROM fd")
def stream_decisions(spark, sf_dir):
    """The consensus on a stream: the same rows as in batch."""
    return _streamed(spark, _feed(spark, sf_dir), lambda s: correction.decide(correction.tallies(correction.votes(s, FEED)), FEED), FEED.window).select(*_COLUMNS.split(", "))


@_query(base.oracle_sql()["freq_average"])
def stream_averages(spark, sf_dir):
    return _streamed(spark, _feed(spark, sf_dir), lambda s: signals.average_frequency(s, window=150), 150)


@_query(base.oracle_sql()["harmonics"])
def stream_harmonics(spark, sf_dir):
    k, f = F.col("k"), F.col("freq_khz")
    s = _feed(spark, sf_dir).withColumn("freq_khz", F.when(k % 3 == 0, f * 2).when(k % 7 == 0, f * 3).otherwise(f))
    return _streamed(spark, s, signals.harmonics, 120).select("event_id", "fundamental", "multiple", F.col("delta").cast("long").alias("delta"), "corroborators")


# ---- the whole


@_query()
def spot_pipeline(spark, sf_dir):
    """Every step of the spot pipeline in one plan; tests hold it against planted cases."""
    prefixes = spark.createDataFrame([("K", "US", "NA", 5, 8, 291), ("W", "US", "NA", 4, 7, 291)], "prefix string, country string, continent string, cq_zone int, itu_zone int, adif int")
    s = _feed(spark, sf_dir)
    plan = pipeline.Plan(settings=FEED, prefixes=prefixes, known=s.select(F.col("dx_call").alias("call")), licensed=s.select(F.col("de_call").alias("call")))
    return pipeline.run(s.withColumn("comment", F.lit("CQ")), plan).select("event_id", "dx_call", "freq_khz", "confidence", "line")


@_query()
def pipeline_counts(spark, sf_dir):
    return signals.event_counts(pipeline.judged(_feed(spark, sf_dir), pipeline.Plan(settings=FEED)))
