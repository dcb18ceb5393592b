"""The registered queries over the spot operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import radio
from .operators import analytics, correction, dedup, filters, lookups, signals
from .operators.correction import Settings
from .plans.spots import SPOTS_SQL, spots
from .plans.store import new_place, stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _sql(body: str) -> str:
    return SPOTS_SQL + body


_BAND_SQL = "CASE " + " ".join(f"WHEN freq_khz BETWEEN {lo} AND {hi} THEN '{b}'" for b, lo, hi in radio.BANDS) + " ELSE '???' END"
_REPORT_BAND_SQL = "CASE " + " ".join(f"WHEN freq_khz < {hi} THEN '{b}'" for b, hi in radio.REPORT_BANDS) + " ELSE '6m+' END"
#: Settings and SQL of the consensus that the decision queries run on.
CONSENSUS = Settings(window=360, min_reports=6, min_advantage=1, min_confidence=60, max_distance=3, tolerance_hz=40.0, bucket_reach=0, same_mode=False, modes=None)
_VOTES_SQL = """, v AS (
  SELECT a.event_id, a.t, a.freq_khz, a.dx_call AS subject, b.dx_call AS cand, b.de_call AS rep, b.t AS bt
  FROM spots a JOIN spots b ON a.k % 20 = b.k % 20 AND b.t BETWEEN a.t - 360 AND a.t - 1 AND (b.de_call <> a.de_call OR b.dx_call = a.dx_call)
  UNION ALL SELECT event_id, t, freq_khz, dx_call, dx_call, de_call, t FROM spots)"""
_DECISIONS_SQL = (
    _VOTES_SQL
    + """, g AS (SELECT event_id, t, freq_khz, subject, cand, COUNT(DISTINCT rep) AS n, MAX(bt) AS last_seen FROM v GROUP BY ALL),
tt AS (SELECT event_id, COUNT(DISTINCT rep) AS tot FROM v GROUP BY event_id),
r AS (SELECT g.*, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY n DESC, last_seen DESC, cand) AS rn, MAX(CASE WHEN cand = subject THEN n ELSE 0 END) OVER (PARTITION BY event_id) AS sn FROM g),
w AS (SELECT r.*, tt.tot, CAST(FLOOR(r.n * 100.0 / tt.tot) AS BIGINT) AS conf, CAST(levenshtein(subject, cand) AS BIGINT) AS dist FROM r JOIN tt ON r.event_id = tt.event_id WHERE rn = 1),
decisions AS (SELECT event_id, t, freq_khz, subject, cand AS winner, n AS winner_support, sn AS subject_support, tot AS total, conf, dist AS distance,
  CASE WHEN cand = subject THEN 'no_winner' WHEN dist > 3 THEN 'max_edit_distance' WHEN n < 6 THEN 'min_reports' WHEN n < sn + 1 THEN 'advantage' WHEN conf < 60 THEN 'confidence' ELSE '' END AS reason,
  CASE WHEN cand = subject OR dist > 3 OR n < 6 OR n < sn + 1 OR conf < 60 THEN 'rejected' ELSE 'applied' END AS decision FROM w)"""
)


def _decided(body: str) -> str:
    return SPOTS_SQL + _DECISIONS_SQL + body


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.votes(spots(spark, sf_dir), CONSENSUS)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = correction.decide(correction.tallies(correction.votes(spots(spark, sf_dir), CONSENSUS)), CONSENSUS)
    return d.select("event_id", "t", "freq_khz", "subject", "winner", "winner_support", "subject_support", "total", "conf", "distance", "decision", "reason")


def _judged(s: DataFrame) -> DataFrame:
    """What corrections and glyphs read of the decisions, stored: the votes are joined and counted once."""
    return stored(correction.decide(correction.tallies(correction.votes(s, CONSENSUS)), CONSENSUS).select("event_id", "subject", "winner", "decision", "total", "subject_support"), "decisions")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions as a stored log, for what reads them more than once."""
    return stored(_decisions(spark, sf_dir), "decisions")


# ---- projections and scalar functions


@_query(_sql(f" SELECT event_id, t, freq_khz, {_BAND_SQL} AS band, de_call, dx_call, report, mode, is_human FROM spots"))
def spots_projection(spark, sf_dir):
    return spots(spark, sf_dir).select("event_id", "t", "freq_khz", radio.band("freq_khz").alias("band"), "de_call", "dx_call", "report", "mode", "is_human")


_WIDE = "freq_khz * (1 + k % 23)"


@_query(_sql(f", x AS (SELECT {_WIDE} AS freq_khz FROM spots) SELECT {_BAND_SQL} AS band, {_REPORT_BAND_SQL} AS report_band, COUNT(*) AS n FROM x GROUP BY ALL"))
def band_counts(spark, sf_dir):
    x = spots(spark, sf_dir).select((F.col("freq_khz") * (1 + F.col("k") % 23)).alias("freq_khz"))
    return x.groupBy(radio.band("freq_khz").alias("band"), radio.report_band("freq_khz").alias("report_band")).agg(F.count("*").alias("n"))


@_query(_sql(" SELECT mode, CASE WHEN mode IN ('FT8', 'FT4') THEN mode ELSE 'RBN' END AS source_type, COUNT(*) AS n FROM spots GROUP BY ALL"))
def mode_source_counts(spark, sf_dir):
    return spots(spark, sf_dir).groupBy("mode", radio.source_type("mode").alias("source_type")).agg(F.count("*").alias("n"))


@_query(_sql(", x AS (SELECT event_id, lower(dx_call) || CASE k % 4 WHEN 0 THEN '.P' WHEN 1 THEN '/' WHEN 2 THEN '/B' ELSE '-!' END AS raw FROM spots), y AS (SELECT event_id, trim(regexp_replace(replace(upper(trim(raw)), '.', '/'), '/$', '')) AS call FROM x) SELECT event_id, call, length(call) BETWEEN 3 AND 10 AND regexp_matches(call, '[0-9]') AND regexp_matches(call, '^[A-Z0-9]+(?:[/-][A-Z0-9#]+)*$') AS valid, ends_with(call, '/B') AS beacon FROM y"))
def call_normalize_valid(spark, sf_dir):
    k = F.col("k") % 4
    raw = F.concat(F.lower("dx_call"), F.when(k == 0, ".P").when(k == 1, "/").when(k == 2, "/B").otherwise("-!"))
    x = spots(spark, sf_dir).select("event_id", radio.normal_call(raw).alias("call"))
    return x.select("event_id", "call", radio.valid_call("call").alias("valid"), radio.is_beacon("call", F.lit("")).alias("beacon"))


@_query(_sql(""", x AS (SELECT event_id, CASE k % 4 WHEN 0 THEN dx_call || '/' || 'W' || CAST(k % 10 AS VARCHAR) WHEN 1 THEN 'VE3/' || dx_call || '/P' WHEN 2 THEN dx_call || '-1-#' ELSE dx_call END AS call FROM spots),
p AS (SELECT event_id, call, string_split(regexp_replace(call, '-#$', ''), '/') AS ps FROM x), u AS (SELECT event_id, call, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM p)
SELECT event_id, call, regexp_replace(arg_min(p, CASE WHEN regexp_matches(p, '[0-9]') THEN -length(p) * 100 + i ELSE 100000 + i END), '^(.+?)-.*$', '\\1') AS base FROM u GROUP BY event_id, call"""))
def license_base_call(spark, sf_dir):
    k, dx = F.col("k"), F.col("dx_call")
    call = F.when(k % 4 == 0, F.concat(dx, F.lit("/W"), (k % 10).cast("string"))).when(k % 4 == 1, F.concat(F.lit("VE3/"), dx, F.lit("/P"))).when(k % 4 == 2, F.concat(dx, F.lit("-1-#"))).otherwise(dx)
    return spots(spark, sf_dir).select("event_id", call.alias("call")).withColumn("base", radio.base_call("call"))


@_query(_sql(", x AS (SELECT event_id, CASE k % 3 WHEN 0 THEN 'cq ' || CAST(report AS VARCHAR) || ' dB test' WHEN 1 THEN 'up -' || CAST(k AS VARCHAR) || 'dB 22 WPM' ELSE 'no report' END AS comment FROM spots) SELECT event_id, COALESCE(TRY_CAST(NULLIF(regexp_extract(comment, '([-+]?\\d{1,3})\\s*[dD][bB]', 1), '') AS INTEGER), 0) AS report, regexp_extract(comment, '([-+]?\\d{1,3})\\s*[dD][bB]', 1) <> '' AS has_report FROM x"))
def snr_extract(spark, sf_dir):
    k = F.col("k")
    comment = F.when(k % 3 == 0, F.concat(F.lit("cq "), F.col("report").cast("string"), F.lit(" dB test"))).when(k % 3 == 1, F.concat(F.lit("up -"), k.cast("string"), F.lit("dB 22 WPM"))).otherwise("no report")
    return spots(spark, sf_dir).select("event_id", F.coalesce(radio.snr(comment), F.lit(0)).alias("report"), radio.snr(comment).isNotNull().alias("has_report"))


@_query(_sql(""", x AS (SELECT *, printf('%.1f', freq_khz) AS f, printf('%02d%02d', CAST(t // 60 % 24 AS INTEGER), CAST(t % 60 AS INTEGER)) AS hm, 'CQ TEST ' || repeat('X', CAST(k % 30 AS INTEGER)) AS note FROM spots),
y AS (SELECT *, 'DX de ' || de_call[1:18 - length(f)] || ':' AS s FROM x),
z AS (SELECT *, rpad(s || lpad(f, CAST(25 - length(s) AS INTEGER), ' ') || '  ' || dx_call[1:12], 39, ' ') || mode || ' ' || CASE WHEN mode NOT IN ('CW', 'RTTY') AND report >= 0 THEN '+' ELSE '' END || CAST(report AS VARCHAR) || ' dB ' || note AS body FROM y)
SELECT event_id, rpad(body[1:65], 66, ' ') || 'FN' || CAST(k % 90 + 10 AS VARCHAR) || ' V ' || hm || 'Z' AS line FROM z"""))
def fixed_width_line(spark, sf_dir):
    t, k = F.col("t"), F.col("k")
    hhmm = F.format_string("%02d%02d", F.floor(t / 60) % 24, t % 60)
    note = F.concat(F.lit("CQ TEST "), F.repeat(F.lit("X"), (k % 30).cast("int")))
    grid = F.concat(F.lit("fn"), (k % 90 + 10).cast("string"), F.lit("aa"))
    return spots(spark, sf_dir).select("event_id", radio.fixed_line("de_call", "freq_khz", "dx_call", "mode", "report", note, grid, F.lit("V"), hhmm).alias("line"))


# ---- lookups

_PREFIXES = [("K", "US", 291), ("K1", "US-1", 2911), ("K1AB8", "SPECIAL", 1), ("K3", "US-3", 2913), ("K7ABC", "CALL", 7), ("W", "US-W", 292)]
_PREFIX_SQL = ", p(prefix, country, padif) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _PREFIXES) + ")"


@_query(_sql(_PREFIX_SQL + ", c AS (SELECT DISTINCT dx_call FROM spots UNION ALL SELECT 'ZZ9ZZA'), m AS (SELECT c.dx_call, arg_max(p.prefix, length(p.prefix)) AS prefix, arg_max(p.country, length(p.prefix)) AS country, arg_max(p.padif, length(p.prefix)) AS padif FROM c JOIN p ON starts_with(c.dx_call, p.prefix) GROUP BY c.dx_call) SELECT s.event_id, s.dx_call, m.prefix, m.country, CAST(m.padif AS BIGINT) AS padif FROM spots s LEFT JOIN m ON s.dx_call = m.dx_call"))
def prefix_join(spark, sf_dir):
    table = spark.createDataFrame(_PREFIXES, "prefix string, country string, padif long")
    x = lookups.longest_prefix(spots(spark, sf_dir), "dx_call", table, rows=len(_PREFIXES))
    return x.select("event_id", "dx_call", F.col("entity.prefix").alias("prefix"), F.col("entity.country").alias("country"), F.col("entity.padif").alias("padif"))


_SKEW = [("W0S0", 1.000012), ("W1S1", 1.0), ("W5S35", 0.999987), ("W7S7", 1.00003)]


@_query(_sql(", sk(call, factor) AS (VALUES " + ", ".join(f"('{c}', {f}::DOUBLE)" for c, f in _SKEW) + ") SELECT event_id, CASE WHEN factor IS NOT NULL AND factor <> 1 THEN floor(freq_khz * factor * 10 + 0.5) / 10 ELSE freq_khz END AS freq_khz FROM spots LEFT JOIN sk ON de_call = call"))
def skew_apply(spark, sf_dir):
    return lookups.apply_skew(spots(spark, sf_dir), spark.createDataFrame(_SKEW, "call string, factor double"), rows=len(_SKEW)).select("event_id", "freq_khz")


@_query(_sql(", kn AS (SELECT DISTINCT dx_call FROM spots WHERE k % 2 = 0) SELECT s.event_id, kn.dx_call IS NOT NULL AS is_known FROM spots s LEFT JOIN kn ON s.dx_call = kn.dx_call"))
def known_semi(spark, sf_dir):
    s = spots(spark, sf_dir)
    return lookups.flag_known(s, s.where("k % 2 = 0").select(F.col("dx_call").alias("call"))).select("event_id", "is_known")


@_query(_sql(", lic AS (SELECT DISTINCT dx_call FROM spots WHERE user_id % 3 = 0) SELECT event_id, dx_call FROM spots WHERE adif <> 11 OR dx_call IN (SELECT dx_call FROM lic)"))
def unlicensed_anti(spark, sf_dir):
    s = spots(spark, sf_dir)
    return lookups.drop_unlicensed(s, s.where("user_id % 3 = 0").select(F.col("dx_call").alias("call")), "adif", "dx_call", us_adif=11).select("event_id", "dx_call")


@_query("SELECT l_orderkey, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY l_orderkey")
def uls_active_semi(spark, sf_dir):
    hd = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("E").alias("status"))
    am = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"))
    return lookups.active_calls(hd, am).groupBy(F.col("id").alias("l_orderkey")).agg(F.count("*").alias("n"))


_SEGMENTS = [(1, 14000.0, 14001.0, 14000.3, "SSB"), (2, 14000.8, 14350.0, 14000.9, "SSB")]


@_query(_sql(""", sg(pos, lo, hi, cw, voice) AS (VALUES (1, 14000.0::DOUBLE, 14001.0::DOUBLE, 14000.3::DOUBLE, 'SSB'), (2, 14000.8, 14350.0, 14000.9, 'SSB')),
m AS (SELECT s.event_id, arg_min(CASE WHEN s.freq_khz <= cw THEN 'CW' ELSE voice END, pos) AS a FROM spots s JOIN sg ON s.freq_khz BETWEEN lo AND hi GROUP BY s.event_id)
SELECT s.event_id, CASE WHEN m.a = 'SSB' THEN 'USB' ELSE COALESCE(m.a, 'USB') END AS mode FROM spots s LEFT JOIN m ON s.event_id = m.event_id"""))
def mode_range_join(spark, sf_dir):
    seg = spark.createDataFrame(_SEGMENTS, "pos int, lower_khz double, upper_khz double, cw_end_khz double, voice string")
    x = lookups.allotted_mode(spots(spark, sf_dir), seg)
    return x.select("event_id", radio.final_mode(F.lit(""), "freq_khz", "allotted").alias("mode"))


@_query(_sql(", x AS (SELECT dx_call AS call, CASE WHEN k % 5 = 0 THEN NULL ELSE 'FN' || CAST(k % 90 + 10 AS VARCHAR) END AS grid, t, CASE WHEN t >= (SELECT AVG(t) FROM spots) AND k % 7 = 0 THEN t - 100000 ELSE t END AS u FROM spots), m AS (SELECT AVG(t) AS a FROM spots) SELECT call, 0 AS is_known, COALESCE(arg_max(grid, u) FILTER (WHERE grid IS NOT NULL AND t >= a), arg_max(grid, u) FILTER (WHERE grid IS NOT NULL AND t < a)) AS grid, CAST(COUNT(*) AS BIGINT) AS observations, MIN(t) AS first_seen, MAX(u) AS updated_at FROM x, m GROUP BY call"))
def grid_merge(spark, sf_dir):
    k = F.col("k")
    grid = F.when(k % 5 != 0, F.concat(F.lit("FN"), (k % 90 + 10).cast("string")))
    s = spots(spark, sf_dir)
    new = s.select(F.col("dx_call").alias("call"), F.lit(0).alias("is_known"), grid.alias("grid"), F.lit(1).cast("long").alias("observations"), F.col("t").alias("first_seen"), F.col("t").alias("updated_at"), F.lit(None).cast("long").alias("expires_at"), k.alias("_k"))
    early = F.col("first_seen") < F.lit(s.agg(F.avg("t")).first()[0])  # the store holds the calls of the first half
    # some rows of the second half come late: their time lies before what is stored
    new = new.withColumn("updated_at", F.when(~early & (F.col("_k") % 7 == 0), F.col("updated_at") - 100000).otherwise(F.col("updated_at"))).drop("_k")
    return lookups.merge_calls(lookups.merge_calls(new.limit(0), new.where(early)), new.where(~early)).drop("expires_at")


@_query(_sql(", st AS (SELECT DISTINCT dx_call AS call, 'FN' || substr(dx_call, 2, 1) || '1' AS grid FROM spots WHERE k % 4 = 0) SELECT s.event_id, COALESCE(CASE WHEN k % 3 = 0 THEN 'JO22' END, st.grid) AS grid FROM spots s LEFT JOIN st ON s.dx_call = st.call"))
def grid_backfill(spark, sf_dir):
    s = spots(spark, sf_dir).withColumn("grid", F.when(F.col("k") % 3 == 0, "JO22"))
    store = s.where("k % 4 = 0").select(F.col("dx_call").alias("call"), F.concat(F.lit("FN"), F.substring("dx_call", 2, 1), F.lit("1")).alias("grid")).distinct()
    return lookups.backfill_grid(s, store, "dx_call", "grid").select("event_id", "grid")


@_query(_sql(", x AS (SELECT event_id, dx_call, t, 'FN' || CAST(k % 4 + 10 AS VARCHAR) AS grid FROM spots WHERE k % 5 <> 0), y AS (SELECT *, LAG(grid) OVER (PARTITION BY dx_call ORDER BY t, event_id) AS pg FROM x) SELECT event_id, grid FROM y WHERE pg IS NULL OR pg <> grid"))
def grid_changes(spark, sf_dir):
    s = spots(spark, sf_dir).withColumn("grid", F.when(F.col("k") % 5 != 0, F.concat(F.lit("FN"), (F.col("k") % 4 + 10).cast("string"))))
    return lookups.grid_changes(s, "dx_call", "grid").select("event_id", "grid")


# ---- duplicates


@_query(_sql(", x AS (SELECT *, MAX(report) OVER (PARTITION BY t // 60, CAST(FLOOR(freq_khz) AS BIGINT), substr(de_call, 1, 2), dx_call ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM spots) SELECT event_id, report FROM x WHERE pm IS NULL OR report > pm"))
def primary_dedup(spark, sf_dir):
    s = spots(spark, sf_dir).withColumns({"minute": F.floor(F.col("t") / 60), "khz": F.floor("freq_khz"), "de2": F.substring("de_call", 1, 2)})
    return dedup.primary(s, ["minute", "khz", "de2", "dx_call"]).select("event_id", "report")


_ANCHOR_SQL = """WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), """ + SPOTS_SQL.split("),\n", 1)[1] + """,
o AS (SELECT *, CAST(FLOOR(freq_khz) AS BIGINT) AS fk, adif % 5 AS zone, ROW_NUMBER() OVER (PARTITION BY CAST(FLOOR(freq_khz) AS BIGINT), adif % 5, dx_call ORDER BY t, event_id) AS rn FROM spots),
w AS (SELECT fk, zone, dx_call, rn, event_id, t AS wt, report AS snr, TRUE AS keep FROM o WHERE rn = 1
  UNION ALL SELECT o.fk, o.zone, o.dx_call, o.rn, o.event_id, CASE WHEN o.t - w.wt < 60 AND NOT o.report > w.snr THEN w.wt ELSE o.t END, CASE WHEN o.t - w.wt < 60 AND NOT o.report > w.snr THEN w.snr ELSE o.report END, NOT (o.t - w.wt < 60 AND NOT o.report > w.snr)
  FROM w JOIN o ON o.fk = w.fk AND o.zone = w.zone AND o.dx_call = w.dx_call AND o.rn = w.rn + 1)
SELECT event_id FROM w WHERE keep"""


@_query(_ANCHOR_SQL)
def secondary_dedup(spark, sf_dir):
    s = spots(spark, sf_dir).withColumns({"khz": F.floor("freq_khz"), "zone": F.col("adif") % 5})
    return dedup.secondary(s, ["khz", "zone", "dx_call"], 60).select("event_id")


@_query(_sql(", x AS (SELECT *, MAX(report) OVER (PARTITION BY t // 60, CAST(FLOOR(freq_khz) AS BIGINT), substr(de_call, 1, 2), dx_call ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM spots) SELECT COUNT(*) AS processed, COUNT(*) FILTER (WHERE NOT (pm IS NULL OR report > pm)) AS duplicates FROM x"))
def dedup_stats(spark, sf_dir):
    s = spots(spark, sf_dir).withColumns({"minute": F.floor(F.col("t") / 60), "khz": F.floor("freq_khz"), "de2": F.substring("de_call", 1, 2)})
    return dedup.stats(s, dedup.primary(s, ["minute", "khz", "de2", "dx_call"]))


# ---- consensus


@_query(_sql(_VOTES_SQL + " SELECT event_id, cand, COUNT(DISTINCT rep) AS n, MAX(bt) AS last_seen FROM v GROUP BY event_id, cand"))
def consensus_votes(spark, sf_dir):
    return correction.tallies(_votes(spark, sf_dir)).select("event_id", "cand", "n", "last_seen")


@_query(_decided(" SELECT * FROM decisions"))
def consensus_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir)


@_query(_decided(" SELECT decision, reason, distance, COUNT(*) AS n FROM decisions GROUP BY ALL"))
def decision_reasons(spark, sf_dir):
    return _decisions(spark, sf_dir).groupBy("decision", "reason", "distance").agg(F.count("*").alias("n"))


@_query(_sql(", wt AS (SELECT *, user_id % 4 <> 1 AS ok FROM spots), v AS (SELECT a.event_id, b.dx_call AS cand, b.de_call AS rep, b.ok FROM wt a JOIN wt b ON a.k % 20 = b.k % 20 AND b.t BETWEEN a.t - 360 AND a.t - 1 AND (b.de_call <> a.de_call OR b.dx_call = a.dx_call) UNION ALL SELECT event_id, dx_call, de_call, ok FROM wt) SELECT event_id, cand, COUNT(DISTINCT CASE WHEN ok THEN rep END) AS n, SUM(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS unreliable_votes FROM v GROUP BY event_id, cand"))
def reliability_floor(spark, sf_dir):
    s = spots(spark, sf_dir)
    weights = s.where("user_id % 4 = 1").select(F.col("de_call").alias("call"), F.lit(0.2).alias("weight")).distinct()
    set_ = Settings(**{**CONSENSUS.__dict__, "min_reliability": 0.5})
    v = correction.votes(lookups.reliability_of(s, weights), set_)
    return v.groupBy("event_id", "cand").agg(F.countDistinct(F.when(F.col("reliable"), F.col("rep"))).alias("n"), F.count_if(~F.col("reliable")).alias("unreliable_votes"))


_GLYPH_SQL = " SELECT d.event_id, CASE WHEN total <= 1 THEN CASE WHEN substr(subject, 3) = 'ABC' THEN 'S' ELSE '?' END WHEN FLOOR(subject_support * 100.0 / total) >= 51 THEN 'V' WHEN FLOOR(subject_support * 100.0 / total) >= 25 THEN 'P' ELSE '?' END AS glyph FROM decisions d"


@_query(_decided(_GLYPH_SQL))
def confidence_glyph(spark, sf_dir):
    return correction.glyphs(correction.tallies(_votes(spark, sf_dir)), F.substring("subject", 3, 10) == "ABC").select("event_id", "glyph")


@_query(_decided(", q AS (SELECT DISTINCT v.event_id, v.cand, v.freq_khz, d.winner FROM v JOIN decisions d ON v.event_id = d.event_id WHERE d.decision = 'applied') SELECT cand AS call, CAST(FLOOR(FLOOR(freq_khz * 1000 + 0.5) / 1000) AS BIGINT) AS bin, CAST(SUM(CASE WHEN cand = winner THEN 1 ELSE -1 END) AS BIGINT) AS score FROM q GROUP BY ALL"))
def quality_scores(spark, sf_dir):
    v = _votes(spark, sf_dir)
    return correction.quality_updates(v, correction.decide(correction.tallies(v), CONSENSUS))


@_query(_decided(" SELECT s.event_id, CASE WHEN d.decision = 'applied' AND s.mode IN ('CW', 'RTTY', 'SSB') THEN d.winner ELSE s.dx_call END AS dx_call FROM spots s JOIN decisions d ON s.event_id = d.event_id"))
def corrected_spots(spark, sf_dir):
    s = spots(spark, sf_dir)
    d = _judged(s)
    out = correction.apply_to(s, d, correction.glyphs(d, F.lit(True)))
    return out.select("event_id", "dx_call")


# ---- signals


_HARMONIC_SQL = """, h AS (SELECT event_id, t, dx_call, report, CASE WHEN k % 3 = 0 THEN freq_khz * 2 WHEN k % 7 = 0 THEN freq_khz * 3 ELSE freq_khz END AS freq_khz FROM spots),
m AS (SELECT h.event_id, b.event_id AS bid, b.report - h.report AS delta, b.freq_khz AS fundamental, mu.multiple FROM h JOIN h b ON h.dx_call = b.dx_call AND b.t // 4 <= h.t // 4 AND b.event_id < h.event_id AND h.t // 4 - b.t // 4 <= 120 AND b.freq_khz < h.freq_khz
  JOIN (SELECT unnest([2, 3, 4]) AS multiple) mu ON abs(b.freq_khz * mu.multiple - h.freq_khz) <= 0.025 + 1e-9 WHERE b.report - h.report >= 6),
x AS (SELECT event_id, MIN(bid) AS bid FROM m GROUP BY event_id)
SELECT x.event_id, f.fundamental, f.multiple, f.delta, (SELECT COUNT(*) FROM m WHERE m.event_id = x.event_id AND abs(m.fundamental - f.fundamental) <= 0.025 + 1e-9) AS corroborators FROM x JOIN m f ON f.event_id = x.event_id AND f.bid = x.bid"""


@_query(_sql(_HARMONIC_SQL))
def harmonics(spark, sf_dir):
    """Four spots a second, as a feed of one-second times has them."""
    k, f = F.col("k"), F.col("freq_khz")
    s = spots(spark, sf_dir).withColumns({"freq_khz": F.when(k % 3 == 0, f * 2).when(k % 7 == 0, f * 3).otherwise(f), "t": F.floor(F.col("t") / 4)})
    return signals.harmonics(s).select("event_id", "fundamental", "multiple", F.col("delta").cast("long").alias("delta"), "corroborators")


@_query(_sql(""", x AS (SELECT a.event_id, a.freq_khz, COUNT(*) AS n, SUM(CAST(FLOOR(b.freq_khz * 10 + 0.5) AS BIGINT)) AS s FROM spots a JOIN spots b ON a.dx_call = b.dx_call AND b.t // 4 >= a.t // 4 - 150 AND b.event_id <= a.event_id AND abs(CAST(FLOOR(b.freq_khz * 10 + 0.5) AS BIGINT) - CAST(FLOOR(a.freq_khz * 10 + 0.5) AS BIGINT)) <= 3 GROUP BY ALL),
y AS (SELECT *, CAST(s AS DOUBLE) / n / 10 AS mean_khz FROM x) SELECT event_id, n, mean_khz, floor(mean_khz * 10 + 0.5) / 10 AS new_khz, n >= 2 AND abs(floor(mean_khz * 10 + 0.5) / 10 - freq_khz) >= 0.05 AS applied FROM y"""))
def freq_average(spark, sf_dir):
    return signals.average_frequency(spots(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 4)), window=150)


_GROUPS = [("hf", "20m"), ("hf", "10m"), ("vhf", "6m"), ("night", "160m")]
_GROUP_SQL = f""", b AS (SELECT t, de_call, CASE WHEN k % 2 = 0 THEN '20m' WHEN k % 4 = 1 THEN '10m' ELSE '6m' END AS band FROM spots), slots AS (SELECT unnest(range((SELECT MIN(t) // 600 FROM b), (SELECT MAX(t) // 600 FROM b) + 1)) AS slot),
gr(grp, band) AS (VALUES {", ".join(f"('{g}', '{b}')" for g, b in _GROUPS)}),
c AS (SELECT s.slot, gr.grp, gr.band, COUNT(DISTINCT b.de_call) AS n FROM slots s CROSS JOIN gr LEFT JOIN b ON b.band = gr.band AND b.t < (s.slot + 1) * 600 AND b.t >= (s.slot + 1) * 600 - 900 GROUP BY ALL),
a AS (SELECT slot, grp, CAST(SUM(n) AS DOUBLE) / COUNT(*) AS mean_reporters FROM c GROUP BY slot, grp)"""


def _grouped(spark, sf_dir):
    k = F.col("k")
    s = spots(spark, sf_dir).withColumn("freq_khz", F.when(k % 2 == 0, 14010.0).when(k % 4 == 1, 28010.0).otherwise(50010.0))
    return signals.active_reporters(s, spark.createDataFrame(_GROUPS, "grp string, band string"), 600, 900)


@_query(_sql(_GROUP_SQL + " SELECT * FROM a"))
def adaptive_reporters(spark, sf_dir):
    """Windows of 15 minutes that slide by ten; one group has no reporters at all."""
    return _grouped(spark, sf_dir)


_STATE_SQL = _GROUP_SQL + """, r AS (SELECT *, CASE WHEN mean_reporters < 70 THEN 'quiet' WHEN mean_reporters > 93 THEN 'busy' ELSE 'normal' END AS raw_state FROM a),
f AS (SELECT *, CASE WHEN LAG(raw_state) OVER (PARTITION BY grp ORDER BY slot) = raw_state THEN raw_state END AS st FROM r),
st AS (SELECT slot, grp, raw_state, COALESCE(LAST_VALUE(st IGNORE NULLS) OVER (PARTITION BY grp ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'normal') AS state FROM f)"""


def _states(spark, sf_dir):
    return signals.hysteresis(_grouped(spark, sf_dir).select("slot", "grp", signals.state_of("mean_reporters", 70, 93).alias("raw_state")))


@_query(_sql(_STATE_SQL + " SELECT * FROM st"))
def adaptive_state(spark, sf_dir):
    return _states(spark, sf_dir)


@_query(_sql(_STATE_SQL + " SELECT slot, CASE MAX(CASE state WHEN 'busy' THEN 2 WHEN 'normal' THEN 1 ELSE 0 END) WHEN 2 THEN 'busy' WHEN 1 THEN 'normal' ELSE 'quiet' END AS state FROM st GROUP BY slot"))
def highest_state(spark, sf_dir):
    return signals.highest_state(_states(spark, sf_dir))


_LEVELS = {"hf": {"quiet": 2, "normal": 4, "busy": 6}, "vhf": {"quiet": 1, "normal": 3, "busy": 5}, "night": {"quiet": 2, "normal": 2, "busy": 2}}


@_query(_sql(_STATE_SQL + ", lv(grp, state, n) AS (VALUES " + ", ".join(f"('{g}', '{state}', {n})" for g, of in _LEVELS.items() for state, n in of.items()) + """),
s AS (SELECT event_id, t, CASE WHEN k % 2 = 0 THEN 'hf' WHEN k % 4 = 1 THEN 'hf' ELSE 'vhf' END AS grp FROM spots WHERE mode IN ('CW', 'RTTY')), n AS (SELECT s.event_id, s.grp, COALESCE(st.state, 'normal') AS state FROM s LEFT JOIN st ON st.grp = s.grp AND st.slot = s.t // 600 - 1)
SELECT n.event_id, CAST(lv.n AS INTEGER) AS min_reports FROM n JOIN lv ON lv.grp = n.grp AND lv.state = n.state"""))
def adaptive_thresholds(spark, sf_dir):
    k = F.col("k")
    s = spots(spark, sf_dir).withColumn("freq_khz", F.when(k % 2 == 0, 14010.0).when(k % 4 == 1, 28010.0).otherwise(50010.0))
    return correction.adaptive_min_reports(s, _states(spark, sf_dir), spark.createDataFrame(_GROUPS, "grp string, band string"), _LEVELS)


@_query(_sql(_STATE_SQL + """, s AS (SELECT event_id, CASE WHEN k % 2 = 0 THEN '20m' WHEN k % 4 = 1 THEN '10m' ELSE '6m' END AS band, t // 600 - 1 AS slot FROM spots), n AS (SELECT s.event_id, s.band, COALESCE(st.state, 'normal') AS state FROM s LEFT JOIN gr ON gr.band = s.band LEFT JOIN st ON st.grp = gr.grp AND st.slot = s.slot)
SELECT event_id, CASE WHEN band = '20m' AND state = 'quiet' THEN 900.0::DOUBLE WHEN band = '6m' AND state = 'busy' THEN 200.0 ELSE 500.0 END AS tolerance_hz, CASE WHEN band = '20m' AND state = 'quiet' THEN 2000 WHEN band = '20m' AND state = 'normal' THEN 500 ELSE 1000 END AS quality_bin_hz FROM n"""))
def band_state_overrides(spark, sf_dir):
    k = F.col("k")
    s = spots(spark, sf_dir).withColumn("freq_khz", F.when(k % 2 == 0, 14010.0).when(k % 4 == 1, 28010.0).otherwise(50010.0))
    over = [("20m", "quiet", 900.0, 2000), ("20m", "normal", 0.0, 500), ("6m", "busy", 200.0, 0)]
    return correction.band_state_params(s, _states(spark, sf_dir), spark.createDataFrame(_GROUPS, "grp string, band string"), over, Settings()).select("event_id", "tolerance_hz", "quality_bin_hz")


@_query("WITH c AS (SELECT CAST(FLOOR(epoch(ts) / 60) AS BIGINT) AS minute, COUNT(*) AS n FROM events GROUP BY 1) SELECT a.minute, a.n, CAST(SUM(b.n) AS DOUBLE) / 15 AS rate, CAST(SUM(b.n) AS DOUBLE) / 15 > 0.4 AS busy FROM c a JOIN c b ON b.minute BETWEEN a.minute - 14 AND a.minute GROUP BY a.minute, a.n")
def rate_busy_quiet(spark, sf_dir):
    return signals.rates(spark.read.parquet(f"{sf_dir}/events.parquet"), busy_above=0.4)


@_query("WITH c AS (SELECT CAST(FLOOR(epoch(ts) / 60) AS BIGINT) AS minute, COUNT(*) AS n FROM events GROUP BY 1), r AS (SELECT a.minute, CAST(SUM(b.n) AS DOUBLE) / 15 > 0.45 AS busy FROM c a JOIN c b ON b.minute BETWEEN a.minute - 14 AND a.minute GROUP BY a.minute) SELECT minute, CASE WHEN BOOL_OR(busy) OVER (ORDER BY minute ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) THEN 'busy' ELSE 'quiet' END AS state FROM r")
def activity_states(spark, sf_dir):
    return signals.activity(signals.rates(spark.read.parquet(f"{sf_dir}/events.parquet"), busy_above=0.45), 3).select("minute", "state")


@_query("WITH h AS (SELECT event_type, CAST(FLOOR(epoch(ts) / 3600) AS BIGINT) AS hour, COUNT(*) * (1 + user_id * 0)::BIGINT AS c FROM events GROUP BY event_type, 2, user_id * 0) SELECT event_type, hour, c, CASE WHEN LAG(c) OVER w IS NOT NULL AND c >= LAG(c) OVER w THEN c - LAG(c) OVER w ELSE c END AS delta FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)")
def counter_delta(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return signals.counter_deltas(e.groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("c")), "event_type", "hour", "c")


@_query(_sql(", n AS (SELECT *, CAST(FLOOR(freq_khz * 10 + 0.5) AS BIGINT) AS bin FROM spots WHERE freq_khz BETWEEN 14000.5 AND 14001.5), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY mode, bin ORDER BY t DESC, event_id DESC) AS rn FROM n) SELECT event_id, mode, bin FROM r WHERE rn <= 50"))
def bandmap_window(spark, sf_dir):
    return signals.band_map(spots(spark, sf_dir), 14001.0, 0.5).select("event_id", "mode", "bin")


# ---- filters and commands


def _wide(s: DataFrame) -> DataFrame:
    """The columns that filters test."""
    k = F.col("k")
    cont = F.element_at(F.array(*[F.lit(c) for c in radio.CONTINENTS]), ((k % 7) + 1).cast("int"))
    return s.withColumns({
        "band": radio.band("freq_khz"), "source": F.when(F.col("is_human"), "HUMAN").otherwise("SKIMMER"), "dx_continent": cont, "de_continent": F.lit("NA"), "dx_zone": (k % 41).cast("int"), "de_zone": F.lit(5),
        "dx_adif": F.col("adif").cast("int"), "de_adif": F.lit(291), "dx_grid2": F.when(k % 6 > 0, F.lit("FN")).otherwise(""), "de_grid2": F.lit("JO"), "confidence": F.when(k % 5 == 0, (k + 1).cast("string")).otherwise("V"), "is_beacon": k % 11 == 0,
    })


def _filter(*lines: str) -> filters.Filter:
    f = filters.OPEN
    for line in lines:
        f, reply = filters.command(f, line)
    return f


@_query(_sql(" SELECT event_id FROM spots WHERE mode IN ('CW', 'FT8') AND k % 41 NOT IN (0) AND k % 41 IN (3, 14, 15, 20) AND k % 7 <> 3 AND NOT (k % 11 = 0) AND k % 6 > 0"))
def filter_allow_block(spark, sf_dir):
    f = _filter("PASS MODE CW,FT8", "PASS DXZONE 3 14 15 20", "REJECT DXCONT EU", "REJECT BEACON", "PASS DXGRID2 FN")
    return _wide(spots(spark, sf_dir)).where(filters.compile_filter(f)).select("event_id")


@_query(_sql(" SELECT event_id FROM spots WHERE (starts_with(dx_call, 'K1') OR ends_with(dx_call, 'AB8') OR dx_call = 'K3ABC') AND NOT starts_with(de_call, 'W2')"))
def filter_patterns(spark, sf_dir):
    f = _filter("PASS DXCALL K1*,*AB8,K3ABC", "REJECT DECALL W2*")
    return _wide(spots(spark, sf_dir)).where(filters.compile_filter(f)).select("event_id")


@_query(_sql(" SELECT event_id FROM spots WHERE mode IN ('FT8', 'FT4') OR (k % 5 = 0 AND k + 1 > 25 AND k + 1 <= 75)"))
def filter_confidence(spark, sf_dir):
    return _wide(spots(spark, sf_dir)).where(filters.compile_filter(_filter("PASS CONFIDENCE P"))).select("event_id")


@_query(_sql(" SELECT 'K3ABC' AS subscriber, event_id FROM spots WHERE dx_call = 'K3ABC' OR mode = 'CW' UNION ALL SELECT 'W1AW', event_id FROM spots WHERE dx_call = 'W1AW' OR k % 7 <> 3 AND mode <> 'FT8' UNION ALL SELECT 'N0NE', event_id FROM spots WHERE dx_call = 'N0NE'"))
def subscribers_theta(spark, sf_dir):
    subs = [("K3ABC", _filter("PASS MODE CW")), ("W1AW", _filter("REJECT DXCONT EU", "REJECT MODE FT8")), ("N0NE", _filter("REJECT BAND ALL"))]
    return filters.deliver(_wide(spots(spark, sf_dir)), subs).select("subscriber", "event_id")


@_query(_sql(" SELECT event_id, dx_call, freq_khz FROM spots ORDER BY event_id DESC LIMIT 25"))
def show_dx(spark, sf_dir):
    return filters.show_dx(spots(spark, sf_dir), 25).select("event_id", "dx_call", "freq_khz")


@_query(_sql(" SELECT mode, COUNT(*) AS n FROM spots WHERE freq_khz BETWEEN 14000.2 AND 14001.1 GROUP BY mode"))
def modes_in_range(spark, sf_dir):
    return spots(spark, sf_dir).where("freq_khz between 14000.2D and 14001.1D").groupBy("mode").agg(F.count("*").alias("n"))


@_query(_sql(" SELECT mode, is_human, COUNT(*) AS n FROM spots GROUP BY ALL"))
def union_sources(spark, sf_dir):
    s = spots(spark, sf_dir)
    return s.where("is_human").unionByName(s.where("not is_human")).groupBy("mode", "is_human").agg(F.count("*").alias("n"))


# ---- decision-log analytics

_STABLE_SQL = """, fo AS (SELECT d.event_id, COUNT(s.event_id) AS n FROM decisions d LEFT JOIN spots s ON s.dx_call = d.winner AND s.t BETWEEN d.t AND d.t + 300 AND abs(s.freq_khz - d.freq_khz) <= 0.5 + 1e-9 WHERE d.decision = 'applied' GROUP BY d.event_id),
fl AS (SELECT d.*, fo.n, fo.n >= 3 AS stable FROM decisions d JOIN fo ON d.event_id = fo.event_id)"""
_REF_SQL = ", ref AS (SELECT event_id AS row, t, freq_khz, dx_call AS subject, CASE WHEN user_id % 7 = 0 THEN 'K9XYZ' ELSE substr(dx_call, 1, 2) || 'ABC' END AS correct FROM spots WHERE event_id % 17 = 0 AND substr(dx_call, 3) <> 'ABC')"


def _reference(spark, sf_dir):
    dx = F.col("dx_call")
    correct = F.when(F.col("user_id") % 7 == 0, "K9XYZ").otherwise(F.concat(F.substring(dx, 1, 2), F.lit("ABC")))
    return spots(spark, sf_dir).where((F.col("event_id") % 17 == 0) & (F.substring(dx, 3, 10) != "ABC")).select(F.col("event_id").alias("row"), "t", "freq_khz", dx.alias("subject"), correct.alias("correct"))


@_query(_decided(" SELECT MIN(t) AS min_t, MAX(t) AS max_t, COUNT(*) AS decisions, COUNT(*) FILTER (WHERE decision = 'applied') AS applied, COUNT(DISTINCT CASE WHEN decision = 'applied' THEN subject || '>' || winner END) AS applied_pairs, CAST(COUNT(DISTINCT CASE WHEN decision = 'applied' THEN subject || '>' || winner END) AS DOUBLE) / COUNT(*) FILTER (WHERE decision = 'applied') AS oscillation FROM decisions"))
def daily_summary(spark, sf_dir):
    return analytics.summary(_decisions(spark, sf_dir))


@_query(_decided(" SELECT reason, COUNT(*) AS n FROM decisions WHERE decision = 'rejected' GROUP BY reason"))
def reject_reasons(spark, sf_dir):
    return analytics.reject_reasons(_decisions(spark, sf_dir))


@_query(_decided(" SELECT COUNT(*) FILTER (WHERE reason = 'confidence') AS confidence_rejects, COUNT(*) FILTER (WHERE reason = 'confidence' AND distance <= 2 AND conf BETWEEN 55 AND 59) AS near_d2, COUNT(*) FILTER (WHERE reason = 'confidence' AND distance = 3 AND conf BETWEEN 60 AND 64) AS near_d3 FROM decisions"))
def headroom(spark, sf_dir):
    return analytics.headroom(_decisions(spark, sf_dir))


@_query(_decided(_REF_SQL + f", x AS (SELECT r.*, EXISTS (SELECT 1 FROM decisions d WHERE d.decision = 'applied' AND d.subject = r.subject AND d.winner = r.correct) AS hit, EXISTS (SELECT 1 FROM decisions d WHERE d.subject = r.subject) AS seen FROM ref r) SELECT {_REPORT_BAND_SQL} AS band, COUNT(*) AS total, COUNT(*) FILTER (WHERE hit) AS matched, COUNT(*) FILTER (WHERE NOT hit AND seen) AS present_miss, COUNT(*) FILTER (WHERE NOT hit AND NOT seen) AS absent FROM x GROUP BY 1"))
def recall_by_band(spark, sf_dir):
    return analytics.recall_by_band(_reference(spark, sf_dir), _log(spark, sf_dir))


@_query(_decided(_REF_SQL + ", p AS (SELECT DISTINCT subject, correct FROM ref), x AS (SELECT COUNT(*) AS pairs, COUNT(*) FILTER (WHERE EXISTS (SELECT 1 FROM decisions d WHERE d.decision = 'applied' AND d.subject = p.subject AND d.winner = p.correct)) AS matched FROM p) SELECT pairs, matched, CAST(matched AS DOUBLE) * 100 / pairs AS recall FROM x"))
def pair_recall(spark, sf_dir):
    return analytics.pair_recall(_reference(spark, sf_dir), _log(spark, sf_dir))


@_query(_decided(_STABLE_SQL + " SELECT (SELECT MIN(t) FROM fl) + ((t - (SELECT MIN(t) FROM fl)) // 900) * 900 AS bucket_start, COUNT(*) AS total, COUNT(*) FILTER (WHERE stable) AS stable, CAST(COUNT(*) FILTER (WHERE stable) AS DOUBLE) * 100 / COUNT(*) AS percent FROM fl GROUP BY 1"))
def stability_bucket(spark, sf_dir):
    return analytics.stability_by_bucket(analytics.follow_on(_log(spark, sf_dir), spots(spark, sf_dir), 300, least=3), 900)


_HORIZONS = (60, 300, 900)


@_query(_decided(", h(horizon) AS (VALUES " + ", ".join(f"({h})" for h in _HORIZONS) + "), fh AS (SELECT h.horizon, d.event_id, COUNT(s.event_id) AS n FROM decisions d CROSS JOIN h LEFT JOIN spots s ON s.dx_call = d.winner AND s.t BETWEEN d.t AND d.t + h.horizon AND abs(s.freq_khz - d.freq_khz) <= 0.5 + 1e-9 WHERE d.decision = 'applied' GROUP BY h.horizon, d.event_id) SELECT horizon, COUNT(*) AS total, COUNT(*) FILTER (WHERE n >= 3) AS stable, CAST(COUNT(*) FILTER (WHERE n >= 3) AS DOUBLE) * 100 / COUNT(*) AS percent FROM fh GROUP BY horizon"))
def stability_horizons(spark, sf_dir):
    return analytics.stability_by_horizon(_log(spark, sf_dir), spots(spark, sf_dir), list(_HORIZONS), least=3)


@_query(_decided(_STABLE_SQL + f" SELECT {_REPORT_BAND_SQL} AS band, COUNT(*) AS total, COUNT(*) FILTER (WHERE stable) AS stable, CAST(COUNT(*) FILTER (WHERE stable) AS DOUBLE) * 100 / COUNT(*) AS percent FROM fl GROUP BY 1"))
def stability_band(spark, sf_dir):
    return analytics.stability_by_band(analytics.follow_on(_log(spark, sf_dir), spots(spark, sf_dir), 300, least=3))


_AGAIN_SQL = """, ag AS (SELECT a.event_id, a.distance, COUNT(b.event_id) > 0 AS winner_again, COALESCE(BOOL_OR(b.subject = a.subject OR b.winner = a.subject), FALSE) AS subject_again
  FROM decisions a LEFT JOIN decisions b ON b.t > a.t AND b.t <= a.t + 600 AND (b.subject = a.winner OR b.winner = a.winner) WHERE a.decision = 'applied' GROUP BY a.event_id, a.distance)"""


@_query(_decided(_AGAIN_SQL + " SELECT distance, COUNT(*) AS total, COUNT(*) FILTER (WHERE winner_again AND NOT subject_again) AS stable, CAST(COUNT(*) FILTER (WHERE winner_again AND NOT subject_again) AS DOUBLE) * 100 / COUNT(*) AS percent FROM ag GROUP BY distance"))
def m1a_stability(spark, sf_dir):
    return analytics.stability_by_distance(analytics.reappearance(_log(spark, sf_dir), 600))


@_query(_decided(" SELECT distance, COUNT(*) AS total, COUNT(*) FILTER (WHERE decision = 'applied') AS applied, COUNT(*) FILTER (WHERE decision <> 'applied') AS rejected, CAST(SUM(conf) FILTER (WHERE decision = 'applied') AS DOUBLE) / COUNT(*) FILTER (WHERE decision = 'applied') AS mean_conf, median(conf) FILTER (WHERE decision = 'applied') AS median_conf, CAST(COUNT(*) FILTER (WHERE decision = 'applied') AS DOUBLE) * 100 / COUNT(*) AS apply_rate FROM decisions WHERE distance BETWEEN 1 AND 3 GROUP BY distance"))
def m1c_by_distance(spark, sf_dir):
    return analytics.by_distance(_decisions(spark, sf_dir).where("distance between 1 and 3"))


@_query(_decided(", x AS (SELECT distance, reason, COUNT(*) AS n FROM decisions WHERE decision = 'rejected' GROUP BY ALL) SELECT distance, reason, n, CAST(n AS DOUBLE) * 100 / SUM(n) OVER (PARTITION BY distance) AS share FROM x"))
def m1c_reason_share(spark, sf_dir):
    return analytics.reason_share(_decisions(spark, sf_dir))


_GRID = [(5, 55), (6, 55), (6, 60), (4, 50), (8, 70)]


@_query(_decided(", cells(min_reports, min_conf) AS (VALUES " + ", ".join(map(str, _GRID)) + """), y AS (SELECT *, winner_support >= min_reports AND winner_support - subject_support >= CASE WHEN distance = 3 THEN 2 ELSE 1 END AND conf >= min_conf + CASE WHEN distance = 3 THEN 5 ELSE 0 END AS ok
  FROM decisions CROSS JOIN cells WHERE winner <> subject AND distance <= 3)
SELECT min_reports, min_conf, COUNT(*) FILTER (WHERE ok) AS passed, COUNT(*) FILTER (WHERE ok AND decision = 'rejected') AS rescued, COUNT(*) FILTER (WHERE ok AND decision = 'rejected' AND distance = 1) AS rescued_d1, COUNT(*) FILTER (WHERE ok AND decision = 'rejected' AND distance = 2) AS rescued_d2,
  COUNT(*) FILTER (WHERE ok AND decision = 'rejected' AND distance = 3) AS rescued_d3 FROM y GROUP BY ALL"""))
def simulate_threshold(spark, sf_dir):
    return analytics.simulate(_decisions(spark, sf_dir), _GRID)


@_query(_decided(""", cells(scenario, reports, advantage, confidence) AS (VALUES ('current', 3, 2, 65), ('relaxed advantage', 3, 1, 65), ('relaxed confidence', 3, 2, 63), ('relaxed both', 3, 1, 63), ('strict', 4, 2, 65), ('very strict', 4, 3, 67)),
xx AS (SELECT *, winner_support - subject_support AS adv FROM decisions CROSS JOIN cells WHERE distance = 3), y AS (SELECT *, winner_support >= reports AND adv >= advantage AND conf >= confidence AS ok FROM xx)
SELECT scenario, COUNT(*) FILTER (WHERE ok) AS passed, COUNT(*) FILTER (WHERE ok AND decision <> 'applied') AS rescued, COUNT(*) FILTER (WHERE NOT ok AND decision = 'applied') AS lost, MIN(adv) FILTER (WHERE ok) AS least_adv, CAST(SUM(adv) FILTER (WHERE ok) AS DOUBLE) / COUNT(*) FILTER (WHERE ok) AS mean_adv FROM y GROUP BY scenario"""))
def d3_scenarios(spark, sf_dir):
    return analytics.distance3_scenarios(_decisions(spark, sf_dir))


@_query(_decided(" SELECT event_id, decision, conf, winner_support - subject_support AS advantage, CAST(winner_support AS DOUBLE) * 100 / total AS winner_share, CAST(subject_support AS DOUBLE) * 100 / total AS subject_share FROM decisions WHERE distance = 3"))
def d3_list(spark, sf_dir):
    # stored: a sort reads its input twice, once to cut it into ranges
    return analytics.distance3_list(stored(_decisions(spark, sf_dir).where("distance = 3"), "distance3")).select("event_id", "decision", "conf", "advantage", "winner_share", "subject_share")


@_query(_decided(""", x AS (SELECT COUNT(*) FILTER (WHERE decision = 'applied' AND distance = 1) AS a1, COUNT(*) FILTER (WHERE distance = 1) AS n1, COUNT(*) FILTER (WHERE decision = 'applied' AND distance = 3) AS a3, COUNT(*) FILTER (WHERE distance = 3) AS n3,
  CAST(SUM(conf) FILTER (WHERE decision = 'applied' AND distance = 1) AS DOUBLE) AS c1, CAST(SUM(conf) FILTER (WHERE decision = 'applied' AND distance = 3) AS DOUBLE) AS c3, COUNT(*) FILTER (WHERE decision = 'applied') AS a, COUNT(*) AS n FROM decisions WHERE distance BETWEEN 1 AND 3),
y AS (SELECT CAST(a1 AS DOUBLE) * 100 / n1 AS rate_d1, CAST(a3 AS DOUBLE) * 100 / n3 AS rate_d3, c1 / a1 AS conf_d1, c3 / a3 AS conf_d3 FROM x)
SELECT *, rate_d1 - rate_d3 AS rate_gap, conf_d1 - conf_d3 AS conf_gap, CASE WHEN rate_d1 - rate_d3 > 30 THEN 'conservative' ELSE 'balanced' END AS gap_class FROM y"""))
def d1_against_d3(spark, sf_dir):
    return analytics.distance_gap(_decisions(spark, sf_dir).where("distance between 1 and 3")).withColumn("gap_class", analytics.gap_class("rate_gap"))


_BOTH_SQL = """, m AS (SELECT a.event_id, b.subject AS call, b.freq_khz AS f, a.subject AS s, a.winner AS w, ROW_NUMBER() OVER (PARTITION BY a.event_id ORDER BY b.t, b.event_id) AS rn
  FROM decisions a JOIN decisions b ON b.t > a.t AND b.t <= a.t + 300 AND b.subject IN (a.subject, a.winner) WHERE a.decision = 'applied'),
x AS (SELECT event_id, arg_min(f, rn) FILTER (WHERE call = s) AS subject_khz, arg_min(f, rn) FILTER (WHERE call = w) AS winner_khz FROM m WHERE rn <= 100 GROUP BY event_id)
SELECT event_id, subject_khz, winner_khz, abs(subject_khz - winner_khz) AS gap_khz FROM x WHERE subject_khz IS NOT NULL AND winner_khz IS NOT NULL"""


@_query(_decided(_BOTH_SQL))
def reappearances(spark, sf_dir):
    return analytics.both_reappear(_log(spark, sf_dir), 300)


@_query(_decided(_BOTH_SQL.replace("\nSELECT event_id, subject_khz", ", gp AS (SELECT event_id, subject_khz").replace("winner_khz IS NOT NULL", "winner_khz IS NOT NULL)", 1) + " SELECT COUNT(*) AS pairs, COUNT(*) FILTER (WHERE gap_khz < 0.5) AS near, COUNT(*) FILTER (WHERE gap_khz >= 0.5) AS apart, CAST(COUNT(*) FILTER (WHERE gap_khz < 0.5) AS DOUBLE) * 100 / COUNT(*) AS near_percent FROM gp"))
def separation_classes(spark, sf_dir):
    return analytics.separation_classes(analytics.both_reappear(_log(spark, sf_dir), 300))


_MATCH_SQL = _REF_SQL + """, j AS (SELECT d.event_id, d.winner, r.row, r.correct FROM decisions d JOIN ref r ON r.subject = d.subject AND abs((r.t % 86400) // 60 - (d.t % 86400) // 60) <= 5 AND abs(r.freq_khz - d.freq_khz) <= 1.0 + 1e-9 WHERE d.decision = 'applied'),
b AS (SELECT event_id, winner, MIN(row) AS ref_row, arg_min(correct, row) AS correct FROM j GROUP BY event_id, winner),
mt AS (SELECT d.event_id, b.ref_row, CASE WHEN b.ref_row IS NULL THEN 'POSSIBLE_FALSE_POSITIVE' WHEN b.correct = d.winner THEN 'CORRECT_FIX' ELSE 'WRONG_FIX' END AS class FROM decisions d LEFT JOIN b ON d.event_id = b.event_id WHERE d.decision = 'applied')"""


@_query(_decided(_MATCH_SQL + " SELECT event_id, COALESCE(ref_row, -1) AS ref_row, class FROM mt"))
def reference_match(spark, sf_dir):
    m = analytics.match_reference(_log(spark, sf_dir), _reference(spark, sf_dir).withColumnRenamed("subject", "bad"))
    return m.withColumn("ref_row", F.coalesce("ref_row", F.lit(-1).cast("long")))


@_query(_decided(_MATCH_SQL + " SELECT row, subject AS bad, correct FROM ref WHERE row NOT IN (SELECT ref_row FROM mt WHERE ref_row IS NOT NULL)"))
def missed_reference(spark, sf_dir):
    r = _reference(spark, sf_dir).withColumnRenamed("subject", "bad")
    return analytics.missed_reference(r, analytics.match_reference(_log(spark, sf_dir), r)).select("row", "bad", "correct")


@_query(_decided(_MATCH_SQL + """, ms AS (SELECT COUNT(*) AS missed FROM ref WHERE row NOT IN (SELECT ref_row FROM mt WHERE ref_row IS NOT NULL)), c AS (SELECT COUNT(*) AS applied, COUNT(*) FILTER (WHERE class = 'CORRECT_FIX') AS correct, COUNT(*) FILTER (WHERE class = 'WRONG_FIX') AS wrong,
  COUNT(*) FILTER (WHERE class = 'POSSIBLE_FALSE_POSITIVE') AS possible_false FROM mt)
SELECT *, CASE WHEN applied > 0 THEN CAST(correct AS DOUBLE) * 100 / applied ELSE 0 END AS accuracy, CASE WHEN correct + wrong > 0 THEN CAST(correct AS DOUBLE) * 100 / (correct + wrong) ELSE 0 END AS precision, CASE WHEN correct + missed > 0 THEN CAST(correct AS DOUBLE) * 100 / (correct + missed) ELSE 0 END AS recall FROM c CROSS JOIN ms"""))
def precision(spark, sf_dir):
    r = _reference(spark, sf_dir).withColumnRenamed("subject", "bad")
    m = stored(analytics.match_reference(_log(spark, sf_dir), r), "matched")
    return analytics.precision(m, analytics.missed_reference(r, m))


@_query(_decided(" SELECT event_id, subject, winner, winner_support, conf, reason FROM decisions WHERE decision = 'rejected' AND winner <> subject ORDER BY winner_support DESC, conf DESC, event_id LIMIT 10"))
def top_rejections(spark, sf_dir):
    return analytics.top_rejections(_decisions(spark, sf_dir))


@_query(_decided(" SELECT subject, winner, COUNT(*) AS n FROM decisions WHERE decision = 'applied' GROUP BY ALL HAVING COUNT(*) > 10 ORDER BY n DESC, subject, winner LIMIT 20"))
def frequent_pairs(spark, sf_dir):
    return analytics.frequent_pairs(_decisions(spark, sf_dir))


# ---- keyed distances, feeds and streams


@_query()
def consensus_keyed_distance(spark, sf_dir):
    from .functions.distance import with_distance

    s = spots(spark, sf_dir)
    d = _decisions(spark, sf_dir).where("winner <> subject").select("event_id", "subject", "winner").join(s.select("event_id", "mode"), "event_id")
    return with_distance(d, "subject", "winner", "mode").groupBy("mode", "distance").agg(F.count("*").alias("n"))


@_query(_sql(" SELECT dx_call, de_call, freq_khz, mode, report, 'CQ ' || dx_call || 'X' AS comment, COUNT(*) AS n FROM spots GROUP BY ALL"))
def feed_lines(spark, sf_dir):
    from .sources.feeds import parse_lines

    s = spots(spark, sf_dir)
    line = F.concat(F.lit("DX de "), F.col("de_call"), F.lit(":  "), F.format_string("%.1f", F.col("freq_khz")), F.lit("  "), F.col("dx_call"), F.lit("  "), F.col("mode"), F.lit(" "), F.col("report").cast("string"), F.lit(" dB CQ "), F.col("dx_call"), F.lit("X 1200Z"))
    p = parse_lines(s.select(line.alias("value")), F.lit("2025-12-04 12:30:00").cast("timestamp"))
    return p.groupBy("dx_call", "de_call", "freq_khz", "mode", F.col("report").cast("long").alias("report"), "comment").agg(F.count("*").alias("n"))


@_query(_sql(" SELECT dx_call, CASE WHEN length(de_call) <= 8 THEN de_call || '-#' ELSE de_call END AS de_call, freq_khz, mode, COUNT(*) AS n FROM spots WHERE k % 3 <> 0 GROUP BY ALL"))
def psk_messages(spark, sf_dir):
    from .sources.feeds import parse_psk

    s = spots(spark, sf_dir)
    good = F.to_json(F.struct(F.floor(F.col("freq_khz") * 1000 + 0.5).cast("long").alias("f"), F.col("mode").alias("md"), F.col("report").cast("int").alias("rp"), F.lit(1764850000).alias("t"), F.col("dx_call").alias("sc"), F.col("de_call").alias("rc")))
    value = F.when(F.col("k") % 3 == 0, F.lit("{broken")).otherwise(good)
    p = parse_psk(s.select(value.alias("value")), F.lit("2025-12-04 12:30:00").cast("timestamp"))
    return p.groupBy("dx_call", "de_call", "freq_khz", "mode").agg(F.count("*").alias("n"))


def _stream_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    """Folders for a stream's output and progress, in the shared folder."""
    base = new_place(spark, name)
    return f"{base}/out", f"{base}/progress"


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    from .streaming import spots as streams

    path = f"{sf_dir}/events.parquet"
    out, progress = _stream_dirs(spark, "tumbling")
    # append mode: a window is written once, when the watermark has passed it; a last event, a day later, closes those of the table
    table, end = spark.read.parquet(path), new_place(spark, "end")
    table.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(*[F.col(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in table.dtypes]).write.parquet(end)
    stream = lambda place: spark.readStream.schema(table.schema).parquet(place)
    counts = streams.tumbling_counts(stream(_glob(path)).unionByName(stream(end)))
    streams.run_once(counts, out, progress)
    return spark.read.schema(counts.schema).parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query(_ANCHOR_SQL)
def stream_dedup(spark, sf_dir):
    from .streaming import spots as streams

    out, progress = _stream_dirs(spark, "dedup")
    table, _ = _stream_dirs(spark, "spots")
    s = spots(spark, sf_dir).select("event_id", "t", "report", "dx_call", F.floor("freq_khz").alias("khz"), (F.col("adif") % 5).alias("zone"))
    s.write.parquet(table)
    stream = spark.readStream.schema(s.schema).parquet(table)
    streams.run_once(streams.anchor_dedup(stream, ["khz", "zone", "dx_call"], 60), out, progress)
    return spark.read.schema("event_id long").parquet(out)


def _glob(path: str) -> str:
    """A table's files as a stream source: a folder, or the one file by a pattern that only it meets."""
    return path[:-1] + "[t]"
