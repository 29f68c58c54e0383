"""Named queries over the driver tables, with their SQL oracles.

Each query applies one operator to all line items seen as observations (``sources.tables``), or to all embeddings seen as
packed series. Oracles restate it in SQL from the same tables. Iterative fits have no oracle; tests hold them against golden outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.functions import scalars
from terrapulse.operators import detection, masks, quality, scoring, temporal
from terrapulse.options import BANDS
from terrapulse.sources.tables import OBS_SQL, observations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_STD = """base AS (
  SELECT *, qa IN (0, 1) AND thermal > -9320 AND thermal < 7070 AND {ranges} AS ok FROM obs
), std AS (
  SELECT *, ok AND row_number() OVER (PARTITION BY pixel_id, day, ok ORDER BY seq) = 1 AS keep FROM base
)""".replace("{ranges}", " AND ".join(f"{b} >= 0 AND {b} <= 10000" for b in BANDS[:6]))
_KEPT = f"WITH {OBS_SQL}, {_STD}, kept AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY day, seq) - 1 AS r FROM std WHERE keep)"
_OBS = f"WITH {OBS_SQL}"
_B = list(enumerate(BANDS))
#: Models that scoring queries are given, the same for every pixel: intercept and weights by band.
_WEIGHTS = (10.0, -5.0, 3.0, 2.0, 1.0, 0.5)
_OMEGA = repr(scalars.OMEGA)


def _query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.standard(observations(spark, sf_dir)).where("keep").drop("keep")


def _models() -> dict:
    return {"intercept": scoring.by_band(*(500.0 * k for k, _ in _B)), "weights": scoring.by_band(*(F.array(F.lit(0.001 * (k + 1)), *map(F.lit, _WEIGHTS)) for k, _ in _B))}


def _norms() -> dict:
    """Band 3 has norm 0 and is skipped."""
    return {"norm": scoring.by_band(*(0.0 if k == 3 else 1000.0 + 100 * k for k, _ in _B))}


_TERMS = "+".join(f"{w} * {f}({k} * {_OMEGA} * day)" for w, (k, f) in zip(_WEIGHTS, [(k, f) for k in (1, 2, 3) for f in ("cos", "sin")]))
_SCORED = (
    _KEPT
    + ", melted AS ("
    + " UNION ALL ".join(f"SELECT pixel_id, day, seq, r, {k} AS band, {b} AS value, {500.0 * k} + {0.001 * (k + 1)} * day + {_TERMS} AS predicted FROM kept" for k, b in _B)
    + "), scored AS (SELECT *, value - predicted AS residual, CASE WHEN band = 3 THEN 0.0 ELSE 1000.0 + 100 * band END AS norm FROM melted)"
)

_STATS = """SELECT pixel_id, count(*) FILTER (qa = 255 {f}) AS fill, count(*) FILTER (qa = 0 {f}) AS clear, count(*) FILTER (qa = 1 {f}) AS water,
    count(*) FILTER (qa = 3 {f}) AS snow, count(*) FILTER (qa = 4 {f}) AS cloud, count(*) FILTER (true {f}) AS total FROM {t} GROUP BY pixel_id"""
_RATIOS = """SELECT pixel_id, fill, clear, water, snow, cloud, total, round(cloud_ratio, 9) AS cloud_ratio, round(snow_ratio, 9) AS snow_ratio,
    round(water_ratio, 9) AS water_ratio, round(clear_ratio, 9) AS clear_ratio,
    CASE WHEN clear_ratio >= 0.25 THEN 'standard' WHEN snow_ratio >= 0.75 THEN 'snow' ELSE 'insufficient' END AS procedure FROM (
  SELECT *, CASE WHEN total > fill THEN cloud / (total - fill)::DOUBLE ELSE 0.0 END AS cloud_ratio,
    CASE WHEN total > fill THEN snow / (clear + water + snow + 0.01::DOUBLE) ELSE 0.0 END AS snow_ratio,
    CASE WHEN total > fill THEN water / (clear + water + 0.01::DOUBLE) ELSE 0.0 END AS water_ratio,
    CASE WHEN total > fill THEN (clear + water) / (total - fill)::DOUBLE ELSE 0.0 END AS clear_ratio FROM c)"""


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@_query(f"{_OBS}, c AS ({_STATS.format(f='AND day <= 736694', t='obs')}) {_RATIOS}")
def qa_statistics(spark, sf_dir):
    return _rounded(quality.statistics(observations(spark, sf_dir)), 9, "cloud_ratio", "snow_ratio", "water_ratio", "clear_ratio")


@_query(f"{_OBS}, c AS ({_STATS.format(f='', t='obs')}) {_RATIOS}")
def qa_statistics_all(spark, sf_dir):
    return _rounded(quality.statistics(observations(spark, sf_dir), until=False), 9, "cloud_ratio", "snow_ratio", "water_ratio", "clear_ratio")


_EVENTS = """WITH obs AS (SELECT user_id AS pixel_id, (date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 719163)::BIGINT AS day,
  CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 255 END AS qa FROM events)"""


@_query(f"{_EVENTS}, c AS ({_STATS.format(f='AND day <= 736694', t='obs')}) {_RATIOS}")
def qa_statistics_late(spark, sf_dir):
    """Every event is after the statistics day: all counters are 0 and every pixel is routed to the fallback."""
    qa = F.expr("CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 255 END")
    obs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("pixel_id"), scalars.ordinal(F.col("ts")).alias("day"), qa.alias("qa"))
    return _rounded(quality.statistics(obs), 9, "cloud_ratio", "snow_ratio", "water_ratio", "clear_ratio")


@_query(f"WITH {OBS_SQL}, {_STD} SELECT pixel_id, seq, day, keep FROM std")
def mask_standard(spark, sf_dir):
    return masks.standard(observations(spark, sf_dir)).select("pixel_id", "seq", "day", "keep")


@_query(f"WITH {OBS_SQL}, {_STD}, s AS (SELECT *, keep OR qa = 3 AS k FROM std) SELECT pixel_id, seq, day, k AND row_number() OVER (PARTITION BY pixel_id, day, k ORDER BY seq) = 1 AS keep FROM s")
def mask_snow(spark, sf_dir):
    return masks.snow(observations(spark, sf_dir)).select("pixel_id", "seq", "day", "keep")


@_query(
    f"""WITH {OBS_SQL}, {_STD}, m AS (SELECT pixel_id, median(green) AS g FROM std WHERE keep AND day <= 736694 GROUP BY pixel_id),
s AS (SELECT std.* EXCLUDE (keep), keep AND coalesce(green < g + 400, true) AS k FROM std LEFT JOIN m USING (pixel_id))
SELECT pixel_id, seq, day, k AND row_number() OVER (PARTITION BY pixel_id, day, k ORDER BY seq) = 1 AS keep FROM s"""
)
def mask_insufficient(spark, sf_dir):
    return masks.insufficient(observations(spark, sf_dir)).select("pixel_id", "seq", "day", "keep")


@_query(f"{_OBS} SELECT pixel_id, seq, thermal * 10 - 27315 AS thermal, thermal * 10 - 27315 > -9320 AND thermal * 10 - 27315 < 7070 AS in_range FROM obs")
def thermal_rescaled(spark, sf_dir):
    df = masks.rescaled(observations(spark, sf_dir))
    return df.select("pixel_id", "seq", "thermal", masks.thermal_in_range(F.col("thermal")).alias("in_range"))


@_query(
    f"""WITH {OBS_SQL}, {_STD} SELECT pixel_id, seq,
  CASE WHEN keep THEN sum(keep::INT) OVER (PARTITION BY pixel_id ORDER BY day, seq ROWS UNBOUNDED PRECEDING) - 1 END::BIGINT AS place FROM std"""
)
def kept_places(spark, sf_dir):
    """Original to masked index."""
    return masks.standard(observations(spark, sf_dir)).select("pixel_id", "seq", masks.kept_rank().alias("place"))


@_query(
    f"""WITH {OBS_SQL}, {_STD} SELECT pixel_id, n, span, coalesce(span >= 365, false) AS enough_time, n >= 12 AS fallback_fits, n > 12 AS standard_fits
FROM (SELECT pixel_id, count(*) FILTER (keep) AS n, max(day) FILTER (keep) - min(day) FILTER (keep) AS span FROM std GROUP BY pixel_id)"""
)
def minimum_observations(spark, sf_dir):
    return masks.enough(masks.standard(observations(spark, sf_dir)))


@_query(
    f"""WITH {OBS_SQL}, {_STD} SELECT pixel_id, seq, keep AND day % 2 = 0 AS both_hold, keep OR day % 2 = 0 AS any_holds, NOT keep AS inverse,
  keep::TINYINT AS as_int FROM std"""
)
def mask_algebra(spark, sf_dir):
    even = F.col("day") % 2 == 0
    df = masks.standard(observations(spark, sf_dir))
    return df.select("pixel_id", "seq", (F.col("keep") & even).alias("both_hold"), (F.col("keep") | even).alias("any_holds"), (~F.col("keep")).alias("inverse"), F.col("keep").cast("tinyint").alias("as_int"))


@_query(
    f"""WITH {OBS_SQL}, {_STD} SELECT pixel_id, count(*) AS size, count(*) FILTER (keep) AS kept, bool_or(keep) AS any_kept, NOT bool_or(keep) AS none_kept,
  bool_and(keep) AS all_kept FROM std GROUP BY pixel_id"""
)
def mask_packed(spark, sf_dir):
    """The packed mask: an array of booleans by pixel, counted with array functions."""
    df = masks.standard(observations(spark, sf_dir))
    m = F.transform(F.array_sort(F.collect_list(F.struct("seq", "keep"))), lambda x: x["keep"])
    p = df.groupBy("pixel_id").agg(m.alias("m"))
    hold = lambda x: x
    return p.select("pixel_id", F.size("m").cast("long").alias("size"), F.size(F.filter("m", hold)).cast("long").alias("kept"), F.exists("m", hold).alias("any_kept"), (~F.exists("m", hold)).alias("none_kept"), F.forall("m", hold).alias("all_kept"))


@_query(_KEPT + " SELECT pixel_id, day, seq, day - lag(day) OVER (PARTITION BY pixel_id ORDER BY day, seq) AS gap FROM kept")
def consecutive_gaps(spark, sf_dir):
    return temporal.with_gaps(_kept(spark, sf_dir)).select("pixel_id", "day", "seq", "gap")


@_query(
    _KEPT
    + """, g AS (SELECT pixel_id, day - lag(day) OVER (PARTITION BY pixel_id ORDER BY day, seq) AS gap FROM kept WHERE day <= 736694),
m AS (SELECT pixel_id, floor(median(gap))::BIGINT AS median_gap FROM g GROUP BY pixel_id)
SELECT pixel_id, median_gap, coalesce(greatest(6, round(6 * 16.0 / (median_gap + 0.001::DOUBLE))::INT), 6) AS peek FROM m"""
)
def peek_sizes(spark, sf_dir):
    return temporal.peek_sizes(_kept(spark, sf_dir))


@_query(
    _KEPT
    + f", s AS (SELECT pixel_id, {', '.join(f'abs({b} - lag({b}) OVER w) AS {b}' for b in BANDS)} FROM kept WINDOW w AS (PARTITION BY pixel_id ORDER BY day, seq))"
    + f" SELECT pixel_id, {', '.join(f'round(median({b}), 6) AS {b}' for b in BANDS)} FROM s GROUP BY pixel_id"
)
def madogram(spark, sf_dir):
    return _rounded(temporal.madogram(_kept(spark, sf_dir)), 6, *BANDS)


@_query(
    _KEPT
    + """, p AS (SELECT a.pixel_id, (b.r - a.r)::INT AS lag, b.day - a.day AS gap FROM kept a JOIN kept b ON a.pixel_id = b.pixel_id AND b.r BETWEEN a.r + 1 AND a.r + 4),
c AS (SELECT pixel_id, lag, gap, count(*) AS n FROM p GROUP BY ALL)
SELECT pixel_id, lag, gap AS modal_gap FROM c QUALIFY row_number() OVER (PARTITION BY pixel_id, lag ORDER BY n DESC, gap) = 1"""
)
def modal_gaps(spark, sf_dir):
    return temporal.modal_gaps(_kept(spark, sf_dir), 4)


_D = ", ".join(f"abs(b.{x} - a.{x}) AS {x}" for x in BANDS)


@_query(
    _KEPT
    + f""", e AS (SELECT * FROM kept WHERE day <= 736694),
p AS (SELECT a.pixel_id, (b.r - a.r)::INT AS lag, b.day - a.day AS gap, {_D} FROM e a JOIN e b ON a.pixel_id = b.pixel_id AND b.r > a.r),
c AS (SELECT pixel_id, lag, gap, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT pixel_id, lag, gap FROM c QUALIFY row_number() OVER (PARTITION BY pixel_id, lag ORDER BY n DESC, gap) = 1),
k AS (SELECT pixel_id, min(lag) AS lag FROM m WHERE gap > 30 GROUP BY pixel_id),
q AS (SELECT p.*, k.lag AS chosen FROM p LEFT JOIN k USING (pixel_id))
SELECT pixel_id, chosen AS lag, {", ".join(f"round(median({x}), 6) AS {x}" for x in BANDS)} FROM q
WHERE lag = coalesce(chosen, 1) AND (chosen IS NULL OR gap > 30) GROUP BY pixel_id, chosen"""
)
def adjusted_variogram(spark, sf_dir):
    return _rounded(temporal.adjusted_variogram(_kept(spark, sf_dir)), 6, *BANDS)


@_query(_KEPT + " SELECT pixel_id, count(*) FILTER (day <= 736694) AS prefix, count(*) AS n FROM kept GROUP BY pixel_id")
def statistics_prefix(spark, sf_dir):
    return temporal.stat_prefix(_kept(spark, sf_dir))


@_query(_KEPT + f", p AS (SELECT a.pixel_id, a.day, b.day - a.day AS gap, {_D} FROM kept a JOIN kept b ON a.pixel_id = b.pixel_id AND b.r = a.r + 3) SELECT pixel_id, day, gap, {', '.join(f'round({b}, 6) AS {b}' for b in BANDS)} FROM p")
def lag_pairs(spark, sf_dir):
    return _rounded(temporal.lag_pairs(_kept(spark, sf_dir), 3), 6, *BANDS)


@_query(
    _OBS
    + " SELECT pixel_id, seq, day::DOUBLE AS x0, "
    + ", ".join(f"round({f}({k} * {_OMEGA} * day), 6) + 0.0 AS x{2 * k - 1 + i}" for k in (1, 2, 3) for i, f in enumerate(("cos", "sin")))
    + " FROM obs"
)
def harmonic_basis(spark, sf_dir):
    t, *waves = scalars.harmonic_terms(F.col("day"))
    return observations(spark, sf_dir).select("pixel_id", "seq", t.alias("x0"), *((F.round(w, 6) + 0.0).alias(f"x{k}") for k, w in enumerate(waves, 1)))


@_query(
    _KEPT
    + f""", y AS (SELECT pixel_id, day, seq, ceil((max(day) OVER w - min(day) OVER w) / 365.2425::DOUBLE) AS years FROM kept WINDOW w AS (PARTITION BY pixel_id))
SELECT pixel_id, day, seq, round(cos({_OMEGA} * day), 6) + 0.0 AS x0, round(sin({_OMEGA} * day), 6) + 0.0 AS x1,
  round(cos(day * ({_OMEGA} / years)), 6) + 0.0 AS x2, round(sin(day * ({_OMEGA} / years)), 6) + 0.0 AS x3 FROM y WHERE years > 0"""
)
def screen_basis(spark, sf_dir):
    w = Window.partitionBy("pixel_id")
    years = F.ceil((F.max("day").over(w) - F.min("day").over(w)) / 365.2425)
    df = _kept(spark, sf_dir).withColumn("years", years).where("years > 0")
    return df.select("pixel_id", "day", "seq", *((F.round(x, 6) + 0.0).alias(f"x{k}") for k, x in enumerate(scalars.screen_terms(F.col("day"), F.col("years"))[:4])))


@_query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(abs(l_quantity - 25), 6) AS magnitude,
  round(sign(l_quantity - 25) * greatest(abs(l_quantity - 25) - 5, 0.0), 6) + 0.0 AS soft,
  round(CASE WHEN abs(l_quantity / 10) < 4.685 THEN pow(1 - pow(l_quantity / 10 / 4.685::DOUBLE, 2), 2) ELSE 0.0 END, 6) AS weight,
  CASE WHEN l_partkey // 3 < 6 THEN 4 WHEN l_partkey // 3 < 8 THEN 6 ELSE 8 END AS terms,
  round(abs(round((l_partkey * 7 - 300) / 365.25::DOUBLE) * 365.25::DOUBLE - (l_partkey * 7 - 300)), 6) AS seasonal FROM lineitem"""
)
def scalar_functions(spark, sf_dir):
    q, part = F.col("l_quantity"), F.col("l_partkey")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(F.abs(q - 25), 6).alias("magnitude"),
        (F.round(scalars.soft_threshold(q - 25, F.lit(5.0)), 6) + 0.0).alias("soft"), F.round(scalars.bisquare(q / 10), 6).alias("weight"),
        scalars.terms_for(part).alias("terms"), F.round(scalars.seasonal_distance(part * 7, F.lit(300)), 6).alias("seasonal"),
    )


@_query(_SCORED + " SELECT pixel_id, band, seq, round(predicted, 4) AS predicted, round(abs(residual), 4) AS absolute FROM scored")
def predictions(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return scoring.residuals(kept, _models()).select("pixel_id", "band", "seq", F.round("predicted", 4).alias("predicted"), F.round(F.abs("residual"), 4).alias("absolute"))


@_query(
    _SCORED
    + """ SELECT pixel_id, band, count(*) AS n, CASE WHEN count(*) > 8 THEN round(sqrt(sum(residual * residual) / (count(*) - 8)), 4) END AS rmse,
  round(median(abs(residual)), 4) AS magnitude FROM scored GROUP BY pixel_id, band"""
)
def model_scores(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return _rounded(scoring.score(scoring.residuals(kept, _models()), 8), 4, "rmse", "magnitude")


_MAGNITUDES = _SCORED + ", mags AS (SELECT pixel_id, day, seq, sum(pow(residual / norm, 2)) AS magnitude FROM scored WHERE band BETWEEN 1 AND 5 AND norm > 0 GROUP BY ALL)"


@_query(_MAGNITUDES + " SELECT pixel_id, day, seq, round(magnitude, 4) AS magnitude FROM mags")
def change_magnitudes(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return _rounded(scoring.change_magnitudes(scoring.residuals(kept, _models()), _norms()), 4, "magnitude")


@_query(
    _MAGNITUDES
    + """, d AS (SELECT *, min(magnitude) OVER w AS least, count(*) OVER w AS ahead FROM mags WINDOW w AS (PARTITION BY pixel_id ORDER BY day, seq ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT pixel_id, day, seq, least > 15.086272469388987 AS change, least <= 15.086272469388987 AND magnitude > 35.888186879610423 AS outlier FROM d WHERE ahead = 6"""
)
def forward_peeks(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    m = scoring.change_magnitudes(scoring.residuals(kept, _models()), _norms())
    return scoring.detections(m, 6).select("pixel_id", "day", "seq", "change", "outlier")


_NEAREST = """, n AS (SELECT *, abs(round((day - 730000) / 365.25::DOUBLE) * 365.25::DOUBLE - (day - 730000)) AS distance FROM kept),
near AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY distance, r) AS rank FROM n QUALIFY rank <= 24)"""


@_query(_KEPT + _NEAREST + " SELECT pixel_id, seq, r AS place, round(distance, 6) AS distance, rank::INT AS rank FROM near")
def nearest_in_season(spark, sf_dir):
    out = scoring.nearest_in_season(_kept(spark, sf_dir), F.lit(730000))
    return out.select("pixel_id", "seq", F.col("place").cast("long").alias("place"), F.round("distance", 6).alias("distance"), "rank")


@_query(_SCORED + _NEAREST + " SELECT pixel_id, band, round(sqrt(sum(residual * residual)) / 4, 4) AS rmse FROM scored JOIN near USING (pixel_id, day, seq) GROUP BY pixel_id, band")
def seasonal_rmse(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    near = scoring.nearest_in_season(kept, F.lit(730000)).drop("place", "distance", "rank")
    return scoring.residuals(near, _models()).groupBy("pixel_id", "band").agg(F.round(scoring.seasonal_rmse(F.col("residual")), 4).alias("rmse"))


@_query(
    _SCORED
    + """, e AS (SELECT pixel_id, band, arg_min(residual, r) AS first, arg_max(residual, r) AS last, max(day) - min(day) AS span FROM scored WHERE band IN (1, 2, 4, 5) GROUP BY ALL),
s AS (SELECT pixel_id, sum(pow((abs(0.001 * (band + 1) * span) + abs(first) + abs(last)) / (1000.0 + 100 * band), 2)) AS drift FROM e GROUP BY pixel_id)
SELECT pixel_id, round(drift, 4) AS drift, drift < 15.086272469388987 AS stable FROM s"""
)
def stability(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return _rounded(scoring.stability(scoring.residuals(kept, _models()), _models(), _norms()), 4, "drift")


@_query(
    _KEPT
    + f"""SELECT pixel_id, round(avg(cos({_OMEGA} * day)), 6) + 0.0 AS mean_cos, round(var_pop(cos({_OMEGA} * day)) * count(*), 4) + 0.0 AS norm_cos,
  round(avg(green), 4) AS mean_green, round(var_pop(green) * count(*), 0) AS norm_green, round(stddev_pop(green), 4) AS std_green FROM kept GROUP BY pixel_id"""
)
def centred_moments(spark, sf_dir):
    wave, n = F.cos(F.col("day") * scalars.OMEGA), F.count("*")
    return _kept(spark, sf_dir).groupBy("pixel_id").agg(
        (F.round(F.avg(wave), 6) + 0.0).alias("mean_cos"), (F.round(F.var_pop(wave) * n, 4) + 0.0).alias("norm_cos"), F.round(F.avg("green"), 4).alias("mean_green"),
        F.round(F.var_pop("green") * n, 0).alias("norm_green"), F.round(F.stddev_pop("green"), 4).alias("std_green"),
    )


@_query(
    _KEPT
    + """, c AS (SELECT pixel_id, green - avg(green) OVER (PARTITION BY pixel_id) AS d FROM kept), k AS (SELECT pixel_id, abs(d) AS d, row_number() OVER (PARTITION BY pixel_id ORDER BY abs(d)) AS i FROM c)
SELECT pixel_id, round(median(d), 4) AS median_abs, round(median(d) FILTER (i > 4) / 0.6745::DOUBLE, 4) AS mad FROM k GROUP BY pixel_id"""
)
def trimmed_mad(spark, sf_dir):
    d = F.col("green") - F.avg("green").over(Window.partitionBy("pixel_id"))
    p = _kept(spark, sf_dir).select("pixel_id", d.alias("d")).groupBy("pixel_id").agg(F.collect_list("d").alias("d"))
    return p.select("pixel_id", F.round(scalars.median_of(F.transform("d", F.abs)), 4).alias("median_abs"), F.round(scalars.trimmed_mad(F.col("d")), 4).alias("mad"))


@_query(
    """SELECT vec_id, len(embedding) AS size, round(embedding[5]::DOUBLE, 6) AS fifth, round(list_sum([x::DOUBLE FOR x IN embedding[9:16]]), 4) AS slice_sum,
  len([x FOR x IN embedding IF x > 0])::INT AS kept, round(list_max(embedding)::DOUBLE, 6) AS high, round(list_min(embedding)::DOUBLE, 6) AS low FROM embeddings"""
)
def array_views(spark, sf_dir):
    """Index, slice, shape, masked compaction and extremes of packed series."""
    e = F.col("embedding")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.size(e).cast("long").alias("size"), F.round(e[4].cast("double"), 6).alias("fifth"), F.round(F.aggregate(F.slice(e, 9, 8), F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("slice_sum"),
        F.size(F.filter(e, lambda x: x > 0)).alias("kept"), F.round(F.array_max(e).cast("double"), 6).alias("high"), F.round(F.array_min(e).cast("double"), 6).alias("low"),
    )


@_query(
    """SELECT label, (i - 1)::INT AS place, count(*) AS n, round(sum(embedding[i]::DOUBLE), 3) + 0.0 AS total FROM embeddings, unnest(range(1, 65)) AS t(i)
WHERE i <= len(embedding) GROUP BY label, i"""
)
def array_transpose(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("place", "x"))
    return rows.groupBy("label", "place").agg(F.count("*").alias("n"), (F.round(F.sum(F.col("x").cast("double")), 3) + 0.0).alias("total"))


@_query("SELECT vec_id, (vec_id // 100)::INT AS row, (vec_id % 100)::INT AS col, i AS place, 723883 + 16 * i AS day FROM embeddings, range(64) AS t(i)")
def shared_dates(spark, sf_dir):
    """A pixel id taken apart into row and column, and one date axis given to every pixel."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    axis = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda i: F.struct(i.alias("place"), (i * 16 + 723883).alias("day")))
    return e.select("vec_id", F.floor(F.col("vec_id") / 100).cast("int").alias("row"), F.pmod("vec_id", F.lit(100)).cast("int").alias("col"), F.inline(axis))


@_query(f"{_OBS} SELECT pixel_id, day, qa, round(green, 6) AS green, row_number() OVER (PARTITION BY pixel_id ORDER BY day, seq) - 1 AS seq FROM obs")
def packed_round_trip(spark, sf_dir):
    out = detection.unpack(detection.pack(observations(spark, sf_dir)))
    return out.select("pixel_id", "day", F.col("qa").cast("int").alias("qa"), F.round("green", 6).alias("green"), "seq")


def _lasso_sql(terms: int) -> str:
    """CTEs that fit the rows of ``obs_fit`` (pixel_id, day, bands): cyclic coordinate descent, one coordinate a step of the recursion.

    ``fits`` has pixel_id, band, n, iterations, intercept, w (seven weights) and rmse.
    """
    waves = [f"{f}({k} * {_OMEGA} * day)" if 2 * k < terms else "0.0::DOUBLE" for k in (1, 2, 3) for f in ("cos", "sin")]
    x = ", ".join(f"{e} AS x{i}" for i, e in enumerate(["day::DOUBLE", *waves]))
    gram = ", ".join("[" + ", ".join(f"covar_pop(x{i}, x{j}) * count(*)" for j in range(7)) + "]" for i in range(7))
    return f"""lm AS ({" UNION ALL ".join(f"SELECT pixel_id, day, {k} AS band, {b} AS y FROM obs_fit" for k, b in _B)}),
lx AS (SELECT *, {x} FROM lm),
gr AS (SELECT pixel_id, band, count(*)::DOUBLE AS n, [{gram}] AS g, [{", ".join(f"covar_pop(x{i}, y) * count(*)" for i in range(7))}] AS xy,
  var_pop(y) * count(*) AS yy, [{", ".join(f"avg(x{i})" for i in range(7))}] AS xm, avg(y) AS ym FROM lx GROUP BY ALL),
cd AS (
  SELECT pixel_id, band, 1 AS j, 1 AS cycle, [0.0::DOUBLE FOR i IN range(7)] AS w, xy AS c, 0.0::DOUBLE AS step, 0.0::DOUBLE AS top, false AS done FROM gr
  UNION ALL
  SELECT pixel_id, band, CASE WHEN j = 7 THEN 1 ELSE j + 1 END, CASE WHEN j = 7 AND NOT fin THEN cycle + 1 ELSE cycle END, w, c, CASE WHEN j = 7 THEN 0.0 ELSE step END, CASE WHEN j = 7 THEN 0.0 ELSE top END, fin
  FROM (
    SELECT *, j = 7 AND step <= 1e-4 * greatest(top, 1.0)
        AND rr / (2 * n) + list_sum([abs(v) FOR v IN w]) - (sc * (yy - fitted) / n - sc * sc * rr / (2 * n)) <= 1e-4 * yy / n AS fin
    FROM (
      SELECT *, yy - fitted - list_dot_product(w, c) AS rr, least(1.0, n / greatest(list_max([abs(v) FOR v IN c]), 1e-300)) AS sc
      FROM (
        SELECT *, list_dot_product(w, xy) AS fitted
        FROM (
          SELECT pixel_id, band, j, cycle, n, yy, xy, [CASE WHEN i = j THEN new ELSE w[i] END FOR i IN range(1, 8)] AS w,
            [c[i] - g[i][j] * (new - w[j]) FOR i IN range(1, 8)] AS c, greatest(step, abs(new - w[j])) AS step, greatest(top, abs(new)) AS top
          FROM (
            SELECT cd.*, n, yy, xy, g, CASE WHEN g[j][j] > 0 THEN sign(c[j] + g[j][j] * w[j]) * greatest(abs(c[j] + g[j][j] * w[j]) - n, 0.0) / g[j][j] ELSE 0.0 END AS new
            FROM cd JOIN gr USING (pixel_id, band) WHERE NOT done AND cycle <= 1000
          )
        )
      )
    )
  )
),
ended AS (SELECT pixel_id, band, cycle, w FROM cd WHERE done OR cycle > 1000),
fits AS (
  SELECT pixel_id, band, any_value(n) AS n, any_value(cycle) AS iterations, any_value(ym - list_dot_product(w, xm)) AS intercept, any_value(w) AS w,
    CASE WHEN any_value(n) > {terms} THEN sqrt(sum(pow(y - ym - list_dot_product(w, [{", ".join(f"x{i} - xm[{i + 1}]" for i in range(7))}]), 2)) / (any_value(n) - {terms})) END AS rmse
  FROM lx JOIN gr USING (pixel_id, band) JOIN ended USING (pixel_id, band) GROUP BY pixel_id, band
)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_W = ", ".join(f"round(w[{i + 1}], 4) + 0.0 AS w{i}" for i in range(7))


@_query(_recursive(_KEPT) + f", obs_fit AS (SELECT * FROM kept), {_lasso_sql(8)} SELECT pixel_id, band::INT AS band, iterations::INT AS iterations, round(intercept, 1) + 0.0 AS intercept, {_W}, round(rmse, 4) AS rmse FROM fits")
def lasso_fits(spark, sf_dir):
    """Fits of all kept observations of a pixel, one row a band; no rmse without degrees of freedom."""
    kept = masks.standard(observations(spark, sf_dir)).where("keep")
    fits = detection.fit_series(detection.pack(kept), 8)
    finite = F.when(F.isnan("rmse") | (F.col("rmse") == float("inf")), None).otherwise(F.round("rmse", 4))
    return fits.select("pixel_id", "band", "iterations", (F.round("intercept", 1) + 0.0).alias("intercept"), *((F.round(F.col("weights")[i], 4) + 0.0).alias(f"w{i}") for i in range(7)), finite.alias("rmse"))


def _eliminated(source: str, columns: int) -> str:
    """Rows of ``source`` with their matrix m (five rows) brought to the unit matrix and what stands beside it, by Gauss-Jordan steps."""
    for p in range(1, 6):
        row = f"[v / m[{p}][{p}] FOR v IN m[{p}]]"
        source = f"(SELECT * REPLACE ([CASE WHEN i = {p} THEN pr ELSE [m[i][k] - m[i][{p}] * pr[k] FOR k IN range(1, {columns + 1})] END FOR i IN range(1, 6)] AS m) FROM (SELECT * EXCLUDE (pr), {row} AS pr FROM {source}))"
    return source


def _robust_sql() -> str:
    """CTEs that fit ``kept`` rows: least squares, then four rounds of bisquare weights; ``rounds4`` has pixel_id, band and the coefficients."""
    products = ", ".join("[" + ", ".join([f"sum(w * x[{i}] * x[{j}])" for j in range(1, 6)] + [f"sum(w * x[{i}] * y)"]) + "]" for i in range(1, 6))
    squares = ", ".join("[" + ", ".join([f"sum(x[{i}] * x[{j}])" for j in range(1, 6)] + [f"{float(i == j)}::DOUBLE" for j in range(1, 6)]) + "]" for i in range(1, 6))
    out = [
        f"yr AS (SELECT *, {_OMEGA} / ceil((max(day) OVER w - min(day) OVER w) / 365.2425::DOUBLE) AS slow, count(*) OVER w AS n FROM kept WINDOW w AS (PARTITION BY pixel_id))",
        "rx AS (" + " UNION ALL ".join(f"SELECT pixel_id, seq, {k} AS band, {BANDS[k]} AS y, n, [cos({_OMEGA} * day), sin({_OMEGA} * day), cos(slow * day), sin(slow * day), 1.0] AS x FROM yr WHERE n > 5" for k in (1, 4)) + ")",
        f"iv AS (SELECT pixel_id, band, m FROM {_eliminated(f'(SELECT pixel_id, band, [{squares}] AS m, []::DOUBLE[] AS pr FROM rx GROUP BY ALL)', 10)})",
        "ry AS (SELECT rx.*, 1 / sqrt(1 - least(0.9999, list_sum([x[i] * list_dot_product(m[i][6:10], x) FOR i IN range(1, 6)]))) AS factor FROM rx JOIN iv USING (pixel_id, band))",
        "w0 AS (SELECT *, 1.0::DOUBLE AS w FROM ry)",
    ]
    for k in range(5):
        out.append(f"s{k} AS (SELECT pixel_id, band, [m[i][6] FOR i IN range(1, 6)] AS beta FROM {_eliminated(f'(SELECT pixel_id, band, [{products}] AS m, []::DOUBLE[] AS pr FROM w{k} GROUP BY ALL)', 6)})")
        if not k:
            out.append("rounds0 AS (SELECT s0.*, false AS done FROM s0)")
        else:
            out.append(f"rounds{k} AS (SELECT pixel_id, band, CASE WHEN o.done THEN o.beta ELSE s{k}.beta END AS beta, o.done OR list_max([abs(s{k}.beta[i] - o.beta[i]) FOR i IN range(1, 6)]) < 1e-8 AS done FROM s{k} JOIN rounds{k - 1} o USING (pixel_id, band))")
        if k < 4:
            residual = f"(SELECT ry.*, beta, done, abs(y - list_dot_product(x, beta)) * factor AS r FROM ry JOIN rounds{k} USING (pixel_id, band))"
            out.append(f"r{k} AS (SELECT *, row_number() OVER (PARTITION BY pixel_id, band ORDER BY r) AS place FROM {residual})")
            out.append(f"d{k} AS (SELECT pixel_id, band, greatest(2.220446049250313e-16 * stddev_pop(y), median(r) FILTER (place > 4) / 0.6745::DOUBLE) AS scale FROM r{k} GROUP BY ALL)")
            out.append(f"w{k + 1} AS (SELECT r{k}.* EXCLUDE (beta, done, r, place), CASE WHEN r / scale / 4.685::DOUBLE < 1 THEN pow(1 - pow(r / scale / 4.685::DOUBLE, 2), 2) ELSE 0.0 END AS w FROM r{k} JOIN d{k} USING (pixel_id, band))")
    return ", ".join(out)


_C = ", ".join(f"round(any_value(beta)[{i + 1}], 3) + 0.0 AS c{i}" for i in range(5))


@_query(_KEPT + f", {_robust_sql()} SELECT pixel_id, band::INT AS band, {_C}, round(sqrt(sum(pow(y - list_dot_product(x, beta), 2)) / (any_value(n) - 5)), 3) AS rmse FROM ry JOIN rounds4 USING (pixel_id, band) GROUP BY pixel_id, band")
def robust_fits(spark, sf_dir):
    """Robust fits of all kept observations of a pixel in the screened bands."""
    kept = masks.standard(observations(spark, sf_dir)).where("keep")
    fits = detection.robust_series(detection.pack(kept))
    return fits.select("pixel_id", "band", *((F.round(F.col("coefficients")[i], 3) + 0.0).alias(f"c{i}") for i in range(5)), F.round("rmse", 3).alias("rmse"))


@_query()
def change_models(spark, sf_dir):
    """Full detection: one row a change model."""
    return detection.models(detection.detect_changes(observations(spark, sf_dir)))


@_query()
def pixel_results(spark, sf_dir):
    """Full detection: one row a pixel with its final mask."""
    return detection.detect_changes(observations(spark, sf_dir))


def _single(name: str, oracle: str | None = None):
    def f(spark, sf_dir):
        out = detection.models(detection.detect_changes(observations(spark, sf_dir), procedure=name))
        out = out.select("*", F.posexplode("bands").alias("band", "x")).drop("bands")
        fit = [(F.round(F.col("x.coefficients")[i], 4) + 0.0).alias(f"w{i}") for i in range(7)]
        fields = ("pixel_id", "procedure", "model_idx", "start_day", "end_day", "break_day", "observation_count", "change_probability", "curve_qa", "band")
        return out.select(*fields, F.round("x.rmse", 4).alias("rmse"), F.round("x.magnitude", 4).alias("magnitude"), (F.round("x.intercept", 1) + 0.0).alias("intercept"), *fit)

    f.__name__ = f"procedure_{name}"
    return _query(oracle)(f)


def _single_sql(name: str, code: int, masked: str) -> str:
    """The oracle of a procedure of one fit over the rows that a mask keeps; ``masked`` is the mask query's oracle."""
    head, _, last = masked.rpartition("SELECT pixel_id, seq, day, k AND")
    keep = last.rpartition(" AS keep FROM s")[0]
    return (
        _recursive(head)
        + f""", m2 AS (SELECT *, k AND{keep} AS chosen FROM s), obs_fit AS (SELECT * FROM m2 WHERE chosen QUALIFY count(*) OVER (PARTITION BY pixel_id) >= 12), {_lasso_sql(4)},
ends AS (SELECT pixel_id, min(day) AS start_day, max(day) AS end_day FROM obs GROUP BY pixel_id)
SELECT pixel_id, '{name}' AS procedure, 0::INT AS model_idx, start_day, end_day, end_day AS break_day, n::INT AS observation_count, 0.0::DOUBLE AS change_probability, {code}::SMALLINT AS curve_qa,
  band::INT AS band, round(rmse, 4) AS rmse, 0.0::DOUBLE AS magnitude, round(intercept, 1) + 0.0 AS intercept, {_W} FROM fits JOIN ends USING (pixel_id)"""
    )


procedure_snow = _single("snow", _single_sql("snow", 54, ORACLES["mask_snow"]))
procedure_insufficient = _single("insufficient", _single_sql("insufficient", 44, ORACLES["mask_insufficient"]))
procedure_standard = _single("standard")


@_query()
def wide_models(spark, sf_dir):
    """The 76-column form of the models."""
    return detection.wide(detection.models(detection.detect_changes(observations(spark, sf_dir))), ("pixel_id",))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_models(spark, sf_dir)
