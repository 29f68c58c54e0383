"""Prediction, residuals and scores of given models over long observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.functions.scalars import harmonic_terms, predict_terms, seasonal_distance
from terrapulse.options import BANDS, HarmonicOptions


def melted(obs: DataFrame, bands: tuple[str, ...] = BANDS, *more: Column) -> DataFrame:
    """pixel_id, day, seq, band (index), value, and ``more`` columns that a row's bands share."""
    return obs.select("pixel_id", "day", "seq", *more, F.posexplode(F.array(*bands)).alias("band", "value"))


def by_band(*values: float | Column) -> Column:
    """The value of a row's band out of a literal array, so that constants need no join."""
    return F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), F.col("band"))


def with_models(df: DataFrame, models: DataFrame | dict[str, Column]) -> DataFrame:
    """Adds columns by pixel and band, or the same for all pixels where they are given as columns."""
    return df.withColumns(models) if isinstance(models, dict) else df.join(models, ["pixel_id", "band"])


def residuals(obs: DataFrame, models: DataFrame | dict[str, Column], bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Adds models (pixel_id, band, intercept, weights; or columns intercept and weights), predicted and residual, one row a band."""
    terms = [f"_x{k}" for k in range(7)]
    rows = melted(obs, bands, *(x.alias(n) for x, n in zip(harmonic_terms(F.col("day")), terms)))
    joined = with_models(rows, models)
    predicted = predict_terms(F.col("weights"), [F.col(n) for n in terms], F.col("intercept"))
    return joined.withColumn("predicted", predicted).withColumn("residual", F.col("value") - F.col("predicted")).drop(*terms)


def score(scored: DataFrame, terms: int) -> DataFrame:
    """rmse over n - terms degrees of freedom and the median absolute residual, by pixel and band; null where n <= terms."""
    n = F.count("*")
    return scored.groupBy("pixel_id", "band").agg(n.alias("n"), F.when(n > terms, F.sqrt(F.sum(F.col("residual") * F.col("residual")) / (n - terms))).alias("rmse"), F.median(F.abs("residual")).alias("magnitude"))


def change_magnitudes(scored: DataFrame, norms: DataFrame | dict[str, Column], o: HarmonicOptions = HarmonicOptions()) -> DataFrame:
    """Sum over detection bands of squared normed residuals, by pixel and day; norms (pixel_id, band, norm; or a column norm) of 0 are skipped."""
    on = with_models(scored.where(F.col("band").isin(*o.detection_bands)), norms).where("norm > 0")
    return on.groupBy("pixel_id", "day", "seq").agg(F.sum(F.pow(F.col("residual") / F.col("norm"), 2)).alias("magnitude"))


def detections(magnitudes: DataFrame, peek: int, o: HarmonicOptions = HarmonicOptions()) -> DataFrame:
    """For each observation with ``peek`` from it on: whether all of them break the model, or it alone is an outlier."""
    w = Window.partitionBy("pixel_id").orderBy("day", "seq").rowsBetween(0, peek - 1)
    out = magnitudes.withColumns({"least": F.min("magnitude").over(w), "ahead": F.count("*").over(w)}).where(F.col("ahead") == peek)
    return out.withColumns({"change": F.col("least") > o.change_threshold, "outlier": (F.col("least") <= o.change_threshold) & (F.col("magnitude") > o.outlier_threshold)})


def nearest_in_season(kept: DataFrame, target: Column, count: int = 24) -> DataFrame:
    """The ``count`` observations of each pixel nearest to ``target`` within the year; ties by position."""
    place = F.row_number().over(Window.partitionBy("pixel_id").orderBy("day", "seq")) - 1
    df = kept.withColumn("place", place).withColumn("distance", seasonal_distance(F.col("day"), target))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("pixel_id").orderBy("distance", "place"))).where(F.col("rank") <= count)


def seasonal_rmse(residual: Column) -> Column:
    """An aggregate: root of the sum of squares over the constant 4."""
    return F.sqrt(F.sum(residual * residual)) / 4.0


def stability(scored: DataFrame, models: DataFrame | dict[str, Column], norms: DataFrame | dict[str, Column], o: HarmonicOptions = HarmonicOptions()) -> DataFrame:
    """The norm of drift and end residuals over detection bands, by pixel, and whether it is below the change threshold; norms of 0 are skipped."""
    first, last = F.min_by("residual", F.struct("day", "seq")), F.max_by("residual", F.struct("day", "seq"))
    ends = scored.where(F.col("band").isin(*o.detection_bands)).groupBy("pixel_id", "band").agg(first.alias("first"), last.alias("last"), (F.max("day") - F.min("day")).alias("span"))
    joined = with_models(with_models(ends, models), norms).where("norm > 0")
    drift = (F.abs(F.col("weights")[0] * F.col("span")) + F.abs("first") + F.abs("last")) / F.col("norm")
    return joined.groupBy("pixel_id").agg(F.sum(F.pow(drift, 2)).alias("drift")).withColumn("stable", F.col("drift") < o.change_threshold)
