"""Observation masks in long form. All windows are of a pixel in the order of day and seq, so one exchange and one sort by pixel serve all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.options import BANDS, REFLECTANCE_HIGH, THERMAL_HIGH, THERMAL_LOW, HarmonicOptions


def clear_or_water(o: HarmonicOptions) -> Column:
    return F.coalesce(F.col("qa").isin(o.codes.clear, o.codes.water), F.lit(False))


def thermal_in_range(thermal: Column) -> Column:
    """Strictly between the limits; NaN and null are not."""
    return F.coalesce((thermal > THERMAL_LOW) & (thermal < THERMAL_HIGH), F.lit(False))


def unsaturated() -> Column:
    """No reflective band below 0 or above the limit; NaN and null pass."""
    bad = F.lit(False)
    for b in BANDS[:6]:
        bad = bad | F.coalesce((F.col(b) < 0) | ((F.col(b) > REFLECTANCE_HIGH) & ~F.isnan(b)), F.lit(False))
    return ~bad


def first_of_day(df: DataFrame, keep: str) -> DataFrame:
    """``keep`` holds for the first kept row (by seq) of a pixel's day only."""
    before = Window.partitionBy("pixel_id").orderBy("day", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(keep), F.struct("day")), ignorenulls=True).over(before)
    return df.withColumn(keep, F.col(keep) & (last.isNull() | ~last["day"].eqNullSafe(F.col("day"))))


def standard(obs: DataFrame, o: HarmonicOptions = HarmonicOptions(), name: str = "keep", thermal: Column | None = None) -> DataFrame:
    thermal = F.col("thermal") if thermal is None else thermal
    return first_of_day(obs.withColumn(name, clear_or_water(o) & thermal_in_range(thermal) & unsaturated()), name)


def snow(obs: DataFrame, o: HarmonicOptions = HarmonicOptions(), name: str = "keep") -> DataFrame:
    """The standard mask and all snow; snow skips the ranges."""
    df = standard(obs, o, name)
    return first_of_day(df.withColumn(name, F.col(name) | F.coalesce(F.col("qa") == o.codes.snow, F.lit(False))), name)


def insufficient(obs: DataFrame, o: HarmonicOptions = HarmonicOptions(), name: str = "keep") -> DataFrame:
    """The standard mask without rows whose green is far above the early median; no early rows, no such limit."""
    df = standard(obs, o, name)
    middle = F.median(F.when(F.col(name) & (F.col("day") <= o.stat_day), F.col("green"))).over(Window.partitionBy("pixel_id"))
    return first_of_day(df.withColumn(name, F.col(name) & F.coalesce(F.col("green") < middle + o.green_margin, F.lit(True))), name)


def rescaled(obs: DataFrame) -> DataFrame:
    return obs.withColumn("thermal", F.col("thermal") * 10 - 27315)


def kept_rank(keep: str = "keep") -> Column:
    """Place of a row among its pixel's kept rows, from 0; null for others."""
    order = Window.partitionBy("pixel_id").orderBy("day", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(F.col(keep), F.sum(F.col(keep).cast("int")).over(order) - 1)


def enough(df: DataFrame, o: HarmonicOptions = HarmonicOptions()) -> DataFrame:
    """Kept rows, their span, and which minimum conditions hold, by pixel."""
    day = F.when(F.col("keep"), F.col("day"))
    out = df.groupBy("pixel_id").agg(F.count_if("keep").alias("n"), (F.max(day) - F.min(day)).alias("span"))
    return out.withColumns({"enough_time": F.coalesce(F.col("span") >= o.day_delta, F.lit(False)), "fallback_fits": F.col("n") >= o.min_obs, "standard_fits": F.col("n") > o.min_obs})
