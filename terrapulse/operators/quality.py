"""Quality statistics and routing of pixels to procedures: one partial and final hash aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.options import HarmonicOptions


def counters(o: HarmonicOptions, upto: Column | None = None) -> list[Column]:
    qa = F.coalesce(F.col("qa").cast("int"), F.lit(o.codes.fill))
    on = F.lit(True) if upto is None else upto
    kinds = [(k, getattr(o.codes, k)) for k in ("fill", "clear", "water", "snow", "cloud")]
    return [F.count_if((qa == v) & on).alias(k) for k, v in kinds] + [F.count_if(on).alias("total")]


def ratios(df: DataFrame) -> DataFrame:
    valid = F.col("total") - F.col("fill")

    def over_valid(x: Column) -> Column:
        return F.when(valid > 0, x / valid).otherwise(0.0)

    seen = F.col("clear") + F.col("water")
    return df.withColumns(
        {
            "cloud_ratio": over_valid(F.col("cloud")),
            "snow_ratio": F.when(valid > 0, F.col("snow") / (seen + F.col("snow") + 0.01)).otherwise(0.0),
            "water_ratio": F.when(valid > 0, F.col("water") / (seen + 0.01)).otherwise(0.0),
            "clear_ratio": over_valid(seen),
        }
    )


def procedure(o: HarmonicOptions) -> Column:
    return F.when(F.col("clear_ratio") >= o.clear_share, "standard").when(F.col("snow_ratio") >= o.snow_share, "snow").otherwise("insufficient")


def statistics(obs: DataFrame, o: HarmonicOptions = HarmonicOptions(), until: bool = True) -> DataFrame:
    """Counters, ratios and the procedure by pixel; ``until`` counts rows up to the statistics day only, but lists every pixel."""
    upto = (F.col("day") <= o.stat_day) if until else None
    return ratios(obs.groupBy("pixel_id").agg(*counters(o, upto))).withColumn("procedure", procedure(o))
