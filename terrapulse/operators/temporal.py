"""Gaps, lags and variability of kept observations (one row an observation: pixel_id, day, seq, bands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.functions.scalars import wider_peek
from terrapulse.options import BANDS, HarmonicOptions


def _ordered():
    return Window.partitionBy("pixel_id").orderBy("day", "seq")


def with_gaps(kept: DataFrame) -> DataFrame:
    """gap: days since the pixel's previous observation."""
    return kept.withColumn("gap", F.col("day") - F.lag("day").over(_ordered()))


def peek_sizes(kept: DataFrame, o: HarmonicOptions = HarmonicOptions()) -> DataFrame:
    """median_gap in whole days and the peek size it leads to, by pixel, over rows up to the statistics day."""
    g = with_gaps(kept.where(F.col("day") <= o.stat_day)).groupBy("pixel_id").agg(F.floor(F.median("gap")).alias("median_gap"))
    return g.withColumn("peek", wider_peek(F.col("median_gap"), o))


def madogram(kept: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Median absolute step to the next observation, by pixel and band."""
    steps = kept.select("pixel_id", *(F.abs(F.col(b) - F.lag(b).over(_ordered())).alias(b) for b in bands))
    return steps.groupBy("pixel_id").agg(*(F.median(b).alias(b) for b in bands))


def packed(kept: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """pixel_id, s: the pixel's observations as one sorted array of structs."""
    return kept.groupBy("pixel_id").agg(F.array_sort(F.collect_list(F.struct("day", "seq", *bands))).alias("s"))


def modal_gaps(kept: DataFrame, lags: int) -> DataFrame:
    """Commonest gap (the least of ties) by pixel and lag, for lags up to ``lags``.

    Each observation meets the next ``lags`` of its own pixel through window functions, without a join.
    """
    w = _ordered()
    gaps = [F.struct(F.lit(k).alias("lag"), (F.lead("day", k).over(w) - F.col("day")).alias("gap")) for k in range(1, lags + 1)]
    pairs = kept.select("pixel_id", F.array(*gaps).alias("all")).select("pixel_id", F.explode("all").alias("g")).where("g.gap is not null")
    return pairs.groupBy("pixel_id", F.col("g.lag").alias("lag")).agg(F.mode("g.gap", True).alias("modal_gap"))


def adjusted_variogram(kept: DataFrame, o: HarmonicOptions = HarmonicOptions(), bands: tuple[str, ...] = BANDS, least_gap: int = 30) -> DataFrame:
    """Median absolute difference by band at the least lag whose commonest gap exceeds ``least_gap``; else the madogram.

    A pixel's series is one packed row, and its lags are tried in order within the row, until one will do.
    """
    p = packed(kept.where(F.col("day") <= o.stat_day), bands).withColumn("n", F.size("s"))
    p = p.where("n > 1").withColumn("days", F.transform("s", lambda x: x["day"]))

    def commonest(lag):
        """Gaps of the lag in order; of the longest run of equal ones, the first."""
        gaps = F.array_sort(F.zip_with(F.slice("days", lag + 1, F.col("n") - lag), F.slice("days", F.lit(1), F.col("n") - lag), lambda a, b: a - b))
        start = F.struct(F.lit(-1).cast("long").alias("v"), F.lit(0).alias("run"), F.lit(-1).cast("long").alias("best"), F.lit(0).alias("top"))

        def step(a, x):
            run = F.when(x == a["v"], a["run"] + 1).otherwise(1)
            return F.transform(F.array(run), lambda r: F.struct(x.alias("v"), r.alias("run"), F.when(r > a["top"], x).otherwise(a["best"]).alias("best"), F.greatest(r, a["top"]).alias("top")))[0]

        return F.aggregate(gaps, start, step, lambda a: a["best"])

    first = F.aggregate(F.sequence(F.lit(1), F.col("n") - 1), F.lit(None).cast("int"), lambda found, k: F.when(found.isNotNull(), found).when(commonest(k) > least_gap, k))
    joined = p.withColumn("lag", first)
    k = F.coalesce("lag", F.lit(1))
    a, b = F.slice("s", k + 1, F.col("n") - k), F.slice("s", F.lit(1), F.col("n") - k)
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    far = F.filter(both, lambda z:F.col("lag").isNull() | (z["a"]["day"] - z["b"]["day"] > least_gap))

    def middle(band: str):
        from terrapulse.functions.scalars import median_of

        return median_of(F.transform("pairs", lambda z: F.abs(z["a"][band] - z["b"][band]))).alias(band)

    return joined.withColumn("pairs", far).select("pixel_id", F.col("lag"), *(middle(x) for x in bands))


def stat_prefix(kept: DataFrame, o: HarmonicOptions = HarmonicOptions()) -> DataFrame:
    return kept.groupBy("pixel_id").agg(F.count_if(F.col("day") <= o.stat_day).alias("prefix"), F.count("*").alias("n"))


def lag_pairs(kept: DataFrame, lag: int, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Each observation with the one ``lag`` later: gap and absolute differences."""
    w = _ordered()
    cols = [(F.lead("day", lag).over(w) - F.col("day")).alias("gap"), *(F.abs(F.lead(b, lag).over(w) - F.col(b)).alias(b) for b in bands)]
    return kept.select("pixel_id", "day", *cols).where("gap is not null")


