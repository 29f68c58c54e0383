"""Files and arrays in and out: observation CSVs, model and mask CSVs, NumPy series and cubes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.operators.detection import models, wide
from terrapulse.options import BANDS

OBS_CSV = "day BIGINT, " + ", ".join(f"{b} DOUBLE" for b in BANDS) + ", qa SMALLINT"
SERIES = "days ARRAY<BIGINT>, bands ARRAY<ARRAY<DOUBLE>>, qas ARRAY<SMALLINT>"
#: Bytes of a cube that are handed to Spark at once.
BLOCK = 64 << 20


def read_observations(spark: SparkSession, path: str, pixel_id: int = 0) -> DataFrame:
    """Headerless rows of day, seven bands and code; one file is one pixel. seq follows the order of the file."""
    df = spark.read.schema(OBS_CSV).csv(path)
    return df.select(F.lit(pixel_id).cast("long").alias("pixel_id"), F.monotonically_increasing_id().alias("seq"), *df.columns)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """The wide model table of ``write_models``."""
    whole = {"start_day", "end_day", "break_day", "observation_count", "curve_qa"}
    names = spark.read.option("header", True).csv(path).columns
    return spark.read.option("header", True).schema(", ".join(f"`{n}` {'BIGINT' if n in whole else 'DOUBLE'}" for n in names)).csv(path)


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("mask TINYINT").csv(path)


def write_models(detected: DataFrame, path: str, keys: tuple[str, ...] = ("pixel_id",)) -> None:
    """One row a model, 76 columns after the keys."""
    wide(models(detected, keys), keys).write.option("header", True).csv(path)


def _check(days: np.ndarray, bands: np.ndarray, qas: np.ndarray, lead: int) -> None:
    if days.ndim != 1 or bands.ndim != lead + 2 or qas.ndim != lead + 1:
        raise ValueError(f"expected days (T,), bands with {lead + 2} axes and codes with {lead + 1}")
    if bands.shape[-2] != len(BANDS) or bands.shape[-1] != len(days) or qas.shape[-1] != len(days) or bands.shape[:lead] != qas.shape[:lead]:
        raise ValueError(f"shapes don't agree: days {days.shape}, bands {bands.shape}, codes {qas.shape}")


def from_series(spark: SparkSession, days: np.ndarray, bands: np.ndarray, qas: np.ndarray, pixel_id: int = 0) -> DataFrame:
    """A packed row of one pixel: days (T,), bands (7, T), codes (T,)."""
    days, bands, qas = map(np.asarray, (days, bands, qas))
    _check(days, bands, qas, 0)
    return spark.createDataFrame([(pixel_id, days.tolist(), bands.astype(float).tolist(), qas.astype(int).tolist())], f"pixel_id BIGINT, {SERIES}")


def from_cube(spark: SparkSession, days: np.ndarray, bands: np.ndarray, qas: np.ndarray) -> DataFrame:
    """Packed rows keyed by row and col: days (T,) are shared, bands (H, W, 7, T), codes (H, W, T).

    The array is in the driver's memory already; it goes over in blocks of rows. Larger scenes belong in Parquet, in the packed or long form.
    """
    days, bands, qas = map(np.asarray, (days, bands, qas))
    _check(days, bands, qas, 2)
    h, w = qas.shape[:2]
    step = max(1, BLOCK // max(1, bands[:1].nbytes))
    out = None
    for r in range(0, h, step):
        rows = [(r + i, j, bands[r + i, j].astype(float).tolist(), qas[r + i, j].astype(int).tolist()) for i in range(min(step, h - r)) for j in range(w)]
        part = spark.createDataFrame(rows, "row INT, col INT, bands ARRAY<ARRAY<DOUBLE>>, qas ARRAY<SMALLINT>")
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], "row INT, col INT, bands ARRAY<ARRAY<DOUBLE>>, qas ARRAY<SMALLINT>")
    return out.select("row", "col", F.lit(days.tolist()).cast("array<bigint>").alias("days"), "bands", "qas")


def tiled(series: DataFrame, height: int, width: int) -> DataFrame:
    """One packed pixel repeated over a grid; row and col come from a linear id."""
    grid = series.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("row"), F.pmod("id", F.lit(width)).cast("int").alias("col"))
    one = series.limit(1).select("days", "bands", "qas").first()
    if one is None:
        raise ValueError("no pixel to repeat")
    lit = {"days": F.lit(one["days"]).cast("array<bigint>"), "bands": F.array(*(F.lit(b).cast("array<double>") for b in one["bands"])), "qas": F.lit(one["qas"]).cast("array<smallint>")}
    return grid.withColumns(lit)


def to_dicts(detected: DataFrame) -> list[dict]:
    """Results as plain dictionaries; for a few pixels, as everything comes to the driver."""
    return [r.asDict(recursive=True) for r in detected.collect()]


def to_pandas(detected: DataFrame, keys: tuple[str, ...] = ("pixel_id",)) -> pd.DataFrame:
    return wide(models(detected, keys), keys).toPandas()
