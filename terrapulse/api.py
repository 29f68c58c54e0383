"""The library's front: detection over arrays, cubes and tables, and its SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from terrapulse.kernel import segments
from terrapulse.operators.detection import _model, detect_changes, detect_packed
from terrapulse.options import BANDS, HarmonicOptions, LassoOptions
from terrapulse.sources import files

__all__ = ["HarmonicOptions", "LassoOptions", "detect", "detect_changes", "detect_cube", "register_sql"]


def detect(dates, spectral, qas, hoptions: HarmonicOptions = HarmonicOptions(), loptions: LassoOptions = LassoOptions()) -> list[dict]:
    """Change models of one pixel, in this process: dates (T,), spectral (7, T), qas (T,). Inputs are left as they are."""
    dates, spectral, qas = np.asarray(dates), np.asarray(spectral), np.asarray(qas)
    files._check(dates, spectral, qas, 0)
    order = np.argsort(dates, kind="stable")
    s = segments.Series(dates[order].astype(np.int64), spectral[:, order].astype(float), qas[order].astype(int))
    name, coroutine = segments.plan(s, hoptions)
    ((found, mask),) = segments.run([coroutine], loptions)
    back = np.zeros(len(mask), np.int8)
    if len(mask):
        back[order] = mask
    return {"procedure": name, "models": [_model(m) for m in found], "processing_mask": back.tolist()}


def detect_cube(spark: SparkSession, dates, spectral, qas, hoptions: HarmonicOptions = HarmonicOptions(), loptions: LassoOptions = LassoOptions()) -> DataFrame:
    """row, col, procedure, models, processing_mask of a cube: spectral (H, W, 7, T), qas (H, W, T)."""
    cube = files.from_cube(spark, dates, spectral, qas)
    return detect_packed(cube, ("row", "col"), hoptions, loptions)


class _Detector:
    """Rows of one pixel in order (pixel_id, day, seven bands, qa) to its change models."""

    def __init__(self):
        self.rows: list[tuple] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        self.rows.append((row["pixel_id"], row["day"], *(float("nan") if row[b] is None else float(row[b]) for b in BANDS), 255 if row["qa"] is None else row["qa"]))
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            table = sorted(enumerate(self.rows), key=lambda r: (r[1][1], r[0]))
            values = [r for _, r in table]
            s = segments.Series(np.array([r[1] for r in values], np.int64), np.array([r[2:9] for r in values], float).T, np.array([r[9] for r in values], int))
            name, coroutine = segments.plan(s, HarmonicOptions())
            ((found, _),) = segments.run([coroutine])
            for k, m in enumerate(found):
                yield values[0][0], name, k, m.start_day, m.end_day, m.break_day, m.count, m.probability, m.curve_qa


def register_sql(spark: SparkSession) -> None:
    """``SELECT * FROM detect_changes(TABLE(obs) PARTITION BY pixel_id ORDER BY (day, seq))``, and scalar helpers."""
    kind = "pixel_id bigint, procedure string, model_idx int, start_day bigint, end_day bigint, break_day bigint, observation_count int, change_probability double, curve_qa int"
    spark.udtf.register("detect_changes", F.udtf(_Detector, returnType=kind))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION to_ordinal(d DATE) RETURNS BIGINT RETURN CAST(unix_date(d) + 719163 AS BIGINT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION from_ordinal(n BIGINT) RETURNS DATE RETURN date_from_unix_date(CAST(n - 719163 AS INT))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION soft_threshold(r DOUBLE, l DOUBLE) RETURNS DOUBLE RETURN signum(r) * greatest(abs(r) - l, 0D)")
