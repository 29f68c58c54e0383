"""Change detection over many pixels: one exchange by pixel, then an Arrow kernel over sorted rows or packed series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapulse.kernel import lasso, robust, segments
from terrapulse.options import BANDS, HarmonicOptions, LassoOptions, RobustOptions

BAND_FIELDS = "struct<name:string,rmse:double,magnitude:double,intercept:double,coefficients:array<double>>"
MODEL = f"struct<start_day:bigint,end_day:bigint,break_day:bigint,observation_count:int,change_probability:double,curve_qa:smallint,bands:array<{BAND_FIELDS}>>"
#: Pixels whose coroutines run in step, and the observations that bound them for the worker's memory.
STEP, OBSERVATIONS = 1024, 1 << 19


def _fields() -> list[Column]:
    """day, seq, seven bands, qa, which also is the order of a series. Null bands are NaN and null codes are fill."""
    one = [F.coalesce(F.col(b).cast("double"), F.lit(float("nan"))).alias(b) for b in BANDS]
    return [F.col("day").cast("long").alias("day"), F.col("seq").cast("long").alias("seq"), *one, F.coalesce(F.col("qa").cast("smallint"), F.lit(255).cast("smallint")).alias("qa")]


def pack(obs: DataFrame, keys: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    """keys, days, bands (seven arrays), qas: sorted by day, then input order."""
    s = obs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_fields()))).alias("s"))
    return s.select(*keys, F.col("s.day").alias("days"), F.array(*(F.col(f"s.{b}") for b in BANDS)).alias("bands"), F.col("s.qa").alias("qas"))


def unpack(series: DataFrame, keys: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    """The long form of packed series."""
    rows = series.select(*keys, "bands", "qas", F.posexplode("days").alias("seq", "day"))
    bands = [F.get(F.col("bands")[k], F.col("seq")).alias(b) for k, b in enumerate(BANDS)]
    return rows.select(*keys, F.col("seq").cast("long").alias("seq"), "day", *bands, F.get("qas", F.col("seq")).alias("qa"))


def _series(batch: pa.RecordBatch) -> list[segments.Series]:
    out = []
    for days, bands, qas in zip(batch["days"], batch["bands"], batch["qas"]):
        d = days.values.to_numpy(zero_copy_only=False).astype(np.int64)
        y = np.stack([b.values.to_numpy(zero_copy_only=False) for b in bands]).astype(float) if len(d) else np.zeros((len(BANDS), 0))
        out.append(segments.Series(d, y, qas.values.to_numpy(zero_copy_only=False).astype(int)))
    return out


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most STEP pixels that have at most OBSERVATIONS observations together, or of one pixel."""
    ends, i = np.cumsum(np.diff(batch["days"].offsets)), 0
    while i < batch.num_rows:
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + OBSERVATIONS, "right"))
        j = min(max(j, i + 1), i + STEP, batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows of whole series, about STEP series or OBSERVATIONS rows at once, and where each series starts."""
    held, rows, pixels = [], 0, 0
    for b in batches:
        held.append(b)
        rows, pixels = rows + b.num_rows, pixels + b["starts"].true_count
        if pixels > 1 and (pixels > STEP or rows >= OBSERVATIONS):
            t = pa.Table.from_batches(held).combine_chunks()
            at = np.flatnonzero(t["starts"].to_numpy())
            yield t.slice(0, at[-1]), at[:-1]
            held, rows, pixels = t.slice(at[-1]).to_batches(), t.num_rows - int(at[-1]), 1
    if rows:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.flatnonzero(t["starts"].to_numpy())


def _model(s: segments.Segment) -> dict:
    bands = [{"name": b, "rmse": float(s.fit.rmse[k]), "magnitude": float(s.magnitude[k]), "intercept": float(s.fit.intercept[k]), "coefficients": s.fit.weights[k].tolist()} for k, b in enumerate(BANDS)]
    return {"start_day": s.start_day, "end_day": s.end_day, "break_day": s.break_day, "observation_count": s.count, "change_probability": s.probability, "curve_qa": s.curve_qa, "bands": bands}


def _schema(df: DataFrame, keys: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + T._parse_datatype_string(f"procedure string, models array<{MODEL}>, processing_mask array<tinyint>").fields)


def _detected(keys: list, series: list[segments.Series], schema: T.StructType, o: HarmonicOptions, lo: LassoOptions, procedure: str | None) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    planned = [segments.plan(s, o, procedure) for s in series]
    done = segments.run([p for _, p in planned], lo)
    models = pa.array([[_model(m) for m in got] for got, _ in done], to_arrow_type(schema["models"].dataType))
    masks = pa.array([mask.astype(np.int8) for _, mask in done], pa.list_(pa.int8()))
    return pa.RecordBatch.from_arrays([*keys, pa.array([name for name, _ in planned]), models, masks], schema.names)


def detect_packed(series: DataFrame, keys: tuple[str, ...] = ("pixel_id",), o: HarmonicOptions = HarmonicOptions(), lo: LassoOptions = LassoOptions(), procedure: str | None = None) -> DataFrame:
    """keys, procedure, models, processing_mask: one row a pixel.

    A pixel without enough observations has no models and an empty mask. Rows of other keys don't meet, so a caller's filter on
    keys belongs before this call.
    """
    schema = _schema(series, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b):
                yield _detected([part[k] for k in keys], _series(part), schema, o, lo, procedure)

    return series.select(*keys, "days", "bands", "qas").mapInArrow(run, schema)


def detect_changes(obs: DataFrame, keys: tuple[str, ...] = ("pixel_id",), o: HarmonicOptions = HarmonicOptions(), lo: LassoOptions = LassoOptions(), partitions: int | None = None, procedure: str | None = None) -> DataFrame:
    """``detect_packed`` of long observations (keys, day, seq, seven bands, qa), which go to the kernel as sorted rows: arrays of series cost
    the JVM more than the sort, and the sort spills.

    ``partitions`` sets the number of kernel tasks by pixel explicitly: adaptive coalescing goes by bytes, but the kernel's cost goes by pixels.
    """
    if partitions:
        obs = obs.repartition(partitions, *keys)
    schema = _schema(obs, keys)
    own = [f"key{i}" for i in range(len(keys))]
    rows = obs.select(*(F.col(k).alias(n) for k, n in zip(keys, own)), *_fields())
    place = F.row_number().over(Window.partitionBy(*own).orderBy("day", "seq", *BANDS, "qa"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _whole(batches):
            days, qas = (t[c].to_numpy().astype(np.int64) for c in ("day", "qa"))
            bands = np.stack([t[b].to_numpy() for b in BANDS])
            series = [segments.Series(days[i:j], bands[:, i:j], qas[i:j]) for i, j in zip(at, [*at[1:], len(days)])]
            yield _detected([t[n].take(at).combine_chunks() for n in own], series, schema, o, lo, procedure)

    return rows.select(*own, "day", *BANDS, "qa", (place == 1).alias("starts")).mapInArrow(run, schema)


def models(detected: DataFrame, keys: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    """One row a change model."""
    out = detected.select(*keys, "procedure", F.posexplode("models").alias("model_idx", "m"))
    return out.select(*keys, "procedure", "model_idx", "m.*")


def wide(model_rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The 76-column form: model fields, then rmse, intercept, magnitude and seven coefficients of each band."""
    cols = []
    for k, b in enumerate(BANDS):
        band = F.col("bands")[k]
        cols += [band[f].alias(f"{b}_{f}") for f in ("rmse", "intercept", "magnitude")] + [band["coefficients"][j].alias(f"{b}_coef_{j}") for j in range(7)]
    return model_rows.select(*keys, "start_day", "end_day", "break_day", "observation_count", "curve_qa", "change_probability", *cols)


def fit_series(series: DataFrame, terms: int = 4, lo: LassoOptions = LassoOptions()) -> DataFrame:
    """LASSO of each packed series as it stands: pixel_id, band, iterations, intercept, coefficients, rmse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                part = b.slice(i, STEP)
                got = [(p, f) for p, s in zip(part["pixel_id"].to_pylist(), _series(part)) if len(s.days) for f in lasso.fit_many([(s.days, s.bands, terms)], lo)]
                rows = [(p, k, int(f.iterations[k]), float(f.intercept[k]), f.weights[k].tolist(), float(f.rmse[k])) for p, f in got for k in range(len(f.rmse))]
                cols = list(zip(*rows)) or [[]] * 6
                kinds = [part["pixel_id"].type, pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["pixel_id", "band", "iterations", "intercept", "weights", "rmse"])

    kind = series.schema["pixel_id"].dataType.simpleString()
    return series.select("pixel_id", "days", "bands", "qas").mapInArrow(run, f"pixel_id {kind}, band int, iterations int, intercept double, weights array<double>, rmse double")


def robust_series(series: DataFrame, bands: tuple[int, ...] = (1, 4), ro: RobustOptions = RobustOptions(max_iter=5)) -> DataFrame:
    """Robust fit of each packed series: pixel_id, band, coefficients, rmse over five degrees of freedom."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, s in zip(b["pixel_id"].to_pylist(), _series(b)):
                if len(s.days) > 5:
                    x = robust.screen_basis(s.days)
                    for k in bands:
                        beta = robust.fit(x, s.bands[k], ro)
                        rows.append((p, k, beta.tolist(), float(lasso.rmse(s.bands[k] - x @ beta, 5))))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b["pixel_id"].type, pa.int32(), pa.list_(pa.float64()), pa.float64()])], ["pixel_id", "band", "coefficients", "rmse"])

    kind = series.schema["pixel_id"].dataType.simpleString()
    return series.select("pixel_id", "days", "bands", "qas").mapInArrow(run, f"pixel_id {kind}, band int, coefficients array<double>, rmse double")
