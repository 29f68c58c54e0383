"""Catalog queries against their SQL oracles on the smallest tables, and the DataFrame, SQL and streaming fronts."""

import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapulse import api
from terrapulse.functions import scalars
from terrapulse.operators import detection, masks, scoring
from terrapulse.plans import catalog
from terrapulse.sources import files
from terrapulse.sources.tables import observations
from terrapulse.streaming import incremental
from tests.test_kernel import GOLDEN, golden, synthetic

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 3) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def compare(got, want):
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [sorted((tuple(plain(v) for v in r) for r in d), key=str) for d in (got.select(names).collect(), want.select(*names).fetchall())]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@data
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    compare(catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLES[name]))


@data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0


@data
def test_models_of_pixels_are_as_literal_ones(spark):
    """Models and norms from tables, joined by pixel and band, give what literals give."""
    kept = masks.standard(observations(spark, DATA)).where("keep").drop("keep")
    pixels = kept.select("pixel_id").distinct()
    weights = [[0.001 * (k + 1), 10.0, -5.0, 3.0, 2.0, 1.0, 0.5] for k in range(7)]
    models = pixels.select("pixel_id", F.inline(F.array(*(F.struct(F.lit(k).alias("band"), F.lit(500.0 * k).alias("intercept"), F.array(*map(F.lit, w)).alias("weights")) for k, w in enumerate(weights)))))
    norms = pixels.select("pixel_id", F.inline(F.array(*(F.struct(F.lit(k).alias("band"), F.lit(0.0 if k == 3 else 1000.0 + 100 * k).alias("norm")) for k in range(7)))))
    scored = scoring.residuals(kept, models)
    for name, got in (("change_magnitudes", scoring.change_magnitudes(scored, norms)), ("stability", scoring.stability(scored, models, norms)), ("model_scores", scoring.score(scored, 8))):
        want = {tuple(r[:-2]) if name != "change_magnitudes" else tuple(r[:-1]): r for r in catalog.QUERIES[name](spark, DATA).collect()}
        rows = got.collect()
        assert len(rows) == len(want) > 0
        key = {"change_magnitudes": 3, "stability": 1, "model_scores": 3}[name]
        own = {tuple(r[:key]): r for r in want.values()}
        for r in rows:
            for a, b in zip(tuple(r)[key:], tuple(own[tuple(r[:key])])[key:]):
                assert a == b or a == pytest.approx(b, abs=1e-4)


@data
def test_first_of_day_with_null_days(spark):
    rows = [(1, None, 1, True), (1, None, 2, True), (1, 5, 3, False), (1, 5, 4, True), (1, 5, 5, True), (2, 5, 1, True)]
    got = masks.first_of_day(spark.createDataFrame(rows, "pixel_id INT, day INT, seq INT, keep BOOLEAN"), "keep")
    assert [r["keep"] for r in got.orderBy("pixel_id", "seq").collect()] == [True, False, False, True, False, True]


@data
@pytest.mark.parametrize("name", ["mask_insufficient", "model_scores", "change_magnitudes", "stability", "adjusted_variogram"])
def test_one_scan_and_one_exchange(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "Join" not in plan


@data
@pytest.mark.parametrize("name", ["procedure_standard", "pixel_results", "change_models", "wide_models"])
def test_detection_reads_sorted_rows(spark, name):
    """No arrays of a series are made in the JVM, and the series are exchanged once."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1 and plan.count("FileScan") == 1


@data
def test_rows_and_packed_series_give_the_same(spark):
    obs = observations(spark, DATA).where("pixel_id < 6")
    obs = obs.withColumn("part", F.when(F.col("seq") % 2 == 0, F.lit("even")))
    keys = ("pixel_id", "part")
    rows, packed = (sorted(d.collect(), key=str) for d in (detection.detect_changes(obs, keys, procedure="snow"), detection.detect_packed(detection.pack(obs, keys), keys, procedure="snow")))
    assert rows == packed and len(rows) == 2 * obs.select("pixel_id").distinct().count() and any(r["models"] for r in rows)


def test_series_are_put_together_whole(monkeypatch):
    monkeypatch.setattr(detection, "STEP", 3)
    monkeypatch.setattr(detection, "OBSERVATIONS", 20)
    keys = np.repeat(np.arange(9), [1, 2, 50, 3, 1, 1, 1, 1, 7])
    t = pa.table({"k": keys, "starts": np.diff(keys, prepend=-1) > 0})
    for size in (1, 4, 100):
        got = [(p["k"].to_pylist(), at.tolist()) for p, at in detection._whole(iter(t.to_batches(size)))]
        assert sum((k for k, _ in got), []) == keys.tolist()
        assert all(at == [i for i, x in enumerate(k) if not i or x != k[i - 1]] for k, at in got)
        assert not any(set(a) & set(b) for (a, _), (b, _) in zip(got, got[1:])) and len(got) > 1


@golden
def test_csv_to_wide_csv(spark, tmp_path):
    obs = files.read_observations(spark, GOLDEN["observations"])
    out = detection.detect_changes(obs)
    files.write_models(out, str(tmp_path / "models"))
    got = files.read_models(spark, str(tmp_path / "models")).drop("pixel_id").toPandas().sort_values("start_day").reset_index(drop=True)
    want = files.read_models(spark, GOLDEN["models_standard"]).toPandas()
    assert got.shape == (5, 76)
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-6), c
    mask = out.select(F.explode("processing_mask")).agg(F.sum("col")).first()[0]
    assert mask == files.read_mask(spark, GOLDEN["mask_standard"]).agg(F.sum("mask")).first()[0]


def _obs(spark, series):
    return detection.unpack(files.from_series(spark, series.days, series.bands, series.qas, 7))


def test_one_pixel_many_ways(spark):
    s = synthetic(150, step=80)
    alone = api.detect(s.days, s.bands, s.qas)
    packed = files.to_dicts(detection.detect_packed(files.from_series(spark, s.days, s.bands, s.qas)))[0]
    assert packed["procedure"] == alone["procedure"] and packed["processing_mask"] == alone["processing_mask"]
    assert [m["break_day"] for m in packed["models"]] == [m["break_day"] for m in alone["models"]]
    cube = api.detect_cube(spark, s.days, np.broadcast_to(s.bands, (2, 3, *s.bands.shape)), np.broadcast_to(s.qas, (2, 3, len(s.qas)))).collect()
    assert {(r["row"], r["col"]) for r in cube} == {(i, j) for i in range(2) for j in range(3)}
    assert all([m["break_day"] for m in r["models"]] == [m["break_day"] for m in alone["models"]] for r in cube)
    tiled = detection.detect_packed(files.tiled(files.from_series(spark, s.days, s.bands, s.qas), 2, 2), ("row", "col"))
    assert tiled.count() == 4
    api.register_sql(spark)
    _obs(spark, s).createOrReplaceTempView("one_pixel")
    rows = spark.sql("SELECT * FROM detect_changes(TABLE(one_pixel) PARTITION BY pixel_id ORDER BY (day, seq)) ORDER BY model_idx").collect()
    assert [r["break_day"] for r in rows] == [m["break_day"] for m in alone["models"]]
    assert spark.sql("SELECT to_ordinal(DATE '2017-12-31') AS n, from_ordinal(736694) AS d, soft_threshold(-7, 5) AS s").first()[0] == 736694


def test_shapes_are_checked(spark):
    s = synthetic(20)
    with pytest.raises(ValueError):
        api.detect(s.days[:-1], s.bands, s.qas)
    with pytest.raises(ValueError):
        api.detect_cube(spark, s.days, s.bands, s.qas)


def test_empty_and_null_observations(spark):
    schema = "pixel_id BIGINT, seq BIGINT, day BIGINT, " + ", ".join(f"{b} DOUBLE" for b in masks.BANDS) + ", qa SMALLINT"
    assert detection.detect_changes(spark.createDataFrame([], schema)).count() == 0
    got = detection.detect_changes(spark.createDataFrame([(1, 0, 730000, *[None] * 7, None)], schema)).first()
    assert got["procedure"] == "insufficient" and got["models"] == [] and got["processing_mask"] == []


def test_nan_in_masks(spark):
    nan = float("nan")
    rows = [(1, 0, 1, 1.0, nan, 1.0, 1.0, 1.0, 1.0, 2900.0, 0), (1, 1, 2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, nan, 0), (1, 2, 3, 1.0, 20000.0, 1.0, 1.0, 1.0, 1.0, 2900.0, 0)]
    schema = "pixel_id BIGINT, seq BIGINT, day BIGINT, " + ", ".join(f"{b} DOUBLE" for b in masks.BANDS) + ", qa INT"
    got = {r["seq"]: r["keep"] for r in masks.standard(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_thresholds():
    assert scalars.chi2_quantile(0.99) == pytest.approx(15.086272469388987, rel=1e-9)
    assert scalars.chi2_quantile(1 - 1e-6) == pytest.approx(35.888186879610423, rel=1e-9)
    assert scalars.change_threshold(6, 6, 15.0) == 15.0 and scalars.change_threshold(12, 6, 15.0) < 15.0


@data
def test_filters_reach_the_scan(spark):
    plan = observations(spark, DATA).where("pixel_id = 3").select("pixel_id", "day")._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" in plan.split("PushedFilters")[1] and "l_comment" not in plan


def test_stream_equals_batch(spark, tmp_path):
    s = synthetic(120, step=60)
    obs = _obs(spark, s)
    for k, cut in enumerate((obs.where("seq < 60"), obs.where("seq >= 60"))):
        cut.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
        incremental.detect_touched(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = incremental.latest(spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))).first()
    want = detection.detect_changes(obs).first()
    assert [m["break_day"] for m in got["models"]] == [m["break_day"] for m in want["models"]]
    running = incremental.running_statistics(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")))
    q = running.writeStream.format("memory").queryName("qa_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("qa_now").first()["total"] == 120
