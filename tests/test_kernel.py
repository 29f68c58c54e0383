"""The numeric kernel against golden outputs and against itself."""

import numpy as np
import pandas as pd
import pytest

from terrapulse.kernel import lasso, robust, segments
from terrapulse.options import BANDS, HarmonicOptions, LassoOptions, RobustOptions
from tests.golden import find

GOLDEN = find()
golden = pytest.mark.skipif(len(GOLDEN) < 9, reason="golden outputs aren't here")
O = HarmonicOptions()


def fixture_series():
    d = np.loadtxt(GOLDEN["observations"], delimiter=",")
    return segments.Series(d[:, 0].astype(np.int64), d[:, 1:8].T.copy(), d[:, 8].astype(int))


def synthetic(n=160, step=None, cadence=16, seed=1, start=724000):
    rng = np.random.default_rng(seed)
    days = start + cadence * np.arange(n)
    wave = 300 * np.cos(lasso.OMEGA * days) + 100 * np.sin(lasso.OMEGA * days)
    y = np.stack([1500 + 100 * b + wave + rng.normal(0, 15, n) for b in range(7)])
    if step is not None:
        y[:6, step:] += 1500
    y[6] = 2900 + rng.normal(0, 3, n)
    return segments.Series(days, y, np.zeros(n, int))


@golden
@pytest.mark.parametrize("name", ["standard", "snow", "insufficient"])
def test_golden_procedures(name):
    ((found, mask),) = segments.run([segments.plan(fixture_series(), O, name)[1]])
    want = pd.read_csv(GOLDEN[f"models_{name}"]).to_dict("records")
    assert mask.astype(int).tolist() == pd.read_csv(GOLDEN[f"mask_{name}"])["mask"].tolist()
    assert len(found) == len(want)
    for m, w in zip(found, want):
        assert (m.start_day, m.end_day, m.break_day, m.count, m.curve_qa) == tuple(int(w[k]) for k in ("start_day", "end_day", "break_day", "observation_count", "curve_qa"))
        assert m.probability == pytest.approx(w["change_probability"], abs=1e-8)
        for k, b in enumerate(BANDS):
            assert m.fit.rmse[k] == pytest.approx(w[f"{b}_rmse"], abs=1e-6)
            assert m.fit.intercept[k] == pytest.approx(w[f"{b}_intercept"], abs=1e-6)
            assert m.magnitude[k] == pytest.approx(w[f"{b}_magnitude"], abs=1e-6)
            for j in range(7):
                assert m.fit.weights[k, j] == pytest.approx(w[f"{b}_coef_{j}"], abs=1e-6)


@golden
def test_golden_routing():
    s = fixture_series()
    assert segments.route(s, O) == "standard"
    assert segments.shares(s, O) == pytest.approx((0.67268623, 0.03870843), abs=1e-7)


@golden
def test_golden_regressions():
    """The twelve days of the regression goldens are rows of the observation fixture, with the thermal band rescaled."""
    days = np.array([724387, 724419, 724451, 724483, 724547, 724739, 724867, 724915, 724931, 724947, 725075, 725091])
    s = segments.rescaled(fixture_series())
    y = s.bands[:, np.searchsorted(s.days, days)]
    (f,) = lasso.fit_many([(days, y, 4)])
    want = pd.read_csv(GOLDEN["lasso"])
    assert f.iterations.tolist() == want["iterations"].tolist()
    for k, w in enumerate(want.to_dict("records")):
        assert f.intercept[k] == pytest.approx(w["intercept"], abs=1e-7)
        assert f.weights[k, :3] == pytest.approx([w[f"coef_{j}"] for j in range(3)], abs=1e-8)
        assert f.rmse[k] == pytest.approx(w["rmse"], abs=1e-8)
    x = robust.screen_basis(days)
    for k, w in enumerate(pd.read_csv(GOLDEN["robust"]).to_dict("records")):
        beta = robust.fit(x, y[k], RobustOptions(max_iter=5))
        assert beta == pytest.approx([w[f"coef_{j}"] for j in range(5)], abs=1e-7)


def test_lasso_satisfies_its_optimality_conditions():
    s = synthetic(60)
    (f,) = lasso.fit_many([(s.days, s.bands, 8)], LassoOptions(tolerance=1e-12, max_iter=100_000))
    x = lasso.basis(s.days)
    c = (x - x.mean(1, keepdims=True)) @ f.residuals.T / len(s.days)
    for b in range(7):
        for j in range(7):
            if f.weights[b, j]:
                assert c[j, b] == pytest.approx(np.sign(f.weights[b, j]), abs=1e-3)
            else:
                assert abs(c[j, b]) <= 1 + 1e-6


@pytest.mark.parametrize("terms", [4, 6, 8])
def test_few_lanes_agree_with_many(terms, monkeypatch):
    """Plain numbers and arrays take the same steps: equal weights and as many cycles."""
    windows = [synthetic(n, seed=n) for n in (12, 24, 60, 150)]
    few = [lasso.fit_many([(s.days, s.bands, terms)])[0] for s in windows]
    monkeypatch.setattr(lasso, "FEW_LANES", 0)
    for s, f in zip(windows, few):
        (g,) = lasso.fit_many([(s.days, s.bands, terms)])
        assert f.iterations.tolist() == g.iterations.tolist() and f.weights == pytest.approx(g.weights, abs=1e-12)
        assert f.intercept == pytest.approx(g.intercept, abs=1e-6) and f.rmse == pytest.approx(g.rmse, nan_ok=True)


def test_missing_and_constant_values_fit_alike(monkeypatch):
    s = synthetic(40)
    s.bands[2] = 7.0
    s.bands[3, 5] = np.nan
    (f,) = lasso.fit_many([(s.days, s.bands, 4)])
    monkeypatch.setattr(lasso, "FEW_LANES", 0)
    (g,) = lasso.fit_many([(s.days, s.bands, 4)])
    assert f.weights == pytest.approx(g.weights, nan_ok=True) and f.iterations.tolist() == g.iterations.tolist()


def test_lanes_agree_with_single_robust_fits():
    windows = [synthetic(n, seed=n) for n in (30, 41, 75)]
    limits = np.array([40.0, 40.0])
    got = robust.screen([(s.days, s.bands[[1, 4]], limits) for s in windows])
    for s, g in zip(windows, got):
        x = robust.screen_basis(s.days)
        want = np.zeros(len(s.days), bool)
        for b in (1, 4):
            beta = robust.fit(x, s.bands[b], RobustOptions(max_iter=5))
            want |= np.abs(x @ beta - s.bands[b]) > 40
        assert (g == want).all()


def test_window_of_one_year_is_rank_deficient_but_works():
    s = synthetic(24)
    days = s.days[0] + np.linspace(0, 365, 24).astype(int)
    (out,) = robust.screen([(days, s.bands[[1, 4]], np.array([1e9, 1e9]))])
    assert not out.any()


def test_step_change_is_found_and_spikes_are_dropped():
    s = synthetic(200, step=100)
    s.bands[:6, 40] += 6000
    ((found, mask),) = segments.run([segments.plan(s, O)[1]])
    assert [m.probability for m in found][0] == 1.0
    assert found[0].break_day == s.days[100]
    assert not mask[40]


def test_batches_agree_with_single_runs():
    many = [synthetic(150, step=k, seed=k) for k in (60, 80, 100)] + [synthetic(20), synthetic(5)]
    together = segments.run([segments.plan(s, O)[1] for s in many])
    for s, (found, mask) in zip(many, together):
        ((alone, own),) = segments.run([segments.plan(s, O)[1]])
        assert (mask == own).all() and [(m.start_day, m.end_day, m.break_day, m.count) for m in found] == [(m.start_day, m.end_day, m.break_day, m.count) for m in alone]


@pytest.mark.parametrize("n,models", [(0, 0), (5, 0), (12, 0)])
def test_short_series(n, models):
    ((found, mask),) = segments.run([segments.standard(segments.rescaled(synthetic(n)), O)])
    assert len(found) == models and len(mask) == 0


def test_twelve_kept_are_enough_for_a_single_fit():
    s = synthetic(12)
    ((found, _),) = segments.run([segments.single(s, segments.usable(s, O), segments.INSUFFICIENT, O)])
    assert len(found) == 1 and found[0].count == 12


def test_duplicates_fill_nan_and_late_days():
    s = synthetic(40)
    s.days[5] = s.days[4]
    s.bands[2, 7] = np.nan
    s.bands[6, 8] = np.nan
    s.qas[9] = 255
    keep = segments.usable(segments.rescaled(s), O)
    assert keep[4] and not keep[5] and keep[7] and not keep[8] and not keep[9]
    late = synthetic(40, start=740000)
    assert segments.route(late, O) == "insufficient"


def test_dense_cadence_widens_the_peek():
    assert segments.wider_peek(np.arange(0, 400, 8), 6) == 12
    assert segments.wider_peek(np.arange(0, 400, 16), 6) == 6
    assert segments.wider_peek(np.array([1]), 6) == 6


def test_snow_routes_and_keeps_snow():
    s = synthetic(60)
    s.qas[:] = 3
    name, coroutine = segments.plan(s, O)
    ((found, mask),) = segments.run([coroutine])
    assert name == "snow" and found[0].curve_qa == 54 and mask.sum() == 60


def test_steps_forward_share_their_work(monkeypatch):
    """Between two fits, distances within a year are worked out for many steps at once and predictions need no new basis."""
    s, calls = synthetic(400), []
    for module, name in ((segments, "nearest_in_season"), (lasso, "basis")):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, f=f, name=name: calls.append(name) or f(*a))
    ((found, mask),) = segments.run([segments.plan(s, O)[1]])
    assert found[0].count > 300 and 0 < calls.count("nearest_in_season") < 40 and calls.count("basis") == 1


def test_outliers_ahead_are_dropped_one_after_another():
    """Spikes alone and in a row ahead of a break: the result is that of the series without them."""
    s = synthetic(260, step=200, seed=3)
    spikes = [90, 91, 92, 120, 121, 150, 190]
    s.bands[:6, spikes] += 5000
    ((found, mask),) = segments.run([segments.plan(s, O)[1]])
    stay = np.setdiff1d(np.arange(260), spikes)
    ((want, _),) = segments.run([segments.plan(segments.Series(s.days[stay], s.bands[:, stay], s.qas[stay]), O)[1]])
    assert not mask[spikes].any() and mask.sum() == len(stay)
    assert [(m.start_day, m.end_day, m.break_day, m.count) for m in found] == [(m.start_day, m.end_day, m.break_day, m.count) for m in want]
    assert found[0].break_day == s.days[200] and found[0].magnitude == pytest.approx(want[0].magnitude)
