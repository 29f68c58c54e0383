"""Change models of one pixel as a coroutine, and a scheduler that runs the coroutines of a batch in step.

A pixel asks for fits and outlier screens and is resumed with the results; the scheduler answers the requests of all pixels of a
batch together, so the numerics run over arrays of pixels although every pixel takes its own path.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable
from dataclasses import dataclass

import numpy as np

from terrapulse.kernel import lasso, robust
from terrapulse.options import REFLECTANCE_HIGH, SEASON_YEAR, THERMAL_HIGH, THERMAL_LOW, HarmonicOptions, LassoOptions

INSUFFICIENT, SNOW, START, END = 44, 54, 14, 24
#: Forward steps that are worked out at once, and the range of gaps up to which they are counted in a table.
AHEAD, GAPS = 64, 1 << 14


@dataclass
class Series:
    days: np.ndarray
    bands: np.ndarray  # (7, n)
    qas: np.ndarray


@dataclass
class Segment:
    start_day: int
    end_day: int
    break_day: int
    count: int
    probability: float
    curve_qa: int
    fit: lasso.Fit
    magnitude: np.ndarray


def first_of_day(days: np.ndarray, keep: np.ndarray) -> np.ndarray:
    kept = np.flatnonzero(keep)
    out = np.zeros(len(days), bool)
    out[kept[np.append(True, days[kept][1:] != days[kept][:-1])] if len(kept) else kept] = True
    return out


def usable(s: Series, o: HarmonicOptions) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        odd = ((s.bands[:6] < 0) | (s.bands[:6] > REFLECTANCE_HIGH)).any(0)
        warm = (s.bands[6] > THERMAL_LOW) & (s.bands[6] < THERMAL_HIGH)
    return first_of_day(s.days, np.isin(s.qas, (o.codes.clear, o.codes.water)) & warm & ~odd)


def usable_snow(s: Series, o: HarmonicOptions) -> np.ndarray:
    return first_of_day(s.days, usable(s, o) | (s.qas == o.codes.snow))


def usable_sparse(s: Series, o: HarmonicOptions) -> np.ndarray:
    keep = usable(s, o)
    early = s.bands[1][keep & (s.days <= o.stat_day)]
    if len(early):
        with np.errstate(invalid="ignore"):
            keep = keep & (s.bands[1] < np.median(early) + o.green_margin)
    return first_of_day(s.days, keep)


def shares(s: Series, o: HarmonicOptions) -> tuple[float, float]:
    """Clear share of what isn't fill, and snow share of what is clear, water or snow; up to the statistics day."""
    q, c = s.qas[s.days <= o.stat_day], o.codes
    clear, water, snow = ((q == k).sum() for k in (c.clear, c.water, c.snow))
    valid = (q != c.fill).sum()
    return ((clear + water) / valid if valid else 0.0), (snow / (clear + water + snow + 0.01) if valid else 0.0)


def route(s: Series, o: HarmonicOptions) -> str:
    clear, snow = shares(s, o)
    return "standard" if clear >= o.clear_share else "snow" if snow >= o.snow_share else "insufficient"


def wider_peek(days: np.ndarray, peek: int) -> int:
    if len(days) < 2:
        return peek
    gaps = np.sort(np.diff(days))
    n = len(gaps)
    middle = int(gaps[n // 2]) if n % 2 else int((int(gaps[n // 2 - 1]) + int(gaps[n // 2])) / 2)  # whole days
    return max(peek, int(np.floor(peek * 16.0 / (middle + 0.001) + 0.5)))


def commonest(gaps: np.ndarray) -> int:
    """The least of the commonest values."""
    low = gaps.min()
    if gaps.max() - low < GAPS:
        return int(low + np.bincount(gaps - low).argmax())
    values, counts = np.unique(gaps, return_counts=True)
    return int(values[counts.argmax()])


def variogram(days: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Median step by band, over the least lag whose commonest gap is over 30 days."""
    n = len(days)
    if n < 2:
        return np.full(len(y), np.nan)
    out = np.median(np.abs(np.diff(y, axis=1)), axis=1)
    for lag in range(1, n):
        gaps = days[lag:] - days[:-lag]
        if commonest(gaps) > 30:
            far = gaps > 30
            out = np.median(np.abs(y[:, lag:] - y[:, :-lag])[:, far], axis=1)
            break
    return out


def change_magnitude(residuals: np.ndarray, norms: np.ndarray) -> np.ndarray:
    on = norms > 0
    return ((residuals[on] / norms[on, None]) ** 2).sum(0)


def nearest_in_season(days: np.ndarray, day: int | np.ndarray, count: int = 24) -> np.ndarray:
    """Places of the nearest days; a row for each day where ``day`` is an array."""
    delta = np.abs(days - np.asarray(day)[..., None]).astype(float)
    return np.argsort(np.abs(np.floor(delta / SEASON_YEAR + 0.5) * SEASON_YEAR - delta), axis=-1, kind="stable")[..., :count]


def sizes_ahead(ahead: np.ndarray, norms: np.ndarray, peek: int) -> np.ndarray:
    """(steps, peek): the change magnitudes that each step looks at; ahead (bands, steps + peek - 1), norms (bands, steps)."""
    seen = ahead[:, None] if ahead.shape[1] == peek else np.lib.stride_tricks.sliding_window_view(ahead, peek, axis=1)
    on = norms > 0
    if on.all():
        return ((seen / norms[:, :, None]) ** 2).sum(0)
    return np.where(on[:, :, None], (seen / np.where(on, norms, 1.0)[:, :, None]) ** 2, 0.0).sum(0)


Ask = Generator[tuple, object, tuple[list[Segment], np.ndarray]]


def single(s: Series, keep: np.ndarray, code: int, o: HarmonicOptions) -> Ask:
    """One model over all kept observations."""
    idx = np.flatnonzero(keep)
    if len(idx) < o.min_obs:
        return [], np.zeros(0, bool)
    f = yield "fit", s.days[idx], s.bands[:, idx], o.terms_min
    first, last = int(s.days[0]), int(s.days[-1])
    return [Segment(first, last, last, len(idx), 0.0, code, f, np.zeros(len(s.bands)))], keep


def standard(s: Series, o: HarmonicOptions) -> Ask:
    """Stable starts, extended backwards and forwards until they break; s.bands holds the rescaled thermal band."""
    keep = usable(s, o)
    idx = np.flatnonzero(keep)
    if len(idx) <= o.min_obs:
        return [], np.zeros(0, bool)
    days, y = s.days[idx], s.bands[:, idx]
    x = lasso.basis(days)
    early = int(np.searchsorted(days, o.stat_day, "right"))
    peek = wider_peek(days[:early], o.peek)
    vario = variogram(days[:early], y[:, :early])
    if np.isnan(vario).any():
        return [], np.zeros(0, bool)
    det, scr = np.array(o.detection_bands), np.array(o.screen_bands)
    limits = vario[scr] * o.screen_factor
    out: list[Segment] = []
    meow, start, prev = o.min_obs, True, 0
    a, b = 0, meow  # the window, in kept positions

    def drop(positions):
        nonlocal idx, days, y, x
        stay = np.ones(len(idx), bool)
        stay[positions] = False
        idx, days, y, x = idx[stay], days[stay], y[:, stay], x[:, stay]

    while b <= len(idx) - meow:
        if out:
            start = False
        # A stable start.
        stable = False
        while b + meow < len(idx):
            if days[b - 1] - days[a] < o.day_delta:
                b += 1
                continue
            odd = yield "screen", days[a:b], y[scr, a:b], limits
            n_odd = int(odd.sum())
            if n_odd == b - a:
                b += 1
                continue
            if n_odd:
                left = days[a:b][~odd]
                if left[-1] - left[0] < o.day_delta or len(left) < meow:
                    b += 1
                    continue
                drop(a + np.flatnonzero(odd))
                b -= n_odd
            f = yield "fit", days[a:b], y[:, a:b], 4, x[:, a:b]
            norm = np.maximum(vario, f.rmse)[det]
            with np.errstate(divide="ignore", invalid="ignore"):
                drift = (np.abs(f.weights[det, 0] * (days[b - 1] - days[a])) + np.abs(f.residuals[det, 0]) + np.abs(f.residuals[det, -1])) / norm
            if (drift**2).sum() < o.change_threshold:
                stable = True
                break
            a, b = a + 1, b + 1
        if not stable:
            break
        # Backwards, with the start's models.
        while a > prev:
            low = a - peek if a - prev > peek else -1 if a <= peek else prev - 1
            back = np.arange(a - 1, low, -1)
            if not len(back):
                break
            r = np.abs(y[:, back] - f.at(x[:, back]))[det]
            size = change_magnitude(r, np.maximum(vario, f.rmse)[det])
            if size.min() > o.change_threshold:
                break
            if size[0] > o.outlier_threshold:
                drop(a - 1)
                b -= 1
            a -= 1
        if a - prev > peek and start:
            g = yield "fit", days[prev:a], y[:, prev:a], 4, x[:, prev:a]
            out.append(_caught(days, prev, a, START, g))
            start = False
        if b + peek > len(idx):
            break
        # Forwards. What the steps up to the next fit look at is worked out for all of them at once: a dropped observation is
        # the first that its step looks at, so later steps don't see it anyway.
        g, change, fa, fb, terms, p, seen = None, 0, a, b, o.terms_min, b, None
        fit_span = days[b - 1] - days[a]
        while b + peek <= len(idx):
            if g is None or b - a < 24 and b > fb or days[b - 1] - days[a] >= 1.33 * fit_span:
                fa, fb, fit_span = a, b, days[b - 1] - days[a]
                g = yield "fit", days[a:b], y[:, a:b], _terms(b - a, o), x[:, a:b]
                spare = g.residuals[det]
            if b - a <= 24:
                steps, error = 1, g.rmse[det][:, None]
            else:
                steps = min(int(np.searchsorted(days[b:] - days[a], 1.33 * fit_span)) + 1, len(idx) - peek + 1 - b, AHEAD)
                near = nearest_in_season(days[fa:fb], days[b + peek - 1 : b + peek - 1 + steps])
                error = np.sqrt((spare[:, near] ** 2).sum(2)) / 4.0
            span = slice(b, b + steps + peek - 1)
            ahead = np.abs(y[:, span] - g.at(x[:, span]))
            sizes = sizes_ahead(ahead[det], np.maximum(vario[det][:, None], error), peek)
            broken = (sizes.min(1) > o.change_threshold).nonzero()[0]
            if len(broken):
                change, steps = 1, int(broken[0])
            last = steps if change else steps - 1
            odd = (sizes[:steps, 0] > o.outlier_threshold).nonzero()[0]
            p, seen = b + last - int(np.searchsorted(odd, last)), ahead[:, last : last + peek]
            terms = _terms(p - a, o)
            if len(odd):
                drop(b + odd)
            b += steps - len(odd)
            if change:
                break
        out.append(Segment(int(days[a]), int(days[b - 1]), int(days[p]), b - a, float(change), terms, g, np.median(seen, axis=1)))
        prev = b
        a, b = b, b + meow
    if prev + peek < len(idx):
        g = yield "fit", days[prev:], y[:, prev:], 4, x[:, prev:]
        out.append(_caught(days, prev, len(idx), END, g))
    mask = np.zeros(len(s.days), bool)
    mask[idx] = True
    return out, mask


def _terms(count: int, o: HarmonicOptions) -> int:
    k = count // o.obs_per_term
    return o.terms_min if k < o.terms_mid else o.terms_mid if k < o.terms_max else o.terms_max


def _caught(days: np.ndarray, a: int, b: int, code: int, f: lasso.Fit) -> Segment:
    return Segment(int(days[a]), int(days[b - 1]), int(days[b] if b < len(days) else days[-1]), b - a, 0.0, code, f, np.zeros(len(f.rmse)))


def rescaled(s: Series) -> Series:
    """Thermal Kelvin x 10 to Celsius x 100."""
    bands = s.bands.copy()
    bands[6] = bands[6] * 10 - 27315
    return Series(s.days, bands, s.qas)


def plan(s: Series, o: HarmonicOptions, procedure: str | None = None) -> tuple[str, Ask]:
    """The pixel's procedure and its coroutine."""
    name = procedure or route(s, o)
    if name == "standard":
        return name, standard(rescaled(s), o)
    if name == "snow":
        return name, single(s, usable_snow(s, o), SNOW, o)
    return name, single(s, usable_sparse(s, o), INSUFFICIENT, o)


def run(coroutines: Iterable[Ask], lasso_options: LassoOptions = LassoOptions()) -> list[tuple[list[Segment], np.ndarray]]:
    """Results in order."""
    tasks = list(coroutines)
    results: list = [None] * len(tasks)
    answers: dict[int, object] = dict.fromkeys(range(len(tasks)))
    while answers:
        asked: dict[str, list] = {"fit": [], "screen": []}
        for i, answer in answers.items():
            try:
                kind, *request = tasks[i].send(answer)
                asked[kind].append((i, request))
            except StopIteration as e:
                results[i] = e.value
        answers = {}
        if asked["fit"]:
            answers |= zip([i for i, _ in asked["fit"]], lasso.fit_many([tuple(r) for _, r in asked["fit"]], lasso_options))
        if asked["screen"]:
            answers |= zip([i for i, _ in asked["screen"]], robust.screen([tuple(r) for _, r in asked["screen"]]))
    return results
