"""Scalar and array functions of the detection as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapulse.options import SEASON_YEAR, YEAR, HarmonicOptions

OMEGA = 2 * math.pi / YEAR
#: Ordinal of 1970-01-01 where 0001-01-01 is 1.
EPOCH = 719163


def ordinal(date: Column) -> Column:
    return F.unix_date(date.cast("date")).cast("long") + EPOCH


def from_ordinal(day: Column) -> Column:
    return F.date_from_unix_date((day - EPOCH).cast("int"))


def soft_threshold(rho: Column, by: Column) -> Column:
    return F.signum(rho) * F.greatest(F.abs(rho) - by, F.lit(0.0))


def bisquare(z: Column, tune: float = 4.685) -> Column:
    return F.when(F.abs(z) < tune, F.pow(1 - F.pow(z / tune, 2), 2)).otherwise(0.0)


def seasonal_distance(day: Column, target: Column) -> Column:
    """Days to the nearest whole number of years from ``target``."""
    delta = (day - target).cast("double")
    return F.abs(F.round(delta / SEASON_YEAR) * SEASON_YEAR - delta)


def terms_for(count: Column, o: HarmonicOptions = HarmonicOptions()) -> Column:
    k = F.floor(count / o.obs_per_term)
    return F.when(k < o.terms_mid, o.terms_min).when(k < o.terms_max, o.terms_mid).otherwise(o.terms_max)


def harmonic_terms(day: Column) -> list[Column]:
    """The seven basis columns of a day."""
    t = day.cast("double")
    return [t, *(f(t * (k * OMEGA)) for k in (1, 2, 3) for f in (F.cos, F.sin))]


def screen_terms(day: Column, years: Column) -> list[Column]:
    """The five columns of the robust screen; ``years`` is the window's span in whole years, rounded up."""
    t = day.cast("double")
    slow = F.lit(OMEGA) / years
    return [F.cos(t * OMEGA), F.sin(t * OMEGA), F.cos(t * slow), F.sin(t * slow), F.lit(1.0)]


def predict(weights: Column, terms: Column, intercept: Column) -> Column:
    """Dot product of two arrays plus the intercept."""
    return F.aggregate(F.zip_with(weights, terms, lambda w, x: w * x), intercept.cast("double"), lambda a, v: a + v)


def predict_terms(weights: Column, terms: list[Column], intercept: Column) -> Column:
    """As ``predict`` for a known number of terms, as one compiled sum; weights that an array lacks are 0."""
    out = intercept.cast("double")
    for i, x in enumerate(terms):
        out = out + F.coalesce(F.get(weights, F.lit(i)), F.lit(0.0)) * x
    return out


def median_of(values: Column) -> Column:
    """Median of an array; 0 where it is empty."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n == 0, 0.0).otherwise((F.get(s, low) + F.get(s, high)) / 2.0)


def trimmed_mad(residuals: Column, trim: int = 4, scale: float = 0.6745) -> Column:
    """Median of an array's absolute values without the smallest few, over a constant; null where none are left."""
    kept = F.slice(F.array_sort(F.transform(residuals, F.abs)), F.lit(trim + 1), F.greatest(F.size(residuals) - trim, F.lit(0)))
    return F.when(F.size(kept) > 0, median_of(kept) / scale)


def wider_peek(median_gap: Column, o: HarmonicOptions = HarmonicOptions()) -> Column:
    """``median_gap`` is in whole days; null (fewer than two observations) leaves the default."""
    return F.coalesce(F.greatest(F.lit(o.peek), F.round(o.peek * 16.0 / (median_gap + 0.001)).cast("int")), F.lit(o.peek))


def chi2_quantile(p: float) -> float:
    """Quantile of the chi-squared distribution with five degrees of freedom, by Newton steps on its closed form."""

    def cdf(x: float) -> float:
        return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)

    x = 5.0
    for _ in range(200):
        density = x**1.5 * math.exp(-x / 2) / (3 * math.sqrt(2 * math.pi))
        step = (cdf(x) - p) / max(density, 1e-300)
        new = max(x - step, x / 2)
        if abs(new - x) < 1e-13 * x:
            return new
        x = new
    return x


def change_threshold(peek: int, default_peek: int, threshold: float) -> float:
    """The threshold where more observations than usual must agree; as given where they are no more."""
    return threshold if peek <= default_peek else chi2_quantile(1 - 0.01 ** (default_peek / peek))
