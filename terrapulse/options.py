"""Options of the detection: thresholds, window sizes, codes and solver settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

BANDS = ("blue", "green", "red", "nir", "swir1", "swir2", "thermal")
#: Mean length of a year for the harmonic terms, and another for distances within a year.
YEAR, SEASON_YEAR = 365.2425, 365.25
THERMAL_LOW, THERMAL_HIGH, REFLECTANCE_HIGH = -9320.0, 7070.0, 10000.0
MAX_TERMS = 7


@dataclass(frozen=True)
class QaCodes:
    fill: int = 255
    clear: int = 0
    water: int = 1
    shadow: int = 2
    snow: int = 3
    cloud: int = 4
    cirrus_low: int = 8
    cirrus_high: int = 9
    occlusion: int = 10


@dataclass(frozen=True)
class HarmonicOptions:
    """``min_obs``: observations a model needs; ``peek``: observations looked at ahead; ``day_delta``: days a start must span."""

    min_obs: int = 12
    peek: int = 6
    day_delta: int = 365
    clear_count: int = 3  # accepted for compatibility, not used by any procedure
    clear_share: float = 0.25
    snow_share: float = 0.75
    outlier_threshold: float = 35.888186879610423
    change_threshold: float = 15.086272469388987
    screen_factor: float = 4.89
    green_margin: float = 400.0
    stat_day: int = 736694
    terms_min: int = 4
    terms_mid: int = 6
    terms_max: int = 8
    obs_per_term: int = 3
    detection_bands: tuple[int, ...] = (1, 2, 3, 4, 5)
    screen_bands: tuple[int, ...] = (1, 4)
    codes: QaCodes = field(default_factory=QaCodes)

    def __post_init__(self):
        if self.min_obs < 1 or self.peek < 1:
            raise ValueError("min_obs and peek must be positive")
        if not self.terms_min <= self.terms_mid <= self.terms_max <= MAX_TERMS + 1:
            raise ValueError("terms must grow and be at most 8")

    def but(self, **changes) -> HarmonicOptions:
        return replace(self, **changes)


@dataclass(frozen=True)
class LassoOptions:
    """``fit_intercept``, ``warm_start`` and ``unbiased_rmse`` are accepted and have no effect: fits always start at zero,
    with an intercept and residual variance by degrees of freedom."""

    max_iter: int = 1000
    alpha: float = 1.0
    tolerance: float = 1e-4
    fit_intercept: bool = True
    warm_start: bool = False
    unbiased_rmse: bool = True


@dataclass(frozen=True)
class RobustOptions:
    max_iter: int = 50
    tolerance: float = 1e-8
    tune: float = 4.685
    scale: float = 0.6745
