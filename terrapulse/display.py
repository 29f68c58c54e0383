"""Text forms of arrays and change models, and a log of how long steps take."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

#: Silent until the application gives it a handler.
log = logging.getLogger("terrapulse")
log.addHandler(logging.NullHandler())


def array_text(values, edge: int = 3, digits: int = 4) -> str:
    """An array in brackets, with its shape; beyond twice ``edge`` values an axis shows its ends only. Masks are ones and zeros."""
    a = np.asarray(values)
    a = a.astype(int) if a.dtype == bool else a
    return f"{a.shape} " + np.array2string(a, precision=digits, threshold=2 * edge, edgeitems=edge, separator=", ", suppress_small=True)


def model_text(model: dict) -> str:
    """A change model as ``detect`` gives it: its days on one line, then a line a band."""
    head = "{start_day}..{end_day} break {break_day}, {observation_count} observations, probability {change_probability:g}, curve {curve_qa}".format(**model)
    bands = [f"  {b['name']:<8} rmse {b['rmse']:.4f} magnitude {b['magnitude']:.4f} intercept {b['intercept']:.4f} " + " ".join(f"{c:.6g}" for c in b["coefficients"]) for b in model["bands"]]
    return "\n".join([head, *bands])


@contextmanager
def timed(step: str, level: int = logging.INFO) -> Iterator[dict]:
    """Logs the milliseconds that a step took, also where it fails; they are ``ms`` of what it yields."""
    began, out = time.perf_counter(), {"ms": 0.0}
    try:
        yield out
    finally:
        out["ms"] = (time.perf_counter() - began) * 1000
        log.log(level, "%s: %.3f ms", step, out["ms"])
