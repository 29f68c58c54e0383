"""Printers, the logger and the timer."""

import logging

import numpy as np
import pytest

from terrapulse import display


def test_arrays_show_their_ends():
    assert display.array_text(np.arange(100.0)) == "(100,) [ 0.,  1.,  2., ..., 97., 98., 99.]"
    assert display.array_text([True, False]) == "(2,) [1, 0]"
    assert display.array_text([]) == "(0,) []"


def test_models_show_days_and_bands():
    band = {"name": "green", "rmse": 1.5, "magnitude": 0.0, "intercept": 10.25, "coefficients": [0.5, -2.0]}
    model = {"start_day": 1, "end_day": 9, "break_day": 9, "observation_count": 5, "change_probability": 0.0, "curve_qa": 8, "bands": [band]}
    first, second = display.model_text(model).split("\n")
    assert first == "1..9 break 9, 5 observations, probability 0, curve 8"
    assert second.split() == ["green", "rmse", "1.5000", "magnitude", "0.0000", "intercept", "10.2500", "0.5", "-2"]


def test_steps_are_timed_and_logged(caplog):
    with caplog.at_level(logging.INFO, "terrapulse"), pytest.raises(ValueError), display.timed("a step") as t:
        raise ValueError
    assert t["ms"] > 0 and caplog.records[0].getMessage().startswith("a step: ")
