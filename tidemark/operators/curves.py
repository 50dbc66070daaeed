"""Seasonal cosine curves through published statistics.

A cosine with amplitude, phase and offset is ``offset + a*cos(fx) + b*sin(fx)``,
which is linear once the frequency is fixed. Least squares then needs only
covariances, so the fit is an aggregate and no solver runs in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import KEYS, STATION, VARIABLE, axis_column

ANNUAL = 2 * math.pi


def curve_columns(columns: list[str]) -> list[str]:
    """The three statistics that are drawn as curves."""
    average = "daily_average" if "daily_average" in columns else "monthly_average"
    return ["average_high", average, "average_low"]


def _position(columns: list[str]) -> Column:
    """Place on the cycle: 0 for the first label, below 1 for the last."""
    axis = axis_column(columns)
    length = 366 if axis == "yearday" else 12
    return (F.col(axis) - 1) / F.lit(float(length))


def _moments(x: Column, y: Column, over=None) -> dict[str, Column]:
    """Mean, variance and covariance of the two waves and the data."""
    given = y.isNotNull()
    c, s = F.when(given, F.cos(x)), F.when(given, F.sin(x))
    parts = {
        "my": F.avg(y),
        "mc": F.avg(c),
        "ms": F.avg(s),
        "cc": F.var_pop(c),
        "ss": F.var_pop(s),
        "yy": F.var_pop(y),
        "cs": F.covar_pop(c, s),
        "cy": F.covar_pop(c, y),
        "sy": F.covar_pop(s, y),
    }
    return {k: v.over(over) if over is not None else v for k, v in parts.items()}


def _solve(m: dict[str, Column]) -> dict[str, Column]:
    """Least squares coefficients; NULL where the points do not fix them."""
    det = m["cc"] * m["ss"] - m["cs"] * m["cs"]
    det = F.when(det > 1e-12, det)
    a = (m["cy"] * m["ss"] - m["sy"] * m["cs"]) / det
    b = (m["sy"] * m["cc"] - m["cy"] * m["cs"]) / det
    return {
        "a": a,
        "b": b,
        "offset": m["my"] - a * m["mc"] - b * m["ms"],
        "error": m["yy"] - a * m["cy"] - b * m["sy"],
    }


def harmonic_fit(stats: DataFrame, frequency: float = ANNUAL) -> DataFrame:
    """Statistics with a fitted value of the given frequency beside each curve.

    The fit runs over one series of 366 or 12 labels, so the window is small
    and one exchange on the series key serves all three curves. Labels without
    data get a fitted value but do not weigh on the fit.
    """
    series = Window.partitionBy(*KEYS)
    x = _position(stats.columns) * F.lit(frequency)
    curves = curve_columns(stats.columns)
    parts = {
        f"__{c}_{k}": v
        for c in curves
        for k, v in _moments(x, F.col(c), series).items()
    }
    fitted = {}
    for c in curves:
        fit = _solve({k: F.col(f"__{c}_{k}") for k in _moments(x, F.col(c))})
        fitted[f"{c}_curve"] = fit["offset"] + fit["a"] * F.cos(x) + fit["b"] * F.sin(x)
    return stats.withColumns(parts).withColumns(fitted).drop(*parts)


def _searcher(length: int, low: float, high: float, step: float, refine: int):
    """A function of the places and values of a curve that gives its best fit.

    Made of local functions only, so that what a task runs is sent along whole.
    """
    n = int(round((high - low) / step))
    below = math.ceil(round(low / step, 9)) - 1
    # Beyond half the number of labels a frequency looks like a lower one.
    ranges = max(1, math.ceil((math.pi * length - low) / (n * step)))

    def fits(x: np.ndarray, y: np.ndarray, f: np.ndarray) -> dict[str, np.ndarray]:
        """Least squares at each frequency; the cosine is linear once that is fixed."""
        wave = np.outer(f, x)
        c, s = np.cos(wave), np.sin(wave)
        mc, ms, my = c.mean(1), s.mean(1), y.mean()
        c, s, y = c - mc[:, None], s - ms[:, None], y - my
        cc, ss, cs = (c * c).mean(1), (s * s).mean(1), (c * s).mean(1)
        cy, sy = (c * y).mean(1), (s * y).mean(1)
        det = cc * ss - cs * cs
        det = np.where(det > 1e-12, det, np.nan)
        a, b = (cy * ss - sy * cs) / det, (sy * cc - cy * cs) / det
        error = (y * y).mean() - a * cy - b * sy
        return {"error": error, "frequency": f, "a": a, "b": b, "offset": my - a * mc - b * ms}

    def best_fit(x: np.ndarray, y: np.ndarray) -> dict[str, float] | None:
        """The fit of the least error, of several the lowest frequency; None without one."""
        if not len(y):
            return None

        def best(f: np.ndarray, held: dict[str, float] | None) -> dict[str, float] | None:
            tried = fits(x, y, f)
            if np.isnan(tried["error"]).all():
                return held
            at = int(np.nanargmin(tried["error"]))
            one = {name: float(v[at]) for name, v in tried.items()}
            return one if held is None or (one["error"], one["frequency"]) < (held["error"], held["frequency"]) else held

        def grid(first: int, last: int) -> np.ndarray:
            return low + np.arange(first, last + 1) * step

        held = best(grid(0, n), None)
        if held is None:
            return None
        for k in range(1, ranges):
            if held["frequency"] != grid(k * n, k * n)[0]:
                break
            held = best(grid(k * n + 1, (k + 1) * n), held)
        if below > 0 and held["frequency"] == low:
            held = best(grid(-below, -1), held)
        for r in range(1, refine + 1):
            held = best(held["frequency"] + np.arange(-10, 11) * step / 10**r, None) or held
        return held

    return best_fit


def _labels(columns: list[str]) -> tuple[str, int]:
    axis = axis_column(columns)
    return axis, 366 if axis == "yearday" else 12


def harmonic_search(
    stats: DataFrame,
    low: float = 1.0,
    high: float = 4 * math.pi,
    step: float = 0.1,
    refine: int = 2,
) -> DataFrame:
    """Coefficients of the best cosine with a free frequency, per curve.

    Tries a grid of frequencies from `low` to `high`. As long as the best one is
    the last of all tried, the grid goes on for as long again, up to half the
    number of labels a cycle; if it is the first, it goes on below, down to one
    `step`. Then `refine` times a ten times finer grid around the best. That is
    a loop which built-in functions can't say, over 366 or 12 labels of a series
    whatever its record: one pandas group, and one exchange. Rows: station,
    variable, curve, error (mean squared), frequency, a, b, offset.
    """
    curves = curve_columns(stats.columns)
    axis, length = _labels(stats.columns)
    search = _searcher(length, low, high, step, refine)
    names = ["error", "frequency", "a", "b", "offset"]
    keys = list(KEYS)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(axis)
        found = []
        for c in curves:
            given = group[group[c].notna()]
            fit = search((given[axis].to_numpy(float) - 1) / length, given[c].to_numpy(float))
            if fit:
                found.append((*group[keys].iloc[0], c, *(fit[n] for n in names)))
        return pd.DataFrame(found, columns=[*keys, "curve", *names])

    numbers = ", ".join(f"{n} double" for n in names)
    schema = f"{STATION} string, {VARIABLE} string, curve string, {numbers}"
    return stats.select(*KEYS, axis, *curves).groupBy(*KEYS).applyInPandas(run, schema)


def harmonic_fit_free(stats: DataFrame, **search: float) -> DataFrame:
    """Like `harmonic_fit`, with the best frequency found for each curve.

    `search` goes to `harmonic_search`. Its result has three rows for a series,
    so it is the small side of the join.
    """
    curves = curve_columns(stats.columns)
    position = _position(stats.columns)
    best = harmonic_search(stats, **search).select(
        *KEYS, "curve", F.struct("frequency", "a", "b", "offset").alias("fit")
    )
    wide = best.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("curve") == c, F.col("fit"))).alias(f"__{c}") for c in curves]
    )
    fitted = {}
    for c in curves:
        fit, x = F.col(f"__{c}"), position * F.col(f"__{c}.frequency")
        fitted[f"{c}_curve"] = fit["offset"] + fit["a"] * F.cos(x) + fit["b"] * F.sin(x)
    parts = [f"__{c}" for c in curves]
    return stats.join(wide, KEYS, "left").withColumns(fitted).drop(*parts)
