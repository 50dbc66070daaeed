"""Literal observations and a brute-force reading of the definitions in pandas."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.schemas import OBSERVATIONS

LEVEL, AIR = "Water Level", "Air Temperature"


def obs(spark, rows):
    """Rows (station, variable, 'yyyy-mm-dd hh:mm', value[, qc])."""
    typed = [
        (r[0], r[1], dt.datetime.fromisoformat(r[2]), r[3], r[4] if len(r) > 4 else None)
        for r in rows
    ]
    return spark.createDataFrame(typed, OBSERVATIONS)


def to_pandas(df):
    return df.toPandas()


def day_rows(station, variable, day, hours, value=1.0, qc=None):
    return [(station, variable, f"{day} {h:02d}:00", value, qc) for h in hours]


def daily_frame(spark, rows):
    """Gated daily rows (station, variable, date, high, low); all days good."""
    df = spark.createDataFrame(
        [(r[0], r[1], dt.date.fromisoformat(r[2]), r[3], r[4]) for r in rows],
        "station_id string, variable string, date date, high double, low double",
    )
    return df.withColumns(
        {
            "mid": (F.col("high") + F.col("low")) / 2,
            "mean": (F.col("high") + F.col("low")) / 2,
            "n_hours": F.lit(24),
            "good_day": F.col("high").isNotNull(),
            "good_month": F.lit(True),
        }
    )


def brute_daily(pdf: pd.DataFrame, hr_threshold=4) -> pd.DataFrame:
    """Good days of one series, straight from the definition."""
    out = []
    for day, group in pdf.assign(day=pdf.ts.dt.date).groupby("day"):
        values = [v for v in group.value if v is not None and not np.isnan(v) and v != 31.8]
        hours = {
            t.hour
            for t, v in zip(group.ts, group.value)
            if v is not None and not np.isnan(v) and v != 31.8
        }
        if values and len(hours) >= 24 - hr_threshold:
            out.append((day, max(values), min(values)))
    return pd.DataFrame(out, columns=["date", "high", "low"])


def brute_year_of(pairs, pick):
    """Extreme of (year, value) pairs and the earliest year that has it."""
    extreme = pick(v for _, v in pairs)
    return extreme, min(y for y, v in pairs if v == extreme)
