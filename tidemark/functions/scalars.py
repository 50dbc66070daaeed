"""Column expressions: cleaning, rounding, naming and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import (
    DATUMS,
    FILL_VALUE,
    TIME_ZONES,
    UNIT_SYSTEMS,
    UNITS,
    WATER_LEVEL,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- cleaning ---------------------------------------------------------------


def flag_sum(flag: Column | str) -> Column:
    """Sum of a comma list of integer flags, e.g. ``'0,1,0'`` gives 1."""
    parts = F.transform(F.split(_col(flag), ","), lambda x: x.cast("int"))
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + x)


def mask_flagged(value: Column | str, flag: Column | str) -> Column:
    """The value, or NULL when any of its flags is raised."""
    return F.when(flag_sum(flag) > 0, None).otherwise(_col(value))


def mask_flagged_row(df: DataFrame, flag: str, keep: list[str]) -> DataFrame:
    """NULL in every column but `keep` on rows with a raised flag.

    Used for hourly heights, where a flagged reading also loses its QC mark.
    """
    raised = flag_sum(flag) > 0
    return df.select(
        *[
            F.col(c) if c in keep else F.when(raised, None).otherwise(F.col(c)).alias(c)
            for c in df.columns
        ]
    )


def nan_to_null(value: Column | str) -> Column:
    """NaN is a missing reading; as a number Spark would rank it highest."""
    return F.nullif(_col(value), F.lit(float("nan")))


def null_fill_value(
    value: Column | str,
    fill: float = FILL_VALUE,
    variable: Column | str | None = None,
    variables: list[str] | None = None,
) -> Column:
    """The value, or NULL where it is the fill value.

    With `variables` the rule holds for those variables only.
    """
    v = _col(value)
    cleaned = F.nullif(v, F.lit(fill))
    if variables is None:
        return cleaned
    return F.when(_col(variable).isin(variables), cleaned).otherwise(v)


# --- rounding ---------------------------------------------------------------


def round_down(num: Column | str, divisor: float) -> Column:
    """Largest multiple of `divisor` not above `num`."""
    n = _col(num)
    return n - F.pmod(n, F.lit(divisor))


def round_up(num: Column | str, divisor: float) -> Column:
    """Next multiple of `divisor` above `num`; an exact multiple moves up."""
    n = _col(num)
    return n + (F.lit(divisor) - F.pmod(n, F.lit(divisor)))


def round_half_even(num: Column | str, decimals: int) -> Column:
    """Round to `decimals` places, halves to the even neighbour."""
    scale = F.lit(10.0**decimals)
    return F.rint(_col(num) * scale) / scale


def round_stat(variable: Column | str, value: Column | str) -> Column:
    """Two decimals for water level, one for everything else."""
    return F.when(
        _col(variable) == WATER_LEVEL, round_half_even(value, 2)
    ).otherwise(round_half_even(value, 1))


# --- names and units --------------------------------------------------------


def station_key(name: Column | str) -> Column:
    """Camel-case key of a station name: ``'Bay St. Louis, MS'`` to ``bayStLouisMs``."""
    n = _col(name)
    spaced = F.translate(F.regexp_replace(n, "[,.]", ""), "-_", "  ")
    words = F.split(F.trim(F.regexp_replace(spaced, r"\s+", " ")), " ")
    rest = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.initcap)
    return F.concat(F.lower(F.element_at(words, 1)), F.array_join(rest, ""))


def station_dirname(name: Column | str) -> Column:
    """Directory name of a station: its key behind an underscore."""
    return F.concat(F.lit("_"), station_key(name))


def unit_for(variable: Column | str, unit_system: Column | str) -> Column:
    """Unit of a variable in the metric or english system; NULL if unknown."""
    pairs = [
        F.lit(x)
        for var, systems in UNITS.items()
        for system, unit in systems.items()
        for x in (f"{var}|{system}", unit)
    ]
    key = F.concat_ws("|", _col(variable), F.lower(_col(unit_system)))
    return F.try_element_at(F.create_map(*pairs), key)


def valid_units(c: Column | str) -> Column:
    return F.coalesce(F.lower(_col(c)).isin(UNIT_SYSTEMS), F.lit(False))


def valid_tz(c: Column | str) -> Column:
    return F.coalesce(F.lower(_col(c)).isin(TIME_ZONES), F.lit(False))


def valid_datum(c: Column | str) -> Column:
    return F.coalesce(F.upper(_col(c)).isin(DATUMS), F.lit(False))


def validate_config(df: DataFrame, fail: bool = False) -> DataFrame:
    """Check `unit_system`, `tz` and `datum` of configuration rows.

    Adds ``valid_units``, ``valid_tz``, ``valid_datum`` and ``valid``. With
    `fail` a bad row stops the job and the settings are put in canonical case.
    """
    checked = df.withColumns(
        {
            "valid_units": valid_units("unit_system"),
            "valid_tz": valid_tz("tz"),
            "valid_datum": valid_datum("datum"),
        }
    )
    valid = F.col("valid_units") & F.col("valid_tz") & F.col("valid_datum")
    checked = checked.withColumn("valid", valid)
    if not fail:
        return checked
    problem = F.format_string(
        "settings refused: unit_system=%s (known: %s), timezone=%s (known: %s), datum=%s (known: %s)",
        F.col("unit_system"),
        F.lit(", ".join(UNIT_SYSTEMS)),
        F.col("tz"),
        F.lit(", ".join(TIME_ZONES)),
        F.col("datum"),
        F.lit(", ".join(DATUMS)),
    )

    def guarded(c: Column) -> Column:
        return F.when(F.col("valid"), c).otherwise(F.raise_error(problem))

    return checked.withColumns(
        {
            "unit_system": guarded(F.lower("unit_system")),
            "tz": guarded(F.lower("tz")),
            "datum": guarded(F.upper("datum")),
        }
    )
