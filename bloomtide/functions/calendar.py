"""Calendar expressions: parts, season, cyclic encoding, names, naive-time arithmetic.

All take and return columns. The timestamp helpers work on TIMESTAMP_NTZ
without going through the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bloomtide.fixed_values import DATE, MONTHS_FR, MONTHS_PER_YEAR, WEEKDAYS_FR, YEAR_LENGTH


def calendar_parts(date: str | Column = DATE) -> dict[str, Column]:
    """Day of year, month and year of a date, by output name."""
    return {"doy": F.dayofyear(date), "month": F.month(date), "year": F.year(date)}


def season(month: str | Column = "month") -> Column:
    """0 for December to February, then 1, 2, 3 per quarter."""
    month = F.col(month) if isinstance(month, str) else month
    return F.floor((month % MONTHS_PER_YEAR) / 3).cast("int")


def cyclic(doy: str | Column = "doy", month: str | Column = "month") -> dict[str, Column]:
    """Sine and cosine of the position in the year, by output name."""
    doy = F.col(doy) if isinstance(doy, str) else doy
    month = F.col(month) if isinstance(month, str) else month
    day_angle = F.lit(2) * F.pi() * doy / F.lit(YEAR_LENGTH)
    month_angle = F.lit(2) * F.pi() * month / F.lit(MONTHS_PER_YEAR)
    return {
        "doy_sin": F.sin(day_angle), "doy_cos": F.cos(day_angle),
        "month_sin": F.sin(month_angle), "month_cos": F.cos(month_angle),
    }


def date_shift(date: str | Column, days: int) -> Column:
    """The date ``days`` later (earlier when negative)."""
    return F.date_add(date, days)


def french_date(date: str | Column = DATE) -> Column:
    """For example ``Lundi 5 Janvier 2026``."""
    weekday = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS_FR]), F.weekday(date) + 1)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS_FR]), F.month(date))
    return F.concat_ws(" ", weekday, F.day(date).cast("string"), month, F.year(date).cast("string"))


def iso_date(date: str | Column = DATE) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def slash_date(date: str | Column = DATE) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def hour_floor(ts: str | Column) -> Column:
    """A naive timestamp cut to its hour."""
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.lit(0), F.lit(0)
    )


def naive_seconds(ts: str | Column) -> Column:
    """Seconds since 1970-01-01 00:00 of a naive timestamp, as BIGINT."""
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * 86400
        + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    )


def month_bucket(ts: str | Column) -> Column:
    """Number of the calendar month; orders like time and bounds a series piece."""
    return F.year(ts) * MONTHS_PER_YEAR + F.month(ts)
