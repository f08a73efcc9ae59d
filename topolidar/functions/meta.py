"""Times, dates and granule names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of_day(hours: Column, minutes: Column, seconds: Column) -> Column:
    return hours * 3600 + minutes * 60 + seconds


def clock(seconds: Column) -> Column:
    """HH:MM:SS.ffffff of seconds, modulo a day."""
    micros = F.pmod(F.round(seconds * 1_000_000).cast("long"), F.lit(86_400_000_000))
    whole = F.floor(micros / 1_000_000)
    return F.format_string("%02d:%02d:%02d.%06d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)), F.pmod(micros, F.lit(1_000_000)))


def day_of_year(date: Column) -> Column:
    """The day of the year as three digits."""
    return F.lpad(F.dayofyear(date).cast("string"), 3, "0")


def month_and_day(year: Column, doy: Column) -> tuple[Column, Column]:
    date = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy.cast("int") - 1)
    return F.month(date), F.dayofmonth(date)


def granule_fields(name: Column) -> dict[str, Column]:
    """Parts of a granule's file name, by place from its product code on; a release of three digits or of two."""
    at = F.substring(name, F.greatest(F.locate("ATL", name), F.lit(1)), F.lit(64))
    part = lambda a, b: F.substring(at, a + 1, b - a)
    short = part(33, 34) == "_"
    return {
        "product": part(0, 5),
        "date": part(6, 14),
        "time": part(14, 20),
        "track": part(21, 25),
        "cycle": part(25, 29),
        "release": F.when(short, part(30, 33)).otherwise(part(30, 34)),
        "version": F.when(short, part(34, 36)).otherwise(part(35, 37)),
        "kind": F.when(F.contains(name, F.lit("rapid")), "rapid").otherwise("final"),
    }


def pairing_key(name: Column) -> Column:
    """What granules of one overpass share in their names: the time of start, and the track with cycle and region."""
    parts = F.split(F.substring_index(name, "/", -1), "_")
    return F.concat_ws("_", F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3)))
