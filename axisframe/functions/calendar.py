"""Calendar on epoch seconds (UTC, double) and on timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

PERIODS = ("hour", "day", "month", "year")
COMPONENTS = ("year", "month", "day", "hour", "minute", "weekday", "dayofyear", "season")
SEASONS = ("DJF", "MAM", "JJA", "SON")

#: Seconds of each unit name of "<unit> since <date>".
UNIT_SECONDS = {
    "second": 1, "seconds": 1, "sec": 1, "secs": 1, "s": 1,
    "minute": 60, "minutes": 60, "min": 60, "mins": 60,
    "hour": 3600, "hours": 3600, "hr": 3600, "hrs": 3600, "h": 3600,
    "day": 86400, "days": 86400, "d": 86400,
}
#: The date layouts understood.
LAYOUTS = ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d")


def to_epoch(moment: dt.datetime) -> float:
    """Seconds since 1970 of a moment; a naive one is taken as UTC."""
    return (moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)).timestamp()


def from_epoch(seconds: float) -> dt.datetime:
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def epoch_labels(moments: list[dt.datetime]) -> list[float]:
    return [to_epoch(m) for m in moments]


def season_name(number: int) -> str:
    return SEASONS[int(number)] if 0 <= int(number) < 4 else ""


def epoch_of(moment: Column) -> Column:
    """Epoch seconds of a TIMESTAMP column, or of TIMESTAMP_NTZ with the session in UTC."""
    return F.unix_micros(moment.cast("timestamp")).cast("double") / 1e6


def moment_of(epoch: Column) -> Column:
    return F.timestamp_micros(F.floor(epoch.cast("double") * 1e6).cast("long"))


def period_start(epoch: Column, period: str) -> Column:
    """Epoch second at which the period of each label begins."""
    if period not in PERIODS:
        raise ValueError(f"period {period!r} is none of {PERIODS}")
    seconds = F.floor(epoch.cast("double"))
    if period in ("hour", "day"):
        width = 3600 if period == "hour" else 86400
        return (F.floor(seconds / width) * width).cast("double")
    day = F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(seconds / 86400).cast("int"))
    return (F.datediff(F.trunc(day, period), F.lit(dt.date(1970, 1, 1))) * 86400.0).cast("double")


def component(epoch: Column, name: str) -> Column:
    """Year, month, day, hour, minute, weekday (0 is Sunday), day of the year
    or season (0 is December to February) of epoch labels."""
    if name not in COMPONENTS:
        raise ValueError(f"component {name!r} is none of {COMPONENTS}")
    seconds = F.floor(epoch.cast("double"))
    day = F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(seconds / 86400).cast("int"))
    found = {
        "year": lambda: F.year(day), "month": lambda: F.month(day), "day": lambda: F.dayofmonth(day),
        "hour": lambda: F.pmod(F.floor(seconds / 3600), F.lit(24)), "minute": lambda: F.pmod(F.floor(seconds / 60), F.lit(60)),
        "weekday": lambda: F.dayofweek(day) - 1, "dayofyear": lambda: F.dayofyear(day),
        "season": lambda: F.floor((F.month(day) % 12) / 3),
    }
    return found[name]().cast("double")


def extract(labels: list[float], name: str) -> list[float]:
    """The component of each of a list of epoch seconds, on the driver."""
    out = []
    for m in map(from_epoch, labels):
        out.append(float({
            "year": m.year, "month": m.month, "day": m.day, "hour": m.hour, "minute": m.minute,
            "weekday": m.isoweekday() % 7, "dayofyear": m.timetuple().tm_yday, "season": m.month % 12 // 3,
        }[name]))
    return out


def parse_date(text: str) -> dt.datetime:
    for layout in LAYOUTS:
        try:
            return dt.datetime.strptime(text.strip(), layout).replace(tzinfo=dt.timezone.utc)
        except ValueError:
            continue
    raise ValueError(f"no date in {text!r}")


def parse_units(units: str) -> tuple[float, dt.datetime]:
    """Seconds per unit and origin of ``<unit> since <date>``."""
    unit, since, date = units.strip().partition(" since ")
    if not since or unit.strip().lower() not in UNIT_SECONDS:
        raise ValueError(f"no time units in {units!r}")
    return float(UNIT_SECONDS[unit.strip().lower()]), parse_date(date)


def decode_labels(label: Column, units: str) -> Column:
    """Epoch seconds of labels counted in ``units``."""
    seconds, origin = parse_units(units)
    return label.cast("double") * seconds + to_epoch(origin)
