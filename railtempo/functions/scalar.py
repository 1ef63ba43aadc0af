"""Column expressions: calendar, line mapping, dwell, severity bands, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Routes that keep their own name, and line groups of the line selector.
SINGLE_LINES = ["1", "2", "3", "4", "5", "6", "7", "A", "C", "E", "B", "D", "F", "M", "N", "Q", "R", "W",
                "J", "Z", "L", "G", "SI"]
LINE_GROUPS = {
    "123456": ["1", "2", "3", "4", "5", "6"],
    "7": ["7"],
    "ace": ["A", "C", "E"],
    "bdfm": ["B", "D", "F", "M"],
    "g": ["G"],
    "jz": ["J", "Z"],
    "l": ["L"],
    "nqrw": ["N", "Q", "R", "W"],
    "s": ["S"],
}
SECOND = 1_000_000
HOUR = 3_600 * SECOND


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch for either timestamp type (session zone UTC)."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def floor_div(value: Column, width: int) -> Column:
    """Exact integer floor division, also below zero."""
    return ((value - F.pmod(value, F.lit(width))) / width).cast("long")


def line_of_route(route: Column | str) -> Column:
    """Line a route belongs to; unknown routes become lower-case text."""
    name = F.upper(F.trim(_col(route)))
    return F.when(name.isin(SINGLE_LINES), name).when(name.isin("S", "GS"), F.lit("S")).otherwise(F.lower(name))


def same_line(line: Column | str, wanted: Column | str) -> Column:
    """Case-insensitive line comparison, so lower-cased unknown routes stay reachable."""
    return F.upper(_col(line)) == F.upper(_col(wanted))


def dwell_seconds(arrival: Column | str, departure: Column | str) -> Column:
    """Whole seconds between arrival and departure, null unless departure is later."""
    gap = micros(departure) - micros(arrival)
    return F.when(gap > 0, floor_div(gap, SECOND).cast("int"))


def delay_or_zero(delay: Column | str) -> Column:
    return F.coalesce(_col(delay), F.lit(0))


def clamp_delay(delay: Column | str, limit: int = 1800) -> Column:
    """Delay capped to plus or minus ``limit`` seconds; null stays null."""
    d = _col(delay)
    return F.when(d.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), d)))


def hour_of(ts: Column | str) -> Column:
    return F.hour(_col(ts))


def weekday_of(ts: Column | str) -> Column:
    """Day of week, Monday is 0."""
    return F.weekday(_col(ts))


def weekend(ts: Column | str) -> Column:
    return F.weekday(_col(ts)) >= 5


def rush_hour(ts: Column | str) -> Column:
    """Weekdays in the hours 7 to 10 and 17 to 20, both ends inclusive."""
    hour = F.hour(_col(ts))
    return (F.weekday(_col(ts)) < 5) & (hour.between(7, 10) | hour.between(17, 20))


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(_col(ts)) * 60 + F.minute(_col(ts))


def station_slot(station: Column | str, slots: int = 472) -> Column:
    """Stable slot number of a station for one-hot encoding, from the first digits of its MD5; null for null."""
    return (F.conv(F.substring(F.md5(_col(station)), 1, 8), 16, 10).cast("long") % slots).cast("int")


def from_epoch(seconds: Column | str) -> Column:
    return F.timestamp_seconds(_col(seconds))


def severity_class(severity: Column | str) -> Column:
    s = _col(severity)
    return F.when(s < 0.33, "low").when(s < 0.67, "medium").otherwise("high")


def marker_band(severity: Column | str) -> Column:
    s = _col(severity)
    return F.when(s > 0.7, "red").when(s > 0.4, "amber").otherwise("yellow")


def marker_size(severity: Column | str) -> Column:
    return 20 + _col(severity) * 20


def anomaly_kind(headway_z: Column | str, dwell_z: Column | str, delay: Column | str) -> Column:
    """Names of the conspicuous measures joined by an underscore, ``combined`` if none stands out."""
    named = F.concat_ws(
        "_",
        F.when(F.abs(_col(headway_z)) > 2, "headway"),
        F.when(F.abs(_col(dwell_z)) > 2, "dwell"),
        F.when(F.abs(_col(delay)) > 300, "delay"),
    )
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("combined"))


def error_severity(error: Column | str, threshold: Column) -> Column:
    return F.least(F.lit(1.0), _col(error) / (threshold * 2))


def five_minute_floor(ts: Column | str) -> Column:
    width = 300 * SECOND
    return F.timestamp_micros(floor_div(micros(ts), width) * width)


def hour_floor(ts: Column | str) -> Column:
    return F.date_trunc("hour", _col(ts))


def day_floor(ts: Column | str) -> Column:
    return F.date_trunc("day", _col(ts))


def non_null_map(columns: list[str]) -> Column:
    """Map of column name to double value, entries with null value left out."""
    pairs = [part for c in columns for part in (F.lit(c), F.col(c).cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def line_group(line: Column | str) -> Column:
    name = F.upper(_col(line))
    out = F.when(F.lit(False), F.lit(""))
    for group, members in LINE_GROUPS.items():
        out = out.when(name.isin(members), F.lit(group))
    return out


def percent_text(share: Column | str, digits: int = 0) -> Column:
    """Percentage text, rounded half up after binary noise beyond six digits is gone."""
    return F.concat(F.format_string(f"%.{digits}f", F.round(_col(share) * 100, 6)), F.lit("%"))


def clock_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def iso_text(ts: Column | str) -> Column:
    """ISO text; the fraction is left out when it is zero."""
    stamp = _col(ts)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros(stamp) % SECOND == 0, whole).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
