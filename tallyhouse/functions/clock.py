"""Trading calendar: periods, local buckets, and local wall time to UTC instants.

Rows are *filtered* on the raw UTC column with two literals, so the predicate reaches the
scan, and *grouped* on wall time in an explicit zone. The session zone stays UTC.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import stripped
from tallyhouse.schemas import DEFAULT_ZONE

MAX_PERIOD_DAYS = 366

# Zone names as they occur in exports.
ZONE_ALIASES = {
    "London": "Europe/London",
    "Europe/London": "Europe/London",
}


class InvalidPeriod(ValueError):
    """The period is reversed or longer than allowed."""


@dataclass(frozen=True)
class Period:
    """Inclusive local dates in a trading zone."""

    start: date
    end: date
    zone: str = DEFAULT_ZONE

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def start_utc(self) -> datetime:
        return self._midnight(self.start)

    @property
    def end_utc(self) -> datetime:
        """Exclusive end: midnight after the last day."""
        return self._midnight(self.end + timedelta(days=1))

    def _midnight(self, day: date) -> datetime:
        local = datetime.combine(day, time.min, tzinfo=ZoneInfo(self.zone))
        return local.astimezone(timezone.utc)

    def previous(self) -> Period:
        """The equally long period that ends the day before this one starts."""
        last = self.start - timedelta(days=1)
        return Period(last - timedelta(days=self.days - 1), last, self.zone)

    def through(self, later: Period) -> Period:
        return Period(self.start, later.end, self.zone)

    def contains(self, instant: Column) -> Column:
        return (instant >= F.lit(self.start_utc)) & (instant < F.lit(self.end_utc))

    def months(self) -> list[str]:
        """``yyyy-MM`` months that an instant of the period can have in any zone.

        Two days are added on either side: clocks of two places differ by up to 26 hours.
        """
        last = self.end + timedelta(days=2)
        found, cursor = [], (self.start - timedelta(days=2)).replace(day=1)
        while cursor <= last:
            found.append(cursor.strftime("%Y-%m"))
            cursor = (cursor + timedelta(days=32)).replace(day=1)
        return found

    def orders(self, orders: DataFrame) -> DataFrame:
        """Orders of the period; stored ones are first cut to its month partitions."""
        return self.stored(orders).filter(self.contains(F.col("occurred_at")))

    def stored(self, rows: DataFrame) -> DataFrame:
        """Rows of the month partitions the period can touch; all rows if there are none."""
        if "local_month" not in rows.columns:
            return rows
        return rows.filter(F.col("local_month").isin(self.months()))


def period(
    start: date, end: date, zone: str = DEFAULT_ZONE, max_days: int | None = MAX_PERIOD_DAYS
) -> Period:
    """Checked period; pass ``max_days=None`` to lift the length bound."""
    if end < start:
        raise InvalidPeriod(f"end {end} is before start {start}")
    made = Period(start, end, zone)
    if max_days is not None and made.days > max_days:
        raise InvalidPeriod(f"{made.days} days exceed the maximum of {max_days}")
    return made


# --- local buckets -------------------------------------------------------------


def local_time(instant: Column, zone: str) -> Column:
    return F.from_utc_timestamp(instant, zone)


def local_day(instant: Column, zone: str) -> Column:
    return F.to_date(local_time(instant, zone))


def week_of(day: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", day))


def bucket(instant: Column, zone: str, granularity: str) -> Column:
    if granularity == "day":
        return local_day(instant, zone)
    if granularity == "week":
        return week_of(local_day(instant, zone))
    raise ValueError(f"granularity must be 'day' or 'week', got {granularity!r}")


def local_month(instant: Column, zone: str) -> Column:
    return F.date_format(local_time(instant, zone), "yyyy-MM")


def iso_weekday(instant: Column, zone: str) -> Column:
    return F.weekday(local_time(instant, zone)) + F.lit(1)


def local_hour(instant: Column, zone: str) -> Column:
    return F.hour(local_time(instant, zone))


def weekday_name(iso: Column) -> Column:
    names = F.array(*[F.lit(n) for n in (
        "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    return F.element_at(names, iso.cast("int"))


def is_fixed_holiday(day: Column) -> Column:
    """25 December, 26 December and 1 January."""
    return F.date_format(day, "MM-dd").isin("12-25", "12-26", "01-01")


# --- wall time in exports ---------------------------------------------------------


def zone_of(alias: Column) -> Column:
    """IANA zone of an export's zone name; NULL when the name is not known."""
    return F.try_element_at(
        F.create_map(*[F.lit(x) for pair in ZONE_ALIASES.items() for x in pair]),
        stripped(alias))


def wall_time(day: Column, clock: Column) -> Column:
    """ISO date plus ``HH:MM[:SS]`` (blank is midnight); NULL when either cannot be read."""
    return clean_wall_time(stripped(day), stripped(clock))


def clean_wall_time(d: Column, t: Column) -> Column:
    iso = F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), d).when(
        d.rlike(r"^\d{8}$"),
        F.concat_ws("-", d.substr(1, 4), d.substr(5, 2), d.substr(7, 2)),
    )
    hms = (
        F.when(t == "", F.lit("00:00:00"))
        .when(t.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}$"), t)
        .when(t.rlike(r"^\d{1,2}:\d{1,2}$"), F.concat(t, F.lit(":0")))
    )
    return F.try_to_timestamp(F.concat_ws(" ", iso, hms), F.lit("yyyy-MM-dd H:m:s"))


def _in_zone(zone: Column, shift) -> Column:
    """Apply a shift with the zone as a literal, which Spark resolves once and not per row."""
    shifted = F.lit(None).cast("timestamp")
    for name in sorted(set(ZONE_ALIASES.values())):
        shifted = F.when(zone == name, shift(F.lit(name))).otherwise(shifted)
    return shifted


def first_instant(wall: Column, zone: Column) -> Column:
    """UTC instant of a wall time; the earlier one where the clock shows it twice."""
    return _in_zone(zone, lambda z: F.to_utc_timestamp(wall, z))


def in_clock_gap(wall: Column, instant: Column, zone: Column) -> Column:
    """True when clocks jumped over the wall time that gave this first instant."""
    return _in_zone(zone, lambda z: F.from_utc_timestamp(instant, z)) != wall


def occurs_twice(wall: Column, instant: Column, zone: Column) -> Column:
    """True when the same wall time is shown again one hour after its first instant."""
    again = instant + F.expr("INTERVAL 1 HOUR")
    return _in_zone(zone, lambda z: F.from_utc_timestamp(again, z)) == wall
