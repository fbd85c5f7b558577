"""Service calendar expressions: Column to Column, none needs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Holidays that recur on the same day each year (month-day).
FIXED_HOLIDAYS = ("01-01", "01-06", "04-25", "05-01", "06-02", "08-15", "11-01", "12-08", "12-25", "12-26")
#: Last hour of each bucket of the day; later hours, and negative ones, are night.
TOD_LAST_HOUR = (("early", 5), ("am-peak", 8), ("midday", 14), ("pm-peak", 18), ("evening", 21))
TOD_TOKENS = tuple(t for t, _ in TOD_LAST_HOUR) + ("night",)
DAY_TYPES = ("weekday", "saturday", "sunday-holiday")
DEFAULT_HOUR = 12


def tod_bucket(hour: Column) -> Column:
    """Bucket of the day of an hour."""
    out = F.when(hour < 0, F.lit("night"))
    for token, last in TOD_LAST_HOUR:
        out = out.when(hour <= last, F.lit(token))
    return out.otherwise(F.lit("night"))


def valid_token(token: Column, known: tuple[str, ...]) -> Column:
    """The token if it is a known one, else null."""
    return F.when(token.isin(*known), token)


def civil_date(ymd: Column) -> Column:
    """Date of eight digits, null for anything else or a day that does not exist."""
    return F.when(ymd.rlike("^[0-9]{8}$"), F.try_to_date(ymd, "yyyyMMdd"))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once for each row, however often use names it."""
    return F.get(F.transform(F.array(x), use), 0)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous computus in integer arithmetic."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    m = div(a + 11 * h, 319)
    j, k = div(c, 4), c % 4
    shift = (2 * e + 2 * j - k - h + m + 32) % 7
    month = div(h - m + shift + 90, 25)
    day = (h - m + shift + month + 19) % 32
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def is_holiday(date: Column) -> Column:
    """Fixed holidays and Easter Monday (I04, I05), which is sought on the Mondays of March and April only."""
    monday = (F.dayofweek(date) == 2) & F.month(date).between(3, 4)
    return F.date_format(date, "MM-dd").isin(*FIXED_HOLIDAYS) | (monday & (date == F.date_add(once(F.year(date), easter_sunday), 1)))


def day_type(ymd: Column) -> Column:
    """weekday, saturday or sunday-holiday; a holiday on any day is the last; null if not a date."""

    def of(date: Column) -> Column:
        weekday = F.dayofweek(date)
        return F.when(date.isNull(), None).when(is_holiday(date) | (weekday == 1), "sunday-holiday").when(weekday == 7, "saturday").otherwise("weekday")

    return once(civil_date(ymd), of)


def epoch_day(ymd: Column) -> Column:
    return F.unix_date(civil_date(ymd))


def ymd_of_day(day: Column) -> Column:
    """Eight digits of a day counted from 1970."""
    return F.date_format(F.date_from_unix_date(day), "yyyyMMdd")


def previous_ymd(ymd: Column) -> Column:
    return F.date_format(F.date_sub(civil_date(ymd), 1), "yyyyMMdd")


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def days_in_month(year: Column, month: Column) -> Column:
    """Length of a month, 0 if there is no such month."""
    valid = month.between(1, 12)
    return F.when(valid, F.dayofmonth(F.last_day(F.make_date(year, F.when(valid, month).otherwise(1), F.lit(1))))).otherwise(0)


def local_hour(epoch_s: Column, zone: str = "Europe/Rome") -> Column:
    """Wall-clock hour of an instant; 12 where there is none."""
    return F.coalesce(F.hour(F.from_utc_timestamp(F.timestamp_seconds(epoch_s), zone)), F.lit(DEFAULT_HOUR))


def utc_date_text(epoch_s: Column) -> Column:
    """ISO date of an instant; years of more than four digits have no plus sign."""
    return F.ltrim(F.date_format(F.timestamp_seconds(epoch_s), "yyyy-MM-dd"), F.lit("+"))


def day_offset(start: Column, later: Column) -> Column:
    """Whole days from one ISO date to another, never negative; 0 if either is unreadable."""
    return F.coalesce(F.greatest(F.datediff(F.try_to_date(later, "yyyy-MM-dd"), F.try_to_date(start, "yyyy-MM-dd")), F.lit(0)), F.lit(0))


def date8(iso: Column) -> Column:
    """Digits of the date of an ISO date-time."""
    return F.regexp_replace(F.substring_index(iso, "T", 1), "-", "")


def browser_date(epoch_s: Column, zone: str = "Europe/Rome") -> Column:
    """The form in which browsers print a local date with its offset, as the boards ask for it."""
    at = F.timestamp_seconds(epoch_s)
    local = F.from_utc_timestamp(at, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(at)) / 60).cast("int")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "EEE MMM dd yyyy HH:mm:ss"), F.lit(" GMT"), offset)


def expand_bits(start: Column, bits: Column) -> Column:
    """Dates from start on whose bit is 1, as an array."""
    places = F.when(F.length(bits) > 0, F.sequence(F.lit(0), F.length(bits) - 1)).otherwise(F.array().cast("array<int>"))
    hit = F.filter(places, lambda i: F.substr(bits, i + 1, F.lit(1)) == "1")
    return F.transform(hit, lambda i: F.date_add(start, i))


DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def days_of_week(names: Column) -> Column:
    """Seven flags from day names in a text (I16)."""
    words = F.split(names, " ")
    return F.array(*[F.array_contains(words, d) for d in DAY_NAMES])
