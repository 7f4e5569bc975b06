"""Time expressions that work for TIMESTAMP and TIMESTAMP_NTZ columns alike."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month names of HTTP dates.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
IMF_DATE = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d{2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}):(\d{2}):(\d{2}) GMT\z"
RFC850_DATE = (
    r"^(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday), "
    r"(\d{2})-([A-Z][a-z]{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2}) GMT\z"
)
ASCTIME_DATE = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) ([A-Z][a-z]{2}) ([ \d]\d) (\d{2}):(\d{2}):(\d{2}) (\d{4})\z"

AsOf = datetime | str


def as_datetime(when: AsOf) -> datetime:
    """Naive values are UTC."""
    if isinstance(when, str):
        when = datetime.fromisoformat(when.replace("Z", "+00:00"))
    if when.tzinfo is not None:
        when = when.astimezone(timezone.utc).replace(tzinfo=None)
    return when


def instant(when: AsOf, type_name: str) -> Column:
    text = as_datetime(when).isoformat(sep=" ")
    if type_name == "timestamp":
        text += "Z"
    return F.lit(text).cast(type_name)


def like(df: DataFrame, column: str, when: AsOf) -> Column:
    """``when`` as a literal of the type of ``df[column]``."""
    return instant(when, df.schema[column].dataType.simpleString())


def shifted(when: AsOf, **delta: float) -> datetime:
    return as_datetime(when) + timedelta(**delta)


def plus_seconds(start: Column, seconds: Column) -> Column:
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def rfc3339(ts: Column) -> Column:
    """UTC text with as many fraction digits (0, 3 or 6) as the value needs."""
    text = date_text(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = date_text(ts, "SSSSSS")
    fraction = (
        F.when(micros == "000000", F.lit(""))
        .when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3)))
        .otherwise(F.concat(F.lit("."), micros))
    )
    return F.concat(text, fraction, F.lit("Z"))


def date_text(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, pattern)


def http_date(text: Column) -> Column:
    """HTTP date in any of its three forms as TIMESTAMP_NTZ (UTC), NULL if malformed."""

    def build(pattern: str, day: int, month: int, year: int, hour: int, year_of) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(text, pattern, i)

        place = F.instr(F.lit(MONTHS), part(month))
        month_number = F.when(place % 3 == 1, ((place + 2) / 3).cast("int"))
        year_number = year_of(part(year).try_cast("int"))
        return F.when(
            text.rlike(pattern),
            F.try_make_timestamp_ntz(
                year_number,
                month_number,
                F.trim(part(day)).try_cast("int"),
                part(hour).try_cast("int"),
                part(hour + 1).try_cast("int"),
                part(hour + 2).try_cast("decimal(8,6)"),
            ),
        )

    def full(year: Column) -> Column:
        return F.when(year >= 1970, year)

    def short(year: Column) -> Column:
        return F.when(year < 70, year + 2000).otherwise(year + 1900)

    return F.coalesce(
        build(IMF_DATE, 1, 2, 3, 4, full),
        build(RFC850_DATE, 1, 2, 3, 4, short),
        build(ASCTIME_DATE, 2, 1, 6, 3, full),
    )
