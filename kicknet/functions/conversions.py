"""Text and spreadsheet serial numbers to typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: day 0 of spreadsheet serial dates
SERIAL_ORIGIN = "1899-12-30"
# serial numbers of 0001-01-01 and 9999-12-31
FIRST_SERIAL, LAST_SERIAL = -693593, 2958465
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
FULL_CLOCK = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"
CLOCK = r"^\s*([01]?[0-9]|2[0-3]):([0-5][0-9])(:[0-5][0-9](\.[0-9]*)?)?\s*$"


def to_number(value: Column, dtype: T.DataType | None = None) -> Column:
    """Double, or null where the text is no plain decimal number (a suffix as in 12F is none)."""
    if isinstance(dtype, T.NumericType):
        return value.cast("double")
    return F.when(value.cast("string").rlike(PLAIN_NUMBER), value.try_cast("double"))


def _dated(serial: Column) -> Column:
    """The serial number, or null if no calendar date has it."""
    return F.when((serial >= FIRST_SERIAL) & (serial < LAST_SERIAL + 1), serial)


def serial_to_date(serial: Column) -> Column:
    """Serial day number to a date; the fraction is dropped. Null beyond the years 1 to 9999."""
    return F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), F.floor(_dated(serial)).cast("int"))


def serial_to_clock(serial: Column) -> Column:
    """Fraction of a serial day number to ``HH:MM``, by whole seconds."""
    serial = _dated(serial)
    seconds = F.round((serial - F.floor(serial)) * 86400).cast("int")
    return F.when(
        serial.isNotNull(),
        F.format_string(
            "%02d:%02d",
            F.floor(seconds / 3600).cast("int") % 24,
            F.floor(seconds / 60).cast("int") % 60,
        ),
    )


def typed_date(value: Column, dtype: T.DataType) -> Column:
    """A date from a date, a serial number, or text holding either."""
    if isinstance(dtype, T.NumericType):
        return serial_to_date(value)
    if isinstance(dtype, T.StringType):
        return F.coalesce(serial_to_date(to_number(value)), value.try_cast("date"))
    return value.cast("date")


def typed_clock(value: Column, dtype: T.DataType) -> Column:
    """``HH:MM`` from a serial number, a timestamp, or text holding a serial number or a time.

    Seconds are cut off, single-digit hours get a zero; text that is no time is null.
    """
    if isinstance(dtype, T.NumericType):
        return serial_to_clock(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "HH:mm")
    # most times are text already, and a failing cast is much dearer than a look for the colon
    hour, minute = F.regexp_extract(value, CLOCK, 1), F.regexp_extract(value, CLOCK, 2)
    clock = F.when(value.rlike(CLOCK), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))
    # nor does text that has the result's form already need to be taken apart
    full = (F.length(value) == 5) & value.rlike(FULL_CLOCK)
    return F.when(full, value).when(value.contains(":"), clock).otherwise(serial_to_clock(to_number(value)))
