"""Reading dates out of strings, and date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import is_datetime

# Accepted date patterns beyond ISO, month first as in US order, each
# with an optional time.
DATE_PATTERNS = [
    "yyyy/M/d",
    "M/d/yyyy",
    "d.M.yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
]
OPTIONAL_TIME = "[ H:mm[:ss]]"
# Years a 64-bit nanosecond timestamp can hold in full.
FIRST_YEAR, LAST_YEAR = 1678, 2261
# No accepted form is longer than this or uses other characters.
LONGEST_DATE = 40
# Every form has a year of four digits.
DATE_CHARACTERS = r"^[\p{L}\d ,./:+-]*\d{4}[\p{L}\d ,./:+-]*$"
ISO_SHAPE = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?\s*(Z|[+-]\d{1,2}:?\d{2})?)?)?)?$"


def parse_datetime(text: Column) -> Column:
    """Timestamp read from a string, null where no accepted form fits.

    ISO dates (year alone, year-month, date, date and time, optional zone) and the
    patterns of ``DATE_PATTERNS`` are read. The parsers run only on strings that can
    be a date at all, so long texts cost one length test.
    """
    trimmed = F.trim(text)
    others = [F.try_to_timestamp(trimmed, F.lit(pattern + OPTIONAL_TIME)) for pattern in DATE_PATTERNS]
    read = F.when(trimmed.rlike(ISO_SHAPE), F.try_to_timestamp(trimmed)).otherwise(F.coalesce(*others))
    # The array lets the year test see the value without parsing twice.
    in_range = F.filter(F.array(read), lambda moment: F.year(moment).between(FIRST_YEAR, LAST_YEAR))
    possible = (F.length(trimmed) <= LONGEST_DATE) & trimmed.rlike(DATE_CHARACTERS)
    return F.when(possible, F.get(in_range, F.lit(0)))


def as_datetime(column: Column, dtype: T.DataType) -> Column:
    return column if is_datetime(dtype) else parse_datetime(column.cast("string"))


def date_part(moment: Column, part: str) -> Column:
    """``year``, ``month``, ``day``, ``dayofweek`` (Monday is 0) or ``quarter``."""
    readers = {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "dayofweek": F.weekday,
        "quarter": F.quarter,
    }
    if part not in readers:
        raise ValueError(f"unknown date part: {part}")
    return readers[part](moment)
