"""Column expressions that read the free-form values of hand-kept sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schemas import DONE, DONE_WORDS, NEEDS_REVIEW, PENDING, PENDING_WORDS

# Month spellings a sheet date may use.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# Whole-text patterns, each rewritten to a plainer form: a range to its later day,
# slashes to ISO (day first when the second number can be a month), month first to
# day first.
# Fixed value: what may stand between the two days of a range.
_DAY_RANGE = r"(?Uis)^\d{1,2}\s*[-–—to]+\s*(\d{1,2})\s+(\w+)(?:\s+(\d{4})\b)?.*$"
_DAY_FIRST = r"^([0-9]{1,2})/(0?[1-9]|1[0-2])/([0-9]{4})$"
_MONTH_FIRST = r"^(0?[1-9]|1[0-2])/([0-9]{1,2})/([0-9]{4})$"
_NAME_FIRST = r"^([A-Za-z]+)\s+([0-9]{1,2})(\s+[0-9]{4})?$"
_ISO = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
_NAMED = r"^([0-9]{1,2})\s+([A-Za-z]+)(?:\s+([0-9]{4}))?$"
# Found inside white space, so that a cell is read by one extraction.
_NUMBER = r"(?U)^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"
_STAMP = r"(?U)^\s*([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?: [0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2})?)?)\s*$"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lookup(word: Column, entries: dict[str, str | int]) -> Column:
    pairs = [F.lit(part) for entry in entries.items() for part in entry]
    return F.try_element_at(F.create_map(*pairs), word)


_MONTH_NUMBERS = {name: i for i, m in enumerate(MONTHS, start=1) for name in (m, m[:3])}


def sheet_date(text: Column, default_year: Column) -> Column:
    """A date as sheets write it; null when the text is not a date.

    Accepts ISO, slashed (day first; month first only when day first is
    impossible), ``24 June 2026`` / ``June 24 2026`` with full or short month
    names, the same without a year (``default_year`` is used), and day ranges such
    as ``5-6 July``, which mean their later day.
    """
    plain = strip(text)
    for pattern, form in (
        (_DAY_RANGE, "$1 $2 $3"),
        (_DAY_FIRST, "$3-$2-$1"),
        (_MONTH_FIRST, "$3-$1-$2"),
        (_NAME_FIRST, "$2 $1$3"),
    ):
        plain = F.regexp_replace(plain, pattern, form)

    # Plain branches over one repeated expression, which generated code evaluates once a row.
    plain = F.trim(plain)
    day, month, year = (F.regexp_extract(plain, _NAMED, i) for i in (1, 2, 3))
    number = _lookup(F.lower(month), _MONTH_NUMBERS).cast("string")
    year = F.coalesce(F.nullif(year, F.lit("")), default_year.cast("string"))
    named = F.concat(year, F.lit("-"), number, F.lit("-"), day)
    # The string-to-date cast rejects impossible dates without raising.
    return F.when(plain.rlike(_ISO), plain).otherwise(named).try_cast("date")


def _cast(text: Column, kind: str) -> Column:
    """The text as another type; blank is null at once, since a cast that fails is an error raised and caught for every row."""
    return F.nullif(text, F.lit("")).try_cast(kind)


def sheet_timestamp(text: Column) -> Column:
    """``yyyy-MM-dd``, optionally with ``HH:mm`` or ``HH:mm:ss``; else null."""
    return F.regexp_extract(text, _STAMP, 1).try_cast("timestamp")


def money(text: Column) -> Column:
    """A number that may carry thousands commas and a rupee sign; else null."""
    return _cast(F.regexp_extract(F.translate(text, ",₹", ""), _NUMBER, 1), "double")


def first_integer(text: Column, default: Column | None = None) -> Column:
    """The first integer in the text (``10 Days`` is 10), else ``default``."""
    found = _cast(F.regexp_extract(text, r"-?[0-9]+", 0), "int")
    return found if default is None else F.coalesce(found, default)


def task_status(text: Column) -> Column:
    """Classify a hand-written status; unknown words go to review, never to pending."""
    word = F.lower(strip(F.coalesce(text, F.lit(""))))
    known = {**dict.fromkeys(PENDING_WORDS, PENDING), **dict.fromkeys(DONE_WORDS, DONE)}
    return F.coalesce(_lookup(word, known), F.lit(NEEDS_REVIEW))


def choice(text: Column, members: tuple[str, ...], default: str | None = None) -> Column:
    """The member equal to the text in any letter case, else ``default``."""
    found = _lookup(F.lower(strip(text)), {m.lower(): m for m in members})
    return found if default is None else F.coalesce(found, F.lit(default))
