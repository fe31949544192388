"""Free-text trial dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phasewise.constants import MONTHS
from phasewise.functions.text import strip

# Letters, digits and blanks at the start of the cell; any other sign ends the date.
_LEADING_RUN = r"(?U)^[\d\s\w]*"
# That run when it is a date, in one of these orders: day, month name and year of two or four
# digits; [month name] year; month name, day and year; year and month name. Groups 1-3, 4-5,
# 6-8 and 9-10 hold the parts.
_DATE = (
    r"(?Us)^\s*(?:(\d{1,2})\s*(\p{L}+)\s*(\d{4}|\d{2})|(?:(\p{L}+)\s*)?(\d{4})"
    r"|(\p{L}+)\s*(\d{1,2})\s+(\d{4})|(\d{4})\s*(\p{L}+))\s*(?:[^\s\w].*|$)"
)
# The usual cell, [[day] month name] year with one blank between, needs no such pattern.
_PLAIN_DATE = r"(?s)^(?:(?:[0-9]{1,2} )?[A-Za-z]+ )?[0-9]{4}(?: *[-(/,;.].*)?\z"
# A sign that no cell holds stands before every group of a match.
_MARK = "\x01"
_GROUPS = _MARK + _MARK.join(f"${i}" for i in range(1, 11))


def date_text(cell: Column) -> Column:
    return strip(F.regexp_extract(cell, _LEADING_RUN, 0))


def is_planned(cell: Column) -> Column:
    return F.contains(cell, F.lit("planned"))


def parse_date(cell: Column) -> Column:
    """``12 Jan 2015``, ``Jan 2015``, ``2015`` and the like as a date; anything else is null.

    Also read are ``Jan 12 2015``, ``2015 Jan``, ``12Jan2015`` and ``12 Jan 15``; years of two
    digits up to 68 are 20xx. Missing months and days become the first. One pattern call per
    cell marks all parts; the result is built from them, so an unreadable cell costs no
    exception on the executor.
    """
    month_numbers = F.create_map(*[F.lit(part) for pair in MONTHS.items() for part in pair])

    def extract(text: Column) -> Column:
        return F.split(F.regexp_replace(text, _DATE, _GROUPS), _MARK)

    def iso(day: Column, name: Column, year: Column) -> Column:
        month = F.when(name == "", F.lit(1)).otherwise(
            F.try_element_at(month_numbers, F.lower(name)))
        text = F.concat(year, F.lit("-"), month.cast("string"), F.lit("-"),
                        F.when(day == "", "1").otherwise(day))
        return text.try_cast("date")

    def assemble(parts: Column) -> Column:
        def first(*groups: int) -> Column:
            return F.concat(*[F.get(parts, i) for i in groups])

        # Groups of the orders that do not apply are empty.
        day, name, year = first(1, 7), first(2, 4, 6, 10), first(3, 5, 8, 9)
        year = F.when(F.length(year) == 2, F.concat(F.when(year <= "68", "20").otherwise("19"), year)
                      ).otherwise(year)
        return F.when(F.size(parts) == 11, iso(day, name, year))

    def assemble_plain(words: Column) -> Column:
        def year(word: int) -> Column:
            return F.substring(F.get(words, word), 1, 4)

        # The first word is a month name, a year with what follows, or a day of two digits.
        first, none = F.get(words, 0), F.lit("")
        return (
            F.when(first >= "A", iso(none, first, year(1)))
            .when(F.length(first) >= 4, iso(none, none, year(0)))
            .otherwise(iso(first, F.get(words, 1), year(2)))
        )

    # One-element arrays, so that the cell and its parts are worked out once each, however
    # often they are used.
    plain = F.get(F.transform(F.array(F.split(cell, " ", 3)), assemble_plain), 0)
    other = F.get(F.transform(F.transform(F.array(cell), extract), assemble), 0)
    return F.when(F.rlike(cell, F.lit(_PLAIN_DATE)), plain).otherwise(other)


def settled_date(cell: Column) -> Column:
    """The parsed date of a cell that is not merely planned."""
    return F.when(~is_planned(cell), parse_date(cell))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start).cast("bigint")
