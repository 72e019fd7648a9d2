"""Scalar functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockroom import messages as M

# White space as the server trims it, and as the entry forms trim it.
_SPACE_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_LINE_SEPARATORS = "\t\n\x0b\f\r\u2028\u2029"
_SERVER_SPACE = _SPACE_SEPARATORS + _LINE_SEPARATORS + "\x1c\x1d\x1e\x1f\x85"
_FORM_SPACE = _SPACE_SEPARATORS + _LINE_SEPARATORS + "\ufeff"


def strip(value: Column) -> Column:
    """Drop white space of every kind from both ends (plain ``trim`` drops blanks only)."""
    return F.btrim(value, F.lit(_SERVER_SPACE))


def form_trim(value: Column) -> Column:
    """Like ``strip``, with the white space an entry form drops."""
    return F.btrim(value, F.lit(_FORM_SPACE))


def blank(value: Column) -> Column:
    """True for NULL and for an empty text."""
    return F.coalesce(value == "", F.lit(True))


def given(value: Column) -> Column:
    """True for a text that is neither NULL nor empty."""
    return ~blank(value)


def first_given(*values: Column | str) -> Column:
    """The first value that is neither NULL nor empty."""
    columns = [F.lit(v) if isinstance(v, str) else v for v in values]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def contains_ignoring_case(value: Column, part: str) -> Column:
    """Literal containment after lower-casing both sides; ``%`` and ``_`` are plain characters."""
    return F.lower(value).contains(F.lower(F.lit(part)))


def piece_code(serial: Column, prefix: str = "INV", attempt: int = 0) -> Column:
    """``PREFIX-<8 hex digits>-<first 8 of the serial>``.

    The hex digits are a hash of the serial, so a task that runs twice gives
    the same code twice; a further ``attempt`` gives another code.
    """
    hashed = F.md5(F.concat(serial, F.lit(f"#{attempt}"))) if attempt else F.md5(serial)
    digits = F.upper(F.substring(hashed, 1, 8))
    return F.concat(F.lit(f"{prefix}-"), digits, F.lit("-"), F.substring(serial, 1, 8))


_EMAIL_FORM = M.EMAIL_FORM.replace("{space}", _FORM_SPACE)


def email_ok(value: Column, form: bool = False) -> Column:
    """The server's rule, or the looser one of the entry form."""
    return F.coalesce(value.rlike(_EMAIL_FORM if form else M.EMAIL_SERVER), F.lit(False))


def state_note(before: Column, after: Column, remark: Column) -> Column:
    """Journal text of a state change, trimmed."""
    return strip(
        F.concat(
            F.lit("Cambio de '"), F.coalesce(before, F.lit("None")),
            F.lit("' a '"), after,
            F.lit("'. "), F.coalesce(remark, F.lit("")),
        )
    )


def filled(template: str) -> Column:
    """A text whose ``{column}`` fields are filled from the row."""
    parts = []
    for literal, column, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if column:
            parts.append(F.coalesce(F.col(column).cast("string"), F.lit("None")))
    return F.concat(*parts)


def parse_timestamp(value: Column) -> Column:
    """Text to timestamp; text that is none gives NULL."""
    return value.try_cast("timestamp_ntz")


def _clock(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` as the clock on the wall showed it.

    ``date_format`` would pass through the session time zone, and move times
    that a change of daylight saving time leaves out there.
    """
    return F.substring(value.cast("timestamp_ntz").cast("string"), 1, 19)


def export_date(value: Column) -> Column:
    """``dd/MM/yyyy HH:mm``, or an empty text."""
    clock = _clock(value)
    day, month, year = F.substring(clock, 9, 2), F.substring(clock, 6, 2), F.substring(clock, 1, 4)
    date = F.concat(day, F.lit("/"), month, F.lit("/"), year)
    return F.coalesce(F.concat(date, F.lit(" "), F.substring(clock, 12, 5)), F.lit(""))


def label_date(value: Column) -> Column:
    """``d/M/yyyy``"""
    date = value.cast("date")
    return F.concat(
        F.day(date).cast("string"), F.lit("/"), F.month(date).cast("string"), F.lit("/"), F.year(date).cast("string")
    )


def export_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def whole_number(value: Column) -> Column:
    """Text to integer; empty or unreadable text gives NULL."""
    return value.try_cast("bigint")


def last_login_text(value: Column) -> Column:
    return F.coalesce(_clock(value), F.lit(M.NEVER))


def yes_no(flag: Column) -> Column:
    return F.when(flag, M.YES).otherwise(M.NO)


def switched(flag: Column) -> Column:
    return F.when(flag, M.SWITCHED_ON).otherwise(M.SWITCHED_OFF)
