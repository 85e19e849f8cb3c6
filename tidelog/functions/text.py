"""Escapes, blanks and line ends of single lines, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ESC = "\x1b"
#: One escape sequence: CSI, a string up to its terminator, a charset designator, two characters, or the lone byte.
ESCAPE = r"\x1b(?:\[[0-?]*[ -/]*[@-~]?|[\]P^_][^\x07\x1b\n]*(?:\x07|\x1b\\)?|[()*+][\s\S]?|[^\n])?"
_BLANK = r"\A[\t-\r\x1c-\x1f\p{Z}]*\z"
#: The longest line that is segmented, in characters. All else reads whole lines.
MAX_LINE = 65_536


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being evaluated once however often use mentions it. What stands in it is kept out of the stage's
    generated method, which a few dozen patterns would make too long for the JVM to compile."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(xs: Column, zero: Column, step: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """The states of a fold: zero, and then the one after each element; one more than there are elements.

    An array that grows by one is copied each time, so elements go by blocks, of which each is folded by itself.
    """

    def states(of: Column, first: Column) -> Column:
        return F.aggregate(of, F.array(first), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int")), lambda b: F.slice(all_, b * block + 1, block))

    def folded(all_: Column) -> Column:
        done = F.aggregate(blocks(all_), F.array(F.array(zero)), lambda done, of: F.concat(done, F.array(F.slice(states(of, F.element_at(F.element_at(done, -1), -1)), 2, block))))
        return F.when(F.size(all_) == 0, F.array(zero)).otherwise(F.flatten(done))

    return let(xs, folded)


def contains_escape(c: Column) -> Column:
    return F.contains(c, F.lit(ESC))


def ansi_strip(c: Column) -> Column:
    """The text without escape sequences; text without any is not searched."""
    return F.when(contains_escape(c), F.regexp_replace(c, F.lit(ESCAPE), F.lit(""))).otherwise(c)


def is_blank(c: Column) -> Column:
    """Empty, or nothing but white space of any script, no-break spaces included."""
    return c.rlike(_BLANK)


def trim_crs(c: Column) -> Column:
    """Detection drops all carriage returns at a line's end."""
    return F.rtrim(c, F.lit("\r"))


def drop_cr(c: Column) -> Column:
    """Facts drop one carriage return at a line's end."""
    return F.when(F.endswith(c, F.lit("\r")), F.regexp_replace(c, r"\r\z", "")).otherwise(c)


def clean(raw: Column) -> Column:
    """What detection reads of a line: all of it, without escapes and carriage returns at its end."""
    return ansi_strip(trim_crs(raw))


SQL_ESCAPE = r"\x1b(?:\[[0-?]*[ -/]*[@-~]?|[\]P^_][^\x07\x1b\n]*(?:\x07|\x1b\\)?|[()*+][\s\S]?|[^\n])?"
SQL_CLEAN = r"regexp_replace(regexp_replace({c}, '\r+$', ''), '" + SQL_ESCAPE + r"', '', 'g')"
SQL_BLANK = r"regexp_full_match({c}, '[\t-\r\x1c-\x1f\pZ]*')"
