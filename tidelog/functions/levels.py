"""Severity words and how lines are read for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.formats import LogFormat, quoted
from tidelog.functions.text import ansi_strip, let

LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")

# The severity vocabulary.
ERROR_WORDS = ("ERROR", "SEVERE", "FATAL", "CRITICAL", "ALERT", "EMERGENCY", "ERR", "FTL", "fail", "eror", "ftl", "crit", "emerg", "error")
WARN_WORDS = ("WARN", "WARNING", "NOTICE", "WRN", "warn", "warning", "notice")
DEBUG_WORDS = ("DEBUG", "TRACE", "DBG", "TRC", "FINE", "FINER", "FINEST", "debug", "dbug", "trce")
INFO_WORDS = ("INFO", "INF", "CONFIG", "info", "inf")
SEARCH_WORDS = (
    "TRACE|DEBUG|INFO|NOTICE|WARNING|WARN|ERROR|SEVERE|FATAL|CRITICAL|ALERT|EMERGENCY"
    "|INF|WRN|ERR|DBG|TRC|FTL"
    "|warning|notice|error|warn|emerg|crit|info|debug|dbug|trce|fail|eror|ftl"
)
PREFIX_WORDS = "TRACE|DEBUG|INFO|NOTICE|WARNING|WARN|ERROR|SEVERE|FATAL|CRITICAL|ALERT|EMERGENCY|FINER|FINEST|FINE|CONFIG"
#: Without a format, only this many characters of a line are searched for a level.
WINDOW = 120

WORDS = {w: level for level, ws in (("DEBUG", DEBUG_WORDS), ("INFO", INFO_WORDS), ("WARN", WARN_WORDS), ("ERROR", ERROR_WORDS)) for w in ws}
ALL_WORDS = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))
LONGEST = max(map(len, WORDS))
PREFIX_LINE = rf"\A({PREFIX_WORDS})(?::[\w.]+)?: .*\z"


def prefixes() -> dict[str, str]:
    """Lower-case prefixes of two letters or more; where levels share one, the lesser level has it."""
    out: dict[str, str] = {}
    for level in LEVELS:
        for word in [w for w, of in WORDS.items() if of == level] + [level]:
            for n in range(2, len(word) + 1):
                out.setdefault(word[:n].lower(), level)
    return out


def level_of_word(w: Column) -> Column:
    """The level of the longest known prefix of a word, whatever its case; null if none of two letters is known."""
    known = F.create_map(*[F.lit(x) for kv in prefixes().items() for x in kv])
    low = F.lower(w)
    return F.coalesce(*[F.when(F.length(w) >= n, F.try_element_at(known, F.substring(low, 1, n))) for n in range(LONGEST, 1, -1)])


def ramp(w: Column) -> Column:
    """The level that a vocabulary word is painted with; INFO for any other."""
    return F.when(w.isin(*ERROR_WORDS), "ERROR").when(w.isin(*WARN_WORDS), "WARN").when(w.isin(*DEBUG_WORDS), "DEBUG").otherwise("INFO")


def ramp_of(word: Column) -> Column:
    """The level of a word; null without one."""
    return let(word, lambda w: F.when(w.isNotNull(), ramp(w)))


def sql_ramp(w: str) -> str:
    def among(words):
        return f"{w} IN ({', '.join(map(quoted, words))})"

    return f"CASE WHEN {among(ERROR_WORDS)} THEN 'ERROR' WHEN {among(WARN_WORDS)} THEN 'WARN' WHEN {among(DEBUG_WORDS)} THEN 'DEBUG' ELSE 'INFO' END"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(c, pattern, group), lambda w: F.when(w != "", w))


FIND = rf"(?:\A|[^A-Za-z])({SEARCH_WORDS})(?:[^A-Za-z]|\z)"
FIND_NO_DOT = rf"(?:\A|[^A-Za-z.])({SEARCH_WORDS})(?:[^A-Za-z]|\z)"


def find_level(c: Column) -> Column:
    """The first severity word with no letter beside it."""
    return _found(c, FIND)


def level_prefix(c: Column) -> Column:
    """The level word of a line such as `SEVERE: ...` or `WARNING:root: ...`."""
    return _found(c, PREFIX_LINE)


def word_without_format(text: Column) -> Column:
    """The level word that makes a line a record when no format is known; null: not a record. text is free of escapes."""
    word = F.coalesce(level_prefix(text), _found(F.substring(text, 1, WINDOW), FIND_NO_DOT))
    return F.when((text != "") & ~text.rlike(r"\A[\s\p{Z}\x1c-\x1f]"), word)


def level_without_format(raw: Column) -> Column:
    word = word_without_format(ansi_strip(raw))
    return F.when(word.isNotNull(), ramp(word))


SKIP = r'(?:[^\["]|\[[^\]]*\])*?'
GUARD = r'(?:[^A-Za-z\["]|\[[^\]]*\])'
RECORD_LEVEL = rf"\A{SKIP}(?:\[(?:[^\]]*:)?\s*({ALL_WORDS})\s*\]|(?:\A|{GUARD})({SEARCH_WORDS})(?:[^A-Za-z]|\z))"
# What a record line is searched for instead, in steps that never nest: brackets are marked (left, right), those that are a
# severity word are marked once more, the others go, and the first word is found. The marks are code points of no character.
_LEFT, _RIGHT, _WORD = "\ufdd0", "\ufdd1", "\ufdd2"
_FIRST_WORD = rf"{_WORD}[A-Za-z]+|(?<![A-Za-z])(?:{SEARCH_WORDS})(?![A-Za-z])"


def after_timestamp(text: Column, fmt: LogFormat) -> Column:
    return F.regexp_replace(text, rf"\A(?:{fmt.timestamp})", "") if fmt.timestamp else text


def record_word(rest: Column) -> Column:
    """(word, hard) of a record line, given what follows its timestamp: its level word, and whether quotes or an open bracket
    come in, in which case the segmenter knows better."""
    marked = F.regexp_replace(rest, r"\[([^\]]*)\]", f"{_LEFT}$1{_RIGHT}")
    worded = F.regexp_replace(marked, rf"{_LEFT}(?:[^{_RIGHT}]*:)?\s*({ALL_WORDS})\s*{_RIGHT}", f"{_WORD}$1 ")
    open_only = F.when(F.contains(rest, F.lit("[")), F.regexp_replace(worded, rf"{_LEFT}[^{_RIGHT}]*{_RIGHT}", " ")).otherwise(rest)

    def read(s: Column) -> Column:
        quoted = F.contains(rest, F.lit('"'))
        found = F.regexp_extract(F.when(quoted, F.substring_index(s, '"', 1)).otherwise(s), _FIRST_WORD, 0)
        word = let(found, lambda w: F.when(w != "", F.ltrim(w, F.lit(_WORD))))
        return F.struct(word.alias("word"), (quoted | F.contains(s, F.lit("["))).alias("hard"))

    return let(open_only, read)


def record_level(text: Column, fmt: LogFormat) -> Column:
    return ramp_of(let(after_timestamp(text, fmt), record_word)["word"])


def by_name(name: Column, formats: tuple[LogFormat, ...], value) -> Column:
    """value(format) of the format with that name, evaluated for that format alone: one flat CASE."""
    first, *rest = formats
    return reduce(lambda case, f: case.when(name == f.name, value(f)), rest, F.when(name == first.name, value(first)))
