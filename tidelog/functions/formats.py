"""The thirteen log layouts and the Column tests built from them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names, priorities and patterns that detection must agree on with other tools, in order of declaration.
# A word boundary before the rest of a line is spelled out, so that one pattern means the same to JVM regex and RE2.
LEVEL = "(?:TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|SEVERE|FATAL|CRITICAL|ALERT|EMERGENCY)"
JUL_LEVEL = "(?:SEVERE|WARNING|INFO|CONFIG|FINE|FINER|FINEST)"
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
SERVER_LEVEL = "(?:emerg|alert|crit|error|warn|notice|info|debug)"
DOTNET_LEVEL = "(?:trce|dbug|info|warn|fail|crit|eror|ftl)"
ZONE = r"(?:Z|[+-]\d{2}:?\d{2})"
REST = r"(?:[^A-Za-z0-9_].*)?"
DOTTED = r"(?:\.[\w$]+)+"
JAVA_STACK = r"(?:\s+at .*)|(?:Caused by: .*)|(?:\s*\.{3} (?:\d+ )?more.*)|(?:[a-z]\w*" + DOTTED + r"\.[A-Za-z]\w*(?:Exception|Error|Throwable)(?:: .*)?)"
ISO = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
TS_ISO = ISO + r"(?:[.,]\d{1,9})?" + ZONE + "?"
TS_ISO_TZ = TS_ISO + r"(?: [+-]\d{2}:\d{2})?"
TS_ISO_MID = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"
TS_JUL = MONTH + r" \d{1,2}, \d{4} \d{1,2}:\d{2}:\d{2} (?:AM|PM)"
TS_JULI = r"\d{1,2}-" + MONTH + r"-\d{4} \d{2}:\d{2}:\d{2}\.\d{1,3}"
TS_GO = r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}"
TS_SYSLOG = r"(?:<\d{1,3}>)?" + MONTH + r"\s+\d{1,2} \d{2}:\d{2}:\d{2}"
TS_SQUARE = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?: [+-]\d{4})?"
TS_DJANGO = r"\d{1,2}/" + MONTH + r"/\d{4} \d{2}:\d{2}:\d{2}"
TS_APACHE = r"[A-Z][a-z]{2} " + MONTH + r" \d{2} \d{2}:\d{2}:\d{2}\.\d{1,6} \d{4}"
TS_MONOLOG = ISO + r"(?:\.\d{1,9})?" + ZONE + "?"
TS_ACCESS = r"\d{2}/" + MONTH + r"/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}"
RFC3339 = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})"

_PART = re.compile(r"\\.|\[\^?(?:\\.|[^\]\\])*\]|.", re.DOTALL)
#: What RE2 takes for s and k where case is ignored, besides their capitals.
_FOLDED = "\u017f\u212a"


def on_jvm(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for the JVM, so that it matches what it matches in RE2: a dot is all but a newline, white space has no vertical
    tab, and without case s and k have a third form. Dotted names are taken for good, as going back takes stack by the dot."""

    def part(found: re.Match) -> str:
        p = found[0]
        if p in (r"\s", r"\S"):
            return r"[\t\n\f\r ]" if p == r"\s" else r"[^\t\n\f\r ]"
        if not ignore_case:
            return p
        if p == r"\w" or p in "sSkK":
            return f"[{p}{_FOLDED if p == r'\w' else _FOLDED[p in 'kK']}]"
        return p[:-1] + _FOLDED + "]" if p.startswith("[") and ("a-z" in p or r"\w" in p) else p

    return "(?d)" + _PART.sub(part, pattern.replace(DOTTED, r"(?:\.[\w$]++(?=\.))++"))


@dataclass(frozen=True)
class LogFormat:
    """One layout. Patterns match whole lines; `also` are further patterns that a record must contain.

    ignore_case holds for the continuation pattern alone. Users may pass lists of their own formats, also from a table
    (from_table). A predicate tells records that no pattern can: it gets batches of lines that the format's patterns leave
    undecided, and only those. A record of None has no pattern. Patterns of a portable format mean what they mean to RE2, those of
    others what the JVM makes of them.
    """

    name: str
    priority: int
    record: str | None
    continuation: str | None = None
    timestamp: str | None = None
    ignore_case: bool = False
    also: tuple[str, ...] = ()
    predicate: Callable[[pd.Series], pd.Series] | None = None
    portable: bool = False

    def _pattern(self, pattern: str, ignore_case: bool = False) -> str:
        return ("(?i)" if ignore_case else "") + (on_jvm(pattern, ignore_case) if self.portable else pattern)

    def record_test(self, text: Column) -> Column:
        if self.record is None:
            return F.lit(False)
        test = text.rlike(self._pattern(rf"\A(?:{self.record})\z"))
        for p in self.also:
            test = test & text.rlike(self._pattern(p))
        return test

    def continuation_test(self, text: Column) -> Column:
        if self.continuation is None:
            return F.lit(False)
        return text.rlike(self._pattern(rf"\A(?:{self.continuation})\z", self.ignore_case))

    def predicate_test(self, text: Column) -> Column:
        """What the predicate says of undecided lines, in Arrow batches; false for all others. text must be a plain column's
        expression, not one within a higher-order function."""
        predicate = self.predicate

        @F.pandas_udf("boolean")
        def ask(s: pd.Series) -> pd.Series:
            out, some = pd.Series(False, index=s.index), s.notna()
            if some.any():
                out[some] = predicate(s[some]).fillna(False).astype(bool).to_numpy()
            return out

        # so marked, it stays a step of its own: asked once, and other Python steps may read its answer
        return ask.asNondeterministic()(F.when(~(self.record_test(text) | self.continuation_test(text)), text))

    def sql_record(self, text: str) -> str:
        tests = [f"regexp_full_match({text}, {quoted(self.record)})", *(f"regexp_matches({text}, {quoted(p)})" for p in self.also)]
        return "(" + " AND ".join(tests) + ")"

    def sql_continuation(self, text: str) -> str:
        if self.continuation is None:
            return "false"
        return f"regexp_full_match({text}, {quoted(('(?i)' if self.ignore_case else '') + '(?:' + self.continuation + ')')})"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Fixed values, continued: the formats in order of declaration.
_LOGBACK_MORE = JAVA_STACK + r"|(?:\s{2,}\S.*)"
FORMATS: tuple[LogFormat, ...] = (
    LogFormat("Logback / Log4j 2", 20, TS_ISO + r"\s+(?:\[[^\]]*\]\s+)?" + LEVEL + REST, _LOGBACK_MORE, TS_ISO, True),
    LogFormat("java.util.logging", 30, rf"(?:{TS_JUL} [\w$.]+ [\w$.]+)|(?:{TS_JULI} {JUL_LEVEL} \[[^\]]*\].*)", rf"(?:{JUL_LEVEL}: .*)|{JAVA_STACK}", f"{TS_JUL}|{TS_JULI}"),
    LogFormat(
        "Python logging", 30, rf"(?:\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}},\d{{1,3}} - [\w.]+ - {LEVEL} - .*)|(?:{LEVEL}:[\w.]+:.*)",
        r'(?:Traceback \(most recent call last\):)|(?:\s+File "[^"]*", line \d+.*)|(?:\s{4,}\S.*)|(?:[A-Za-z_][\w.]*(?:Error|Exception|Warning|Exit|Interrupt)(?::.*)?)', TS_ISO,
    ),
    LogFormat("Go log / slog", 30, rf"(?:{TS_GO}(?: \S+\.go:\d+)? .*)|(?:{RFC3339} {LEVEL} .*)", None, f"{TS_GO}|{TS_ISO_MID}"),
    LogFormat("Structured JSON", 30, r"\{.*\}\s*", also=(r'^\{[^\n]*"(?:log\.)?level"\s*:', r'^\{[^\n]*"(?:msg|message|event)"\s*:')),
    LogFormat("nginx / Apache access", 40, r'\S+ \S+ \S+ \[[^\]]*\] "[^"]*" \d{3} (?:\d+|-).*', None, TS_ACCESS),
    LogFormat("nginx error", 40, rf"{TS_GO} \[{SERVER_LEVEL}\] \d+#\d+: .*", None, TS_GO),
    LogFormat("Apache error", 40, rf"\[{TS_APACHE}\] \[[^\]:]+:{SERVER_LEVEL}\].*", None, TS_APACHE),
    LogFormat("PHP / Laravel (Monolog)", 30, rf"\[{TS_MONOLOG}\] [\w.-]+\.{LEVEL}: .*", r'(?:\[stacktrace\]\s*)|(?:\[previous exception\] .*)|(?:#\d+ .*)|(?:"\}\s*)|(?:\s+\S.*)', TS_MONOLOG),
    LogFormat("Django / gunicorn", 30, rf'(?:\[{TS_SQUARE}\] \[\d+\] \[[^\]]+\] .*)|(?:\[{TS_DJANGO}\] ".*" \d{{3}} .*)', None, f"{TS_SQUARE}|{TS_DJANGO}"),
    LogFormat(
        ".NET (Microsoft.Extensions.Logging)", 30, rf"(?:\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}\.\d{{1,9}} [+-]\d{{2}}:\d{{2}} \[[^\]]+\] .*)|(?:{DOTNET_LEVEL}: \S+\[\d+\].*)",
        r"(?: {6}\S.*)|(?:\s+at .*)|(?:\s*--- End of .*)", TS_ISO_TZ,
    ),
    LogFormat("syslog", 30, rf"(?:<\d{{1,3}}>)?(?:{MONTH}\s+\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}} \S+ \S+(?:\[\d+\])?: .*)|(?:{RFC3339} \S+ \S+(?:\[\d+\])?: .*)", None, f"{TS_SYSLOG}|{TS_ISO_MID}"),
    LogFormat("Plain timestamp", 10, ISO + REST, _LOGBACK_MORE, TS_ISO, True),
)
FORMATS = tuple(replace(f, portable=True) for f in FORMATS)
BY_NAME = {f.name: f for f in FORMATS}

#: Formats that a table may hold: each is a pattern in the plan.
MOST_FORMATS = 200
REFUSED = "name string, reason string"


def from_table(table: DataFrame, predicates: dict[str, Callable[[pd.Series], pd.Series]] | None = None, most: int = MOST_FORMATS) -> tuple[tuple[LogFormat, ...], DataFrame]:
    """Formats of a table's rows, and what is refused of it (name, reason).

    Columns are name, place (order of declaration), priority, record, and may be continuation, timestamp, ignore_case. Refused are rows
    without name or place, a name's later rows, rows with neither pattern nor predicate for their name, and rows of which a
    pattern does not compile. The table is read when this is called; one of more than `most` rows is refused as a whole.
    """
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} formats")
    compiles = table.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile  # patterns are the engine's, not Python's
    found: dict[str, LogFormat] = {}
    refused: list[tuple[str | None, str]] = []
    for row in sorted((r.asDict() for r in rows), key=lambda r: (r["place"] is None, r["place"] or 0, r["name"] or "", r["record"] or "")):
        name, reason = row["name"], None
        ask = (predicates or {}).get(name)
        if not name or row["place"] is None:
            reason = "no name or place"
        elif name in found:
            reason = "name repeats"
        elif row["record"] is None and ask is None:
            reason = "no pattern"
        for part in ("record", "continuation", "timestamp"):
            if reason is None and row.get(part) is not None:
                try:
                    compiles(row[part])
                except Exception:  # noqa: BLE001  whatever the engine says of it
                    reason = f"{part} does not compile"
        if reason is None:
            found[name] = LogFormat(name, row["priority"] or 0, row["record"], row.get("continuation"), row.get("timestamp"), bool(row.get("ignore_case")), predicate=ask)
        else:
            refused.append((name, reason))
    return tuple(found.values()), table.sparkSession.createDataFrame(refused, REFUSED)
