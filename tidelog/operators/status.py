"""Status lines in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.index import MAX_CHARS

# Wording.
UNKNOWN = "Format: <unknown>"
TAIL_UNAVAILABLE = "live tail unavailable — reopen to refresh"
DISABLED = "highlighting disabled for this file"
FAILED = "could not be read"
HEAD, MATCHED, NO_MATCH, CLOSEST = "Format: ", " — matched ", "Format: no format matched ", " (closest: "
ANSI_ONLY, PLAIN = "showing ANSI colours only", "showing plain text"


def grouped(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def line_note(lines: Column, capped: Column) -> Column:
    return F.concat(grouped(lines), F.when(capped, "+ lines (line index capped)").otherwise(" lines"))


def too_large_note(max_chars: int = MAX_CHARS) -> str:
    return f"not indexed: file is over {max_chars // 1024**3:,} G characters"


def status(verdicts: DataFrame, note: Column | None = None, notes: list[Column] | None = None) -> DataFrame:
    """verdicts with status_text, tooltip, warning. note: the scan's caps; notes: what follows the text, nulls left out."""
    note = F.lit(None).cast("string") if note is None else note
    tail = F.coalesce(F.concat(F.lit(" — "), note), F.lit(""))
    hit, ansi = F.col("outcome") == "matched", F.col("ansi_lines") > 0
    matched = F.concat(F.lit(HEAD), F.col("format"), F.lit(MATCHED), grouped(F.col("matched")), F.lit(" / "), grouped(F.col("scanned")), F.lit(" lines ("), F.col("percent_text"), F.lit(")"), tail)
    none = F.concat(
        F.lit(NO_MATCH), F.col("scanned").cast("string"), F.lit(" lines — "), F.when(ansi, ANSI_ONLY).otherwise(PLAIN),
        F.coalesce(F.concat(F.lit(CLOSEST), F.col("closest"), F.lit(", "), F.col("closest_text"), F.lit(")")), F.lit("")),
    )
    tip_hit = F.concat(F.lit("matched "), F.col("matched").cast("string"), F.lit(" of "), F.col("scanned").cast("string"), F.lit(" non-blank lines scanned"), tail)
    tip_none = F.concat(F.when(ansi, "No log format explains this file: only its ANSI colour codes are shown").otherwise("Files that no format explains stay uncoloured"), tail)
    text = F.when(hit, matched).otherwise(none)
    if notes:
        text = F.concat_ws(" — ", text, *notes)
    return verdicts.withColumn("status_text", text).withColumn("tooltip", F.when(hit, tip_hit).otherwise(tip_none)).withColumn("warning", ~hit)


def outcome_text(outcome: Column, max_chars: int = MAX_CHARS) -> Column:
    """What is said of a file that is not scanned: too large, not read, or switched off; null for others."""
    return F.when(outcome == "too_large", too_large_note(max_chars)).when(outcome == "failed", FAILED).when(outcome == "disabled", DISABLED)
