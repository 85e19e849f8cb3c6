"""Which format a file uses: one wide pass over its lines, one row per file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.formats import FORMATS, LogFormat
from tidelog.functions.text import clean, contains_escape, is_blank, let, trim_crs

THRESHOLD = 0.5


#: Formats whose answers fit one number, two bits each.
PACK = 31


def normalised(lines: DataFrame) -> DataFrame:
    """lines with text (escapes and carriage returns gone), has_ansi, is_blank."""
    text = clean(F.col("raw"))
    return lines.withColumn("text", text).withColumn("has_ansi", contains_escape(trim_crs(F.col("raw")))).withColumn("is_blank", is_blank(F.col("text")))


def _bits(text: Column, formats: tuple[LogFormat, ...]) -> Column:
    """Two bits a format: 1 where a line is explained (record or continuation), 1 more where it is a record."""
    answers = [F.when(f.record_test(text), F.lit(3 << 2 * i)).when(f.continuation_test(text), F.lit(1 << 2 * i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(formats)]
    return reduce(Column.bitwiseOR, answers)


def answered(lines: DataFrame, formats: tuple[LogFormat, ...] = FORMATS, *more: str) -> DataFrame:
    """path, the columns `more`, text, has_ansi, bits (an array of numbers; null for blank lines): all patterns in one pass.

    Where formats have predicates, these are asked in the same pass.
    """
    groups = [formats[i : i + PACK] for i in range(0, len(formats), PACK)]
    asked = [(i, f) for i, f in enumerate(formats) if f.predicate is not None]
    if asked:
        rest = answered(lines, tuple(replace(f, predicate=None) for f in formats), *more)
        said = rest.select("*", *[f.predicate_test(F.when(F.col("bits").isNotNull(), F.col("text"))).alias(f"_p{i}") for i, f in asked])
        own = {g: [F.when(F.col(f"_p{i}"), F.lit(3 << 2 * (i % PACK))).otherwise(F.lit(0)).cast("long") for i, _ in asked if i // PACK == g] for g in range(len(groups))}
        bits = F.array(*[reduce(Column.bitwiseOR, own[g], F.get("bits", F.lit(g))) for g in range(len(groups))])
        return said.select("path", *more, "text", "has_ansi", F.when(F.col("bits").isNotNull(), bits).alias("bits"))
    text = let(clean(F.col("raw")), lambda t: F.struct(t.alias("text"), F.when(~is_blank(t), F.array(*[_bits(t, g) for g in groups])).alias("bits")))
    return lines.select("path", *more, contains_escape(trim_crs(F.col("raw"))).alias("has_ansi"), text.alias("_t")).select("path", *more, "_t.text", "has_ansi", "_t.bits")


def _said(i: int, bit: int) -> Column:
    return F.get("bits", F.lit(i // PACK)).bitwiseAND(F.lit(bit << 2 * (i % PACK)).cast("long")) != 0


def match_matrix(lines: DataFrame, formats: tuple[LogFormat, ...] = FORMATS) -> DataFrame:
    """Non-blank lines with r0.. (is a record of format i) and e0.. (record or continuation)."""
    a = answered(lines, formats, "line_no").where("bits is not null")
    return a.select("path", "line_no", "text", "has_ansi", *[_said(i, 2).alias(f"r{i}") for i in range(len(formats))], *[_said(i, 1).alias(f"e{i}") for i in range(len(formats))])


def scores(lines: DataFrame, formats: tuple[LogFormat, ...] = FORMATS, *more: str) -> DataFrame:
    """path, scanned, ansi_lines, rec0.., exp0.., and of the columns `more` a file's greatest value: lines are counted by their
    answers first, of which a file has a few dozen at most, and only these counts are exchanged and taken apart."""
    greatest = [F.max(m).alias(m) for m in more]
    alike = answered(lines, formats, *more).groupBy("path", "has_ansi", "bits").agg(F.count("*").alias("n"), *greatest)

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))

    some = F.col("bits").isNotNull()
    return alike.groupBy("path").agg(
        total(some).alias("scanned"), total(some & F.col("has_ansi")).alias("ansi_lines"), *[total(_said(i, bit)).alias(f"{name}{i}") for i in range(len(formats)) for bit, name in ((2, "rec"), (1, "exp"))], *greatest
    )


def percent_text(matched: Column, scanned: Column) -> Column:
    """One decimal; never 100.0% while a line is unmatched."""
    tenths = F.floor(matched * F.lit(1000.0) / F.greatest(scanned, F.lit(1)) + F.lit(0.5)).cast("long")
    tenths = F.when((tenths == 1000) & (matched < scanned), F.lit(999).cast("long")).otherwise(tenths)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def verdicts(scored: DataFrame, formats: tuple[LogFormat, ...] = FORMATS, *more: str) -> DataFrame:
    """path, outcome, format, matched, scanned, ratio, percent_text, closest, closest_text, ansi_lines, and the columns `more`.

    The candidate explains most lines among formats with a record; ties go to priority, then to declaration. It is the
    format if it explains half of the lines, else only the closest. Lines without a path are no file, and have no candidate.
    """
    options = F.array(*[F.struct(F.col(f"exp{i}").alias("explained"), F.lit(f.priority).alias("priority"), F.lit(-i).alias("place"), F.lit(f.name).alias("name"), F.col(f"rec{i}").alias("records")) for i, f in enumerate(formats)])
    # a grouped maximum over the file's own rows: no new exchange, and the choice is made once however often it is read
    b = scored.select("path", "scanned", "ansi_lines", *more, F.explode(options).alias("o")).groupBy("path").agg(
        F.first("scanned").alias("scanned"), F.first("ansi_lines").alias("ansi_lines"), *[F.first(m).alias(m) for m in more], F.max(F.when((F.col("o.records") > 0) & F.col("path").isNotNull(), F.col("o"))).alias("best")
    )
    hit = F.col("best").isNotNull() & (F.col("best.explained") * 2 >= F.col("scanned")) & (F.col("scanned") > 0)
    share = percent_text(F.col("best.explained"), F.col("scanned"))
    return b.select(
        "path", F.when(hit, "matched").otherwise("no_match").alias("outcome"), F.when(hit, F.col("best.name")).alias("format"),
        F.when(hit, F.col("best.explained")).alias("matched"), "scanned", F.when(hit, F.col("best.explained") / F.col("scanned")).alias("ratio"),
        F.when(hit, share).alias("percent_text"), F.when(~hit, F.col("best.name")).alias("closest"), F.when(~hit, share).alias("closest_text"), "ansi_lines", *more,
    )


def detect(lines: DataFrame, formats: tuple[LogFormat, ...] = FORMATS) -> DataFrame:
    return verdicts(scores(lines, formats), formats)


_ENDED = ("has_more_lines", "hit_bytes", "error")


def ended(rows: DataFrame, formats: tuple[LogFormat, ...] = FORMATS) -> DataFrame:
    """Verdicts of files as reader.capped() reads them, with complete and reason: a file whose reading failed is `failed`, whatever
    was read of it before."""
    v = verdicts(scores(rows, formats, *_ENDED), formats, *_ENDED)
    lost = F.col("error").isNotNull()
    kept = [c for c in v.columns if c not in ("path", "outcome", *_ENDED)]
    cut = F.coalesce("has_more_lines", F.lit(False)) | F.coalesce("hit_bytes", F.lit(False))
    return v.select("path", F.when(lost, "failed").otherwise(F.col("outcome")).alias("outcome"), *[F.when(~lost, F.col(c)).alias(c) for c in kept], (lost | ~cut).alias("complete"), F.col("error").alias("reason"))


def two_phase(heads: DataFrame, refine: Callable[[DataFrame], DataFrame], formats: tuple[LogFormat, ...] = FORMATS) -> DataFrame:
    """Verdicts from a quick look at every file, replaced by those of a long look at files that the quick one did not finish.

    heads: rows as of reader.capped(), with small caps; refine: from a frame of paths to such rows, with large caps. Only files
    that were cut are read again; a file whose second reading fails keeps its first answer, one whose first reading fails is
    not read again. phase says which look an answer is from; complete, whether a cap still cuts it.
    """
    first = ended(heads, formats).persist()  # a row a file, asked twice; lost parts are read again
    second = ended(refine(first.where("not complete").select("path")), formats).where("outcome <> 'failed'")
    fields = [c for c in first.columns if c != "path"]
    both = first.join(second.select(F.col("path").alias("_path"), F.struct(*fields).alias("_second")), F.col("path") == F.col("_path"), "left")
    again = F.col("_second").isNotNull()
    return both.select("path", *[F.when(again, F.col(f"_second.{c}")).otherwise(F.col(c)).alias(c) for c in fields], F.when(again, "refined").otherwise("head").alias("phase"))


def named_stats(lines: DataFrame, fmt: LogFormat) -> DataFrame:
    """path, matched, scanned of one known format; files without a line to scan are absent."""
    m = match_matrix(lines, (fmt,))
    return m.groupBy("path").agg(F.count_if("e0").alias("matched"), F.count("*").alias("scanned"))


def unmatched(lines: DataFrame, verdict: DataFrame, first: int = 3, formats: tuple[LogFormat, ...] = FORMATS) -> DataFrame:
    """The first lines of each matched file that its format does not explain; tasks keep `first` of each file before any exchange."""
    m = match_matrix(lines, formats).join(verdict.where("outcome = 'matched'").select("path", "format"), "path")
    explained = F.coalesce(*[F.when(F.col("format") == f.name, F.col(f"e{i}")) for i, f in enumerate(formats)])
    w = Window.partitionBy("path").orderBy("line_no")
    return m.where(~explained).withColumn("k", F.row_number().over(w)).where(F.col("k") <= first).select("path", "line_no", "text")


def render_mode(verdict: DataFrame) -> DataFrame:
    """How a file is shown: by its format, by its terminal colours alone, or plainly."""
    return verdict.withColumn("render_mode", F.when(F.col("outcome") == "matched", "format").when(F.col("ansi_lines") > 0, "ansi").otherwise("plain"))
