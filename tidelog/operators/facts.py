"""Line facts: which lines start records and how severe they are; filters, folds and error walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.formats import FORMATS, LogFormat
from tidelog.functions.levels import LEVELS, after_timestamp, by_name, level_prefix, ramp_of, record_word, word_without_format
from tidelog.functions.segment import walked_level
from tidelog.functions.text import ansi_strip, drop_cr, let
from tidelog.operators.carry import BLOCK, block_of, carried, in_block, with_next


#: Files whose formats are sent to every task; of more, formats meet their lines in a join by file and block.
FEW_FILES = 50_000
SALT = 64


def with_formats(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """lines with the format of their file, null where none matched.

    Verdicts are a row per file and are looked at first: up to FEW_FILES are broadcast, and what found them isn't run again.
    Beyond that both sides are dealt by file and block, so that one huge file isn't one task.
    """
    v = verdicts.select("path", F.when(F.col("outcome") == "matched", F.col("format")).alias("format"))
    found = v.limit(FEW_FILES + 1).collect()
    if len(found) <= FEW_FILES:
        return lines.join(F.broadcast(lines.sparkSession.createDataFrame(found, v.schema)), "path", "left")
    salted = v.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return lines.withColumn("_salt", F.pmod(block_of(F.col("line_no")), F.lit(SALT)).cast("int")).join(salted, ["path", "_salt"], "left").drop("_salt")


def line_facts(lines: DataFrame, verdicts: DataFrame, formats: tuple[LogFormat, ...] = FORMATS, walk: bool = True, pull_up: bool = True) -> DataFrame:
    """path, line_no, raw, format, is_record, level.

    Files with a format are read by it; the others by level words alone. Lines whose level the regular form can't tell
    (quotes or open brackets before it) go through the segmenter, and only those. A record without a level takes that of
    a line such as `SEVERE: ...` right after it. Predicates are asked of lines of their own format's files.
    """
    base = with_formats(lines, verdicts)
    known = F.col("format").isNotNull()
    asked = {f.name: f"_p{i}" for i, f in enumerate(formats) if f.predicate is not None}
    if asked:
        plain = ansi_strip(drop_cr(F.col("raw")))
        base = base.select("*", *[f.predicate_test(F.when(F.col("format") == f.name, plain)).alias(asked[f.name]) for f in formats if f.name in asked])

    def with_format(text: Column) -> Column:
        record = F.coalesce(by_name(F.col("format"), formats, lambda x: x.record_test(text) | F.col(asked[x.name]) if x.name in asked else x.record_test(text)), F.lit(False)) & (text != "")
        rest = by_name(F.col("format"), formats, lambda x: after_timestamp(text, x))
        read = let(let(rest, record_word), lambda w: F.struct(F.lit(True).alias("is_record"), ramp_of(w["word"]).alias("level"), w["hard"].alias("hard"), F.lit(None).cast("string").alias("more")))
        other = F.struct(F.lit(False).alias("is_record"), F.lit(None).cast("string").alias("level"), F.lit(False).alias("hard"), ramp_of(level_prefix(text)).alias("more"))
        return F.when(record, read).otherwise(other)

    def without_format(text: Column) -> Column:
        return let(word_without_format(text), lambda w: F.struct(w.isNotNull().alias("is_record"), ramp_of(w).alias("level"), F.lit(False).alias("hard"), F.lit(None).cast("string").alias("more")))

    # each pattern is in the plan once and is tried once a line, for the line's own format alone
    read = let(ansi_strip(drop_cr(F.col("raw"))), lambda text: F.when(known, with_format(text)).otherwise(without_format(text)))
    f = base.withColumn("_f", read).select("path", "line_no", "raw", "format", "_f.is_record", "_f.level", F.col("_f.hard").alias("_hard"), F.col("_f.more").alias("_more"))
    if walk:
        f = f.withColumn("level", F.coalesce(walked_level(F.col("raw"), F.col("format"), F.col("_hard"), formats), F.when(~F.col("_hard"), F.col("level"))))
    if pull_up:
        alone = F.col("is_record") & F.col("level").isNull() & known
        f = with_next(f, _after=F.col("_more")).withColumn("level", F.when(alone, F.col("_after")).otherwise(F.col("level")))
    return f.select("path", "line_no", "raw", "format", "is_record", "level")


def ordinal(level: Column) -> Column:
    """0 to 3; null without a level."""
    return F.when(level.isNotNull(), F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1)


def encoded(facts: DataFrame) -> DataFrame:
    """facts with fact: 0 for no record, 128 for a record without a level, else 129 to 132."""
    return facts.withColumn("fact", F.when(~F.col("is_record"), F.lit(0)).otherwise(F.coalesce(ordinal(F.col("level")) + 129, F.lit(128))).cast("long"))


def decoded(fact: Column) -> Column:
    """is_record, level, is_error of an encoded fact."""
    code = fact.bitwiseAND(15).cast("int")
    level = F.when(code > 0, F.get(F.array(*[F.lit(x) for x in LEVELS]), code - 1))
    return F.struct((fact.bitwiseAND(128) != 0).alias("is_record"), level.alias("level"), (fact == 132).alias("is_error"))


def record_ids(facts: DataFrame, block: int = BLOCK) -> DataFrame:
    """facts with record_id: the line that starts the record a line belongs to; null before the first record."""
    return carried(facts, block, record_id=F.when(F.col("is_record"), F.col("line_no")))


def records(facts: DataFrame) -> DataFrame:
    """One row per record: path, record_id, level, n_lines, head. Long records stay sums, not lists."""
    return record_ids(facts).where("record_id is not null").groupBy("path", "record_id").agg(
        F.max(F.when(F.col("is_record"), F.col("level"))).alias("level"), F.count("*").alias("n_lines"), F.max(F.when(F.col("is_record"), F.col("raw"))).alias("head")
    )


def hides_nothing(levels: set[str] | None, text: str) -> bool:
    return (levels is None or set(levels) == set(LEVELS)) and not text.strip()


def visible(levels: set[str] | None = None, text: str = "") -> Column:
    """Whether a record passes: its level is wanted (records without one always pass) and its raw line holds the text."""
    ok = F.lit(True)
    if levels is not None and set(levels) != set(LEVELS):
        ok = F.col("level").isNull() | F.col("level").isin(*sorted(levels))
    if text.strip():
        ok = ok & F.contains(F.lower("raw"), F.lit(text.lower()))
    return ok


def hidden(facts: DataFrame, levels: set[str] | None = None, text: str = "", block: int = BLOCK) -> DataFrame:
    """facts with is_hidden: lines follow the record they belong to; lines before the first record show."""
    if hides_nothing(levels, text):
        return facts.withColumn("is_hidden", F.lit(False))
    marked = carried(facts, block, _mark=F.when(F.col("is_record"), ~visible(levels, text)))
    return marked.withColumn("is_hidden", F.coalesce("_mark", F.lit(False))).drop("_mark")


def _marks(facts: DataFrame, levels: set[str] | None, text: str, block: int = BLOCK) -> DataFrame:
    """path, line_no, _block, is_hidden alone: of each line only whether its record is shut goes through the exchange, once."""
    own = facts.select("path", "line_no", block_of(F.col("line_no"), block).alias("_block"), F.when(F.col("is_record"), ~visible(levels, text)).alias("_shut"))
    return carried(own, block, once=True, _mark=F.col("_shut")).select("path", "line_no", "_block", F.coalesce("_mark", F.lit(False)).alias("is_hidden"))


def fold_runs(facts: DataFrame, levels: set[str] | None = None, text: str = "", block: int = BLOCK) -> DataFrame:
    """path, first_line, last_line, line_count: maximal runs of hidden lines. The default filter hides nothing.

    Runs are found within blocks of lines; of a block's runs, those at its edges (two at most) are joined to their
    neighbours in a second, small pass over the files.
    """
    if hides_nothing(levels, text):
        return facts.select("path", F.col("line_no").alias("first_line"), F.col("line_no").alias("last_line"), F.lit(0).cast("long").alias("line_count")).where(F.lit(False))
    h = _marks(facts, levels, text, block)
    starts = (F.col("is_hidden") & ~F.coalesce(F.lag("is_hidden").over(in_block()), F.lit(False))).cast("long")
    whole = Window.partitionBy("path", "_block")
    marked = h.select("path", "line_no", "_block", "is_hidden", F.sum(starts).over(in_block().rowsBetween(Window.unboundedPreceding, 0)).alias("_run"), F.min("line_no").over(whole).alias("_low"), F.max("line_no").over(whole).alias("_high"))
    sums = [F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("line_count").alias("line_count")]
    runs = marked.where("is_hidden").groupBy("path", "_block", "_run").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("line_count"), F.bool_or(F.col("line_no") == F.col("_low")).alias("_opens"), F.bool_or(F.col("line_no") == F.col("_high")).alias("_closes")
    )
    inner = runs.where("not _opens and not _closes").select("path", "first_line", "last_line", "line_count")
    ahead = Window.partitionBy("path").orderBy("first_line")
    # lines are numbered without gaps, so a run goes on where the one before it ended
    edge = runs.where("_opens or _closes").withColumn("_new", F.coalesce((F.lag("last_line").over(ahead) + 1 != F.col("first_line")).cast("long"), F.lit(1)))
    edge = edge.withColumn("_joined", F.sum("_new").over(ahead.rowsBetween(Window.unboundedPreceding, 0))).groupBy("path", "_joined").agg(*sums).drop("_joined")
    return inner.unionByName(edge)


def hidden_counts(facts: DataFrame, levels: set[str] | None = None, text: str = "") -> DataFrame:
    """path, n_hidden, n_lines, note."""
    h = facts.select("path", F.lit(False).alias("is_hidden")) if hides_nothing(levels, text) else _marks(facts, levels, text)
    c = h.groupBy("path").agg(F.count_if("is_hidden").alias("n_hidden"), F.count("*").alias("n_lines"))
    return c.withColumn("note", F.format_string("filter hides %,d of %,d lines", F.col("n_hidden"), F.col("n_lines")))


def fold_text(count: Column) -> Column:
    return F.format_string("… %d hidden", count)


def error_walk(facts: DataFrame, forward: bool = True, block: int = BLOCK) -> DataFrame:
    """facts with target: the next (or the one before) ERROR record, round the file's end; null if the file has none."""
    line = F.when(F.col("is_record") & (F.col("level") == "ERROR"), F.col("line_no"))
    beside = carried(facts, block, backward=forward, strictly=True, _beside=line)
    ends = facts.groupBy("path").agg((F.min if forward else F.max)(line).alias("_round"))
    return beside.join(ends, "path").select(*facts.columns, F.coalesce("_beside", "_round").alias("target"))


def next_error(facts: DataFrame, line: int, forward: bool = True) -> DataFrame:
    """path, target from one line of every file: two grouped minima, no window."""
    errors = facts.where("is_record and level = 'ERROR'")
    if forward:
        return errors.groupBy("path").agg(F.coalesce(F.min(F.when(F.col("line_no") > line, F.col("line_no"))), F.min("line_no")).alias("target"))
    return errors.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("line_no") < line, F.col("line_no"))), F.max("line_no")).alias("target"))


def any_error(facts: DataFrame) -> DataFrame:
    return facts.groupBy("path").agg(F.bool_or(F.col("is_record") & F.coalesce(F.col("level") == "ERROR", F.lit(False))).alias("any_error"))


def resume_points(facts: DataFrame) -> DataFrame:
    """path, resume: the last record's start, from which facts of an appended file are computed anew."""
    return facts.where("is_record").groupBy("path").agg(F.max("line_no").alias("resume"))


def appended(before: DataFrame, lines: DataFrame, verdicts: DataFrame, formats: tuple[LogFormat, ...] = FORMATS) -> DataFrame:
    """Facts of grown files from the facts before and all lines now: only lines from the resume point on are classified."""
    points = before.select("path").distinct().join(resume_points(before), "path", "left").withColumn("resume", F.coalesce("resume", F.lit(0)))
    fresh = lines.join(points, "path", "left").where(F.col("resume").isNull() | (F.col("line_no") >= F.col("resume"))).drop("resume")
    kept = before.join(points, "path").where(F.col("line_no") < F.col("resume")).drop("resume")
    return kept.unionByName(line_facts(fresh, verdicts, formats))
