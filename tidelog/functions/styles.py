"""Terminal styles, and where escapes stand, as Column expressions: no Python worker reads a line.

`ansi.runs_of` gives the same runs out of Arrow batches, which takes about two thirds of the time once warm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ansi import COLOUR, RUNS
from tidelog.functions.text import ESC, ESCAPE, contains_escape, let, scan

#: What stands in a colour sequence besides its parameters: escape, bracket, intermediate bytes, final byte.
NO_PARAMETER = f"{ESC}[m" + "".join(map(chr, range(0x20, 0x30)))
#: Bits of a style's flags.
BOLD, DIM, ITALIC, UNDERLINE = 1, 2, 4, 8
#: A colour as one number: its kind, above 24 bits of code or channels; 0 for none.
NAMED, INDEXED, RGB = 1 << 24, 2 << 24, 3 << 24
_KINDS = ("named", "indexed", "rgb")
#: What a sequence's next parameter is: a selector, the kind of a colour, an index, the red, green or blue of a direct
#: colour, or of no account, as one before it was malformed.
SELECTOR, KIND, INDEX, RED, GREEN, BLUE, IGNORED = range(7)
_STATE = "struct<fg:int,bg:int,flags:int,expects:int,target:int,channels:int>"


def _state(fg: Column, bg: Column, flags: Column, expects: Column | int = SELECTOR, target: Column | int = 0, channels: Column | int = 0) -> Column:
    parts = (fg, bg, flags, expects, target, channels)
    return F.struct(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast(_STATE)


def parameters(sequence: Column) -> Column:
    """A select-graphic-rendition sequence's parameters as (n, whole, given); null for other sequences.

    Colons part like semicolons; a direct colour's colour-space number is left out. n is the number in front: 0 where there is
    none, and of over nine digits one that means nothing. whole: there is nothing else; given: there are digits.
    """
    bare = F.translate(sequence, NO_PARAMETER, "")
    flat = F.when(F.contains(bare, F.lit(":2:")), F.regexp_replace(bare, r"(?<![^;])(38|48):2:[^:;]*:([^:;]*):([^:;]*):([^:;]*)(?![^;])", "$1:2:$2:$3:$4")).otherwise(bare)

    def one(p: Column) -> Column:
        return let(p.try_cast("int"), lambda n: F.when(n.isNotNull(), _parameter(F.least(n, F.lit(10**9)), F.lit(True), F.lit(True))).when(p == "", _parameter(F.lit(0), F.lit(True), F.lit(False))).otherwise(odd(p)))

    def odd(p: Column) -> Column:
        digits = F.regexp_extract(p, "^[0-9]*", 0)
        short = F.regexp_replace(digits, "^0+", "")
        n = F.when(F.length(short) > 9, F.lit(10**9)).when(short == "", F.lit(0)).otherwise(short.try_cast("int"))
        return _parameter(n, F.length(digits) == F.length(p), digits != "")

    # of the sequences that open with a bracket, only a final byte can be a letter
    return F.when(F.startswith(sequence, F.lit(f"{ESC}[")) & F.endswith(sequence, F.lit("m")), F.transform(F.split(F.translate(flat, ":", ";"), ";"), one))


def _parameter(n: Column, whole: Column, given: Column) -> Column:
    return F.struct(n.alias("n"), whole.alias("whole"), given.alias("given"))


def select(s: Column, p: Column) -> Column:
    """The state after one parameter."""
    n, flags = p["n"], s["flags"]
    expects = F.when(p["whole"], SELECTOR).otherwise(IGNORED)
    value = F.least(n, F.lit(255))
    channels = s["channels"] * 256 + value
    colour = F.when(s["expects"] == INDEX, value + INDEXED).otherwise(channels + RGB)
    fg = F.when(n.isin(0, 39), 0).when(n.between(30, 37) | n.between(90, 97), n + NAMED).otherwise(s["fg"])
    bg = F.when(n.isin(0, 49), 0).when(n.between(40, 47) | n.between(100, 107), n - 10 + NAMED).otherwise(s["bg"])
    on = F.when(n == 1, BOLD).when(n == 2, DIM).when(n == 3, ITALIC).when(n.isin(4, 21), UNDERLINE).otherwise(0)
    off = F.when(n == 22, BOLD | DIM).when(n == 23, ITALIC).when(n == 24, UNDERLINE).when(n == 0, BOLD | DIM | ITALIC | UNDERLINE).otherwise(0)
    ignored = _state(s["fg"], s["bg"], flags, IGNORED)
    return (
        F.when(s["expects"] == IGNORED, s)
        .when((s["expects"] == SELECTOR) & n.isin(38, 48) & p["whole"], _state(s["fg"], s["bg"], flags, KIND, n))
        .when(s["expects"] == SELECTOR, _state(fg, bg, flags.bitwiseOR(on).bitwiseAND(F.bitwise_not(off)), expects))
        .when(~p["whole"], ignored)
        .when((s["expects"] == KIND) & p["given"] & n.isin(2, 5), _state(s["fg"], s["bg"], flags, F.when(n == 5, INDEX).otherwise(RED), s["target"]))
        .when(s["expects"] == KIND, ignored)
        .when(s["expects"].isin(RED, GREEN), _state(s["fg"], s["bg"], flags, s["expects"] + 1, s["target"], channels))
        .otherwise(_state(F.when(s["target"] == 38, colour).otherwise(s["fg"]), F.when(s["target"] == 48, colour).otherwise(s["bg"]), flags))
    )


def _after(s: Column, params: Column) -> Column:
    """The state after one sequence."""
    return F.when(params.isNull(), s).otherwise(F.aggregate(params, _state(s["fg"], s["bg"], s["flags"]), select))


def _unpacked(c: Column) -> Column:
    kind, rest = F.shiftright(c, 24), c.bitwiseAND(F.lit((1 << 24) - 1))
    code = F.when(kind < 3, rest)
    r, g, b = (F.when(kind == 3, F.shiftright(rest, by).bitwiseAND(F.lit(255))) for by in (16, 8, 0))
    return F.when(kind > 0, F.struct(F.get(F.array(*map(F.lit, _KINDS)), kind - 1).alias("kind"), code.alias("code"), r.alias("r"), g.alias("g"), b.alias("b")).cast(COLOUR))


def _style(s: Column) -> Column:
    flags = (s["flags"].bitwiseAND(F.lit(bit)) != 0 for bit in (BOLD, DIM, ITALIC, UNDERLINE))
    return F.struct(_unpacked(s["fg"]).alias("fg"), _unpacked(s["bg"]).alias("bg"), *(f.alias(n) for f, n in zip(flags, ("bold", "dim", "italic", "underline"), strict=True)))


def escapes(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(ESCAPE), F.lit(0))


def _pieces(raw: Column, taken: Column) -> Column:
    sizes = F.zip_with(F.split(raw, ESCAPE, -1), taken, lambda k, t: F.struct(F.length(k).alias("kept"), F.coalesce(F.length(t), F.lit(0)).alias("taken")))

    def placed(sizes: Column) -> Column:
        starts = scan(sizes, F.lit(0), lambda at, n: at + n["kept"] + n["taken"])
        return F.zip_with(sizes, F.slice(starts, 1, F.size(sizes)), lambda n, at: F.struct(at.alias("start"), (at + n["kept"]).alias("end")))

    return let(sizes, placed)


def pieces(raw: Column) -> Column:
    """Text between escapes, in order, as (start, end) in raw; one more than there are escapes, empty ones included."""
    return _pieces(raw, escapes(raw))


def line_runs(raw: Column) -> Column:
    """Styled runs (start, end, style) over a line's raw text, in expressions alone: the style is a state machine folded over
    the parameters of the line's sequences. Plain text is no run; escapes lie between runs, so none touch."""

    def runs(taken: Column) -> Column:
        states = scan(F.transform(taken, parameters), _state(F.lit(0), F.lit(0), F.lit(0)), _after)
        return F.zip_with(_pieces(raw, taken), states, lambda p, s: F.struct(p["start"].alias("start"), p["end"].alias("end"), s.alias("s")))

    seen = F.filter(let(escapes(raw), runs), lambda r: (r["end"] > r["start"]) & ((r["s"]["fg"] > 0) | (r["s"]["bg"] > 0) | (r["s"]["flags"] > 0)))
    return F.transform(seen, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _style(r["s"]).alias("style"))).cast(RUNS)


def raw_offsets(raw: Column) -> Column:
    """For each character of the stripped text, and for its end, the offset in the raw text."""
    kept = F.filter(pieces(raw), lambda p: p["end"] > p["start"])
    return F.concat(F.flatten(F.transform(kept, lambda p: F.sequence(p["start"], p["end"] - 1))), F.array(F.length(raw)))


def escaped_ranges(raw: Column) -> Column:
    """(start, end) of what escapes take up, end exclusive; sequences side by side are one range: the gaps between kept text."""

    def gaps(kept: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(kept, lambda p: p["end"]))
        starts = F.concat(F.transform(kept, lambda p: p["start"]), F.array(F.length(raw)))
        return F.filter(F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda r: r["end"] > r["start"])

    return let(F.filter(pieces(raw), lambda p: p["end"] > p["start"]), gaps)


def runs_of(lines: DataFrame) -> DataFrame:
    """path, line_no, runs of the lines that hold escapes."""
    return lines.where(contains_escape(F.col("raw"))).select("path", "line_no", line_runs(F.col("raw")).alias("runs"))
