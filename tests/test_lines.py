"""Escapes, styles, levels and segments of single lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.functions import ansi, levels, segment, styles, text
from tidelog.functions.formats import BY_NAME, FORMATS

E = "\x1b"


def column(spark, values, fn):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").orderBy("i").select(fn(F.col("c"))).collect()]


def strip_model(s):
    """Read character by character, independent of the expression."""
    out, i = [], 0
    while i < len(s):
        if s[i] != E:
            out.append(s[i])
            i += 1
            continue
        j = i + 1
        if j >= len(s) or s[j] == "\n":
            i += 1
        elif s[j] == "[":
            j += 1
            while j < len(s) and "0" <= s[j] <= "?":
                j += 1
            while j < len(s) and " " <= s[j] <= "/":
                j += 1
            i = j + 1 if j < len(s) and "@" <= s[j] <= "~" else j
        elif s[j] in "]P^_":
            j += 1
            while j < len(s) and s[j] not in f"\x07{E}\n":
                j += 1
            i = j + 1 if j < len(s) and s[j] == "\x07" else j + 2 if s[j : j + 2] == E + "\\" else j
        elif s[j] in "()*+":
            i = min(j + 2, len(s))
        else:
            i = j + 1
    return "".join(out)


def test_strip_agrees_with_a_model(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice([E, "[", "]", "m", "3", ";", "\x07", "\\", "(", "B", "\n", "a", " ", "P"]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    assert column(spark, values, text.ansi_strip) == [strip_model(v) for v in values]
    for v in values:
        kept, at = ansi.strip_with_map(v)
        assert kept == strip_model(v) and "".join(v[i] for i in at[:-1]) == kept and at[-1] == len(v)


def test_blank_and_line_ends(spark):
    assert column(spark, ["", " \t ", " ", " \x0b", "a", " .", "　"], text.is_blank) == [True, True, True, True, False, False, True]
    assert column(spark, ["a\r\r", "\ra", "a"], text.trim_crs) == ["a", "\ra", "a"]
    assert column(spark, ["a\r\r", "a"], text.drop_cr) == ["a\r", "a"]


def style(**k):
    return {"fg": None, "bg": None, "bold": False, "dim": False, "italic": False, "underline": False} | k


def named(n):
    return {"kind": "named", "code": n, "r": None, "g": None, "b": None}


def test_runs():
    assert ansi.ansi_runs(f"{E}[31mERROR{E}[0m boom") == [{"start": 5, "end": 10, "style": style(fg=named(31))}]
    assert ansi.escape_ranges(f"{E}[31mERROR{E}[0m boom") == [(0, 5), (10, 14)]
    assert ansi.strip_with_map(f"{E}[31mERROR{E}[0m boom")[1][0] == 5
    assert [r["style"] for r in ansi.ansi_runs(f"{E}[1;31ma{E}[22mb{E}[39mc")] == [style(fg=named(31), bold=True), style(fg=named(31))]
    assert ansi.ansi_runs(f"{E}[38;5;196mx")[0]["style"]["fg"]["code"] == 196
    assert ansi.ansi_runs(f"{E}[38;2;255;136;0mx")[0]["style"]["fg"] == {"kind": "rgb", "code": None, "r": 255, "g": 136, "b": 0}
    assert ansi.ansi_runs(f"{E}[38:2::1:2:3mx")[0]["style"]["fg"]["b"] == 3
    assert ansi.ansi_runs(f"{E}[38;2;1;2mx") == [] and ansi.ansi_runs(f"{E}[38;9;1mx") == [] and ansi.ansi_runs(f"{E}[38mx") == []
    assert ansi.ansi_runs(f"{E}[48;5;300mx")[0]["style"]["bg"]["code"] == 255
    assert ansi.ansi_runs(f"{E}[103mx")[0]["style"]["bg"] == named(93)
    assert ansi.ansi_runs(f"{E}[31ma\nb") == [{"start": 5, "end": 6, "style": style(fg=named(31))}]  # styles end with the line
    assert ansi.ansi_runs(f"{E}[mx{E}[7my") == []
    assert len(ansi.ansi_runs(f"{E}[31ma{E}[31mb")) == 2  # the escape lies between


def test_palette(spark):
    got = column(spark, ["1", "16", "196", "231", "232", "255"], lambda c: ansi.palette_rgb(c.cast("int")))
    assert got == [0xCD0000, 0, 0xFF0000, 0xFFFFFF, 0x080808, 0xEEEEEE]


def test_attributes(spark):
    def paint(sgr):
        runs = ansi.ansi_runs(f"{E}[{sgr}mx")
        df = spark.createDataFrame([(runs[0]["style"],)], f"s {ansi.STYLE}")
        return df.select(ansi.style_attributes(F.col("s"), F.lit(0x112233), F.lit(0), F.lit(0xFFFFFF)).alias("a")).select("a.*").first().asDict()

    assert paint("1")["foreground"] == 0x112233 and paint("1")["bold"]
    assert paint("41")["foreground"] is None and paint("41")["background"] == 0xCD0000
    assert paint("2;30")["foreground"] == 0x737373  # 0.45 of the way to white


def test_level_words(spark):
    words = ["ERROR", "warn", "WRN", "inf", "Trace", "fatigue", "executor", "unsupported", "x", "", "SEVERE", "fine", "eror"]
    assert column(spark, words, levels.level_of_word) == ["ERROR", "WARN", "WARN", "INFO", "DEBUG", "ERROR", None, None, None, None, "ERROR", "DEBUG", "ERROR"]


def test_levels_without_format(spark):
    cases = {
        "something ERROR happened": "ERROR", "MyErrorHandler ran": None, "  ERROR indented": None, "Logger.error( x": None, "SEVERE: lost": "ERROR", "WARNING:root: hm": "WARN",
        "CONFIG: on": "INFO", "plain": None, "": None, "a" * 120 + " ERROR": None, "production.ERROR here": None, "x [warn] y": "WARN", "fatal thing": None,
    }
    assert column(spark, list(cases), levels.level_without_format) == list(cases.values())


SAMPLES = {
    "Logback / Log4j 2": ["2026-10-01 09:14:02,101 [main] INFO  a.B - x", "2026-10-01T09:14:02.101+02:00  INFO 12345 --- [main] x", "2026-10-01 09:14:02.101 ERROR a.B - x"],
    "java.util.logging": ["Oct 1, 2026 9:14:02 AM a.B run", "01-Oct-2026 09:14:02.101 SEVERE [main] a.B x"],
    "Python logging": ["2026-10-01 09:14:02,101 - a.b - ERROR - x", "WARNING:root:x"],
    "Go log / slog": ["2026/10/01 09:14:02 main.go:12: x", "2026-10-01T09:14:02Z ERROR x"],
    "Structured JSON": ['{"level":"error","msg":"x"}', '{"@timestamp":"t","log.level":"info","message":"m"}'],
    "nginx / Apache access": ['10.0.0.1 - - [01/Oct/2026:09:14:02 +0000] "GET / HTTP/1.1" 200 12 "-" "x"', '::1 - bob [x] "GET /" 404 -'],
    "nginx error": ["2026/10/01 09:14:02 [error] 12#3: *1 x"],
    "Apache error": ["[Thu Oct 01 09:14:02.123456 2026] [core:error] [pid 1] x"],
    "PHP / Laravel (Monolog)": ["[2026-10-01 09:14:02] production.ERROR: x", "[2026-10-01T09:14:02.123456+00:00] app.INFO: x"],
    "Django / gunicorn": ["[2026-10-01 09:14:02 +0000] [12] [INFO] x", '[01/Oct/2026 09:14:02] "GET / HTTP/1.1" 200 12'],
    ".NET (Microsoft.Extensions.Logging)": ["2026-10-01 09:14:02.101 +02:00 [ERR] x", "fail: A.B[0] x", "info: A.B[14]"],
    "syslog": ["<34>Oct  1 09:14:02 host app[12]: x", "2026-10-01T09:14:02Z host app: x"],
    "Plain timestamp": ["2026-10-01 09:14:02 x", "2026-10-01T09:14:02.5 x"],
}


@pytest.mark.parametrize("name", list(SAMPLES))
def test_records(spark, name):
    assert all(column(spark, SAMPLES[name], BY_NAME[name].record_test))
    assert not any(column(spark, ["plain prose", "", '{"level":"x"}', "\tat a.B.c(D.java:1)"], BY_NAME[name].record_test))


def test_continuations(spark):
    logback, python, php, net = (BY_NAME[n].continuation_test for n in ("Logback / Log4j 2", "Python logging", "PHP / Laravel (Monolog)", ".NET (Microsoft.Extensions.Logging)"))
    stack = ["\tat a.B.c(D.java:1)", "Caused by: x", "\t... 12 more", "java.lang.IllegalStateException: x", "  wrapped"]
    assert all(column(spark, stack, logback)) and column(spark, ["caused by: x"], logback) == [True]
    assert all(column(spark, ["Traceback (most recent call last):", '  File "a.py", line 3, in f', "    x = 1", "ValueError: no"], python))
    assert all(column(spark, ["[stacktrace]", "#0 /a.php(1): f()", '"}', "  x"], php)) and all(column(spark, ["      message", "   at A.B()", "--- End of x"], net))


WORDS = ["ERROR", "warn", "[main]", "[ERROR]", "[core:error]", "a.b.C", "x", "production.INFO:", "(", "INFOx", "-", "[err or]", "FATAL", "  "]


def test_the_regular_level_is_the_segmenters(spark):
    """Lines without quotes and open brackets: the expression and the scanner agree."""
    rng = random.Random(3)
    fmt = BY_NAME["Plain timestamp"]
    lines = ["2026-10-01 09:14:02 " + "".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randrange(6))) for _ in range(3000)]
    lines = [x for x in lines if re.fullmatch(fmt.record, x)]
    seg = segment.Segmenter(fmt)
    got = column(spark, lines, lambda c: levels.record_level(c, fmt))
    bad = [(x, a, seg.level(x)) for x, a in zip(lines, got, strict=True) if a != seg.level(x)]
    assert not bad, bad[:5]


def test_segments():
    def kinds(name, line):
        return [(t, line[a:b]) for t, a, b in segment.Segmenter(BY_NAME.get(name)).spans(line) if t != "WS"]

    got = kinds("Logback / Log4j 2", "2026-10-01 09:14:02.101 [error-1] INFO  a.B - hello world")
    assert got == [("TIMESTAMP", "2026-10-01 09:14:02.101"), ("THREAD", "[error-1]"), ("LEVEL_INFO", "INFO"), ("LOGGER", "a.B"), ("MESSAGE", "-"), ("MESSAGE", "hello"), ("MESSAGE", "world")]
    assert kinds("PHP / Laravel (Monolog)", "[2026-10-01 09:14:02] production.ERROR: no")[:4] == [("TIMESTAMP", "[2026-10-01 09:14:02]"), ("LOGGER", "production."), ("LEVEL_ERROR", "ERROR"), ("MESSAGE", ":")]
    assert kinds("Apache error", "[Thu Oct 01 09:14:02.123456 2026] [core:error] [pid 1] x")[1] == ("LEVEL_ERROR", "[core:error]")
    assert kinds("java.util.logging", "SEVERE: lost it") == [("LEVEL_ERROR", "SEVERE"), ("MESSAGE", ": lost it")]
    assert kinds("Structured JSON", '{"level":"error","msg":"x"}') and all(k[0] == "LOGGER" or not k[0].startswith("LEVEL") for k in kinds("Structured JSON", '{"level":"error","msg":"x"}'))
    assert kinds(None, "a b") == [("GENERIC", "a b")] and segment.Segmenter(None).spans("") == []
    assert segment.Segmenter(BY_NAME["Plain timestamp"]).spans("2026-10-01 09:14:02 " + "x" * 70000) == [("GENERIC", 0, 70020)]


def test_spans_tile_every_line():
    rng = random.Random(9)
    for name, samples in SAMPLES.items():
        seg = segment.Segmenter(BY_NAME[name])
        for s in samples + ["  at x", "noise", '[a "b', '2026-10-01 09:14:02 "a [b" c] ERROR']:
            for _ in range(30):
                k = rng.randrange(len(s) + 1)
                line = s[:k] + rng.choice(["", f"{E}[31m", f"{E}[0m{E}[1m", E, '"', "["]) + s[k:]
                spans = seg.spans(line)
                assert [a for _, a, _ in spans] == [0, *[b for _, _, b in spans][:-1]] and spans[-1][2] == len(line) and all(a < b for _, a, b in spans), (name, line, spans)


def test_thirteen_formats():
    assert len(FORMATS) == 13 and len(BY_NAME) == 13


def odd_escapes():
    rng = random.Random(3)
    bits = [f"{E}[", "m", ";", ":", "38", "48", "5", "2", "1", "22", "0", "39", "103", "255", "300", "é", "x", "?", f"{E}]t\x07", f"{E}(", "31", " m", "4", "24", "7" * 12, f"{E}[38;2;", f"{E}[48:2::9:8:7m", f"{E}[1;31m", f"{E}[38;5;", "🙂"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    colours = ["".join(f"{E}[{';'.join(str(rng.choice([0, 1, 2, 3, 4, 5, 21, 22, 23, 24, 31, 38, 39, 45, 48, 49, 97, 107, ''])) for _ in range(rng.randint(0, 7)))}m{rng.choice(['', 'a', 'bc'])}" for _ in range(rng.choice([1, 5, 64, 65, 130]))) for _ in range(150)]
    return ["", E, "plain", "é" * 100, f"{E}[31m" * 300 + "x", *made, *colours]


def test_styles_in_expressions_equal_plain_ones(spark):
    odd = odd_escapes()
    df = spark.createDataFrame(list(enumerate(odd)), "i long, raw string")
    got = df.select("i", styles.line_runs(F.col("raw")).alias("runs"), styles.raw_offsets(F.col("raw")).alias("offsets"), styles.escaped_ranges(F.col("raw")).alias("ranges")).collect()
    for r in got:
        line = odd[r["i"]]
        assert [x.asDict(True) for x in r["runs"]] == ansi.ansi_runs(line), line
        assert r["offsets"] == ansi.strip_with_map(line)[1] and [tuple(x) for x in r["ranges"]] == ansi.escape_ranges(line), line
    assert "Python" not in styles.runs_of(df.selectExpr("'p' as path", "i as line_no", "raw"))._jdf.queryExecution().toString()


def test_many_escapes_in_one_line(spark):
    line = f"{E}[31ma{E}[0mb" * 20_000
    runs, offsets = spark.createDataFrame([(line,)], "raw string").select(styles.line_runs(F.col("raw")), styles.raw_offsets(F.col("raw"))).first()
    assert len(runs) == 20_000 and runs[-1]["end"] == len(line) - 5 and len(offsets) == 40_001
    assert spark.createDataFrame([(None,)], "raw string").select(styles.raw_offsets(F.col("raw")).alias("o")).first()["o"] is None
