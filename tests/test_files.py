"""Whole files: reading, detection, facts, folds, index, frames, status, tail."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidelog.functions.formats import BY_NAME, LogFormat
from tidelog.operators import carry, detect, facts, frames, index, status
from tidelog.sources import corpora, reader
from tidelog.streaming import tail

R = "2026-10-01 09:14:02.101 [main] {} a.B - {}"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_detection(log):
    v = {r["path"]: r for r in detect.detect(log({
        "tie": R.format("INFO", "x") + "\n" + R.format("WARN", "y"), "below": "2026-10-01 09:14:02 INFO a\nx\ny\nz", "half": R.format("INFO", "x") + "\nnoise", "indented": "  a\n  b",
        "stack": R.format("ERROR", "x") + "\njava.lang.IllegalStateException: x\n\tat a.B.c(D.java:1)\n\nCaused by: y", "crlf": "Oct 1, 2026 9:14:02 AM a.B run\r\nSEVERE: x\r\n",
        "colour": "2026-10-01 09:14:02 \x1b[31mERROR\x1b[0m x\n\x1b[0m\n2026-10-01 09:14:03 INFO y", "nginx": "2026/10/01 09:14:02 [error] 12#3: *1 x", "empty": "", "blank": " \n\t",
    })).collect()}
    assert v["tie"]["format"] == "Logback / Log4j 2" and v["tie"]["percent_text"] == "100.0%"
    assert (v["below"]["outcome"], v["below"]["closest"], v["below"]["closest_text"]) == ("no_match", "Logback / Log4j 2", "25.0%")
    assert v["half"]["outcome"] == "matched" and v["half"]["percent_text"] == "50.0%"
    assert v["indented"]["outcome"] == "no_match" and v["indented"]["closest"] is None
    assert (v["stack"]["matched"], v["stack"]["scanned"]) == (4, 4) and v["crlf"]["format"] == "java.util.logging"
    assert (v["colour"]["format"], v["colour"]["scanned"], v["colour"]["ansi_lines"]) == ("Logback / Log4j 2", 2, 1)
    assert v["nginx"]["format"] == "nginx error"
    assert "empty" not in v and v["blank"]["scanned"] == 0 and v["blank"]["outcome"] == "no_match"


def test_percentages(spark):
    df = spark.createDataFrame([(1999999, 2000000), (5, 5), (1204, 1208), (0, 3), (1, 3)], "m long, s long").select(detect.percent_text(F.col("m"), F.col("s")).alias("p"))
    assert [r["p"] for r in df.collect()] == ["99.9%", "100.0%", "99.7%", "0.0%", "33.3%"]


def test_own_formats_and_unmatched(log):
    mine = (LogFormat("mine", 5, r"#\d+ .*"),)
    l = log({"a": "#1 x\nno\n#2 y"})
    v = detect.detect(l, mine)
    assert one(v)["format"] == "mine" and [r["text"] for r in detect.unmatched(l, v, formats=mine).collect()] == ["no"]
    assert one(detect.named_stats(l, mine[0]))["matched"] == 2


def test_facts_and_pull_up(log):
    l = log({"jul": "Oct 1, 2026 9:14:02 AM a.B run\nSEVERE: x\n\tat a.B.c(D.java:1)\nOct 1, 2026 9:14:02 AM a.B run\n\nINFO: late", "lb": R.format("INFO", "[error-reporter] x") + "\n\tat a.Logger.error(D.java:1)\n" + R.format("ERROR", "y"), "q": '2026-10-01 09:14:02 "say" ERROR\n2026-10-01 09:14:02 x', "json": '{"level":"error","msg":"x"}'})
    f = {(r["path"], r["line_no"]): (r["is_record"], r["level"]) for r in facts.line_facts(l, detect.detect(l)).collect()}
    assert f["jul", 0] == (True, "ERROR") and f["jul", 1] == (False, None) and f["jul", 3] == (True, None)
    assert f["lb", 0] == (True, "INFO") and f["lb", 1] == (False, None) and f["lb", 2] == (True, "ERROR")
    assert f["q", 0] == (True, "ERROR") and f["json", 0] == (True, None)


def marks(spark, text):
    """'E' an ERROR record, 'I' an INFO record, '-' a record without level, '.' no record."""
    rows = [("p", i, c, c != ".", {"E": "ERROR", "I": "INFO"}.get(c)) for i, c in enumerate(text)]
    return spark.createDataFrame(rows, "path string, line_no long, raw string, is_record boolean, level string")


def test_folds(spark):
    runs = lambda t, **k: [(r["first_line"], r["last_line"]) for r in facts.fold_runs(marks(spark, t), **k).orderBy("first_line").collect()]
    assert runs("E..I...E..", levels={"ERROR"}) == [(3, 6)]
    assert runs("E..I...E..", text="zzz") == [(0, 9)]
    assert runs("..I.E", levels={"ERROR"}) == [(2, 3)]
    assert runs("EI-", levels={"ERROR"}) == [(1, 1)] and runs("EIE") == []
    assert one(facts.hidden_counts(marks(spark, "EIIE"), {"ERROR"}))["note"] == "filter hides 2 of 4 lines"


def test_folds_agree_with_a_loop(spark):
    rng = random.Random(2)
    for t in ("".join(rng.choice("EI-.") for _ in range(rng.randrange(1, 30))) for _ in range(12)):
        hidden, out = False, []
        for c in t:
            hidden = c == "I" if c != "." else hidden
            out.append(hidden)
        got = [r["is_hidden"] for r in facts.hidden(marks(spark, t), {"ERROR"}).orderBy("line_no").collect()]
        assert got == out, t


def test_error_walk(spark):
    f = marks(spark, ".E..IE...")
    ahead = {r["line_no"]: r["target"] for r in facts.error_walk(f).collect()}
    back = {r["line_no"]: r["target"] for r in facts.error_walk(f, forward=False).collect()}
    assert (ahead[1], ahead[5], ahead[8], back[0], back[5]) == (5, 1, 1, 5, 1)
    assert one(facts.next_error(f, 5))["target"] == 1 and one(facts.next_error(f, 0, forward=False))["target"] == 5
    assert {r["target"] for r in facts.error_walk(marks(spark, ".E.")).collect()} == {1}
    assert {r["target"] for r in facts.error_walk(marks(spark, ".I.")).collect()} == {None}


def test_encoding(spark):
    e = facts.encoded(marks(spark, "E-.I"))
    assert [r["fact"] for r in e.orderBy("line_no").collect()] == [132, 128, 0, 130]
    assert [tuple(r["x"]) for r in e.orderBy("line_no").select(facts.decoded(F.col("fact")).alias("x")).collect()] == [(True, "ERROR", True), (True, None, False), (False, None, False), (True, "INFO", False)]


def test_appended_facts_equal_a_full_scan(log):
    text = "\n".join(["Oct 1, 2026 9:14:02 AM a.B run", "SEVERE: x"] * 4 + ["Oct 1, 2026 9:14:02 AM a.B run"])
    l = log({"a": text})
    v = detect.detect(l)
    full = sorted(map(tuple, facts.line_facts(l, v).collect()), key=str)
    for cut in (1, 2, 3, 8):
        before = facts.line_facts(l.where(F.col("line_no") < cut), v)
        assert sorted(map(tuple, facts.appended(before, l, v).collect()), key=str) == full


def test_document_lines_and_offsets(log):
    n = lambda t: log({"a": t}, final_empty=True).count()
    assert [n(t) for t in ("", "a", "a\n", "a\nb", "a\n\n", "a\n\n\nb")] == [1, 1, 2, 2, 3, 4]
    s = index.line_starts(log({"a": "abc\nde\nf"}, final_empty=True))
    assert [r["start_offset"] for r in s.orderBy("line_no").collect()] == [0, 4, 7]
    probes = s.sparkSession.createDataFrame([("a", i) for i in range(-1, 12)], "path string, offset long")
    assert [r["line_no"] for r in index.line_of(probes, s).orderBy("offset").collect()] == [0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 2]
    wanted = s.sparkSession.createDataFrame([("a", 1), ("a", 9)], "path string, line_no long")
    assert [r["start_offset"] for r in index.start_of(wanted, s).orderBy("line_no").collect()] == [4, 8]
    assert one(index.capped(index.line_starts(log({"a": "a\nb\nc\nd\ne"}, final_empty=True)), 3))["capped"]


def test_blocks_do_not_change_offsets(spark):
    l = corpora.big_log(spark, 3000)
    a, b = (sorted(map(tuple, index.line_starts(l, block=k).collect())) for k in (65_536, 64))
    assert a == b and [r[1] for r in a] == list(range(len(a)))


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbfone\r\ntwo\n")
    (tmp_path / "B.OUT").write_bytes("x é\ny".encode("utf-16"))
    (tmp_path / "c.log").write_bytes(b"\x7fELF\0\0")
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / "log").write_text("no")
    (tmp_path / "big.log").write_text("z" * 5000)
    f = {os.path.basename(r["path"]): r["outcome"] for r in reader.files(spark, str(tmp_path), max_size=4000).collect()}
    assert f == {"a.log": "ok", "B.OUT": "ok", "c.log": "binary", "notes.txt": "not_a_log", "log": "not_a_log", "big.log": "too_large"}
    t = {os.path.basename(r["path"]): r["text"] for r in reader.read_documents(spark, str(tmp_path)).collect()}
    assert t["a.log"] == "one\ntwo\n" and t["B.OUT"] == "x é\ny"


def test_numbers_of_split_files(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"f{k}.log").write_text("".join(f"{i}\r\n" if i % 5 else f"{i}\n" for i in range(4000 + k)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = reader.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 8001 and all(r["line_no"] == int(r["raw"].rstrip("\r")) for r in got)


def test_caps(log):
    def scan(text, lines, size):
        rows = reader.bounded(log({"a": text}), lines, size).orderBy("line_no").collect()
        return len(rows), [(r["has_more_lines"], r["hit_bytes"]) for r in rows][:1]

    assert scan("a\n" * 200, 200, 10**6) == (200, [(False, False)]) and scan("a\n" * 201, 200, 10**6) == (200, [(True, False)])
    assert scan("aaaa\nbbbb\ncccc\ndddd", 100, 17) == (3, [(False, True)]) and scan("aaaa\nbbbb", 100, 9) == (2, [(False, False)])
    assert reader.byte_text(512 * 1024) == "512 KB" and reader.byte_text(256 * 1024**2) == "256 MB" and reader.byte_text(2 * 1024**3) == "2 GB" and reader.byte_text(100) == "100-byte"


def test_frames(log, spark):
    text = '\tat com.example.shop.Cart.total(Cart.java:42)\n  File "src/app.py", line 10, in handler\n#0 /var/www/app/Kernel.php(42): x\n  at f (/app/src/index.js:3:7)\nC:\\src\\App.cs:5\nnone here:9\nsee a.ts:1 and b.ts:2'
    rows = frames.frames(log({"/logs/a.log": text})).orderBy("line_no", "start").collect()
    got = [(r["line_no"], r["frame_path"], r["frame_line"], r["frame_col"], r["package_dir"]) for r in rows]
    assert got == [(0, "Cart.java", 42, 0, "com/example/shop"), (1, "src/app.py", 10, 0, None), (2, "/var/www/app/Kernel.php", 42, 0, None), (3, "/app/src/index.js", 3, 6, None), (4, "C:\\src\\App.cs", 5, 0, None), (6, "a.ts", 1, 0, None), (6, "b.ts", 2, 0, None)]
    lines = text.split("\n")
    assert all(lines[r["line_no"]][r["start"] :].startswith(r["frame_path"]) for r in rows)
    at = frames.frame_at(frames.frames(log({"/logs/a.log": "see a.ts:1 and b.ts:2"})), 16).collect()
    assert [r["frame_path"] for r in at] == ["b.ts"]


def test_frame_resolution(log, spark):
    catalog = spark.createDataFrame([(x,) for x in ("/w/src/Thing.kt", "/w/build/Only.java", "/w/a/com/x/Cart.java", "/w/Cart.java", "/app/index.js", "/w/logs/local.py")], "file_path string")
    l = log({"/w/logs/a.log": "see ../src/Thing.kt:1\nat com.x.Cart.f(Cart.java:2)\nx (Cart.java:2)\n(/app/index.js:3)\nx Only.java:4\nsee ./local.py:5\nsee nope/gone.py:6"})
    got = {r["line_no"]: (r["file_path"], r["how"]) for r in frames.resolve(frames.frames(l), catalog).collect()}
    assert got[0] == ("/w/src/Thing.kt", "relative") and got[1] == ("/w/a/com/x/Cart.java", "name") and got[2] == ("/w/Cart.java", "name")
    assert got[3] == ("/app/index.js", "absolute") and got[4] == ("/w/build/Only.java", "name") and got[5] == ("/w/logs/local.py", "relative") and got[6] == (None, None)


def test_status(log):
    v = detect.detect(log({"a": "\n".join([R.format("INFO", "x")] * 1204 + ["noise"] * 4), "b": "noise\n\x1b[31mred"}))
    s = {r["path"]: r for r in status.status(v, notes=[status.line_note(F.lit(1208), F.lit(False))]).collect()}
    assert s["a"]["status_text"] == "Format: Logback / Log4j 2 — matched 1,204 / 1,208 lines (99.7%) — 1,208 lines" and not s["a"]["warning"]
    assert s["b"]["status_text"] == "Format: no format matched 2 lines — showing ANSI colours only — 1,208 lines" and s["b"]["warning"]


def test_tail_counts(log):
    head, rest = log({"a": "\n".join([R.format("INFO", "x")] * 10)}), log({"a": "\n".join([R.format("INFO", "x")] * 3 + ["noise"])})
    v = detect.detect(head)
    r = one(tail.merged(tail.counts(head, v), tail.counts(rest, v)))
    assert (r["matched"], r["scanned"]) == (13, 14)


def test_growth():
    before = {"seen": 18, "marked": 4, "mark": __import__("hashlib").sha256(b"abcd").hexdigest()}
    assert [tail.growth(*x) for x in ((None, 3, b"a"), (before, 18, b"abcdX"), (before, 29, b"abcdX"), (before, 10, b"abcdX"), (before, 29, b"xbcdX"))] == ["new", "same", "appended", "rewritten", "rewritten"]


def test_tail_stream(spark, tmp_path, log):
    spark.dataSource.register(tail.TailSource)
    logs, store = tmp_path / "logs", str(tmp_path / "facts")
    logs.mkdir()
    path = logs / "a.log"
    path.write_text(R.format("INFO", "1") + "\n" + R.format("ERROR", "2"))
    v = spark.createDataFrame([(str(path), "matched", "Logback / Log4j 2")], "path string, outcome string, format string")
    stream = tail.lines_of(spark.readStream.format("tail").load(str(logs)))
    q = stream.writeStream.foreachBatch(tail.facts_batch(store, v)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    def settled(n):
        end = time.time() + 60
        while time.time() < end:
            try:
                rows = tail.latest_facts(spark, store).orderBy("line_no").collect()
                if len(rows) >= n:
                    return [(r["line_no"], r["level"]) for r in rows]
            except Exception:
                pass
            time.sleep(0.3)
        raise AssertionError("no rows")

    try:
        assert settled(1) == [(0, "INFO")]  # the unfinished line waits
        with path.open("a") as f:
            f.write(" more\n\tat a.B.c(D.java:1)\n" + R.format("WARN", "3") + "\n")
        assert settled(4) == [(0, "INFO"), (1, "ERROR"), (2, None), (3, "WARN")]
    finally:
        q.stop()


def test_chunks_hold_whole_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 64)
    for k, (charset, mark) in enumerate((("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"))):
        folder = tmp_path / str(k)
        folder.mkdir()
        text = "".join(f"line é {i} " + "x" * (i * 37 % 200) + "\n" for i in range(60))
        path = folder / "a.log"
        path.write_bytes(mark + (text + "open").encode(charset))
        reader_, offset, rows = tail._Reader(str(folder), 500), {}, []
        for _ in range(60):
            chunks, after = reader_.read(offset)
            chunks = list(chunks)
            assert list(reader_.readBetweenOffsets(offset, after))[-1:] == chunks[-1:]
            rows += chunks
            if after == offset:
                break
            offset = after
        raw = path.read_bytes()
        got = [x for c in rows for x in raw[c[3] : c[4]].decode(charset).split("\n")[:-1]]
        assert got == text.split("\n")[:-1] and [c[2] for c in rows] == [sum(raw[d[3] : d[4]].decode(charset).count("\n") for d in rows[:i]) for i in range(len(rows))]


def test_lines_by_charset_and_heads(spark, tmp_path):
    text = "one é\ntwo " + "y" * 70_000 + "\nthree"
    (tmp_path / "u8.log").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "le.log").write_bytes(text.encode("utf-16"))
    (tmp_path / "be.log").write_bytes(b"\xfe\xff" + text.encode("utf-16-be"))
    (tmp_path / "l1.log").write_bytes("caf\xe9".encode("latin-1"))
    by: dict = {}
    for r in reader.read_lines(spark, str(tmp_path), fallback="ISO-8859-1").orderBy("line_no").collect():
        by.setdefault(os.path.basename(r["path"]), []).append(r["raw"])
    assert by == {"u8.log": text.split("\n"), "le.log": text.split("\n"), "be.log": text.split("\n"), "l1.log": ["caf\xe9"]}
    heads = {os.path.basename(r["path"]): r for r in reader.read_heads(spark, str(tmp_path / "u8.log"), 9, 40).collect()}
    assert (heads["u8.log"]["raw"], heads["u8.log"]["hit_bytes"], heads["u8.log"]["has_more_lines"]) == ("one é", True, False)
    assert [r["has_more_lines"] for r in reader.read_heads(spark, str(tmp_path / "le.log"), 2, 10**7).collect()] == [True, True]


def test_long_lines_stay_whole(log):
    l = log({"a": "2026-10-01 09:14:02 INFO x\n2026-10-01 09:14:02 INFO " + "x" * 70_000 + " needle\nlast"})
    assert [r["start_offset"] for r in index.line_starts(l).orderBy("line_no").collect()][2] == 27 + 70_033
    assert one(detect.detect(l))["matched"] == 2 and l.where(F.contains("raw", F.lit("needle"))).count() == 1


def test_blocks_agree_with_one_window(spark):
    rng = random.Random(5)
    f = marks(spark, "".join(rng.choice("EI-.....") for _ in range(300))).unionByName(marks(spark, "".join(rng.choice("I.") for _ in range(97))).withColumn("path", F.lit("q")))
    rows = lambda df: sorted(map(str, df.collect()))
    for block in (1, 7, 64):
        assert rows(facts.hidden(f, {"ERROR"}, block=block)) == rows(facts.hidden(f, {"ERROR"}))
        assert rows(facts.fold_runs(f, {"ERROR"}, block=block)) == rows(facts.fold_runs(f, {"ERROR"}))
        assert rows(facts.record_ids(f, block)) == rows(facts.record_ids(f))
        for forward in (True, False):
            assert rows(facts.error_walk(f, forward, block)) == rows(facts.error_walk(f, forward))
        assert rows(carry.with_next(f, block, _n=F.col("raw"))) == rows(carry.with_next(f, _n=F.col("raw")))
        assert rows(reader.bounded(f, 50, 90, block=block)) == rows(reader.bounded(f, 50, 90))
    s = index.line_starts(f)
    probes = spark.range(-3, 900, 7).select(F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("path"), F.col("id").alias("offset"))
    assert rows(index.line_of(probes, s, 16)) == rows(index.line_of(probes, s))


def test_many_files_without_broadcast(log, monkeypatch):
    monkeypatch.setattr(facts, "FEW_FILES", 1)
    l = log({f"f{k}": R.format("INFO", "x") + "\nmore\n" + R.format("ERROR", "y") for k in range(4)})
    f = facts.line_facts(l, detect.detect(l))
    assert sorted(r["level"] for r in f.where("is_record").collect()) == ["ERROR"] * 4 + ["INFO"] * 4 and f.count() == 12


def test_index_grows(log):
    text = "one\ntwo\n\nfour\n" * 5
    l = log({"a": text})
    head = index.line_starts(l.where("line_no < 7"))
    more = index.extended(index.totals(head), l.where("line_no >= 7"))
    whole = {r["line_no"]: r["start_offset"] for r in index.line_starts(l).collect()}
    assert {r["line_no"]: r["start_offset"] for r in more.collect()} == {k: v for k, v in whole.items() if k >= 7}


def test_notes_of_files_not_followed(spark):
    f = spark.createDataFrame([("a", False, None), ("b", True, None), ("c", None, "too_large"), ("d", None, "failed")], "path string, capped boolean, outcome string")
    assert [(r["follows"], r["note"] is not None) for r in tail.followable(f).orderBy("path").collect()] == [(True, False), (False, True), (False, True), (False, True)]


def test_format_names():
    assert BY_NAME["Plain timestamp"].priority == 10


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_lines_are_dealt_once(spark, log):
    f = log({"a": "x\ny\nz\n" * 20, "b": "one\ntwo"}).select("path", "line_no", "raw", (F.col("line_no") % 3 == 0).alias("is_record"), F.lit("INFO").alias("level"))
    for df in (index.line_starts(f, block=8), facts.fold_runs(f, {"ERROR"}, block=8), facts.hidden_counts(f, {"ERROR"}, "x")):
        assert "ReusedExchange" in final_plan(df) or "ReusedQueryStage" in final_plan(df)


def test_default_filter_folds_nothing_and_reads_no_window(spark, log):
    f = log({"a": "x\ny\nz"}).select("path", "line_no", "raw", F.lit(True).alias("is_record"), F.lit("INFO").alias("level"))
    folds = facts.fold_runs(f)
    assert folds.collect() == [] and folds.columns == ["path", "first_line", "last_line", "line_count"]
    assert "Window" not in final_plan(folds)
    counts = facts.hidden_counts(f, text="  ")
    assert [(r["n_hidden"], r["n_lines"]) for r in counts.collect()] == [(0, 3)] and "Window" not in final_plan(counts)


def test_repeated_and_null_frames(spark):
    rows = [("/logs/a.log", k, 0, "run.py", 1, None) for k in range(3)] + [("/logs/a.log", 3, 0, None, 1, None), (None, 4, 0, "/srv/x.js", 1, None), (None, 5, 0, "sub/run.py", 1, None)]
    found = spark.createDataFrame(rows, "path string, line_no long, start int, frame_path string, frame_line long, package_dir string")
    catalog = spark.createDataFrame([("/logs/run.py",), ("/srv/x.js",), ("/srv/x.js",), ("/a/build/run.py",)], "file_path string")
    got = {r["line_no"]: (r["file_path"], r["how"]) for r in frames.resolve(found, catalog).collect()}
    assert got == {0: ("/logs/run.py", "name"), 1: ("/logs/run.py", "name"), 2: ("/logs/run.py", "name"), 3: (None, None), 4: ("/srv/x.js", "absolute"), 5: ("/logs/run.py", "name")}
    assert frames.resolve(found.limit(0), catalog.limit(0)).count() == 0


def test_walks_check_folders(log, spark):
    files = ["/p/app/lib/x.py", "/p/lib/y.py", "/z.py", "/p/app/a.py/b.py"]
    wanted = {
        "lib/x.py": "/p/app/lib/x.py", "nodir/../lib/x.py": None, "lib/../lib/x.py": "/p/app/lib/x.py", "lib/x.py/../x.py": None, "../lib/y.py": "/p/lib/y.py", "../../z.py": "/z.py",
        "../../../../z.py": None, "logs/../lib/x.py": None, "./lib//x.py": "/p/app/lib/x.py", "lib/x.py/.": None, "a.py/b.py": "/p/app/a.py/b.py", "lib/../../lib/../app/lib/x.py": "/p/app/lib/x.py", "app/../lib/y.py": "/p/lib/y.py",
    }
    rows = [("/p/app/run.log", i, w, None) for i, w in enumerate(wanted)]
    found = spark.createDataFrame(rows, "path string, line_no long, frame_path string, package_dir string")
    catalog = spark.createDataFrame([(f,) for f in files], "file_path string")
    stored = frames.directories(catalog).union(frames.directories(found.select(F.col("path").alias("file_path"))))
    for folders in (None, stored.distinct()):
        got = {r["frame_path"]: r["file_path"] if r["how"] == "relative" else None for r in frames.resolve(found, catalog, folders).collect()}
        assert got == wanted


def test_numbers_that_no_long_holds(log):
    from tidelog.functions import ansi, styles

    found = frames.frames(log({"/a.log": f"x (Main.java:{'9' * 40}:{'8' * 50})\nx (Main.java:7:{'0' * 30}3)"})).orderBy("line_no").collect()
    assert [(r["frame_line"], r["frame_col"]) for r in found] == [(None, 0), (7, 2)]
    huge = "7" * 5000
    for line in (f"\x1b[{huge}mx", f"\x1b[38;5;{huge}mx", f"\x1b[38;{huge};1mx", f"\x1b[1;{huge}mx", f"\x1b[38;2;{huge};1;2mx"):
        got = log({"/a.log": line}).select(styles.line_runs(F.col("raw"))).first()[0]
        assert [r.asDict(True) for r in got] == ansi.ansi_runs(line)
    assert ansi.ansi_runs(f"\x1b[1;{huge}mx")[0]["style"]["bold"]


def _store_model(steps):
    """What is there after batches of (path, generation, lines from line_no 0 on)."""
    now = {}
    for batch in steps:
        for path, generation, first, texts in batch:
            have = now.get(path)
            if have is None or have[0] < generation:
                have = now[path] = [generation, {}]
            if have[0] == generation:
                have[1].update({first + k: t for k, t in enumerate(texts)})
    return sorted((p, n, t) for p, (_, lines) in now.items() for n, t in lines.items())


def test_facts_follow_generations(spark, log, tmp_path):
    info, jul = "2026-01-02 03:04:05,006 [main] INFO a.B - x", "Jan 2, 2026 3:04:05 AM a.B run"
    v = detect.detect(log({"/a.log": "\n".join([info] * 3), "/j.log": "\n".join([jul, "SEVERE: bad"] * 3)}))
    run, steps = tail.facts_batch(str(tmp_path / "s"), v), [
        [("/a.log", 0, 0, [info, "  more", info, "x", info]), ("/j.log", 0, 0, [jul])],
        [("/j.log", 0, 1, ["SEVERE: late", jul])],
        [("/a.log", 1, 0, [info, "short"])],  # five lines become two
        [("/a.log", 1, 2, ["y"]), ("/j.log", 0, 3, ["WARNING: w"])],
        [("/j.log", 1, 0, [jul]), ("/j.log", 2, 0, ["only"])],  # twice rewritten within a batch
    ]
    for n, batch in enumerate(steps):
        rows = [(p, g, first + k, t) for p, g, first, texts in batch for k, t in enumerate(texts)]
        run(spark.createDataFrame(rows, tail.TAIL_SCHEMA), n)
        if n in (1, 3):
            run(spark.createDataFrame(rows, tail.TAIL_SCHEMA), n)  # again, after a failure
        got = sorted((r["path"], r["line_no"], r["raw"]) for r in tail.latest_facts(spark, str(tmp_path / "s")).collect())
        assert got == _store_model(steps[: n + 1]), n
        if n == 1:
            level = {r["line_no"]: r["level"] for r in tail.latest_facts(spark, str(tmp_path / "s")).where("path = '/j.log'").collect()}
            assert level[0] == "ERROR"  # from the line that a later batch brought
        if n == 2:
            assert tail.compact(spark, str(tmp_path / "s")) == 2
    assert tail.compact(spark, str(tmp_path / "s")) == 4
    assert sorted((r["path"], r["line_no"], r["raw"]) for r in tail.latest_facts(spark, str(tmp_path / "s")).collect()) == _store_model(steps)


def test_a_batch_reads_only_the_version_before_it(spark, log, tmp_path):
    v = detect.detect(log({"/a.log": "2026-01-02 03:04:05,006 [main] INFO a.B - x"}))
    run = tail.facts_batch(str(tmp_path / "s"), v)
    for n in range(4):
        run(spark.createDataFrame([("/a.log", 0, n, f"line {n}")], tail.TAIL_SCHEMA), n)
        if n > 1:  # what is older than the version before is not needed
            import shutil

            shutil.rmtree(tmp_path / "s" / "ends" / f"version={n - 2}")
    assert [r["line_no"] for r in tail.latest_facts(spark, str(tmp_path / "s")).orderBy("line_no").collect()] == [0, 1, 2, 3]


def _capped_model(data, max_lines, max_bytes):
    cut, data = len(data) > max_bytes, data[:max_bytes]
    mark, charset = next(((m, c) for m, c in reader._MARKS if data.startswith(m)), (b"", "utf-8"))
    lines = data[len(mark) :].decode(charset, "replace").split("\n")
    if cut or lines[-1] == "":
        lines.pop()
    more = len(lines) > max_lines
    return lines[:max_lines], more, cut and not more


@pytest.mark.parametrize("step", [3, 7, 64, 1 << 20])
def test_capped_reading_agrees_with_a_model(tmp_path, monkeypatch, step):
    monkeypatch.setattr(reader, "_STEP", step)
    rng, path = random.Random(step), tmp_path / "a.log"
    for k in range(150):
        text = "".join(rng.choice(["\n", "a", "é", "😀", "\r\n", "bc"]) for _ in range(rng.randrange(0, 60)))
        mark, charset = rng.choice([(b"", "utf-8"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]) if step > 3 else (b"", "utf-8")
        path.write_bytes(mark + text.encode(charset))
        most, size = rng.randrange(1, 12), rng.choice([4, 20, 21, 40, 1000])
        steps = list(reader._capped_lines(str(path), most, size, "utf-8"))
        got = [x for s in steps for x in s[1]]
        assert [s[0] for s in steps if s[1]] == [sum(len(x[1]) for x in steps[:i]) for i, s in enumerate(steps) if s[1]]
        assert (got, steps[-1][2], steps[-1][3]) == _capped_model(mark + text.encode(charset), most, size), (text, most, size)


def test_two_phases_over_files(spark, tmp_path):
    good = R.format("INFO", "x")
    (tmp_path / "in").mkdir()
    for name, body in {
        "short.log": f"{good}\n{good}", "turns.log": "noise\n" * 4 + f"{good}\n" * 40, "bin.out": "\0\1\n", "lost.log": f"{good}\n" * 30, "z.txt": good, "none.log": "", "wide.log": None,
    }.items():
        (tmp_path / "in" / name).write_bytes(b"\xff\xfe" + f"{good}\n{good}\n".encode("utf-16-le") if body is None else body.encode())
    again = []

    def refine(paths):
        again.extend(sorted(r["path"].rsplit("/", 1)[1] for r in paths.collect()))
        (tmp_path / "in" / "lost.log").unlink()
        return reader.capped(paths, 1000, 1 << 20)

    heads = reader.capped(reader._listed(spark, str(tmp_path / "in")).select("path").union(spark.createDataFrame([(str(tmp_path / "in" / "none.log"),)], "path string")), 4, 1 << 20)
    got = {r["path"].rsplit("/", 1)[1]: (r["outcome"], r["scanned"], r["complete"], r["phase"], r["reason"]) for r in detect.two_phase(heads, refine).collect()}
    assert again == ["lost.log", "turns.log"]  # only what the first look did not finish
    assert got == {
        "short.log": ("matched", 2, True, "head", None), "turns.log": ("matched", 44, True, "refined", None), "bin.out": ("failed", None, True, "head", "binary"),
        "lost.log": ("matched", 4, False, "head", None), "none.log": ("no_match", 0, True, "head", None), "wide.log": ("matched", 2, True, "head", None),
    }
    whole = {r["path"].rsplit("/", 1)[1]: (r["outcome"], r["phase"]) for r in reader.detect_files(spark, str(tmp_path / "in"), (4, 1 << 20)).collect()}
    assert whole == {"short.log": ("matched", "head"), "turns.log": ("matched", "refined"), "bin.out": ("failed", "head"), "wide.log": ("matched", "head")}
    # the scalable reader selects the same files
    assert {r["path"].rsplit("/", 1)[1] for r in reader.read_lines(spark, str(tmp_path / "in")).select("path").distinct().collect()} == {"short.log", "turns.log", "wide.log"}
