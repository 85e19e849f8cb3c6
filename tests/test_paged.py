"""Pages through a stored index, formats out of tables, and the index of growing files."""

import os
import random

import pytest

from tidelog.functions.formats import LogFormat, from_table
from tidelog.operators import detect, facts, index
from tidelog.sources import paged, reader
from tidelog.streaming import tail


def test_ranges_agree_with_whole_reading(spark, tmp_path):
    rng, logs = random.Random(4), tmp_path / "logs"
    logs.mkdir()
    text = lambda n: "".join(rng.choice(["\n", "a", "é", "😀", "line\r\n", "x" * 40, "\n"]) for _ in range(n))
    files = {"a.log": text(400).encode(), "b.log": text(300).encode() + b"\nno end", "c.OUT": b"\xef\xbb\xbf" + text(90).encode(), "d.log": b"\xff\xfe" + text(200).encode("utf-16-le"), "e.log": b"\xfe\xff" + text(90).encode("utf-16-be"), "empty.log": b"", "one.log": b"x" * 1000, "z.txt": b"a\nb\n"}
    for name, data in files.items():
        (logs / name).write_bytes(data)
    for every, block in ((3, 32), (7, 64), (1, 4096)):
        entries = paged.build(spark, f"file://{logs}", f"file://{tmp_path}/index-{every}", every, block).persist()
        want = {(r["path"], r["line_no"]): r["raw"] for r in reader.read_lines(spark, f"file://{logs}").collect()}
        paths = sorted({p for p, _ in want})
        assert len(paths) == 6 and not entries.where("path like '%z.txt'").count()
        wanted = [(p, a, a + rng.randrange(-1, 25)) for p in paths for a in (0, 1, every, 10, 50, 91, 10**6)] + [(paths[0], 5, 9)] * 2 + [(paths[0], -3, 2), ("file:///none.log", 0, 5)]
        df = spark.createDataFrame(wanted, "path string, first_line long, last_line long")
        got = sorted((r["path"], r["line_no"], r["raw"]) for r in paged.read_ranges(entries, df, every).distinct().collect())
        assert got == sorted((p, n, t) for (p, n), t in want.items() if any(p == q and a <= n <= b for q, a, b in wanted))
        # a range meets few entries, whatever the length of the file
        for r in paged.ranges(entries, df, every).where("to_byte is not null").collect():
            assert r["line_no"] <= r["first_line"] < r["line_no"] + every


def test_long_ranges_go_by_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "PIECE", 10)
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(95)))
    entries = paged.build(spark, f"file://{tmp_path}/a.log", f"file://{tmp_path}/index", 4, 64)
    df = spark.createDataFrame([(entries.first()["path"], 3, 500)], "path string, first_line long, last_line long")
    assert paged.ranges(entries, df, 4).count() >= 10
    assert sorted(r["line_no"] for r in paged.read_ranges(entries, df, 4).collect()) == list(range(3, 95))


def test_a_page_reads_its_own_bytes(spark, tmp_path):
    path = tmp_path / "big.log"
    with path.open("w") as f:
        for i in range(400_000):
            f.write(f"2024-01-01 00:00:00 INFO line {i} of a file that no page reads as a whole\n")
    paged.build(spark, f"file://{path}", f"file://{tmp_path}/index")
    name = paged.stored(spark, f"file://{tmp_path}/index").first()["path"]
    got = paged.page(spark, f"file://{tmp_path}/index", name, 1000)
    assert [r["line_no"] for r in got.orderBy("line_no").collect()] == list(range(256_000, 256_256))
    wanted = spark.createDataFrame([(name, 256_000, 256_255)], "path string, first_line long, last_line long")
    (r,) = paged.ranges(paged.stored(spark, f"file://{tmp_path}/index"), wanted).collect()
    assert r["to_byte"] - r["from_byte"] < 100_000 < os.path.getsize(path) / 100
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "EqualTo(path," in plan and "GreaterThan(line_no," in plan


ROWS = "name string, place int, priority int, record string, continuation string, timestamp string, ignore_case boolean"


def test_formats_from_a_table(spark, log):
    rows = [
        ("two", 2, 5, r"two .*", r"\s+.*", None, True), ("one", 1, 5, r"one .*", None, None, None), ("one", 3, 5, "later", None, None, None), ("bad", 4, 5, "(", None, None, None), ("worse", 5, 5, "a", "[", None, None),
        ("none", 6, 5, None, None, None, None), (None, 7, 5, "x", None, None, None), ("nowhere", None, 5, "x", None, None, None), ("asked", 8, 5, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, ROWS)
    own, refused = from_table(table, {"asked": lambda s: s.str.len() == 4})
    assert [f.name for f in own] == ["one", "two", "asked"] and own[1].ignore_case
    assert sorted((r["name"] or "", r["reason"]) for r in refused.collect()) == [("", "no name or place"), ("bad", "record does not compile"), ("none", "no pattern"), ("nowhere", "no name or place"), ("one", "name repeats"), ("worse", "continuation does not compile")]
    lines = log({"/a": "one 1\none 2\nx\n", "/b": "two 1\n  more\n\n", "/c": "abcd\nefgh\nlonger\n", "/d": "nothing\n"})
    got = {r["path"]: (r["outcome"], r["format"], r["matched"], r["scanned"]) for r in detect.detect(lines, own).collect()}
    assert got == {"/a": ("matched", "one", 2, 3), "/b": ("matched", "two", 2, 2), "/c": ("matched", "asked", 2, 3), "/d": ("no_match", None, None, 1)}
    f = facts.line_facts(lines, detect.detect(lines, own), own)
    assert [r["is_record"] for r in f.where("path = '/c'").orderBy("line_no").collect()] == [True, True, False]
    assert [r["is_record"] for r in f.where("path = '/b'").orderBy("line_no").collect()] == [True, False, False]
    with pytest.raises(ValueError):
        from_table(table, most=3)
    assert from_table(table.limit(0))[0] == ()


def test_predicates_see_undecided_lines_alone(spark, log):
    def ask(s):
        assert not s.str.startswith("sure").any() and s.notna().all() and (s.str.strip() != "").all()
        return s.str.startswith("maybe")

    rule = LogFormat("rule", 1, r"sure.*", predicate=ask)
    lines = log({"/a": "sure 1\nmaybe 2\n\n\nno\n"})
    (v,) = detect.detect(lines, (rule,)).collect()
    assert (v["format"], v["matched"], v["scanned"]) == ("rule", 2, 3)
    verdicts = detect.detect(lines, (rule,))
    assert [(r["matched"], r["scanned"]) for r in tail.counts(lines, verdicts, (rule,)).collect()] == [(2, 3)]
    assert [r["text"] for r in detect.unmatched(lines, verdicts, formats=(rule,)).collect()] == ["no"]


def test_the_index_of_a_stream_is_that_of_the_whole(spark, log, tmp_path):
    texts = {"/a": "one\n\nthree é😀\n" * 9, "/b": "x\n" * 5}
    lines = log(texts)
    source, store = f"{tmp_path}/in", f"file://{tmp_path}/store"
    for i, (low, high) in enumerate(((0, 4), (4, 11), (11, 99))):  # a file a batch
        part = lines.where(f"line_no >= {low} and line_no < {high}").coalesce(1)
        part.write.parquet(f"{source}/part={i}")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    stream.writeStream.foreachBatch(tail.index_batch(store, block=4)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    read = lambda df: sorted((r["path"], r["line_no"], r["start_offset"], r["length"]) for r in df.collect())
    assert read(tail.latest_starts(spark, store)) == read(index.line_starts(lines))
    version = tail.versions(spark, store, "totals")
    assert version == 2
    state = spark.read.parquet(f"{store}/totals/version={version}")
    assert sorted(map(tuple, state.collect())) == [("/a", 0, 27, len(texts["/a"])), ("/b", 0, 5, 10)]
    # the last batch again, then a rewrite that leaves two lines, then one that leaves none
    run = tail.index_batch(store)
    run(lines.where("line_no >= 11"), version)
    assert read(tail.latest_starts(spark, store)) == read(index.line_starts(lines))
    schema = "path string, generation long, line_no long, raw string"
    run(spark.createDataFrame([("/a", 1, 0, "new"), ("/a", 1, 1, "n"), ("/a", 0, 27, "old")], schema), 3)
    assert read(tail.latest_starts(spark, store).where("path = '/a'")) == [("/a", 0, 0, 3), ("/a", 1, 4, 1)]
    assert tail.latest_starts(spark, store).where("path = '/b'").count() == 5
