"""Texts made to collide, and values made to break what reads them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import chat, common, ngrams, pieces, quality, repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(length, a="a", b="b"):
    """A word of two letters and its complement: every polynomial modulo 2**64 takes them for equal from 1,024 on."""
    while len(a) < length:
        a, b = a + b, b + a
    return a, b


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("length", [32, 512, 1024, 2048, 8192])
def test_text_hashes_tell_them_apart(length):
    a, b = thue_morse(length)
    texts = [a, b, a + "x", "x" + a, b + a, a + b, "", "x"]
    data = np.frombuffer("".join(["pad", *texts, *texts]).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in [*texts, *texts]]) + 3
    h = common.text_hashes(common.prefix_hashes(data), np.concatenate([[3], ends[:-1]]), ends)
    assert len(set(h[:8].tolist())) == 8 and (h[:8] == h[8:]).all()


@pytest.mark.parametrize("length", [1024, 2048])
def test_operators_tell_them_apart(spark, length):
    a, b = thue_morse(length)
    texts = [f"{a} q r s", f"{b} q r s", f"{a}\n{b}\n{a}", f"{a} {b} {a} {b} x", f"{b} {a}", " ".join([a, b] * 30), "\n".join([f"{a} 1", f"{b} 1", f"{a} 1", f"{b} 2"])]
    docs = frame(spark, texts)
    got = ngrams.joined(docs).select("doc_id", "component_id", "n_links").collect()
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in got} == {(i, i, 0) for i in range(len(texts))}
    rows = quality.base_table(docs, ["doc_id"]).collect()
    own = quality.OWN
    for r in rows:
        want = quality.base_counts(texts[r["doc_id"]].encode())
        assert tuple(r[f"{own}{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    assert all(r["lossless"] for r in pieces.encoding_report(docs).collect())
    kept = ngrams.one_of_each(docs, 5, 80).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == set(range(len(texts)))


def test_bytes_decide_where_hashes_agree(monkeypatch):
    """With a hash that says everything is equal, counts and segmentations are still right."""
    monkeypatch.setattr(quality, "text_hashes", lambda p, a, b: np.zeros(len(a), np.uint64))
    monkeypatch.setattr(pieces, "text_hashes", lambda p, a, b: np.zeros(len(a), np.uint64))
    text = b"one\ntwo\none\nsix\ntwo\none"
    data = np.frombuffer(text + b"one", np.uint8)
    assert quality.chunk_counts(data, np.array([0, len(text), len(data)]))[3].tolist() == [3, 0]
    raw = np.frombuffer(b" ab cd ab ee", np.uint8)
    first = np.array([0, 3, 6, 9])
    where, inverse = pieces._alike(raw, first, np.append(first[1:], len(raw)))
    assert inverse[0] == inverse[2] and len(where) == 3 and [raw[first[w] : first[w] + 3].tobytes() for w in where[inverse]] == [b" ab", b" cd", b" ab", b" ee"]


def test_blocks_by_elements_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    texts = []
    for _ in range(40):
        t = list(base)
        t[rng.integers(300)] = "other"
        texts.append(" ".join(t))
    want = ngrams.joined(frame(spark, texts)).orderBy("doc_id").collect()
    monkeypatch.setattr(ngrams, "ELEMENTS", 900)
    assert ngrams.joined(frame(spark, texts)).orderBy("doc_id").collect() == want
    assert {r["n_links"] for r in want} == {39}


def test_arguments_that_break_parsers(spark):
    bad = ['{"prompt":"\\ud800"}', "[" * 3000, '{"prompt":' + "9" * 5000 + "}", "{", "", None, '{"a\\udfff":1}', "[" * 3000 + "]" * 3000]
    good = ['{"prompt":"\\ud83d\\ude00","turn":1}', '{"turn":1e400,"prompt":"x"}', '{"prompt":"a","prompt":"b","turn":2.0}']
    call = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
    rows = [(1, k, "user", "t", [(f"c{k}", "ask", a, [])], None) for k, a in enumerate(bad + good)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, calls {call}, call_id string")
    got = {r["turn"]: r for r in chat.formatted(df, {"ask": chat.ASK}).where("kind = 'call'").collect()}
    assert len(got) == len(rows)
    for k, a in enumerate(bad):
        if a is not None:
            assert got[k]["error"] == "arguments are no JSON" and json.loads(got[k]["json"])["arguments"] is None and not got[k]["valid"]
    assert [got[len(bad) + k]["valid"] for k in range(3)] == [True, False, True]
    assert json.loads(got[len(bad)]["json"])["arguments"]["prompt"] == "😀" and json.loads(got[len(bad) + 2]["json"])["arguments"] == {"prompt": "b", "turn": 2}


def test_rows_without_id_are_told_apart(spark):
    """Different texts whose 32-bit hashes agree are documents of their own."""
    head = "h" * 120
    some = spark.range(400_000).select(F.concat(F.lit(head), F.col("id").cast("string")).alias("text"))
    pairs = some.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).limit(2).collect()
    assert pairs
    texts = [t for p in pairs for t in p["t"]]
    docs = spark.createDataFrame([(None, t, "en", "s", 1) for t in texts], DOCS)
    got = repeats.deduplicated(docs).collect()
    # one row keeps the head, all others lose it
    assert sorted(r["n_removed"] >= 120 for r in got) == [False] + [True] * (len(texts) - 1)
    assert all(r["n_removed"] < len(texts[0]) for r in got)
