"""The corpus pipeline, stage by stage against plain Python, and as a whole."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_operators import babble, brute_join

from tidelog.llm import mixing, pieces, pii, quality

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(12)
    clean = [babble(rng, rng.randrange(60, 120), 4000) for _ in range(40)]
    near = [c.replace(c.split(" ")[5], "changed", 1) for c in clean[:10]]
    mail = [babble(rng, 70, 4000) + f" write to user{k}@example.com or +49 30 1234567{k}" for k in range(10)]
    return clean + near + clean[:5] + mail + ["too short", "", None, "same line of text\n" * 60]


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, COLS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    by = {r[0]: r[1] for r in rows}
    after = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        after.append(docs)
        if k < 4:
            assert docs.columns == [c.split()[0] for c in COLS.split(", ")], name
    good = {d for d, t in by.items() if (c := quality.base_counts((t or "").encode()))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    kept = {r["doc_id"]: r["text"] for r in after[0].collect()}
    assert kept == {d: by[d] for d in good} and len(good) == 65
    ids = sorted(kept)
    classes = brute_join([kept[i] for i in ids], 5, 80)
    alone = {ids[c[0]] for c in classes if c[0] == c[2]}
    assert {r["doc_id"] for r in after[1].collect()} == alone and len(alone) == 50
    clean = {r["doc_id"]: r["text"] for r in after[2].collect()}
    assert clean == {d: pii.redact(by[d], pii.find_spans(by[d])[1]) for d in alone} and "[EMAIL]" in clean[55] and "@" not in clean[55]
    times = Counter(r["doc_id"] for r in after[3].collect())
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mixed(after[2]).collect()}
    assert times == Counter({d: n for d, n in taken.items() if n})
    back = [(r["doc_id"], r["text"]) for r in pieces.decoded(after[4].select("doc_id", "ids")).collect()]
    assert sorted(back) == sorted((d, clean[d]) for d in times.elements())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, after[4].collect())) and after[4].where(F.col("n_pieces") != F.size("ids")).count() == 0


EXTRA = COLS + ", size long, taken long, copies long, places string, grp long, component_id long"


def run_over(spark, folder, rows, cols):
    spark.createDataFrame(rows, cols).write.parquet(str(folder / "documents.parquet"))
    return corpus_pipeline.run(spark, str(folder))


def test_empty_table(spark, tmp_path):
    out = run_over(spark, tmp_path, [], COLS)
    assert out.columns == ["doc_id", "n_pieces", "ids"] and out.count() == 0


def test_odd_rows(spark, tmp_path):
    """Repeated rows and ids, null ids, empty and very long texts, extra columns of the operators' own names. There is one
    source, whose target is its own size, so the mix takes every document once."""
    rng = random.Random(21)
    good = [babble(rng, 80, 4000) for _ in range(5)]
    long_ = babble(rng, 150_000, 60_000) + " ünï"
    texts_of = [(1, good[0]), (1, good[0]), (2, good[1]), (2, good[2]), (3, long_), (4, None), (5, ""), (None, good[3]), (None, good[3]), (6, good[4] + " x@example.org"), (7, good[0])]
    rows = [(d, t, None, "a", None if t is None else len(t), 9, None, 8, "p", 7, None) for d, t in texts_of]
    out = run_over(spark, tmp_path, rows, EXTRA)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in pieces.decoded(out).collect())
    assert got == sorted([(1, good[0]), (2, min(good[1:3])), (3, long_), (0, good[3]), (0, good[3]), (6, good[4] + " [EMAIL]")])
