"""Prefix trie, manifest and token counts against brute force, and on odd input."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import common, manifest, tokens, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie -----------------------------------------------------------------------------------------------------


def code(role, text):
    return sha(f"{len(role.encode())}:{role}{text}")[:32]


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, code(role or "", text or ""), role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(first, [])[:h] + mine[h:]
    return out


def brute_trie(convs):
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out, inner = [], {w[:-1] for w in nodes if w}
    for way, members in nodes.items():
        below = [w for w in nodes if w[: len(way)] == way]
        leaves = sum(w not in inner for w in below)
        saved = sum((len(nodes[w]) - 1) * len(w[-1][1]) for w in below if w)
        done = sorted(c for c in members if len(convs[c]) == len(way))
        out.append((min(members), len(way), min(nodes[way[:-1]]) if way else None, len(members), sum(len(w) == len(way) + 1 for w in below), leaves, saved, sha(",".join(map(str, done)))))
    return sorted(out, key=str)


def traffic(rng, n, longest):
    said = ["yes", "no", "", None, "é😀", "maybe so", "a,b"]
    rows = []
    for c in rng.sample(range(-150, 900), n):
        for k in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.3 else "user", rng.choice(said)))
    return rows + rows[:5] + [(None, 1, "user", "nobody")]


@pytest.mark.parametrize(("span", "block", "chunk", "longest"), [(16, 1 << 16, 1 << 20, 9), (2, 3, 8, 14), (3, 50, 1, 40)])
def test_trie(spark, monkeypatch, span, block, chunk, longest):
    monkeypatch.setattr(trie, "SPAN", span)
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = traffic(random.Random(longest), 60, longest)
    df = spark.createDataFrame(rows, TURNS).withColumn("pos", F.lit("x")).withColumn("n", F.lit(1.5)).withColumn("code", F.lit("c"))
    own = trie.numbered(trie.turns(df))
    out = trie.trie(*trie.reopened(own)).collect()
    assert sorted((tuple(r)[:8] for r in out), key=str) == brute_trie(rebuilt(rows))
    # intervals nest, and the order is a preorder
    at = sorted((r["rank"], r["until"], r["depth"]) for r in out)
    open_ = []
    for rank, until, depth in at:
        while open_ and open_[-1] <= rank:
            open_.pop()
        assert len(open_) == depth and (not open_ or until <= open_[-1])
        open_.append(until)
    assert [x[0] for x in at] == list(range(len(at)))


def test_trie_sql_query_and_no_rows(spark, tmp_path):
    rows = traffic(random.Random(3), 80, 9)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = trie.op11_prefix_trie(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT {','.join(got.columns)} FROM ({trie.OP11_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) == brute_trie(rebuilt(rows))
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert trie.op11_prefix_trie(spark, f"{tmp_path}/none").collect() == []


def test_trie_of_one_long_conversation(spark):
    n = 3000
    rows = [(7, k, "user", f"t{k % 5}") for k in range(n)] + [(8, k, "user", f"t{k % 5}") for k in range(n - 1)] + [(9, 0, "user", "x" * 100_000)]
    own = trie.numbered(trie.turns(spark.createDataFrame(rows, TURNS)))
    out = {(r["conv_id"], r["depth"]): r for r in trie.trie(own.select("conv_id", "pos", "code", "size"), own.select("conv_id").distinct()).collect()}
    assert len(out) == n + 2 and out[7, 0]["n_leaves"] == 2 and out[7, 0]["saved_tokens"] == 2 * (n - 1) and out[7, 0]["n_children"] == 2
    assert out[7, n - 1]["ends_sha256"] == sha("8") and out[7, n]["ends_sha256"] == sha("7") and out[7, n]["parent_conv_id"] == 7


# --- manifest --------------------------------------------------------------------------------------------------------


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one leaf after the other."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: sha("".join(map(field, (i, source, lang, n, text))))

    def tree(level):
        all_levels = [level]
        while len(level) > 1:
            level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
            all_levels.append(level)
        return all_levels

    def steps(levels, i):
        for level in levels[:-1]:
            run = i // 3 * 3
            yield level[run:i], level[i + 1 : run + 3]
            i //= 3

    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = [tree([leaf(*r) for r in sources[s]]) for s in order]
    over = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            way = [*steps(trees[k], i), *steps(over, k)]
            bad = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r[0], r[1].replace("\n", ""), *r[2:]) if bad else leaf(*r)
            for a, b in way:
                now = sha("".join(a) + now + "".join(b))
            out.append((r[0], leaf(*r), trees[k][-1][0], over[-1][0], sha("".join("".join(a + b) for a, b in way)), now, now == over[-1][0]))
    return sorted(out, key=str)


def leaves(rng, n, sources):
    texts = ["a\nb", "", None, "\n", "plain", "é\n😀", "x" * 90_000]
    rows = [(rng.choice([i, i, i, None]), rng.choice(texts), rng.choice(["en", None]), rng.choice(sources), rng.choice([3, None])) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize(("n", "sources", "levels"), [(120, ["hot"] * 9 + ["b", None, "é", "Z"], 4), (60, ["hot"] * 9 + ["b"], 1), (40, [f"s{i}" for i in range(35)], 2), (1, ["a"], 4), (3, [None], 4)])
def test_manifest(spark, tmp_path, monkeypatch, n, sources, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = leaves(random.Random(n), n, sources)
    spark.createDataFrame(rows, DOCS).withColumn("idx", F.lit("x")).withColumn("tree", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op12_merkle_manifest(spark, str(tmp_path)).collect()
    want = brute_manifest(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert n < 10 or {r[-1] for r in want} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({manifest.OP12_SQL})").fetchall(), key=str) == want


def test_manifest_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest.op12_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_placed_spreads_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    got = common.placed(rows.repartition(7), ["g"], [F.col("v")], "placed").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append(r)
    order = sorted(groups, key=lambda g: min(r["tree"] for r in groups[g]))
    assert order == sorted(groups, key=lambda g: (g is not None, g or ""))
    for g in groups.values():
        g.sort(key=lambda r: r["v"])
        assert [r["idx"] for r in g] == list(range(len(g))) and {r["n"] for r in g} == {len(g)} and len({r["tree"] for r in g}) == 1


# --- token counts ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.VOCABULARY)
    return path, Tokenizer.from_file(path), tokens.Vocabulary.load(path)


def odd_texts(rng):
    signs = ["՘", "꟎", "࢏", "<|endoftext|>", "<|endoftext", "'s", "'ST", " ", "  ", "\n", " ", "\u0085", "\x1c", "\x00", "é", "é", "😀", "１", "ab", "Zebra", "1234", "!?", "中文", "　", "\U000323b0", "﻿", "‍"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    return [None, "", " ", "\n\n \n", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "x" * 3000, " " * 3000 + "x", "ab" * 2000, "՘" * 50, *out]


def test_token_counts(spark, vocabulary, monkeypatch, tmp_path):
    path, library, _ = vocabulary
    texts = odd_texts(random.Random(8))
    rows = [(i if i % 9 else None, t, "en", "a", 1) for i, t in enumerate(texts + texts[:4])]
    spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("x")).withColumn("n_bytes", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    got = tokens.op13_token_counts(spark, str(tmp_path), path).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert tokens.op13_token_counts(spark, f"{tmp_path}/none", path).collect() == []


def test_texts_are_cut_where_pre_tokens_end(vocabulary, monkeypatch):
    _, library, v = vocabulary
    monkeypatch.setattr(tokens, "SLICE", 5)
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    patterns = v.patterns()
    for t in odd_texts(random.Random(9)):
        assert "".join(tokens.slices(t or "", 5)) == (t or "")
        assert tokens.count(t or "", v, patterns, tokens.Sizes(v.ranks))[0] == len(library.encode(t or "", add_special_tokens=False).ids)


def test_proof_and_merges(vocabulary):
    """Strings are proved exactly where the library makes one token of them; both ways of merging give its pieces."""
    _, library, v = vocabulary
    of = {b: c for c, b in tokens.byte_characters().items()}
    for word in random.Random(1).sample(sorted(v.alone), 3000):
        assert [x.value for x in library.model.tokenize("".join(of[b] for b in word.encode()))] == ["".join(of[b] for b in word.encode())]
    strings = [bytes(tokens.byte_characters()[c] for c in s) for s in library.get_vocab(with_added_tokens=False)]
    for word in strings:
        one = len(library.model.tokenize("".join(of[b] for b in word))) == 1
        assert one == (tokens.merged(word, v.ranks) == [word])
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"aabbeinrst\xc3\xa9 ") for _ in range(rng.randrange(1, 200)))
        want = [x.value for x in library.model.tokenize("".join(of[b] for b in word))]
        for short in (0, 10**6):
            tokens_short, tokens.SHORT = tokens.SHORT, short
            assert ["".join(of[b] for b in p) for p in tokens.merged(word, v.ranks)] == want
            tokens.SHORT = tokens_short
