"""Token counts of whole texts for a byte-level BPE vocabulary, without encoding them.

Offline, once per vocabulary, every vocabulary string is merged by the vocabulary's own rules: those that end as one
token are proved to stand alone. Tasks then cut texts into pre-tokens, count those that are proved strings as one token
each by a look-up, and merge only the rest, each different one once per task as long as a bounded memory holds it. The
proof, the merge ranks and the pattern travel as one broadcast, whose size the vocabulary bounds.

Library and pattern engine know different versions of Unicode: `Vocabulary` asks the library's own pre-tokeniser about
every code point once, and texts that hold one on which they differ are cut by a pattern without those.

Added tokens inside texts count as the library counts them by default: one token each, leftmost first, the longest of
those that start there. Null texts have no bytes and no tokens; rows that repeat are counted alike; a null doc_id stays;
other columns are not looked at. A text is read in pieces that end between a visible character and white space, where
pre-tokens always end, so memory follows its longest run without white space.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import frugal, table

#: The vocabulary that the query counts for, and the tokens above which a text is over the limit.
VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: The library's pre-tokens; {L} and {N} stand for its letters and numbers.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?{L}++| ?{N}++| ?[^\s\p{{L}}\p{{N}}]++|\s+(?!\S)|\s+"
#: Characters of a text that are cut into pre-tokens at a time.
SLICE = 200_000
#: Merged pre-tokens that a task remembers, and the bytes up to which one is short.
REMEMBERED, SHORT = 500_000, 64

_CUT = regex.compile(r"\S(?=\s)")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merged_short(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """merged() for few bytes, where looking through all pairs costs less than a heap."""
    parts = [word[i : i + 1] for i in range(len(word))]
    get, none = ranks.get, len(ranks)
    left = [get(pair, none) for pair in zip(parts, parts[1:])]
    while left and (least := min(left)) < none:
        i = left.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del left[i]
        if i:
            left[i - 1] = get((parts[i - 1], parts[i]), none)
        if i < len(left):
            left[i] = get((parts[i], parts[i + 1]), none)
    return parts


def merged(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The pieces of one pre-token: the pair of least rank is merged, the leftmost first, until no pair has a rank."""
    if len(word) <= SHORT:
        return _merged_short(word, ranks)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:  # one of them has grown since
            continue
        parts[i], parts[j] = left + right, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p is not None]


@dataclass
class Vocabulary:
    """What tasks need of a vocabulary file: proved strings, merge ranks, added tokens, and code points apart."""

    alone: frozenset[str]
    ranks: dict[tuple[bytes, bytes], int]
    added: list[str]
    odd: str = ""  # ranges of a character class

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in what stands beside them")
        of = byte_characters()
        raw = lambda s: bytes(of[c] for c in s)
        ranks = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[raw(a), raw(b)] = r
        alone = set()
        for word in map(raw, model["vocab"]):
            try:
                text = word.decode()
            except UnicodeDecodeError:
                continue  # no pre-token: texts are cut between characters
            if merged(word, ranks) == [word]:
                alone.add(text)
        return cls(frozenset(alone), ranks, [t["content"] for t in spec["added_tokens"]], code_points_apart(path))

    def patterns(self) -> tuple[regex.Pattern, regex.Pattern, Callable[[str], bool], regex.Pattern | None]:
        """The pattern of pre-tokens, that without the code points apart, whether a text has one, and added tokens."""
        plain = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}"))
        added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        if not self.odd:
            return plain, plain, lambda text: False, added
        apart = PATTERN.format(L=rf"(?:(?![{self.odd}])\p{{L}})", N=rf"(?:(?![{self.odd}])\p{{N}})").replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{self.odd}])")
        low = re.compile(f"[{chr(min(int(x, 16) for x in re.findall(r'[0-9a-f]{8}', self.odd)))}-\U0010ffff]")
        odd = regex.compile(f"[{self.odd}]")
        return plain, regex.compile(apart), lambda text: low.search(text) is not None and odd.search(text) is not None, added


class Sizes(dict):
    """Tokens of pre-tokens that are not proved: merged where asked for first, remembered up to a bound."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, pre_token: str) -> int:
        n = len(merged(pre_token.encode(), self.ranks))
        if len(pre_token) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[pre_token] = n
        return n


def code_points_apart(path: str) -> str:
    """Code points that the pattern engine takes for letters or numbers and the library does not, as ranges of a class.

    Every assigned code point is shown to the library between two letters: it is a letter if no pre-token ends there, and
    likewise between two digits. Differences of any other kind are refused.
    """
    from tokenizers import Tokenizer

    ask = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    known = regex.findall(r"[^\p{Cn}\p{Co}\p{Cs}']", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    own = [set(regex.findall(p, "".join(known))) for p in (r"\p{L}", r"\p{N}")]
    points = list(map(ord, known))
    apart = []
    for first in range(0, len(points), 5_000):
        some = [chr(c) for c in points[first : first + 5_000]]
        inside = []
        for a in "a1":
            ends = {end for _, (_, end) in ask(a + "".join(c + a for c in some))}
            inside.append([2 * i + 1 not in ends and 2 * i + 2 not in ends for i in range(len(some))])
        for c, letter, number in zip(some, *inside, strict=True):
            if (c in own[0], c in own[1]) != (letter, number):
                if letter or number:
                    raise ValueError(f"the library's class of {ord(c):#x} is unknown to the pattern")
                apart.append(ord(c))
    ranges: list[list[int]] = []
    for c in apart:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges)


def slices(text: str, limit: int) -> Iterator[str]:
    """Pieces of about `limit` characters that end where pre-tokens do whatever follows; without such a place, longer ones."""
    at = 0
    while len(text) - at > limit:
        cut = _CUT.search(text, at + limit - 1)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def count(text: str, vocabulary: Vocabulary, patterns: tuple, sizes: Sizes) -> tuple[int, int]:
    """Tokens of one text, and how many of its pre-tokens were counted by look-up alone."""
    plain, apart, odd, added = patterns
    total = direct = 0
    pieces = [text]
    if added is not None and any(a in text for a in vocabulary.added):
        pieces = added.split(text)
        total = len(pieces) - 1
    alone, size = vocabulary.alone, sizes.__getitem__
    for piece in pieces:
        for part in slices(piece, SLICE):
            found = (apart if not part.isascii() and odd(part) else plain).findall(part)
            rest = [p for p in found if p not in alone]
            direct += len(found) - len(rest)
            total += len(found) - len(rest) + sum(map(size, rest))
    return total, direct


def _counts(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = shared.value
    patterns, sizes = vocabulary.patterns(), Sizes(vocabulary.ranks)
    for batch in batches:
        texts = batch.column(1)
        found = [(0, 0) if (t := texts[i].as_py()) is None else count(t, vocabulary, patterns, sizes) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))], ["doc_id", "n_bytes", "n_tokens", "n_direct"])


def counted(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_direct (pre-tokens counted by look-up) of each row, by the vocabulary file at path."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(frugal(partial(_counts, shared)), "doc_id long, n_bytes long, n_tokens long, n_direct long")


def op13_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every whole document, and whether they are more than LIMIT.

    Null texts have none; repeated rows and rows without doc_id stay. An empty table gives no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return counted(table(spark, sf_dir, "documents"), path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
