"""SentencePiece encoding and decoding: sampled segmentations by forward filtering and backward sampling.

A text (with the model's leading blank) is cut before every run of blanks; no piece spans such a cut, so the lattice of
pieces factors into one small lattice per cut. Forward filtering gives each position of a lattice the weight of all
segmentations that end there; backward sampling walks from the end and draws each piece in proportion to what it
contributes. The draws are hashes of (row key, place of the cut in the text, step), so a row's segmentation is the same
in any batch, partition or retry. Characters without a piece, and the blank's own symbol where the text holds it
literally, become byte pieces: decoding gives back every byte.

The models at hand give merge ranks, not probabilities; a piece of rank r weighs 1 / (r + 2) ** theta.

Null and empty texts have no pieces. A null key counts as 0. Lattices are built for the distinct strings of a few
megabytes of text at a time, all of them at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import frugal, mix, prefix_hashes, table, text_buffers, text_chunks, text_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 20240
THETA = 1.0
#: Bytes of text whose distinct strings are held as lattices at a time.
LATTICE_BYTES = 600_000
SYMBOL = "▁"


def load(path: str = MODEL) -> dict:
    """What encoding and decoding need of a model: plain values and a trie, small enough (1.5 MB) to go along with the task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, plain, byte_ids = [], {}, {}
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            pieces.append(bytes([int(name[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(name.replace(SYMBOL, " ").encode())
            plain[name.replace(SYMBOL, " ")] = (i, max(0.0, -sp.get_score(i)))
    return {"bytes": pieces, "plain": plain, "byte_ids": byte_ids, "trie": double_array(plain)}


def double_array(plain: dict[str, tuple[int, float]]) -> dict[str, np.ndarray]:
    """The pieces' bytes as a double array: node t follows node s by byte c if t = base[s] + c and parent[t] = s.

    `piece` is the piece that ends at a node, or -1. The root is the last node; code 256 follows no node.
    """
    numbers: dict[bytes, int] = {b"": 0}
    ends, below = {}, [[]]
    for name, (i, _) in plain.items():
        word = name.encode()
        at = 0
        for k in range(len(word)):
            child = numbers.setdefault(word[: k + 1], len(numbers))
            if child == len(below):
                below.append([])
                below[at].append((word[k], child))
            at = child
        ends[at] = i
    # nodes of many children are given room first, one after the other; those of one child take what is left between
    shift, place = np.zeros(len(below), np.int64), np.zeros(len(below), np.int64)
    free = np.ones(2 * len(below) + 1024, bool)
    free[:256] = False
    at, many = 256, 0
    for node in sorted((k for k, c in enumerate(below) if len(c) > 1), key=lambda k: -len(below[k])):
        codes = np.array([c for c, _ in below[node]])
        if len(codes) != many:
            at, many = 256, len(codes)
        while True:
            if at + 1024 > len(free):
                free = np.append(free, np.ones(len(free), bool))
            tries = np.flatnonzero(free[at : at + 128]) + at - codes[0]
            fits = np.flatnonzero(free[tries[:, None] + codes].all(axis=1))
            if len(fits):
                break
            at += 128
        shift[node] = tries[fits[0]]
        place[[k for _, k in below[node]]] = shift[node] + codes
        free[shift[node] + codes] = False
    single = [(k, *c[0]) for k, c in enumerate(below) if len(c) == 1]
    if single:
        node, codes, child = np.array(single).T
        place[child] = np.flatnonzero(np.append(free, np.ones(len(single), bool)))[: len(single)]
        shift[node] = place[child] - codes
    root = int(place.max()) + 257
    place[0] = root
    base, parent, piece = np.zeros(root + 1, np.int32), np.full(root + 1, -1, np.int32), np.full(root + 1, -1, np.int32)
    base[place] = shift
    for node, children in enumerate(below):
        parent[place[[k for _, k in children]]] = place[node]
    piece[place[list(ends)]] = list(ends.values())
    return {"base": base, "parent": parent, "piece": piece}


class Lattices:
    """The model's pieces as a trie, and the lattices of many strings at once.

    A place is a string's distance from its start, 0 to its length. Places are numbered by distance, and within one by
    falling length of the strings: those of a distance, and what is known of them, lie side by side in memory.
    """

    def __init__(self, model: dict, theta: float = THETA):
        self.n_pieces = len(model["bytes"])
        self.fallback = -theta * math.log(self.n_pieces + 2)
        self.byte_ids = np.zeros(256, np.int64)
        for byte, i in model["byte_ids"].items():
            self.byte_ids[byte] = i
        self.trie = model["trie"]
        self.weight = np.zeros(self.n_pieces)
        ids, ranks = np.array(list(model["plain"].values())).reshape(-1, 2).T
        self.weight[ids.astype(np.int64)] = -theta * np.log(ranks + 2)
        # of up to so many bytes, no product of weights leaves the range of numbers
        self.short = int(600 / (max(abs(self.fallback), float(np.abs(self.weight).max(initial=0.0))) + math.log(2)))

    def places(self, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Numbers the places; of each: distance, string, whether a byte follows, and where that is in the data.

        `column` is the first place of each distance, `rank` a string's number by falling length, `size` the lengths in it.
        """
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        self.rank = np.empty(len(size), np.int64)
        self.rank[order] = np.arange(len(size))
        self.size = size[order]
        width = len(size) - np.searchsorted(self.size[::-1], np.arange(int(size.max(initial=0)) + 1))
        self.column = np.concatenate([[0], np.cumsum(width)])
        depth = np.repeat(np.arange(len(width), dtype=np.int32), width)
        string = (np.arange(len(depth)) - self.column[depth]).astype(np.int32)
        inside = depth < self.size[string]
        return depth, string, inside, np.where(inside, offsets[order][string] + depth, 0)

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """Edges of the strings' lattices by the place that they end at (`first` and `degree` of each): `prev`, `piece`."""
        depths, strings, inside, where = self.places(offsets)
        n, column = len(data), self.column
        border = np.ones(n + 1, bool)
        border[:n] = (data & 0xC0) != 0x80
        border[offsets] = True
        chars = np.flatnonzero(border)
        for k in np.flatnonzero(np.diff(chars) > 4):  # no UTF-8: every byte is its own character
            border[chars[k] : chars[k + 1]] = True
        chars = np.flatnonzero(border)
        wide = np.zeros(n + 1, np.int8)
        wide[chars[:-1]] = np.diff(chars)
        codes = np.full(len(where), 256, np.int16)
        codes[inside] = data[where[inside]]
        border = border[where] | ~inside
        start = np.flatnonzero(border & inside)
        wide = wide[where[start]]
        single = np.zeros(len(start), bool)
        base, parent, piece = self.trie["base"], self.trie["parent"], self.trie["piece"]
        who = np.arange(len(start))
        depth, string = depths[start], strings[start]
        at, node = start, np.full(len(start), len(base) - 1, np.int32)
        parts = []
        length = 0
        while len(who):
            node, before = base[node] + codes[at], node
            live = np.flatnonzero(parent[node] == before)
            who, node, depth, string = who[live], node[live], depth[live] + np.int32(1), string[live]
            at = column[depth] + string
            length += 1
            what = piece[node]
            hit = np.flatnonzero((what >= 0) & border[at])
            one = who[hit]
            single[one[wide[one] == length]] = True
            parts.append((start[one], at[hit], what[hit]))
        rest = np.flatnonzero(~single)
        if len(rest):
            p, w = start[rest], wide[rest].astype(np.int64)
            at = where[p]
            packed = np.zeros(len(rest), np.int64)
            for k in range(4):
                packed |= np.where(w > k, data[np.minimum(at + k, n - 1)].astype(np.int64) << (8 * k), 0)
            parts.append((p, column[depths[p] + w] + strings[p], self.n_pieces + packed * 8 + w))
        # no two edges of one part end at the same place, so parts are dealt by counting
        degree = np.zeros(len(codes), np.int32)
        slots = []
        for _, end, _ in parts:
            slot = degree[end]
            slots.append(slot)
            degree[end] = slot + 1
        self.degree = degree
        self.first = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(degree, out=self.first[1:])
        self.prev, self.piece = np.empty(self.first[-1], np.int32), np.empty(self.first[-1], np.int64)
        for (p, end, what), slot in zip(parts, slots, strict=True):
            to = self.first[end] + slot
            self.prev[to] = p
            self.piece[to] = what

    def forward(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """Forward filtering of all strings, one distance from their start at a time.

        `reach` holds for each edge its share of the weight that comes to where it ends, plus those of the edges before it
        there. Weights of short strings are multiplied as they are, those of long ones as logarithms.
        """
        self.edges(data, offsets)
        column, degree, prev = self.column, self.degree, self.prev
        weight = np.where(self.piece < self.n_pieces, self.weight[np.minimum(self.piece, self.n_pieces - 1)], self.fallback)
        long = int(np.searchsorted(-self.size, -self.short))
        alpha = np.ones(len(degree))
        alpha[:long] = 0.0
        ends = np.flatnonzero(degree)
        heads = self.first[ends]
        by_column = np.searchsorted(ends, column)
        of_long = np.searchsorted(ends, column[:-1] + np.minimum(long, np.diff(column)))
        share = np.exp(weight)
        bounds = np.append(heads, len(prev))
        for a, m, b in zip(by_column[1:-1].tolist(), of_long[1:].tolist(), by_column[2:].tolist(), strict=True):
            if m > a:
                own = slice(bounds[a], bounds[m])
                g = heads[a:m] - bounds[a]
                v = weight[own] + alpha[prev[own]]
                top = np.maximum.reduceat(v, g)
                v = np.exp(v - np.repeat(top, degree[ends[a:m]]))
                total = np.add.reduceat(v, g)
                alpha[ends[a:m]] = top + np.log(total)
                share[own] = v / np.repeat(total, degree[ends[a:m]])
            if b > m:
                own = slice(bounds[m], bounds[b])
                v = share[own]
                v *= alpha[prev[own]]
                total = np.add.reduceat(v, heads[m:b] - bounds[m])
                alpha[ends[m:b]] = total
                v /= np.repeat(total, degree[ends[m:b]])
        edge, left = heads, degree[ends]
        while len(edge):
            more = np.flatnonzero(left > 1)
            edge, left = edge[more] + 1, left[more] - 1
            share[edge] += share[edge - 1]
        share[bounds[1:] - 1] = 1.0
        self.reach = share

    def sample(self, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling for many occurrences of the strings: (pieces in order, number of pieces of each)."""
        n_strings = len(self.size)
        place = self.rank[which]
        active = np.argsort(place, kind="stable")  # neighbours in memory are drawn one after the other
        place = place[active]
        place += self.column[self.size[place]]
        seeds = seeds[active]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(which), np.int64)
        t = 0
        go = place >= n_strings
        while True:
            active, place, seeds = active[go], place[go], seeds[go]
            if not len(active):
                break
            u = (mix(seeds + np.uint64(t * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[place]
            on = np.flatnonzero(self.reach[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[self.reach[edge[on]] <= u[on]]
            steps.append((active, self.piece[edge]))
            count[active] += 1
            place = self.prev[edge]
            go = place >= n_strings
            t += 1
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (who, what) in enumerate(steps):
            out[ends[who] - 1 - k] = what
        return out, count

    def as_ids(self, found: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with characters that have none written as byte pieces."""
        odd = found >= self.n_pieces
        if not odd.any():
            return found.astype(np.int32), per_text
        times = np.where(odd, (found - self.n_pieces) % 8, 1)
        wide = np.repeat(found, times)
        k = np.arange(len(wide)) - np.repeat(np.cumsum(times) - times, times)
        byte = ((wide - self.n_pieces) // 8 >> (8 * k)) & 255
        text = np.repeat(np.repeat(np.arange(len(per_text)), per_text), times)
        ids = np.where(wide >= self.n_pieces, self.byte_ids[np.where(wide >= self.n_pieces, byte, 0)], wide)
        return ids.astype(np.int32), np.bincount(text, minlength=len(per_text))[: len(per_text)].astype(np.int64)


def _alike(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings that tile raw: the places of one of each, and which one each is; every string is compared with its one."""
    _, where, inverse = np.unique(text_hashes(prefix_hashes(raw), first, last), return_index=True, return_inverse=True)
    size, one = last - first, first[where[inverse]]
    if (size == (last - first)[where[inverse]]).all() and (raw[np.repeat(one - first, size) + np.arange(len(raw))] == raw).all():
        return where, inverse
    seen: dict[bytes, int] = {}
    inverse = np.array([seen.setdefault(raw[a:b].tobytes(), len(seen)) for a, b in zip(first, last, strict=True)])
    return np.unique(inverse, return_index=True)[1], inverse


def encode_chunk(lat: Lattices, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of each text's ids) of a few texts."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    # each text that isn't empty gets the model's leading blank
    lead = (lengths > 0).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(lengths + lead)])
    raw = np.full(int(off[-1]), 32, np.uint8)
    at = np.ones(len(raw), bool)
    at[off[:-1][lead > 0]] = False
    raw[at] = data
    blank = raw == 32
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut[off[:-1][lead > 0]] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(raw))
    where, inverse = _alike(raw, first, last)
    size = (last - first)[where]
    word = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(first[where] - word[:-1], size) + np.arange(word[-1])
    lat.forward(raw[take], word)
    text_first = np.searchsorted(first, off)
    owner = np.repeat(np.arange(n), np.diff(text_first))
    place = (np.arange(len(first)) - text_first[owner]).astype(np.uint64)
    row = mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    found, count = lat.sample(inverse, mix(row[owner] + place * np.uint64(0x2545F4914F6CDD1D)))
    per_text = np.bincount(owner, weights=count, minlength=n)[:n].astype(np.int64) if len(owner) else np.zeros(n, np.int64)
    ids, per_text = lat.as_ids(found, per_text)
    return ids, np.concatenate([[0], np.cumsum(per_text)])


def decode(model: dict, ids: list[int]) -> bytes:
    """The text's bytes: pieces' bytes in order, without the leading blank."""
    pieces = model["bytes"]
    return b"".join([pieces[i] for i in ids])[1:]


def _batches(model_var, seed: int, theta: float, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_var.value
        lat = Lattices(model, theta)
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            keys = np.array([0 if k is None else int(k) for k in batch.column("doc_id").to_pylist()], np.int64)
            for a, b in text_chunks(offsets, LATTICE_BYTES):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, id_off = encode_chunk(lat, part, off, keys[a:b], seed)
                yield emit(model, batch.slice(a, b - a), part, off, ids, id_off)

    return run


def _ids(model, batch, data, off, ids, id_off):
    arrays = [batch.column("doc_id"), pa.array(np.diff(id_off)), pa.ListArray.from_arrays(pa.array(id_off.astype(np.int32)), pa.array(ids, pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_pieces", "ids"])


def _digest(model, batch, data, off, ids, id_off):
    sha, same = [], []
    blob, raw = data.tobytes(), ids.astype("<i4")
    for k in range(len(off) - 1):
        own = raw[id_off[k] : id_off[k + 1]]
        sha.append(hashlib.sha256(own.tobytes()).hexdigest())
        same.append(decode(model, own.tolist()) == blob[off[k] : off[k + 1]])
    arrays = [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(np.diff(id_off)), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_pieces", "ids_sha256", "lossless"])


def encoded(docs: DataFrame, model_path: str = MODEL, seed: int = SEED, theta: float = THETA) -> DataFrame:
    """doc_id, n_pieces, ids: a sampled segmentation of every whole text."""
    var = docs.sparkSession.sparkContext.broadcast(load(model_path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(_batches(var, seed, theta, _ids)), f"doc_id {kind}, n_pieces long, ids array<int>")


def decoded(ids: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text back from doc_id, ids."""
    var = ids.sparkSession.sparkContext.broadcast(load(model_path))
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = var.value
        for batch in batches:
            texts = [decode(model, x or []).decode("utf-8", "surrogateescape") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoding_report(docs: DataFrame, model_path: str = MODEL, seed: int = SEED, theta: float = THETA) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_sha256 (of the ids as little-endian int32), lossless (decoding gave the text)."""
    var = docs.sparkSession.sparkContext.broadcast(load(model_path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(_batches(var, seed, theta, _digest)), f"doc_id {kind}, n_bytes long, n_pieces long, ids_sha256 string, lossless boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"))
