"""WARC archives and their two-level capture index.

Archives: each task writes one .warc.gz of gzip members, one per record, to the shared folder and reports where every
record lies. Of equal payloads of at least MIN_PAYLOAD bytes, the record with the smallest page_id is a response and
the others are revisits that refer to it; they carry no payload.

Index: captures are sorted by reversed-host URL key over range partitions. Each partition writes its lines in
compressed blocks of BLOCK_LINES to one .cdx.gz file and a sparse directory (first key, place of each block) beside it.
A lookup bisects the first keys of the files (as many as index partitions), then the file's directory, reads one block
as a range, bisects its lines, and reads each record as a range.

Null urls have the empty key, null html the empty payload; such pages are archived and found like others. Rows that
repeat a page_id and payload are all responses (or all revisits). A task that fails leaves a file that no report names;
the rerun writes another. Files are opened through pyarrow's filesystem for the shared folder's own URI.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import materialise, table, work_dir

MIN_PAYLOAD = 100
BLOCK_LINES = 500
GZIP_LEVEL = 4
OPEN_FILES = 24
TASK_BYTES = 4 * 1024**2


def _open_fs(base: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(base)


def capture_key(url: Column, page_id: Column) -> Column:
    """Reversed host, ')', the rest of the url from its path on, a blank and the page's number: sorts a site together."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(u, r"(?s)\A.*?://", "")
    host = F.lower(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    path = F.regexp_replace(rest, r"(?s)\A[^/?#]*", "")
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), path, F.lit(" "), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")))


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, key, digest, record_type, refers_to, refers_url, payload (null for revisits)."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    shared = p.where(F.octet_length("html") >= MIN_PAYLOAD).groupBy(F.col("digest").alias("dg")).agg(F.min("page_id").alias("first_id"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    j = p.join(shared, F.col("digest") == F.col("dg"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return j.select(
        "page_id", "url", capture_key(F.col("url"), F.col("page_id")).alias("key"), "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"),
        F.when(~again, F.col("html")).cast("binary").alias("payload"),
    )


def target_of(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{target_of(url)}')}>"


def record(page_id: int | None, url: str | None, digest: str, kind: str, refers_to: int | None, refers_url: str | None, payload: bytes | None) -> bytes:
    """One WARC/1.1 record, not compressed."""
    target = target_of(url)
    block = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload or b"") + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += ["Content-Type: application/http;msgtype=response"] if kind == "response" else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url)}", f"WARC-Refers-To-Target-URI: {target_of(refers_url)}", f"X-Refers-To-Page: {refers_to}"]
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else b""


def _writer(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(base)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            places, lengths = [], []
            for row in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(row["page_id"], row["url"], row["digest"], row["record_type"], row["refers_to"], row["refers_url"], row["payload"]), GZIP_LEVEL, mtime=0)
                out.write(member)
                places.append(at)
                lengths.append(len(member))
                at += len(member)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([name] * n, pa.string()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _indexer(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(base)
        name, out, at = uuid.uuid4().hex, None, 0
        directory: list[list] = []
        lines: list[list] = []

        def flush():
            nonlocal at
            block = zlib.compress(json.dumps(lines, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 6)
            out.write(block)
            directory.append([lines[0][0], at, len(block)])
            at += len(block)
            lines.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
                lines.append([key, file, offset, length])
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory, ensure_ascii=False).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name]), pa.array([len(directory)], pa.int64())], names=["first_key", "name", "n_blocks"])

    return run


def write(pages: DataFrame, base: str) -> tuple[list[tuple[str, str]], int]:
    """Write archives and index under base; returns (first key, name) of each index file in order of keys, and the archives' bytes.

    That list has a row per index partition (spark.sql.shuffle.partitions), whatever the number of captures.
    """
    fs_spark = pages.sparkSession
    fs_spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(fs_spark._jsc.hadoopConfiguration()).mkdirs(fs_spark._jvm.org.apache.hadoop.fs.Path(base))
    captures = materialise(planned(pages).mapInArrow(_writer(base), "key string, file string, offset long, length long"), "warc-captures")
    ordered = captures.repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    files = materialise(ordered.mapInArrow(_indexer(base), "first_key string, name string, n_blocks long"), "warc-directory")
    size = captures.agg(F.sum("length")).first()[0] or 0
    return sorted((r["first_key"], r["name"]) for r in files.select("first_key", "name").collect()), size


class Index:
    """One reader of an index: holds a few directories, blocks and open archives at a time."""

    def __init__(self, base: str, files: list[tuple[str, str]]):
        self.fs, self.root = _open_fs(base)
        self.firsts, self.names = [f for f, _ in files], [n for _, n in files]
        self.directories: OrderedDict[str, list] = OrderedDict()
        self.blocks: OrderedDict[tuple, list] = OrderedDict()
        self.handles: OrderedDict[str, object] = OrderedDict()

    def _kept(self, store: OrderedDict, key, make, most: int):
        if key in store:
            store.move_to_end(key)
        else:
            store[key] = make()
            if len(store) > most:
                old = store.popitem(last=False)[1]
                if hasattr(old, "close"):
                    old.close()
        return store[key]

    def read(self, file: str, offset: int, length: int) -> bytes:
        h = self._kept(self.handles, file, lambda: self.fs.open_input_file(f"{self.root}/{file}"), OPEN_FILES)
        return h.read_at(length, offset)

    def directory(self, name: str) -> list:
        def make():
            with self.fs.open_input_file(f"{self.root}/{name}.dir") as d:
                return json.loads(zlib.decompress(d.read()))

        return self._kept(self.directories, name, make, 4)

    def block(self, name: str, k: int) -> list:
        _, at, length = self.directory(name)[k]
        return self._kept(self.blocks, (name, k), lambda: json.loads(zlib.decompress(self.read(f"{name}.cdx.gz", at, length))), 8)

    def find(self, key: str) -> Iterator[list]:
        """All index lines of a key: equal keys may run on over blocks and files."""
        f = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while f < len(self.names) and (self.firsts[f] <= key):
            entries = self.directory(self.names[f])
            k = max(bisect.bisect_left(entries, key, key=lambda e: e[0]) - 1, 0)
            while k < len(entries) and entries[k][0] <= key:
                lines = self.block(self.names[f], k)
                i = bisect.bisect_left(lines, key, key=lambda e: e[0])
                while i < len(lines) and lines[i][0] == key:
                    yield lines[i]
                    i += 1
                k += 1
            f += 1


_FOUND = "page_id long, record_type string, refers_to long, header_digest string, payload_bytes long, payload_digest string"


def lookup(keys: DataFrame, base: str, files: list[tuple[str, str]], size: int) -> DataFrame:
    """The records of distinct keys (column key), read back from the archives: one row per record. Keys are small and what they
    make a task read is not: they are dealt over a task for every TASK_BYTES of the archives' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(base, files)
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for _, file, offset, length in index.find(key):
                    head, payload = parse(gzip.decompress(index.read(file, offset, length)))
                    page = head.get("X-Page-Id")
                    whole = head["WARC-Type"] == "response"
                    rows.append((None if page is None else int(page), head["WARC-Type"], int(head["X-Refers-To-Page"]) if not whole else None, head["WARC-Payload-Digest"][7:], len(payload) if whole else None, hashlib.sha256(payload).hexdigest() if whole else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "record_type", "refers_to", "header_digest", "payload_bytes", "payload_digest"])

    return keys.select("key").distinct().repartitionByRange(max(1, -(-size // TASK_BYTES)), "key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages, then read every one back through the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    base = work_dir(pages.sparkSession, "warc")
    files, size = write(pages, base)
    keys = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    found = materialise(lookup(keys, base, files, size), "warc-found")
    first = found.where("record_type = 'response'").select(F.col("page_id").alias("r"), F.col("payload_digest").alias("rd"), F.col("payload_bytes").alias("rb")).where("r is not null").distinct()
    back = found.join(first, (found.refers_to == first.r) & (found.header_digest == first.rd), "left")
    return back.select("page_id", F.coalesce("payload_bytes", "rb").alias("payload_bytes"), F.coalesce("payload_digest", "rd").alias("payload_digest"), "record_type", "refers_to")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
g AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= {MIN_PAYLOAD} GROUP BY d HAVING count(*) > 1 AND min(page_id) IS NOT NULL)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND p.page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND p.page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d"""
