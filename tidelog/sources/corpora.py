"""Log corpora: made from the warehouse tables by expressions that Spark and a SQL oracle share, and synthetic files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Placeholders that differ between the engines: timestamps by layout, arrays.
_SPARK = {
    "iso": "date_format({t}, 'yyyy-MM-dd HH:mm:ss.SSS')", "isoc": "date_format({t}, 'yyyy-MM-dd HH:mm:ss,SSS')", "isot": "date_format({t}, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "plain": "date_format({t}, 'yyyy-MM-dd HH:mm:ss')", "slash": "date_format({t}, 'yyyy/MM/dd HH:mm:ss')", "access": "date_format({t}, 'dd/MMM/yyyy:HH:mm:ss')",
    "dj": "date_format({t}, 'dd/MMM/yyyy HH:mm:ss')", "jul": "date_format({t}, 'MMM d, yyyy h:mm:ss a')", "sys": "date_format({t}, 'MMM dd HH:mm:ss')", "apache": "date_format({t}, 'EEE MMM dd HH:mm:ss.SSS yyyy')",
}
_DUCK = {
    "iso": "strftime({t}, '%Y-%m-%d %H:%M:%S.%g')", "isoc": "strftime({t}, '%Y-%m-%d %H:%M:%S,%g')", "isot": "strftime({t}, '%Y-%m-%dT%H:%M:%S')",
    "plain": "strftime({t}, '%Y-%m-%d %H:%M:%S')", "slash": "strftime({t}, '%Y/%m/%d %H:%M:%S')", "access": "strftime({t}, '%d/%b/%Y:%H:%M:%S')",
    "dj": "strftime({t}, '%d/%b/%Y %H:%M:%S')", "jul": "strftime({t}, '%b %-d, %Y %-I:%M:%S %p')", "sys": "strftime({t}, '%b %d %H:%M:%S')", "apache": "strftime({t}, '%a %b %d %H:%M:%S.%g %Y')",
}
_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
_LOW = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END"
_E = "cast(event_id as string)"
_U = "cast(user_id as string)"
_APP = f"<iso> || ' [worker-' || cast(event_id % 4 as string) || '] ' || {_LEVEL} || ' com.example.shop.Cart - ' || event_type || ' of user ' || {_U} || ' line ' || {_E}"
_STACK = f"CASE WHEN event_type = 'error' THEN <[>{_APP}, 'java.lang.IllegalStateException: no stock for ' || {_U}, chr(9) || 'at com.example.shop.Cart.total(Cart.java:' || cast(event_id % 90 + 1 as string) || ')', chr(9) || 'at com.example.Main.main(Main.java:7)'<]> ELSE <[>{_APP}<]> END"
_FORMATS = [
    f"{_APP}",
    f"<jul> || ' com.example.Shop sell'",
    f"<isoc> || ' - shop.cart - ' || {_LEVEL} || ' - event ' || {_E}",
    f"<slash> || ' main.go:' || {_E} || ': served ' || {_U}",
    f"'{{\"level\":\"' || {_LOW} || '\",\"msg\":\"event ' || {_E} || '\"}}'",
    f"'10.0.0.' || cast(user_id % 250 as string) || ' - - [' || <access> || ' +0000] \"GET /item/' || {_E} || ' HTTP/1.1\" 200 ' || cast(event_id % 999 as string)",
    f"<slash> || ' [' || {_LOW} || '] 12#3: *' || {_E} || ' upstream'",
    f"'[' || <apache> || '] [core:' || {_LOW} || '] [pid ' || {_E} || '] AH00128'",
    f"'[' || <plain> || '] production.' || {_LEVEL} || ': event ' || {_E}",
    f"'[' || <plain> || ' +0000] [' || {_E} || '] [' || {_LEVEL} || '] Booting worker'",
    f"<iso> || ' +00:00 [INF] event ' || {_E}",
    f"'<34>' || <sys> || ' host1 app[' || {_E} || ']: user ' || {_U}",
    f"<plain> || ' started job ' || {_E}",
]
_CASE = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_FORMATS))
_RED = "chr(27) || '[1;3' || cast(event_id % 8 as string) || 'm'"
#: corpus: (path, array of lines) over events; lines of a file are ordered by event_id, then place in the array.
CORPORA = {
    "app": ("'/logs/app/app-' || cast(user_id % 8 as string) || '.log'", _STACK),
    "formats": ("'/logs/f/file-' || cast(event_id % 13 as string) || '.log'", f"<[>CASE event_id % 13 {_CASE} END<]>"),
    "jul": ("'/logs/jul-' || cast(user_id % 4 as string) || '.log'", f"<[>{_FORMATS[1]}, CASE event_type WHEN 'error' THEN 'SEVERE: ' WHEN 'view' THEN 'FINE: ' WHEN 'purchase' THEN 'WARNING: ' ELSE 'INFO: ' END || event_type || ' ' || {_E}<]>"),
    "coloured": ("'/logs/c-' || cast(user_id % 4 as string) || '.log'", f"<[>chr(27) || ']0;title' || chr(7) || <iso> || ' [main] ' || {_RED} || {_LEVEL} || chr(27) || '[0m Shop - ' || chr(27) || '[38;5;196m' || event_type || chr(27) || '[39m ' || {_E}<]>"),
    "mixed": ("'/logs/m-' || cast(event_id % 20 as string) || '.log'", f"<[>CASE WHEN (event_id / 20) % 20 < event_id % 20 + 0.5 THEN <plain> || ' tick ' || {_E} ELSE 'noise ' || {_E} END<]>"),
    "ties": ("'/logs/t-' || cast(event_id % 2 as string) || '.log'", f"<[>CASE WHEN event_id % 2 = 0 THEN {_APP} ELSE {_FORMATS[6]} END<]>"),
    "ragged": ("'/logs/r-' || cast(user_id % 4 as string) || '.log'", f"<[>{_APP} || chr(13), '', '   ', '  wrapped ' || {_E}, CASE WHEN event_id % 3 = 0 THEN 'SEVERE: lost ' || {_E} ELSE 'plain words ' || {_E} END<]>"),
}


def _fill(text: str, marks: dict[str, str], left: str, right: str) -> str:
    for k, v in marks.items():
        text = text.replace(f"<{k}>", v.replace("{t}", "ts"))
    return text.replace("<[>", left).replace("<]>", right)


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """path, line_no, raw of a corpus."""
    path, lines = (_fill(x, _SPARK, "array(", ")") for x in CORPORA[name])
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select("event_id", F.expr(path).alias("path"), F.posexplode(F.expr(lines)).alias("k", "raw"))
    w = Window.partitionBy("path").orderBy("event_id", "k")
    return rows.select("path", (F.row_number().over(w) - 1).cast("long").alias("line_no"), "raw")


def corpus_sql(name: str) -> str:
    """The same lines for DuckDB, as a query."""
    path, lines = (_fill(x, _DUCK, "[", "]") for x in CORPORA[name])
    return (
        "SELECT path, row_number() OVER (PARTITION BY path ORDER BY event_id, k) - 1 AS line_no, raw FROM "
        f"(SELECT event_id, path, unnest(lines) AS raw, generate_subscripts(lines, 1) AS k FROM (SELECT event_id, {path} AS path, {lines} AS lines FROM events))"
    )


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `app` corpus as files of 1, 3, 5, .. lines: slice k of a log has its lines k * k to (k + 1) * (k + 1) - 1."""
    k = F.floor(F.sqrt("line_no")).cast("long")
    return corpus(spark, sf_dir, "app").select(F.concat("path", F.lit("."), k.cast("string")).alias("path"), (F.col("line_no") - k * k).alias("line_no"), "raw")


SLICES_SQL = f"SELECT path || '.' || k::VARCHAR AS path, line_no - k * k AS line_no, raw FROM (SELECT *, floor(sqrt(line_no))::BIGINT AS k FROM ({corpus_sql('app')}))"

#: Files of the `app` corpus that are rewritten, and from which line on their new text is taken.
REWRITTEN, REWRITTEN_FROM = "regexp_extract(path, '([0-9])[.]log$', 1) IN ('1', '3', '5', '7')", 90


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `app` corpus after half of its files were replaced by what followed their first lines."""
    c = corpus(spark, sf_dir, "app")
    return c.where(f"NOT ({REWRITTEN})").unionByName(c.where(REWRITTEN).where(F.col("line_no") >= REWRITTEN_FROM).withColumn("line_no", F.col("line_no") - REWRITTEN_FROM))


REWRITTEN_SQL = f"SELECT path, CASE WHEN {REWRITTEN} THEN line_no - {REWRITTEN_FROM} ELSE line_no END AS line_no, raw FROM ({corpus_sql('app')}) WHERE NOT ({REWRITTEN}) OR line_no >= {REWRITTEN_FROM}"


def write_logs(lines: DataFrame, folder: str) -> int:
    """Writes each path's lines as one text file of its name into folder, which all tasks see; gives the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(folder)
        fs.create_dir(where, recursive=True)
        name = out = None
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != name:
                    if out is not None:
                        out.close()
                    name, out = path, fs.open_output_stream(f"{where}/{path.rsplit('/', 1)[-1]}")
                    yield pa.RecordBatch.from_pydict({"path": [path]})
                out.write(f"{raw}\n".encode())
        if out is not None:
            out.close()

    return lines.repartition("path").sortWithinPartitions("path", "line_no").select("path", "raw").mapInArrow(run, "path string").count()


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: no format, some level words."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).withColumn("line_no", F.col("line_no").cast("long"))


PROSE_SQL = "SELECT '/docs/' || doc_id::VARCHAR AS path, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log lines of orders: records without a severity."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_format("o_orderdate", "dd/MMM/yyyy:HH:mm:ss")
    raw = F.concat(F.lit("host"), (F.col("o_custkey") % 50).cast("string"), F.lit(" - - ["), day, F.lit(' +0000] "GET /order/'), F.col("o_orderkey").cast("string"), F.lit(' HTTP/1.1" 200 '), (F.col("o_orderkey") % 5000).cast("string"))
    w = Window.partitionBy("path").orderBy("o_orderkey")
    return o.select(F.concat(F.lit("/logs/access-"), (F.col("o_custkey") % 4).cast("string"), F.lit(".log")).alias("path"), "o_orderkey", raw.alias("raw")).select("path", (F.row_number().over(w) - 1).cast("long").alias("line_no"), "raw")


ACCESS_SQL = """SELECT path, row_number() OVER (PARTITION BY path ORDER BY o_orderkey) - 1 AS line_no, raw FROM (SELECT o_orderkey, '/logs/access-' || (o_custkey % 4)::VARCHAR || '.log' AS path,
'host' || (o_custkey % 50)::VARCHAR || ' - - [' || strftime(o_orderdate, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /order/' || o_orderkey::VARCHAR || ' HTTP/1.1" 200 ' || (o_orderkey % 5000)::VARCHAR AS raw FROM orders)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that frames of the `app` corpus and of `frame_lines` may name."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    made = p.select(F.concat(F.lit("/src/com/example/m"), (k % 40).cast("string"), F.lit("/Part"), k.cast("string"), F.lit(".java")).alias("file_path"))
    fixed = spark.createDataFrame([(x,) for x in FIXED_FILES], "file_path string")
    return made.union(fixed)


FIXED_FILES = ("/src/com/example/shop/Cart.java", "/build/gen/com/example/shop/Cart.java", "/src/com/other/Cart.java", "/src/com/example/Main.java", "/build/Main.java", "/logs/tools/run.py", "/srv/app/index.js", "/logs/lib/deep/Thing.kt")
CATALOG_SQL = "SELECT '/src/com/example/m' || (p_partkey % 40)::VARCHAR || '/Part' || p_partkey::VARCHAR || '.java' AS file_path FROM part UNION ALL SELECT unnest([" + ", ".join(f"'{x}'" for x in FIXED_FILES) + "])"
_FRAME = (
    "CASE event_id % 7 WHEN 0 THEN '  File \"tools/run.py\", line ' || <n> || ', in main' WHEN 1 THEN '#0 /var/www/Kernel.php(' || <n> || '): handle()' "
    "WHEN 2 THEN '    at handle (/srv/app/index.js:' || <n> || ':9)' WHEN 3 THEN 'see ../logs/lib/deep/Thing.kt:' || <n> WHEN 4 THEN chr(9) || 'at com.example.m' || <m> || '.Part' || <p> || '.run(Part' || <p> || '.java:' || <n> || ')' "
    "WHEN 5 THEN 'nothing here ' || <n> ELSE 'x (Main.java:' || <n> || ')' END"
)
FRAME_LINE = _FRAME.replace("<n>", "cast(event_id % 400 as string)").replace("<m>", "cast((event_id % 2000 + 1) % 40 as string)").replace("<p>", "cast(event_id % 2000 + 1 as string)")


def frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("path").orderBy("event_id")
    return e.select("event_id", F.lit("/logs/app.log").alias("path"), F.expr(FRAME_LINE).alias("raw")).withColumn("path", F.concat(F.lit("/logs/app"), (F.col("event_id") % 5).cast("string"), F.lit(".log"))).select("path", (F.row_number().over(w) - 1).cast("long").alias("line_no"), "raw")


FRAME_SQL = f"SELECT path, row_number() OVER (PARTITION BY path ORDER BY event_id) - 1 AS line_no, raw FROM (SELECT event_id, '/logs/app' || (event_id % 5)::VARCHAR || '.log' AS path, {FRAME_LINE} AS raw FROM events)"


def big_log(spark: SparkSession, records: int, path: str = "/logs/big.log") -> DataFrame:
    """A deterministic log of any size: levels, threads and loggers go round, each ERROR brings three stack lines."""
    i = F.col("id")
    def pick(values: list[str], k: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))

    level = pick(["INFO", "DEBUG", "INFO", "WARN", "INFO", "DEBUG", "INFO", "ERROR"], i)
    clock = F.format_string("2026-10-01 %02d:%02d:%02d.%03d", F.floor(i / 60000) + 9, F.floor(i / 1000) % 60, F.floor(i / 17) % 60, i % 1000)
    head = F.concat(clock, F.format_string(" [worker-%d] ", i % 16), level, F.lit(" "), pick(["com.example.Api", "com.example.Db", "com.example.Cache", "com.example.Auth", "com.example.Jobs"], i), F.format_string(" - handled request %d in %d ms", i, i % 977))
    stack = F.array(F.lit("java.lang.IllegalStateException: request failed"), F.lit("\tat com.example.Api.handle(Api.java:42)"), F.lit("\tat com.example.Server.run(Server.java:7)"))
    lines = F.when(level == "ERROR", F.concat(F.array(head), stack)).otherwise(F.array(head))
    # errors so far are every eighth record, so numbers need no window
    first = i + 3 * F.floor(i / 8)
    # a path that the optimizer knows would turn joins on it into products
    return spark.range(records).select(F.when(i >= 0, F.lit(path)).alias("path"), first.cast("long").alias("first"), F.posexplode(lines).alias("k", "raw")).select("path", (F.col("first") + F.col("k")).alias("line_no"), "raw")
