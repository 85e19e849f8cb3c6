"""Stack frames in lines, and the files that they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The frame shapes and source extensions.
EXTENSIONS = "java|kt|kts|scala|groovy|gradle|py|rb|js|cjs|mjs|ts|tsx|jsx|cs|go|rs|php|cpp|hpp|c|h|m|mm|swift|dart"
PATH_LINE = r"""(?:^|[(\s"@'\[])((?:[A-Za-z]:[\\/]|~?/)?[A-Za-z0-9_.$\-][A-Za-z0-9_.$/\\*\-]*\.(?:""" + EXTENSIONS + r""")):(\d+)(?::(\d+))?"""
PHP_FRAME = r"(?:^|\s)((?:[A-Za-z]:[\\/]|/)?[^\s(:]+\.php)\((\d+)\)"
PYTHON_FRAME = r'File "([^"]+)", line (\d+)(?:, in (\S+))?'
JVM_FRAME = r"(?:^|[^A-Za-z0-9_])at\s+([\w$.]+)\.[\w$<>-]+\("
MAX_DEPTH = 12


def _found(c: Column, pattern: str, rank: int, with_col: bool = False) -> Column:
    """The frames of one shape, left to right, with offsets: each match is looked for from where the one before ended."""
    def group(n: int) -> Column:
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(n))

    whole = group(0)
    at = F.aggregate(
        whole, F.struct(F.lit(1).alias("from"), F.array().cast("array<int>").alias("starts")),
        lambda acc, m: F.struct((F.position(m, c, acc["from"]) + F.length(m)).alias("from"), F.concat(acc["starts"], F.array(F.position(m, c, acc["from"]) - 1)).alias("starts")),
        lambda acc: acc["starts"],
    )
    column = group(3) if with_col else F.transform(whole, lambda _: F.lit(""))
    zipped = F.arrays_zip(whole.alias("w"), group(1).alias("p"), group(2).alias("l"), column.alias("k"), at.alias("a"))
    return F.transform(zipped, lambda z: F.struct(
        F.lit(rank).alias("rank"), (z["a"] + F.position(z["p"], z["w"]) - 1).alias("start"),
        (z["a"] + F.length(z["w"]) - (0 if rank != 0 else F.length(z["w"]) - F.length(F.regexp_extract(z["w"], r'^File "[^"]+", line \d+', 0)))).alias("end"),
        z["p"].alias("frame_path"), z["l"].try_cast("long").alias("frame_line"),
        F.when(z["k"] == "", F.lit(0)).otherwise(F.greatest(F.coalesce(z["k"].try_cast("long"), F.lit(1)) - 1, F.lit(0))).cast("long").alias("frame_col"),
    ))


def package_dir(c: Column, start: Column) -> Column:
    """The package, as a directory, of the JVM frame whose file begins at `start` behind an opening parenthesis."""
    before = F.substr(c, F.lit(1), start)
    qualified = F.try_element_at(F.regexp_extract_all(before, F.lit(JVM_FRAME), F.lit(1)), F.lit(-1))
    named = F.replace(F.regexp_extract(qualified, r"^(.+)\.[^.]*$", 1), F.lit("."), F.lit("/"))
    return F.when(F.endswith(before, F.lit("(")), F.nullif(named, F.lit("")))


def frames(lines: DataFrame) -> DataFrame:
    """path, line_no, start, end, frame_path, frame_line, frame_col, rank, package_dir: every frame of every line.

    A line number that no long holds is null, such a column is 0.
    """
    raw = F.col("raw")
    every = F.concat(_found(raw, PYTHON_FRAME, 0), _found(raw, PHP_FRAME, 1), _found(raw, PATH_LINE, 2, True))
    some = lines.where(raw.rlike(PYTHON_FRAME) | raw.rlike(PHP_FRAME) | raw.rlike(PATH_LINE))
    out = some.select("path", "line_no", "raw", F.explode(every).alias("f")).select("path", "line_no", "raw", "f.*")
    return out.withColumn("package_dir", F.when(F.col("rank") == 2, package_dir(raw, F.col("start")))).drop("raw")


def frame_at(found: DataFrame, column: int) -> DataFrame:
    """The frame at a caret of each line: Python frames before PHP frames before path and line."""
    hit = found.where((F.col("start") <= column) & (F.col("end") > column))
    return hit.groupBy("path", "line_no").agg(F.min_by(F.struct("start", "end", "frame_path", "frame_line", "frame_col", "package_dir"), F.struct("rank", "start")).alias("f")).select("path", "line_no", "f.*")


def _walked(folder: Column, parts: Column) -> Column:
    """Where parts lead from a folder: struct of p, the path of a file (null if they can't lead to one), and needs, folders that
    must be there beside those on p's own way: those that were stepped into and left again by '..'.

    '' and '.' stay where they are; '..' over the root leads nowhere, and so does a way whose last part is no name.
    """
    start = F.struct(folder.alias("p"), F.lit(0).alias("own"), F.array().cast("array<string>").alias("needs"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        up = F.regexp_replace(acc["p"], r"/[^/]*$", "")
        entered = acc["own"] > 0  # what was above the log's own folder before is there, as the log is
        back = F.struct(up.alias("p"), F.greatest(acc["own"] - 1, F.lit(0)).alias("own"), F.when(entered, F.array_append(acc["needs"], acc["p"])).otherwise(acc["needs"]).alias("needs"), (acc["ok"] & (acc["p"] != "")).alias("ok"))
        into = F.struct(F.concat(acc["p"], F.lit("/"), x).alias("p"), (acc["own"] + 1).alias("own"), acc["needs"].alias("needs"), acc["ok"].alias("ok"))
        return F.when((x == "") | (x == "."), acc).when(x == "..", back).otherwise(into)

    named = ~F.element_at(parts, -1).isin("", ".", "..")
    return F.aggregate(parts, start, step, lambda acc: F.struct(F.when(acc["ok"] & named, acc["p"]).alias("p"), F.array_distinct(acc["needs"]).alias("needs")))


def directories(files: DataFrame, column: str = "file_path") -> DataFrame:
    """folder: every directory that lies above one of these paths, once; the root is ''."""
    parts = F.split(F.replace(column, F.lit("\\"), F.lit("/")), "/", -1)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(ups).alias("folder")).distinct()


def resolve(found: DataFrame, catalog: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """found with file_path and how (absolute, relative, name; null if nothing fits). catalog: file_path.

    A relative path is walked part by part: `nodir/../x.py` fits only if the folder nodir is there. A file above which the
    walk passes proves its own folders; folders that the walk left again are looked up in the closure of all directories,
    which `folders` (column folder, see directories()) gives where it is stored, and catalog and logs do otherwise.

    An absolute path as it stands; else relative to the log's directory and its ancestors, nearest first; else by name,
    files of the frame's package before files outside build directories before any, then the shortest path, then by path.
    Frames repeat, so each question (directory, path, package) is asked once: its candidates, MAX_DEPTH + 2 at most, meet the
    files in one equi-join, and the best goes back to the frames.
    """
    norm = F.replace("frame_path", F.lit("\\"), F.lit("/"))
    f = found.withColumn("_norm", norm).withColumn("_folder", F.regexp_replace("path", r"/[^/]*$", ""))
    asked = f.select("_folder", "_norm", F.col("package_dir").alias("_package")).distinct()
    none = F.array().cast("array<struct<how:int,depth:int>>")

    def tried(how: int, depth: Column) -> Column:
        return F.struct(F.lit(how).alias("how"), depth.cast("int").alias("depth"))

    parts, above = F.split("_norm", "/", -1), F.split("_folder", "/", -1)
    bare = F.try_element_at(F.filter(parts, lambda x: (x != "") & (x != ".") & (x != "..")), F.lit(-1))
    # ancestors of the log's directory, nearest first; '' is the root
    ups = F.transform(F.sequence(F.lit(0), F.least(F.size(above), F.lit(MAX_DEPTH)) - 1), lambda k: tried(1, k))
    options = F.concat(
        F.when(F.col("_norm").rlike("^(?:/|[A-Za-z]:/)"), F.array(tried(0, F.lit(0)))).otherwise(none),
        F.when(F.contains("_norm", F.lit("/")) & F.col("_folder").isNotNull(), ups).otherwise(none),
        F.when(F.trim(bare) != "", F.array(tried(2, F.lit(0)))).otherwise(none),
    )
    t = asked.withColumn("_bare", bare).select("*", F.inline(options))
    folder = F.array_join(F.slice(above, F.lit(1), F.size(above) - F.col("depth")), "/")
    t = t.withColumn("_walk", F.when(F.col("how") == 1, _walked(folder, parts)))
    # whole paths and bare names share one join, told apart by their first character
    t = t.withColumn("_key", F.when(F.col("how") == 0, F.concat(F.lit("="), "_norm")).when(F.col("how") == 1, F.concat(F.lit("="), "_walk.p")).otherwise(F.concat(F.lit("~"), "_bare")))
    t = t.withColumn("_needs", F.coalesce("_walk.needs", F.array().cast("array<string>"))).drop("_walk")
    files = catalog.select(F.col("file_path").alias("_file")).distinct()
    files = files.select("_file", F.explode(F.array(F.concat(F.lit("="), "_file"), F.concat(F.lit("~"), F.element_at(F.split("_file", "/", -1), -1)))).alias("_key"))
    inside = F.endswith("_file", F.concat(F.lit("/"), F.col("_package"), F.lit("/"), F.col("_bare")))
    rank = F.when(F.col("how") != 2, 0).when(F.col("_package").isNotNull() & inside, 0).when(~F.col("_file").rlike("/(?:build|out|generated)/"), 1).otherwise(2)
    order = F.struct("how", "depth", rank.alias("rank"), F.length("_file").alias("size"), F.col("_file"))
    question = ["_folder", "_norm", "_package"]
    hits = t.join(files, "_key").withColumn("_n", F.size("_needs"))
    if folders is None:
        folders = directories(catalog).union(directories(found.select(F.col("path").alias("file_path")).distinct())).distinct()
    # candidates whose left folders are all there; those that left none get keys that no folder has, spread by file
    ways = [*question, "how", "depth", "_file", "_bare", "_n"]
    none_left = F.concat(F.lit("?"), F.pmod(F.xxhash64("_file"), F.lit(4096)).cast("string"))
    asks = hits.withColumn("_need", F.explode_outer("_needs")).withColumn("_need", F.coalesce("_need", none_left))
    met = asks.join(folders.select(F.col("folder").alias("_need"), F.lit(1).alias("_there")), "_need", "left")
    hits = met.groupBy(*ways).agg(F.sum("_there").alias("_there")).where(F.coalesce("_there", F.lit(0)) == F.col("_n"))
    best = hits.groupBy(*question).agg(F.min(order).alias("_best"))
    best = best.select(*[F.col(c).alias(f"{c}_asked") for c in question], F.col("_best._file").alias("file_path"), F.get(F.array(F.lit("absolute"), F.lit("relative"), F.lit("name")), F.col("_best.how")).alias("how"))
    same = F.col("_folder").eqNullSafe(F.col("_folder_asked")) & F.col("_norm").eqNullSafe(F.col("_norm_asked")) & F.col("package_dir").eqNullSafe(F.col("_package_asked"))
    return f.join(best, same, "left").select(*found.columns, "file_path", "how")
