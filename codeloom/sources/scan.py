"""Source trees as a Spark data source, ignore patterns, and parsed relations of what was scanned."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.functions import exprs as X

FILES = "path string, relative_path string, size long, modified timestamp, extension string, content string, scan_seq long"


def pattern_regex(pattern: str) -> tuple[re.Pattern, bool, bool] | None:
    """(regex over relative paths, negated, directories only) of a gitignore line; None for blanks and comments."""
    line = pattern.rstrip("\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith("\\") and line[1:2] in ("!", "#") else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, k = "", 0
    while k < len(line):
        if line.startswith("**/", k):
            out += "(?:.*/)?"
            k += 3
        elif line.startswith("/**", k) and k + 3 == len(line):
            out += "/.+"
            k += 3
        elif line.startswith("**", k):
            out += ".*"
            k += 2
        elif line[k] == "*":
            out += "[^/]*"
            k += 1
        elif line[k] == "?":
            out += "[^/]"
            k += 1
        elif line[k] == "[" and "]" in line[k + 2 :]:
            end = line.index("]", k + 2)
            body = line[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            k = end + 1
        elif line[k] == "\\" and k + 1 < len(line):
            out += re.escape(line[k + 1])
            k += 2
        else:
            out += re.escape(line[k])
            k += 1
    return re.compile(f"{'' if anchored else '(?:.*/)?'}{out}"), negated, only_dirs


class Ignore:
    """Whether a relative path is left out: the last pattern that matches decides, and nothing comes
    back from under a folder that is left out. ``node_modules`` and ``.git`` go wherever they occur in a path."""

    def __init__(self, patterns: list[str]):
        self.rules = [r for r in map(pattern_regex, patterns) if r]

    @classmethod
    def of(cls, root: str, patterns: list[str]) -> Ignore:
        """Configured patterns, then those of the root's .gitignore, if there is one."""
        try:
            own = Path(root, ".gitignore").read_text("utf-8").split("\n")
        except OSError:
            own = []
        return cls([*patterns, *own])

    def _matches(self, path: str, is_dir: bool) -> bool:
        left_out = False
        for regex, negated, only_dirs in self.rules:
            if (is_dir or not only_dirs) and regex.fullmatch(path):
                left_out = not negated
        return left_out

    def __call__(self, path: str, is_dir: bool) -> bool:
        if "node_modules" in path or ".git" in path:
            return True
        parts = path.split("/")
        return any(self._matches("/".join(parts[:k]), True) for k in range(1, len(parts))) or self._matches(path, is_dir)


def walk(root: str, ignore: Ignore, below: str = "") -> Iterator[tuple[str, str]]:
    """('visited' | 'ignored' | 'file', relative path) of every entry; links are neither files nor folders."""
    with os.scandir(os.path.join(root, below)) as found:
        entries = sorted(found, key=lambda e: e.name)
    for e in entries:
        path = f"{below}/{e.name}" if below else e.name
        is_dir = e.is_dir(follow_symlinks=False)
        yield "visited", path
        if ignore(path, is_dir):
            yield "ignored", path
        elif is_dir:
            yield from walk(root, ignore, path)
        elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1] in X.EXTENSIONS:
            yield "file", path


class TreePartition(InputPartition):
    def __init__(self, names: list[tuple[int, str]]):
        self.names = names


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no such directory: {self.root}")
        self.ignore = Ignore.of(self.root, [p for p in options.get("ignore", "").split("\n") if p])
        self.files_each = int(options.get("filesPerPartition", 256))

    def partitions(self):
        names = [(k, path) for k, (what, path) in enumerate(walk(self.root, self.ignore)) if what == "file"]
        return [TreePartition(names[k : k + self.files_each]) for k in range(0, len(names), self.files_each)] or [TreePartition([])]

    def read(self, partition):
        for seq, name in partition.names:
            full = os.path.join(self.root, name)
            stat = os.stat(full)
            modified = datetime.fromtimestamp(stat.st_mtime, timezone.utc)
            content = Path(full).read_text("utf-8", errors="replace")
            yield full, name, stat.st_size, modified, os.path.splitext(name)[1], content, seq


class TreeSource(DataSource):
    """``spark.read.format("source_tree")``: source files under a folder that driver and executors share, hidden
    and empty ones included, links and ignored paths not. Options: path, ignore (patterns, one a line)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema):
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """Source files under root with their contents; raises FileNotFoundError where root is no directory."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such directory: {root}")
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("ignore", "\n".join(ignore or [])).load(root)


def scan_matching(spark: SparkSession, root: str, pattern: str, ignore: list[str] | None = None) -> DataFrame:
    """Scanned files whose relative path holds a match of the pattern."""
    return scan(spark, root, ignore).filter(F.col("relative_path").rlike(pattern))


def scan_stats(root: str, ignore: list[str] | None = None) -> dict[str, int]:
    """scanned (entries seen), included and ignored."""
    kinds = [what for what, _ in walk(os.path.abspath(root), Ignore.of(root, ignore or []))]
    return {"scanned": kinds.count("visited"), "included": kinds.count("file"), "ignored": kinds.count("ignored")}


def list_directories(path: str) -> dict:
    """Folders below a path by name, and its parent; raises as the operating system does."""
    here = os.path.abspath(path)
    with os.scandir(here) as found:
        names = sorted((e.name for e in found if e.is_dir()), key=str.casefold)
    parent = os.path.dirname(here)
    return {"path": here, "parent": None if parent == here else parent, "directories": [{"name": n, "path": os.path.join(here, n)} for n in names]}


PARSED = (
    "path string, error string, "
    "imports array<struct<type:string,source:string,specifiers:array<string>,dynamic:boolean,line:int>>, "
    "exports array<struct<type:string,specifiers:array<string>,source:string,property:string,line:int>>, "
    "calls array<struct<function:string,line:int>>, "
    "functions array<struct<type:string,name:string,class_name:string,method_name:string,kind:string,is_static:boolean,is_async:boolean,is_generator:boolean,params:int,line:int>>"
)


def parse_files(files: DataFrame, dynamic_imports: bool = False) -> DataFrame:
    """path, error, and arrays of import, export, call and function records of each file's content.

    A file that cannot be parsed has its error and empty arrays.
    """
    from pyspark.sql.types import _parse_datatype_string

    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = _parse_datatype_string(PARSED)
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        from codeloom.functions.jsparse import Parsed, ParseError, parse

        for batch in batches:
            rows = []
            for path, text in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                error, found = None, Parsed()
                try:
                    found = parse(text or "", dynamic_imports)
                except (ParseError, KeyError, IndexError) as why:
                    error = str(why) or "unreadable"
                rows.append({"path": path, "error": error, "imports": found.imports, "exports": found.exports, "calls": found.calls, "functions": found.functions})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, spark_schema)


def parse_cached(files: DataFrame, cache: str, dynamic_imports: bool = False) -> DataFrame:
    """What ``parse_files`` returns, with each content parsed once: what was parsed before is found in the folder ``cache`` by the
    content's digest, and what was not is parsed and added to it. Files of equal content share one entry."""
    spark = files.sparkSession
    schema = spark.createDataFrame([], PARSED.replace("path string", "digest string")).schema
    keyed = files.select("path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.schema(schema).parquet(cache)
        fresh = keyed.join(known.select("digest"), "digest", "left_anti")
    else:
        fresh = keyed
    contents = fresh.groupBy("digest").agg(F.first("content").alias("content"))
    parsed = parse_files(contents.withColumnRenamed("digest", "path"), dynamic_imports).withColumnRenamed("path", "digest")
    parsed.write.mode("append").parquet(cache)
    return keyed.select("path", "digest").join(spark.read.schema(schema).parquet(cache), "digest").drop("digest")


def relations(files: DataFrame, parsed: DataFrame) -> dict[str, DataFrame]:
    """Relations of the code graph: files, imports, exports, functions, calls."""
    at = (F.col("scan_seq") * 1_000_000 + F.col("n")).alias("seq")
    placed = parsed.join(files.select("path", "scan_seq"), "path")

    def rows(column: str) -> DataFrame:
        return placed.select("path", "scan_seq", F.posexplode(column).alias("n", "r")).select("path", at, "r.*")

    dated = ["modified"] if "modified" in files.columns else []
    own = files.select("path", "size", X.lines_of_code("content").alias("loc"), "scan_seq", *dated)
    file_rows = own.join(parsed.select("path", F.col("error").isNotNull().alias("parse_error"), F.col("error").alias("parse_error_message")), "path")
    source = F.col("source")
    imports = rows("imports").filter("source IS NOT NULL AND source <> ''")
    imports = imports.select(
        F.col("path").alias("src"), X.resolve_import(source, F.col("path")).alias("dst"), "line", "type", X.is_external(source).alias("is_external"), "seq"
    )
    name = (
        F.when(F.col("type") == "named", F.col("specifiers"))
        .when(F.col("type") == "default", F.array(F.lit("default")))
        .when(F.col("type") == "all", F.array(F.lit("*")))
        .otherwise(F.array(F.coalesce("property", F.lit("module.exports"))))
    )
    exports = rows("exports").select(F.col("path").alias("src"), F.explode(name).alias("name"), F.col("type").alias("export_type"), "line", "seq")
    functions = rows("functions").withColumn("file", F.col("path")).drop("path")
    calls = rows("calls").select(F.col("path").alias("file"), "function", "line", "seq")
    return {"files": file_rows, "imports": imports, "exports": exports, "functions": functions, "calls": calls}
