"""Readers: locate a table in any of the usual layouts, pin its types, set bad rows aside."""

from __future__ import annotations

from collections.abc import Mapping

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse_type

CORRUPT = "_corrupt_record"


def _listing(folder: str) -> tuple[str, dict[str, int]]:
    """Files below a folder (local, HDFS or object store), relative to it, with their times of change."""
    if "://" not in folder:
        import os
        store, base = pafs.LocalFileSystem(), os.path.abspath(folder)
    else:
        store, base = pafs.FileSystem.from_uri(folder)
    found = store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    return base, {f.path[len(base):].lstrip("/"): f.mtime_ns or 0 for f in found if f.type == pafs.FileType.File}


def _any_case(text: str) -> str:
    """A glob that matches a name whatever its case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() and c.lower() != c.upper() else f"\\{c}" if c in "*?[]{}\\" else c for c in text)


def find_table(spark: SparkSession, root: str, name: str, module: str | None = None, depth: int = 6) -> str | None:
    """Path of ``name``.csv or ``name``.csv.gz below root[/module], or None.

    The file may lie flat or in folders of its own name, ``depth`` folders down at most. The shallowest wins, a
    compressed file before a plain one at the same depth; names compare without case. The store itself matches
    the pattern, one level after the other, and the search ends at the first level with a match: what lies
    deeper, or has another name, is not listed in the driver.
    """
    folder = f"{root.rstrip('/')}/{module}" if module else root.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for level in range(depth + 1):
        for ending in (".csv.gz", ".csv"):
            found = files.globStatus(path(folder + "/*" * level + "/" + _any_case(name + ending)))
            hits = [s.getPath().toString() for s in found or [] if s.isFile()]
            if hits:
                best = min(hits)
                return best.removeprefix("file:") if "://" not in folder else best
    return None


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file; only its first line is read."""
    return spark.read.option("header", True).csv(path).columns


def csv_schema(spark: SparkSession, path: str, types: Mapping[str, str]) -> StructType:
    """The file's own column order with pinned types; other columns stay text."""
    return StructType([StructField(c, parse_type(types[c]) if c in types else StringType())
                       for c in header_of(spark, path)])


def read_csv(spark: SparkSession, path: str, types: Mapping[str, str] | None = None,
             spread: int | None = None) -> DataFrame:
    """CSV with pinned types; a row that does not fit stops the job.

    Types are never guessed from a sample: a column that is empty for thousands of
    rows would come out wrong. A gzip file is one task, so its rows are spread
    over ``spread`` partitions (default: the session's parallelism) after reading.
    """
    df = (spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
          .option("columnPruning", False)       # otherwise unread columns are not checked
          .schema(csv_schema(spark, path, types or {})).csv(path))
    if any(f.endswith(".gz") for f in df.inputFiles()):      # one file or a folder of them
        df = df.repartition(spread or spark.sparkContext.defaultParallelism)
    return df


def read_csv_tolerant(spark: SparkSession, path: str,
                      types: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of a file known to be damaged. Nothing is lost silently:
    the rejected frame holds the text of every row left out."""
    schema = csv_schema(spark, path, types or {})
    names = schema.names
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    # line by line, so that a broken line cannot swallow its neighbours
    lines = spark.read.text(path).where(F.trim("value") != "")
    cells = F.from_csv("value", ", ".join(f"`{c}` string" for c in names))
    header = F.lit(True)
    for c in names:
        header = header & F.coalesce(cells[c] == c, F.lit(False))
    row = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields),
                     {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    raw = lines.where(~header).select("value", row.alias("r"))
    fields = [F.col("r").getField(c).alias(c) for c in names]
    broken = F.col("r").getField(CORRUPT).isNotNull()
    return raw.where(~broken).select(*fields), raw.where(broken).select(F.col("value").alias("row_text"), *fields)


def read_table(spark: SparkSession, root: str, name: str, module: str | None = None,
               types: Mapping[str, str] | None = None) -> DataFrame:
    path = find_table(spark, root, name, module)
    if path is None:
        raise FileNotFoundError(f"no {name}.csv or {name}.csv.gz below {root}" + (f"/{module}" if module else ""))
    return read_csv(spark, path, types)


def read_optional(spark: SparkSession, root: str, name: str, schema: str, module: str | None = None) -> DataFrame:
    """The table, or an empty frame of the same columns where it does not exist.

    Only a missing table is forgiven; an unreadable one still fails.
    """
    path = find_table(spark, root, name, module)
    if path is None:
        return spark.createDataFrame([], schema)
    types = {f.name: f.dataType.simpleString() for f in parse_type(schema).fields}
    return read_csv(spark, path, types).select(*types)


def latest_run(spark: SparkSession, root: str, name: str, prefix: str = "run_") -> DataFrame:
    """Rows of ``name`` from every run folder, with ``run``, ``modified`` and ``is_latest``.

    The newest run is found from the files' times alone; filtered by ``is_latest``, only its rows are read.
    """
    folder, files = _listing(root)
    runs = {f.split("/", 1)[0]: 0 for f in files if f.startswith(prefix) and f"/{name}" in f}
    if not runs:
        raise FileNotFoundError(f"no {prefix}*/{name} below {root}")
    rows = (spark.read.option("header", True).csv(f"{root.rstrip('/')}/{prefix}*/{name}")
            .select("*", F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_modification_time").alias("modified")))
    rows = rows.withColumn("run", F.regexp_extract("_file", f"/({prefix}[^/]*)/", 1)).drop("_file")
    for f, changed in files.items():
        if (run := f.split("/", 1)[0]) in runs and f"/{name}" in f and not f.rsplit("/", 1)[-1].startswith((".", "_")):
            runs[run] = max(runs[run], changed // 1_000_000)       # times in Spark have this grain or a finer one
    newest = max(runs, key=lambda r: (runs[r], r))
    return rows.withColumn("is_latest", F.col("run") == newest)
