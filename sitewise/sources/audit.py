"""File checks: rows that do not fit the header, gzip streams that break, sizes."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.sources.tables import header_of

# quoted parts; an opening quote without its partner reaches to the end of the line
_QUOTED = r'"[^"]*("|$)'


def _fields(line: Column) -> Column:
    """Number of comma-separated fields, commas in double quotes left out: one pass over the line."""
    bare = F.regexp_replace(line, _QUOTED, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose field count differs from the header: (file, row_text, n_fields, expected)."""
    header = header_of(spark, path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    n = _fields(F.col("value"))
    return (lines.where((F.trim("value") != "") & (n != len(header)))
            .select("file", F.col("value").alias("row_text"), n.alias("n_fields"),
                    F.lit(len(header)).alias("expected")))


def file_report(spark: SparkSession, path: str, expected_bytes: Mapping[str, int] | None = None,
                low: float = 0.6) -> DataFrame:
    """Per file: size, data rows, malformed rows, and whether it is far below its expected size.

    ``expected_bytes`` maps a file name to its usual size; the size check is advice,
    a malformed row is what shows a broken write.
    """
    header = header_of(spark, path)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    n = _fields(F.col("value"))
    filled = F.trim("value") != ""
    report = lines.groupBy("file").agg(
        F.max("bytes").alias("bytes"),
        F.count(F.when(filled & (F.replace("value", F.lit('"'), F.lit("")) != ",".join(header)), 1)).alias("n_rows"),
        F.count(F.when(filled & (n != len(header)), 1)).alias("n_malformed"))
    name = F.element_at(F.split("file", "/"), -1)
    usual = F.lit(None).cast("long")
    for f, size in (expected_bytes or {}).items():
        usual = F.when(name == f, F.lit(size).cast("long")).otherwise(usual)
    return report.withColumn("small", F.coalesce(F.col("bytes") < usual * low, F.lit(False)).cast("int"))


def _inflate(path: str) -> tuple[int, bool, str]:
    """Count the lines of one gzip file, block by block; stop where the stream breaks."""
    if "://" in path:
        store, inner = pafs.FileSystem.from_uri(path)
    elif path.startswith("file:"):
        store, inner = pafs.LocalFileSystem(), path[5:]
    else:
        store, inner = pafs.LocalFileSystem(), path
    lines, tail = 0, b""
    decoder = zlib.decompressobj(wbits=31)
    try:
        with store.open_input_stream(inner, compression=None) as f:
            while block := f.read(1 << 20):
                while block:
                    text = decoder.decompress(block, 1 << 20)    # a block may inflate a thousandfold
                    lines += text.count(b"\n")
                    tail = text[-1:] or tail
                    block = decoder.unconsumed_tail
                    if decoder.eof:                       # another member may follow
                        block = decoder.unused_data
                        if block:
                            decoder = zlib.decompressobj(wbits=31)
        if not decoder.eof:
            return lines, False, "stream ends early"
        return lines + (tail not in (b"", b"\n")), True, ""
    except (zlib.error, OSError, EOFError) as e:
        return lines, False, str(e)


def gzip_audit(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, ok, n_lines, error) per gzip file; every file is read through by one task.

    Gzip cannot be split, so a file is the unit of work; memory stays at one block.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *_inflate(p)) for p in pdf["path"]]
            yield pd.DataFrame([(p, ok, n, e) for p, n, ok, e in rows], columns=["path", "ok", "n_lines", "error"])

    frame = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return frame.mapInPandas(work, "path string, ok boolean, n_lines long, error string")


# tasks get this module's functions by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
