"""Words, stored intermediates and the query registry shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.session import scratch_path

#: A word; bytes.split() without argument cuts at the same six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this package; ``sql`` is its DuckDB counterpart."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored_at(df: DataFrame, name: str, codec: str = "snappy", more: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir``; the table read back, and its path.

    Cuts the lineage like a checkpoint, survives lost executors, and the columnar files
    let later steps read only the columns they need. ``more``: further options of the writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression=codec, **(more or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def small_batches(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """``df``, with the session's Arrow batches kept to ``most`` bytes: a task holds a few copies of one."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored_at`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text, empty for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def row_key(*cols: Column | str) -> Column:
    """A 64-bit key of a row's content: rows with equal content share it, and any result."""
    return F.xxhash64(*cols)


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` as one struct ``row`` beside copies of ``columns``: whatever else it holds clashes with nothing."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``most_bytes`` of the binary ``column`` (one row at least)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = filled = 0
        for i, size in enumerate(sizes):
            if i > start and filled + (size or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, filled = i, 0
            filled += size or 0
        if start < len(sizes):
            yield batch.slice(start)
