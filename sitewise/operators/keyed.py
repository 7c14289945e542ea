"""Helpers of Arrow tasks that read rows ordered by key, one run of equal keys after the other."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def key_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Runs of rows with equal keys: (key, whether it goes on from the run before, rows)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in keys:
            codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            change[1:] |= codes[1:] != codes[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(low, high - low)
            key = tuple(part.column(k)[0].as_py() for k in keys)
            yield key, key == last, part
            last = key


def output_schema(df: DataFrame, columns: Sequence[str], more: Sequence[tuple[str, str]]) -> tuple[pa.Schema, str]:
    """Arrow schema and Spark schema of some columns of ``df`` followed by (name, kind) ones."""
    kinds = {"binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    kept = df.select(*columns).schema
    arrow = to_arrow_schema(kept)
    for name, kind in more:
        arrow = arrow.append(pa.field(name, kinds[kind]))
    return arrow, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` {k}" for n, k in more])
