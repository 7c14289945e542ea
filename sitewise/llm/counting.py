"""How often keys occur in the whole corpus, asked by chunk and answered by hash range.

A chunk of documents sends its sorted distinct keys, cut by range, as packed arrays. The task
of a range merges the sorted runs of all chunks, counts equal keys and answers every chunk
with a packed array. A key that is everywhere reaches its range once for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE_KEYS = 1_000_000
COUNT = np.uint16


def frequencies(chunks: DataFrame, total: int) -> DataFrame:
    """(chunk, df) for (chunk, keys): for each of the chunk's sorted distinct keys, in how many rows it occurs.

    ``keys`` and ``df`` are packed arrays (8 bytes an entry, and the size of ``COUNT``); ``times`` has the
    occurrences inside the chunk. Counts stop at the largest ``COUNT``. ``total`` keys in all decide into
    how many ranges the hash space is cut, so that a range holds about RANGE_KEYS of them.
    """
    ranges = max(8, -(-total // RANGE_KEYS))
    width = np.uint64((1 << 64) // ranges + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, times in zip(*(batch.column(c).to_pylist() for c in ("chunk", "keys", "times")), strict=True):
                keys, counts = np.frombuffer(raw, np.uint64), np.frombuffer(times, COUNT)
                cuts = np.searchsorted(keys, np.arange(1, ranges, dtype=np.uint64) * width)
                parts = [(r, a, b) for r, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)])) if b > a]
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([r for r, _, _ in parts], pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int64()),
                    "keys": pa.array([keys[a:b].tobytes() for _, a, b in parts], pa.binary()),
                    "times": pa.array([counts[a:b].tobytes() for _, a, b in parts], pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        raws = group.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(raws), np.uint64)
        times = np.frombuffer(b"".join(group.column("times").to_pylist()), COUNT)
        order = np.argsort(keys, kind="stable")      # a merge of the chunks' sorted runs
        fresh = np.r_[True, keys[order][1:] != keys[order][:-1]]
        sums = np.minimum(np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(fresh)), np.iinfo(COUNT).max).astype(COUNT)
        df = np.empty(len(keys), COUNT)
        df[order] = sums[np.cumsum(fresh) - 1]
        ends = np.cumsum([len(r) // 8 for r in raws])
        return pa.table({"chunk": group.column("chunk"), "range": group.column("range"),
                         "df": pa.array([df[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)], pa.binary())})

    asked = chunks.select("chunk", "keys", "times").mapInArrow(ask, "range int, chunk long, keys binary, times binary")
    answers = asked.groupBy("range").applyInArrow(answer, "chunk long, range int, df binary")
    # a chunk has as many answers as there are ranges it touches, at most one for each of its keys
    ordered = F.array_sort(F.collect_list(F.struct("range", "df")))
    return (answers.groupBy("chunk").agg(ordered.alias("parts"))
            .select("chunk", F.transform("parts", lambda p: p["df"]).alias("df")))


def _chunk(sets: list[np.ndarray]) -> tuple[bytes, bytes, bytes, bytes]:
    """Sets as (distinct keys, times, sizes, indices): each set is a run of indices into the keys."""
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    keys, index, times = np.unique(every, return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets], np.int32)
    return (keys.tobytes(), np.minimum(times, np.iinfo(COUNT).max).astype(COUNT).tobytes(), sizes.tobytes(),
            index.astype(np.int32).tobytes())


CHUNK = "n_keys long, keys binary, times binary, sizes binary, index binary"


def chunk_batch(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    keys, times, sizes, index = _chunk(sets)
    return pa.RecordBatch.from_pydict({
        "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "n_keys": pa.array([len(keys) // 8], pa.int64()),
        **{c: pa.array([v], pa.binary()) for c, v in (("keys", keys), ("times", times), ("sizes", sizes), ("index", index))}})


def answered(chunks: DataFrame) -> DataFrame:
    """Stored chunks with the frequencies of their keys as ``df`` (packed parts)."""
    total = chunks.agg(F.sum("n_keys")).first()[0] or 0
    return chunks.drop("times").join(frequencies(chunks, total), "chunk")
