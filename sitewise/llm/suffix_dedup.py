"""Removal of repeated byte strings by counting the strings at anchors, shard by shard.

Merging the Burrows-Wheeler transforms of shards byte by byte refines the interleave once for
every byte of context: 400 passes over all suffixes for a threshold of 400 bytes. This is
another way (see the README): no transform is built. A string start is an anchor if the
smallest hash among the next M short strings is there, so equal strings have equal anchors,
and 64-bit hashes of what lies at the anchors are counted over all shards, in hash order:

1. of the bytes that every string with this anchor shares (its core): where a core occurs
   once, nothing repeats, and its anchor is done;
2. of all bytes that the strings of the anchor cover together: if the cover occurs as often
   as the core, every string in it is repeated, in one step;
3. of the single strings, only for anchors whose cores have different covers.

Shards send their sorted hashes once for each step; the task of a hash range merges the sorted
runs, and answers carry the counts back. A string that is in many shards costs one entry for
each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import discard, documents, query, slices, small_batches, stored_at, text_bytes
from sitewise.llm.counting import COUNT, frequencies

LENGTH, WINDOW, GRAM = 400, 128, 16         # bytes of a repeat, strings an anchor is the smallest of, their bytes
SHARD_BYTES = 2_000_000
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            row = np.full(max(n, SHARD_BYTES + 1), base, np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


class Shard:
    """Texts of a shard, with hashes of any of their substrings."""

    def __init__(self, raw: bytes, sizes: np.ndarray):
        self.bytes = np.frombuffer(raw, np.uint8)
        self.sizes = sizes
        self.ends = np.cumsum(sizes)
        up, self.down = _power(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[:len(raw)], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def suffixes(self, length: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """(first, last, core, cover): for each anchor the string starts first..last that share it, and two hashes."""
        n = len(self.bytes)
        none = np.zeros(0, np.int64)
        if n < length:
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        at = np.arange(n - gram + 1)
        least = self.hash(at, at + gram)
        where = at.astype(np.int32)
        width = 1
        while width < window:       # smallest of the next ``window`` (a power of two), the leftmost of equals
            later = least[width:] < least[:-width]
            least = np.where(later, least[width:], least[:-width])
            where = np.where(later, where[width:], where[:-width])
            width *= 2
        start = np.concatenate([np.arange(end - size, end - length + 1) for size, end in zip(self.sizes, self.ends) if size >= length]
                               or [none])
        if not len(start):
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        anchor = where[start].astype(np.int64)
        fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
        head = np.flatnonzero(fresh)
        first, last, anchor = start[head], start[np.r_[head[1:], len(start)] - 1], anchor[head]
        core = self.hash(anchor, anchor + length - window + 1)
        cover = self.hash(first, last + length) + (last - first).astype(np.uint64) * np.uint64(_ODD)
        return first, last, core, _mix(cover ^ np.uint64(1))

    def removed(self, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
        """Mask of the bytes in strings that start in first..last."""
        n = len(self.bytes) + 1
        edges = np.bincount(first, minlength=n) - np.bincount(last + length, minlength=n)
        return np.cumsum(edges)[:-1] > 0


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the runs first..last."""
    sizes = last - first + 1
    return np.repeat(first - np.r_[0, np.cumsum(sizes)][:-1], sizes) + np.arange(int(sizes.sum()))


def _runs(keys: np.ndarray) -> dict[str, pa.Array]:
    keys, times = np.unique(keys, return_counts=True)
    return {"keys": pa.array([keys.tobytes()], pa.binary()), "n_keys": pa.array([len(keys)], pa.int64()),
            "times": pa.array([np.minimum(times, np.iinfo(COUNT).max).astype(COUNT).tobytes()], pa.binary())}


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_ROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept_sha256", pa.string())])


def _results(ids: list, shard: Shard, gone: np.ndarray, which: np.ndarray) -> list[tuple]:
    rows = []
    for i in which:
        end = int(shard.ends[i])
        own, mask = shard.bytes[end - int(shard.sizes[i]):end], gone[end - int(shard.sizes[i]):end]
        spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if len(mask) else 0
        kept = own[~mask].tobytes() if spans else own.tobytes()
        rows.append((ids[i], len(own), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def _columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema.types), schema.types)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text
    or another; overlaps count, and matches never cross texts. A null text is empty; texts shorter than
    ``length`` stay whole; of repeated rows every one is a repeat of the other. Strings are compared by
    64-bit hashes. ``window`` (a power of two) + ``gram`` must not exceed ``length``.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_BYTES):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                "text": pa.array([b"".join(texts)], pa.binary())})

    shards = rows.mapInArrow(gather, "ids array<long>, sizes array<long>, text binary")
    shards, path = stored_at(shards.withColumn("chunk", F.monotonically_increasing_id()), "suffix-shards", "zstd")

    def opened(row: dict) -> Shard:
        return Shard(row["text"], np.array(row["sizes"], np.int64))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, core, cover = opened(row).suffixes(length, window, gram)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([row["chunk"]], pa.int64()), **_runs(np.r_[core, cover])})

    lists = shards.mapInArrow(sort, "chunk long, keys binary, n_keys long, times binary")
    # an anchor is the smallest of ``window`` strings on either side, so one in (window + 1) / 2, with two keys each
    size = shards.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    merged = frequencies(lists, 4 * size // (window + 1))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = opened(row)
                first, last, core, cover = shard.suffixes(length, window, gram)
                every, place = np.unique(np.r_[core, cover], return_inverse=True)
                count = np.frombuffer(b"".join(row["df"] or []), COUNT).astype(np.int64)
                if not len(every):
                    count = np.zeros(0, np.int64)
                in_core, in_cover = count[place[:len(core)]], count[place[len(core):]]
                whole = in_cover > 1
                # a core is split if some of its anchors have other covers
                split = (in_core > 1) & ((in_cover < in_core) | (in_core == np.iinfo(COUNT).max))
                ask = spread(first[split], last[split])
                # a text waits for step 3 if one of its own strings does
                open_ = np.zeros(len(shard.sizes), bool)
                text_of = np.searchsorted(shard.ends, first[split & ~whole], "right")
                open_[text_of] = True
                gone = shard.removed(first[whole], last[whole], length)
                done = _results(row["ids"], shard, gone, np.flatnonzero(~open_))
                yield rows_and(done, None)
                if len(ask):
                    spots = [(shard.ends[i] - shard.sizes[i], shard.ends[i]) for i in np.flatnonzero(open_)]
                    lengths = [int(b - a) for a, b in spots]
                    texts = b"".join(shard.bytes[a:b].tobytes() for a, b in spots)
                    # runs of strings to ask for, in the waiting texts
                    held = np.where(open_, shard.sizes, 0)
                    lost = (shard.ends - shard.sizes) - (np.cumsum(held) - held)
                    mine = split & ~whole
                    shift = lost[np.searchsorted(shard.ends, first[mine], "right")]
                    yield rows_and([], {
                        "ids": [[row["ids"][i] for i in np.flatnonzero(open_)]], "sizes": [lengths], "text": [texts],
                        "gone": [np.packbits(np.concatenate([gone[a:b] for a, b in spots]) if spots else np.zeros(0, bool)).tobytes()],
                        "asks": [np.r_[first[mine] - shift, last[mine] - shift].astype(np.int64).tobytes()],
                        **_runs(shard.hash(ask, ask + length))})

    open_kind = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("text", pa.binary()),
                           ("gone", pa.binary()), ("asks", pa.binary()), ("keys", pa.binary()),
                           ("n_keys", pa.int64()), ("times", pa.binary())])
    both = pa.schema([*_ROW, *open_kind])

    def rows_and(done: list[tuple], waiting: dict | None) -> pa.RecordBatch:
        n = 1 if waiting else len(done)
        left = [pa.nulls(n, f.type) for f in _ROW] if waiting else _columns(done, _ROW)
        right = ([pa.array(waiting[f.name], f.type) if not isinstance(waiting[f.name], pa.Array) else waiting[f.name] for f in open_kind]
                 if waiting else [pa.nulls(n, f.type) for f in open_kind])
        return pa.RecordBatch.from_arrays([*left, *right], schema=both)

    ddl = (f"{_RESULT}, ids array<long>, sizes array<long>, text binary, gone binary, asks binary, "
           "keys binary, n_keys long, times binary")
    refined = shards.join(merged, "chunk", "left").select("ids", "sizes", "text", "df").mapInArrow(refine, ddl)
    second, _ = stored_at(refined.withColumn("chunk", F.monotonically_increasing_id()), "suffix-split", "zstd")
    discard(docs.sparkSession, path)
    done = second.where(F.col("sizes").isNull()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    waiting = second.where(F.col("sizes").isNotNull())
    counted = frequencies(waiting, waiting.agg(F.sum("n_keys")).first()[0] or 0)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["sizes"]:
                    continue
                shard = opened(row)
                start = spread(*np.frombuffer(row["asks"], np.int64).reshape(2, -1))
                place = np.searchsorted(np.frombuffer(row["keys"], np.uint64), shard.hash(start, start + length))
                start = start[np.frombuffer(b"".join(row["df"]), COUNT)[place] > 1]
                gone = np.unpackbits(np.frombuffer(row["gone"], np.uint8), count=len(shard.bytes)).astype(bool)
                gone |= shard.removed(start, start, length)
                yield pa.RecordBatch.from_arrays(
                    _columns(_results(row["ids"], shard, gone, np.arange(len(shard.sizes))), _ROW), schema=_ROW)

    rest = (waiting.select("chunk", "ids", "sizes", "text", "gone", "asks", "keys").join(counted, "chunk")
            .drop("chunk").mapInArrow(finish, _RESULT))
    return done.union(rest)


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
