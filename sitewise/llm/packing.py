"""Packing pieces of token sequences into as few fixed-size sequences as possible.

Only the histogram of lengths matters: at most ``capacity`` numbers, whatever the corpus.
A configuration is a multiset of lengths that fits a sequence. The configuration linear
program (cover every length as often as it occurs with the fewest configurations) is solved
by multiplicative weights. Each round prices the lengths, finds by knapsack dynamic
programming the most valuable configuration that holds each length, takes those that fill a
sequence in whole multiples of a share of what is left, and lets the weights of covered
lengths shrink. Sequences filled to the end meet the program's lower bound, the total length
over the capacity, so what the rounds take is optimal; the rounded rest (a twentieth, more
where the histogram is thin) is packed best-fit, by count. Then every piece finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import logging
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sitewise.llm.common import documents, query, slices, stored, text_bytes
from sitewise.llm.tokens import ids_of, vocabulary
from sitewise.operators.ordered import hash_rank

CAPACITY, END = 1024, 2
#: Share of the total length the program leaves for rounding, power of a length in its first weight, loss of (log) weight
#: by covering a length once, share of the scarcest length's rest taken in a step.
REST, POWER, SHRINK, STEP = 0.05, 1.5, 0.2, 0.2

_BYTES_AT_ONCE = 2_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end``, cut only where longer than ``capacity``.

    All pieces but the first have ``capacity`` ids. A null text is empty: one piece with the end id. Texts are encoded
    whole at any length; repeated rows give repeated pieces; an empty table none.
    """
    path = vocab or vocabulary()
    schema = to_arrow_schema(StructType.fromDDL(_PIECES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = ids_of(path), end.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for part in slices([batch], "text", _BYTES_AT_ONCE):
                encoded = encoder.encode([t.decode() if t else "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += last
                    n, start, piece = len(ids) // 4, 0, 0
                    stop = n % capacity or capacity
                    while start < n:
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                        start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
                                             if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text")).mapInArrow(cut, _PIECES)


# --- the linear program over the histogram ------------------------------------------

Configuration = tuple[tuple[int, int], ...]     # (length, copies), longest first


class Plan(NamedTuple):
    """How often to use each configuration; how many sequences come from the linear program; the lower bound of all."""

    used: dict[Configuration, int]
    from_program: int
    least: int


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(highest value, length to take first) for every room; value[l] <= 0 bars a length."""
    capacity = len(value) - 1
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = value[1:room + 1] + best[room - 1::-1]
        at = int(gain.argmax())
        if gain[at] > best[room - 1]:
            best[room], pick[room] = gain[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, pick


def holding(length: int, pick: np.ndarray) -> Configuration:
    """The most valuable configuration that has a piece of ``length``."""
    copies: dict[int, int] = defaultdict(int)
    copies[length] += 1
    room = len(pick) - 1 - length
    while room:
        if pick[room]:
            copies[int(pick[room])] += 1
        room -= int(pick[room]) or 1
    return tuple(sorted(copies.items(), reverse=True))


def program(counts: np.ndarray, rest: float = REST) -> tuple[dict[Configuration, int], np.ndarray]:
    """(configurations that fill a sequence and how often to use them, counts that are left).

    Stops when ``rest`` of the total length is left, or when no priced configuration fills a sequence any more.
    """
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    left, total = counts.astype(np.int64).copy(), int((counts * size).sum())
    used: dict[Configuration, int] = defaultdict(int)
    while (left * size).sum() > rest * total:
        covered = 1 - left / np.maximum(counts, 1)
        weight = np.where(left > 0, (size / capacity) ** POWER * np.exp(-SHRINK * covered), 0.0)
        _, pick = knapsack(weight)
        taken = 0
        # the least covered lengths first, of these the longest
        for length in sorted(np.flatnonzero(left).tolist(), key=lambda n: (covered[n], -n)):
            if not left[length]:
                continue
            config = holding(length, pick)
            if sum(n * copies for n, copies in config) < capacity:
                continue
            most = min(int(left[n]) // copies for n, copies in config)
            if most:
                step = max(1, int(STEP * most))
                used[config] += step
                taken += step
                for n, copies in config:
                    left[n] -= step * copies
        if not taken:
            break
    return used, left


def best_fit(counts: dict[int, int], capacity: int) -> dict[Configuration, int]:
    """Best-fit decreasing by count: sequences filled alike are handled as one."""
    open_: dict[int, dict[Configuration, int]] = defaultdict(dict)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in range(length, capacity) if open_.get(r)), capacity)
            config, many = open_[room].popitem() if room < capacity else ((), left)
            each = min(room // length, left)
            bins = min(many, left // each)
            if room < capacity and many > bins:
                open_[room][config] = many - bins
            new = (*config, (length, each))
            rest = open_[room - each * length]
            rest[new] = rest.get(new, 0) + bins
            left -= bins * each
    filled: dict[Configuration, int] = defaultdict(int)
    for configs in open_.values():
        for config, many in configs.items():
            filled[config] += many
    return filled


def plan(counts: np.ndarray) -> Plan:
    """Whole numbers of configurations that hold exactly ``counts`` pieces of each length.

    Where rounding costs more than the program saves (a thin histogram), best-fit alone is used.
    """
    capacity = len(counts) - 1
    counts = counts.astype(np.int64)
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    whole, rest = {((capacity, 1),): int(counts[capacity])} if counts[capacity] else {}, counts.copy()
    rest[capacity] = 0
    used, left = program(rest)
    filled = best_fit({int(n): int(left[n]) for n in np.flatnonzero(left)}, capacity)
    alone = best_fit({int(n): int(rest[n]) for n in np.flatnonzero(rest)}, capacity)
    from_program = sum(used.values())
    if from_program + sum(filled.values()) > sum(alone.values()):
        used, filled, from_program = {}, alone, 0
    chosen: dict[Configuration, int] = defaultdict(int)
    for part in (whole, used, filled):
        for config, many in part.items():
            chosen[config] += many
    found = Plan(chosen, from_program + sum(whole.values()), least)
    logging.getLogger(__name__).info("%d sequences, %d at least; %d from the linear program", sum(chosen.values()), least, found.from_program)
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    ``pieces`` has doc_id, piece, start, length (1 to ``capacity``) and ids_crc32; equal rows are
    interchangeable. Sequences are numbered from 0 and filled without gaps. No pieces, no rows.
    """
    pieces = stored(pieces, "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():      # one row per length: at most ``capacity``
        counts[row["length"]] = row["count"]
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranked, sequences = np.zeros(capacity + 1, np.int64), 0
    for config, many in plan(counts).used.items():
        offset = 0
        for length, copies in config:
            runs[length].append((int(ranked[length]), sequences, copies, offset))
            ranked[length] += many * copies
            offset += copies * length
        sequences += many
    table = {length: np.array(r, np.int64) for length, r in runs.items()}   # bounded by the configurations, which follow the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                run = table[int(n)]
                first, base, copies, at = run[np.searchsorted(run[:, 0], rank[rows], "right") - 1].T
                sequence[rows] = base + (rank[rows] - first) // copies
                offset[rows] = at + (rank[rows] - first) % copies * n
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=out)

    ddl = f"{_PIECES}, sequence_id long, offset long"
    out = to_arrow_schema(StructType.fromDDL(ddl))
    order = hash_rank(pieces, ["doc_id", "piece", "start", "ids_crc32"], by=["length"], name="_rank")
    return (order.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long").alias("_rank"))
            .mapInArrow(place, ddl))


@query("op6_pack_best_fit")
def op6_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(documents(spark, sf_dir)))
