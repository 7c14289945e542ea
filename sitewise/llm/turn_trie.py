"""Prefix trie of conversations: which turns are shared, by how many, and what storing them once saves.

Conversations become sequences of turn ids, which one range shuffle brings into lexicographic
order, cut into shards. A shard lays its sequences out as padded matrices of turn ids, sorts
them with ``lexsort`` and marks where a column differs from the row above; the running OR of
the marks along a row says at which depths a node starts, and ``reduceat`` sums up each depth.
Only nodes on the first and the last path of a shard can go on in another one. Their parts
meet afterwards, and what several shards have counted (a node's own text, a child, a leaf) is
taken back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import discard, query, small_batches, stored, stored_at

#: Turns and conversations in a shard, columns of a matrix, ids in one row of a long list.
SHARD, WIDTH, IDS_AT_ONCE = 1 << 16, 16, 1 << 13
_NONE = hashlib.sha256(b"").hexdigest()

PART = ("kind string, shard int, slot int, key binary, parent_key binary, parent_slot int, conv_id long, depth long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, size long, path_size long, "
        "closing boolean, on_last boolean, part int, ids binary")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, size): 128 bits of a turn's role and text, and the text's bytes; null is empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"),
                    F.xxhash64(text, role, F.lit(1)).alias("b"), F.octet_length(text).cast("long").alias("size")))


def _in_order() -> Column:
    """Turns by number, null first; equal numbers by the turns' ids."""
    return F.transform(F.array_sort(F.collect_list(F.struct("turn", "a", "b", "size"))),
                       lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["size"].alias("size")))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): the turn ids of every conversation in order."""
    return turns(conversations).groupBy("conv_id").agg(_in_order().alias("seq"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, seq): conversation c begins with the first crc32(c) mod ``most`` turns of c - c mod ``family``.

    Its own turns after as many follow. A family is brought together by one shuffle of turn ids.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    own = (turns(conversations).withColumn("base", base).repartition("base")
           .groupBy("base", "conv_id").agg(_in_order().alias("seq")))
    families = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "seq")).alias("members"))
    first = F.filter("members", lambda m: m["conv_id"] == F.col("base"))
    each = families.select(F.when(F.size(first) > 0, first[0]["seq"]).alias("head"), F.inline("members"))
    n = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    head = F.when(F.col("head").isNull(), F.slice("seq", 1, F.lit(0))).otherwise(F.slice("head", 1, n))
    return each.select("conv_id", F.concat(head, F.slice("seq", n + 1, F.size("seq"))).alias("seq"))


@dataclass
class Nodes:
    """The trie of some sequences: one entry per node, by depth, then in order; the root is number 0."""

    parent: np.ndarray
    depth: np.ndarray
    turn: np.ndarray        # number of the last turn, 0 for the root
    n_convs: np.ndarray
    conv_id: np.ndarray
    size: np.ndarray
    kids: np.ndarray
    child: np.ndarray       # the first of the children, which are numbered in a row
    leaves: np.ndarray
    saved: np.ndarray
    end: np.ndarray         # of every sequence, the node where it ends


def number_turns(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order as numbers from 1, and for each number where its id is found."""
    order = np.lexsort((b, a))
    fresh = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, bool)
    numbers = np.empty(len(a), np.int32)
    numbers[order] = np.cumsum(fresh)
    return numbers, order[fresh]


def build(ids: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, size_of: np.ndarray, width: int = WIDTH) -> Nodes:
    """The trie of sequences given as turn numbers, one after the other; ``size_of`` has the bytes of each number."""
    starts = np.cumsum(lengths) - lengths
    at = np.zeros(len(ids), np.int64)                    # the node a sequence has reached
    parent, counts, least, turn, levels = [np.array([-1])], [np.array([len(ids)])], [ids.min(keepdims=True)], [np.array([0])], [0, 1]
    active, low = np.flatnonzero(lengths > 0), 0
    while len(active):
        # a matrix of the next columns of all sequences that go on; 0 pads, and sorts first
        filled = np.arange(width) < (lengths[active] - low)[:, None]
        matrix = np.zeros(filled.shape, np.int32)
        matrix[filled] = numbers[((starts[active] + low)[:, None] + np.arange(width))[filled]]
        order = np.lexsort((ids[active], *matrix.T[::-1], at[active]))
        active, matrix = active[order], matrix[order]
        change = np.ones(matrix.shape, bool)
        change[1:] = matrix[1:] != matrix[:-1]
        change[1:, 0] |= at[active][1:] != at[active][:-1]
        np.logical_or.accumulate(change, axis=1, out=change)
        for column in range(width):
            there = np.flatnonzero(matrix[:, column])
            if not len(there):
                break
            rows, starts_here = active[there], change[there, column]
            first = np.flatnonzero(starts_here)
            parent.append(at[rows[first]])
            counts.append(np.diff(np.r_[first, len(there)]))
            least.append(np.minimum.reduceat(ids[rows], first))
            turn.append(matrix[there[first], column])
            at[rows] = levels[-1] + np.cumsum(starts_here) - 1
            levels.append(levels[-1] + len(first))
        low += width
        active = active[lengths[active] > low]
    up, n, last = np.concatenate(parent), np.concatenate(counts), np.concatenate(turn).astype(np.int64)
    size = np.r_[0, size_of][last]
    kids, child, leaves, saved = (np.zeros(len(up), np.int64) for _ in range(4))
    for low, high in zip(levels[-2::-1], levels[:0:-1], strict=True):
        saved[low:high] += (n[low:high] - 1) * size[low:high]
        leaves[low:high][kids[low:high] == 0] = 1
        if low:
            first = np.flatnonzero(np.r_[True, up[low + 1:high] != up[low:high - 1]])
            of = up[low:high][first]
            kids[of], child[of] = np.diff(np.r_[first, high - low]), low + first
            leaves[of] = np.add.reduceat(leaves[low:high], first)
            saved[of] = np.add.reduceat(saved[low:high], first)
    depth = np.repeat(np.arange(len(levels) - 1), np.diff(levels))
    return Nodes(up, depth, last, n, np.concatenate(least), size, kids, child, leaves, saved, at)


def edge_path(nodes: Nodes, ends: np.ndarray, last: bool) -> list[int]:
    """Nodes from the root to where the first or the last sequence ends."""
    path = [0]
    while nodes.kids[path[-1]] and (last or not ends[path[-1]]):
        path.append(int(nodes.child[path[-1]] + (nodes.kids[path[-1]] - 1 if last else 0)))
    return path


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def shard_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PART for one shard: finished nodes, parts of nodes on its first and last path, lists of ids ending there."""
    ids, lengths, a, b, sizes = [], [], [], [], []
    for batch in batches:
        seq = batch.column("seq")
        ids.append(batch.column("conv_id").to_numpy())
        lengths.append(np.diff(seq.offsets.to_numpy()).astype(np.int64))
        for into, field in zip((a, b, sizes), seq.flatten().flatten(), strict=True):
            into.append(field.to_numpy(zero_copy_only=False).astype(np.int64))
    if not sum(map(len, ids)):
        return
    ids, lengths, a, b, sizes = map(np.concatenate, (ids, lengths, a, b, sizes))
    shard = TaskContext.get().partitionId()
    numbers, found = number_turns(a, b)
    nodes = build(ids, lengths, numbers, sizes[found])
    count = len(nodes.parent)

    order = np.lexsort((ids, nodes.end))                 # ids by the node they end at, ascending
    runs = np.flatnonzero(np.r_[True, nodes.end[order][1:] != nodes.end[order][:-1]])
    ending = {int(nodes.end[order[s]]): ids[order[s:e]] for s, e in zip(runs, [*runs[1:], len(order)])}
    ends = np.zeros(count, bool)
    ends[list(ending)] = True
    first, last = (edge_path(nodes, ends, side) for side in (False, True))
    key, path_size = {}, {}
    for path in (first, last):
        digest, total = hashlib.md5(usedforsecurity=False), 0
        for node in path:
            if node:
                turn = found[nodes.turn[node] - 1]
                digest.update(a[turn].tobytes() + b[turn].tobytes())
                total += int(nodes.size[node])
            key[node], path_size[node] = digest.copy().digest(), total
    edge = np.array(sorted(key), np.int64)
    open_ = np.zeros(count, bool)
    open_[edge] = True

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        schema = PARTS_SCHEMA
        return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else
                                           pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                                           for f in schema], schema=schema)

    def counts(at: np.ndarray) -> dict:
        return {"conv_id": nodes.conv_id[at], "depth": nodes.depth[at], "n_convs": nodes.n_convs[at], "n_children": nodes.kids[at],
                "n_leaves": nodes.leaves[at], "saved_tokens": nodes.saved[at]}

    inner = np.flatnonzero(~open_)
    for at in range(0, len(inner), 1 << 14):
        some = inner[at:at + (1 << 14)]
        up = nodes.parent[some]
        yield batch_of(len(some), kind=["node"] * len(some), shard=[shard] * len(some), **counts(some),
                       parent_conv_id=pa.array(nodes.conv_id[up], pa.int64(), mask=open_[up]),
                       parent_slot=pa.array(up.astype(np.int32), pa.int32(), mask=~open_[up]),
                       ends_sha256=[hashlib.sha256(_joined(ending[i])).hexdigest() if i in ending else _NONE for i in some.tolist()])
    on_last = set(last)
    yield batch_of(len(edge), kind=["part"] * len(edge), shard=[shard] * len(edge), slot=edge, **counts(edge), size=nodes.size[edge],
                   key=[key[i] for i in edge.tolist()], parent_key=[key.get(int(nodes.parent[i])) for i in edge],
                   path_size=[path_size[i] for i in edge.tolist()], on_last=[i in on_last for i in edge.tolist()],
                   closing=[i == last[-1] for i in edge.tolist()])
    for node in edge.tolist():
        some = ending.get(node, ())
        for part, at in enumerate(range(0, len(some), IDS_AT_ONCE)):
            yield batch_of(1, kind=["ends"], shard=[shard], key=[key[node]], part=[part], ids=[_joined(some[at:at + IDS_AT_ONCE])])


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
PARTS_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (column.split() for column in PART.split(", "))])


def list_digests(lists: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, shard, part, ids): a list of any length streams through its task row by row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: bytes, sha) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

        now, sha = None, None
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield row(now, sha)
                    now, sha = key, hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
        if now is not None:
            yield row(now, sha)

    ordered = lists.select("key", "shard", "part", "ids").repartition("key").sortWithinPartitions("key", "shard", "part")
    return ordered.select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def recombine(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that several shards may share: (merged nodes by key, conv_id of each part's whole node).

    Sorted shards share a node only if it is on the last path of all but the last of them and on the first
    path of all but the first. The first shard keeps the node's own text and its place among its parent's
    children, the last one says whether it is a leaf; the others' parts, and those of the nodes above, are corrected.
    """
    part = parts.where("kind = 'part'")
    held = part.groupBy("key").agg(F.min("shard").alias("from"), F.max("shard").alias("to"))
    known = (part.join(held, "key").withColumn("early", F.col("shard") > F.col("from"))
             .withColumn("late", F.col("shard") < F.col("to")).drop("from", "to"))
    shards = known.groupBy("shard").agg(
        F.max(F.when(F.col("early"), F.col("depth"))).alias("shared"), F.max(F.when(F.col("early"), F.col("path_size"))).alias("shared_size"),
        F.max(F.col("closing") & F.col("late") & (F.col("n_children") == 0)).alias("goes_on"))
    right = known.join(shards, "shard")
    saved = F.when(F.col("early"), F.col("shared_size") - F.col("path_size") + F.col("size")).otherwise(0)
    child = F.when(F.col("early") & (F.col("depth") < F.col("shared")), 1).otherwise(0)
    leaf = F.when(F.col("goes_on") & F.col("on_last"), 1).otherwise(0)
    merged = right.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"),
        F.sum("n_convs").alias("n_convs"), F.sum(F.col("n_children") - child).alias("n_children"),
        F.sum(F.col("n_leaves") - leaf).alias("n_leaves"), F.sum(F.col("saved_tokens") + saved).alias("saved_tokens"))
    merged = stored(merged, "trie-shared")
    places = part.select("shard", "slot", "key").join(merged.select("key", F.col("conv_id").alias("parent_conv_id")), "key")
    return merged, places.select("shard", F.col("slot").alias("parent_slot"), "parent_conv_id")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(seqs: DataFrame) -> DataFrame:
    """One row per node (distinct sequence of first turns) of (conv_id, seq), the root included.

    conv_id: smallest member; parent_conv_id: the parent's; n_convs: members; n_children; n_leaves: childless nodes
    below, itself included; saved_tokens: over the subtree, (members - 1) times the bytes of the last text; ends_sha256:
    SHA-256 of the members that end here, ascending, comma-joined. No conversations give no rows, one without turns
    belongs to the root alone. Turns are equal if 128 bits of role and text are. conv_id is unique in ``seqs``; rows
    without one are dropped before. A text of any length is a turn id here; the turn ids of one conversation (24 bytes
    each) are held by one task, however many conversations share a prefix or are equal.
    """
    spark = seqs.sparkSession
    every, path = stored_at(seqs, "trie-sequences", "zstd")
    total = every.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    # sequences by turn ids, equal ones by conv_id: what ends at a node is ascending over its shards
    shards = every.repartitionByRange(max(1, -(-total // SHARD)), "seq", "conv_id")
    parts = stored(small_batches(shards).mapInArrow(shard_parts, PART), "trie-parts")
    discard(spark, path)
    merged, places = recombine(parts)
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    digests = list_digests(parts.where("kind = 'ends'"))
    shared = (merged.join(above, "parent_key", "left").join(digests, "key", "left")
              .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE))))
    nodes = parts.where("kind = 'node'")
    below = nodes.where("parent_slot is not null").drop("parent_conv_id").join(places, ["shard", "parent_slot"])
    finished = nodes.where("parent_slot is null")
    return finished.select(*COLUMNS).union(below.select(*COLUMNS)).union(shared.select(*COLUMNS))


@query("op11_turn_trie", """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list({'k': md5(strlen(r) || ':' || r || x), 's': strlen(x)} ORDER BY turn NULLS FIRST) AS seq FROM t GROUP BY conv_id),
steps AS (
    SELECT list(c ORDER BY i) AS crc FROM (
        SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b : CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
        FROM range(256) n(i))),
taken AS (
    SELECT conv_id, seq, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch : ascii(ch)::BIGINT)),
        lambda a, b : xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
    FROM own, steps),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(list_slice(p.seq, 1, h), []), list_slice(c.seq, h + 1, len(c.seq))) AS seq
    FROM taken c LEFT JOIN own p ON p.conv_id = c.conv_id - (c.conv_id % 5 + 5) % 5),
member AS (
    SELECT conv_id AS c, d, len(seq) = d AS ends, CASE WHEN d > 0 THEN seq[d].s ELSE 0 END AS s,
        md5(array_to_string(list_transform(list_slice(seq, 1, d), lambda t : t.k), ',')) AS p,
        CASE WHEN d > 0 THEN md5(array_to_string(list_transform(list_slice(seq, 1, d - 1), lambda t : t.k), ',')) END AS up
    FROM rebuilt, unnest(range(0, len(seq) + 1)) g(d)),
node AS (
    SELECT d, p, min(up) AS up, min(c) AS c, count(*) AS n, min(s) AS s,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS digest
    FROM member GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
whole AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids USING (d, p)),
below AS (
    SELECT m.d, m.p, sum(CASE WHEN y.kids = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((y.n - 1) * y.s)::BIGINT AS saved
    FROM whole y JOIN member m ON m.c = y.c AND m.d <= y.d GROUP BY m.d, m.p)
SELECT w.c AS conv_id, w.d::BIGINT AS depth, q.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, b.leaves AS n_leaves,
    b.saved AS saved_tokens, w.digest AS ends_sha256
FROM whole w JOIN below b USING (d, p) LEFT JOIN node q ON q.d = w.d - 1 AND q.p = w.up""")
def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
