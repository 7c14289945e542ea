"""Links between the tokens of two vocabularies, and how often the corpus links two ids.

A text is cut before every space that follows a character other than white space: there both
tokenizers always start a token, so the units between cuts are aligned one by one, each
distinct unit once. Of a batch of units, two incidence matrices in compressed rows say which
bytes a token covers; the row products A x B^T, summed row by row over the visited rows of
B^T, are the overlap links. Tokens by groups (cut where tokens of both kinds end) give the
links within groups in the same way. Chunks of texts then ask for the counts of their distinct
id pairs, several chunks at once, and get them back by range.

What a task holds is bounded by the bytes of a chunk, of an Arrow batch and of a row group, not by its share of the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.llm.common import discard, documents, query, slices, small_batches, stored, stored_at, text_bytes
from sitewise.llm.tokens import ids_of, vocabulary

#: Text in a chunk, bytes of a block of row products, pairs in a range of the count table, units of texts counted at once.
CHUNK_BYTES, BLOCK_BYTES, RANGE_PAIRS, UNITS_AT_ONCE = 1 << 20, 1 << 20, 50_000, 1 << 16
#: Bytes of pairs asked for together: each such row meets a copy of its range of the count table. Bytes of an Arrow batch.
ASKED_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
#: Rows of chunks are large: Parquet looks at the size of a page and of a row group after every one, not after 100.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
              "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"}
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
_CUT = re.compile(r"(?<=\S) ")
_ODD_SPACE = re.compile(r"\s ")
_TOGETHER = 256
#: Between ids of one side, between the sides of a group, between groups, after a unit.
_MARKS = (",", "|", ";", "\n")


def piece_vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Csr:
    """A sparse matrix in compressed rows: the entries of row i are ``index[start[i]:start[i + 1]]``."""

    def __init__(self, start: np.ndarray, index: np.ndarray, value: np.ndarray | None = None):
        self.start, self.index, self.value = start, index, value

    def row_sizes(self) -> np.ndarray:
        return np.diff(self.start)


def covering(lengths: np.ndarray) -> Csr:
    """Rows that cover consecutive columns: row i the next ``lengths[i]`` ones."""
    start = np.r_[0, np.cumsum(lengths)]
    return Csr(start, np.arange(start[-1]))


def members(lengths: np.ndarray) -> Csr:
    """The transpose of ``covering``: each column's row as the single entry of a row."""
    return Csr(np.arange(lengths.sum() + 1), np.repeat(np.arange(len(lengths)), lengths))


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """For each row of a x b, how many products it sums (the symbolic pass): no product is formed."""
    visited = b.row_sizes()[a.index]
    return np.diff(np.r_[0, np.cumsum(visited)][a.start])


def products(a: Csr, b: Csr, block: int = BLOCK_BYTES) -> Csr:
    """a x b of 0/1 matrices by Gustavson's rows: every entry of a row of ``a`` adds the row of ``b`` it names.

    Rows go in blocks of about ``block`` products. Where the columns of a row do not arrive in order they are sorted.
    """
    sizes = product_sizes(a, b)
    width = int(b.index.max(initial=0)) + 1
    ends = np.cumsum(sizes)
    counts, index, value = np.zeros(len(sizes), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + block, "right")))
        entries = a.index[a.start[low]:a.start[high]]
        visited = b.start[entries + 1] - b.start[entries]
        offsets = np.arange(visited.sum()) - np.repeat(np.cumsum(visited) - visited, visited)
        columns = b.index[np.repeat(b.start[entries], visited) + offsets]
        keys = np.repeat(np.arange(low, high), sizes[low:high]) * width + columns
        if len(keys) and (keys[1:] < keys[:-1]).any():
            keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        counts[low:high] = np.bincount(keys[first] // width - low, minlength=high - low)
        index.append(keys[first] % width)
        value.append(np.diff(np.r_[first, len(keys)]))
        low = high
    return Csr(np.r_[0, np.cumsum(counts)], np.concatenate(index), np.concatenate(value))


class Aligned:
    """Two token sequences over the same bytes: overlap links, groups, links within groups."""

    def __init__(self, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.links = products(covering(a_lengths), members(b_lengths))      # value: bytes that two tokens share
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        self.group_ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = (np.searchsorted(self.group_ends, e) for e in (a_ends, b_ends))
        # token by group, and group by token, whose row product links every a with every b of its group
        tokens = Csr(np.arange(len(a_ends) + 1), self.a_group)
        groups = covering(np.bincount(self.b_group, minlength=len(self.group_ends)))
        self.group_links = product_sizes(tokens, groups)                    # per a token; only counted


class Units(NamedTuple):
    """What is known of some units, one entry each: FIGURES, the text of the groups, and in ``pairs`` a run of id pairs, ``n_links`` long.

    ``sound``: whether both vocabularies give back every byte; if not, the unit has nothing else.
    """

    sound: np.ndarray
    figures: np.ndarray
    texts: list[str]
    pairs: np.ndarray


class Tokens:
    """Both vocabularies and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a = ids_of(a_path).bpe
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes = {self.a.encode_single_token(value): value for value in self.a.token_byte_values()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))]
        self.a_lengths, self.b_lengths = (np.array([len(v) for v in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids as they are written, with what stands between them and the next one
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{i}{mark}" for mark in _MARKS for i in range(self.width)]

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        a = self.a.encode_to_numpy(" " + " ".join(units), disallowed_special=()).astype(np.int64)
        parts = [" ".join(units[i:i + _TOGETHER]) for i in range(0, len(units), _TOGETHER)]
        b = [i for ids in self.b.encode(parts, num_threads=1) for i in ids] if units != [""] else [self.b.piece_to_id("▁")]
        return a, np.array(b, np.int64)

    def align(self, units: list[str]) -> Units:
        """Align units, which all begin with a space not written here. Together, units must not hold or end in white space."""
        raw = (" " + " ".join(units)).encode()
        a, b = self._ids(units)
        if any(b"".join(map(table.__getitem__, ids.tolist())) != raw for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            if len(units) == 1:
                return Units(np.zeros(1, bool), np.zeros((1, len(FIGURES)), np.int64), [""], np.zeros(0, np.uint64))
            half = len(units) // 2                       # find the units that are not sound
            x, y = self.align(units[:half]), self.align(units[half:])
            return Units(np.r_[x.sound, y.sound], np.vstack([x.figures, y.figures]), x.texts + y.texts, np.r_[x.pairs, y.pairs])
        ends = np.r_[np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[1:], len(raw)] if len(units) > 1 else np.array([len(raw)])
        both = Aligned(self.a_lengths[a], self.b_lengths[b])
        a_end, b_end = (np.searchsorted(np.cumsum(n[ids]), ends) + 1 for n, ids in ((self.a_lengths, a), (self.b_lengths, b)))
        links, group_end = both.links, both.a_group[a_end - 1] + 1
        inner = np.r_[0, np.cumsum(both.group_links)][a_end]
        figures = np.diff(np.vstack([np.zeros(len(FIGURES), np.int64), np.stack([a_end, b_end, group_end, links.start[a_end], inner], axis=1)]), axis=0)
        pairs = (np.repeat(a, links.row_sizes()).astype(np.uint64) << np.uint64(32)) | b[links.index].astype(np.uint64)
        # the ids in writing order: by group, a before b; a mark after each
        place = np.concatenate([2 * both.a_group, 2 * both.b_group + 1])
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.concatenate([a, b])[order]
        step = np.r_[np.diff(place), 2]
        last = np.zeros(len(both.group_ends), bool)
        last[group_end - 1] = True
        mark = np.where(step == 0, 0, np.where(place % 2 == 0, 1, np.where(last[place // 2], 3, 2)))
        texts = "".join(map(self.written.__getitem__, (mark * self.width + ids).tolist())).split(_MARKS[3])[:-1]
        return Units(np.ones(len(units), bool), figures, texts, pairs)

    def learn(self, units: list[str]) -> tuple[np.ndarray, Units]:
        """(place of each unit in the result, what is known of them); plain units are aligned together, block by block."""
        odd = [i for i, u in enumerate(units) if not u or u[-1].isspace() or " " in u or len(u) > BLOCK_BYTES]
        away = set(odd)
        plain = [i for i in range(len(units)) if i not in away] if odd else range(len(units))
        parts, run, held = [], [], 0
        for i in plain:
            run.append(units[i])
            held += len(units[i])
            if held > BLOCK_BYTES // 4:
                parts.append(self.align(run))
                run, held = [], 0
        if run:
            parts.append(self.align(run))
        parts += [self.align([units[i]]) for i in odd]
        rank = np.empty(len(units), np.int64)
        rank[np.r_[np.array(plain, np.int64), np.array(odd, np.int64)]] = np.arange(len(units))
        if not parts:
            return rank, Units(np.zeros(0, bool), np.zeros((0, len(FIGURES)), np.int64), [], np.zeros(0, np.uint64))
        return rank, Units(np.concatenate([p.sound for p in parts]), np.vstack([p.figures for p in parts]),
                           [t for p in parts for t in p.texts], np.concatenate([p.pairs for p in parts]))


def units(text: str) -> list[str]:
    """The units of space + text, each without the space it begins with."""
    if text[0] != " " and not _ODD_SPACE.search(text):
        return text.split(" ")
    return [u[1:] if i == 0 else u for i, u in enumerate(_CUT.split(" " + text))]


_LOADED: dict[tuple[str, str], Tokens] = {}


def tokens_of(a_path: str, b_path: str) -> Tokens:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Tokens(a_path, b_path)
    return _LOADED[a_path, b_path]


#: A chunk of texts. ``keys``: its distinct id pairs, sorted; ``times``: in how many of its texts each is linked;
#: ``unit_at``: per unit a run of places in ``keys`` (sizes ``unit_sizes``); ``text_at``: per text a run of units; all ``narrow``.
CHUNK = ("chunk long, ids array<long>, " + ", ".join(f"{c} array<long>" for c in FIGURES) + ", groups_sha256 array<string>, "
         "keys binary, times binary, unit_sizes binary, unit_at binary, text_sizes binary, text_at binary")


def narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes that hold the largest; how many bytes each takes comes first."""
    kind = np.min_scalar_type(int(values.max(initial=0))).newbyteorder("<")
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _runs(sizes: np.ndarray, index: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs named by ``of``, one after the other: (their sizes, their entries)."""
    start = np.cumsum(sizes) - sizes
    n = sizes[of]
    return n, index[np.repeat(start[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of CHUNK for (doc_id, text): every text whole, about CHUNK_BYTES of them together."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(a_path, b_path)
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", CHUNK_BYTES):
            place: dict[str, int] = {}
            at = []
            for raw in batch.column("text").to_pylist():
                try:
                    each = units(raw.decode()) if raw else []
                except UnicodeDecodeError:
                    each = []
                at.append(np.array([place.setdefault(u, len(place)) for u in each], np.int32))
            rank, found = tokens.learn(list(place))
            del place
            at = [rank[x].astype(np.int32) for x in at]
            if not found.sound.all():
                at = [x if found.sound[x].all() else x[:0] for x in at]
            unit_sizes = found.figures[:, 3]
            keys, unit_at = np.unique(found.pairs, return_inverse=True)
            unit_at = unit_at.astype(np.int32)
            text_sizes = np.array([len(x) for x in at], np.int64)
            text_at = np.concatenate([*at, np.zeros(0, np.int32)])
            starts = np.r_[0, np.cumsum(text_sizes)]
            figures = {}
            for i, name in enumerate(FIGURES):
                sums = np.r_[0, np.cumsum(found.figures[:, i][text_at])]
                figures[name] = sums[starts[1:]] - sums[starts[:-1]]
            # a pair counts once for a text: distinct units of texts first, then the distinct pairs of those
            times = np.zeros(len(keys), np.int64)
            low = 0
            while low < len(at):
                high = max(low + 1, int(np.searchsorted(starts, starts[low] + UNITS_AT_ONCE, "right")) - 1)
                of = np.repeat(np.arange(high - low), text_sizes[low:high])
                kept = np.unique(of * len(rank) + text_at[starts[low]:starts[high]])
                n, entries = _runs(unit_sizes, unit_at, kept % max(len(rank), 1))
                linked = np.unique(np.repeat(kept // max(len(rank), 1), n) * max(len(keys), 1) + entries)
                times += np.bincount(linked % max(len(keys), 1), minlength=len(keys))[:len(keys)]
                low = high
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()), "ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                **{c: pa.array([v.tolist()], pa.list_(pa.int64())) for c, v in figures.items()},
                "groups_sha256": pa.array([[hashlib.sha256(";".join([found.texts[u] for u in x.tolist()]).encode()).hexdigest() if len(x) else ""
                                            for x in at]], pa.list_(pa.string())),
                **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (
                    ("keys", keys), ("times", times.astype("<u4")))},
                **{c: pa.array([narrow(v)], pa.binary()) for c, v in (
                    ("unit_sizes", unit_sizes), ("unit_at", unit_at), ("text_sizes", text_sizes), ("text_at", text_at))}})
            number += 1

    return small_batches(docs.select("doc_id", text_bytes(F.col("text")).alias("text")), BATCH_BYTES).mapInArrow(align, CHUNK)


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, count, best) of all id pairs: in how many texts they are linked, and whether that is the most for ``a``."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, times in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist(), strict=True):
                keys = np.frombuffer(keys, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int32)),
                                                  pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int32)),
                                                  pa.array(np.frombuffer(times, "<u4").astype(np.int64))], names=["a", "b", "n"])

    sums = made.select("keys", "times").mapInArrow(unpacked, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("count"))
    # the partners of one id are at most the other vocabulary
    return sums.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """A range of the count table for every pair, by a multiplicative hash."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def answered(made: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk, parts): the counts of a chunk's pairs, and which are best, packed by range of the count table."""
    n = max(1, -(-pairs.count() // RANGE_PAIRS))

    def together(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        keys = np.concatenate([k for _, k in held])
        of = np.repeat(np.arange(len(held)), [len(k) for _, k in held])
        numbers = np.array([chunk for chunk, _ in held], np.int64)
        where = _range_of(keys, n)
        order = np.argsort(where, kind="stable")            # within a range by chunk, its pairs in their order
        cuts = np.searchsorted(where[order], np.arange(n + 1))
        parts = []
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            here = order[cuts[r]:cuts[r + 1]]
            which, sizes = np.unique(of[here], return_counts=True)
            parts.append({"range": r, "chunks": numbers[which].tolist(), "sizes": sizes.tolist(), "asked": keys[here].tobytes()})
        return pa.RecordBatch.from_pylist(parts, pa.schema([("chunks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                                                            ("range", pa.int64()), ("asked", pa.binary())]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if held and size + len(raw) > ASKED_BYTES:
                    yield together(held)
                    held, size = [], 0
                held.append((chunk, np.frombuffer(raw, np.uint64)))
                size += len(raw)
        if held:
            yield together(held)

    def with_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().astype(np.uint64) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(_range_of((a << np.uint64(32)) | b, n)), *(batch.column(c) for c in ("a", "b", "count", "best"))],
                                             names=["range", "a", "b", "count", "best"])

    def pack(table: pa.Table) -> pa.Table:
        a, b, count, best = (table.column(c).to_numpy() for c in ("a", "b", "count", "best"))
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        order = np.argsort(keys)
        return pa.table({"range": table.column("range").slice(0, 1), **{c: pa.array([v[order].tobytes()], pa.binary()) for c, v in (
            ("keys", keys), ("counts", count.astype("<i8")), ("bests", best.astype(bool)))}})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at = np.searchsorted(np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["asked"], np.uint64))
            cuts = np.cumsum(row["sizes"])[:-1]
            counts, bests = (np.split(np.frombuffer(row[c], kind)[at], cuts) for c, kind in (("counts", "<i8"), ("bests", bool)))
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(row["chunks"], pa.int64()), "range": pa.array([row["range"]] * len(counts), pa.int64()),
                "counts": pa.array([x.tobytes() for x in counts], pa.binary()), "bests": pa.array([x.tobytes() for x in bests], pa.binary())})

    asked = made.select("chunk", "keys").mapInArrow(ask, "chunks array<long>, sizes array<long>, range long, asked binary")
    table = (pairs.mapInArrow(with_range, "range long, a int, b int, count long, best boolean")
             .groupBy("range").applyInArrow(pack, "range long, keys binary, counts binary, bests binary"))
    answers = asked.join(table, "range").mapInArrow(answer, "chunk long, range long, counts binary, bests binary")
    return answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", "counts", "bests"))).alias("parts")), n


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links of every row of ``docs``.

    Vocabulary A is byte-level, B has pieces with byte fallback and adds a space, so A encodes space + text; special
    tokens in texts are plain text. Links are pairs of token occurrences whose bytes overlap; groups end where tokens
    of both end. A pair of ids counts once for every document (row) that links it; n_best counts the links whose pair
    has its A id's highest count, ties included; count_sum adds up the counts. n_group_links is the number of pairs
    of tokens in the same group. Null and empty texts, invalid UTF-8, and texts that a vocabulary does not give back
    byte by byte have no tokens: zeros and an empty string. Rows with a null or repeated doc_id, and repeated rows, are
    documents of their own. Other columns are not read. Texts are whole at any length; only a unit (a stretch without
    a space) is handled at once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    made, path = stored_at(chunks(docs, a_path or vocabulary(), b_path or piece_vocabulary()), "alignment-chunks", "zstd", LARGE_ROWS)
    pairs, pairs_path = stored_at(pair_counts(made), "alignment-pairs", "zstd")
    answers, n = answered(made, pairs)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys = np.frombuffer(row["keys"], np.uint64)
            order = np.argsort(_range_of(keys, n), kind="stable")
            counts, bests = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            counts[order] = np.frombuffer(b"".join(p["counts"] for p in row["parts"] or ()), "<i8")
            bests[order] = np.frombuffer(b"".join(p["bests"] for p in row["parts"] or ()), bool)
            sizes, at, text_sizes, text_at = (widened(row[c]) for c in ("unit_sizes", "unit_at", "text_sizes", "text_at"))
            unit_ends, text_ends = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(text_sizes)]
            out = {}
            for name, value in (("n_best", bests), ("count_sum", counts)):
                of_unit = np.diff(np.r_[0, np.cumsum(value[at])][unit_ends])
                out[name] = pa.array(np.diff(np.r_[0, np.cumsum(of_unit[text_at])][text_ends]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["ids"], pa.int64()), **{c: pa.array(row[c], pa.int64()) for c in FIGURES[:4]}, **out,
                "groups_sha256": pa.array(row["groups_sha256"], pa.string()), "n_group_links": pa.array(row["n_group_links"], pa.int64())})

    whole = made.drop("times").join(answers, "chunk", "left").mapInArrow(
        finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_group_links long")
    done = stored(whole, "alignment-found")
    for used in (path, pairs_path):
        discard(spark, used)
    small_batches(docs)                                  # as other queries leave it
    return done


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(documents(spark, sf_dir))
