"""N-gram Jaccard join as a blocked sparse matrix product with size-derived bounds.

Rows of the incidence matrix are documents, columns their 4-word shingles (as 64-bit hashes).
A pair with similarity t has an overlap of at least ceil(t * n) for either size n, so at most
n - ceil(t * n) shingles of a document may be missing in its partner. Three bounds follow:

1. A document of which too many of some chosen shingles occur nowhere else has no partner.
2. Partners share a shingle among the n - ceil(t * n) + 1 rarest of each, and their sizes lie
   in the same or neighbouring size bands. Documents meeting there form candidate groups.
3. Inside a group the product of two blocks of rows accumulates the overlap counts; pairs
   below the bound of their sizes are dropped, and a block emits links that connect what is
   linked (a forest), never all pairs.

How often a shingle occurs is asked by chunk: a chunk sends its distinct shingles, cut by hash
range, as packed arrays; the task of a range counts and answers with packed arrays.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.llm.common import documents, packed, query, row_key, slices, small_batches, stored, text_bytes
from sitewise.llm.counting import CHUNK, COUNT, answered, chunk_batch
from sitewise.llm.graph import components

WORDS, PERCENT = 4, 85
CHUNK_BYTES, BLOCK, HUBS = 2_000_000, 1024, 16
FILTER_BITS = 1 << 24       # of the filter on keys; a fuller filter lets more documents through, none is lost
_KEY = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence where it is shorter."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i:len(h) - n + 1 + i]) * _KEY
            out ^= out >> np.uint64(29)
    return np.unique(out)


def spare(n: int, percent: int) -> int:
    """How many of ``n`` shingles a partner may lack at most."""
    return n + (-percent * n // 100)


# --- the three bounds -------------------------------------------------------------------

def _survivors(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """(key): rows of which enough chosen shingles occur in another row. Chosen are the smallest hashes."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            ids, sets = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = shingles(text, words)
                if len(own):
                    ids.append(key)
                    sets.append(own[:2 * spare(len(own), percent) + 1])
            yield chunk_batch(ids, sets)

    chunks = rows.mapInArrow(sample, f"ids binary, {CHUNK}").withColumn("chunk", F.monotonically_increasing_id())
    chunks = stored(chunks, "join-samples")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                df = np.frombuffer(b"".join(row["df"]), COUNT)
                n = np.frombuffer(row["sizes"], np.int32)
                single = (df[np.frombuffer(row["index"], np.int32)] < 2).astype(np.int64)
                starts = np.r_[0, np.cumsum(n)[:-1]]
                alone = np.add.reduceat(single, starts) if len(n) else np.zeros(0, np.int64)
                # 2 * spare + 1 were chosen, of which a linked row may have ``spare`` alone
                fine = alone <= (n - 1) // 2
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.frombuffer(row["ids"], np.int64)[fine])})

    return answered(chunks).select("ids", "sizes", "index", "df").mapInArrow(judge, "key long")


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit filter of fixed size over the keys: its words are merged on the executors."""
    bits = FILTER_BITS
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(i)), F.lit(bits)) for i in range(3)]))
    words = (keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")))
    out = np.zeros(bits // 32, np.uint32)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().astype(np.uint32)
    return out


def _sets(rows: DataFrame, bits: np.ndarray, words: int) -> DataFrame:
    """(uid, doc_id, n, signature, set) of the rows whose key is in the filter."""
    tests = [F.pmod(F.xxhash64("key", F.lit(i)), F.lit(FILTER_BITS)).alias(f"at{i}") for i in range(3)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            ok = np.ones(batch.num_rows, bool)
            for i in range(3):
                at = batch.column(f"at{i}").to_numpy()
                ok &= bits[at // 32] >> (at % 32).astype(np.uint32) & np.uint32(1) > 0
            held = batch.filter(pa.array(ok))
            sets = [shingles(t, words) for t in held.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": held.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "signature": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    return (rows.select("doc_id", "text", *tests).mapInArrow(build, "doc_id long, n long, signature binary, set binary")
            .where(F.col("n") > 0).withColumn("uid", F.monotonically_increasing_id()))


def _candidate_groups(classes: DataFrame, percent: int) -> DataFrame:
    """(node, root): classes that share a rare shingle within neighbouring size bands, transitively."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set", 2 * CHUNK_BYTES):
            yield chunk_batch(batch.column("uid").to_pylist(), [np.frombuffer(s, np.uint64) for s in batch.column("set").to_pylist()])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                df, keys = np.frombuffer(b"".join(row["df"]), COUNT), np.frombuffer(row["keys"], np.uint64)
                index, start = np.frombuffer(row["index"], np.int32), 0
                uids, found, bands = [], [], []
                for uid, n in zip(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32)):
                    own = index[start:start + n]
                    start += n
                    # indices follow the hash order, so a stable sort by frequency orders alike everywhere
                    first = own[np.argsort(df[own], kind="stable")][:spare(int(n), percent) + 1]
                    first = first[df[first] > 1]
                    band = int(np.log(n) / np.log(100 / percent) + 1e-9)
                    for b in (band, band + 1):
                        found.append(keys[first])
                        uids.append(np.full(len(first), uid))
                        bands.append(np.full(len(first), b))
                yield pa.RecordBatch.from_pydict({
                    "uid": pa.array(np.concatenate(uids) if uids else [], pa.int64()),
                    "shingle": pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64()),
                    "band": pa.array(np.concatenate(bands) if bands else [], pa.int64())})

    chunks = classes.select("uid", "set").mapInArrow(gather, f"ids binary, {CHUNK}")
    chunks = stored(chunks.withColumn("chunk", F.monotonically_increasing_id()), "join-chunks")
    postings = stored(answered(chunks).select("ids", "sizes", "index", "keys", "df")
                      .mapInArrow(rarest, "uid long, shingle long, band long"), "join-postings")
    heads = stored(postings.groupBy("shingle", "band").agg(F.min("uid").alias("head"), F.max("uid").alias("tail"))
                   .where(F.col("head") < F.col("tail")).drop("tail"), "join-heads")
    meets = postings.join(heads, ["shingle", "band"]).select(F.col("uid").alias("a"), F.col("head").alias("b"))
    return components(meets.where(F.col("a") != F.col("b")).distinct())


def block_links(uids: np.ndarray, sets: list[np.ndarray], split: int, percent: int,
                joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever is linked among the rows of one product of blocks.

    Rows before ``split`` are multiplied with all that follow; with ``split`` = len, all with all.
    Rows are joined already where ``joined`` has equal labels; such pairs need no link.
    """
    n = np.array([len(s) for s in sets], np.int64)
    keys, columns = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(columns, minlength=len(keys)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[columns]
    at, columns, wide = at[keep], number[columns[keep]], int(shared.sum())
    overlap = np.zeros((split, len(sets)), np.float32)
    for start in range(0, wide, 4096):      # accumulate over blocks of columns
        inside = (columns >= start) & (columns < start + 4096)
        dense = np.zeros((len(sets), min(4096, wide - start)), np.float32)
        dense[at[inside], columns[inside] - start] = 1
        overlap += dense[:split] @ dense.T
    overlap = overlap.astype(np.int64)      # so that 100 times a count stays exact
    union = n[:split, None] + n[None, :] - overlap
    linked = 100 * overlap >= percent * union
    parent = np.arange(len(sets))
    if joined is not None:
        first: dict[int, int] = {}
        parent = np.array([first.setdefault(int(j), i) for i, j in enumerate(joined)])

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(split):
        for j in np.flatnonzero(linked[i, i + 1:]) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(uids[i]), int(uids[j])))
    return links


_LINKS = "a long, b long"


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _linked(classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect all linked classes."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    placed = (groups.join(sizes, "root")
              .withColumn("blocks", F.ceil(F.col("members") / BLOCK))
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
              # a few members, chosen by hash, join every block of a large group
              .withColumn("hub", (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("members")) < HUBS)))
    placed = stored(placed, "join-blocks")
    members = classes.select("uid", "set").join(placed, F.col("uid") == F.col("node"))

    def product(table: pa.Table) -> pa.Table:
        uids = table.column("uid").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        return _link_table(block_links(uids, sets, len(sets), percent))

    every = F.when(F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = (members.withColumn("_b", F.explode(every)).groupBy("root", "_b").applyInArrow(
        lambda key, table: product(table.select(["uid", "set"])), _LINKS))
    first = stored(first, "join-links")
    large = placed.where(F.col("blocks") > 1)
    if large.isEmpty():
        return first

    # groups of many blocks: pairs of blocks whose members are not all joined yet
    label = components(first)
    state = (large.join(label.withColumnRenamed("root", "joined"), "node", "left")
             .withColumn("joined", F.coalesce("joined", "node")))
    state = stored(state, "join-state")
    span = state.groupBy("root", "block").agg(F.min("joined").alias("low"), F.max("joined").alias("high"))
    left, right = (span.select("root", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high")]) for s in "ij")
    open_ = (left.join(right, "root").where(F.col("block_i") < F.col("block_j"))
             .where(F.least("low_i", "low_j") < F.greatest("high_i", "high_j"))
             .select("root", F.col("block_i").alias("i"), F.col("block_j").alias("j")))
    sides = (open_.select("root", "i", "j", F.explode(F.array("i", "j")).alias("block")))
    sent = (state.join(sides, ["root", "block"]).select("node", "joined", "block", "root", "i", "j")
            .join(classes.select("uid", "set"), F.col("uid") == F.col("node")))

    def cross(key, table):
        first_block = key[1].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "uid", "set", "joined"))),
                      key=lambda r: (r[0] != first_block, r[1]))
        return _link_table(block_links(np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows],
                                       sum(r[0] == first_block for r in rows), percent, np.array([r[3] for r in rows])))

    second = sent.groupBy("root", "i", "j").applyInArrow(cross, _LINKS)
    return first.union(second)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents link when 100 * overlap >= ``percent`` * union of their sets of word n-grams
    (A-Z in lower case; shorter texts are one n-gram). ``component_id`` is the smallest doc_id
    reachable. A null, empty or blank text has no n-gram and is linked with nothing; rows with
    equal sets are one class; a null doc_id takes part, and is smallest only where no other id is.
    Texts are read whole at any length (8 bytes for each distinct n-gram in a task); other columns are
    not read; an empty table gives no rows.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    rows = rows.withColumn("key", row_key("doc_id", "text"))
    bits = _filter(_survivors(rows.select("key", "text"), percent, words))
    sets = stored(_sets(rows, bits, words), "join-sets")
    # stored, so that the joins with it can split a signature that very many rows share
    heads = stored(sets.groupBy("signature").agg(F.min("uid").alias("uid")), "join-signatures")
    classes = stored(sets.select("uid", "n", "set").join(heads.select("uid"), "uid"), "join-classes")
    links = _linked(classes, _candidate_groups(classes, percent), percent)
    label = components(links)
    member = (sets.select("uid", "doc_id", "signature").join(heads.withColumnRenamed("uid", "node"), "signature")
              .join(label, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")))
    member = stored(member, "join-members")
    named = stored(member.groupBy("root").agg(F.min("doc_id").alias("component_id")), "join-names")
    found = (member.join(named, "root").groupBy("doc_id").agg(F.min("component_id").alias("component_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array([len(shingles(t, words)) for t in batch.column("text").to_pylist()], pa.int64())})

    sized = rows.select("doc_id", "text").mapInArrow(count, "doc_id long, n_shingles long")
    own = sized.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return own.select("doc_id", "n_shingles", F.coalesce(linked, "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are linked with one of smaller doc_id.

    Rows equal in doc_id and text are one document. Blank texts are linked with nothing and all stay,
    as do rows without doc_id, which no smaller id could stand for. All columns stay, whatever their names.
    """
    found = jaccard_components(docs.select("doc_id", "text"), words, percent)
    gone = (found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct())
    marked = (packed(docs, "doc_id", "text")
              .withColumn("_key", F.when(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), row_key("text"))))
    kept = marked.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    first = Window.partitionBy("doc_id", "_key").orderBy(F.length("text"))
    return (kept.withColumn("_nth", F.row_number().over(first))
            .where((F.col("_nth") == 1) | F.col("_key").isNull() | F.col("doc_id").isNull()).select("row.*"))


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
