"""I-Match fingerprints over randomised subsets of a lexicon.

The lexicon holds the terms whose document frequency lies in a band (neither noise nor
function words). A fingerprint hashes, for each of some hundred random subsets of the
lexicon, the sorted distinct terms of the text that are in the subset. Every subset draws
each term on its own. Subsets come in three densities, so that short and long texts alike have
subsets with about one term; two fingerprints are compared where neither is crowded.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sitewise.llm.common import documents, query, slices, text_bytes

#: Kept document frequencies, as shares of all documents. At most distinct terms per text / BAND[0] terms fit.
BAND = (0.002, 0.2)
#: Subsets of each density; a subset of density d draws a term with probability 1 / (SUBSETS * d).
SUBSETS, DENSITIES, CROWDED = 96, (1, 4, 16), 54
MIN_TERMS = 5           # a text with fewer band terms keeps all of its terms
_FLUSH = 300_000
_BYTES_AT_ONCE = 4_000_000
_SHARES = np.repeat([1.0 / (SUBSETS * d) for d in DENSITIES], SUBSETS)


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[int]:
    """Hashes (64 bits, signed) of the terms (words, A-Z in lower case) whose share of documents lies in ``band``."""

    def flush(seen: Counter[bytes]) -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh64_intdigest(t) for t in seen], np.uint64).view(np.int64)
        return pa.RecordBatch.from_pydict({"term": pa.array(hashes), "df": pa.array(seen.values(), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches, "text", _BYTES_AT_ONCE):
            for text in batch.column(0).to_pylist():
                seen.update(set(text.lower().split()))
            if len(seen) > _FLUSH:
                yield flush(seen)
                seen.clear()
        if seen:
            yield flush(seen)

    texts = docs.select(text_bytes(F.col("text")).alias("text"))
    total = docs.count()
    df = texts.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    kept = df.where((F.col("df") >= band[0] * total) & (F.col("df") <= band[1] * total)).select("term")
    # bounded by the lower end of the band, whatever the number of documents
    return sorted(r["term"] for r in kept.toLocalIterator())


def _mixed(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Another 64-bit hash from a hash (the finaliser of a public mixing function)."""
    with np.errstate(over="ignore"):
        x = x + np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def memberships(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsets of each term one after the other, where each term's begin): every subset draws every term by itself."""
    limit = (_SHARES * 2.0 ** 64).astype(np.uint64)
    parts = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(terms), 4096):
        drawn = _mixed(terms[at:at + 4096, None], 2 + np.arange(len(limit))[None]) < limit
        parts.append(np.argwhere(drawn) + [at, 0])
    found = np.concatenate(parts)
    return found[:, 1], np.searchsorted(found[:, 0], np.arange(len(terms) + 1))


class Lexicon:
    """The lexicon in a task: which subsets drew which term, and the numbers of words met before."""

    def __init__(self, hashes: list[int]):
        self.hashes = np.sort(np.array(hashes, np.int64).view(np.uint64))
        self.place = {h: i for i, h in enumerate(self.hashes.tolist())}
        self.subsets, self.starts = memberships(self.hashes)
        self.words: dict[bytes, int] = {}

    def numbers(self, terms: set[bytes]) -> list[int]:
        """Numbers of the terms that are in the lexicon."""
        if len(self.words) > _FLUSH:
            self.words.clear()
        for t in terms.difference(self.words):
            self.words[t] = self.place.get(xxhash.xxh64_intdigest(t), -1)
        return [n for n in map(self.words.__getitem__, terms) if n >= 0]


def fingerprint(text: bytes, lexicon: Lexicon) -> np.ndarray:
    """32-bit hashes, densities x subsets; 0 for a subset without a term of the text."""
    terms = set(text.lower().split())
    numbers = np.sort(np.array(lexicon.numbers(terms), np.int64))
    if len(numbers) < MIN_TERMS:
        held = np.sort(np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64))
        subset, starts = memberships(held)
        sizes = np.diff(starts)
    else:
        held = lexicon.hashes[numbers]
        sizes = lexicon.starts[numbers + 1] - lexicon.starts[numbers]
        subset = lexicon.subsets[np.repeat(lexicon.starts[numbers], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    out = np.zeros(len(_SHARES), np.uint32)
    if len(subset):
        order = np.argsort(subset, kind="stable")        # inside a subset the terms stay in sorted order
        which, value = subset[order], np.repeat(held, sizes)[order]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        place = np.arange(len(which)) - np.repeat(first, np.diff(np.r_[first, len(which)]))
        # a term is hashed with its place in the sorted list of the subset
        out[which[first]] = np.maximum(_mixed(np.add.reduceat(_mixed(value, place + 1), first), 1) >> np.uint64(32), 1)
    return out.reshape(len(DENSITIES), SUBSETS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal subsets among those that hold a term of either text, 0 to 1; 1 for equal fingerprints.

    Read at the two finest densities from the first at which neither text is crowded.
    """
    if np.array_equal(a, b):
        return 1.0
    filled = np.maximum(np.count_nonzero(a, axis=1), np.count_nonzero(b, axis=1))
    level = next((i for i, n in enumerate(filled) if n <= CROWDED), len(DENSITIES) - 1)
    x, y = a[level:level + 2], b[level:level + 2]
    either = np.count_nonzero((x > 0) | (y > 0))
    return float(np.count_nonzero((x == y) & (x > 0)) / either) if either else 0.0


def _hex(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt so that every text and the next one in descending doc_id share a partition, in order.

    Rows are cut into ranges of (doc_id, hash of the text) by a hash-chosen sample, so rows without a doc_id, or with
    the same one, spread as well. The largest row of every range is sent on to the range above too (the largest of
    all to the lowest one), marked ``own`` = false. Only the cuts and the ranges' largest rows' keys, one for each
    range, pass through the driver. Texts travel compressed.
    """
    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)).alias("place")).withColumn("mark", F.xxhash64("text"))
    sample = (rows.select("place", "mark").distinct().orderBy(F.xxhash64("place", "mark"), "place", "mark").limit(16 * buckets)
              .orderBy("place", "mark").collect())
    cuts = [(r["place"], r["mark"]) for r in sample][15::16]
    ranged = rows.withColumn("range", F.lit(0))
    if cuts:
        # the number of cuts below a row, by binary search in literal arrays
        places, marks, at = F.lit([p for p, _ in cuts]), F.lit([m for _, m in cuts]), F.lit(0)
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

        def below(i):
            p = F.get(places, i)
            return (p < F.col("place")) | ((p == F.col("place")) & (F.get(marks, i) < F.col("mark")))

        ranged = rows.withColumn("range", F.aggregate(steps, at, lambda n, s: F.when(
            (n + s <= len(cuts)) & below(n + s - 1), n + s).otherwise(n)))
    tops = sorted((r["range"], *r["top"]) for r in ranged.groupBy("range").agg(F.max(F.struct("place", "mark")).alias("top")).collect())
    above = [(place, mark, tops[(i + 1) % len(tops)][0]) for i, (_, place, mark) in enumerate(tops)]
    if not above:
        return ranged.withColumn("own", F.lit(True)).limit(0)
    also = docs.sparkSession.createDataFrame(above, "place long, mark long, also int")          # a row for each range
    sent = ranged.join(F.broadcast(also), ["place", "mark"], "left").withColumn("to", F.explode(F.array_compact(F.array(
        F.struct("range", F.lit(True).alias("own")),
        F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("range"), F.lit(False).alias("own")))))))
    return (sent.select("doc_id", "text", "place", "mark", F.col("to.range").alias("range"), F.col("to.own").alias("own"))
            .mapInArrow(_compressed, "doc_id long, text binary, place long, mark long, range int, own boolean")
            .repartitionById(buckets + 1, "range")
            .sortWithinPartitions("range", F.desc("own"), F.desc("place"), F.desc("mark")))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array(map(pack, batch.column("text").to_pylist()), pa.binary())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, buckets: int | None = None) -> DataFrame:
    """Fingerprint of every text, of its edited text and their likeness, and the likeness to the next text.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next text in
    descending doc_id (after the last: the first). A null text is empty; rows of one doc_id follow each other
    by hash, a null doc_id comes last; a single row is its own next. Equal texts have equal fingerprints.
    A text is held whole in a task, together with its neighbour only, whatever its length.
    """
    terms = lexicon(docs, band)
    schema = to_arrow_schema(StructType.fromDDL(_OUT))
    n = buckets or max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(terms)
        unpack = zstandard.ZstdDecompressor().decompress
        last = None                 # the row before, waiting for its next
        for batch in slices(batches, "text", _BYTES_AT_ONCE):
            rows = []
            for doc_id, packed, range_, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "own")),
                                                   strict=True):
                raw = unpack(packed)
                row = (doc_id, raw.decode(), range_, own, fingerprint(raw, known))
                if last is not None and last[2] == range_ and last[3]:
                    rows.append(finish(last, row, known))
                last = row
            yield table(rows)

    def finish(row, after, known):
        doc_id, text, _, _, own = row
        half = len(text) // 2
        edited = (text[:len(text) - half] + after[1][:half]).encode()
        other = fingerprint(edited, known)
        return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), _hex(own), _hex(other),
                likeness(own, other), likeness(own, after[4]))

    def table(rows):
        columns = zip(*rows) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    return with_next(docs, n).mapInArrow(walk, _OUT)


@query("op5_imatch_fingerprints")
def op5_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
