"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter window is the product of its
letters' vectors, each rotated by its place; a text is the sum over its windows, a language
the sum over its training texts. A text gets the language whose profile has the highest
cosine. One pass bundles the profiles (tasks send one vector for each language), one predicts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sitewise.llm.common import documents, query, slices, text_bytes

DIMENSIONS, UNKNOWN = 1024, "und"
_BYTES_AT_ONCE, _ROWS_AT_ONCE = 1_000_000, 4096
#: Characters, different windows, and counts (groups x windows) handled at once.
_PIECE, _WINDOWS_AT_ONCE, _CELLS = 1 << 20, 1 << 13, 1 << 22
_DENSE = 1 << 22        # windows over so few possible values are counted in a table
_alpha: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def letter_vectors(letters: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One +1/-1 vector for each code point, the same in every process (0 is the word boundary)."""
    with np.errstate(over="ignore"):
        x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + np.arange(1, dimensions // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        # the finaliser of a public 64-bit mixing function
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def windows(framed: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, window index) of every letter, and the windows as rows of three code points.

    The first and the last character of a text are its frame: neighbours of letters, in the middle of no window.
    """
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in framed])
    text_of = np.repeat(np.arange(len(framed)), np.diff(np.r_[0, ends]))
    codes = np.where(_is_letter()[codes], codes, 0).astype(np.int64)
    inner = codes > 0
    inner[ends - 1] = False
    inner[np.r_[0, ends[:-1]]] = False
    at = np.flatnonzero(inner)
    present = np.unique(np.concatenate([[0], codes[at - 1], codes[at], codes[at + 1]]))
    place = np.zeros(int(present[-1]) + 1, np.int64)
    place[present] = np.arange(len(present))
    n = len(present)
    key = (place[codes[at - 1]] * n + place[codes[at]]) * n + place[codes[at + 1]]
    if n ** 3 <= _DENSE:
        seen = np.zeros(n ** 3, np.int64)
        seen[key] = 1
        keys = np.flatnonzero(seen)
        seen[keys] = np.arange(len(keys))
        which = seen[key]
    else:
        keys, which = np.unique(key, return_inverse=True)
    rows = np.stack([present[keys // (n * n)], present[keys // n % n], present[keys % n]], axis=1)
    return text_of[at], which, rows


def bind(rows: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vectors of windows: the product of the rotated letter vectors."""
    letters, index = np.unique(rows, return_inverse=True)
    index = index.reshape(rows.shape)
    vectors = letter_vectors(letters, dimensions)
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    return first[index[:, 0]] * second[index[:, 1]] * vectors[index[:, 2]]


def _add_bundles(out: np.ndarray, framed: list[str], owner: list[int]) -> None:
    """Add the window vectors of some framed texts to their groups' rows, a block of different windows at a time."""
    text_of, which, rows = windows(framed)
    group = np.array(owner, np.int64)[text_of]
    order = np.argsort(which, kind="stable")
    which, group = which[order], group[order]
    step = max(64, min(_WINDOWS_AT_ONCE, _CELLS // len(out)))
    cuts = np.searchsorted(which, np.arange(0, len(rows) + step, step))
    for at, (low, high) in zip(range(0, len(rows), step), zip(cuts, cuts[1:])):
        many = min(step, len(rows) - at)
        counts = np.bincount(group[low:high] * many + which[low:high] - at, minlength=len(out) * many)
        out += counts.reshape(len(out), many).astype(np.float32) @ bind(rows[at:at + many], out.shape[1])


def bundles(texts: Sequence[str], group: np.ndarray, n_groups: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sum of the window vectors of the texts in each group; a row of zeros for no letters.

    Long texts are cut into pieces that share a character on either side, so memory does not follow their length.
    """
    out = np.zeros((n_groups, dimensions), np.float32)
    framed, owner, held = [], [], 0
    for text, g in zip(texts, group, strict=True):
        low = f" {text.lower()} "
        for start in range(1, len(low) - 1, _PIECE):
            framed.append(low[start - 1:min(start + _PIECE, len(low) - 1) + 1])
            owner.append(int(g))
            held += len(framed[-1])
            if held > _PIECE:
                _add_bundles(out, framed, owner)
                framed, owner, held = [], [], 0
    if framed:
        _add_bundles(out, framed, owner)
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A profile for each non-null value of ``lang``: languages x dimensions numbers reach the driver."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "_text", _BYTES_AT_ONCE):
            langs = batch.column("_lang").to_pylist()
            names = sorted(set(langs))
            group = np.array([names.index(x) for x in langs], np.int64)
            sums = bundles([t.decode() for t in batch.column("_text").to_pylist()], group, len(names), dimensions)
            for name, row in zip(names, np.rint(sums).astype(np.int64), strict=True):
                total[name] = total[name] + row if name in total else row
        for name, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([row.tolist()], pa.list_(pa.int64()))],
                                             names=["lang", "profile"])

    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("_lang"),
                                                          text_bytes(F.col(text)).alias("_text"))
    parts = labelled.mapInArrow(bundle, "lang string, profile array<long>")
    sums = (parts.select("lang", F.posexplode("profile").alias("at", "value"))
            .groupBy("lang", "at").agg(F.sum("value").alias("value")))
    profiles: dict[str, np.ndarray] = {}
    for row in sums.collect():
        profiles.setdefault(row["lang"], np.zeros(dimensions))[row["at"]] = row["value"]
    return {name: p for name, p in sorted(profiles.items()) if p.any()}


def predict(text: Column, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> Column:
    """Struct (lang_pred, score) of a text column; ``und`` and 0 for a text without a letter or without profiles."""
    names = list(profiles)
    matrix = np.array([p / np.linalg.norm(p) for p in profiles.values()], np.float32).reshape(len(names), dimensions)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def score(texts: list[str]) -> tuple[list[str], np.ndarray]:
        own = bundles(texts, np.arange(len(texts)), len(texts), dimensions)
        norm = np.linalg.norm(own, axis=1)
        likeness = own @ matrix.T / np.maximum(norm, 1e-9)[:, None]
        best = likeness.argmax(axis=1) if names else np.zeros(len(texts), int)
        named = (norm > 0) & bool(names)
        points = likeness[np.arange(len(texts)), best] if names else np.zeros(len(texts))
        return ([names[b] if ok else UNKNOWN for b, ok in zip(best, named)],
                np.where(named, np.clip(points, 0, 1), 0.0).astype(float))

    @arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            found, points = [], []
            some = [pa.RecordBatch.from_arrays([array.slice(i, _ROWS_AT_ONCE)], names=["t"]) for i in range(0, len(array), _ROWS_AT_ONCE)]
            for part in slices(some, "t", _BYTES_AT_ONCE):
                a, b = score([t.decode() if t else "" for t in part.column("t").to_pylist()])
                found += a
                points.append(b)
            columns = [pa.array(found, pa.string()), pa.array(np.concatenate(points) if points else [], pa.float64())]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))

    return predicted(text_bytes(text))


def identify(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows with crc32(doc_id) mod ``folds`` = ``fold`` are held out.

    Profiles come from the other rows that have a language. A null doc_id counts as an empty one. Repeated
    rows get equal predictions; ties go to the language first in code-point order; with nothing to learn
    from, every row is ``und``. Texts are read whole, whatever their length.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    marked = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    profiles = learn(marked.where(~F.col("held_out")))
    return (marked.select("doc_id", "held_out", predict(F.col("text"), profiles).alias("_p"))
            .select("doc_id", "held_out", "_p.lang_pred", "_p.score"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
