"""Quality rules on repetition, from a suffix array over the words of each text.

Neighbours in the suffix array share a prefix; their longest-common-prefix values delimit
the intervals of repeated word sequences, and the deepest interval around a suffix is the
longest repeat that starts there. The spans of all repeats of a minimum length are united.
A text is rejected if they cover too much of it or one of them is too long.

Suffixes are sorted by prefix doubling over many short texts at once (one text never meets
another: a symbol is a word of one text), and only groups that still tie are sorted again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sitewise.llm.common import documents, packed, query, text_bytes

#: Repeats count from so many words; the limits of the verdict.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.50, 100
_WORDS_AT_ONCE = 500_000
_SYMBOLS = b"#*$%&|<>"
_NOT_CODE_POINT_STARTS = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\r\x0b\x0c"

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest sequence starting there that also starts elsewhere."""
    n = len(symbols)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = np.argsort(symbols, kind="stable")
    fresh = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    levels, width = [rank.copy()], 1
    tied = order[~(fresh & np.r_[fresh[1:], True])]
    while len(tied):
        after = tied + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = rank[tied].astype(np.int64) << 32 | second
        by_key = np.argsort(key, kind="stable")
        tied, key = tied[by_key], key[by_key]
        first = np.r_[True, key[1:] >> 32 != key[:-1] >> 32]
        fresh = np.r_[True, key[1:] != key[:-1]]
        index = np.arange(len(tied))
        inside = index[fresh][np.cumsum(fresh) - 1] - index[first][np.cumsum(first) - 1]
        rank[tied] = (key >> 32) + inside
        levels.append(rank.copy())
        tied = tied[~(fresh & np.r_[fresh[1:], True])]
        width *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    left, right = suffix[:-1], suffix[1:]
    some = levels[0][left] == levels[0][right]
    left, right = left[some], right[some]
    common = np.zeros(len(left), np.int64)
    for k in reversed(range(len(levels))):
        a, b = left + common, right + common
        open_ = (a < n) & (b < n)
        same = open_ & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        common[same] += 1 << k
    # an interval's depth at a suffix is the larger of its two neighbouring common prefixes;
    # a suffix is left of one pair and right of one pair at most
    longest[left] = common
    longest[right] = np.maximum(longest[right], common)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The measures of ``FIELDS`` for some texts (UTF-8)."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    n = int(sizes.sum())
    tokens = np.fromiter((ids[w] for ws in words for w in ws), np.int64, n)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    longest = longest_repeats(text_of * (len(ids) + 1) + tokens)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[mask], minlength=len(texts)).astype(np.int64)

    threes = np.flatnonzero(longest >= 3)
    spans = np.flatnonzero(longest >= min_repeat)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, text_of, longest)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t.translate(None, _NOT_CODE_POINT_STARTS + _SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": per_text(_covered(threes, np.full(len(threes), 3), n)),
        "n_covered": per_text(_covered(spans, longest[spans], n)),
        "longest_repeat": most,
    }


def repetition(text: Column, min_repeat: int = MIN_REPEAT) -> Column:
    """Struct of ``FIELDS`` for a text column."""
    kind = pa.struct([(f, pa.int64()) for f in FIELDS])

    @arrow_udf("struct<" + ",".join(f"{f}:long" for f in FIELDS) + ">")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or b"" for t in batch.to_pylist()]
            parts, start, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t) // 6 + 1
                if size >= _WORDS_AT_ONCE or i == len(texts) - 1:
                    parts.append(measure(texts[start:i + 1], min_repeat))
                    start, size = i + 1, 0
            columns = [pa.array(np.concatenate([p[f] for p in parts]) if parts else [], pa.int64()) for f in FIELDS]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))

    return measured(text_bytes(text))


def judge(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
          max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``row`` (a row of ``docs`` as a struct) and ``quality``: the measures, base_failed and kept.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``n_covered`` counts words inside any repeated sequence of
    ``min_repeat`` words or more (first occurrence included), ``longest_repeat`` the words of the
    longest repeat. A null or empty text has no words and fails the base rule; repeated rows get
    equal verdicts; a text of any length is measured whole in one task. Other columns stay in ``row``,
    whatever their names; an empty table gives no rows.
    """
    q = F.col("quality")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    fine = (q["n_covered"] <= max_covered * q["n_words"]) & (q["longest_repeat"] <= max_repeat)
    return (packed(docs, "text").select("row", repetition(F.col("text"), min_repeat).alias("quality"))
            .select("row", F.struct(*[q[f].alias(f) for f in FIELDS], failed.alias("base_failed"),
                                    (~failed & fine).alias("kept")).alias("quality")))


@query("op3_repetition_rules")
def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "quality.*")
