"""Line deduplication: of equal normalised lines only the earliest of the corpus stays.

Lines are normalised (A-Z in lower case, white space collapsed) and hashed to 128 bits.
Digests are grouped with partial aggregation, so a line in a third of all documents meets
one task only as partial minima. Only digests that occur twice go on; the join with them
can be split where a digest is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sitewise.llm.common import LOWER, UPPER, discard, documents, query, row_key, stored, stored_at, text_bytes

#: Lines of fewer words are too common to tell a copy from chance; they always stay.
MIN_WORDS = 5
_SPACE = r"[\x20\x09-\x0D]+"


def _normal(line: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(line, _SPACE, " "), UPPER, LOWER))


def line_digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, at, digest) of every line of ``min_words`` words or more; ``at`` counts all lines from 0."""
    lines = docs.select("doc_id", "key", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    normal = lines.select("doc_id", "key", "at", _normal(F.col("line")).alias("line"))
    long_enough = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) >= min_words - 1
    return (normal.where(long_enough & (F.col("line") != ""))
            .select("doc_id", "key", "at", F.unhex(F.md5("line")).alias("digest")))


def earliest(digests: DataFrame) -> DataFrame:
    """(digest, first): the place of the first occurrence of every digest that occurs twice or more."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "at")
    return (digests.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).select("digest", "first"))


_CUT = "n_units long, n_removed long, n_chars long, n_removed_chars long, removed string, text string"


def _cut(min_words: int):
    @arrow_udf(f"struct<{_CUT.replace(' ', ':').replace(',:', ',')}>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([(f, pa.int64()) for f in ("n_units", "n_removed", "n_chars", "n_removed_chars")]
                         + [("removed", pa.string()), ("text", pa.string())])
        for arrays in batches:
            rows = []
            for text, ats, keepers, again, own in zip(*(a.to_pylist() for a in arrays), strict=True):
                lines = text.decode().split("\n")
                first = dict(zip(ats or [], keepers or []))
                if again:       # a repeated row: what its twin keeps, it loses
                    first = {i: first.get(i, own) for i, x in enumerate(lines) if len(x.encode().split()) >= min_words}
                kept, spans, start, gone = [], [], 0, 0
                for i, line in enumerate(lines):
                    if i in first:
                        spans.append(f"{start}:{start + len(line)}:{'' if first[i] is None else first[i]}")
                        gone += len(line)
                    else:
                        kept.append(line)
                    start += len(line) + 1
                rows.append((len(lines), len(spans), start - 1, gone, ",".join(spans), "\n".join(kept)))
            columns = zip(*rows) if rows else [[]] * len(kind)
            yield pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind)],
                                             fields=list(kind))
    return cut


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): what stays of its text and where the rest was.

    Columns: doc_id, n_units (lines), n_removed, n_chars, n_removed_chars, removed, text. ``removed`` lists
    start:end:first for every removed line, in code points of the original text, with the doc_id that holds
    its first occurrence. Occurrences rank by doc_id (null last), then content, then place in the text. Of
    rows equal in doc_id and text one ranks first. A null text is empty: one empty line, nothing removed. An
    empty table gives no rows. Lines of a text of any length are hashed one by one; the text is held whole only
    where it is cut. ``docs`` must give its rows in the same order each time it is read, as files do.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key("doc_id", "text"))
    digests, path = stored_at(line_digests(rows, min_words), "line-digests", "zstd")
    first = stored(earliest(digests), "line-first")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "at")
    lost = (digests.join(first, "digest").where(own != F.col("first"))
            .groupBy("key").agg(F.collect_set(F.struct("at", F.col("first.doc_id").alias("keeper"))).alias("_lost")))
    # repeated rows, counted before the shuffle; those of one key are equal, but for 64-bit collisions told apart by id and size
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.length("text"))
    twins = (numbered.groupBy("key", "doc_id", "size").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
             .groupBy("key").agg(F.collect_list(F.struct("doc_id", "size", "first")).alias("_twins")))
    known = stored(lost.join(twins, "key", "full"), "line-lost")
    discard(docs.sparkSession, path)
    marked = numbered.join(known, "key", "left").withColumn("_again", F.coalesce(F.exists("_twins", lambda t: (
        t["doc_id"].eqNullSafe(F.col("doc_id"))) & (t["size"] == F.col("size")) & (t["first"] != F.col("row"))), F.lit(False)))
    done = marked.select("doc_id", _cut(min_words)(text_bytes(F.col("text")), F.col("_lost.at"), F.col("_lost.keeper"),
                                                   "_again", "doc_id").alias("_r"))
    return done.select("doc_id", "_r.*")


SQL = rf"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, CAST(unnest(range(1, len(lines) + 1)) AS BIGINT) AS pos, unnest(lines) AS line FROM l),
n AS (
  SELECT *, trim(translate(regexp_replace(line, '{_SPACE}', ' ', 'g'), '{UPPER}', '{LOWER}'), ' ') AS normal,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS start FROM u),
r AS (
  SELECT *, len(string_split(normal, ' ')) >= {MIN_WORDS} AND normal <> '' AS counts,
         first_value(doc_id) OVER w AS keeper, row_number() OVER w AS nth
  FROM n WINDOW w AS (PARTITION BY normal ORDER BY doc_id, pos)),
f AS (SELECT *, counts AND nth > 1 AS gone FROM r)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_units, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       CAST(sum(length(line) + 1) - 1 AS BIGINT) AS n_chars,
       CAST(coalesce(sum(length(line)) FILTER (gone), 0) AS BIGINT) AS n_removed_chars,
       coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(line) AS BIGINT) || ':' || keeper, ',' ORDER BY pos)
                FILTER (gone), '') AS removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM f GROUP BY doc_id
"""


@query("op2_line_dedup", SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))
