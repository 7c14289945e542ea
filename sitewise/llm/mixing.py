"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight, up to ``max_epochs`` times what it
has; what a capped source cannot take is shared out again by weight until no source is
above its cap. The level reached that way has a closed form: with the sources in order of
cap / weight, it is the highest of (budget - caps before) / (weight - weights before).

A target is met by whole repetitions of every document of the source and one more of
those that come first in a seeded order, as long as this brings the sum nearer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.scalars import hash_hex
from sitewise.llm.common import WORD, documents, packed, query, stored, word_count
from sitewise.operators.ordered import running_totals

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2.0, 42


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, place, source_size, target) from rows with ``source`` and ``size``.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn.
    """
    # each small table is stored: plans that repeat its whole history in every prefix sum fill the driver
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    places = running_totals(sums, "source", {"_n": F.lit(1)}, index="place").select("source", "place")
    named = F.coalesce(F.max("place") + 1, F.lit(0))
    last = places.agg(named.alias("n")).scalar()
    placed = (sums.join(places, "source", "left")
              .withColumn("place", F.coalesce("place", last).cast("long"))
              .withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]),
                                           (F.col("place") % len(weights)).cast("int")))
              .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
              .withColumn("_ratio", F.col("_cap") / F.col("_weight")))
    placed = stored(placed, "mix-places")
    steps = running_totals(placed, "_ratio", {"_caps": F.col("_cap"), "_weights": F.col("_weight")})
    budget = F.col("_caps_total") / F.lit(float(max_epochs)) * F.lit(float(share))
    level = steps.agg(F.max((budget - F.col("_caps_before"))
                            / (F.col("_weights_total") - F.col("_weights_before"))).alias("level")).scalar()
    found = placed.withColumn("target", F.least("_cap", level * F.col("_weight")))
    return stored(found.select("source", "place", "source_size", "target"), "mix-targets")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each row: doc_id, source, size, source_size, target, repeats, taken.

    ``docs`` has doc_id, source and text. A null text has size 0; a null source is a source of
    its own; rows that share a doc_id (or have none) within a source are drawn together. A source
    of size 0 has target 0 and its documents are not repeated. An empty table gives no rows. Texts are
    counted whole at any length and not kept; other columns are not read.
    The sum taken from a source misses its target by at most half a draw.
    """
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sized, weights, share, max_epochs)
    targets = targets.withColumn("_whole", F.when(F.col("source_size") > 0,
                                                  F.floor(F.col("target") / F.col("source_size")))
                                 .otherwise(0).cast("long"))
    # the table has one row per source; adaptive execution broadcasts it only if it is small
    rows = stored(sized.join(targets, sized.source.eqNullSafe(targets.source)).drop(targets.source)
                  .withColumn("_draw", hash_hex(seed, "doc_id")), "mix-draws")
    order = running_totals(rows, "_draw", {"_size": F.col("size")}, by=["place"])
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    extra = ((F.col("_size_before") + F.col("_size") / 2.0 <= rest) & (F.col("size") > 0)).cast("long")
    return (rows.join(order.select("place", "_draw", "_size", "_size_before"), ["place", "_draw"])
            .withColumn("repeats", F.col("_whole") + extra)
            .select("doc_id", "source", "size", "source_size", "target", "repeats",
                    (F.col("repeats") * F.col("size")).alias("taken")))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them: all columns stay, whatever their names."""
    # rows of one doc_id and source have one count, but for rows without words, which have 0 or more
    counts = (mix(docs.select("doc_id", "source", "text"), **options).groupBy("doc_id", "source")
              .agg(F.max("repeats").alias("repeats")).withColumnsRenamed({"doc_id": "_id", "source": "_source"}))
    rows = packed(docs, "doc_id", "source")
    kept = rows.join(counts, rows.doc_id.eqNullSafe(F.col("_id")) & rows.source.eqNullSafe(F.col("_source")))
    return (kept.where(F.col("repeats") > 0)
            .select("row", F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int")))).select("row.*"))


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sums),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + place % 3] AS weight, source_size * 2.0::DOUBLE AS cap FROM placed),
steps AS (
  SELECT (sum(cap) OVER () / 2.0 * 1.5 - coalesce(sum(cap) OVER before, 0))
       / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM steps) * weight) AS target FROM weighed),
drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(concat_ws('-', '42', s.doc_id)) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.doc_id) AS own
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN size > 0 AND upto - own / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) * size
            AS BIGINT) AS taken
FROM drawn
"""


@query("op9_mix_sources", SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
