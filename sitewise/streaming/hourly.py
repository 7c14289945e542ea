"""The binning job over an unbounded event source.

Bins are anchored at each stay's start, so the key is (stay, feature, bin). Every
micro-batch is reduced to partial sums, maxima and counts and appended under its
batch number; the bins are the sum of the parts. The stream keeps no state that
grows with the stays, late rows simply land in a later part, and a repeated batch
overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def partial_bins(events: DataFrame, hours: int, width_h: int = 1) -> DataFrame:
    return (events.where((F.col("hours_in") >= 0) & (F.col("hours_in") < hours))
            .groupBy("stay_id", "feature", F.floor(F.col("hours_in") / width_h).cast("int").alias("hr"))
            .agg(F.sum("value").alias("total"), F.max("value").alias("top"), F.count("value").alias("n")))


def start_bins(stream: DataFrame, hours: int, path: str, checkpoint: str, width_h: int = 1,
               once: bool = False) -> StreamingQuery:
    """Write the partial bins of every micro-batch below ``path``."""
    def sink(batch: DataFrame, number: int) -> None:
        partial_bins(batch, hours, width_h).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_bins(spark: SparkSession, path: str, sums: Sequence[str] = (), maxima: Sequence[str] = ()) -> DataFrame:
    """Finished bins from the parts: sum, maximum or mean by feature."""
    f = F.col("feature")
    total, n = F.sum("total"), F.sum("n")
    value = F.when(f.isin(*sums), total) if sums else F.when(F.lit(False), total)
    if maxima:
        value = value.when(f.isin(*maxima), F.max("top"))
    return (spark.read.parquet(path).groupBy("stay_id", "feature", "hr")
            .agg(value.otherwise(F.try_divide(total, n)).alias("value")))
