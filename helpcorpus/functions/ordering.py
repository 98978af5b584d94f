"""Dense numbers and ordered text files for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """df with each row's place in the order of those columns, from `first` on without gaps.

    Ranges are sorted apart; a range begins with the number of rows in those before it. Rows that are
    equal in all columns of the order may change places.
    """
    d = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return _without_gaps(d, name, first)


def _without_gaps(d: DataFrame, name: str, first: int) -> DataFrame:
    """Increasing ids, of which each partition has its own range, as numbers without gaps."""
    d = d.withColumn("_range", F.shiftright("_at", 33))
    sizes = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each partition
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    starts = F.broadcast(sizes.select("_range", before.alias("_start")))
    return d.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(_ROW)) + first).drop("_range", "_start", "_at")


def write_lines(df: DataFrame, order: list[str], path: str, value: str | Column = "value", rows_per_file: int = 1_000_000, ranged: bool = False, compression: str = "none") -> None:
    """Lines of text in that order: a file for each range, or several of at most rows_per_file lines, whose names sort as their lines do.

    Ranges are found by a pass of its own over df, so a costly value should be an expression, which is taken once the rows are in order.
    A df that is `ranged` lies in ranges of the order's first columns already (repartitionByRange) and is not shuffled again.
    Files may be compressed, as Spark's text files are; read_lines reads them too."""
    d = (df if ranged else df.repartitionByRange(*order)).sortWithinPartitions(*order).select((F.col(value) if isinstance(value, str) else value).alias("value"))
    # gzip at its default level takes as long as all else
    d.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("zlib.compress.level", "BEST_SPEED").text(path, compression=compression)


def read_lines(spark: SparkSession, path: str, value: str | Column = "value") -> DataFrame:
    """(nth, value): the lines of write_lines with their place from 0, or a value made of each line.

    Lines are neither shuffled nor written: a pass counts those of each split, and a split begins with the number of
    lines in those before it. Should the two passes split the files in different ways, reading fails."""
    d = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), (F.col(value) if isinstance(value, str) else value).alias("value"), F.monotonically_increasing_id().alias("_line"))
    splits = d.groupBy("_file", "_block").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a row for each split
    before = F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    at = F.col("_line") - F.col("_first")
    nth = F.when((at >= 0) & (at < F.col("_n")), F.col("_start") + at).otherwise(F.raise_error(F.lit("the files were split in another way when they were counted")).cast("long"))
    return d.join(F.broadcast(splits.withColumn("_start", before)), ["_file", "_block"], "left").select(nth.alias("nth"), "value")
