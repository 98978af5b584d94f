"""Two-pass external shuffle of records into shards (native: DataFrame functions only).

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash of the record and of which
of its like it is, so that equal records part, and writes them. Pass 2 has one task for each bucket: it
sorts the bucket into a fixed order and shuffles it in memory (Spark's shuffle() is Fisher-Yates; its
generator is seeded by the seed and the task's number, which is the bucket's). The concatenated buckets
are dealt to the shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, column, occurrences, row_keys, whole, written

#: Bytes of a bucket, which a task holds in memory; raise it with the executors' memory, so that there are no more tasks than need be.
BUCKET_BYTES = 16 << 20
#: What a row counts besides its text.
ROW_BYTES = 64
OWN = ("_size", "_crc32", "_law", "_shard", "_slot")


def _dealt(docs: DataFrame, n_shards: int, seed: int, id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    """row (docs' columns as a struct) with size, crc, shard, slot."""
    text = F.coalesce(column(text_col), F.lit(""))
    scattered = docs.select(whole(docs).alias("row"), column(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n"), F.crc32(text.cast("binary")).alias("crc"), *row_keys(docs, seed))
    scattered = occurrences(scattered)
    total = scattered.agg(F.sum(F.col("n") + ROW_BYTES)).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = scattered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "occ"), F.lit(n_buckets)).cast("int"))
    # one row per bucket: its size follows the number of buckets, not of rows
    order = W.orderBy(F.xxhash64(F.lit(seed), "bucket"), "bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    starts = written(counts.select("bucket", (F.sum("in_bucket").over(order) - F.col("in_bucket")).alias("start"), F.sum("in_bucket").over(W.partitionBy()).alias("total")))
    # bucket b is partition b, whatever the session's settings
    gathered = scattered.select("bucket", "id", "k1", "k2", "occ", "n", "crc", "row").repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket", "id", "k1", "k2", "occ")
    mixed = gathered.groupBy("bucket").agg(F.collect_list(F.struct("n", "crc", "row")).alias("rows")).select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    placed = mixed.join(starts, "bucket").select("start", "total", F.posexplode("rows").alias("at", "x")).withColumn("p", F.col("start") + F.col("at"))
    # the first (total mod n) shards take one row more
    q, r = F.floor(F.col("total") / n_shards), F.col("total") % n_shards
    ahead = r * (q + 1)
    shard = F.when(F.col("p") < ahead, F.floor(F.col("p") / (q + 1))).otherwise(r + F.floor((F.col("p") - ahead) / F.greatest(q, F.lit(1)))).cast("int")
    slot = F.when(F.col("p") < ahead, F.col("p") % (q + 1)).otherwise((F.col("p") - ahead) % F.greatest(q, F.lit(1))).cast("long")
    return placed.select("x.row", (F.col("x.n") + 1).alias("size"), F.col("x.crc").alias("crc"), shard.alias("shard"), slot.alias("slot"))


def shuffle_shards(docs: DataFrame, n_shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, names: tuple[str | None, ...] = OWN) -> DataFrame:
    """Columns of docs, then _size, _crc32, _law ('rows'), _shard and _slot (or other names for them; None leaves one out).

    Law `rows`: the shards' row counts differ by one at most; slots run from 0 without gaps. Null text
    has size 1 and the crc of the empty text; null ids come first in a bucket's order. Repeated rows
    all stay and are scattered apart. A text is never cut; one longer than a bucket makes its bucket
    larger. A column of docs with one of the five names gives way to it. An empty table gives an empty
    result. The result is a function of the rows, the seed, n_shards and bucket_bytes alone: neither
    partitions nor settings matter.
    """
    d = _dealt(docs, n_shards, seed, id_col, text_col, bucket_bytes)
    own = [F.col("size"), F.col("crc"), F.lit("rows"), F.col("shard"), F.col("slot")]
    kept = [F.col("row")[c].alias(c) for c in beside(docs, *names)]
    return d.select(*kept, *[c.alias(n) for c, n in zip(own, names, strict=True) if n])


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Writes a folder per shard with a folder per run of slots in it, each run in slot order by one task."""
    runs = sharded.withColumn("_run", F.floor(F.col("_slot") / rows_per_file).cast("int"))
    runs.repartition("_shard", "_run").sortWithinPartitions("_shard", "_run", "_slot").write.partitionBy("_shard", "_run").parquet(path)
