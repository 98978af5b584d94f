"""What the operators of this package share: reading tables, cutting lineage, tokens."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One ASCII white-space separated word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own only in local mode, where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helpcorpus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back.

    A lost executor's part is then read again instead of computed again, so ids that depend on the
    layout of partitions stay as they were written. Results may read these tables, so they stay until
    `cleared` or until the folder is.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helpcorpus-{uuid.uuid4().hex}"
    TABLES.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, codec: str = "zstd") -> DataFrame:
    """written, laid out in buckets by a column, so that joins and groups by it need no shuffle of this side.

    Only the catalog knows of buckets, so the table has a name there until it has been looked up.
    """
    spark = df.sparkSession
    name = f"helpcorpus_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    TABLES.append(path)
    df.write.option("path", path).option("compression", codec).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


#: The tables that this process has written and not cleared.
TABLES: list[str] = []


def cleared(spark: SparkSession, keep: Sequence[str] = ()) -> None:
    """Deletes the tables written so far but those to keep; results that read the others cannot be read any more."""
    for path in [p for p in TABLES if p not in keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        TABLES.remove(path)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that none can clash with an operator's own."""
    return F.struct(*[column(c) for c in docs.columns])


def beside(docs: DataFrame, *own: str) -> list[str]:
    """docs' columns but those that have the name of an operator's own, which stand in their place."""
    return [c for c in docs.columns if c.lower() not in own]


def text_key(text: Column) -> Column:
    """128 bits of a text; null is the empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))


def crc_text(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def crc_of(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None or doc_id != doc_id else str(int(doc_id)).encode())


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of ASCII white space. bytes.lower and bytes.split know just these."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stable(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, as doc_id and text; other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def ranked(df: DataFrame, order: list[str], first: int = 0, name: str = "name") -> DataFrame:
    """Distinct rows of df with their rank in the order of those columns, from `first` on, whatever the layout of partitions.

    Ranges are sorted apart; a range's first rank is the number of rows in the ranges before it.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    sorted_ = written(sorted_)
    per = sorted_.groupBy(F.shiftright("_place", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per partition
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    starts = written(per.select("_range", before.alias("_start")))
    at = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.withColumn("_range", F.shiftright("_place", 33)).join(starts, "_range").withColumn(name, F.col("_start") + at + first).drop("_range", "_start", "_place")


def occurrences(rows: DataFrame) -> DataFrame:
    """rows(k1, k2, ...), written, with rid and occ: 0, 1, ... among the rows of equal (k1, k2).

    A repeated row is numbered partition by partition, from the number of its like in those before, so
    a task holds one partition's share of a group only. The numbers come back to the rows as one array
    for each partition; rows are laid out by partition and are not shuffled.
    """
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    rows = bucketed(rows.withColumn("pid", F.shiftright("rid", 33)), "pid")
    narrow = rows.select("k1", "k2", "rid", "pid")
    twins = written(narrow.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"))
    d = narrow.join(twins, ["k1", "k2"])
    per = d.groupBy("k1", "k2", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("k1", "k2").orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    at = F.row_number().over(Window.partitionBy("k1", "k2", "pid").orderBy("rid")) - 1
    found = d.withColumn("at", at).join(per.withColumn("before", before).drop("n"), ["k1", "k2", "pid"]).select("rid", (F.col("at") + F.col("before")).alias("occ")).where("occ > 0")
    every = narrow.select("rid", "pid").join(found, "rid", "left").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("rid", F.coalesce("occ", F.lit(0)).alias("occ")))).alias("x"))
    every = written(every.select("pid", F.col("x.occ").alias("occs")))
    at = F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)).cast("int")
    return rows.join(every.hint("shuffle_hash"), "pid").withColumn("occ", F.get("occs", at).cast("long")).drop("occs", "pid")


def row_keys(docs: DataFrame, seed: int) -> list[Column]:
    """k1 and k2: 128 bits of all columns of a row but maps, which Spark does not hash."""
    cols = [column(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return [F.xxhash64(F.lit(seed), F.lit(i), *cols).alias(f"k{i}") for i in (1, 2)]
