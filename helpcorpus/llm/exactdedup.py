"""Exact dedup by deterministic block naming (native: DataFrame functions only).

Texts are cut into blocks of a fixed number of bytes. Distinct blocks are sorted and named by their
rank, an integer; then adjacent pairs of names are sorted and named the same way, level by level, until
every document has one name. Equal names mean equal texts and the reverse: no step trusts a hash. Names
are ranks over all data, so neither partitions nor the order of rows change them.

A block's content is shuffled once, pre-aggregated, to find the distinct blocks. Blocks are sorted, and
found by documents, by a 128-bit key; that no key stands for two blocks is counted over all blocks, and
another salt is taken where one does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, stable, written

BLOCK_BYTES = 4096


def _blocks(binary: Column) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(binary) / F.lit(BLOCK_BYTES))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(binary, i * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)))


def _key(block: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * salt), block).alias("k1"), F.xxhash64(F.lit(2 * salt + 1), block).alias("k2"))


def identities(docs: DataFrame, normalised: Column, keep: list[Column]) -> DataFrame:
    """A row per document: rid, the columns of keep, name (equal just where the normalised texts are)."""
    spark = docs.sparkSession
    binary = normalised.cast("binary")
    blocks = docs.select(binary.alias("b")).select(F.explode(_blocks(F.col("b"))).alias("block"))
    for salt in range(8):
        keys = written(blocks.withColumn("k", _key(F.col("block"), salt)).groupBy("k", "block").agg(F.lit(1)).select("k"))
        known = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first()
        if (known[1] or 1) == 1:
            break
    else:
        raise RuntimeError("eight salts in turn gave one key to two blocks")
    names, first = written(ranked(keys, ["k"])), known[0]
    heads = written(docs.withColumn("b", binary).select(*keep, F.transform(_blocks(F.col("b")), lambda x: _key(x, salt)).alias("ks")).withColumn("rid", F.monotonically_increasing_id()))
    most = heads.agg(F.max(F.size("ks"))).first()[0] or 0
    parts = heads.select("rid", F.size("ks").alias("left"), F.posexplode("ks").alias("pos", "k")).join(names, "k").select("rid", "left", "pos", "name")
    if most <= 1:
        return heads.drop("ks").join(parts.select("rid", "name"), "rid")
    parts = written(parts)
    done = []
    while True:
        done.append(parts.where("left = 1").select("rid", "name"))
        if most <= 1:
            break
        most = (most + 1) // 2
        pairs = (
            parts.where("left > 1").groupBy("rid", "left", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        # a level's names stand above those of the levels before it
        named = written(ranked(pairs.select("a", "b").distinct(), ["a", "b"], first))
        first += named.count()
        parts = written(pairs.join(named, ["a", "b"]).select("rid", F.ceil(F.col("left") / 2).cast("int").alias("left"), "pos", "name"))
    names = done[0]
    for x in done[1:]:
        names = names.unionByName(x)
    return heads.drop("ks").join(names, "rid")


#: Removes the six ASCII white-space characters.
def squeezed(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\f\r", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, identity, keep_id, group_size, kept, n_chars, text_sha256.

    Texts are equal when they are after deleting ASCII white space; null counts as empty, and empty
    texts are one group. The row with the most code points stays, then the smallest doc_id (a null id
    is the largest); of rows that repeat id and length the first read stays. A very long text is as
    many blocks as it needs. An empty table gives an empty result. Other columns of docs are not
    read, so none clashes.
    """
    d = stable(docs, id_col, text_col)
    flat = squeezed(F.col("text"))
    rows = written(identities(d, flat, [F.col("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(flat.cast("binary"), 256).alias("text_sha256")]))
    # struct order: longest text, then smallest id with null last, then the first row
    rank = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("rid").alias("d"))
    # written, so that the join below stands alone and a hot group's rows can be split between tasks
    groups = written(rows.groupBy("name").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(groups, "name").select(
        "doc_id", F.col("best.c").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.d")).alias("kept"), "text_sha256", F.col("name").alias("identity"), "n_chars"
    )
