"""Resolving addresses to topics, and the order of browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import context_hash, topic_label
from .topics import BLOCK_OFFSETS


#: Offsets of a cell, in which a reference is looked up; and the partitions over which references that cannot resolve are spread.
CELL, ASIDE = 256, 4096


def first_of(table: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """The first entry of each key of a list, as lists are searched; pre-aggregated before any join."""
    return table.where(F.col(key).isNotNull()).groupBy("doc", key).agg(F.min_by(value, order).alias(value))


def _spans(anchors: DataFrame, out: str, copies: int = 1) -> DataFrame:
    """(_doc, _cell, _copy, _from, _to, topic): what each anchor covers up to the next one or the end of its block, in every cell that it touches."""
    one = anchors.groupBy("doc", F.col("topic_offset").cast("long").alias("_from")).agg(F.max_by(F.col("topic_index").cast("int"), "pos").alias(out)).where("_from >= 0")
    block = F.floor(F.col("_from") / BLOCK_OFFSETS)
    # a block has 32768 offsets at most, and so has a partition of this window rows
    end = F.coalesce(F.lead("_from").over(W.partitionBy("doc", "_block").orderBy("_from")), (F.col("_block") + 1) * BLOCK_OFFSETS)
    d = one.withColumn("_block", block).withColumn("_to", end)
    cells = F.explode(F.sequence(F.floor(F.col("_from") / CELL), F.floor((F.col("_to") - 1) / CELL)))
    d = d.select(F.col("doc").alias("_doc"), cells.alias("_cell"), "_from", "_to", out)
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))) if copies > 1 else F.lit(0))


def resolve_topic_offset(refs: DataFrame, anchors: DataFrame, offset: str = "topic_offset", out: str = "topic_index", copies: int = 1) -> DataFrame:
    """As-of join: the topic of the greatest anchor at or before an offset in the same block of 32768, else null.

    An anchor covers the offsets up to the next one. These spans are laid on cells of CELL offsets, so an
    equi-join finds a reference's few candidates, of which one holds it; no reference passes a window.
    References to one popular place are the larger side of that join alone, so adaptive execution splits
    them over tasks (it reads the few spans again in each); without it, cells can stand in several
    copies, among which references take turns. Of anchors with one offset the last by position counts.
    References that cannot resolve (no document, no offset, a negative one) are spread.
    """
    at = F.col(f"`{offset}`").cast("long")
    turn = F.monotonically_increasing_id()
    able = F.col("doc").isNotNull() & F.coalesce(at >= 0, F.lit(False))
    d = refs.withColumns({"_at": at, "_of_cell": F.when(able, F.floor(at / CELL)).otherwise(-1 - F.pmod(turn, F.lit(ASIDE)))})
    same = (F.col("doc") == F.col("_doc")) & (F.col("_of_cell") == F.col("_cell"))
    if copies > 1:
        d = d.withColumn("_turn", F.pmod(turn, F.lit(copies)).cast("int"))
        same = same & (F.col("_turn") == F.col("_copy"))
    found = d.join(_spans(anchors, out, copies), same & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")), "left")
    return found.select(*[F.col(f"`{c}`") for c in refs.columns], out)


def _by_key(refs: DataFrame, table: DataFrame, key: str, on: str, value: str, out: str) -> DataFrame:
    t = first_of(table, key, value).select("doc", F.col(key).alias(on), F.col(value).alias(out))
    return refs.join(t, ["doc", on], "left")


def resolve_context_hash(refs: DataFrame, contexts: DataFrame, anchors: DataFrame, on: str = "hash", out: str = "topic_index") -> DataFrame:
    return resolve_topic_offset(_by_key(refs, contexts, "hash", on, "topic_offset", "_off"), anchors, "_off", out).drop("_off")


def resolve_context_name(refs: DataFrame, contexts: DataFrame, anchors: DataFrame, name: str = "name", out: str = "topic_index") -> DataFrame:
    return resolve_context_hash(refs.withColumn("_hash", context_hash(F.col(name))), contexts, anchors, "_hash", out).drop("_hash")


def resolve_map_id(refs: DataFrame, context_map: DataFrame, anchors: DataFrame, on: str = "map_id", out: str = "topic_index") -> DataFrame:
    return resolve_topic_offset(_by_key(refs, context_map, "map_id", on, "topic_offset", "_off"), anchors, "_off", out).drop("_off")


def map_number(text: Column) -> Column:
    """Decimal or 0x hexadecimal text as a signed 32-bit number, else null."""
    hexed = F.regexp_extract(text, "^0[xX]([0-9a-fA-F]{1,12})$", 1)
    n = F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).when(text.rlike("^[+-]?[0-9]{1,12}$"), F.try_to_number(F.regexp_replace(text, "^[+]", ""), F.lit("S999999999999")).cast("long"))
    return F.when(n.between(-(1 << 31), (1 << 31) - 1), n).cast("int")


def resolve_reference(refs: DataFrame, contexts: DataFrame, context_map: DataFrame, anchors: DataFrame, ref: str = "ref") -> DataFrame:
    """Trimmed text: a context's name, else a map number; blank resolves to nothing."""
    d = refs.withColumn("_t", F.nullif(F.trim(ref), F.lit(""))).withColumn("_n", map_number(F.trim(ref)))
    d = resolve_context_name(d, contexts, anchors, "_t", "_by_name")
    d = resolve_map_id(d, context_map, anchors, "_n", "_by_number")
    return d.select(*refs.columns, F.coalesce("_by_name", "_by_number").alias("topic_index"))


def resolve_topic_number(refs: DataFrame, topic_map: DataFrame, topics: DataFrame, number: str = "number", out: str = "topic_index") -> DataFrame:
    """A number is a place in the list of positions; the position, 12 or more, has to be a topic's own."""
    places = topic_map.where("topic_pos >= 12").select("doc", F.col("ordinal").alias(number), F.col("topic_pos").alias("_pos"))
    return refs.join(places, ["doc", number], "left").join(topics.select("doc", F.col("topic_pos").alias("_pos"), F.col("topic_index").alias(out)), ["doc", "_pos"], "left").drop("_pos")


def context_name_for_offset(offsets: DataFrame, topic_ids: DataFrame) -> DataFrame:
    return _by_key(offsets, topic_ids, "topic_offset", "topic_offset", "name", "name")


def default_window_for_topic(topics: DataFrame, default_windows: DataFrame, windows: DataFrame) -> DataFrame:
    """topics(doc, start_offset, ...) with win_ordinal and win_name of the window that is set for just that offset."""
    d = _by_key(topics, default_windows, "topic_offset", "start_offset", "win", "_win").withColumn("_win", F.when(F.col("_win") >= 0, F.col("_win")))
    w = windows.select("doc", F.col("ordinal").alias("_win"), F.col("ordinal").alias("win_ordinal"), F.col("name").alias("win_name"))
    return d.join(w, ["doc", "_win"], "left").drop("_win")


def resolve_window(refs: DataFrame, windows: DataFrame) -> DataFrame:
    """By name without case, the first of a name, else by number. refs(doc, win_name, win_number)"""
    named = windows.where("name is not null").groupBy("doc", F.lower("name").alias("_name")).agg(F.min("ordinal").alias("_by_name"))
    d = refs.withColumn("_name", F.lower("win_name")).join(named, ["doc", "_name"], "left")
    d = d.join(windows.select("doc", F.col("ordinal").alias("win_number"), F.col("ordinal").alias("_by_number")), ["doc", "win_number"], "left")
    return d.select(*refs.columns, F.coalesce("_by_name", "_by_number").alias("win"))


def contents_topic(docs: DataFrame, topic_map: DataFrame, topics: DataFrame, anchors: DataFrame) -> DataFrame:
    """The declared contents offset's topic, else that of place 0, else the first topic. docs(doc, contents_offset)"""
    d = resolve_topic_offset(docs, anchors, "contents_offset", "_declared").withColumn("_zero", F.lit(0))
    d = resolve_topic_number(d, topic_map, topics, "_zero", "_mapped")
    first = topics.groupBy("doc").agg(F.min("topic_index").alias("_first"))
    return d.join(first, "doc", "left").select("doc", F.coalesce("_declared", "_mapped", "_first").alias("topic_index"))


def browse_neighbors(browse: DataFrame, topic_map: DataFrame, topics: DataFrame, anchors: DataFrame) -> DataFrame:
    """browse_prev and browse_next: the authored offset, else the topic number."""
    d = browse
    for side, out in (("back", "browse_prev"), ("fore", "browse_next")):
        d = resolve_topic_offset(d, anchors, f"{side}_offset", "_a")
        d = resolve_topic_number(d, topic_map, topics, f"{side}_number", "_b").withColumn(out, F.coalesce("_a", "_b")).drop("_a", "_b")
    return d


def physical_neighbors(topics: DataFrame) -> DataFrame:
    w = W.partitionBy("doc").orderBy("topic_index")
    return topics.select("doc", "topic_index", F.lag("topic_index").over(w).alias("prev"), F.lead("topic_index").over(w).alias("next"))


def all_topics_listing(topics: DataFrame) -> DataFrame:
    return topics.select("doc", "topic_index", topic_label(F.col("title"), F.col("topic_index")).alias("label")).orderBy("doc", "topic_index")
