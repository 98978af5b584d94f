"""Keyword indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fold_text
from .resolve import resolve_topic_offset


def keyword_topics(keywords: DataFrame, anchors: DataFrame) -> DataFrame:
    """A row for each topic that an entry reaches; offsets without a topic are left out."""
    exploded = keywords.select("doc", "table_id", "ord", "keyword", F.explode("offsets").alias("topic_offset")).where("topic_offset >= 0")
    return resolve_topic_offset(exploded, anchors).where("topic_index is not null").select("doc", "table_id", "ord", "keyword", "topic_index").distinct()


def resolve_keywords(keywords: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, table_id, keyword, topic_indices): sorted topics of an entry; entries without any are dropped. Ordered by folded and raw keyword."""
    d = keyword_topics(keywords, anchors).groupBy("doc", "table_id", "ord", "keyword").agg(F.array_sort(F.collect_list("topic_index")).alias("topic_indices"))
    return d.orderBy("doc", F.lower("keyword"), "keyword")


def keyword_exact_lookup(lookups: DataFrame, keywords: DataFrame) -> DataFrame:
    """(lookup, rank, topic_offset): offsets of the names between semicolons, each offset at its first place. Names have to match in case, tables need not."""
    names = lookups.select("lookup", "doc", F.upper("table_id").alias("table_id"), F.posexplode(F.split("names", ";")).alias("at", "name")).withColumn("name", F.trim("name")).where("name <> ''")
    entries = keywords.select("doc", F.upper("table_id").alias("table_id"), F.col("keyword").alias("name"), "ord", "offsets")
    hits = names.join(entries, ["doc", "table_id", "name"]).select("lookup", "doc", "at", "ord", F.posexplode("offsets").alias("nth", "topic_offset")).where("topic_offset >= 0")
    first = hits.groupBy("lookup", "doc", "topic_offset").agg(F.min(F.struct("at", "ord", "nth")).alias("place"))
    return first.select("lookup", "doc", F.row_number().over(W.partitionBy("lookup").orderBy("place")).alias("rank"), "topic_offset")


def related_topics(lookups: DataFrame, keywords: DataFrame, anchors: DataFrame) -> DataFrame:
    """(lookup, rank, topic_index): the looked up offsets' topics in the order first seen."""
    d = resolve_topic_offset(keyword_exact_lookup(lookups, keywords), anchors).where("topic_index is not null").groupBy("lookup", "topic_index").agg(F.min("rank").alias("first"))
    return d.select("lookup", F.row_number().over(W.partitionBy("lookup").orderBy("first")).alias("rank"), "topic_index")


def merge_keyword_index(resolved: DataFrame) -> DataFrame:
    """One entry for each keyword without case: key, the spelling seen first (by doc, ord), number of destinations. resolved: rows of keyword_topics"""
    by_spelling = resolved.groupBy(F.lower("keyword").alias("key"), "keyword").agg(F.min(F.struct("doc", "ord")).alias("seen"))
    spelling = by_spelling.groupBy("key").agg(F.min_by("keyword", "seen").alias("keyword"))
    places = resolved.select(F.lower("keyword").alias("key"), "doc", "topic_index").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return spelling.join(places, "key")


def merged_destinations(resolved: DataFrame) -> DataFrame:
    """A row for each destination of a merged entry: lists of any length stay distributed."""
    return resolved.select(F.lower("keyword").alias("key"), "doc", "topic_index").distinct()


def _placed(places: DataFrame, anchors: DataFrame, spelled: Callable[[Column], Column]) -> DataFrame:
    """(doc, topic_index, keywords): of places(doc, topic_offset, keywords) each topic's keywords once, looked up before they become rows; a topic's keywords are its own bound."""
    found = resolve_topic_offset(places.where("topic_offset >= 0"), anchors).where("topic_index is not null")
    return found.groupBy("doc", "topic_index").agg(F.array_distinct(F.transform(F.flatten(F.collect_list("keywords")), spelled)).alias("keywords"))


def placed_destinations(places: DataFrame, anchors: DataFrame) -> DataFrame:
    """merged_destinations of entries that are not yet listed: places(doc, topic_offset, keywords)."""
    return _placed(places, anchors, F.lower).select(F.explode("keywords").alias("key"), "doc", "topic_index")


def placed_spellings(places: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, keyword) of merge_keyword_index for entries that are not yet listed: in a list a document's keywords are in their own order, so the spelling seen first is the smallest of the first document."""
    words = _placed(places, anchors, lambda k: k).select("doc", F.explode("keywords").alias("keyword"))
    return words.groupBy(F.lower("keyword").alias("key")).agg(F.min(F.struct("doc", "keyword")).alias("first")).select("key", "first.keyword")


def keyword_label(keyword: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(keyword, F.lit("  ("), n.cast("string"), F.lit(" topics)"))).otherwise(keyword)


def filter_keyword_index(merged: DataFrame, query: str) -> DataFrame:
    return merged.where(F.contains("key", F.lower(F.trim(F.lit(query))))).select("key", keyword_label(F.col("keyword"), F.col("n")).alias("label"))


def keywords_by_topic(resolved: DataFrame) -> DataFrame:
    """(doc, topic_index, folded_keywords): sorted distinct folded keywords; a topic's keywords are its own bound."""
    return resolved.groupBy("doc", "topic_index").agg(F.array_sort(F.collect_set(fold_text(F.col("keyword")))).alias("folded_keywords"))


def keyword_table_profile(keywords: DataFrame) -> DataFrame:
    """Entries, targets and entries with a macro (-1) by table; other negative offsets say nothing."""
    return keywords.groupBy("doc", "table_id").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum(F.size(F.filter("offsets", lambda o: o >= 0))).cast("long").alias("n_targets"), F.count_if(F.exists("offsets", lambda o: o == -1)).alias("n_macro")
    )
