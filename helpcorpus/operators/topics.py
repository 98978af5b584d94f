"""Assembling topics from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Record types.
DISPLAY, TABLE, MODERN_DISPLAY, MODERN_TABLE = 0x01, 0x22, 0x20, 0x23
TEXT_TYPES = (DISPLAY, MODERN_DISPLAY, TABLE, MODERN_TABLE)
ANCHOR_TYPES = (MODERN_DISPLAY, MODERN_TABLE)
REGION_RANK = {"non_scrolling": 0, "scrolling": 1, "unclassified": 2}
BLOCK_OFFSETS = 32768


def group_records_into_topics(records: DataFrame) -> DataFrame:
    """Numbers records by the headers up to them; records before the first header go."""
    w = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return records.withColumn("topic_no", (F.sum(F.col("is_header").cast("int")).over(w) - 1).cast("int")).where("topic_no >= 0")


def normalize_topic_metadata(headers: DataFrame) -> DataFrame:
    """Sentinels as null: offsets below 0, positions below 12, numbers below 0 or 65535. Old headers have positions, new ones offsets and regions."""
    none = F.lit(None).cast("long")
    at_least = lambda c, n: F.when(F.col(c) >= n, F.col(c))
    new = F.col("modern")
    return headers.select(
        "doc", "pos", "modern", F.when(new, at_least("back", 0)).alias("browse_back"), F.when(new, at_least("fore", 0)).alias("browse_forward"),
        F.when(~new, at_least("back", 12)).alias("previous"), F.when(~new, at_least("fore", 12)).alias("following"),
        F.when((F.col("number") >= 0) & (F.col("number") != 65535), F.col("number")).cast("long").alias("number"),
        F.when(new, at_least("non_scroll", 12)).otherwise(none).alias("non_scroll"), F.when(new, at_least("scroll", 12)).otherwise(none).alias("scroll"), F.when(new, at_least("next_topic", 12)).otherwise(none).alias("next_topic"),
    )


def region_of(pos: Column, non_scroll: Column, scroll: Column, next_topic: Column) -> Column:
    in_fixed = (pos >= non_scroll) & (scroll.isNull() | (pos < scroll))
    in_body = (pos >= scroll) & (next_topic.isNull() | (pos < next_topic))
    return F.when(F.coalesce(in_fixed, F.lit(False)), "non_scrolling").when(F.coalesce(in_body, F.lit(False)), "scrolling").when(non_scroll.isNull() & scroll.isNull(), "scrolling").otherwise("unclassified")


def classify_region(records: DataFrame) -> DataFrame:
    return records.withColumn("region", region_of(F.col("pos"), F.col("non_scroll"), F.col("scroll"), F.col("next_topic")))


def record_text(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Strings of display and table records put together; other kinds have no text."""
    parts = F.array_join(F.filter(F.split(payload, "\x00"), lambda x: x != ""), "")
    return records.withColumn("text", F.when(F.col("record_type").isin(*TEXT_TYPES), parts).otherwise(""))


def topic_plain_text(records: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A topic's non-empty record texts by line, fixed region first, then body, then the rest. A topic's records are its own bound."""
    rank = F.coalesce(*[F.when(F.col("region") == k, F.lit(v)) for k, v in REGION_RANK.items()])
    rows = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(rank.alias("rank"), *order, "text"))))
    return records.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("plain_text"))


def recover_unclassified(records: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Body rows (displayable records of body and no region), and a warning for each topic with records of no region."""
    shown = records.where(F.col("record_type").isin(*TEXT_TYPES) & (F.col("region") != "non_scrolling"))
    lost = shown.where("region = 'unclassified'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return shown, lost.select(*by, F.concat(F.lit("recovered "), F.col("n").cast("string")).alias("warning"))


def apply_decode_fallback(records: DataFrame, issues: DataFrame, by: list[str]) -> DataFrame:
    """formatted, unless a record failed to decode or has an issue that is not safe for layout."""
    unsafe = issues.groupBy(*by).agg(F.bool_or(~F.col("layout_safe")).alias("unsafe"), F.count(F.lit(1)).alias("n_issues"))
    d = records.join(unsafe, by, "left")
    plain = F.coalesce("unsafe", F.lit(False)) | F.col("failed")
    return d.select(*records.columns, F.when(plain, "plain").otherwise("formatted").alias("mode"), F.when(plain, F.col("plain_text")).otherwise(F.col("formatted_text")).alias("chosen_text"), F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"))


def offset_anchors(records: DataFrame, block_size: int = 4096) -> DataFrame:
    """anchors(doc, topic_offset, topic_index, pos) of modern records: block and the lengths before in it."""
    d = records.where(F.col("record_type").isin(*ANCHOR_TYPES) & (F.col("pos") >= 12)).withColumn("block", F.floor((F.col("pos") - 12) / block_size))
    before = F.sum("length").over(W.partitionBy("doc", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return d.select("doc", (F.col("block") * BLOCK_OFFSETS + F.coalesce(before, F.lit(0))).cast("long").alias("topic_offset"), "topic_index", "pos")


def topic_start_offsets(topics: DataFrame, anchors: DataFrame) -> DataFrame:
    """topics with the offset of their first anchor, null without one."""
    first = anchors.groupBy("doc", "topic_index").agg(F.min_by("topic_offset", "pos").alias("start_offset"))
    return topics.join(first, ["doc", "topic_index"], "left")


def startup_topic(topics: DataFrame) -> DataFrame:
    """The first topic with something to show, else the first; topics(doc, topic_index, n_visible)."""
    return topics.groupBy("doc").agg(F.coalesce(F.min(F.when(F.col("n_visible") > 0, F.col("topic_index"))), F.min("topic_index")).alias("topic_index"))


def expand_phrases(tokens: DataFrame, phrases: DataFrame, by: list[str]) -> DataFrame:
    """Texts from literals and phrases of the token's own document, cut at the expected length; status ok, short, long or missing phrase. tokens(doc, *by, seq, phrase_id, literal, space, expected), phrases(doc, phrase_id, phrase)"""
    d = tokens.join(phrases, ["doc", "phrase_id"], "left")
    piece = F.concat(F.coalesce("literal", "phrase", F.lit("")), F.when(F.col("space"), " ").otherwise(""))
    d = d.withColumn("piece", piece).withColumn("missing", F.col("literal").isNull() & F.col("phrase").isNull())
    g = d.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("full"), F.max("expected").alias("expected"), F.bool_or("missing").alias("missing"))
    n = F.length("full")
    status = F.when(F.col("missing"), "missing phrase").when(n < F.col("expected"), "short").when(n > F.col("expected"), "long").otherwise("ok")
    return g.select(*by, F.expr("left(full, expected)").alias("text"), status.alias("status"))


def flatten_nested_cells(cells: DataFrame, max_depth: int = 64, order: str = "cell_id") -> DataFrame:
    """(doc, root, cell_id, depth, path, nth, kind): every cell under its root down to max_depth, with the ids from the root on and its place in the walk of its root, depth first.

    Siblings are walked by `order`. A path's key has a part of fixed width for each ancestor, its place among
    its siblings, so keys sort as the walk goes. Paths double by pointer jumping: seven joins for 64 levels.
    Cells under no root, or on a circle, are under none.
    """
    from ..functions.lineage import cut

    rank = F.row_number().over(W.partitionBy("doc", "parent_id").orderBy(order, "cell_id"))
    d = cells.where("parent_id is not null").withColumn("key", F.lpad(F.hex(rank.cast("long")), 8, "0")).unionByName(cells.where("parent_id is null").withColumn("key", F.lit("")))
    d = cut(d.select("doc", "cell_id", "kind", F.array("cell_id").alias("ids"), F.col("key"), F.col("parent_id").alias("next")))
    reach = 1
    while reach <= max_depth + 1:
        up = d.select("doc", F.col("cell_id").alias("next"), F.col("ids").alias("above"), F.col("key").alias("before"), F.col("next").alias("further"))
        longer = d.where("next is not null").join(up, ["doc", "next"]).select("doc", "cell_id", "kind", F.concat("above", "ids").alias("ids"), F.concat("before", "key").alias("key"), F.col("further").alias("next"))
        d = cut(d.where("next is null").unionByName(longer).where(F.size("ids") <= max_depth + 1))
        reach *= 2
    d = d.where("next is null").withColumn("root", F.get("ids", F.lit(0)))
    nth = F.row_number().over(W.partitionBy("doc", "root").orderBy("key")) - 1
    return d.select("doc", "root", "cell_id", (F.size("ids") - 1).alias("depth"), F.array_join(F.col("ids").cast("array<string>"), "/").alias("path"), nth.alias("nth"), "kind")
