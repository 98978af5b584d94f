"""Diagnostics and profiles of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes of a stream's own header.
STREAM_HEADER = 9
# The family of fixed-pitch fonts, and the charsets that are written from the right.
MODERN_FAMILY = 1
RTL_CHARSETS = (0xB1, 0xB2)
# Generations by minor version; up to OLD_MINOR blocks are plain; later, compression, block and decoded size by flags.
GENERATIONS = {15: "Windows30", 21: "Windows31", 27: "Multimedia", 33: "Windows95"}
OLD_MINOR, OLD_BLOCK = 16, ("none", 2048, 2036)
BLOCKS = {0: ("none", 4096, 4084), 4: ("lz77", 4096, 16384), 8: ("lz77", 2048, 16384)}
OTHER_BLOCK = ("unknown", 4096, 4084)


def stream_inventory(streams: DataFrame) -> DataFrame:
    """streams(doc, name, file_offset, reserved, used, flags) with violation: a stream that does not fit what is reserved for it."""
    return streams.withColumn("violation", (F.col("used") + STREAM_HEADER > F.col("reserved")) | (F.col("reserved") < STREAM_HEADER))


def stream_totals(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("doc").agg(F.count(F.lit(1)).alias("n_streams"), F.sum("used").alias("used"), F.sum("reserved").alias("reserved"), F.count_if("violation").alias("n_violations"))


def corpus_summary(docs: DataFrame, **tables: DataFrame) -> DataFrame:
    """A row for each document with the number of rows in each table."""
    counts = [t.groupBy("doc").agg(F.count(F.lit(1)).alias(f"n_{n}")) for n, t in tables.items()]
    return reduce(lambda d, c: d.join(c, "doc", "left"), counts, docs.select("doc")).na.fill(0)


def topic_record_profile(topics: DataFrame, records: DataFrame, macros: DataFrame, by: list[str]) -> DataFrame:
    """topics(*by, browse_back, browse_forward, previous, following) with the number of records of each region, of those with text, and of macros."""
    of = lambda r: F.count_if(F.col("region") == r)
    n = records.groupBy(*by).agg(of("non_scrolling").alias("n_fixed"), of("scrolling").alias("n_scrolling"), of("unclassified").alias("n_other"), F.count_if(F.col("text") != "").alias("n_visible"))
    m = macros.groupBy(*by).agg(F.count(F.lit(1)).alias("n_macros"))
    d = topics.join(n, by, "left").join(m, by, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_fixed", "n_scrolling", "n_other", "n_visible", "n_macros")]
    return d.select(*by, "browse_back", "browse_forward", "previous", "following", *counts)


def record_content_profile(records: DataFrame, inlines: DataFrame, issues: DataFrame, by: list[str]) -> DataFrame:
    """records(*by, record_type) with paragraphs, is_table, text runs, hotspots, pictures and issues. inlines(*by, paragraph, kind, hotspot), issues(*by)"""
    text = F.col("kind") == "text"
    runs = [F.count_if(text).alias("n_runs"), F.count_if(text & F.col("hotspot")).alias("n_hotspots"), F.count_if(F.col("kind") == "picture").alias("n_pictures")]
    per = inlines.groupBy(*by, "paragraph").agg(*runs).groupBy(*by).agg(F.count(F.lit(1)).alias("n_paragraphs"), *[F.sum(c).alias(c) for c in ("n_runs", "n_hotspots", "n_pictures")])
    wrong = issues.groupBy(*by).agg(F.count(F.lit(1)).alias("n_issues"))
    d = records.select(*by, (F.col("record_type") == 0x23).alias("is_table")).join(per, by, "left").join(wrong, by, "left")
    return d.select(*by, "is_table", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_paragraphs", "n_runs", "n_hotspots", "n_pictures", "n_issues")])


def point_size(twips: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(4096), F.floor((F.abs(twips) + 10) / 20))).cast("int")


def font_rows(fonts: DataFrame) -> DataFrame:
    """A row for each descriptor: face, points, weight, style flags, colour as #RRGGBB, fixed_pitch, rtl. fonts(face_name, twips, weight, flags, family, red, green, blue, charset)"""
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    colour = F.concat(F.lit("#"), *[F.lpad(F.hex(F.col(c)), 2, "0") for c in ("red", "green", "blue")])
    return fonts.select(
        "doc", "font_index", F.trim("face_name").alias("face"), point_size(F.col("twips")).alias("points"), "weight", flag(1).alias("italic"), flag(2).alias("underline"), flag(4).alias("strike"),
        colour.alias("colour"), F.coalesce(F.col("family") == MODERN_FAMILY, F.lit(False)).alias("fixed_pitch"), F.coalesce(F.col("charset").isin(*RTL_CHARSETS), F.lit(False)).alias("rtl"),
    )


def font_census(fonts: DataFrame) -> DataFrame:
    """Descriptors by face and size, with the number that are bold, italic, underlined, struck out, fixed-pitch and right-to-left, and of colours."""
    d = font_rows(fonts).groupBy("face", "points", "colour").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("weight") >= 700).alias("n_bold"), *[F.count_if(c).alias(f"n_{c}") for c in ("italic", "underline", "strike", "fixed_pitch", "rtl")]
    )
    return d.groupBy("face", "points").agg(F.count(F.lit(1)).alias("n_colours"), *[F.sum(c).alias(c) for c in d.columns[3:]])


def block_layout(docs: DataFrame) -> DataFrame:
    """docs(doc, minor, flags) with generation, compression, block_size and decoded_size; unknown flags are kept as `unknown` and their number."""
    number = lambda c: F.col(c).cast("string")
    generation = F.coalesce(*[F.when(F.col("minor") == k, v) for k, v in GENERATIONS.items()], F.concat(F.lit("Unknown "), number("minor")))

    def pick(i: int, other: Column) -> Column:
        return F.when(F.col("minor") <= OLD_MINOR, OLD_BLOCK[i]).otherwise(F.coalesce(*[F.when(F.col("flags") == k, v[i]) for k, v in BLOCKS.items()], other))

    kind = pick(0, F.concat(F.lit(OTHER_BLOCK[0] + " "), number("flags")))
    return docs.select("*", generation.alias("generation"), kind.alias("compression"), pick(1, F.lit(OTHER_BLOCK[1])).alias("block_size"), pick(2, F.lit(OTHER_BLOCK[2])).alias("decoded_size"))


def block_profile(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Physical and decoded sizes of a document's blocks, in whole percents, with what its header says of them; n_over counts blocks that decode to more than it allows. blocks(doc, physical, decoded), docs(doc, minor, flags)"""
    d = blocks.join(block_layout(docs), "doc").groupBy("doc", "generation", "compression", "block_size", "decoded_size")
    d = d.agg(F.count(F.lit(1)).alias("n"), F.sum("physical").alias("physical"), F.sum("decoded").alias("decoded"), F.count_if(F.col("decoded") > F.col("decoded_size")).alias("n_over"))
    return d.withColumn("percent", F.floor(F.lit(100) * F.col("physical") / F.greatest(F.col("decoded"), F.lit(1))).cast("long"))


def warnings_report(**stages: DataFrame) -> DataFrame:
    """One list of all stages' warnings (doc, ord, message), with the stage before the message."""
    parts = [w.select("doc", F.lit(name).alias("stage"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit(f"{name}: "), "message").alias("message")) for name, w in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def warnings_summary(report: DataFrame) -> DataFrame:
    """The first warning of a document, and how many there are."""
    d = report.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min_by("message", F.struct("stage", "ord", "message")).alias("first"))
    return d.select("doc", "n", F.when(F.col("n") > 1, F.concat("first", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("first")).alias("summary"))
