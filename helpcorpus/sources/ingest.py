"""Reading corpora: files, headers, contents lines, text by charset."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import path_identity, topic_label

# What names a help file, and the first words of its header.
EXTENSIONS = ("hlp", "mvb")
MAGIC, OTHER_FAMILY = 0x00035F3F, 0x00024E4C
# Java charsets by charset byte; all other bytes are windows-1252.
CHARSETS = {0x4D: "x-MacRoman", 0x80: "Shift_JIS", 0x81: "EUC-KR", 0x82: "x-Johab", 0x86: "GBK", 0x88: "Big5", 0xA1: "windows-1253", 0xA2: "windows-1254", 0xA3: "windows-1258", 0xB1: "windows-1255", 0xB2: "windows-1256", 0xBA: "windows-1257", 0xCC: "windows-1251", 0xDE: "x-windows-874", 0xEE: "windows-1250"}
# Charsets of well-known faces, of whole locales and of primary languages.
FACE_CHARSETS = {
    0x02: ("symbol", "wingdings", "wingdings 2", "wingdings 3"),
    0x80: ("ms gothic", "ms pgothic", "ms mincho", "ms pmincho", "meiryo"),
    0x81: ("gulim", "gulimche", "batang", "batangche", "dotum", "dotumche", "gungsuh", "gungsuhche"),
    0x86: ("simsun", "nsimsun", "simhei", "fangsong", "kaiti"),
    0x88: ("mingliu", "pmingliu", "dfkai-sb"),
}
LOCALE_CHARSETS = {0x88: (0x0404, 0x0C04, 0x1404), 0x86: (0x0804, 0x1004), 0xCC: (0x0C1A, 0x1C1A, 0x281A, 0x301A), 0xEE: (0x081A, 0x181A, 0x241A, 0x2C1A)}
LANGUAGE_CHARSETS = {0xB2: (0x01,), 0xCC: (0x02, 0x19, 0x22, 0x23, 0x2F), 0xEE: (0x05, 0x0E, 0x15, 0x18, 0x1A, 0x1B, 0x1C, 0x24), 0xA1: (0x08,), 0xB1: (0x0D,), 0x80: (0x11,), 0x81: (0x12,), 0xDE: (0x1E,), 0xA2: (0x1F,), 0xBA: (0x25, 0x26, 0x27), 0xA3: (0x2A,)}


def scan_corpus_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """files(path, doc, length) under a folder, by extension without case; contents are not read. Of files with one identity the first path stays."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    return named.groupBy(path_identity(F.col("path")).alias("doc")).agg(F.min("path").alias("path"), F.min_by("length", "path").alias("length")).select("path", "doc", "length")


def triage_headers(headers: DataFrame) -> DataFrame:
    """The first rule that a header breaks, or ok; a number that is null was not in the file."""
    short = F.greatest(*[F.col(c).isNull() for c in ("magic", "directory_start", "first_free", "logical_size")])
    size, at, free = F.col("logical_size"), F.col("directory_start"), F.col("first_free")
    verdict = (
        F.when(F.col("magic") == OTHER_FAMILY, "other family").when(F.col("magic") != MAGIC, "bad magic").when(short, "header cut short").when(size < 16, "size too small").when(size > F.col("actual_size"), "size beyond file")
        .when((at < 16) | (at >= size), "directory out of bounds").when((free != -1) & ((free < 16) | (free >= size)), "free list out of bounds").otherwise("ok")
    )
    return headers.withColumn("verdict", verdict)


def header_fields(files: DataFrame, content: str = "content") -> DataFrame:
    """The header's little-endian numbers from the bytes of a file; a number that the file is too short for is null."""

    def word(at: int) -> Column:
        h = F.hex(F.substring(F.col(content), at, 4))
        return F.when(F.length(h) == 8, F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long"))

    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)
    return files.select("*", word(1).alias("magic"), word(5).alias("directory_start"), signed(word(9)).alias("first_free"), word(13).alias("logical_size"), F.octet_length(content).alias("actual_size"))


def load_topics(raw: DataFrame) -> DataFrame:
    """topics(doc, topic_index, label, ...) in the order of positions."""
    index = (F.row_number().over(W.partitionBy("doc").orderBy("topic_pos")) - 1).cast("int")
    return raw.withColumn("topic_index", index).withColumn("label", topic_label(F.col("title"), F.col("topic_index")))


def contents_lines(spark: SparkSession, path: str) -> DataFrame:
    """lines(doc, line, text) of contents files, one file a row at first, so line numbers are its own."""
    whole = spark.read.text(path, wholetext=True).select(path_identity(F.input_file_name()).alias("doc"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return whole.select("doc", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _parsed(lines: DataFrame) -> DataFrame:
    t = F.trim(F.col("text"))
    directive = F.lower(F.regexp_extract(t, r"^:(\S*)", 1))
    level, rest = F.regexp_extract(t, r"^([0-9]+)", 1), F.trim(F.regexp_extract(t, r"^[0-9]+(.*)$", 1))
    target = F.when(F.instr(rest, "=") > 0, F.expr("substring(rest, instr(rest, '=') + 1)"))
    d = lines.withColumn("t", t).where("t <> '' and not startswith(t, ';')")
    d = d.withColumn("directive", F.when(F.col("t").startswith(":"), directive)).withColumn("value", F.when(F.col("t").startswith(":"), F.trim(F.regexp_extract("t", r"^:\S*(.*)$", 1))))
    d = d.withColumn("digits", level).withColumn("rest", rest).withColumn("title", F.trim(F.substring_index("rest", "=", 1))).withColumn("target", target)
    before_window = F.substring_index("target", ">", 1)
    d = d.withColumn("win", F.nullif(F.trim(F.when(F.instr("target", ">") > 0, F.expr("substring(target, instr(target, '>') + 1)"))), F.lit("")))
    d = d.withColumn("context", F.nullif(F.trim(F.substring_index(before_window, "@", 1)), F.lit(""))).withColumn("before_window", before_window)
    d = d.withColumn("help_file", F.nullif(F.trim(F.when(F.instr("before_window", "@") > 0, F.expr("substring(before_window, instr(before_window, '@') + 1)"))), F.lit("")))
    return d.withColumn("level", F.when(F.length("digits") <= 5, F.expr("try_cast(digits AS BIGINT)")))


def read_contents_lines(lines: DataFrame) -> DataFrame:
    """contents(doc, line, level, title, context, help_file, win): the entries among lines(doc, line, text)."""
    ok = _parsed(lines).where("digits <> '' and level between 1 and 65535 and title <> ''")
    return ok.select("doc", "line", F.col("level").cast("int").alias("level"), "title", "context", "help_file", "win")


def contents_meta(lines: DataFrame) -> DataFrame:
    """(doc, title, base_file, base_window): what the last :Title and :Base lines with a value say."""
    d = _parsed(lines).where("value <> '' and directive in ('title', 'base')").groupBy("doc").agg(*[F.max_by(F.when(F.col("directive") == k, F.col("value")), F.when(F.col("directive") == k, F.col("line"))).alias(k) for k in ("title", "base")])
    window = F.when(F.instr("base", ">") > 0, F.trim(F.expr("substring(base, instr(base, '>') + 1)")))
    return d.select("doc", "title", F.trim(F.substring_index("base", ">", 1)).alias("base_file"), window.alias("base_window"))


def contents_link_rows(lines: DataFrame) -> DataFrame:
    """Rows for contents_links (doc, ord, directive, key, text) from the :Index and :Link lines."""
    d = _parsed(lines).where("value <> '' and directive in ('index', 'link')")
    return d.select("doc", F.col("line").alias("ord"), F.when(F.col("directive") == "index", "index").otherwise("search").alias("directive"), F.lit(None).cast("int").alias("key"), F.col("value").alias("text"))


def contents_warnings(lines: DataFrame) -> DataFrame:
    """(doc, line, warning): lines that say something unusable. A line without digits is dropped silently."""
    d = _parsed(lines)
    known = F.col("directive").isin("title", "base", "index", "link", "include")
    warning = (
        F.when((F.col("directive") != "") & ~known, F.concat(F.lit("unsupported directive :"), "directive")).when(known & (F.col("value") == ""), F.concat(F.lit("empty :"), "directive"))
        .when((F.col("digits") != "") & F.coalesce(F.col("level") == 0, F.lit(False)), F.lit("level 0")).when((F.col("digits") != "") & F.coalesce(F.col("level") > 65535, F.lit(True)), F.lit("level out of range"))
        .when((F.col("digits") != "") & (F.col("title") == ""), F.lit("no title"))
    )
    return d.select("doc", "line", warning.alias("warning")).where("warning is not null")


def decode_text(content: Column, charset: Column) -> Column:
    """Bytes as text by charset byte; a byte that names none, and none at all, stand for windows-1252. Needs java_charsets."""
    text = F.decode(content, "windows-1252")
    for byte, name in CHARSETS.items():
        text = F.when(charset == byte, F.decode(content, name)).otherwise(text)
    return text


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Within it frames may be made that decode by any charset of Java; the session's own setting is put back."""
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _lookup(x: Column, table: dict[int, tuple]) -> Column:
    found = F.lit(None).cast("int")
    for charset, keys in table.items():
        found = F.when(x.isin(*keys), F.lit(charset)).otherwise(found)
    return found


def resolve_charset(fonts: DataFrame, charsets: DataFrame, locales: DataFrame) -> DataFrame:
    """fonts with their charset: an explicit one other than 1 by face index, else by face name, else by locale, else by language."""
    d = fonts.join(charsets, ["doc", "face_index"], "left").join(locales, "doc", "left")
    face = F.lower(F.trim("face_name"))
    by_face = _lookup(face, FACE_CHARSETS)
    by_locale = F.coalesce(_lookup(F.col("locale"), LOCALE_CHARSETS), _lookup(F.col("locale").bitwiseAND(0x3FF), LANGUAGE_CHARSETS))
    explicit = F.when(F.col("charset") != 1, F.col("charset"))
    return d.withColumn("charset", F.coalesce(explicit, by_face, by_locale)).drop("locale")
