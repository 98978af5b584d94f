"""Column functions: folding, labels, hashes, escapes, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of bytes in a context hash that differ from the rule in hash_weight.
HASH_EXCEPTIONS = {0x00: 0, 0x21: 11, 0x2E: 12, 0x30: 10, 0x5B: 11, 0x5C: 12, 0x5D: 13, 0x5E: 14, 0x5F: 13, 0xB4: 11}


def hash_weight(byte: int) -> int:
    """What a byte adds to a context hash: 48 less than it; small letters as capitals, high bytes as signed ones."""
    if byte in HASH_EXCEPTIONS:
        return HASH_EXCEPTIONS[byte]
    if 0x60 <= byte < 0x80:
        return byte - 80
    return byte - 48 if byte < 0xB0 else byte - 304


def wrap32(x: Column) -> Column:
    """A BIGINT as a wrapped signed 32-bit number."""
    return F.shiftright(F.shiftleft(x, 32), 32)


def context_hash(name: Column) -> Column:
    """The wrapped 32-bit hash of a context name's bytes; 1 for the empty name, null for null."""
    weights = F.expr(f"array({', '.join(f'{hash_weight(b)}L' for b in range(256))})")  # one literal once it is folded
    code = lambda i: F.conv(F.hex(F.substring(F.encode(name, "UTF-8"), i, F.lit(1))), 16, 10).cast("int")
    n = F.octet_length(name)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda h, i: F.pmod(h * 43 + F.get(weights, code(i)), F.lit(1 << 32)))
    return F.when(n == 0, F.lit(1).cast("long")).when(n > 0, wrap32(total)).cast("int")


def fold_text(s: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


def topic_label(title: Column, index: Column) -> Column:
    """The trimmed title; a blank one is `Topic n` counted from one."""
    return F.when(F.trim(title) != "", F.trim(title)).otherwise(F.concat(F.lit("Topic "), (index + 1).cast("string")))


def export_label(title: Column, index: Column) -> Column:
    """The title as it is, unless it is blank."""
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", F.concat(F.lit("Topic "), (index + 1).cast("string"))).otherwise(title)


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def js_string(s: Column) -> Column:
    """A quoted literal that cannot end a script element."""
    named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "<": "\\u003C", ">": "\\u003E", "&": "\\u0026"}
    escaped = s
    for a, b in named.items():
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    every = escaped
    for c in (chr(c) for c in range(32) if chr(c) not in named):
        every = F.replace(every, F.lit(c), F.lit(f"\\u{ord(c):04X}"))
    # most names have nothing to escape, and most texts no other control characters
    escaped = F.when(s.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), every).otherwise(escaped)
    return F.concat(F.lit('"'), F.when(s.rlike(r'[\x00-\x1F"\\<>&]'), escaped).otherwise(s), F.lit('"'))


def path_identity(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def dotless(path: Column) -> Column:
    """A path with `/`, without empty parts and `.`, and without `..` where a folder stands before it; a leading `/` stays."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    start = F.array().cast("array<string>")

    def walk(kept: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(kept) > 0) & (F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("")) != "..")
        return F.when(part.isin("", "."), kept).when(up, F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.array_append(kept, part))

    parts = F.array_join(F.aggregate(F.split(p, "/"), start, walk), "/")
    return F.concat(F.when(p.startswith("/"), "/").otherwise(""), parts)


def document_identity(path: Column) -> Column:
    """What two spellings of a document's path have in common."""
    return path_identity(dotless(path))


def linked_identity(current: Column, target: Column) -> Column:
    """The identity of the document that a reference names: the linking one where it names none."""
    named = F.trim(F.coalesce(target, F.lit(""))) != ""
    return F.when(named, document_identity(external_path(current, target))).otherwise(document_identity(current))


def relative_only(path: Column) -> Column:
    """May be followed without asking: not blank, no leading separator, no drive."""
    p = F.trim(F.coalesce(path, F.lit("")))
    return (p != "") & ~F.substring(p, 1, 1).isin("/", "\\") & (F.substring(p, 2, 1) != ":")


def external_path(current: Column, target: Column) -> Column:
    """The target's path as seen from the current file: absolute ones stay, others join its folder."""
    t = F.replace(target, F.lit("\\"), F.lit("/"))
    c = F.replace(current, F.lit("\\"), F.lit("/"))
    folder = F.regexp_extract(c, r"^(.*/)[^/]*$", 1)
    return F.when(t.startswith("/") | (F.substring(t, 2, 1) == ":"), t).otherwise(F.concat(folder, t))
