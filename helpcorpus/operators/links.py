"""The hyperlink graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scalars import context_hash, document_identity, export_label, linked_identity, relative_only
from .resolve import default_window_for_topic, resolve_context_hash, resolve_topic_offset, resolve_window
from .topics import topic_start_offsets

# The most documents of a closure, and of a catalog's neighbours.
CLOSURE, CATALOG = 32, 32


def extract_hotspots(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each link of a page in order: seq, target, anchor_text."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?s)(<a href="[^"]*">.*?</a>)'), 1)
    d = pages.select("doc", "topic_index", F.posexplode(found).alias("seq", "a"))
    return d.select("doc", "topic_index", "seq", F.regexp_extract("a", '^<a href="([^"]*)"', 1).alias("target"), F.regexp_replace(F.regexp_extract("a", "(?s)^<a[^>]*>(.*)</a>$", 1), "<[^>]*>", "").alias("anchor_text"))


def describe_hotspots(hotspots: DataFrame) -> DataFrame:
    """A line for each target. hotspots(kind, topic_offset, hash, popup, help_file, macro)"""
    unsigned = F.lpad(F.hex(F.pmod(F.col("hash").cast("long"), F.lit(1 << 32))), 8, "0")
    popup = F.concat(F.lit(" popup="), F.col("popup").cast("string"))
    text = (
        F.when(F.col("kind") == "Internal", F.concat(F.lit("internal TOPICOFFSET="), F.col("topic_offset").cast("string"), popup)).when(F.col("kind") == "ContextHash", F.concat(F.lit("internal context hash=0x"), unsigned, popup))
        .when(F.col("kind") == "External", F.concat(F.lit("external TOPICOFFSET="), F.col("topic_offset").cast("string"), F.lit(" file="), "help_file")).otherwise(F.concat(F.lit("macro (safe-policy dispatch): "), "macro"))
    )
    return hotspots.withColumn("description", text)


def documents_by_identity(known_docs: DataFrame) -> DataFrame:
    """(identity, dst_doc): known documents by their path without case, dots and kinds of separators; the first of those that have one."""
    return known_docs.groupBy(document_identity(F.col("doc")).alias("identity")).agg(F.min("doc").alias("dst_doc"))


def resolve_hotspots(hotspots: DataFrame, contexts: DataFrame, anchors: DataFrame, known_docs: DataFrame, default_windows: DataFrame, windows: DataFrame) -> DataFrame:
    """hotspots with dst_doc, dst_topic, mode and win, and with the popup that is in force.

    Internal offsets and hashes lead within the document; a hash that leads to no context's topic is
    tried as an offset. An external link leads to the known document that its file names from the linking one's folder, to the
    linking one itself without a file. An even opcode makes it a popup. A destination's mode follows from the
    window that an external link asks for or its topic has; unresolved links have none. hotspots(doc,
    topic_index, seq, kind, topic_offset, hash, popup, opcode, help_file, win_name, win_number)
    """
    external = F.col("kind") == "External"
    d = hotspots.withColumn("identity", F.when(external, linked_identity(F.col("doc"), F.col("help_file")))).join(documents_by_identity(known_docs), "identity", "left").drop("identity")
    d = d.withColumn("dst_doc", F.when(external, F.col("dst_doc")).otherwise(F.col("doc"))).withColumn("popup", F.when(external, F.coalesce(F.col("opcode") % 2 == 0, F.lit(False))).otherwise(F.col("popup")))
    d = d.withColumnRenamed("doc", "_src").withColumnRenamed("dst_doc", "doc")
    by_hash = resolve_context_hash(d.withColumn("_h", F.when(F.col("kind") == "ContextHash", F.col("hash"))), contexts, anchors, "_h", "_t1").drop("_h")
    offset = F.when(F.col("kind") == "ContextHash", F.when(F.col("_t1").isNull(), F.col("hash").cast("long"))).otherwise(F.col("topic_offset"))
    both = resolve_topic_offset(by_hash.withColumn("_o", offset), anchors, "_o", "_t2").drop("_o")
    found = both.withColumn("dst_topic", F.coalesce("_t1", "_t2")).drop("_t1", "_t2").withColumnRenamed("doc", "dst_doc").withColumnRenamed("_src", "doc")
    asked = [F.when(external, F.col(c)).alias(c) for c in ("win_name", "win_number")]
    return topic_mode(found.select(*[c for c in found.columns if c not in ("win_name", "win_number")], *asked), anchors, default_windows, windows)


def topic_mode(edges: DataFrame, anchors: DataFrame, default_windows: DataFrame, windows: DataFrame) -> DataFrame:
    """edges(dst_doc, dst_topic, popup, win_name, win_number) with mode and win of their topic; none where there is no topic."""
    starts = topic_start_offsets(anchors.select("doc", "topic_index").distinct(), anchors).select(F.col("doc").alias("dst_doc"), F.col("topic_index").alias("dst_topic"), F.col("start_offset").alias("dst_offset"))
    d = link_mode(edges.join(starts, ["dst_doc", "dst_topic"], "left"), default_windows, windows).drop("dst_offset")
    there = F.col("dst_topic").isNotNull()
    return d.withColumn("mode", F.when(there, F.col("mode"))).withColumn("win", F.when(there, F.col("win")))


def link_mode(edges: DataFrame, default_windows: DataFrame, windows: DataFrame) -> DataFrame:
    """edges with mode and win: popup; an explicit window other than main is secondary; else the target's default window decides. edges(dst_doc, dst_offset, popup, win_name, win_number)"""
    d = edges.withColumnRenamed("doc", "_src").withColumnRenamed("dst_doc", "doc")
    d = resolve_window(d, windows).withColumnRenamed("win", "_explicit")
    by_offset = default_window_for_topic(default_windows.select("doc", F.col("topic_offset").alias("start_offset")).distinct(), default_windows, windows)
    d = d.join(by_offset.select("doc", F.col("start_offset").alias("dst_offset"), F.col("win_ordinal").alias("_default"), F.col("win_name").alias("_default_name")), ["doc", "dst_offset"], "left")
    named = windows.select("doc", F.col("ordinal").alias("_explicit"), F.lower("name").alias("_explicit_name"))
    d = d.join(named, ["doc", "_explicit"], "left")
    explicit_main = F.coalesce(F.lower("win_name") == "main", F.lit(False)) | F.coalesce(F.col("_explicit_name") == "main", F.lit(False))
    asked = F.col("win_name").isNotNull() | F.col("win_number").isNotNull()
    default_other = F.col("_default").isNotNull() & ~F.coalesce(F.lower("_default_name") == "main", F.lit(False))
    mode = F.when(F.col("popup"), "popup").when(asked & ~explicit_main, "secondary").when(explicit_main, "main").when(default_other, "secondary").otherwise("main")
    win = F.when(F.col("popup"), None).when(asked & ~explicit_main, F.col("_explicit")).when(explicit_main, None).when(default_other, F.col("_default"))
    d = d.withColumns({"mode": mode, "win": win.cast("int")})
    return d.drop("_explicit", "_explicit_name", "_default", "_default_name").withColumnRenamed("doc", "dst_doc").withColumnRenamed("_src", "doc")


def unresolved_hotspots(resolved: DataFrame) -> DataFrame:
    """(doc, topic_index, seq, message) of links that lead nowhere."""
    unsigned = F.lpad(F.hex(F.pmod(F.col("hash").cast("long"), F.lit(1 << 32))), 8, "0")
    message = (
        F.when(F.col("kind") == "Internal", F.concat(F.lit("Unresolved TOPICOFFSET "), F.col("topic_offset").cast("string"))).when(F.col("kind") == "ContextHash", F.concat(F.lit("Unresolved context hash 0x"), unsigned))
        .when(F.col("dst_doc").isNull(), "The linked HLP was not embedded in this HTML export.").otherwise(F.concat(F.lit("Unresolved linked TOPICOFFSET "), F.col("topic_offset").cast("string"), F.lit(" in "), "dst_doc"))
    )
    return resolved.where("dst_topic is null").select("doc", "topic_index", "seq", message.alias("message"))


def unresolved_counts(unresolved: DataFrame) -> DataFrame:
    """(doc, n): how many links of a document lead nowhere."""
    return unresolved.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def referenced_files(refs: DataFrame) -> DataFrame:
    """(doc, rank, help_file): files that a document names, distinct without case, the spelling and order first seen. refs(doc, source_rank, ord, help_file)"""
    seen = refs.where("trim(help_file) <> ''").groupBy("doc", F.lower("help_file").alias("_k")).agg(F.min(F.struct("source_rank", "ord", "help_file")).alias("f"))
    return seen.select("doc", F.row_number().over(W.partitionBy("doc").orderBy("f.source_rank", "f.ord", "f.help_file")).alias("rank"), F.col("f.help_file").alias("help_file"))


def reference_policy(refs: DataFrame) -> DataFrame:
    return refs.withColumn("allowed", relative_only(F.col("help_file")))


def linked_file_closure(seeds: DataFrame, refs: DataFrame, known_docs: DataFrame, cap: int | None = CLOSURE) -> tuple[DataFrame, DataFrame]:
    """Breadth-first reach from each seed: (root, doc, hop, rank), and (root, doc, help_file, warning).

    refs(doc, rank, help_file); a file is looked up from its referrer's folder among the known documents.
    Order within a hop is by the referrer's place and the reference's rank. Beyond the cap a document is
    named as skipped, one that is not known as one that cannot be opened, each once for its referrer. A
    hop is one join and one anti-join; what it found and skipped is written, so no plan grows with hops.
    """
    known = documents_by_identity(known_docs)
    edges = refs.select("doc", "rank", "help_file", linked_identity(F.col("doc"), F.col("help_file")).alias("identity"), relative_only(F.col("help_file")).alias("allowed")).where("trim(help_file) <> ''")
    edges = cut(edges.join(known, "identity", "left").select("doc", F.col("rank").alias("nth"), "help_file", "allowed", F.col("dst_doc").alias("next")))
    roots = seeds.withColumn("identity", document_identity(F.col("doc"))).join(known, "identity", "left").select(F.coalesce("dst_doc", "doc").alias("doc")).distinct()
    reached = cut(roots.select(F.col("doc").alias("root"), "doc", F.lit(0).alias("hop"), F.lit(1).alias("rank")))
    frontier, refused, hop = reached, [], 0
    while True:
        hop += 1
        step = frontier.select("root", "doc", F.col("rank").alias("up")).join(edges, "doc")
        why = F.when(~F.col("allowed"), "skipped: not a relative path").when(F.col("next").isNull(), "skipped: cannot be opened")
        new = step.where("allowed and next is not null").groupBy("root", F.col("next").alias("doc")).agg(F.min(F.struct("up", "nth")).alias("place")).join(reached.select("root", "doc"), ["root", "doc"], "left_anti")
        so_far = reached.groupBy("root").agg(F.max("rank").alias("so_far"))
        new = new.join(so_far, "root").withColumn("rank", F.col("so_far") + F.row_number().over(W.partitionBy("root").orderBy("place")))
        new = cut(new.select("root", "doc", F.lit(hop).alias("hop"), "rank"))
        over = new.limit(0) if cap is None else new.where(F.col("rank") > cap)
        late = step.join(over.select("root", F.col("doc").alias("next")), ["root", "next"]).select("root", "doc", "help_file", F.lit("skipped: over the limit").alias("warning"))
        refused.append(cut(step.select("root", "doc", "help_file", why.alias("warning")).where("warning is not null").unionByName(late).distinct()))
        frontier = new if cap is None else new.where(F.col("rank") <= cap)
        if frontier.isEmpty():
            return reached, reduce(DataFrame.unionByName, refused).distinct()
        reached = cut(reached.unionByName(frontier))


def related_catalog(links: DataFrame, known_docs: DataFrame, cap: int = CATALOG) -> tuple[DataFrame, DataFrame]:
    """(doc, rank, related_doc), and (doc, rank, help_file, warning): one hop over index links and then search links.

    links(doc, ord, kind, help_file). A file is looked up from the document's folder; the document itself
    and files seen before are passed over. The first `cap` files are tried, rank says as which; those
    that are no known document are a warning, and so are paths that are not relative (without a rank)
    and, once for a document, that there are more files (rank cap + 1).
    """
    nth = F.struct(F.when(F.col("kind") == "index", 0).otherwise(1).alias("kind"), F.col("ord"))
    d = links.withColumn("place", nth).withColumn("allowed", relative_only(F.col("help_file")))
    refused = d.where("not allowed").select("doc", F.lit(None).cast("int").alias("rank"), "help_file", F.lit("skipped: not a relative path").alias("warning"))
    d = d.where("allowed").withColumn("identity", linked_identity(F.col("doc"), F.col("help_file"))).where(F.col("identity") != document_identity(F.col("doc")))
    d = d.groupBy("doc", "identity").agg(F.min("place").alias("place"), F.min_by("help_file", "place").alias("help_file"))
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("doc").orderBy("place"))).where(F.col("rank") <= cap + 1)
    d = d.join(documents_by_identity(known_docs), "identity", "left")
    why = F.when(F.col("rank") > cap, "skipped: over the limit").when(F.col("dst_doc").isNull(), "skipped: cannot be opened")
    file = F.when(F.col("rank") <= cap, F.col("help_file"))
    missing = d.select("doc", "rank", file.alias("help_file"), why.alias("warning")).where("warning is not null")
    return d.where(F.col("dst_doc").isNotNull() & (F.col("rank") <= cap)).select("doc", "rank", F.col("dst_doc").alias("related_doc")), refused.unionByName(missing)


def destination_tooltips(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """edges with tooltip: a popup shows its destination's text where it has any, other links its label."""
    body = F.trim(F.regexp_replace(F.regexp_replace("plain_text", "\r\n", "\n"), r"^\s+|\s+$", ""))
    d = topics.select(F.col("doc").alias("dst_doc"), F.col("topic_index").alias("dst_topic"), body.alias("_body"), export_label(F.col("title"), F.col("topic_index")).alias("_label"))
    return edges.join(d, ["dst_doc", "dst_topic"], "left").withColumn("tooltip", F.when(F.col("popup") & (F.col("_body") != ""), F.col("_body")).otherwise(F.col("_label"))).drop("_body", "_label")


def scaled(v: Column, target: Column, source: Column) -> Column:
    return F.floor(v.cast("long") * target / F.greatest(source, F.lit(1))).cast("long")


def scale_picture_hotspots(rects: DataFrame) -> DataFrame:
    """Rectangles from source to target size; width and height stay one at least. rects(x, y, w, h, source_w, source_h, target_w, target_h)"""
    sx, sy = (lambda c: scaled(F.col(c), F.col("target_w"), F.col("source_w"))), (lambda c: scaled(F.col(c), F.col("target_h"), F.col("source_h")))
    return rects.withColumns({"sx": sx("x"), "sy": sy("y"), "sw": F.greatest(sx("w"), F.lit(1)), "sh": F.greatest(sy("h"), F.lit(1))})


def _pieces(d: DataFrame, a: str, n: str, level: str, cell: str) -> DataFrame:
    """d with the cells that the range from a on of n whole numbers is cut into: at each level those of 4^level that it fills and whose parent it does not, six at most."""
    top = F.expr(f"greatest(0, int(ceil(log2({n}) / 2)))")
    d = d.withColumn(level, F.explode(F.sequence(F.lit(0), top)))
    first = lambda k: f"shiftright({a} + shiftleft(1L, 2 * ({k})) - 1, 2 * ({k}))"
    end = lambda k: f"shiftright({a} + {n}, 2 * ({k}))"
    at, to, inner, outer = first(level), end(level), f"4 * {first(f'{level} + 1')}", f"4 * {end(f'{level} + 1')}"
    run = lambda x, y: f"CASE WHEN {x} < {y} THEN sequence({x}, {y} - 1) ELSE CAST(array() AS array<bigint>) END"
    cells = f"CASE WHEN {inner} < {outer} THEN concat({run(at, inner)}, {run(outer, to)}) ELSE {run(at, to)} END"
    return d.withColumn(cell, F.explode(F.expr(cells)))


def hit_test(points: DataFrame, rects: DataFrame, by: list[str]) -> DataFrame:
    """(point_id, rect_id): the last rectangle in order of the point's own picture that holds it, edges at right and bottom left out.

    by: the columns that name a picture, in both tables; places and sizes are whole numbers. A rectangle is
    cut into tiles whose sides are powers of four, some dozens by its size's logarithms, and a tile keeps the
    last of the rectangles that it is part of. So however many rectangles lie over each other, a place meets
    one row for each shape of tile. Places that many points share are looked up once.
    """
    r = rects.where("w > 0 and h > 0 and ord is not null").select(*by, "rect_id", "ord", *[F.col(c).cast("long").alias(c) for c in "xywh"])
    near = r.repartition(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, F.expr("shiftright(x, 6)"), F.expr("shiftright(y, 6)"))  # neighbours share tiles
    r = _pieces(_pieces(near, "x", "w", "lx", "cx"), "y", "h", "ly", "cy")
    shape = [*by, "lx", "ly", "cx", "cy"]
    tiles = cut(r.groupBy(*shape).agg(F.max("ord").alias("ord"), F.max_by("rect_id", "ord").alias("rect_id")))
    shapes = tiles.select("lx", "ly").distinct().agg(F.collect_set(F.struct("lx", "ly")).alias("shapes"))  # a row for each two powers of four
    place = points.select("point_id", *by, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"))
    p = place.select(*by, "px", "py").distinct().join(F.broadcast(shapes)).select(*by, "px", "py", F.inline("shapes"))
    p = p.withColumn("cx", F.expr("shiftright(px, 2 * lx)")).withColumn("cy", F.expr("shiftright(py, 2 * ly)"))
    last = [F.max("ord").alias("ord"), F.max_by("rect_id", "ord").alias("rect_id")]
    top = p.join(tiles, shape).groupBy(*by, "px", "py").agg(*last)
    return place.join(top, [*by, "px", "py"], "left").groupBy("point_id").agg(F.max_by("rect_id", "ord").alias("rect_id"))


def resolve_picture_hotspots(hotspots: DataFrame, contexts: DataFrame) -> DataFrame:
    """Hotspots of pictures with kind, topic_offset and warning: macros stay; a name without a context is a warning; a named window makes a link external. hotspots(doc, spot_id, macro, name, win_name)"""
    named = contexts.groupBy("doc", "hash").agg(F.min_by("topic_offset", "ord").alias("topic_offset"))
    d = hotspots.withColumn("hash", F.when(F.col("macro").isNull(), context_hash(F.col("name")))).join(named, ["doc", "hash"], "left")
    kind = F.when(F.col("macro").isNotNull(), "Macro").when(F.col("topic_offset").isNull(), None).when(F.col("win_name").isNotNull(), "External").otherwise("Internal")
    warning = F.when(F.col("macro").isNull() & F.col("topic_offset").isNull(), F.concat(F.lit("unknown context "), "name"))
    return d.withColumn("kind", kind).withColumn("warning", warning)


def picture_usage(pictures: DataFrame) -> DataFrame:
    """(doc, source, picture_index, n_uses, n_topics): indexed pictures, each decoded once however often it is used; embedded and unsupported ones are counted together by kind. pictures(doc, topic, source, picture_index)"""
    index = F.when(F.col("source") == "indexed", F.col("picture_index"))
    per_topic = pictures.groupBy("doc", "source", index.alias("picture_index"), "topic").agg(F.count(F.lit(1)).alias("n"))
    return per_topic.groupBy("doc", "source", "picture_index").agg(F.sum("n").alias("n_uses"), F.count(F.lit(1)).alias("n_topics"))
