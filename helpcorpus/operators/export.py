"""Selecting topics and exporting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import passing_shuffles, written
from ..functions.ordering import numbered, read_lines, write_lines
from ..functions.scalars import export_label, file_name, html_escape, js_string

#: Parts of a site that register actions, in the order in which they do.
SECTIONS = ("topics", "contents", "listing", "index")
PARTS = ("topics", "manifest", "documents", "contents", "listing", "index", "search", "actions")


def _range_tokens(specs: DataFrame) -> DataFrame:
    """specs(doc, spec, n) by token, with its bounds and what is wrong with it."""
    d = specs.select("doc", "spec", "n", F.posexplode(F.split("spec", "[,;]")).alias("at", "token")).withColumn("token", F.trim("token")).where("token <> ''")
    single, both = F.regexp_extract("token", "^([0-9]{1,9})$", 1), r"^([0-9]{1,9})\s*-\s*([0-9]{1,9})$"
    number = lambda x: F.nullif(x, F.lit("")).try_cast("int")
    d = d.withColumn("a", F.coalesce(number(single), number(F.regexp_extract("token", both, 1)))).withColumn("b", F.coalesce(number(single), number(F.regexp_extract("token", both, 2))))
    error = (
        F.when(F.regexp_count("token", F.lit("-")) > 1, "malformed range").when(F.col("a").isNull() | F.col("b").isNull(), "not a number")
        .when((F.col("a") < 1) | (F.col("a") > F.col("n")) | (F.col("b") < 1) | (F.col("b") > F.col("n")), "out of range").when(F.col("a") > F.col("b"), "backwards")
    )
    return d.withColumn("error", error)


def parse_topic_ranges(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, spec, topic_index) of good specs, each topic once and from 0; (doc, spec, error) of the others: the first wrong token's, or that nothing is selected."""
    tokens = _range_tokens(specs)
    wrong = tokens.where("error is not null").groupBy("doc", "spec").agg(F.min_by("error", "at").alias("error"))
    none = specs.select("doc", "spec").join(tokens.select("doc", "spec").distinct(), ["doc", "spec"], "left_anti").withColumn("error", F.lit("nothing selected"))
    good = tokens.join(wrong, ["doc", "spec"], "left_anti")
    return good.select("doc", "spec", F.explode(F.sequence(F.col("a") - 1, F.col("b") - 1)).alias("topic_index")).distinct(), wrong.unionByName(none)


def select_topics(topics: DataFrame, selection: DataFrame) -> DataFrame:
    return topics.join(selection, ["doc", "topic_index"], "left_semi")


def template_id(doc: str = "doc", topic: str = "topic_index") -> Column:
    return F.concat_ws("-", F.lit("hlp-topic"), doc, F.col(topic).cast("string"))


def render_topic_html(runs: DataFrame) -> DataFrame:
    """(doc, topic_index, html): one section for each topic, fixed records before the body, texts escaped; a run with an action is a link that carries its id and tooltip. runs(doc, topic_index, pos, region, text, action_id, tooltip); a topic's records are its own bound."""
    rank = F.when(F.col("region") == "non_scrolling", 0).otherwise(1)
    title = F.when(F.col("tooltip").isNotNull(), F.concat(F.lit(' title="'), html_escape(F.col("tooltip")), F.lit('"'))).otherwise("")
    link = F.concat(F.lit('<a class="hlp-link" href="#" data-action="'), F.col("action_id").cast("string"), F.lit('"'), title, F.lit(">"), html_escape(F.col("text")), F.lit("</a>"))
    piece = F.concat(F.lit("<p>"), F.when(F.col("action_id").isNotNull(), link).otherwise(html_escape(F.col("text"))), F.lit("</p>"))
    rows = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "pos", piece.alias("p"))))
    inner = lambda k: F.array_join(F.transform(F.filter("rows", lambda r: r["rank"] == k), lambda r: r["p"]), "")
    d = runs.groupBy("doc", "topic_index").agg(rows.alias("rows"))
    return d.select("doc", "topic_index", F.concat(F.lit('<section id="'), html_escape(template_id()), F.lit('"><header>'), inner(0), F.lit("</header>"), inner(1), F.lit("</section>")).alias("html"))


def program_ops(calls: DataFrame, by: list[str]) -> DataFrame:
    """(*by, ops): the allowed calls of a program in order, as a list of names and arguments; a program has at most 256 calls. calls(*by, call_no, canonical, args, verdict)"""
    call = F.concat(F.lit("["), F.array_join(F.transform(F.concat(F.array("canonical"), "args"), lambda a: js_string(a)), ","), F.lit("]"))
    ops = F.array_sort(F.collect_list(F.struct("call_no", call.alias("call"))))
    d = calls.where("verdict = 'ALLOW'").groupBy(*by).agg(ops.alias("rows"))
    return d.select(*by, F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["call"]), ","), F.lit("]")).alias("ops"))


def link_actions(spots: DataFrame) -> DataFrame:
    """The actions of links in texts, which come first in an export. See site_actions."""
    return spots.select(F.lit(0).alias("section"), F.col("doc").alias("grp"), F.lit("").alias("sub"), F.col("pos").cast("long").alias("seq"), "kind", "dst_doc", "topic_index", "mode", "win_name", "ops", "message")


def site_actions(spots: DataFrame, contents: DataFrame, topics: DataFrame, destinations: DataFrame) -> DataFrame:
    """The actions that a site's parts register: (section, grp, sub, seq) is their order, then what action_registry reads.

    spots(doc, pos, kind, dst_doc, topic_index, mode, win_name, ops, message): links in texts, by the place
    of their run; contents(doc, line, target_doc, topic_index, mode, win): lines, of which those that lead
    somewhere open it; topics(doc, topic_index) are opened from their listing; destinations(key, doc,
    topic_index) from the keyword index.
    """
    text = lambda c: F.col(c) if c else F.lit(None).cast("string")

    def opened(d: DataFrame, section: str, grp: str, sub: str | None, seq: str, doc: str, mode: str | None = None, win: str | None = None) -> DataFrame:
        m = F.coalesce(text(mode), F.lit("main"))
        return d.select(F.lit(SECTIONS.index(section)).alias("section"), F.col(grp).alias("grp"), F.coalesce(text(sub), F.lit("")).alias("sub"), F.col(seq).cast("long").alias("seq"), F.lit("open").alias("kind"), F.col(doc).alias("dst_doc"), "topic_index", m.alias("mode"), text(win).alias("win_name"), text(None).alias("ops"), text(None).alias("message"))

    lines = opened(contents.where("topic_index is not null"), "contents", "doc", None, "line", "target_doc", "mode", "win")
    listing = opened(topics, "listing", "doc", None, "topic_index", "doc")
    index = opened(destinations, "index", "key", "doc", "topic_index", "doc")
    return link_actions(spots).unionByName(lines).unionByName(listing).unionByName(index)


def action_registry(actions: DataFrame) -> DataFrame:
    """(section, grp, sub, seq, action_id, json): ids of the whole export without gaps, in the order of registration; open, program and noop actions. See site_actions."""
    window = F.when(F.col("win_name").isNotNull(), F.concat(F.lit(",window:"), js_string(F.col("win_name")))).otherwise("")
    opened = F.concat(F.lit("{kind:\"open\",doc:"), js_string(F.col("dst_doc")), F.lit(",topic:"), F.col("topic_index").cast("string"), F.lit(",mode:\""), "mode", F.lit("\""), window, F.lit("}"))
    program = F.concat(F.lit("{kind:\"program\",ops:"), F.coalesce("ops", F.lit("[]")), F.lit("}"))
    json = F.when(F.col("kind") == "open", opened).when(F.col("kind") == "program", program).otherwise(F.concat(F.lit('{kind:"noop",message:'), js_string(F.col("message")), F.lit("}")))
    order = ["section", "grp", "sub", "seq"]
    # finding the ranges reads rows up to twice more, so they are made before
    return numbered(written(actions.select(*order, json.alias("json"))), order, "action_id").select(*order, "action_id", "json")


def with_actions(rows: DataFrame, registry: DataFrame, section: str, grp: str, seq: str, sub: str | None = None) -> DataFrame:
    """rows with the action_id that they registered, null for rows that have none."""
    ids = registry.where(F.col("section") == SECTIONS.index(section)).select(F.col("grp").alias("_grp"), F.col("sub").alias("_sub"), F.col("seq").alias("_seq"), "action_id")
    on = (F.col(grp) == F.col("_grp")) & (F.col(seq) == F.col("_seq"))
    on = on & (F.col(sub) == F.col("_sub")) if sub else on
    return rows.join(ids, on, "left").drop("_grp", "_sub", "_seq")


def linked_runs(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """with_actions of runs, in ranges of doc and topic_index: ids go to the topics of their runs, so that texts are shuffled once, to where sections are put together."""
    ids = registry.where(F.col("section") == SECTIONS.index("topics")).select(F.col("grp").alias("doc"), F.col("seq").alias("pos"), "action_id")
    links = runs.select("doc", "topic_index", "pos").join(ids, ["doc", "pos"]).distinct()
    rows = runs.withColumn("_run", F.lit(True)).unionByName(links.withColumn("_run", F.lit(False)), allowMissingColumns=True)
    own = F.collect_list("action_id").over(W.partitionBy("doc", "topic_index", "pos"))
    d = rows.repartitionByRange("doc", "topic_index").withColumn("_ids", own).where("_run")
    return d.select(*runs.columns, F.explode_outer("_ids").alias("action_id"))


def topic_manifest(topics: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(doc, topic_index, json): a line for each topic with label, template and browse neighbours. neighbors(doc, topic_index, browse_prev, browse_next)"""
    d = topics.join(neighbors, ["doc", "topic_index"], "left")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    json = F.concat(F.lit("{topic:"), F.col("topic_index").cast("string"), F.lit(",title:"), js_string(export_label(F.col("title"), F.col("topic_index"))), F.lit(",template:"), js_string(template_id()), F.lit(",browsePrev:"), number("browse_prev"), F.lit(",browseNext:"), number("browse_next"), F.lit("}"))
    return d.select("doc", "topic_index", json.alias("json"))


def documents_manifest(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(doc, json): name, title (the file's name where blank) and number of topics. The topics' own lines are topic_manifest, so no document's list has to fit one row."""
    n = topics.groupBy("doc").agg(F.count(F.lit(1)).alias("topics"))
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", file_name(F.col("doc"))).otherwise(F.col("title"))
    return docs.join(n, "doc", "left").select("doc", F.to_json(F.struct(file_name(F.col("doc")).alias("name"), title.alias("title"), F.coalesce("topics", F.lit(0)).alias("topics"))).alias("json"))


def output_path(path: str) -> str:
    """The same path with the extension html."""
    folder, slash, name = path.rpartition("/")
    stem, dot, ending = name.rpartition(".")
    return path if dot and stem and ending.lower() == "html" else f"{folder}{slash}{stem if dot and stem else name}.html"


def _write_site(path: str, docs: DataFrame, topics: DataFrame, runs: DataFrame, spots: DataFrame, neighbors: DataFrame, contents: DataFrame, keywords: DataFrame, destinations: DataFrame, compression: str) -> None:
    registry = action_registry(site_actions(spots, contents, topics, destinations))
    number = F.coalesce(F.col("action_id").cast("string"), F.lit("null"))
    line = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
    label = js_string(export_label(F.col("title"), F.col("topic_index")))
    sections = render_topic_html(linked_runs(runs, registry))
    tree = with_actions(contents.drop("topic_index"), registry, "contents", "doc", "line")
    listing = with_actions(topics.select("doc", "topic_index", "title"), registry, "listing", "doc", "topic_index")
    # a destination's place in the registry is its own
    index = registry.where(F.col("section") == SECTIONS.index("index")).select(F.col("grp").alias("key"), F.col("sub").alias("doc"), F.col("seq").alias("topic_index"), "action_id").join(keywords.select("key", "keyword"), "key")
    place = ["doc", "topic_index"]
    parts = {
        "topics": (sections, place, F.replace("html", F.lit("\n"), F.lit("&#10;"))), "manifest": (topic_manifest(topics, neighbors), place, "json"), "documents": (documents_manifest(docs, topics), ["doc"], "json"),
        "contents": (tree, ["doc", "line"], line("{level:", F.col("level").cast("string"), ",title:", js_string(F.col("title")), ",action:", number, "}")), "listing": (listing, place, line("{title:", label, ",action:", number, "}")),
        "index": (index, ["key", "doc", "topic_index"], line("{keyword:", js_string(F.col("keyword")), ",action:", number, "}")),
        "search": (topics, place, line("{doc:", js_string(F.col("doc")), ",topic:", F.col("topic_index").cast("string"), ",title:", label, ",text:", js_string(F.col("plain_text")), "}")), "actions": (registry, ["action_id"], "json"),
    }
    for part, (d, order, value) in parts.items():
        write_lines(d, order, f"{path}/{part}", value, ranged=part == "topics", compression=compression)


def export_site(
    path: str, docs: DataFrame, topics: DataFrame, warnings: DataFrame, runs: DataFrame, spots: DataFrame, neighbors: DataFrame, contents: DataFrame, keywords: DataFrame, destinations: DataFrame,
    compression: str = "none",
) -> DataFrame:
    """Writes a site under path, whose name gets the extension html; returns (path, document_count, topic_count, warning_count).

    Its parts are lines of text in order (see write_lines): topics (sections), manifest, documents, contents,
    listing, index, search, and the actions, whose line n is action n. Links in sections, lines of
    contents, of the listing and of the index carry the ids of their actions. runs(doc, topic_index, pos,
    region, text, tooltip): the runs of texts, spots the links among them; neighbors(doc, topic_index,
    browse_prev, browse_next), contents(doc, line, level, title, target_doc, topic_index, mode, win),
    keywords(key, keyword), destinations(key, doc, topic_index), each once. A site holds texts twice, to be shown and to be
    searched; its files may be compressed ("gzip").
    """
    path = output_path(path)
    with passing_shuffles(topics.sparkSession):
        _write_site(path, docs, topics, runs, spots, neighbors, contents, keywords, destinations, compression)
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    return one(docs, "document_count").crossJoin(one(topics, "topic_count")).crossJoin(one(warnings, "warning_count")).select(F.lit(path).alias("path"), "*")


def read_site(spark: SparkSession, path: str, value: str | Column = "value") -> DataFrame:
    """(part, nth, value): the lines of all parts of a written site, or a value made of each, with their places from 0."""
    out = None
    for part in PARTS:
        d = read_lines(spark, f"{output_path(path)}/{part}", value).select(F.lit(part).alias("part"), "nth", "value")
        out = d if out is None else out.unionByName(d)
    return out


def dump_lines(**sections: DataFrame) -> DataFrame:
    """(doc, section, seq, line) of a text report; sections are rows of doc, seq and line."""
    parts = [d.select("doc", F.lit(name).alias("section"), F.col("seq").cast("long").alias("seq"), "line") for name, d in sections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_dump(path: str, lines: DataFrame) -> None:
    """The report of all documents, in the order of document, section and seq; each line after its document and a tab."""
    write_lines(lines.withColumn("value", F.concat("doc", F.lit("\t"), "line")), ["doc", "section", "seq", "line"], path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(nth, doc, line): the report's lines in order."""
    return read_lines(spark, path).select("nth", F.substring_index("value", "\t", 1).alias("doc"), F.expr("substring(value, instr(value, '\t') + 1)").alias("line"))
