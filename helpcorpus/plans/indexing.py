"""Queries over keywords, search and contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import written
from ..operators import contents as C
from ..operators import keywords as K
from ..operators import search as S
from ..sources import ingest as I
from .assembly import _ENTRIES, asof
from .registry import Tables, query, view

view("lookups", "SELECT doc AS lookup, doc, 'a' AS table_id, 'en-0; fr-1;de-0 ;EN-0;missing;;en-0;es-2' AS names FROM {docs}")
_REACHED = f"""(SELECT DISTINCT doc, table_id, ord, keyword, topic_index
    FROM ({asof('(SELECT doc, table_id, ord, keyword, unnest(offsets) AS topic_offset FROM keywords)', 'title_anchors', 'topic_offset', 'r.doc, r.table_id, r.ord, r.keyword')})
    WHERE topic_index IS NOT NULL)"""
view("reached_duck", "SELECT 1", _REACHED[1:-1])


def reached(t: Tables, table: str = "K"):
    return K.keyword_topics(t("keywords").where(F.col("table_id") == table), t("title_anchors"))


@query("resolve_keywords", """SELECT doc, keyword, string_agg(CAST(topic_index AS STRING), ',' ORDER BY topic_index) AS topics FROM reached_duck WHERE table_id = 'K'
    GROUP BY doc, ord, keyword""")
def _(t: Tables):
    return K.resolve_keywords(t("keywords").where("table_id = 'K'"), t("title_anchors")).select("doc", "keyword", F.array_join(F.col("topic_indices").cast("array<string>"), ",").alias("topics"))


_LOOKUP = """
    WITH n AS (SELECT lookup, doc, upper(table_id) AS table_id, trim(unnest(string_split(names, ';'))) AS name, unnest(range(len(string_split(names, ';')))) AS nm FROM lookups),
    h AS (SELECT n.lookup, n.doc, n.nm, k.ord, unnest(k.offsets) AS topic_offset, unnest(range(len(k.offsets))) AS nth FROM n
    JOIN keywords k ON n.doc = k.doc AND n.table_id = upper(k.table_id) AND n.name = k.keyword WHERE n.name <> ''),
    f AS (SELECT lookup, doc, topic_offset, min(row(nm, ord, nth)) AS place FROM h WHERE topic_offset >= 0 GROUP BY ALL),
    ranked AS (SELECT lookup, doc, CAST(row_number() OVER (PARTITION BY lookup ORDER BY place) AS INT) AS rank, topic_offset FROM f)"""


@query("keyword_exact_lookup", _LOOKUP + " SELECT lookup, rank, topic_offset FROM ranked")
def _(t: Tables):
    return K.keyword_exact_lookup(t("lookups"), t("keywords")).select("lookup", "rank", "topic_offset")


@query("related_topics", _LOOKUP + f""", r AS ({asof('ranked', 'title_anchors', 'topic_offset', 'r.lookup, r.rank')}) SELECT lookup, CAST(row_number() OVER (PARTITION BY lookup
    ORDER BY min(rank)) AS INT) AS rank, topic_index FROM r WHERE topic_index IS NOT NULL GROUP BY lookup, topic_index""")
def _(t: Tables):
    return K.related_topics(t("lookups"), t("keywords"), t("title_anchors"))


_MERGED = """SELECT s.key, s.keyword, n FROM (SELECT key, arg_min(keyword, seen) AS keyword FROM (SELECT lower(keyword) AS key, keyword, min(row(doc, ord)) AS seen
    FROM reached_duck WHERE table_id = 'K' GROUP BY ALL) GROUP BY key) s
    JOIN (SELECT key, count(*) AS n FROM (SELECT DISTINCT lower(keyword) AS key, doc, topic_index FROM reached_duck WHERE table_id = 'K')
    GROUP BY key) p ON s.key = p.key"""
view("merged_duck", "SELECT 1", _MERGED)


@query("merge_keyword_index", """SELECT m.key, m.keyword, m.n, d.doc, d.topic_index FROM merged_duck m JOIN (SELECT DISTINCT lower(keyword) AS key, doc, topic_index FROM reached_duck
    WHERE table_id = 'K') d ON m.key = d.key""")
def _(t: Tables):
    r = reached(t)
    return K.merge_keyword_index(r).join(K.merged_destinations(r), "key").select("key", "keyword", "n", "doc", "topic_index")


@query("filter_keyword_index", """SELECT key, CASE WHEN n > 1 THEN concat(keyword, '  (', CAST(n AS STRING), ' topics)') ELSE keyword END AS label FROM merged_duck
    WHERE contains(key, 'the')""")
def _(t: Tables):
    return K.filter_keyword_index(K.merge_keyword_index(reached(t)), " The ")


view("topic_keywords_duck", "SELECT 1", """SELECT doc, topic_index, list_sort(list_distinct(list(trim(regexp_replace(lower(keyword), '\\s+', ' ', 'g'))))) AS folded_keywords FROM reached_duck
    WHERE table_id = 'K' GROUP BY ALL""")


@query("keywords_by_topic", "SELECT doc, topic_index, array_to_string(folded_keywords, '|') AS folded FROM topic_keywords_duck")
def _(t: Tables):
    return K.keywords_by_topic(reached(t)).select("doc", "topic_index", F.array_join("folded_keywords", "|").alias("folded"))


@query("keyword_table_profile", """SELECT doc, table_id, count(*) AS n_entries, CAST(sum(len(list_filter(offsets, lambda o: o >= 0))) AS BIGINT) AS n_targets, count(*) FILTER (WHERE list_contains(offsets, -1)) AS n_macro
    FROM keywords GROUP BY ALL""")
def _(t: Tables):
    return K.keyword_table_profile(t("keywords"))


def _fold(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


view("search_duck", "SELECT 1", f"""SELECT t.doc, t.topic_index, t.title, {_fold('t.title')} AS folded_title, {_fold('t.plain_text')} AS folded_body, coalesce(k.folded_keywords, []) AS folded_keywords
    FROM topics t LEFT JOIN topic_keywords_duck k ON t.doc = k.doc AND t.topic_index = k.topic_index""")


def search_table(t: Tables):
    return S.build_search_table(t("topics"), K.keywords_by_topic(reached(t)))


def _ladder(x: str, q: str, a: int, b: int, c: int) -> str:
    return f"CASE WHEN {x} = {q} THEN {a} WHEN starts_with({x}, {q}) THEN {b} WHEN contains({x}, {q}) THEN {c} ELSE 0 END"


def _title(q: str) -> str:
    return _ladder("folded_title", q, 1000, 850, 700)


def _keyword(q: str) -> str:
    return f"coalesce(list_max(list_transform(folded_keywords, lambda k: {_ladder('k', q, 950, 800, 650)})), 0)"


def _body(q: str) -> str:
    terms = f"string_split({q}, ' ')"
    return f"""CASE WHEN contains(folded_body, {q}) THEN CAST(400 + least(octet_length(encode({q})), 100) AS INT)
    WHEN len({terms}) > 1 AND len(list_filter({terms}, lambda w: NOT contains(folded_body, w))) = 0 THEN CAST(300 + 5 * least(len({terms}), 20) AS INT)
    ELSE 0 END"""


def _score(q: str) -> str:
    return f"greatest({_title(q)}, {_keyword(q)}, {_body(q)})"


_KIND = "CASE WHEN score IN (1000, 850, 700) THEN 'Title' WHEN score IN (950, 800, 650) THEN 'Keyword' ELSE 'Body' END"
PHRASE = "  The  And"
_Q = "'the and'"


@query("fold_text", f"SELECT doc_id, md5({_fold('text')}) AS digest FROM documents")
def _(t: Tables):
    from ..functions.scalars import fold_text

    return t("documents").select("doc_id", F.md5(fold_text(F.col("text"))).alias("digest"))


@query("build_search_table", "SELECT doc, topic_index, folded_title, md5(folded_body) AS body, array_to_string(folded_keywords, '|') AS folded FROM search_duck")
def _(t: Tables):
    return search_table(t).select("doc", "topic_index", "folded_title", F.md5("folded_body").alias("body"), F.array_join("folded_keywords", "|").alias("folded"))


for _name, _sql, _col in (("score_title", _title(_Q), S.score_title), ("score_keyword", _keyword(_Q), S.score_keyword), ("score_body", _body(_Q), S.score_body)):

    @query(_name, f"SELECT doc, topic_index, {_sql} AS score FROM search_duck")
    def _(t: Tables, col=_col):
        return search_table(t).select("doc", "topic_index", col(F.lit("the and")).cast("int").alias("score"))


_HITS = f"(SELECT doc, topic_index, title, {_score(_Q)} AS score FROM search_duck)"


@query("search_topics", f"""SELECT doc, topic_index, score, {_KIND} AS kind, CAST(row_number() OVER (PARTITION BY doc ORDER BY score DESC, topic_index) AS INT) AS rank
    FROM {_HITS} WHERE score > 0 QUALIFY rank <= 200""")
def _(t: Tables):
    return S.search_topics_in(search_table(t), PHRASE).select("doc", "topic_index", "score", "kind", "rank")


@query("search_corpus", f"""SELECT doc, topic_index, score, concat('[', CASE WHEN {_KIND} = 'Body' THEN 'Text'
    ELSE {_KIND} END, '] ', coalesce(nullif(trim(title), ''), concat('Topic ', CAST(topic_index + 1 AS STRING))), ' — ', string_split(replace(doc, chr(92), '/'), '/')[-1]) AS label FROM {_HITS}
    WHERE score > 0 ORDER BY score DESC, doc, topic_index LIMIT 200""")
def _(t: Tables):
    return S.search_corpus(search_table(t), PHRASE)


view("batch_queries", """SELECT item_id * 4 AS query_id, concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), '  ', split_part(text, ' ', 3)) AS query
    FROM {benchmark} UNION ALL SELECT item_id * 4 + 1, text FROM {benchmark} UNION ALL SELECT item_id * 4 + 2, split_part(text, ' ', 2) FROM {benchmark}
    UNION ALL SELECT item_id * 4 + 3, '  ' FROM {benchmark}""")


@query("search_batch", f"""SELECT query_id, rank, doc, topic_index, score, {_KIND} AS kind
    FROM (SELECT query_id, doc, topic_index, {_score('q')} AS score, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY {_score('q')} DESC, doc, topic_index) AS INT) AS rank FROM search_duck, (SELECT query_id, {_fold('query')} AS q FROM batch_queries)
    WHERE q <> '' AND {_score('q')} > 0) WHERE rank <= 10""")
def _(t: Tables):
    """Over the search table as an ingest job leaves it, folded once."""
    return S.search_batch(written(search_table(t)), t("batch_queries"))


@query("search_export_profile", """SELECT doc, topic_index, title, CAST(CASE WHEN lower(title) = 'the' THEN 100 ELSE 0 END + CASE WHEN contains(lower(title), 'the') THEN 40
    ELSE 0 END + CASE WHEN contains(lower(plain_text), 'the') THEN 10 ELSE 0 END AS INT) AS score FROM topics
    WHERE contains(lower(title), 'the') OR contains(lower(plain_text), 'the') ORDER BY score DESC, title, doc, topic_index LIMIT 200""")
def _(t: Tables):
    return S.search_export_profile(t("topics"), " The ")


view("entries_duck", "SELECT 1", _ENTRIES)


def entries(t: Tables):
    return I.read_contents_lines(t("contents_text").withColumnRenamed("ord", "line"))


_PARENT = "(SELECT max(a.line) FROM entries_duck a WHERE a.doc = c.doc AND a.line < c.line AND a.level < c.level)"
_DEPTH = """(SELECT count(*) FROM entries_duck a WHERE a.doc = c.doc AND a.line < c.line AND a.level < c.level AND NOT EXISTS (SELECT 1 FROM entries_duck b
    WHERE b.doc = c.doc AND b.line > a.line AND b.line < c.line AND b.level <= a.level))"""


@query("contents_hierarchy", f"""SELECT doc, line, level, title, {_PARENT} AS parent_line, CAST({_DEPTH} AS INT) AS depth, coalesce(lead(level) OVER (PARTITION BY doc
    ORDER BY line) > level, FALSE) AS has_children FROM entries_duck c""")
def _(t: Tables):
    return C.contents_hierarchy(entries(t)).withColumn("line", F.col("line").cast("long"))


# the parent of each row by a self-contained subquery, then titles from the root
view("nodes_duck", "SELECT 1", f"SELECT doc, line, title, {_PARENT} AS parent_line FROM entries_duck c")
PATHS = """WITH RECURSIVE walk AS (SELECT doc, line, title AS path FROM nodes_duck WHERE parent_line IS NULL
    UNION ALL SELECT n.doc, n.line, concat(w.path, ' / ', n.title) FROM walk w
    JOIN nodes_duck n ON n.doc = w.doc AND n.parent_line = w.line) SELECT doc, line, path FROM walk"""


@query("contents_paths", PATHS)
def _(t: Tables):
    return C.contents_paths(C.contents_hierarchy(entries(t)))


view("place_names", """SELECT 'world' AS doc, n_nationkey AS ord, lower(n_name) AS name, CAST(12 + 64 * n_nationkey AS BIGINT) AS topic_offset FROM {nation}
    WHERE n_nationkey % 3 <> 1 UNION ALL SELECT CASE WHEN s_suppkey % 4 = 1 THEN 'other.hlp'
    ELSE 'world' END, 100 + s_suppkey, lower(s_name), CAST(12 + 64 * (100 + s_suppkey) AS BIGINT) FROM {supplier} WHERE s_suppkey % 5 <> 2""")
view("place_anchors", "SELECT doc, topic_offset, CAST(ord AS INT) AS topic_index, topic_offset AS pos FROM {place_names}")
view("place_docs", "SELECT DISTINCT doc FROM {place_names}")


def targets(t: Tables):
    from ..functions.scalars import context_hash

    ctx = t("place_names").withColumn("hash", context_hash(F.col("name")))
    bases = t.spark.createDataFrame([], "doc string, base_file string")
    nothing = t.spark.createDataFrame([], "doc string, ord long, map_id int, topic_offset long")
    # a line without a target has no context either
    lines = t("contents_text").where("contains(text, '=')").withColumnRenamed("ord", "line")
    return C.resolve_contents_targets(I.read_contents_lines(lines), bases, t("place_docs"), ctx, nothing, t("place_anchors"))


_TARGETS = """SELECT e.doc, e.line, e.title, e.win, k.doc AS target_doc, CAST(n.ord AS INT) AS topic_index FROM entries_duck e
    LEFT JOIN place_docs k ON k.doc = coalesce(lower(e.help_file), e.doc) LEFT JOIN place_names n ON n.doc = k.doc AND lower(n.name) = lower(e.context)
    WHERE e.context IS NOT NULL"""
view("targets_duck", "SELECT 1", _TARGETS)


@query("resolve_contents_targets", "SELECT line, title, win, target_doc, topic_index FROM targets_duck")
def _(t: Tables):
    return targets(t).select("line", "title", "win", "target_doc", "topic_index")


@query("unresolved_contents", "SELECT line, concat('Unresolved contents entry: ', title) AS message FROM targets_duck WHERE topic_index IS NULL")
def _(t: Tables):
    return C.unresolved_contents(targets(t)).select("line", "message")


@query("contents_row_for_topic", "SELECT doc, topic_index, min(line) AS line FROM targets_duck WHERE doc = target_doc AND topic_index IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    return C.contents_row_for_topic(targets(t))


view("link_rows", r"""SELECT 'world' AS doc, s_suppkey AS ord, CASE s_suppkey % 3 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'index' ELSE 'search' END AS directive, CASE
    WHEN s_suppkey % 7 = 0 THEN 10000 ELSE CAST(s_suppkey AS INT) END AS key,
    CASE s_suppkey % 5 WHEN 0 THEN concat('Terms=', s_name, '.hlp') WHEN 1 THEN concat(' =C:', chr(92), 'help', chr(92), s_name, '.hlp')
    WHEN 2 THEN ' ' WHEN 3 THEN concat(chr(92), chr(92), 'srv', chr(92), s_name) ELSE concat('dir/', s_name) END AS text FROM {supplier}""")
_LINK = r"""SELECT ord, coalesce(directive, CASE WHEN label IS NOT NULL THEN 'index' ELSE 'search' END) AS kind, label, CASE
    WHEN starts_with(file, chr(92)) OR substring(file, 2, 1) = ':' THEN string_split(file, chr(92))[-1] ELSE file END AS help_file FROM (
    SELECT *, CASE WHEN contains(text, '=') THEN nullif(trim(split_part(text, '=', 1)), '') END AS label, trim(CASE
    WHEN contains(text, '=') THEN substring(text, instr(text, '=') + 1) ELSE text END) AS file FROM link_rows WHERE key <> 10000) WHERE file <> ''"""


@query("contents_links", _LINK)
def _(t: Tables):
    return C.contents_links(t("link_rows")).drop("doc")


view("cached_rows", """SELECT CAST(c_nationkey AS STRING) AS doc, c_custkey AS ord, CASE WHEN c_custkey % 31 = 0 THEN 70000 WHEN c_custkey % 37 = 0 THEN 70001
    ELSE CAST(c_custkey AS INT) END AS key, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS text FROM {customer}""")
view("cached_jumps", "SELECT CAST(c_nationkey AS STRING) AS doc, c_custkey AS ord, CAST(c_custkey - c_custkey % 2 AS INT) AS key, c_custkey AS target FROM {customer}")
view("cached_levels", "SELECT CAST(c_nationkey AS STRING) AS doc, c_custkey AS ord, CAST((c_custkey * 7) % 64 AS INT) AS level_byte FROM {customer} WHERE c_custkey % 29 <> 0")


@query("assemble_keyed_contents", """
    SELECT r.doc, r.nth, b.level, trim(r.text) AS title, j.target, CASE WHEN trim(r.text) = '' THEN 'empty title' END AS warning
    FROM (SELECT doc, key, text, CAST(row_number() OVER (PARTITION BY doc ORDER BY ord) AS INT) AS nth FROM cached_rows WHERE key NOT IN (70000, 70001)) r
    JOIN (SELECT doc, level_byte >> 4 AS level, CAST(row_number() OVER (PARTITION BY doc ORDER BY ord) AS INT) AS nth FROM cached_levels) b ON r.doc = b.doc AND r.nth = b.nth
    LEFT JOIN (SELECT doc, key, arg_max(target, ord) AS target FROM cached_jumps GROUP BY ALL) j ON j.doc = r.doc AND j.key = r.key WHERE b.level > 0""")  # fmt: skip
def _(t: Tables):
    return C.assemble_keyed_contents(t("cached_rows"), t("cached_jumps"), t("cached_levels"))


view("authored", "SELECT doc, ord, text FROM {cached_rows} WHERE CAST(doc AS INT) % 3 = 0")


@query("pick_contents_source", """SELECT doc, ord, text, 'authored' AS source FROM authored UNION ALL SELECT doc, ord, text, 'cached' FROM cached_rows WHERE doc NOT IN (SELECT doc
    FROM authored)""")
def _(t: Tables):
    return C.pick_contents_source(t("authored"), t("cached_rows").select("doc", "ord", "text"))
