"""Queries over sources, topic assembly, address resolution and browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as R
from ..operators import topics as T
from ..functions.lineage import scratch_path
from ..functions.scalars import context_hash
from ..operators.contents import contents_links
from ..sources import ingest as I
from .bindings import duck_hash
from .registry import Tables, query, view

_CASES = lambda table, x: " ".join(f"WHEN {x} IN ({','.join(map(str, ks))}) THEN {c}" for c, ks in table.items())
_LINES = "1 = 1"

view("contents_text", r"""
    SELECT 'world' AS doc, ord, text FROM (
      SELECT 3 * r_regionkey AS ord, concat('1 ', r_name) AS text FROM {region}
      UNION ALL SELECT 100 + n_nationkey, concat('2 ', n_name, CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE concat('=', lower(n_name)) END) FROM {nation}
      UNION ALL SELECT 1000 + s_suppkey, concat('  3 ', s_name, '=', lower(s_name), CASE WHEN s_suppkey % 9 = 0 THEN '@other.hlp>steps' ELSE '' END) FROM {supplier}
      UNION ALL SELECT 200000, ':Title World' UNION ALL SELECT 200001, ':Base' UNION ALL SELECT 200011, ':base world.hlp > main'
    UNION ALL SELECT 300000 + s_suppkey, concat(CASE WHEN s_suppkey % 2 = 0 THEN ':Index ' ELSE ':LINK ' END, CASE
    WHEN s_suppkey % 3 = 0 THEN concat(s_name, ' = ') ELSE '' END, s_name, '.hlp') FROM {supplier} UNION ALL SELECT 200002, ':Index Terms=terms.hlp' UNION ALL SELECT 200003, ':Link more.hlp'
      UNION ALL SELECT 200004, '0 Invalid' UNION ALL SELECT 200005, ':Unknown thing' UNION ALL SELECT 200006, '; remark' UNION ALL SELECT 200007, ''
    UNION ALL SELECT 200008, 'no digits' UNION ALL SELECT 200009, '70000 Deep' UNION ALL SELECT 200010, '4 =nothing')
    UNION ALL SELECT concat('tree', CAST(k % 61 AS STRING)), k, concat(CAST(CASE WHEN k % 4 = 0 THEN greatest(1, l - 5)
    ELSE l END AS STRING), ' Deep ', CAST(k AS STRING)) FROM (SELECT c_custkey AS k, CAST(floor(c_custkey / 61) AS INT) + 1 AS l FROM {customer})""")
_PARSED = r"""
    WITH p AS (SELECT doc, ord AS line, trim(text) AS t FROM contents_text WHERE trim(text) <> '' AND trim(text) NOT LIKE ';%'),
    q AS (SELECT *, regexp_extract(t, '^([0-9]+)', 1) AS digits, trim(regexp_extract(t, '^[0-9]+(.*)$', 1)) AS rest, CASE
    WHEN t LIKE ':%' THEN lower(regexp_extract(t, '^:(\S*)', 1)) END AS directive, CASE
    WHEN t LIKE ':%' THEN trim(regexp_extract(t, '^:\S*(.*)$', 1)) END AS val FROM p),
    r AS (SELECT *, trim(split_part(rest, '=', 1)) AS title, CASE
    WHEN contains(rest, '=') THEN substring(rest, instr(rest, '=') + 1) END AS target, TRY_CAST(digits AS BIGINT) AS lev FROM q)"""


@query("scan_corpus_files", """
    SELECT concat('nation=', CAST(c_nationkey AS STRING)) AS folder, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS length
    FROM customer GROUP BY ALL""")
def _(t: Tables):
    """Customers' names as files of lines in a folder for each nation, beside files of another kind; lengths of what the scan finds, by folder."""
    d, path = t("customer").select("c_name", F.col("c_nationkey").alias("nation"), "c_custkey"), scratch_path(t.spark)
    laid = d.repartitionByRange("nation", "c_custkey").select("nation", "c_name")
    laid.write.partitionBy("nation").text(f"{path}/notes")
    t("nation").write.json(f"{path}/other")
    files = I.scan_corpus_files(t.spark, path, ("txt",))
    return files.groupBy(F.element_at(F.split("doc", "/"), -2).alias("folder")).agg(F.sum("length").alias("length"))


@query("header_fields", "SELECT file_id, CAST(magic AS BIGINT) AS magic, directory_start, first_free, logical_size, 16 + file_id % 50 AS actual_size FROM headers")
def _(t: Tables):
    """Headers laid out as bytes and read back."""
    little = lambda c: F.concat(*[F.substring(F.lpad(F.hex(F.pmod(F.col(c).cast("long"), F.lit(1 << 32))), 8, "0"), i, 2) for i in (7, 5, 3, 1)])
    body = F.repeat(F.lit("00"), (F.col("file_id") % 50).cast("int"))
    laid = t("headers").select("file_id", F.unhex(F.concat(*map(little, ("magic", "directory_start", "first_free", "logical_size")), body)).alias("content"))
    return I.header_fields(laid).select("file_id", "magic", "directory_start", "first_free", "logical_size", F.col("actual_size").cast("long").alias("actual_size"))


@query("triage_headers", """
    SELECT file_id, CASE WHEN magic = 151116 THEN 'other family' WHEN magic <> 220991 THEN 'bad magic' WHEN logical_size < 16 THEN 'size too small' WHEN logical_size > actual_size THEN 'size beyond file'
      WHEN directory_start < 16 OR directory_start >= logical_size THEN 'directory out of bounds'
    WHEN first_free <> -1 AND (first_free < 16 OR first_free >= logical_size) THEN 'free list out of bounds' ELSE 'ok' END AS verdict FROM headers""")  # fmt: skip
def _(t: Tables):
    return I.triage_headers(t("headers")).select("file_id", "verdict")


@query("load_topics", "SELECT doc, topic_index, coalesce(nullif(trim(title), ''), concat('Topic ', CAST(topic_index + 1 AS STRING))) AS label FROM topics")
def _(t: Tables):
    return I.load_topics(t("topics").drop("topic_index")).select("doc", "topic_index", "label")


_ENTRIES = _PARSED + r""", s AS (SELECT *, split_part(target, '>', 1) AS bw FROM r)
    SELECT doc, line, CAST(lev AS INT) AS level, title, nullif(trim(split_part(bw, '@', 1)), '') AS context, CASE WHEN contains(bw, '@') THEN nullif(trim(substring(bw, instr(bw, '@') + 1)), '') END AS help_file,
           CASE WHEN contains(target, '>') THEN nullif(trim(substring(target, instr(target, '>') + 1)), '') END AS win
    FROM s WHERE digits <> '' AND length(digits) <= 5 AND lev BETWEEN 1 AND 65535 AND title <> ''"""


@query("read_contents_lines", _ENTRIES)
def _(t: Tables):
    return I.read_contents_lines(t("contents_text").withColumnRenamed("ord", "line"))


@query("contents_warnings", _PARSED + """, w AS (SELECT doc, line, CASE WHEN directive <> '' AND directive NOT IN ('title','base','index','link','include') THEN concat('unsupported directive :', directive)
      WHEN directive IN ('title','base','index','link','include') AND val = '' THEN concat('empty :', directive)
    WHEN digits <> '' AND lev = 0 THEN 'level 0' WHEN digits <> '' AND (length(digits) > 5 OR lev > 65535) THEN 'level out of range'
      WHEN digits <> '' AND title = '' THEN 'no title' END AS warning FROM r) SELECT * FROM w WHERE warning IS NOT NULL""")  # fmt: skip
def _(t: Tables):
    return I.contents_warnings(t("contents_text").withColumnRenamed("ord", "line"))


# Bytes of a short text in each charset, with the text.
SAMPLES = {
    0x4D: ("8E8F", "éè"), 0x80: ("93FA967B", "日本"), 0x81: ("C7D1B1DB", "한글"), 0x82: ("D065", "한"), 0x86: ("D6D0CEC4", "中文"), 0x88: ("A4A4A4E5", "中文"), 0xA1: ("C3E5E9E1", "Γεια"), 0xA2: ("DEFDF0", "Şığ"),
    0xA3: ("D0F0FE", "Đđ₫"), 0xB1: ("F9ECE5ED", "שלום"), 0xB2: ("E3D1CDC8C7", "مرحبا"), 0xBA: ("E0E8E6", "ąčę"), 0xCC: ("CFF0E8E2E5F2", "Привет"), 0xDE: ("CAC7D1CA", "สวัส"), 0xEE: ("E8EDB9", "číą"), 0x63: ("E9FC80", "éü€"),
}
_SAMPLE = lambda i: " ".join(f"WHEN {n} THEN {[c, *map(repr, SAMPLES[c])][i]}" for n, c in enumerate(SAMPLES))
_OF_CHARSET = lambda i: f"CASE doc_id % {len(SAMPLES)} {_SAMPLE(i)} END"
# what windows-1252 lacks becomes a question mark
_WESTERN = r"regexp_replace(text, '[^\x00-\x7F\x{A0}-\x{FF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '?', 'g')"
_ASCII = r"replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), chr(92), '/')"


@query("decode_text_bytes", f"""
    SELECT doc_id, charset, length(x) AS n_chars, md5(x) AS digest FROM (
      SELECT doc_id, 0 AS charset, {_WESTERN} AS x FROM documents UNION ALL SELECT doc_id, {_OF_CHARSET(0)}, concat({_OF_CHARSET(2)}, {_ASCII})
    FROM documents)""")
def _(t: Tables):
    """Whole texts as windows-1252 bytes; and as ASCII after some bytes of each charset."""
    d, ascii_ = t("documents"), F.replace(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), F.lit("\\"), F.lit("/"))
    with I.java_charsets(t.spark):
        western = d.select("doc_id", F.lit(0).alias("charset"), F.encode("text", "windows-1252").alias("b"))
        other = d.select("doc_id", F.expr(_OF_CHARSET(0)).alias("charset"), F.concat(F.unhex(F.expr(_OF_CHARSET(1))), ascii_.cast("binary")).alias("b"))
        x = western.unionByName(other).select("doc_id", "charset", I.decode_text(F.col("b"), F.col("charset")).alias("x"))
    return x.select("doc_id", "charset", F.length("x").cast("long").alias("n_chars"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query("contents_meta", _PARSED + """ SELECT doc, max(val) FILTER (WHERE directive = 'title') AS title, max(trim(split_part(val, '>', 1))) FILTER (WHERE directive = 'base') AS base_file,
    max(CASE WHEN contains(val, '>') THEN trim(substring(val, instr(val, '>') + 1)) END) FILTER (WHERE directive = 'base') AS base_window FROM r
    WHERE val <> '' AND directive IN ('title', 'base') GROUP BY doc""")  # fmt: skip
def _(t: Tables):
    return I.contents_meta(t("contents_text").withColumnRenamed("ord", "line"))


@query("contents_link_rows", _PARSED + """ SELECT doc, line AS ord, CASE directive WHEN 'index' THEN 'index' ELSE 'search' END AS kind, CASE WHEN contains(val, '=') THEN nullif(trim(split_part(val, '=', 1)), '') END AS label,
    trim(CASE WHEN contains(val, '=') THEN substring(val, instr(val, '=') + 1) ELSE val END) AS help_file FROM r
    WHERE val <> '' AND directive IN ('index', 'link')""")  # fmt: skip
def _(t: Tables):
    """Link lines of contents files, through contents_links."""
    return contents_links(I.contents_link_rows(t("contents_text").withColumnRenamed("ord", "line")))


@query("resolve_charset", f"""
    SELECT f.doc, font_index, coalesce(CASE WHEN c.charset <> 1 THEN c.charset END,
      CASE {' '.join(f"WHEN lower(trim(face_name)) IN ({','.join(repr(x) for x in v)}) THEN {k}" for k, v in I.FACE_CHARSETS.items())} END,
      CASE {_CASES(I.LOCALE_CHARSETS, 'locale')} END, CASE {_CASES(I.LANGUAGE_CHARSETS, '(locale & 1023)')} END) AS charset
    FROM fonts f LEFT JOIN charsets c ON f.doc = c.doc AND f.face_index = c.face_index LEFT JOIN locales l ON f.doc = l.doc""")
def _(t: Tables):
    return I.resolve_charset(t("fonts"), t("charsets"), t("locales")).select("doc", "font_index", "charset")


@query("group_records_into_topics", "SELECT doc, pos, CAST(sum(CAST(is_header AS INT)) OVER (PARTITION BY doc ORDER BY pos) - 1 AS INT) AS topic_no FROM records")
def _(t: Tables):
    return T.group_records_into_topics(t("records").select("doc", "pos", "is_header")).select("doc", "pos", "topic_no")


@query("normalize_topic_metadata", """
    SELECT pos, CASE WHEN modern AND back >= 0 THEN back END AS browse_back, CASE WHEN modern AND fore >= 0 THEN fore END AS browse_forward, CASE
    WHEN NOT modern AND back >= 12 THEN back END AS previous, CASE WHEN NOT modern AND fore >= 12 THEN fore END AS following,
      CAST(CASE WHEN number >= 0 AND number <> 65535 THEN number END AS BIGINT) AS number, CASE
    WHEN modern AND non_scroll >= 12 THEN non_scroll END AS non_scroll, CASE WHEN modern AND scroll >= 12 THEN scroll END AS scroll, CASE
    WHEN modern AND next_topic >= 12 THEN next_topic END AS next_topic FROM topic_headers""")  # fmt: skip
def _(t: Tables):
    return T.normalize_topic_metadata(t("topic_headers")).drop("doc", "modern")


_REGION = """CASE WHEN pos >= non_scroll AND (scroll IS NULL OR pos < scroll) THEN 'non_scrolling'
    WHEN pos >= scroll AND (next_topic IS NULL OR pos < next_topic) THEN 'scrolling' WHEN non_scroll IS NULL AND scroll IS NULL THEN 'scrolling'
    ELSE 'unclassified' END"""
_RTEXT = "CASE WHEN record_type IN (1, 32, 34, 35) THEN replace(payload, chr(0), '') ELSE '' END"


@query("classify_region", f"SELECT topic_id, pos, line, {_REGION} AS region FROM region_records")
def _(t: Tables):
    return T.classify_region(t("region_records")).select("topic_id", "pos", "line", "region")


@query("record_text", f"SELECT topic_id, pos, line, {_RTEXT} AS text FROM region_records")
def _(t: Tables):
    return T.record_text(t("region_records")).select("topic_id", "pos", "line", "text")


_ASSEMBLED = f"(SELECT topic_id, pos, line, record_type, {_REGION} AS region, {_RTEXT} AS text FROM region_records)"


@query("topic_plain_text", f"""SELECT topic_id, coalesce(string_agg(text, chr(10) ORDER BY CASE region WHEN 'non_scrolling' THEN 0 WHEN 'scrolling' THEN 1
    ELSE 2 END, pos, line, text) FILTER (WHERE text <> ''), '') AS plain_text FROM {_ASSEMBLED} GROUP BY topic_id""")
def _(t: Tables):
    return T.topic_plain_text(T.record_text(T.classify_region(t("region_records"))), ["topic_id"], ["pos", "line"])


@query("recover_unclassified", f"""SELECT topic_id, concat('recovered ', CAST(count(*) AS STRING)) AS warning FROM {_ASSEMBLED}
    WHERE region = 'unclassified' AND record_type IN (1, 32, 34, 35) GROUP BY topic_id""")
def _(t: Tables):
    return T.recover_unclassified(T.classify_region(t("region_records")), ["topic_id"])[1]


view("decoded", "SELECT doc, pos, concat('<p>', text) AS formatted_text, text AS plain_text, pos % 37 = 5 AS failed FROM {records}")
view("decode_issues", "SELECT doc, pos, pos % 3 = 0 AS layout_safe FROM {records} WHERE pos % 4 = 1 UNION ALL SELECT doc, pos, TRUE FROM {records} WHERE pos % 8 = 1")


@query("apply_decode_fallback", """
    SELECT d.doc, d.pos, CASE WHEN coalesce(unsafe, FALSE) OR failed THEN 'plain' ELSE 'formatted' END AS mode, CASE
    WHEN coalesce(unsafe, FALSE) OR failed THEN plain_text ELSE formatted_text END AS chosen_text, coalesce(n, 0) AS n_issues
    FROM decoded d LEFT JOIN (SELECT doc, pos, bool_or(NOT layout_safe) AS unsafe, count(*) AS n FROM decode_issues
    GROUP BY doc, pos) i ON d.doc = i.doc AND d.pos = i.pos""")  # fmt: skip
def _(t: Tables):
    return T.apply_decode_fallback(t("decoded"), t("decode_issues"), ["doc", "pos"]).select("doc", "pos", "mode", "chosen_text", "n_issues")


@query("offset_anchors", "SELECT doc, topic_offset, topic_index, pos FROM anchors")
def _(t: Tables):
    return T.offset_anchors(t("record_lengths"))


@query("topic_start_offsets", """SELECT t.doc, t.topic_index, s.start_offset FROM (SELECT DISTINCT doc, topic_index FROM record_lengths) t
    LEFT JOIN (SELECT doc, topic_index, arg_min(topic_offset, pos) AS start_offset FROM anchors
    GROUP BY ALL) s ON t.doc = s.doc AND t.topic_index = s.topic_index""")
def _(t: Tables):
    return T.topic_start_offsets(t("record_lengths").select("doc", "topic_index").distinct(), T.offset_anchors(t("record_lengths")))


@query("startup_topic", """SELECT doc, coalesce(min(CASE WHEN v > 0 THEN topic_index END), min(topic_index)) AS topic_index
    FROM (SELECT doc, topic_index, count(*) FILTER (WHERE record_type = 35 AND text <> '') AS v FROM records GROUP BY ALL) GROUP BY doc""")
def _(t: Tables):
    return T.startup_topic(t("records").groupBy("doc", "topic_index").agg(F.count_if((F.col("record_type") == 35) & (F.col("text") != "")).alias("n_visible")))


view("phrases", """SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY w) AS INT) AS phrase_id, w AS phrase
    FROM (SELECT DISTINCT CAST(p_partkey % 3 AS STRING) AS doc, split_part(p_name, ' ', 1) AS w FROM {part} WHERE length(p_name) > 0)""")
view("phrase_tokens", """
    SELECT doc, rec, seq, CASE WHEN rec % 9 = 5 THEN 999999 ELSE phrase_id END AS phrase_id, CASE WHEN rec % 9 = 5 THEN CAST(NULL AS STRING)
    WHEN phrase_id IS NULL THEN w END AS literal, seq < 2 AS space, expected FROM (
      SELECT x.doc, rec, seq, w, phrase_id, length(p_name) + CASE WHEN rec % 7 = 0 THEN 2 WHEN rec % 5 = 0 THEN -1 ELSE 1 END AS expected
      FROM (SELECT CAST(p_partkey % 3 AS STRING) AS doc, p_partkey AS rec, 1 AS seq, split_part(p_name, ' ', 1) AS w, p_name FROM {part}
            UNION ALL SELECT CAST(p_partkey % 3 AS STRING), p_partkey, 2, split_part(p_name, ' ', 2), p_name FROM {part}) x
    LEFT JOIN {phrases} y ON x.doc = y.doc AND x.w = y.phrase)""")


@query("expand_phrases", """
    SELECT doc, rec, substring(f, 1, greatest(e, 0)) AS text, CASE WHEN m THEN 'missing phrase' WHEN length(f) < e THEN 'short'
    WHEN length(f) > e THEN 'long' ELSE 'ok' END AS status FROM (
      SELECT t.doc, rec, string_agg(concat(coalesce(literal, phrase, ''), CASE WHEN space THEN ' ' ELSE '' END), '' ORDER BY seq) AS f, max(expected) AS e, bool_or(literal IS NULL AND phrase IS NULL) AS m
      FROM phrase_tokens t LEFT JOIN phrases p ON t.doc = p.doc AND t.phrase_id = p.phrase_id GROUP BY t.doc, rec)""")  # fmt: skip
def _(t: Tables):
    return T.expand_phrases(t("phrase_tokens"), t("phrases"), ["doc", "rec"])


view("cells", """SELECT 'parts' AS doc, p_partkey AS cell_id, CASE WHEN p_partkey < 4 THEN CAST(NULL AS BIGINT)
    ELSE CAST(floor(p_partkey / 4) AS BIGINT) END AS parent_id, CASE p_size % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'picture' WHEN 2 THEN 'window'
    ELSE 'display' END AS kind FROM {part} WHERE p_partkey > 0""")


@query("flatten_nested_cells", """
    WITH RECURSIVE walk AS (SELECT doc, cell_id AS root, cell_id, 0 AS depth, kind, [cell_id] AS ids FROM cells WHERE parent_id IS NULL
      UNION ALL SELECT w.doc, w.root, c.cell_id, w.depth + 1, c.kind, list_append(w.ids, c.cell_id) FROM walk w JOIN cells c ON c.doc = w.doc AND c.parent_id = w.cell_id WHERE w.depth < 64)
    SELECT doc, root, cell_id, depth, array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), '/') AS path, CAST(row_number() OVER (PARTITION BY doc, root ORDER BY ids) - 1 AS INT) AS nth, kind FROM walk""")  # fmt: skip
def _(t: Tables):
    return T.flatten_nested_cells(t("cells"))


@query("context_hash", f"SELECT ord, name, {duck_hash('name')} AS hash FROM context_names")
def _(t: Tables):
    return t("context_names").select("ord", "name", context_hash(F.col("name")).alias("hash"))


def asof(refs: str, anchors: str, off: str, keep: str) -> str:
    """The as-of join in DuckDB."""
    return f"""SELECT {keep}, CASE WHEN r.{off} >= 0 AND a.topic_offset // 32768 = r.{off} // 32768 THEN a.topic_index END AS topic_index FROM {refs} r
    ASOF LEFT JOIN (SELECT doc, topic_offset, arg_max(topic_index, pos) AS topic_index FROM {anchors}
    GROUP BY ALL) a ON r.doc = a.doc AND r.{off} >= a.topic_offset"""


@query("resolve_topic_offset", asof("offset_refs", "anchors", "topic_offset", "r.ref_id"))
def _(t: Tables):
    return R.resolve_topic_offset(t("offset_refs"), T.offset_anchors(t("record_lengths"))).select("ref_id", "topic_index")


view("contexts_duck", "SELECT 1", f"SELECT doc, hash, arg_min(topic_offset, ord) AS topic_offset FROM (SELECT *, {duck_hash('name')} AS hash FROM context_names) GROUP BY doc, hash")
view("link_hashes_duck", "SELECT 1", f"SELECT doc, topic_index AS src, seq, hash FROM (SELECT *, {duck_hash('name')} AS hash FROM link_names)")
_BY_HASH = "(SELECT l.doc, l.src, l.seq, c.topic_offset FROM link_hashes_duck l LEFT JOIN contexts_duck c ON l.doc = c.doc AND l.hash = c.hash)"


def contexts(t: Tables):
    return t("context_names").withColumn("hash", context_hash(F.col("name")))


def links(t: Tables):
    return t("link_names").withColumnRenamed("topic_index", "src").withColumn("hash", context_hash(F.col("name")))


@query("resolve_context_hash", asof(_BY_HASH, "page_anchors", "topic_offset", "r.src, r.seq"))
def _(t: Tables):
    return R.resolve_context_hash(links(t), contexts(t), t("page_anchors")).select("src", "seq", "topic_index")


@query("resolve_context_name", asof(_BY_HASH, "page_anchors", "topic_offset", "r.src, r.seq"))
def _(t: Tables):
    return R.resolve_context_name(links(t), contexts(t), t("page_anchors")).select("src", "seq", "topic_index")


view("map_refs", "SELECT event_id AS ref_id, 'pages' AS doc, CAST(event_id % 350 AS INT) AS map_id FROM {events}")
_MAP = "(SELECT doc, map_id, arg_min(topic_offset, ord) AS topic_offset FROM context_map GROUP BY ALL)"


@query("resolve_map_id", asof(f"(SELECT q.doc, ref_id, m.topic_offset FROM map_refs q LEFT JOIN {_MAP} m ON q.doc = m.doc AND q.map_id = m.map_id)", "page_anchors", "topic_offset", "r.ref_id"))
def _(t: Tables):
    return R.resolve_map_id(t("map_refs"), t("context_map"), t("page_anchors")).select("ref_id", "topic_index")


_NUMBER = "CASE WHEN regexp_matches(tr, '^0[xX][0-9a-fA-F]{1,12}$') THEN TRY_CAST(concat('0x', substring(tr, 3)) AS BIGINT) ELSE TRY_CAST(tr AS BIGINT) END"
_REFS = f"""(SELECT ref_id, doc, tr, CASE WHEN n BETWEEN -2147483648 AND 2147483647 THEN n END AS n, hash FROM (SELECT ref_id, doc, tr, CASE
    WHEN regexp_matches(tr, '^([+-]?[0-9]{{1,12}}|0[xX][0-9a-fA-F]{{1,12}})$') THEN {_NUMBER} END AS n, {duck_hash('tr')} AS hash
    FROM (SELECT ref_id, doc, nullif(trim(ref), '') AS tr FROM text_refs)))"""


@query("resolve_reference", f"""
    SELECT a.ref_id, coalesce(a.topic_index, b.topic_index) AS topic_index
    FROM ({asof(f"(SELECT q.doc, ref_id, c.topic_offset FROM {_REFS} q LEFT JOIN contexts_duck c ON q.doc = c.doc AND q.hash = c.hash AND q.tr IS NOT NULL)", "page_anchors", "topic_offset", "r.ref_id")}) a
   
    JOIN ({asof(f"(SELECT q.doc, ref_id, m.topic_offset FROM {_REFS} q LEFT JOIN {_MAP} m ON q.doc = m.doc AND q.n = m.map_id)", "page_anchors", "topic_offset", "r.ref_id")}) b USING (ref_id)""")
def _(t: Tables):
    return R.resolve_reference(t("text_refs"), contexts(t), t("context_map"), t("page_anchors")).select("ref_id", "topic_index")


view("number_refs", "SELECT event_id AS ref_id, 'pages' AS doc, CAST(event_id % 400 AS INT) AS number FROM {events}")
view("page_topics", """SELECT 'pages' AS doc, CAST(page_id AS INT) AS topic_index, 12 + 64 * page_id AS topic_pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
    FROM {pages}""")


@query("resolve_topic_number", """SELECT ref_id, p.topic_index FROM number_refs r LEFT JOIN topic_map m ON r.doc = m.doc AND r.number = m.ordinal AND m.topic_pos >= 12
    LEFT JOIN page_topics p ON p.doc = r.doc AND p.topic_pos = m.topic_pos""")
def _(t: Tables):
    return R.resolve_topic_number(t("number_refs"), t("topic_map"), t("page_topics")).select("ref_id", "topic_index")


@query("context_name_for_offset", """SELECT r.topic_offset, n.name FROM page_anchors r LEFT JOIN (SELECT topic_offset, arg_min(name, ord) AS name FROM topic_ids
    GROUP BY ALL) n USING (topic_offset)""")
def _(t: Tables):
    return R.context_name_for_offset(t("page_anchors").select("doc", "topic_offset"), t("topic_ids")).select("topic_offset", "name")


@query("default_window_for_topic", """SELECT p.topic_index, w.ordinal AS win_ordinal, w.name AS win_name FROM page_anchors p LEFT JOIN (SELECT topic_offset, arg_min(win, ord) AS win
    FROM default_windows GROUP BY ALL) d USING (topic_offset) LEFT JOIN windows w ON w.ordinal = d.win AND d.win >= 0""")
def _(t: Tables):
    return R.default_window_for_topic(t("page_anchors").withColumnRenamed("topic_offset", "start_offset"), t("default_windows"), t("windows")).select("topic_index", "win_ordinal", "win_name")


@query("resolve_window", """SELECT r.ref_id, coalesce(n.o, w.ordinal) AS win FROM window_refs r LEFT JOIN (SELECT lower(name) AS k, min(ordinal) AS o FROM windows
    WHERE name IS NOT NULL GROUP BY 1) n ON lower(r.win_name) = n.k LEFT JOIN windows w ON w.ordinal = r.win_number""")
def _(t: Tables):
    return R.resolve_window(t("window_refs"), t("windows")).select("ref_id", "win")


view("declared", """SELECT 'pages' AS doc, CAST(-1 AS BIGINT) AS contents_offset UNION ALL SELECT source, CASE WHEN min(doc_id) % 2 = 0 THEN 12 + 64 * min(doc_id)
    ELSE CAST(-1 AS BIGINT) END FROM {documents} GROUP BY source""")
view("every_topic", "SELECT doc, topic_index, topic_pos FROM {topics} UNION ALL SELECT doc, topic_index, topic_pos FROM {page_topics}")
view("every_anchor", "SELECT doc, topic_offset, topic_index, pos FROM {title_anchors} UNION ALL SELECT doc, topic_offset, topic_index, pos FROM {page_anchors}")


@query("contents_topic", f"""
    SELECT d.doc, coalesce(a.topic_index, m.topic_index, f.topic_index) AS topic_index FROM declared d LEFT JOIN ({asof('declared', 'every_anchor', 'contents_offset', 'r.doc')}) a ON d.doc = a.doc
    LEFT JOIN (SELECT t.doc, e.topic_index FROM topic_map t JOIN every_topic e ON t.doc = e.doc AND t.topic_pos = e.topic_pos WHERE t.ordinal = 0 AND t.topic_pos >= 12) m ON d.doc = m.doc
    LEFT JOIN (SELECT doc, min(topic_index) AS topic_index FROM every_topic GROUP BY doc) f ON d.doc = f.doc""")
def _(t: Tables):
    return R.contents_topic(t("declared"), t("topic_map"), t("every_topic"), t("every_anchor"))


def _side(side: str) -> str:
    number = f"""SELECT r.ref_id, p.topic_index FROM browse r LEFT JOIN topic_map m ON r.{side}_number = m.ordinal AND m.topic_pos >= 12
    LEFT JOIN page_topics p ON p.topic_pos = m.topic_pos"""
    return f"""(SELECT ref_id, coalesce(x.topic_index, y.topic_index) AS t FROM ({asof('browse', 'page_anchors', f'{side}_offset', 'r.ref_id')}) x
    JOIN ({number}) y USING (ref_id))"""


@query("browse_neighbors", f"SELECT ref_id, b.t AS browse_prev, f.t AS browse_next FROM {_side('back')} b JOIN {_side('fore')} f USING (ref_id)")
def _(t: Tables):
    return R.browse_neighbors(t("browse"), t("topic_map"), t("page_topics"), t("page_anchors")).select("ref_id", "browse_prev", "browse_next")


@query("physical_neighbors", """SELECT doc, topic_index, lag(topic_index) OVER w AS prev, lead(topic_index) OVER w AS next FROM topics WINDOW w AS (PARTITION BY doc
    ORDER BY topic_index)""")
def _(t: Tables):
    return R.physical_neighbors(t("topics"))


@query("all_topics_listing", """SELECT doc, topic_index, coalesce(nullif(trim(title), ''), concat('Topic ', CAST(topic_index + 1 AS STRING))) AS label FROM topics
    ORDER BY doc, topic_index""")
def _(t: Tables):
    return R.all_topics_listing(t("topics"))
