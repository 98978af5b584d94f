"""The corpus tables, derived from the given ones by the same expressions for both engines."""

from __future__ import annotations

from ..functions.scalars import hash_weight
from .registry import view

_WEIGHTS = ",".join(str(hash_weight(b)) for b in range(256))


def duck_hash(name: str) -> str:
    """DuckDB's expression of the context hash of a name."""
    byte = f"CAST(CAST('0x' || hex(encode({name}))[2 * i + 1 : 2 * i + 2] AS INT) AS BIGINT)"
    h = f"list_reduce(list_transform(range(octet_length(encode({name}))), lambda i: {byte}), lambda h, b: (((h * 43 + [{_WEIGHTS}][b + 1]) % 4294967296) + 4294967296) % 4294967296, CAST(0 AS BIGINT))"
    return f"CAST(CASE WHEN {name} = '' THEN 1 ELSE (SELECT CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END FROM (SELECT {h} AS u)) END AS INT)"


def duck_identity(doc: str, file: str) -> str:
    """DuckDB's expression of the path that a file's name means from a document: its own path for none, else from its folder, without dots and case."""
    path = f"""CASE WHEN trim(coalesce({file}, '')) = '' THEN {doc} WHEN starts_with(replace({file}, chr(92), '/'), '/') OR substring({file}, 2, 1) = ':' THEN {file}
        ELSE concat(regexp_extract(replace({doc}, chr(92), '/'), '^(.*/)[^/]*$', 1), {file}) END"""
    step = "CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:len(a) - 1] ELSE list_append(a, x[1]) END"
    parts = f"list_reduce(list_transform(string_split(p, '/'), lambda y: [y]), lambda a, x: {step}, CAST([] AS VARCHAR[]))"
    return f"(SELECT lower(concat(CASE WHEN starts_with(p, '/') THEN '/' ELSE '' END, array_to_string({parts}, '/'))) FROM (SELECT replace({path}, chr(92), '/') AS p))"


# only ids are put in order; texts are joined to their places
view("topics", """
    SELECT d.source AS doc, n.topic_index, CAST(12 + 64 * n.topic_index AS BIGINT) AS topic_pos, split_part(d.text, chr(10), 1) AS title, d.text AS plain_text, d.lang, d.doc_id
    FROM {documents} d JOIN (SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS topic_index
    FROM {documents}) n ON d.doc_id = n.doc_id""")
view("docs", "SELECT source AS doc, min(concat('Manual ', source)) AS title, CAST(count(*) AS BIGINT) AS n_topics FROM {documents} GROUP BY source")

_TYPE = "CASE WHEN line = 0 THEN 2 WHEN line % 7 = 0 THEN 35 WHEN line % 11 = 0 THEN 34 ELSE 32 END"
view("records",
    f"""SELECT doc, topic_index * 100000L + line AS pos, line = 0 AS is_header, {_TYPE} AS record_type, text, topic_index
    FROM (SELECT doc, topic_index, posexplode(split(plain_text, '\\n')) AS (line, text) FROM {{topics}})""",
    f"""SELECT doc, CAST(topic_index AS BIGINT) * 100000 + line AS pos, line = 0 AS is_header, {_TYPE} AS record_type, text, topic_index
    FROM (SELECT doc, topic_index, unnest(string_split(plain_text, chr(10))) AS text, unnest(range(len(string_split(plain_text, chr(10))))) AS line
    FROM topics)""")

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
view("record_lengths", f"""
    SELECT CAST(l_orderkey % 20 AS STRING) AS doc, CAST(12 + 16 * row_number() OVER (PARTITION BY l_orderkey % 20 ORDER BY {_ORDER}) AS BIGINT) AS pos,
           CAST(floor(l_quantity) AS BIGINT) AS length, CAST(dense_rank() OVER (PARTITION BY l_orderkey % 20 ORDER BY l_orderkey) - 1 AS INT) AS topic_index,
           CASE WHEN l_linenumber % 7 = 6 THEN 34 WHEN l_linenumber % 3 = 0 THEN 35 ELSE 32 END AS record_type
    FROM {{lineitem}}""")
_BLOCK = "CAST(floor((pos - 12) / 4096) AS BIGINT)"
view("anchors", f"""
    SELECT doc, {_BLOCK} * 32768 + coalesce(CAST(sum(length) OVER (PARTITION BY doc, {_BLOCK} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS topic_offset, topic_index, pos
    FROM {{record_lengths}} WHERE record_type IN (32, 35) AND pos >= 12""")
view("offset_refs", """
    SELECT CAST(user_id % 20 AS STRING) AS doc, event_id AS ref_id,
           CASE WHEN event_id % 50 = 0 THEN -1 ELSE CAST(floor(value * 100) AS BIGINT) + 32768 * (event_id % 16) END AS topic_offset
    FROM {events}""")
view("title_anchors", "SELECT doc, topic_pos AS topic_offset, topic_index, topic_pos AS pos FROM {topics}")
# words of titles are keywords from four letters on, so articles and the like are none
view("keywords",
    """SELECT doc, table_id, ord, keyword, CASE WHEN ord % 13 = 0 THEN array_append(offsets, -1L) ELSE offsets END AS offsets FROM (
        SELECT doc, table_id, CAST(row_number() OVER (PARTITION BY doc, table_id ORDER BY keyword) - 1 AS INT) AS ord, keyword, array_sort(collect_set(topic_pos)) AS offsets
        FROM (SELECT doc, 'K' AS table_id, topic_pos, explode(split(title, ' ')) AS keyword FROM {topics}
              UNION ALL SELECT doc, 'A', topic_pos, concat(lang, '-', CAST(CAST(floor(topic_index / 25) AS INT) AS STRING)) FROM {topics})
        WHERE length(keyword) >= 4 GROUP BY doc, table_id, keyword)""",
    """SELECT doc, table_id, ord, keyword, CASE WHEN ord % 13 = 0 THEN list_append(offsets, -1) ELSE offsets END AS offsets FROM (
        SELECT doc, table_id, CAST(row_number() OVER (PARTITION BY doc, table_id ORDER BY keyword) - 1 AS INT) AS ord, keyword, list_sort(list_distinct(list(topic_pos))) AS offsets
        FROM (SELECT doc, 'K' AS table_id, topic_pos, unnest(string_split(title, ' ')) AS keyword FROM topics
              UNION ALL SELECT doc, 'A', topic_pos, concat(lang, '-', CAST(CAST(floor(topic_index / 25) AS INT) AS STRING)) FROM topics)
        WHERE length(keyword) >= 4 GROUP BY doc, table_id, keyword)""")
_STRIP = "regexp_replace(lower({}), '^[.,]+|[.,]+$', ''{})"
_FIRST = "split_part(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ', 1)"
view("context_names", f"SELECT 'pages' AS doc, page_id AS ord, {_STRIP.format(_FIRST, '')} AS name, 12 + 64 * page_id AS topic_offset FROM {{pages}}", f"""SELECT 'pages' AS doc, page_id AS ord, {_STRIP.format(_FIRST, chr(44) + chr(39) + 'g' + chr(39))} AS name, 12 + 64 * page_id AS topic_offset
    FROM pages""")
view("page_anchors", "SELECT 'pages' AS doc, 12 + 64 * page_id AS topic_offset, CAST(page_id AS INT) AS topic_index, 12 + 64 * page_id AS pos FROM {pages}")
view("link_names",
    f"""SELECT 'pages' AS doc, CAST(page_id AS INT) AS topic_index, CAST(seq AS INT) AS seq, {_STRIP.format('href', '')} AS name, href AS anchor_text, seq % 2 = 1 AS popup
    FROM (SELECT page_id, posexplode(regexp_extract_all(html, '<a href=\"/([^\"]+)\"', 1)) AS (seq, href) FROM {{pages}})""",
    f"""SELECT 'pages' AS doc, CAST(page_id AS INT) AS topic_index, CAST(seq AS INT) AS seq, {_STRIP.format('href', chr(44) + chr(39) + 'g' + chr(39))} AS name, href AS anchor_text, seq % 2 = 1 AS popup
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"/([^\"]+)\"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href=\"/([^\"]+)\"', 1)))) AS seq
    FROM pages)""")
view("context_map", "SELECT 'pages' AS doc, p_partkey AS ord, CAST(p_partkey % 300 AS INT) AS map_id, 12 + 64 * (p_partkey % 400) AS topic_offset FROM {part}")
view("topic_ids", "SELECT 'pages' AS doc, p_partkey AS ord, 12 + 64 * (p_partkey % 500) AS topic_offset, p_name AS name FROM {part}")
view("default_windows", "SELECT 'pages' AS doc, p_partkey AS ord, 12 + 64 * (p_partkey % 500) AS topic_offset, p_size % 5 - 1 AS win FROM {part}")
view("windows", """SELECT 'pages' AS doc, ordinal, name, caption
    FROM (VALUES (0, 'main', 'Main'), (1, 'Steps', 'Step by step'), (2, 'gloss', 'Glossary'), (3, CAST(NULL AS STRING), 'Nameless'), (4, 'STEPS', 'Again')) AS w(ordinal, name, caption)""")
view("topic_map", "SELECT 'pages' AS doc, CAST(page_id AS INT) AS ordinal, CASE WHEN page_id % 17 = 3 THEN -1 ELSE 12 + 64 * page_id END AS topic_pos FROM {pages}")
view("window_refs", """SELECT event_id AS ref_id, 'pages' AS doc, CASE event_id % 6 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'steps' WHEN 2 THEN 'nowhere'
    WHEN 3 THEN CAST(NULL AS STRING) ELSE 'Gloss' END AS win_name, CASE WHEN event_id % 4 = 3 THEN CAST(NULL AS INT)
    ELSE CAST(event_id % 7 AS INT) END AS win_number FROM {events}""")
view("text_refs", """SELECT event_id AS ref_id, 'pages' AS doc, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat(' ', CAST(event_id % 300 AS STRING), ' ')
    WHEN 2 THEN concat('0x', lower(CAST(event_id % 90 AS STRING))) WHEN 3 THEN '99999999999' WHEN 4 THEN 'nothing' ELSE 'the' END AS ref FROM {events}
    UNION ALL SELECT 1000000000 + ord, doc, name FROM {context_names}""")
view("browse", """
    SELECT 'pages' AS doc, turn + 100 * conv_id AS ref_id, CASE WHEN turn % 5 = 4 THEN CAST(NULL AS BIGINT) ELSE 12 + 64 * ((conv_id * 7 + turn - 1) % 400) END AS back_offset,
           CASE WHEN turn % 5 = 3 THEN CAST(NULL AS BIGINT) ELSE 12 + 64 * ((conv_id * 7 + turn + 1) % 400) END AS fore_offset,
           CAST((conv_id + turn) % 300 AS INT) AS back_number, CASE WHEN turn % 2 = 0 THEN CAST(NULL AS INT) ELSE CAST((conv_id + 2 * turn) % 300 AS INT) END AS fore_number
    FROM {conversations}""")
view("fonts", """SELECT CAST(p_partkey % 20 AS STRING) AS doc, CAST(p_partkey AS INT) AS font_index, CAST(p_partkey % 12 AS INT) AS face_index, CASE p_size % 6
    WHEN 0 THEN 'Symbol' WHEN 1 THEN ' MS Gothic ' WHEN 2 THEN 'Gulim' WHEN 3 THEN 'SimSun' WHEN 4 THEN 'MingLiU'
    ELSE p_brand END AS face_name, p_size * 10 AS twips, 400 + 300 * (p_size % 2) AS weight, p_size % 8 AS flags FROM {part}""")
view("descriptors", """SELECT doc, font_index, face_name, twips, weight, flags, CAST(font_index % 5 AS INT) AS family, CAST(font_index % 256 AS INT) AS red, CAST(font_index * 7 % 256 AS INT) AS green, CAST(font_index % 2 * 255 AS INT) AS blue, CASE font_index % 6
    WHEN 1 THEN 177 WHEN 2 THEN 178 WHEN 3 THEN 204 ELSE CAST(NULL AS INT) END AS charset FROM {fonts}""")
view("charsets", """SELECT CAST(s_suppkey % 20 AS STRING) AS doc, CAST(s_suppkey % 9 AS INT) AS face_index, min(CAST(CASE WHEN s_nationkey % 4 = 0 THEN 1
    ELSE 160 + s_nationkey END AS INT)) AS charset FROM {supplier} GROUP BY 1, 2""", """SELECT CAST(s_suppkey % 20 AS STRING) AS doc, CAST(s_suppkey % 9 AS INT) AS face_index, min(CAST(CASE WHEN s_nationkey % 4 = 0 THEN 1
    ELSE 160 + s_nationkey END AS INT)) AS charset FROM supplier GROUP BY 1, 2""")
view("locales", """SELECT CAST(n_nationkey AS STRING) AS doc, CASE n_nationkey % 9 WHEN 0 THEN 1028 WHEN 1 THEN 3098 WHEN 2 THEN 2074 WHEN 3 THEN 1025 WHEN 4 THEN 1049
    WHEN 5 THEN 1032 WHEN 6 THEN 1041 WHEN 7 THEN 1066 ELSE CAST(NULL AS INT) END AS locale FROM {nation}""")
view("headers", """
    SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 11 = 0 THEN 151116 WHEN o_orderkey % 13 = 0 THEN 7 ELSE 220991 END AS magic,
           CAST(floor(o_totalprice) AS BIGINT) % 5000 AS directory_start, CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE o_custkey % 4000 END AS first_free,
           CASE WHEN o_orderkey % 17 = 0 THEN 10 ELSE 3000 + o_custkey % 2000 END AS logical_size, 4000 + o_orderkey % 1000 AS actual_size
    FROM {orders}""")
view("topic_headers", """
    SELECT 'pages' AS doc, CAST(o_orderkey AS BIGINT) AS pos, o_orderkey % 2 = 0 AS modern, CAST(o_custkey % 40 - 10 AS BIGINT) AS back, CAST(o_custkey % 60 - 10 AS BIGINT) AS fore,
           CASE WHEN o_orderkey % 7 = 0 THEN 65535 ELSE o_custkey % 900 - 5 END AS number, CAST(o_custkey % 30 AS BIGINT) AS non_scroll, CAST(o_orderkey % 50 AS BIGINT) AS scroll, CAST(o_custkey % 100 - 3 AS BIGINT) AS next_topic
    FROM {orders}""")
view("region_records", """SELECT CAST(l_orderkey AS BIGINT) AS topic_id, l_partkey % 100 AS pos, CASE WHEN l_orderkey % 4 = 0 THEN CAST(NULL AS BIGINT)
    ELSE l_orderkey % 40 END AS non_scroll, CASE WHEN l_orderkey % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE 30 + l_orderkey % 30 END AS scroll, CASE
    WHEN l_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE 70 + l_orderkey % 20 END AS next_topic, CASE l_linenumber % 4 WHEN 0 THEN 32 WHEN 1 THEN 35
    WHEN 2 THEN 34 ELSE 2 END AS record_type, concat(l_returnflag, chr(0), l_linestatus) AS payload, l_linenumber AS line FROM {lineitem}""", """SELECT CAST(l_orderkey AS BIGINT) AS topic_id, l_partkey % 100 AS pos, CASE WHEN l_orderkey % 4 = 0 THEN CAST(NULL AS BIGINT)
    ELSE l_orderkey % 40 END AS non_scroll, CASE WHEN l_orderkey % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE 30 + l_orderkey % 30 END AS scroll, CASE
    WHEN l_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE 70 + l_orderkey % 20 END AS next_topic, CASE l_linenumber % 4 WHEN 0 THEN 32 WHEN 1 THEN 35
    WHEN 2 THEN 34 ELSE 2 END AS record_type, concat(l_returnflag, chr(0), l_linestatus) AS payload, l_linenumber AS line FROM lineitem""")
