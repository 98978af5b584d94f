"""The registered queries of this package: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .decontaminate import contamination
from .divergence import source_divergence
from .exactdedup import exact_dedup
from .filteraudit import filter_audit
from .jaccard import jaccard_components
from .lm import score
from .mixing import mix
from .pii import personal_data
from .quality import quality
from .sharding import shuffle_shards
from .tokencount import token_counts
from .toxicity import toxicity
from .warc import warc_round_trip


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shuffle_shards(read(spark, sf_dir, "documents"), 16)
    return d.select("doc_id", F.col("_size").alias("size"), F.col("_crc32").alias("text_crc32"), F.col("_law").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), k=3, percent=90)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.round("_weight", 9).alias("weight"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op")]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


SQUEEZED = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')"


WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
            g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS first FROM p)
            SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
                   array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + ((CAST('0x' || substr(x, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
                   CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
            FROM g""",
        "op12_source_divergence": """
            WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id,
                              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
            t AS (SELECT lang, source, doc_id, unnest(w) AS term FROM d),
            k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
            c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
            g AS (SELECT lang, source, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) s),
            v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
            f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + v.v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v))::HUGEINT AS l
                  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
            pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
                      FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                      LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
            terms AS (SELECT lang, source, term AS item, ((p - l) * (p - l) // l)::BIGINT AS value FROM f WHERE n > 0 AND p > l),
            x AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms)
            SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
            FROM x QUALIFY part = 'pair' OR rank <= 200""",
        "op13_filter_interaction": """
            WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
            f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
                         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
            m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
            s AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY ALL),
            perms AS (SELECT '' AS o UNION ALL SELECT o || x FROM perms, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
            o AS (SELECT o, unnest(range(1, 6)) AS step FROM perms WHERE length(o) = 5),
            e AS (SELECT s.*, o.o, o.step, contains(fails, substr(o, step, 1)) AS own, len(list_filter(range(1, step), lambda i: contains(fails, substr(o, i, 1)))) > 0 AS earlier FROM s, o)
            SELECT part, o AS filter_order, CAST(step AS INT) AS step, sum(CASE WHEN own OR earlier THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN own AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND length(fails) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
                   sum(CASE WHEN own THEN n * 120 // length(fails) ELSE 0 END)::BIGINT AS shapley
            FROM e GROUP BY part, o, step""",
        "op6_ngram_jaccard_join": f"""
            WITH RECURSIVE t AS (SELECT doc_id, {WORDS} AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 90 * (x.n + y.n - k)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            walk AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node),
            c AS (SELECT node, min(root) AS root FROM walk GROUP BY node)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
            FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
        "op9_exact_dedup": f"""
            WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({SQUEEZED}) AS text_sha256, {SQUEEZED} AS k FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
                   row_number() OVER w = 1 AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id)""",
    }
