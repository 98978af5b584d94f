"""Ranked full-text search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.lineage import written
from ..functions.scalars import file_name, fold_text, topic_label

LIMIT = 200


def build_search_table(topics: DataFrame, topic_keywords: DataFrame) -> DataFrame:
    """(doc, topic_index, title, folded_title, folded_body, folded_keywords); folded once, not for each query."""
    d = topics.select("doc", "topic_index", "title", fold_text(F.col("title")).alias("folded_title"), fold_text(F.col("plain_text")).alias("folded_body"))
    return d.join(topic_keywords, ["doc", "topic_index"], "left").withColumn("folded_keywords", F.coalesce("folded_keywords", F.array().cast("array<string>")))


def _ladder(text: Column, q: Column, equal: int, start: int, inside: int) -> Column:
    return F.when(text == q, equal).when(F.startswith(text, q), start).when(F.contains(text, q), inside).otherwise(0)


def score_title(q: Column) -> Column:
    return _ladder(F.col("folded_title"), q, 1000, 850, 700)


def score_keyword(q: Column) -> Column:
    near = F.filter("folded_keywords", lambda k: F.contains(k, q))
    return F.when(F.size(near) > 0, F.array_max(F.transform(near, lambda k: _ladder(k, q, 950, 800, 650)))).otherwise(0)


def score_body(q: Column, terms: Column | None = None) -> Column:
    """The phrase: 400 and its bytes up to 100; else all of several terms: 300 and five for each up to 20. terms: the query's, where they are split before."""
    body, terms = F.col("folded_body"), F.split(q, " ") if terms is None else terms
    every = (F.size(terms) > 1) & F.forall(terms, lambda t: F.contains(body, t))
    return F.when(F.contains(body, q), 400 + F.least(F.octet_length(q), F.lit(100))).when(every, 300 + 5 * F.least(F.size(terms), F.lit(20))).otherwise(0)


def score(q: Column, terms: Column | None = None) -> Column:
    return F.when(q == "", 0).otherwise(F.greatest(score_title(q), score_keyword(q), score_body(q, terms)))


def kind_of(score: Column) -> Column:
    """The rungs of the ladders do not overlap, so the score tells where the match was."""
    return F.when(score.isin(1000, 850, 700), "Title").when(score.isin(950, 800, 650), "Keyword").otherwise("Body")


def hits(search_topics: DataFrame, query: str) -> DataFrame:
    q = fold_text(F.lit(query))
    return search_topics.withColumn("score", score(q)).where("score > 0").withColumn("kind", kind_of(F.col("score"))).select("doc", "topic_index", "title", "score", "kind")


def search_topics_in(search_topics: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """The best hits of each document: by score, then topic."""
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("score"), "topic_index"))
    return hits(search_topics, query).withColumn("rank", rank).where(F.col("rank") <= limit)


def search_corpus(search_topics: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """The best hits of all documents with their label: by score, document and topic."""
    kind = F.when(F.col("kind") == "Body", "Text").otherwise(F.col("kind"))
    label = F.concat(F.lit("["), kind, F.lit("] "), topic_label(F.col("title"), F.col("topic_index")), F.lit(" — "), file_name(F.col("doc")))
    return hits(search_topics, query).orderBy(F.desc("score"), "doc", "topic_index").limit(limit).select("doc", "topic_index", "score", label.alias("label"))


#: A text is checked for so many runs of each query before its score is taken.
KEYS = 8


def _codes(text: str, size: int) -> np.ndarray:
    """All runs of so many characters (1 to 3) as numbers: 21 bits for each character, from one."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    return c if size == 1 else c[:-1] | c[1:] << 21 if size == 2 else c[:-2] | c[1:-1] << 21 | c[2:] << 42


@F.pandas_udf(ArrayType(LongType()))
def _runs(terms: pd.Series) -> pd.Series:
    """A term's distinct runs of three characters; terms of one or two are their own."""
    return pd.Series([np.unique(_codes(x, min(len(x), 3))) for x in terms], dtype=object)


def query_keys(q: DataFrame) -> DataFrame:
    """(at, runs): up to KEYS runs that a text with the query's terms holds, those of fewest queries first. Short terms count for queries without longer ones. q(at, terms)"""
    terms = q.select("at", F.explode(F.array_distinct("terms")).alias("term")).withColumn("size", F.least(F.length("term"), F.lit(3)))
    runs = terms.select("at", "size", F.explode(_runs("term")).alias("run")).distinct()
    n = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    kept = runs.join(n, "run").withColumn("nth", F.row_number().over(W.partitionBy("at").orderBy(F.desc("size"), "n", "run")))
    best = F.array_sort(F.collect_list(F.struct("nth", "run")))
    return kept.where(F.col("nth") <= KEYS).groupBy("at").agg(best.alias("runs")).select("at", F.transform("runs", lambda x: x["run"]).alias("runs"))


def _asking(text: Column, asked: DataFrame) -> Column:
    """The queries (their `at`) of asked(at, terms, runs), a slice of a table, whose runs and then whose terms a text holds. Tasks get the slice with the function."""
    d = asked.select("at", "terms", "runs").toPandas()
    terms, at, keys = [list(x) for x in d["terms"]], d["at"].to_numpy(np.int64), np.array([[*r, *[r[0]] * (KEYS - len(r))] for r in d["runs"]], np.int64).reshape(-1, KEYS)
    known, place = np.unique(keys, return_inverse=True)
    place, sizes = place.reshape(-1, KEYS), [n for n in (1, 2, 3) if ((known >= 1 << 21 * (n - 1)) & (known < 1 << 21 * n)).any()]
    known = np.append(known, np.iinfo(np.int64).max)

    @F.pandas_udf(ArrayType(LongType()))
    def found(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            held = np.zeros(len(known), bool)
            for n in sizes:
                c = _codes(text, n)
                i = np.searchsorted(known, c)
                held[i[known[i] == c]] = True
            m = np.arange(len(at))
            for j in range(KEYS):
                m = m[held[place[m, j]]]
            out.append(at[[i for i in m if all(x in text for x in terms[i])]])
        return pd.Series(out, dtype=object)

    return found(text)


def _head() -> Column:
    """Title and keywords as one text."""
    return F.concat_ws(" ", "folded_title", "lines")


def _keyword_lines(d: DataFrame) -> DataFrame:
    """With all keywords in one text, each between line feeds, which folded texts do not have; so a rung is one look."""
    return d.withColumn("lines", F.concat(F.lit("\n"), F.array_join("folded_keywords", "\n"), F.lit("\n"))).drop("folded_keywords")


def _score_head(q: Column) -> Column:
    """The better of title and keyword (650 and more), null for none."""
    title, lines, n = F.col("folded_title"), F.col("lines"), F.lit("\n")
    return (
        F.when(title == q, 1000).when(F.contains(lines, F.concat(n, q, n)), 950).when(F.startswith(title, q), 850).when(F.contains(lines, F.concat(n, q)), 800)
        .when(F.contains(title, q), 700).when(F.contains(lines, q), 650)
    )


def _best(asked: DataFrame, text: Column, search_topics: DataFrame, s: Column, k: int) -> DataFrame:
    """The k best topics of each query of asked(at, query_id, q, terms, runs) among those whose text holds its terms. Texts are neither shuffled nor written."""
    met = search_topics.withColumn("at", F.explode(_asking(text, asked))).join(F.broadcast(asked.drop("runs")), "at")
    pairs = met.select("query_id", "doc", "topic_index", s.alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc", "topic_index"))
    # scores of none come last; a filter before the rank would take each score twice
    return pairs.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") > 0))


def search_batch(search_topics: DataFrame, queries: DataFrame, k: int = 10, slice_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, doc, topic_index, score, kind): the k best topics of each query of a table.

    A match needs all of a query's terms, each within one word. So a query's candidates are the topics
    that hold runs of three characters of its terms, the runs that fewest other queries have, and then the terms.
    Every title or keyword rung (650 and more) stands above every body rung (500 at most), so titles and
    keywords are searched first; queries that find k topics there are done, and bodies are searched for
    the others only. Only candidates are scored, where they are read; the k best of each task are kept before
    the shuffle (Spark's window group limit). Queries go to the topics; a table of more than slice_bytes
    is taken in slices, and the topics are read for each. Blank queries are dropped.
    """
    q = queries.select("query_id", fold_text(F.col("query")).alias("q")).where("q <> ''").withColumn("terms", F.split("q", " "))
    slices = 1 + (q.agg(F.sum(F.octet_length("q") + 64)).first()[0] or 0) // slice_bytes
    q = written(q.withColumn("at", F.monotonically_increasing_id()))
    return reduce(DataFrame.unionByName, [_search_slice(search_topics, q.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i), k) for i in range(slices)])


def _search_slice(search_topics: DataFrame, q: DataFrame, k: int) -> DataFrame:
    asked = written(q.join(query_keys(q), "at"))
    topics = _keyword_lines(search_topics)
    first = written(_best(asked, _head(), topics.drop("folded_body"), _score_head(F.col("q")), k))
    done = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
    rest = asked.join(done, "query_id", "left_anti")
    lower = _best(rest, F.concat_ws(" ", _head(), "folded_body"), topics, F.coalesce(_score_head(F.col("q")), score_body(F.col("q"), F.col("terms"))), k)
    found = first.join(done, "query_id", "left_semi").unionByName(lower)
    return found.select("query_id", "rank", "doc", "topic_index", "score", kind_of(F.col("score")).alias("kind"))


def search_export_profile(topics: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """The exported page's own ranking: 100 for an equal title, 40 for one that contains the query, 10 for the body."""
    q = F.lower(F.trim(F.lit(query)))
    title, body = F.lower("title"), F.lower("plain_text")
    s = F.when(title == q, 100).otherwise(0) + F.when(F.contains(title, q), 40).otherwise(0) + F.when(F.contains(body, q), 10).otherwise(0)
    return topics.select("doc", "topic_index", "title", s.alias("score")).where("score > 0").orderBy(F.desc("score"), "title", "doc", "topic_index").limit(limit)
