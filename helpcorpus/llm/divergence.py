"""How the sources of a language differ in their words: chi-square-like divergence of term shares, in exact integers.

Each (lang, source) group is a sparse row over the language's terms. The divergence of two groups sums
over all kept terms; only terms that both have need a look at both rows. So the sum is taken with every
term absent from one side or both (the zero baseline), from each row's own histogram of counts, and
corrected for the terms that both have. The corrections come from Gustavson's row accumulation: a task
holds a piece of the term-major index, and each group scatters its terms through it into a dense
accumulator with a cell for each peer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, written

#: What a term consists of: ASCII letters, of which capitals are lower-cased, and all bytes of other characters.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: A task's counts are handed on when they have so many cells, an accumulator's cells likewise.
CELLS = 300_000
ONE = 1_000_000_000


def _counted(cells: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush():
            rows = [(lang, source, t, n, docs[t]) for (lang, source), (ns, docs) in groups.items() for t, n in ns.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["lang", "source", "term", "n", "docs"])

        groups, held = {}, 0
        for b in batches:
            langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, b.column("text"), strict=True):
                words = (text.as_py() or b"").translate(TERM_BYTES).split()
                ns, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(ns)
                ns.update(words)
                docs.update(set(words))
                held += len(ns)
                if held > cells:
                    yield flush()
                    groups, held = {}, 0
        if held:
            yield flush()

    return run


def _accumulated(cells: int):
    """Batches of the term-major index to (lang, a, b, value): for each term that both have, what the baseline without it is wrong by."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part = lambda p, q: (p - q) * (p - q) // q
        totals, held = {}, 0

        def flush():
            out = [(lang, a, np.flatnonzero(acc), acc) for (lang, a), acc in totals.items()]
            at = lambda f, t: pa.array(np.concatenate([f(*x) for x in out]) if out else [], t)
            langs = pa.array([x[0] for x in out for _ in range(len(x[2]))], pa.string())
            cols = [langs, at(lambda _, a, i, acc: np.full(len(i), a), pa.int32()), at(lambda _, a, i, acc: i, pa.int32()), at(lambda _, a, i, acc: acc[i], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["lang", "a", "b", "value"])

        for batch in batches:
            langs, width = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("width").to_numpy(zero_copy_only=False)
            posts = batch.column("posts")
            start = posts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            flat = posts.values
            i, p, p0 = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("i", "p", "p0"))
            of_term = np.repeat(np.arange(batch.num_rows), np.diff(start))
            span = np.arange(start[0], start[-1])
            for lang in set(langs.tolist()):
                mine = span[(langs == lang)[of_term]]
                mine = mine[np.argsort(i[mine], kind="stable")]  # row by row
                for row in np.split(mine, np.flatnonzero(np.diff(i[mine])) + 1):
                    terms = of_term[row - start[0]]
                    n = start[terms + 1] - start[terms]
                    cell = np.repeat(start[terms] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    a = int(i[row[0]])
                    pa_, qa = np.repeat(p[row], n), np.repeat(p0[row], n)
                    pb, qb = p[cell], p0[cell]
                    if (lang, a) not in totals:
                        totals[lang, a] = np.zeros(int(width[terms[0]]), np.int64)
                        held += len(totals[lang, a])
                    np.add.at(totals[lang, a], i[cell], part(pa_, pb) - part(pa_, qb) - part(qa, pb) + part(qa, qb))
            if held > cells:
                yield flush()
                totals, held = {}, 0
        if totals:
            yield flush()

    return run


def share(n: Column, of: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (of + terms)), exact for any counts; without terms and counts, as if there were one."""
    below = F.greatest(of + terms, F.lit(1))
    whole, rest = F.call_function("div", n + 1, below), F.pmod(n + 1, below)
    wide = F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * rest.cast("decimal(20,0)"), below.cast("decimal(20,0)")).cast("long")
    return 1 + whole * ONE + F.when(rest < 9 * ONE, F.call_function("div", rest * ONE, below)).otherwise(wide)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_index(docs: DataFrame, least_docs: int = 3, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(lang, term, n, posts): the kept terms of each language with the groups that have them, as (i, n); and
    (lang, terms, n, width, sources, ns): a row for each language, sources in order, i their place in it.

    docs(lang, source, text as bytes), without nulls. A posting list has at most a cell for each source of a
    language.
    """
    groups = docs.select("lang", "source").distinct()
    groups = written(groups.withColumn("i", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")))
    cut = docs.mapInArrow(_counted(cells), "lang string, source string, term binary, n bigint, docs bigint")
    cut = cut.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).join(groups, ["lang", "source"])
    index = cut.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("i", "n"))).alias("posts")).where(F.col("docs") >= least_docs)
    index = written(index.select("lang", F.col("term").cast("string").alias("term"), "n", "posts"))
    per = index.select("lang", F.inline("posts")).groupBy("lang", "i").agg(F.sum("n").alias("n"))
    every = groups.join(per, ["lang", "i"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    kept = index.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("n"))
    none = F.lit(0).cast("long")
    langs = every.join(kept, "lang", "left").select("lang", F.coalesce("terms", none).alias("terms"), F.coalesce("n", none).alias("n"), F.size("g").alias("width"), F.col("g.source").alias("sources"), F.col("g.n").alias("ns"))
    return index, written(langs)


def pair_values(index: DataFrame, langs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(lang, a, b, value): the divergence of group a from group b, for all pairs of a language's sources, in places."""
    about = langs.select("lang", "terms", "width", "ns")
    at = lambda i: F.get("ns", i)
    terms = F.col("terms")
    posts = F.transform("posts", lambda x: F.struct(x["i"].alias("i"), share(x["n"], at(x["i"]), terms).alias("p"), share(F.lit(0).cast("long"), at(x["i"]), terms).alias("p0")))
    found = index.select("lang", "posts").join(about, "lang").select("lang", "width", posts.alias("posts"))
    corrections = found.mapInArrow(_accumulated(cells), "lang string, a int, b int, value bigint").where("a <> b")
    # a row's own counts, as (count, terms with it)
    own = index.select("lang", F.inline("posts")).groupBy("lang", "i", "n").agg(F.count(F.lit(1)).alias("k"))
    own = own.groupBy("lang", "i").agg(F.collect_list(F.struct("n", "k")).alias("own"), F.sum("k").alias("has"))
    rows = langs.select("lang", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("a"))
    rows = rows.join(own.withColumnRenamed("i", "a"), ["lang", "a"], "left").repartition("lang", "a").join(about, "lang")
    rows = rows.withColumn("own", F.transform(F.coalesce("own", F.array().cast("array<struct<n: bigint, k: bigint>>")), lambda x: F.struct(share(x["n"], at(F.col("a")), terms).alias("p"), x["k"].alias("k"))))
    p0 = lambda i: share(F.lit(0).cast("long"), at(F.col(i)), terms)
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).where("a <> b").withColumn("p0a", p0("a")).withColumn("p0b", p0("b"))
    total = lambda f: F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["k"] * f(x["p"]))
    has = F.coalesce("has", F.lit(0))
    forth = total(lambda p: divergence(p, F.col("p0b"))) + (terms - has) * divergence(F.col("p0a"), F.col("p0b"))
    back = total(lambda p: divergence(F.col("p0b"), p)) - has * divergence(F.col("p0b"), F.col("p0a"))
    both = rows.select("lang", F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b"), forth.alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), back.alias("value")))))
    return both.unionByName(corrections).groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source differs from its language's others, and by which terms.

    Part `pair` has a row for each other source of the language, with the sum over all kept terms; part
    `term` the `top` terms that are more frequent in the source than in its language as a whole.

    Null text, lang and source are empty; a null and an empty lang or source are one. A source without
    terms has pairs, a language with one source has none; without kept terms all pairs are 0. Ties are
    ordered by item. An empty table gives no rows, repeated rows count again, other columns are not read.
    Values are exact while a language keeps fewer than 2 * 10^9 terms. A row of the result's pairs stands
    for each two sources of a language, so a language's sources are assumed to be few enough to list.
    """
    some = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    d = docs.select(some("lang").alias("lang"), some("source").alias("source"), some(text_col).cast("binary").alias("text"))
    index, langs = term_index(d, least_docs, cells)
    name = lambda i: F.get("sources", F.col(i))
    pairs = pair_values(index, langs, cells).join(langs.select("lang", "sources"), "lang")
    pairs = pairs.select("lang", name("a").alias("source"), F.lit("pair").alias("part"), name("b").alias("item"), "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    flat = index.select("lang", "term", F.col("n").alias("all"), F.inline("posts")).join(langs.withColumnRenamed("n", "every"), "lang")
    flat = flat.withColumn("p", share(F.col("n"), F.get("ns", F.col("i")), F.col("terms"))).withColumn("q", share(F.col("all"), F.col("every"), F.col("terms"))).where("p > q")
    flat = flat.select("lang", name("i").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    best = flat.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(best)
