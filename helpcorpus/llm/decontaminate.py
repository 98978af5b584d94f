"""Benchmark decontamination with SimHash windows (native: DataFrame functions only).

A window has as many words as a benchmark item and is a multiset of shingles of five words. The matched
shingles of a text tell how the overlap with an item changes from start to start. Of every n starts in a row,
n being the item's words, the first one with the greatest overlap becomes a window, if that is as much as
the similarity needs. So the most similar window of a text is among them, and a text's windows for an item
have together no more words than both have: an item may be long.

Distinct windows get SimHash fingerprints, and the index finds the items for them: 64 bits are cut into
five blocks, and two fingerprints within radius 19 differ by three bits at most in one of them. Items stand
in the index under every value within three bits of each of their blocks, so a window meets, by its
length, block and bits, all items within the radius whichever it was laid for. Those within it are decided by exact weighted
Jaccard similarity. A shingle that repeats counts many times in a fingerprint, so windows and items with
such a one do not depend on the radius: they are decided directly, for the items that they were laid for.

A finding depends on the text alone, so texts stand by 128 bits of them, and equal texts are one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, text_key, whole, written

#: Sets of shingles of similarity 0.8 differ in 10 of 64 bits on average; 19 is three deviations more. The blocks' widths, and the
#: bits by which one of them differs at most within the radius (19 / 5, rounded down).
RADIUS, WIDTHS, PROBED = 19, (13, 13, 13, 13, 12), 3


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _grams(hashes: str, m: int) -> Column:
    """Hashes of the runs of m words."""
    h = F.col(hashes)
    runs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (m - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, m)]))
    return F.when(F.size(h) >= m, runs).otherwise(F.array().cast("array<long>"))


def _simhash(grams: Column) -> Column:
    bit = lambda j: F.aggregate(grams, F.lit(0), lambda n, h: n + F.shiftright(h, j).bitwiseAND(F.lit(1)).cast("int"))
    return F.aggregate(F.array(*[F.when(2 * bit(j) > F.size(grams), F.lit(1 << j if j < 63 else -(1 << 63))).otherwise(F.lit(0)) for j in range(64)]), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _blocks(fingerprint: str) -> Column:
    """Numbered bit blocks."""
    at, cuts = 0, []
    for i, width in enumerate(WIDTHS):
        cuts.append(F.struct(F.lit(i).alias("block"), F.shiftright(F.col(fingerprint), at).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")))
        at += width
    return F.array(*cuts)


def _probes() -> Column:
    """All values within PROBED bits of a block of the column bits, from 0 bits on."""
    masks = {i: [sum(1 << b for b in x) for n in range(PROBED + 1) for x in combinations(range(width), n)] for i, width in enumerate(WIDTHS)}
    by_block = F.coalesce(*[F.when(F.col("block") == i, F.expr(f"array({', '.join(f'{m}L' for m in ms)})")) for i, ms in masks.items()])
    return F.transform(by_block, lambda m: F.col("bits").bitwiseXOR(m))


def _numbered(table: DataFrame, by: list[str], grams: str) -> DataFrame:
    """(*by, grams): the shingles with the number of their like before them in their array hashed in, so that a multiset is a set; arrays without repeats stay."""
    once, again = table.where(~_repeats(grams)).select(*by, grams), table.where(_repeats(grams))
    d = again.select(*by, F.posexplode(grams).alias("_at", "_g"))
    nth = F.row_number().over(W.partitionBy(*by, "_g").orderBy("_at"))
    d = d.withColumn("_g", F.when(nth == 1, F.col("_g")).otherwise(F.xxhash64("_g", nth)))
    return once.unionByName(d.groupBy(*by).agg(F.collect_list("_g").alias(grams)))


def _need(m: int, percent: int) -> Column:
    """The least overlap of an item of n words with its window in a document of n_doc words."""
    both = F.col("n") + F.least("n", "n_doc") - 2 * (m - 1)
    return F.greatest(F.lit(1), F.ceil(F.lit(percent) * both / F.lit(100 + percent)).cast("int"))


def _repeats(grams: str) -> Column:
    return F.size(F.array_distinct(grams)) < F.size(grams)


def _stretches(m: int) -> Column:
    """Changes of the overlap from start to start: each of the matches at, sorted by shingle and place, counts from the start whose window it
    enters last to the one that it leaves, or earlier where the item's number of its like follows it in the window."""
    length = F.col("n") - (m - 1)

    def of(x: Column, i: Column) -> Column:
        later = F.get("at", i + x["c"])
        last = F.when(later["gram"] == x["gram"], F.least(x["p"], later["p"] - length)).otherwise(x["p"])
        first = F.greatest(F.lit(0), x["p"] - length + 1)
        return F.when(last >= first, F.array(F.struct(first.alias("start"), F.lit(1).alias("by")), F.struct((last + 1).alias("start"), F.lit(-1).alias("by"))))

    return F.flatten(F.filter(F.transform("at", of), lambda x: x.isNotNull()))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k1, k2, item_id, start, n_words, similarity): windows of texts that are similar to an item, the most similar of a text
    among them; k1 and k2 are the text's key.

    Words are lower-cased runs of letters and digits. An item of fewer than k words is one shingle of
    them; an item without words matches nothing. A document shorter than the item is one window.
    """
    items = benchmark.select(column(item_col).alias("item_id"), F.transform(_words(column(item_text)), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") > 0)
    items = items.withColumn("n", F.size("h")).withColumn("m", F.least(F.col("n"), F.lit(k)))
    by_size = F.coalesce(*[F.when(F.col("m") == m, _grams("h", m)) for m in range(1, k + 1)])
    items = written(items.withColumn("grams", by_size).select(F.monotonically_increasing_id().alias("iid"), "item_id", "n", "m", "grams"))
    per_item = items.select("iid", "n", "m", F.explode("grams").alias("gram"))
    per_item = written(per_item.groupBy("iid", "n", "m", "gram").agg(F.count(F.lit(1)).cast("int").alias("c")))
    sizes = [r["m"] for r in per_item.select("m").distinct().collect()] or [k]  # k numbers at most
    hashed = F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))
    texts = docs.select(text_key(column(text_col)).alias("key"), column(text_col).alias("text"))
    # explode of one element keeps what follows from being moved under this projection, where it would hash all words anew for each word
    d = texts.select("key.*", F.explode(F.array(hashed)).alias("h"))
    places = [F.transform(_grams("h", m), lambda g, p: F.struct(F.lit(m).alias("m"), p.alias("p"), g.alias("gram"))) for m in sizes]  # noqa: B023
    at = d.select("k1", "k2", F.size("h").alias("n_doc"), F.inline(F.concat(*places))).join(per_item, ["m", "gram"])
    pair = ["k1", "k2", "n_doc", "iid", "m", "n"]
    at = at.groupBy(*pair).agg(F.sort_array(F.collect_set(F.struct("gram", "p", "c"))).alias("at"))
    at = at.withColumn("need", F.coalesce(*[F.when(F.col("m") == m, _need(m, percent)) for m in sizes])).where(F.size("at") >= F.col("need"))
    at = at.select(*pair, "need", F.inline(F.coalesce(*[F.when(F.col("m") == m, _stretches(m)) for m in sizes])))
    # the window's frame takes in all changes at its start; what follows is grouped by more than these columns and is not shuffled again
    at = at.withColumn("both", F.sum("by").over(W.partitionBy(*pair).orderBy("start"))).where("by > 0 and both >= need")
    best = at.groupBy(*pair, F.floor(F.col("start") / F.col("n")).alias("cell")).agg(F.min_by("start", F.struct(-F.col("both"), "start")).alias("start"))
    laid = written(best.groupBy("k1", "k2", "m", "n", "start").agg(F.collect_set("iid").alias("iids")))
    # each text with a window once, hashed again
    hits = texts.select("key.*", "text").join(laid.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    hits = hits.select("k1", "k2", hashed.alias("h")).select("k1", "k2", *[_grams("h", m).alias(f"g{m}") for m in sizes])
    # a text's windows are cut in one go, so that its shingles are not written again for each
    spans = laid.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "n", "start", "iids")).alias("spans")).join(hits, ["k1", "k2"])

    def cut(x: Column) -> Column:
        grams = F.coalesce(*[F.when(x["m"] == m, F.col(f"g{m}")) for m in sizes])
        return F.struct(*[x[c].alias(c) for c in ("m", "n", "start", "iids")], F.slice(grams, x["start"] + 1, x["n"] - x["m"] + 1).alias("window"))

    laid = spans.select("k1", "k2", F.inline(F.transform("spans", cut)))
    laid = written(laid.select("k1", "k2", "m", "n", "start", "iids", F.struct(F.xxhash64(F.lit(1), "window"), F.xxhash64(F.lit(2), "window")).alias("w"), "window"))
    windows = laid.groupBy("m", "n", "w").agg(F.first("window").alias("window"))
    windows = written(windows.withColumn("f", _simhash(F.col("window"))).withColumn("many", _repeats("window")))
    marked = items.select("iid", "m", "n", _simhash(F.col("grams")).alias("f_item"), _repeats("grams").alias("many_item"))
    index = marked.where("not many_item").select("iid", "m", "n", "f_item", F.inline(_blocks("f_item"))).select("iid", "m", "n", "f_item", "block", F.explode(_probes()).alias("bits"))
    left = windows.where("not many").select("m", "n", "w", "f", F.inline(_blocks("f")))
    near = left.join(index, ["m", "n", "block", "bits"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("f_item"))) <= RADIUS).select("m", "n", "w", "iid")
    for_them = laid.select("m", "n", "w", F.explode("iids").alias("iid")).distinct().join(windows.select("m", "n", "w", "many"), ["m", "n", "w"])
    direct = for_them.join(marked.select("iid", "many_item"), "iid").where("many or many_item").select("m", "n", "w", "iid")
    pairs = near.unionByName(direct).distinct()
    both = pairs.join(_numbered(windows, ["m", "n", "w"], "window"), ["m", "n", "w"]).join(_numbered(items, ["iid", "item_id"], "grams"), "iid")
    both = both.withColumn("both", F.size(F.array_intersect("window", "grams"))).withColumn("all", F.size("window") + F.size("grams") - F.col("both"))
    # written, so that the join below stands alone and a passage of many documents can be split between tasks
    sure = both.where(F.lit(100) * F.col("both") >= F.lit(percent) * F.col("all")).select("m", "n", "w", "item_id", (F.col("both") / F.col("all")).alias("similarity")).distinct()
    return laid.join(written(sure), ["m", "n", "w"]).select("k1", "k2", "item_id", "start", F.col("n").alias("n_words"), "similarity").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, contaminated, items (sorted ids), similarity (the greatest, 0.0 if none).

    Null text has no words; a very long one is searched whole. Rows are decided by their text, so
    repeated rows agree and texts that share an id do not. An item that repeats an id is found under
    it. With an empty benchmark nothing is contaminated; an empty table gives an empty result. Other
    columns are not read, so none clashes.
    """
    found = written(leaks(docs, benchmark, k, percent, text_col).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity")))
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), text_key(column(text_col)).alias("key")).select("doc_id", "key.*")
    return rows.join(found, ["k1", "k2"], "left").select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns of any name, without those that hold a passage like a benchmark item.

    A row is decided by its text, as in `contamination`: rows without text stay, repeated rows stay or go
    together, very long texts are searched whole; an empty table or benchmark takes nothing away.
    """
    out = written(leaks(docs, benchmark, k, percent, text_col).select("k1", "k2").distinct())
    rows = docs.select(whole(docs).alias("row"), text_key(column(text_col)).alias("key")).select("row", "key.*")
    return rows.join(out, ["k1", "k2"], "left_anti").select("row.*")
