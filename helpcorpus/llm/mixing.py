"""Mixing sources to target weights by temperature (native: DataFrame functions only).

A source's weight is its token share to the power alpha, normalised. Alpha is bisected in [0, 1]
until the weights meet a target: an entropy (as a part of the largest, log of the number of sources)
or a limit on how often a source repeats. The weights become integer epochs over each source plus a
budgeted prefix of a seeded permutation of its blocks, and of documents within the block that the
budget cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, beside, column, occurrences, row_keys, whole, written

#: Steps of the bisection that one pass over the sources settles: 2**STEPS candidates.
STEPS, PASSES = 6, 4
BLOCK_TOKENS = 65_536
#: A source's permuted blocks are summed in so many ranges (a power of two) before single blocks are.
GROUP_BITS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _candidates(shares: DataFrame, low: float, high: float) -> list:
    """For each of the 2**STEPS + 1 exponents between low and high: entropy and repetition of the weights."""
    n = 1 << STEPS
    grid = F.explode(F.array(*[F.lit(low + (high - low) * i / n) for i in range(n + 1)])).alias("alpha")
    # r = tokens / largest: its power needs no normalising to stay in (0, 1]
    z = shares.select("r", grid).withColumn("w", F.pow("r", "alpha")).groupBy("alpha")
    z = z.agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.count(F.lit(1)).alias("k"), F.max(F.col("w") / F.col("r")).alias("most"), F.min(F.col("w") / F.col("r")).alias("least"))
    return sorted(z.select("alpha", (F.log("z") - F.col("wl") / F.col("z")).alias("entropy"), F.log("k").alias("top"), (F.col("most") / F.col("least")).alias("repeats")).collect(), key=lambda x: x["alpha"])


def exponent(tokens: DataFrame, max_repeats: float | None = None, entropy: float | None = None) -> float:
    """The smallest alpha in [0, 1] whose weights repeat no source over max_repeats, or the largest whose entropy is at least that part of the greatest. Fixed number of rows to the driver."""
    shares = tokens.where("tokens > 0").select((F.col("tokens") / F.max("tokens").over(W.partitionBy())).alias("r"))
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        found = _candidates(shares, low, high)
        if not found:
            return 1.0
        if max_repeats is not None:  # repeats fall as alpha grows; the first that meets the limit
            k = next((i for i, x in enumerate(found) if x["repeats"] <= max_repeats), len(found) - 1)
            if k == 0:
                return found[0]["alpha"]
            low, high = found[k - 1]["alpha"], found[k]["alpha"]
        else:  # entropy falls as alpha grows; the last that still has it
            k = max((i for i, x in enumerate(found) if x["entropy"] >= (entropy or 0) * x["top"]), default=0)
            if k == len(found) - 1:
                return found[-1]["alpha"]
            low, high = found[k]["alpha"], found[k + 1]["alpha"]
    return high if max_repeats is not None else low


def _mixed(docs: DataFrame, max_repeats: float | None, entropy: float | None, budget: int | None, seed: int, id_col: str, text_col: str, source_col: str, block_tokens: int) -> DataFrame:
    """row (docs' columns as a struct) with n, weight, epoch, block and rank."""
    source, text = column(source_col), F.coalesce(column(text_col), F.lit(""))
    by = F.struct(source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))
    d = docs.select(whole(docs).alias("row"), by.alias("s"), word_count(text).alias("n"), *row_keys(docs, seed))
    d = occurrences(d)
    sources = written(d.groupBy("s").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    alpha = exponent(sources, max_repeats, entropy)
    top = W.partitionBy()
    w = sources.withColumn("w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double") / F.max("tokens").over(top), F.lit(alpha))).otherwise(0.0))
    w = w.withColumn("weight", F.when(F.sum("w").over(top) > 0, F.col("w") / F.sum("w").over(top)).otherwise(0.0))
    least = F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))).over(top)
    share = F.col("weight") * (least if budget is None else F.lit(float(budget)))
    # a share that is a whole number of epochs but for rounding counts as whole
    epochs = F.when(F.col("tokens") > 0, share / F.col("tokens")).otherwise(F.lit(1.0))
    w = w.withColumn("epochs", epochs).withColumn("full", F.floor(F.col("epochs") + 1e-9).cast("int"))
    w = w.withColumn("rest", F.when(F.col("epochs") - F.col("full") > 1e-9, F.floor((F.col("epochs") - F.col("full")) * F.col("tokens"))).otherwise(0).cast("long"))
    plan = written(w.select("s", "weight", "full", "rest", F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("rows") / block_tokens), F.lit(1)).alias("n_blocks")))
    rank = F.xxhash64(F.lit(seed + 1), "k1", "k2", "occ")
    placed = d.join(plan, "s").withColumn("rank", rank).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "occ"), "n_blocks").cast("int"))
    # blocks of the epoch that the budget cuts, in permuted order; ranges of that order are summed first, so no task orders all blocks of a source
    key = F.xxhash64(F.lit(seed), "s", "block", "full")
    blocks = placed.groupBy("s", "block", "full", "rest").agg(F.sum("n").alias("in_block")).withColumn("key", key).withColumn("group", F.shiftright("key", 64 - GROUP_BITS))
    blocks = written(blocks)
    upto = lambda x, w_: F.sum(x).over(w_.rowsBetween(W.unboundedPreceding, W.currentRow))
    groups = blocks.groupBy("s", "group").agg(F.sum("in_block").alias("in_group"))
    groups = written(groups.select("s", "group", (upto("in_group", W.partitionBy("s").orderBy("group")) - F.col("in_group")).alias("ahead")))
    before = F.col("ahead") + upto("in_block", W.partitionBy("s", "group").orderBy("key", "block")) - F.col("in_block")
    cut = written(blocks.join(groups, ["s", "group"]).withColumn("before", before).where("rest > 0 and before <= rest").select("s", "block", "before", "in_block", "rest"))
    inside = placed.drop("rest").join(cut.where("before + in_block > rest").select("s", "block", "before", "rest"), ["s", "block"]).select("s", "block", "rid", "n", "rest", "before", "rank", "k1", "k2", "occ")
    partly = inside.withColumn("upto", upto("n", W.partitionBy("s", "block").orderBy("rank", "k1", "k2", "occ"))).where(F.col("before") + F.col("upto") <= F.col("rest")).select("rid", F.lit(True).alias("partly"))
    entire = cut.where("before + in_block <= rest").select("s", "block", F.lit(True).alias("entire"))
    times = placed.join(entire, ["s", "block"], "left").join(partly, "rid", "left").withColumn("times", F.col("full") + F.coalesce(F.col("entire"), F.col("partly"), F.lit(False)).cast("int")).where("times > 0")
    return times.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).select("row", "n", "weight", "epoch", "block", F.struct(F.xxhash64(F.lit(seed), "s", "block", "epoch").alias("block_key"), F.col("rank").alias("row_key")).alias("rank"))


def mix(
    docs: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """A row for each time that a row of docs stands in the mix: its columns, then _tokens, _weight, _epoch, _block, _rank.

    budget: tokens of the mix; None: the least in which every source stands in full once, so nothing
    is lost. Tokens are white-space words. Null, empty and blank texts have none and cost nothing: they
    stand as often as the block they are dealt to, and once where their source has no tokens at all.
    Null is a source of its own, null ids are ids. Repeated rows count each and are dealt apart. A text
    is never cut, however long; the cut stops before the one that would pass the budget. A column of
    docs with one of the five names gives way to it. An empty table gives an empty result. Equal ranks
    are ordered by the rows' hashes. _rank orders the mix within an epoch of a source. The result is a
    function of the rows and parameters alone.
    """
    d = _mixed(docs, max_repeats, entropy, budget, seed, id_col, text_col, source_col, block_tokens)
    kept = [F.col("row")[c].alias(c) for c in beside(docs, "_tokens", "_weight", "_epoch", "_block", "_rank")]
    return d.select(*kept, F.col("n").alias("_tokens"), F.col("weight").alias("_weight"), F.col("epoch").alias("_epoch"), F.col("block").alias("_block"), F.col("rank").alias("_rank"))


def mixed_rows(docs: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """mix with docs' own columns alone, whatever their names."""
    return _mixed(docs, max_repeats, entropy, budget, seed, id_col, text_col, source_col, block_tokens).select("row.*")
