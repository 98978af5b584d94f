"""N-gram Jaccard join: a blocked sparse product of documents by n-grams with size-derived bounds.

Documents with one set of n-grams are one class. The incidence of classes by n-grams is cut down by
bounds that follow from the sizes alone, before any pair is made:

1. In the order of hashes, two linked sets of sizes n and m share as many of their first n-grams as
   they may miss plus one; classes with too few shared n-grams there link with nothing.
2. What is left is ordered by document frequency. Only the columns of n-grams that stand in the first
   n - ceil(t n) + 1 places of a class can hold the first n-gram that a linked pair shares, and an
   entry at place i bounds the overlap by n - i.
3. A column's entries are multiplied with its hub, the entry with the fewest rarer n-grams. Classes
   linked with one hub need no product of their own: only components are asked for. Then the entries
   of a column that are not in its hub's component are multiplied with those of other components.

The product of two classes is accumulated over blocks of columns (ranges of the n-grams' hashes): a
block adds the overlap in it, and a pair is discarded as soon as what it has, with the least of the
two sizes in each block to come, falls short of the overlap that its sizes ask for.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import column, stable, tokens, whole, written
from .components import components

CHUNK_KEYS, CHUNK_DOCS = 500_000, 20_000
#: Blocks of columns over which a product is accumulated.
BLOCKS = 8
CHUNK = "chunk string, key array<long>, key2 array<long>, doc_id array<long>, cls array<binary>, n array<long>, lens array<long>, sets binary"
_LONGS = pa.list_(pa.int64())
_CHUNK = pa.schema([("chunk", pa.string()), ("key", _LONGS), ("key2", _LONGS), ("doc_id", _LONGS), ("cls", pa.list_(pa.binary())), ("n", _LONGS), ("lens", _LONGS), ("sets", pa.binary())])


def least_shared(n: int, percent: int) -> int:
    """The fewest n-grams that a set of n shares with any linked set."""
    return -(-percent * n // 100)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; the whole sequence where it has fewer words."""
    index: dict[bytes, int] = defaultdict(count().__next__)
    local, ends = [], []
    for t in texts:
        local.extend(map(index.__getitem__, tokens(t)))
        ends.append(len(local))
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
    words = h[np.array(local, np.int64)] if local else np.empty(0, np.uint64)

    def mixed(columns: list[np.ndarray]) -> np.ndarray:
        acc = np.full(len(columns[0]), len(columns), np.uint64)
        for c in columns:
            acc = (acc ^ c) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        return acc ^ (acc >> np.uint64(32))

    n = len(words) - k + 1
    grams = mixed([words[i : i + n] for i in range(k)]) if n > 0 else np.empty(0, np.uint64)
    out, a = [], 0
    for b in ends:
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mixed([words[i : i + 1] for i in range(a, b)]))
        else:
            out.append(np.empty(0, np.uint64))
        a = b
    return out


def _chunked(k: int, percent: int, prefix: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal rows, made
            cols = list(zip(*rows, strict=True))
            made += 1
            sets = np.concatenate(cols[5]).tobytes()
            out = [[f"{part}-{made}"], *[[list(c)] for c in cols[:5]], [[len(s) for s in cols[5]]], [sets]]
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _CHUNK.types, strict=True)], schema=_CHUNK)

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                for key, key2, doc_id, s in zip(*(b[c].to_pylist() for c in ("key", "key2", "doc_id")), shingle_sets(b["text"].to_pylist(), k), strict=True):
                    n = len(s)
                    cls = xxhash.xxh3_128_digest(s.tobytes()) if n else None
                    first = min(n, 2 * (n - least_shared(n, percent)) + 1) if prefix else n
                    rows.append((key, key2, doc_id, cls, n, s[:first].copy()))
                    held += first
                    if held >= CHUNK_KEYS or len(rows) >= CHUNK_DOCS:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    return run


def _entries(row: dict) -> list[tuple]:
    """key, class, size and n-grams of a chunk's classes, each class once."""
    sets = np.split(np.frombuffer(row["sets"], np.uint64), np.cumsum(row["lens"])[:-1])
    seen: set = set()
    return [(key, c, n, s) for key, c, n, s in zip(row["key"], row["cls"], row["n"], sets, strict=True) if c is not None and not (c in seen or seen.add(c))]


def _asked(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                if e := _entries(row):
                    yield from packed.requests(0, row["chunk"], *np.unique(np.concatenate([x[3] for x in e]), return_counts=True), n_parts)

    return run


def _frequencies(row: dict, replies: pa.Table) -> tuple[list[tuple], list[np.ndarray]]:
    e = _entries(row)
    if not e:
        return [], []
    keys, at = np.unique(np.concatenate([x[3] for x in e]), return_inverse=True)
    df = packed.answered(replies, 0, len(keys))[at]
    return e, np.split(df, np.cumsum([len(x[3]) for x in e])[:-1])


def _survivors(percent: int):
    schema = pa.schema([("key", pa.int64()), ("cls", pa.binary())])

    def run(_, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        found = []
        for row in chunk.to_pylist():
            for (key, cls, n, _), df in zip(*_frequencies(row, replies), strict=True):
                m = least_shared(n, percent)
                if (df > 1).sum() >= m - least_shared(m, percent) + 1:
                    found.append((key, cls))
        return pa.Table.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(schema.types)], schema=schema)

    return run


def _columns(percent: int):
    schema = pa.schema([("gram", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("at", pa.int64())])

    def run(_, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for row in chunk.to_pylist():
            for (_, cls, n, s), df in zip(*_frequencies(row, replies), strict=True):
                order = np.lexsort((s, df))[: n - least_shared(n, percent) + 1]
                at = np.flatnonzero(df[order] > 1)
                out[0].append(s[order[at]].view(np.int64))
                out[1].extend([cls] * len(at))
                out[2].append(np.full(len(at), n))
                out[3].append(at)
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out[0], out[2], out[3])]
        return pa.Table.from_arrays([pa.array(flat[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.int64())], schema=schema)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("grams", pa.binary())])
    for b in batches:
        for row in b.to_pylist():
            e = _entries(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in e], pa.binary()), pa.array([x[2] for x in e], pa.int64()), pa.array([x[3].tobytes() for x in e], pa.binary())], schema=schema)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int, blocks: int = BLOCKS) -> np.ndarray:
    """Whether each pair of sorted sets is linked: the product over blocks of columns, with pairs dropped that cannot reach their bound."""
    edges = np.array([(i << 64) // blocks for i in range(1, blocks)], np.uint64)
    cut = lambda sets: np.array([[0, *np.searchsorted(s, edges), len(s)] for s in sets], np.int64).reshape(-1, blocks + 1)
    at_l, at_r = cut(left), cut(right)
    each = np.minimum(np.diff(at_l, axis=1), np.diff(at_r, axis=1))
    to_come = each.sum(axis=1)
    asked = percent * (at_l[:, -1] + at_r[:, -1])
    have = np.zeros(len(left), np.int64)
    live = np.flatnonzero((100 + percent) * to_come >= asked)
    for k in range(blocks):
        sizes = np.diff(at_l, axis=1)[live, k], np.diff(at_r, axis=1)[live, k]
        grams = [s[i][at[i, k] : at[i, k + 1]] for s, at in ((left, at_l), (right, at_r)) for i in live]
        if grams:
            pair = np.concatenate([np.repeat(np.arange(len(live)), n) for n in sizes])
            gram = np.concatenate(grams)
            order = np.lexsort((gram, pair))
            pair, gram = pair[order], gram[order]
            have[live] += np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (gram[1:] == gram[:-1])], minlength=len(live))
        to_come -= each[:, k]
        live = live[(100 + percent) * (have + to_come)[live] >= asked[live]]
    return (100 + percent) * have >= asked


def _linked(percent: int):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):  # long sets bound what is sorted at once
                b = batch.slice(at, 100)
                left, right = ([np.frombuffer(x.as_buffer(), np.uint64) for x in b[c]] for c in ("grams_a", "grams_b"))
                yield pa.RecordBatch.from_arrays([b["a"], b["b"]], schema=schema).filter(pa.array(overlaps(left, right, percent)))

    return run


def _components(d: DataFrame, k: int, percent: int) -> DataFrame:
    """d(doc_id, key, key2, text) without text, with n and comp: rows with equal comp are linked, null is without shingles."""
    spark = d.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cross = "(100 + {p}) * least(n_a - at_a, n_b - at_b) >= {p} * (n_a + n_b)".format(p=percent)

    def counted(chunks: DataFrame, use, schema: str) -> DataFrame:
        # a range holds some two million keys
        n = max(partitions, math.ceil((chunks.agg(F.sum(F.octet_length("sets"))).first()[0] or 0) / 8 / 2_000_000))
        replies = packed.totals(chunks.mapInArrow(_asked(n), packed.REQUEST)).where(F.col("totals").isNotNull()).select("chunk", "kind", "part", "totals")
        return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(use, schema)

    first = written(d.mapInArrow(_chunked(k, percent, True), CHUNK))
    members = first.select(F.explode(F.arrays_zip("key", "key2", "doc_id", "cls", "n")).alias("x")).select("x.*")
    alive = counted(first, _survivors(percent), "key long, cls binary").groupBy("cls").agg(F.min("key").alias("key"))
    sets = written(d.join(alive.select("key").distinct(), "key", "left_semi").select(*d.columns).mapInArrow(_chunked(k, percent, False), CHUNK), "snappy")
    rows = sets.mapInArrow(_rows, "cls binary, n long, grams binary")
    entries = written(counted(sets, _columns(percent), "gram long, cls binary, n long, at long").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        p = p.join(rows.select(F.col("cls").alias("a"), F.col("grams").alias("grams_a")), "a").join(rows.select(F.col("cls").alias("b"), F.col("grams").alias("grams_b")), "b")
        return p.mapInArrow(_linked(percent), "a binary, b binary")

    hubs = entries.groupBy("gram").agg(F.min(F.struct("at", "n", "cls")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = written(hubs.select("gram", F.col("hub.cls").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.at").alias("at_a")))
    one = entries.select("gram", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    star = written(verified(one.join(hubs, "gram").where("a <> b").where(cross).select("a", "b")))
    comps = components(star)

    def labelled(df: DataFrame, c: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")), c, "left").withColumn(f"comp_{c}", F.coalesce(f"comp_{c}", c))

    here = written(labelled(one, "b").join(labelled(hubs.select("gram", "a"), "a").select("gram", F.col("comp_a").alias("hub")), "gram"))
    left = here.where("comp_b <> hub").select("gram", F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("at_b").alias("at_a"), F.col("comp_b").alias("comp_a"))
    rest = left.join(here, "gram").where("comp_a <> comp_b and (a < b or comp_b = hub)").where(cross).select("a", "b")
    comps = components(star.unionByName(verified(rest)))
    named = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    return written(named.drop("cls"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Sets hold the distinct shingles of k lower-cased (A-Z) words; a text of fewer words is one
    shingle; texts without words, null ones too, have none and link with nothing. Two documents link
    when 100 * intersection >= percent * union (percent over 50). component_id is the least id that
    links reach, nulls aside; a null id without a partner keeps null. Repeated rows are in one
    component. A very long text is one set, whole: its 8 bytes a word have to fit a task. An empty
    table gives an empty result. Other columns of docs are not read, so none clashes.
    """
    d = stable(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("key2", F.lit(0).cast("long"))
    named = _components(d, k, percent)
    # written, so that the join below stands alone and a hot component's rows can be split between tasks
    least = written(named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    return named.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which each component of linked documents keeps one row: that of the least id.

    A null id comes after all others. What decides on a row is its id and text together (128 bits of
    them), so texts that share an id stand for themselves. Of rows with that id and text the one with
    the least hash of all columns stays. Texts without words are all kept. Columns of any name are
    kept as they are. An empty table gives an empty result.
    """
    doc_id, text = column(id_col).cast("long"), F.coalesce(column(text_col), F.lit(""))
    row_key = lambda i: F.xxhash64(F.lit(i), doc_id, text)
    named = _components(docs.select(doc_id.alias("doc_id"), text.alias("text"), row_key(0).alias("key"), row_key(1).alias("key2")), k, percent).where("comp is not null")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key", "key2")
    # written, so that the join below stands alone and a hot component's rows can be split between tasks
    best = written(named.groupBy("comp").agg(F.min(own).alias("best")))
    gone = named.join(best, "comp").where("key <> best.key or key2 <> best.key2").select("key", "key2").distinct()
    same = named.groupBy("key", "key2").count().where("count > 1").select("key", "key2")
    rows = docs.select(whole(docs).alias("row"), row_key(0).alias("key"), row_key(1).alias("key2"))
    kept = rows.join(written(gone), ["key", "key2"], "left_anti")
    same = written(same)
    if same.limit(1).count():
        of_many = kept.join(same, ["key", "key2"], "left_semi").groupBy("key", "key2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(same, ["key", "key2"], "left_anti").select("row").unionByName(of_many.select("row"))
    return kept.select("row.*")
