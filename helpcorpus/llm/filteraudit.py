"""How five quality filters interact, over a sparse document-term matrix.

Texts are cut into chunks. A chunk becomes a shard of compressed sparse rows over its own words; the
words of all chunks are ranked to one global dictionary, and shards are rewritten to its numbers.
Only a chunk's distinct words are shuffled. Row sums are a text's words, stored cells its distinct
words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, ranked, written

#: A chunk ends with the text that brings it to so many bytes or rows.
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 1 << 16
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _shards(schema, chunk_bytes: int, chunk_rows: int):
    """Batches of (row, text) to one row a chunk: rows, indptr, indices, data and the chunk's words in the order of their numbers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def fresh():
            return [], {}, [0], [], [], 0

        def flush():
            rows = pa.concat_arrays(kept)
            one = lambda x, t: pa.array([x], pa.list_(t))
            cols = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), one(indptr, pa.int64()), one(indices, pa.int32()), one(data, pa.int64()), one(list(words), pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["rows", "indptr", "indices", "data", "words"])

        kept, words, indptr, indices, data, size = fresh()
        for b in batches:
            row, begin = b.column("row"), 0
            for i, text in enumerate(b.column("text")):
                text = text.as_py() or b""
                counts = Counter(text.split())
                indices.extend([words.setdefault(w, len(words)) for w in counts])
                data.extend(counts.values())
                indptr.append(len(indices))
                size += len(text)
                if size >= chunk_bytes or len(indptr) > chunk_rows:
                    kept.append(row.slice(begin, i + 1 - begin))
                    yield flush()
                    kept, words, indptr, indices, data, size = fresh()
                    begin = i + 1
            if begin < len(row):
                kept.append(row.slice(begin))
        if kept:
            yield flush()

    return run


def term_matrix(docs: DataFrame, row: Column, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(word, term): every distinct word (ASCII white space parts words, case counts) with its rank from 0 in
    byte order; and (chunk, rows, indptr, indices, data): the shards, whose row k has the cells
    indptr[k] to indptr[k + 1], with terms in `indices` and counts in `data`.

    `row` is a struct that the shards keep for each document. A null text is an empty row, an empty
    table has no shards. A shard is as large as `chunk_bytes` of text or one text that is longer.
    """
    d = docs.select(row.alias("row"), column(text_col).cast("binary").alias("text"))
    kind = d.schema["row"].dataType.simpleString()
    local = d.mapInArrow(_shards(d.schema, chunk_bytes, chunk_rows), f"rows array<{kind}>, indptr array<bigint>, indices array<int>, data array<bigint>, words array<binary>")
    local = written(local.withColumn("chunk", F.monotonically_increasing_id()))
    words = local.select("chunk", F.posexplode("words").alias("at", "word"))
    dictionary = ranked(words.select("word").distinct(), ["word"], name="term")
    numbers = words.join(dictionary, "word").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("terms"))
    numbers = numbers.select("chunk", F.col("terms.term").alias("terms"))
    shards = local.drop("words").join(numbers, "chunk", "left")  # a chunk of empty texts has no words
    return dictionary, shards.select("chunk", "rows", "indptr", F.transform("indices", lambda i: F.get("terms", i)).alias("indices"), "data")


def row_statistics(shards: DataFrame) -> DataFrame:
    """(row, n_words, n_distinct): row sums and numbers of stored cells of every row of the shards."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                rows, indptr, data = (b.column(c)[k].values for c in ("rows", "indptr", "data"))
                ptr = indptr.to_numpy(zero_copy_only=False)
                total = np.concatenate([[0], np.cumsum(data.to_numpy(zero_copy_only=False), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([rows, pa.array(total[ptr[1:]] - total[ptr[:-1]]), pa.array(np.diff(ptr))], ["row", "n_words", "n_distinct"])

    kind = shards.schema["rows"].dataType.elementType.simpleString()
    # a stored cell is one term of the global dictionary, so numbers of cells are numbers of distinct words
    return shards.select("rows", "indptr", "data").mapInArrow(run, f"row {kind}, n_words bigint, n_distinct bigint")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **sizes: int) -> DataFrame:
    """(doc_id, part, n_words, n_distinct, fails): a row for each document; bit 0 of fails is filter A, bit 4 filter E.

    A: under 200 words. B: under half of them distinct. C: over 3 % capitals A-Z among code points.
    D: has any of #$%&*|. E: a smaller id has the same text. A null text is empty; a null id is no
    smaller id, nor has it one; rows of one id and text are not smaller than each other.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    n = F.length(text)
    capitals = n - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    row = F.struct(
        column(id_col).cast("long").alias("doc_id"), F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"),
        (100 * capitals.cast("long") > 3 * n.cast("long")).alias("c"), text.rlike("[#$%&*|]").alias("d"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    d = row_statistics(term_matrix(docs, row, text_col, **sizes)[1]).select("row.*", "n_words", "n_distinct")
    d = written(d)
    # a row's id is the least of its text, or a smaller one has it; by both columns, so copies of one text are spread
    least = d.groupBy("key").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("least", F.lit(True))
    d = d.join(least, ["key", "doc_id"], "left")
    failed = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), F.col("c"), F.col("d"), F.col("doc_id").isNotNull() & F.col("least").isNull()]
    fails = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return d.select("doc_id", "part", "n_words", "n_distinct", fails.cast("int").alias("fails"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **sizes: int) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, for each value of part_col.

    part, filter_order, step, then counts of documents: kept after the step; removed in it; redundant,
    failing its filter but removed before; unique_fails, failing no other; good_lost and toxic_lost,
    removed in it with label quality 1 and toxic 1 (any row of labels of that id); shapley, removed by
    its filter, summed over all orders.

    See `failures` for the filters and for nulls. A null part counts as the empty one. An empty table has no
    parts and so no rows. Repeated rows count as often as they stand there. Other columns are not read.
    """
    d = failures(docs, id_col, text_col, part_col, **sizes)
    is_ = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_("quality").alias("good"), is_("toxic").alias("toxic"))
    d = d.join(marks, "doc_id", "left").groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    # at most 32 patterns of failures a part
    d = d.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("seen"))
    d = d.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, instr('{FILTERS}', {{}}) - 1)"
    d = d.withColumn("own", F.expr(bit.format("substr(filter_order, step, 1)")))
    d = d.withColumn("before", F.expr(f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (a, x) -> a | {bit.format('x')})"))
    total = lambda of, where: F.aggregate(F.filter("seen", where), F.lit(0).cast("long"), lambda a, x: a + of(x))
    has = lambda x, mask: x["fails"].bitwiseAND(F.col(mask)) != 0
    here = lambda x: has(x, "own") & ~has(x, "before")
    n = lambda x: x["n"]
    return d.select(
        "part", "filter_order", "step", total(n, lambda x: ~has(x, "own") & ~has(x, "before")).alias("kept"), total(n, here).alias("removed"),
        total(n, lambda x: has(x, "own") & has(x, "before")).alias("redundant"), total(n, lambda x: x["fails"] == F.col("own")).alias("unique_fails"),
        total(lambda x: x["good"], here).alias("good_lost"), total(lambda x: x["toxic"], here).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in an equal share of the orders
        total(lambda x: x["n"] * (F.lit(len(ORDERS)) / F.bit_count(x["fails"])).cast("long"), lambda x: has(x, "own")).alias("shapley"),
    )
