"""Language-model scores by deleted interpolation.

Unigram and bigram maximum-likelihood estimates and a uniform one are mixed with weights that depend
on how often the context was seen (a bucket for each power of two). The weights are learned by
expectation-maximisation on held-out counts: each training token is left out of the counts once and
predicted from the rest. Counts come from all training documents; they are exchanged as packed blocks
(see packed.py), so no task holds more than a chunk of documents or a range of the key space.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import bucketed, crc_of, stable, tokens, written

#: Folds of crc32(id); documents of fold HELD are not learned from.
FOLDS, HELD = 7, 2
#: A chunk ends with the text that brings it to so many characters or rows.
CHUNK_BYTES, CHUNK_DOCS = 8 << 20, 1 << 16
UNIGRAM, BIGRAM = 0, 1
END = b""
#: Bins of an octave of an estimate, for the held-out counts that expectation-maximisation sees.
BINS = 4
NONE = -10_000

_CHUNK = "chunk string, doc_id array<long>, held array<boolean>, lens array<long>, ids binary, ranks binary, vocab binary, checks binary, clashes long"
_RESOLVED = "chunk string, doc_id array<long>, held array<boolean>, lens array<long>, ids binary, words binary, pairs binary, n_keys long, n_all long, clashes long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _chunks(salt: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as ids of words, frequent ones first, and the ids' places in a sorted vocabulary of hashes."""
    part, made, schema = TaskContext.get().partitionId(), 0, _arrow(_CHUNK)
    docs: list[tuple] = []

    def flush() -> pa.RecordBatch:
        nonlocal docs, made
        index: dict[bytes, int] = defaultdict(count().__next__)
        index[END]
        local, lens = [], []
        for _, t in docs:
            w = tokens(t)
            local.extend(map(index.__getitem__, w))
            local.append(0)
            lens.append(len(w) + 1)
        h = np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in index), np.uint64, len(index))
        vocab, first, rank = np.unique(h, return_index=True, return_inverse=True)
        checks = np.fromiter((xxhash.xxh32_intdigest(w, salt) for w in index), np.uint32, len(index))[first].astype("<u2")
        ids, made = rank[np.array(local, np.int64)], made + 1
        ranks = np.argsort(-np.bincount(ids, minlength=len(vocab)), kind="stable")
        order = np.empty_like(ranks)
        order[ranks] = np.arange(len(ranks))
        ids = order[ids]
        doc_id = [i for i, _ in docs]
        out = [f"{part}-{made}", doc_id, [crc_of(i) % FOLDS == HELD for i in doc_id], lens, packed.pack_counts(ids), packed.pack_counts(ranks), packed.pack(vocab), checks.tobytes(), len(h) - len(vocab)]
        docs = []
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, schema.types, strict=True)], schema=schema)

    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            b = batch.slice(at, 500)
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                docs.append((i, t))
                size += len(t)
                if size >= CHUNK_BYTES or len(docs) >= CHUNK_DOCS:
                    yield flush()
                    size = 0
    if docs:
        yield flush()


def _parts(salt: int, row: dict) -> tuple:
    """Ids in the sorted vocabulary, the vocabulary, sorted bigram keys, each token's bigram, whether a token is learned from."""
    ids, lens, vocab = packed.unpack_counts(row["ranks"])[packed.unpack_counts(row["ids"])], np.array(row["lens"]), packed.unpack(row["vocab"])
    end = np.searchsorted(vocab, np.uint64(xxhash.xxh64_intdigest(END, salt)))
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lens) - lens] = end
    code, at = np.unique(before * len(vocab) + ids, return_inverse=True)
    a, b = vocab[code // len(vocab)], vocab[code % len(vocab)]
    key = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    key *= np.uint64(0xC2B2AE3D27D4EB4F)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    keys, rank = np.unique(key, return_inverse=True)
    return ids, vocab, keys, rank[at], np.repeat(~np.array(row["held"], bool), lens)


def _asked(salt: int, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, vocab, keys, pair, learn = _parts(salt, row)
                yield from packed.requests(UNIGRAM, row["chunk"], vocab, np.bincount(ids[learn], minlength=len(vocab)), n_parts, np.frombuffer(row["checks"], "<u2"))
                yield from packed.requests(BIGRAM, row["chunk"], keys, np.bincount(pair[learn], minlength=len(keys)), n_parts)

    return run


def _resolve(salt: int):
    def run(_, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        """A chunk with the corpus counts of its words and of each token's bigram; or a range's sums."""
        schema, out = _arrow(_RESOLVED), []
        for r in replies.to_pylist():
            if r["totals"] is None and r["kind"] == UNIGRAM:
                out.append([None] * 7 + [r["n_keys"], r["n_all"], r["clashes"]])
        for row in chunk.to_pylist():
            _, vocab, keys, pair, _ = _parts(salt, row)
            words, pairs = packed.answered(replies, UNIGRAM, len(vocab)), packed.answered(replies, BIGRAM, len(keys))
            out.append([row["chunk"], row["doc_id"], row["held"], row["lens"], row["ids"], packed.pack_counts(words[packed.unpack_counts(row["ranks"])]), packed.pack_counts(pairs[pair]), 0, 0, row["clashes"]])
        return pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(schema.types)], schema=schema)

    return run


def _counted(row: dict) -> tuple:
    """For each token: counts of its word, of its context and of both; the ids; whether it is learned from."""
    ids, lens, words, pairs = packed.unpack_counts(row["ids"]), np.array(row["lens"]), packed.unpack_counts(row["words"]), packed.unpack_counts(row["pairs"])
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    starts = np.cumsum(lens) - lens
    before[starts] = ids[-1]  # a chunk ends with an end, as the text before any text does
    return words[ids], words[before], pairs, starts, np.repeat(~np.array(row["held"], bool), lens)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of its count's log2."""
    return np.where(context > 0, np.frexp(context.astype(float))[1], 0)


def _binned(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.floor(np.log2(np.maximum(p, 1e-300)) * BINS), NONE).astype(np.int64)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, at, np.concatenate(counts))
    return distinct, sums


def _held_out(n_all: int):
    """Counts of left-out tokens by bucket and binned estimates; a cell is one number while it is counted."""
    schema, bits = _arrow("bucket long, two long, one long, n long"), 20
    zero = 1 << (bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b in batches:
            for row in b.to_pylist():
                word, context, both, _, learn = _counted(row)
                w, c, p = word[learn] - 1, context[learn] - 1, both[learn] - 1
                code = (bucket(c).astype(np.int64) << 2 * bits) + ((_binned(p / np.maximum(c, 1)) + zero) << bits) + _binned(w / max(n_all - 1, 1)) + zero
                found, n = np.unique(code, return_counts=True)
                codes.append(found)
                counts.append(n)
            codes, counts = ([x] for x in _summed(codes, counts))
        code, n = codes[0], counts[0]
        mask = (1 << bits) - 1
        cells = [code >> 2 * bits, ((code >> bits) & mask) - zero, (code & mask) - zero, n]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cells], schema=schema)

    return run


def learned_weights(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights by bucket of the uniform, unigram and bigram estimate, by expectation-maximisation.

    cells: bucket, binned bigram and unigram estimate, number of left-out tokens. A bucket without
    tokens takes the weights of the nearest lower one that has some.
    """
    weights = np.tile([0.1, 0.9, 0.0], (80, 1))
    value = lambda x: np.where(x == NONE, 0.0, np.exp2((x + 0.5) / BINS))
    by: dict[int, list] = defaultdict(list)
    for b, two, one, n in cells:
        by[b].append((two, one, n))
    last = weights[0]
    for b in range(80):
        if b in by:
            two, one, n = np.array(by[b]).T
            f = np.stack([np.full(len(n), uniform), value(one), value(two)])
            lam = np.full(3, 1 / 3)
            for _ in range(rounds):
                post = lam[:, None] * f
                post = post / post.sum(axis=0) * n
                lam = np.maximum(post.sum(axis=1) / n.sum(), [1e-6, 1e-6, 0.0])
                lam /= lam.sum()
            last = lam
        weights[b] = last
    return weights


def _scored(weights: np.ndarray, n_keys: int, n_all: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                word, context, both, starts, _ = _counted(row)
                lam = weights[bucket(context)]
                p = lam[:, 0] / (n_keys + 1) + lam[:, 1] * word / max(n_all, 1) + lam[:, 2] * both / np.maximum(context, 1)
                base = np.log10((word + 1) / (n_all + n_keys + 1))
                cols = [row["doc_id"], row["held"], row["lens"], np.add.reduceat((word > 0).astype(np.int64), starts), [n_all] * len(starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased (A-Z) words and one end for each text; null text counts as empty and has
    the end alone. Documents of fold 2 of 7 by crc32 of the id as text are not learned from; a null
    id has the crc of the empty text. score is the model's log10 probability of the text, base_score
    that of unigrams with one added to each count. Repeated rows are learned from and scored each.
    With nothing to learn from every word is unknown. A very long text is one part of a chunk, whole.
    An empty table gives an empty result. Other columns of docs are not read, so none clashes.

    Words are told apart by 64 bits of hash. That no key stands for two words is checked over all
    words with 16 further bits, and another salt is taken where one does. Bigrams have 64-bit keys.
    """
    spark = docs.sparkSession
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    d = stable(docs, id_col, text_col)
    for salt in range(8):
        # laid out by chunk once, so that counts come to chunks and no chunk is shuffled
        chunks = bucketed(d.mapInArrow(partial(_chunks, salt), _CHUNK), "chunk", "snappy")
        n_tokens = chunks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0]
        if n_tokens is None:
            return spark.createDataFrame([], out)
        # a range holds some two million bigrams
        n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_tokens / 2_000_000))
        replies = packed.totals(chunks.mapInArrow(_asked(salt, n_parts), packed.REQUEST))
        table = written(chunks.drop("checks").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_resolve(salt), _RESOLVED), "snappy")
        n_keys, n_all, clashes = table.agg(F.sum("n_keys"), F.sum("n_all"), F.sum("clashes")).first()
        if not clashes:
            break
    else:
        raise RuntimeError("eight salts in turn gave one key to two words")
    table = table.where(F.col("chunk").isNotNull())
    cells = table.mapInArrow(_held_out(n_all), "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    weights = learned_weights([tuple(c) for c in cells], 1 / (n_keys + 1))
    return table.mapInArrow(_scored(weights, n_keys, n_all, _arrow(out)), out)
