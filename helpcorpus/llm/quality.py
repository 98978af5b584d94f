"""Quality by weak labels.

Overlapping heuristic labellers vote on a text: too many decorated words, bars, capitals, repeated
words or lines, digits, or too few words. Expectation-maximisation, begun from the mean vote, estimates
how accurate each is, the annotation among them, and which of them err together. The posterior labels
train a linear scorer on hashed features: the text's words and the bins of its statistics, so that it
also learns words that go with bad text and no labeller knows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_text, stable
from .weak import label_model, sparse_logistic

#: Bound of the labelled rows that the scorer is fitted on; dimensions of its hashed features; its ridge, that with the least
#: log loss on fold 1 when folds 2 to 4 of sf0.1 are learned from.
LABELLED, DIMENSIONS, RIDGE = 12_000, 1 << 14, 0.1
FOLDS, HELD = 5, 0
MEMO = 400_000
PLAIN_ENDS = set(".,;:?!'\")]}»”’")
#: Statistics of a text, as parts of its words or lines, and each one's bounds of "surely bad" and "surely good".
BOUNDS = {"decorated": (0.3, 0.02), "bars": (0.1, 0.005), "capitals": (0.5, 0.1), "repeated": (0.5, 0.1), "runs": (0.3, 0.02), "lines": (0.3, 0.02), "digits": (0.3, 0.05), "doubled": (0.3, 0.02)}


def _hash(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % DIMENSIONS


class Texts:
    """Statistics and hashed features of texts, with a memo of words."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[tuple[int, ...] | None, int]] = {}

    def _look(self, w: str) -> tuple[tuple[int, ...] | None, int]:
        letters = [c for c in w if c.isalpha()]
        core = w.rstrip("!?.,;:")
        marks = (int(not w[-1].isalnum() and w[-1] not in PLAIN_ENDS), int(set(w) == {"|"}), int(len(letters) > 1 and all(c.isupper() for c in letters)), int(sum(c.isdigit() for c in w) * 2 > len(w)), int(len(w) - len(core) > 1))
        self.memo[w] = found = (marks if any(marks) else None, _hash(f"word:{w.lower()}"))
        return found

    def described(self, text: str) -> tuple[dict[str, float], list[int], list[int]]:
        """Statistics, sorted indices of their bins, sorted indices of the words."""
        words = text.split()
        n = len(words)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, sums, at = self.memo, [0, 0, 0, 0, 0], set()
        seen = Counter(words)
        for w, k in seen.items():
            marks, i = memo.get(w) or self._look(w)
            at.add(i)
            if marks:
                for j, v in enumerate(marks):
                    sums[j] += v * k
        lines = [x for x in text.split("\n") if x.strip()]
        runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
        top, n_or_1 = max(seen.values()) if n > 20 else 0, max(n, 1)
        stats = {"decorated": sums[0] / n_or_1, "bars": sums[1] / n_or_1, "capitals": sums[2] / n_or_1, "digits": sums[3] / n_or_1, "doubled": sums[4] / n_or_1, "repeated": top / n_or_1, "runs": runs / n_or_1, "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0, "words": n}
        # bins of sixteenths of a statistic's root, and of log2 of the length
        bins = {_hash(f"{k}:{math.ceil(16 * math.sqrt(stats[k]))}") for k in BOUNDS} | {_hash(f"words:{int(math.log2(n + 1))}")}
        return stats, sorted(bins), sorted(at - bins)


def votes(s: dict[str, float]) -> list[int]:
    """1: bad, -1: good, 0: abstains; a labeller for each bounded statistic, one for length, one for all."""
    v = [1 if s[k] >= bad else -1 if s[k] <= good else 0 for k, (bad, good) in BOUNDS.items()]
    return [*v, 1 if s["words"] < 3 else 0, -1 if all(x == -1 for x in v) else 0]


def mean_vote(v: np.ndarray) -> np.ndarray:
    """Where expectation-maximisation begins: the share of bad votes among those that do not abstain, drawn towards a half."""
    return (0.5 + (v > 0).sum(axis=1)) / (1 + (v != 0).sum(axis=1))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = Texts()
    for b in batches:
        d = [texts.described(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["bad"], pa.array([votes(x[0]) for x in d], pa.list_(pa.int32())), pa.array([x[1] for x in d], pa.list_(pa.int32())), pa.array([x[2] for x in d], pa.list_(pa.int32()))], ["bad", "votes", "bins", "words"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """The scorer's weights by hashed feature and its bias. The annotation is one voter among the others."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") < 1).cast("int").alias("bad")).where("doc_id is not null and bad is not null")
    known = known.where(crc_text(F.col("doc_id")) % FOLDS != HELD).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # at most `labelled` rows of two numbers: small enough to broadcast at any scale; of rows that repeat an id one is learned from
    sample = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("bad").alias("bad"))
    t = sample.select("text", "bad").mapInArrow(_described, "bad int, votes array<int>, bins array<int>, words array<int>").toArrow()
    bins, words = ([np.array(x, np.int64) for x in t[c].to_pylist()] for c in ("bins", "words"))
    rows = [(np.concatenate([b, w]), np.append(np.ones(len(b)), np.full(len(w), 1 / math.sqrt(max(len(w), 1))))) for b, w in zip(bins, words, strict=True)]
    v = np.array([[*x, 2 * bad - 1] for x, bad in zip(t["votes"].to_pylist(), t["bad"].to_pylist(), strict=True)]) if rows else np.zeros((0, len(BOUNDS) + 3))
    post, _, _ = label_model(v, mean_vote(v))
    return sparse_logistic(rows, DIMENSIONS, post, ridge)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher is better), predicted (1 where score >= 0.5), kept.

    Learns from at most `labelled` rows of labels whose crc32 of the id as text is not 0 modulo 5, and
    one text for each; ids that tie in hash are taken by id. Null text counts as empty; texts without
    words have no parts of anything and the length 0. A very long text is described whole; its words
    weigh one over the root of their number. Repeated rows are scored each; a score of just 0.5 is
    kept. Without labels every score is that of the bias. An empty table gives an empty result. Other
    columns of docs are not read, so none clashes.
    """
    d = stable(docs, id_col, text_col)
    weights, bias = fit(d, labels, labelled)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, by = Texts(), weights.tolist()
        for b in batches:
            scores = []
            for t in b["text"].to_pylist():
                _, bins, words = texts.described(t)
                z = bias + sum([by[i] for i in bins]) + sum([by[i] for i in words]) / math.sqrt(max(len(words), 1))
                scores.append(1 / (1 + math.exp(max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64())], schema=schema)

    scored = d.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_text(F.col("doc_id")) % FOLDS == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))
