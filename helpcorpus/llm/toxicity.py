"""Toxicity by weak supervision.

Features of a text are its distinct words, their beginnings, and beginnings that several of its words
share. Those that labelled training documents associate with toxicity are a lexicon; they are dealt to
overlapping lexicon and pattern voters, which vote beside the annotation. A generative model estimates
the voters' accuracies and correlations; its posterior labels train a linear classifier on the
features, which alone scores texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, crc_text, stable
from .weak import label_model, logistic

#: Bound of the labelled rows that the model is fitted on.
LABELLED = 12_000
#: Of the features, those that so many toxic texts have and whose log odds ratio is so many standard errors, the first so many; the classifier's
#: ridge. The last three have the least log loss on fold 1 when folds 2 to 4 of sf0.1 are learned from.
LEAST, SURE, FEATURES, RIDGE = 3, 2.6, 2000, 0.2
FOLDS, HELD = 5, 0
LEXICON_VOTERS = 10
BEGINNINGS = (4, 5, 6, 7)
MEMO = 400_000
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»…–—“”‘’"


def word_features(raw: str) -> tuple[str, ...]:
    """Features that a lower-cased raw word gives a text; p features also count towards q."""
    w = raw.strip(EDGES)
    if not w:
        return ()
    return (f"w{w}", *(f"p{w[:n]}" for n in BEGINNINGS if len(w) > n))


def features(text: str) -> set[str]:
    seen = Counter(f for raw in {w.strip(EDGES) for w in text.lower().split()} for f in word_features(raw))
    return {*seen, *(f"q{f[1:]}" for f, n in seen.items() if n > 1 and f[0] == "p")}


def _associations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
            for f in features(text):
                counts.setdefault(f, [0, 0])[toxic] += 1
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["feature", "pos", "neg"])


def _matches(known: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(known[f] for f in features(t) if f in known) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["toxic"], pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    return run


class Model:
    """A linear classifier: weights of known features and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memo: dict[str, tuple] = {}

    def _look(self, raw: str) -> tuple:
        """A raw word's weighted features, and the beginnings that count when they come twice."""
        fs = word_features(raw)
        once = tuple(f for f in fs if f in self.weights)
        twice = tuple(f"q{f[1:]}" for f in fs if f[0] == "p" and f"q{f[1:]}" in self.weights)
        self.memo[raw] = found = (raw.strip(EDGES), once, twice) if once or twice else ()
        return found

    def scores(self, texts: list[str]) -> list[float]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, look, out = self.memo, self._look, []
        for t in texts:
            hits = set()
            for raw in set(t.lower().split()):
                m = memo.get(raw)
                if m is None:
                    m = look(raw)
                if m:
                    hits.add(m)
            seen, twice = set(), Counter()
            for _, once, two in hits:
                seen.update(once)
                twice.update(two)
            seen.update(f for f, n in twice.items() if n > 1)
            z = self.bias + sum(self.weights[f] for f in sorted(seen))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, least: int = LEAST, sure: float = SURE, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic; nulls and held-out ids are left out; an id that repeats counts as toxic if one of its rows is."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(crc_text(F.col("doc_id")) % FOLDS != HELD).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # at most `labelled` rows of two numbers: small enough to broadcast at any scale; of rows that repeat an id one is learned from
    sample = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).select("text", "toxic")
    assoc = sample.mapInArrow(_associations, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = sample.groupBy("toxic").count().collect()
    pos, neg = (sum(r["count"] for r in totals if r["toxic"] == y) for y in (1, 0))
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (F.lit(n) - F.col(c) + 0.5))
    z = (odds("pos", pos) - odds("neg", neg)) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    top = assoc.where(F.col("pos") >= least).select("feature", z.alias("z"), (F.col("pos") >= 4 * F.col("neg")).alias("mostly")).where(F.col("z") > sure).orderBy(F.desc("z"), "feature").limit(features).collect()
    names = [r["feature"] for r in top]
    rows = sample.mapInArrow(_matches({f: i for i, f in enumerate(names)}), "toxic int, found array<int>").collect()
    x = np.zeros((len(rows), len(names)), np.uint8)
    for i, r in enumerate(rows):
        x[i, r["found"]] = 1
    y = np.array([r["toxic"] for r in rows], int)
    # voters are of features that mostly mean toxic; the classifier weighs all
    mostly = [i for i, r in enumerate(top) if r["mostly"]]
    words = [i for i in mostly if names[i][0] == "w"]
    groups = [words[k::LEXICON_VOTERS] for k in range(LEXICON_VOTERS)]
    # the ties of neighbouring lists overlap, so that their voters do
    groups = [[*g, *groups[k - 1][:2]] for k, g in enumerate(groups)]
    groups += [[i for i in mostly if names[i][0] == kind and len(names[i]) == n + 1] for kind in "pq" for n in BEGINNINGS]
    votes = np.stack([np.where(x[:, g].any(axis=1), 1, 0) if g else np.zeros(len(rows)) for g in groups] + [np.where(x[:, mostly].any(axis=1), 0, -1), 2 * y - 1], axis=1) if rows else np.zeros((0, len(groups) + 2))
    post, _, _ = label_model(votes, np.where(y == 1, 0.9, 0.05))
    w, bias = logistic(x, post, ridge=ridge)
    return Model(dict(zip(names, map(float, w), strict=True)), bias)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, least: int = LEAST, sure: float = SURE, features: int = FEATURES, ridge: float = RIDGE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 where score >= 0.5).

    Learns from at most `labelled` rows of labels whose crc32 of the id as text is not 0 modulo 5, and
    one text for each; ids that tie in hash are taken by id, features that tie by name. Null text
    counts as empty and gets the score of a text without features; a very long text is read whole.
    Repeated rows are scored each; a score of just 0.5 is toxic. Without labels every score is that of
    the bias. An empty table gives an empty result. Other columns of docs are not read, so none clashes.

    The model knows the features that at least `least` toxic texts of those have and whose log odds ratio
    is over `sure` standard errors, of these the `features` strongest (936 qualify on sf0.1); `ridge` is its
    penalty. These bound what is fitted on the bounded sample, not what is scored.
    """
    d = stable(docs, id_col, text_col)
    model = fit(d, labels, labelled, least, sure, features, ridge)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([crc_of(i) % FOLDS == HELD for i in b["doc_id"].to_pylist()], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], schema=schema)

    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, least: int = LEAST, sure: float = SURE, features: int = FEATURES, ridge: float = RIDGE) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not call toxic. Texts are scored where they are read.

    Parameters are those of `toxicity`. A null text is scored as empty and stays, unless the bias alone is toxic; repeated
    rows stay or go together; texts are read whole; an empty table stays empty.
    """
    model = fit(stable(docs, id_col, text_col), labels, labelled, least, sure, features, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(["" if t is None else t for t in b[text_col].to_pylist()])
            yield b.filter(pa.array([v < 0.5 for v in s], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
