"""Token counts of whole texts, with the whole-token shortcut.

Before any text is read, the vocabulary is examined: no piece may hold a character before its word
mark, so no merge crosses from a word to the space after it, and the units `marks + rest` of a text
are merged independently. Each vocabulary string that is such a unit is then encoded by itself; those
that come back as one token are the shortcut. Units in the shortcut count one; only the others are
merged, each distinct one once per task as long as the memo, which is bounded by characters, has room.
"""

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable

MARK = "▁"
#: Characters of the distinct units whose counts a task remembers; beyond it the memo is begun anew. A unit longer than LONG is merged each time.
MEMO, LONG = 3_000_000, 200
#: Characters of texts that are cut into units at once.
SLICE = 4_000_000


class PieceUnits:
    """Counts units of a sentencepiece model. A unit is written as in the text, without the space that makes its first mark."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece crosses a word's end; units of this model are not independent")
        words = [p[1:] for p in plain if p.startswith(MARK) and p.strip(MARK)]
        words = [w.replace(MARK, " ") for w in words]
        self.single = {w for w, ids in zip(words, self.sp.encode(words), strict=True) if len(ids) == 1 and self.sp.id_to_piece(ids[0]) == MARK + w.replace(" ", MARK)}
        if MARK not in plain:
            raise ValueError("the word mark alone is no piece")
        self.single.add("")  # one space at a text's end: its mark alone
        self.memo: dict[str, int] = {}
        self.held = 0

    def units(self, text: str) -> list[str]:
        """The text's units: it is read as if one space stood before it."""
        text = text.replace(MARK, " ")
        units = text.split(" ")
        if "" not in units:
            return units
        joined, gap = [], 0
        for u in units[:-1]:
            if u:
                joined.append(" " * gap + u)
                gap = 0
            else:
                gap += 1
        return [*joined, " " * gap + units[-1]] if text else []

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.units(t) for t in texts]
        if self.held > MEMO:
            self.memo.clear()
            self.held = 0
        single, memo = self.single, self.memo
        new = list({u for units in cut for u in units if u not in single and u not in memo})
        memo.update(zip(new, map(len, self.sp.encode(new)), strict=True))
        self.held += sum(map(len, new))
        out = [sum([1 if u in single else memo[u] for u in units]) for units in cut]
        for u in [u for u in new if len(u) > LONG]:
            del memo[u]
            self.held -= len(u)
        return out


def sliced(texts: Iterable[str], most: int = SLICE) -> Iterator[list[str]]:
    """Texts in lists of so many characters, or of one longer text."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


@lru_cache(maxsize=2)
def counter(path: str) -> PieceUnits:
    return PieceUnits(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty, which has no bytes and no tokens; a very long text is counted whole;
    repeated rows are counted each; an empty table gives an empty result. Other columns of docs are
    not read, so none clashes.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model_path)
        for texts in batches:
            yield pd.Series([n for part in sliced(texts) for n in c.counts(part)], dtype="int64")

    n = F.pandas_udf(count, "long")("text")
    d = stable(docs, id_col, text_col)
    return d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
