"""Counts of 64-bit keys over all data, exchanged as packed blocks instead of a row for each key.

Rows are gathered into chunks of bounded size. A chunk asks for its distinct keys, sorted and
delta-coded, one block for each range of the key space; Spark shuffles blocks by range; a range sums
the counts of all chunks and answers each chunk with totals in the order asked. Keys are hashes, so
ranges are even, and a key that is in every row comes once from each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

REQUEST = "kind int, part int, chunk string, keys binary, counts binary, checks binary"
TOTALS = "chunk string, kind int, part int, totals binary, n_keys long, n_all long, clashes long"
_REQUEST = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()), ("checks", pa.binary())])
_TOTALS = pa.schema([("chunk", pa.string()), ("kind", pa.int32()), ("part", pa.int32()), ("totals", pa.binary()), ("n_keys", pa.int64()), ("n_all", pa.int64()), ("clashes", pa.int64())])


def planes(a: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, then the next, ...; compressed where there are enough of them, with a first byte that says so."""
    b = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return b"z" + zstandard.ZstdCompressor(level=1).compress(b) if len(a) > 32 else b"p" + b


def unplaned(b: bytes, width: int) -> np.ndarray:
    b = zstandard.ZstdDecompressor().decompress(b[1:]) if b[:1] == b"z" else b[1:]
    wide = np.zeros((len(b) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return wide.view("<u8").ravel()


def _width(a: np.ndarray) -> int:
    return max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1


def pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys: width, first key, differences of that many bytes."""
    if not len(keys):
        return b""
    d = np.diff(keys)
    width = _width(d)
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + planes(d, width)


def unpack(block: bytes) -> np.ndarray:
    if not block:
        return np.empty(0, np.uint64)
    first = np.array([int.from_bytes(block[1:9], "little")], np.uint64)
    return np.cumsum(np.concatenate([first, unplaned(block[9:], block[0])]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of up to 64 bits."""
    width = _width(counts)
    return bytes([width]) + planes(counts, width)


def unpack_counts(block: bytes) -> np.ndarray:
    return unplaned(block[1:], block[0]).astype(np.int64)


def requests(kind: int, chunk: str, keys: np.ndarray, counts: np.ndarray, n_parts: int, checks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct sorted keys and their counts in it, cut into ranges; the work follows the keys, not the ranges.

    checks: 16 further bits of what each key stands for, so that keys that meet can be told apart.
    """
    part = ((keys >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1))) if len(keys) else []
    cuts = [*starts, len(keys)]
    cut = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    n = len(cut)
    columns = [[kind] * n, [int(part[a]) for a, _ in cut], [chunk] * n, [pack(keys[a:b]) for a, b in cut], [pack_counts(counts[a:b]) for a, b in cut], [None if checks is None else checks[a:b].astype("<u2").tobytes() for a, b in cut]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _REQUEST.types, strict=True)], schema=_REQUEST)


def _merged(table: pa.Table) -> pa.Table:
    """A range's totals for each chunk, and a row without totals: how many keys have a count, the counts' sum, keys that stand for two things."""
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    keys = [unpack(x.as_py()) for x in table["keys"]]
    counts = np.concatenate([unpack_counts(x.as_py()) for x in table["counts"]])
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, at, counts)
    each = np.split(sums[at], np.cumsum([len(k) for k in keys])[:-1])
    clashes = 0
    if table["checks"].null_count == 0:
        checks = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table["checks"]])
        clashes = int((checks[first][at] != checks).sum())
    n = len(keys)
    # the last row has a name of its own, so that no group gathers those of all ranges
    columns = [[*table["chunk"].to_pylist(), f"range-{kind}-{part}"], [kind] * (n + 1), [part] * (n + 1), [*map(pack_counts, each), None], [0] * n + [int((sums > 0).sum())], [0] * n + [int(sums.sum())], [0] * n + [clashes]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _TOTALS.types, strict=True)], schema=_TOTALS)


def totals(asked: DataFrame) -> DataFrame:
    """TOTALS for the rows of REQUEST."""
    return asked.groupBy("kind", "part").applyInArrow(_merged, TOTALS)


def answered(replies: pa.Table, kind: int, n: int) -> np.ndarray:
    """A chunk's totals of a kind, in the order of its sorted keys; n: how many it asked for."""
    rows = sorted((r["part"], r["totals"]) for r in replies.to_pylist() if r["kind"] == kind)
    found = np.concatenate([unpack_counts(b) for _, b in rows]) if rows else np.empty(0, np.int64)
    if len(found) != n:
        raise RuntimeError("the input changed between two readings; write or checkpoint it first")
    return found
