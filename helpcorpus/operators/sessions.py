"""Navigation sessions: history, recent documents, bookmarks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import file_name, topic_label

# Depth of a history, number of recent documents.
HISTORY, RECENT = 256, 5


class History:
    """Two bounded stacks around a current location."""

    def __init__(self, current=None, back=(), forward=(), depth: int = HISTORY):
        self.current, self.back, self.forward, self.depth = current, list(back), list(forward), depth

    def apply(self, action: str, location: str | None) -> None:
        if action == "visit" and location != self.current:
            if self.current is not None:
                self.back = [*self.back, self.current][-self.depth :]
            self.current, self.forward = location, []
        elif action == "back" and self.back:
            if self.current is not None:
                self.forward = [*self.forward, self.current][-self.depth :]
            self.current = self.back.pop()
        elif action == "forward" and self.forward:
            if self.current is not None:
                self.back = [*self.back, self.current][-self.depth :]
            self.current = self.forward.pop()


_REPLAY = pa.schema([("usr", pa.int64()), ("event_id", pa.int64()), ("current", pa.string()), ("back_depth", pa.int32()), ("forward_depth", pa.int32())])
_FINAL = pa.schema([("usr", pa.int64()), ("current", pa.string()), ("back", pa.list_(pa.string())), ("forward", pa.list_(pa.string()))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(user, history, events of the batch) over rows sorted by user; one history is held, whatever a user's number of events."""
    user, h = None, History()
    for b in batches:
        for usr, event_id, action, location in zip(*(b[c].to_pylist() for c in ("usr", "event_id", "action", "location")), strict=True):
            if usr != user:
                if user is not None:
                    yield user, h, None
                user, h = usr, History()
            h.apply(action, location)
            yield usr, h, event_id
    if user is not None:
        yield user, h, None


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for usr, h, event_id in _runs(batches):
        if event_id is not None:
            out.append((usr, event_id, h.current, len(h.back), len(h.forward)))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_REPLAY.types)], schema=_REPLAY)
            out = []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_REPLAY.types)], schema=_REPLAY)


def _finals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = [(usr, h.current, list(h.back), list(h.forward)) for usr, h, event_id in _runs(batches) if event_id is None]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_FINAL.types)], schema=_FINAL)


def _by_user(events: DataFrame) -> DataFrame:
    return events.select("usr", "ts", "event_id", "action", "location").repartition("usr").sortWithinPartitions("usr", "ts", "event_id")


def replay_history(events: DataFrame) -> DataFrame:
    """(usr, event_id, current, back_depth, forward_depth) after each event. A user's events are streamed in order; only the two stacks are held. A null user has no history."""
    return _by_user(events.where("usr is not null")).mapInArrow(_replayed, "usr long, event_id long, current string, back_depth int, forward_depth int")


def location_parts(location: Column) -> tuple[Column, Column]:
    """The document and the topic's index of a location `document#index`; without an index, or a wrong one, the first topic."""
    index = F.when(F.instr(location, "#") > 0, F.substring_index(location, "#", -1).try_cast("int"))
    return F.when(index.isNotNull(), F.regexp_replace(location, "#[^#]*$", "")).otherwise(location), F.coalesce(index, F.lit(0))


def history_listing(events: DataFrame, topics: DataFrame) -> DataFrame:
    """(usr, ord, marker, location, label): back from the oldest, the current one, forward from the nearest; a label is `title — file`, and `Topic n` for topics without a title or not known. topics(doc, topic_index, title)"""
    last = _by_user(events.where("usr is not null")).mapInArrow(_finals, "usr long, current string, back array<string>, forward array<string>")
    mark = lambda col, m: F.transform(col, lambda x: F.struct(F.lit(m).alias("marker"), x.alias("location")))
    here = F.when(F.col("current").isNotNull(), F.array(F.struct(F.lit("•").alias("marker"), F.col("current").alias("location")))).otherwise(F.array().cast("array<struct<marker:string,location:string>>"))
    rows = last.select("usr", F.posexplode(F.concat(mark(F.col("back"), "←"), here, mark(F.reverse("forward"), "→"))).alias("ord", "x")).select("usr", "ord", "x.marker", "x.location")
    doc, index = location_parts(F.col("location"))
    d = rows.withColumn("doc", doc).withColumn("topic_index", index).join(topics.select("doc", "topic_index", "title"), ["doc", "topic_index"], "left")
    return d.select("usr", "ord", "marker", "location", F.concat(topic_label(F.col("title"), F.col("topic_index")), F.lit(" — "), file_name(F.col("doc"))).alias("label"))


def recent_documents(opens: DataFrame, keep: int = RECENT) -> DataFrame:
    """(usr, rank, doc): documents by last opening. Moving to the front of a list without repeats is the same."""
    last = opens.groupBy("usr", F.lower("doc").alias("doc")).agg(F.max(F.struct("ts", "event_id")).alias("at"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy("usr").orderBy(F.desc("at")))).where(F.col("rank") <= keep).select("usr", "rank", "doc")


def bookmarks(rows: DataFrame) -> DataFrame:
    """Bookmarks distinct by place, the first label stays; rows without path or topic are malformed and go. rows(ord, label, path, topic, at_offset, win)"""
    ok = rows.where("path is not null and topic is not null and label is not null")
    return ok.groupBy("path", "topic", "at_offset", "win").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))


_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def bookmark_lines(marks: DataFrame) -> DataFrame:
    """One line of five tab-separated escaped fields for each bookmark."""
    fields = []
    for c in ("label", "path", "topic", "at_offset", "win"):
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in _ESCAPES:
            x = F.replace(x, F.lit(a), F.lit(b))
        fields.append(x)
    return marks.select(F.concat_ws("\t", *fields).alias("value"))


def parse_bookmark_lines(lines: DataFrame) -> DataFrame:
    """The bookmarks of lines(value); a line with a wrong escape, number or number of fields goes."""
    f = F.split("value", "\t")
    d = lines.where(F.size(f) == 5).where(F.forall(f, lambda x: x.rlike(r"^([^\\]|\\[\\tnr])*$")))

    def plain(i: int):
        x = F.replace(F.get(F.split("value", "\t"), F.lit(i)), F.lit("\\\\"), F.lit("\x00"))
        for a, b in _ESCAPES[1:]:
            x = F.replace(x, F.lit(b), F.lit(a))
        return F.replace(x, F.lit("\x00"), F.lit("\\"))

    number = lambda i: F.nullif(plain(i), F.lit("")).try_cast("long")
    d = d.where((plain(2).rlike("^[0-9]{1,10}$")) & plain(3).rlike("^-?[0-9]{0,10}$"))
    return d.select(plain(0).alias("label"), plain(1).alias("path"), number(2).alias("topic"), number(3).alias("at_offset"), F.nullif(plain(4), F.lit("")).alias("win"))


def write_bookmarks(marks: DataFrame, path: str) -> None:
    bookmark_lines(marks).write.text(path)


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    return parse_bookmark_lines(spark.read.text(path))
