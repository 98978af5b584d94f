"""The session operators over streams of navigation events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import RECENT, History

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Stateful processors of this module need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """A user's rows of one micro-batch by time, those without one last; how many they are is bounded by what a trigger reads."""
    return sorted(rows, key=lambda r: [(v is None, v) for v in (r.ts, r.event_id)])


class RecentProcessor(StatefulProcessor):
    """The last few documents of a user: a list that an opening moves its document to the front of. Rows without a document open none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.docs = handle.getListState("recent", "doc string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        docs = [x[0] for x in self.docs.get()]
        for r in _in_order(rows):
            if r.location is not None:
                d = r.location.lower()
                docs = [d, *[x for x in docs if x != d]][:RECENT]
        if docs:
            self.docs.put([(d,) for d in docs])
            for i, d in enumerate(docs):
                yield Row(usr=key[0], rank=i + 1, doc=d)

    def close(self) -> None:
        pass


class HistoryProcessor(StatefulProcessor):
    """A user's history; events are in order within a micro-batch, later ones are applied when they arrive.

    The history is one value, read and written once for a user and micro-batch. Events are rows: most
    users have few, and a frame for each user costs more than they do.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getValueState("history", "current string, back array<string>, forward array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        h = History(*(self.history.get() or ()))
        for r in _in_order(rows):
            h.apply(r.action, r.location)
            yield Row(usr=key[0], event_id=r.event_id, current=h.current, back_depth=len(h.back), forward_depth=len(h.forward))
        self.history.update((h.current, h.back, h.forward))

    def close(self) -> None:
        pass


def stream_recent_documents(opens: DataFrame) -> DataFrame:
    """Updates (usr, rank, doc) for each user of a micro-batch. opens(usr, ts, event_id, location)"""
    with_state_store(opens.sparkSession)
    return opens.groupBy("usr").transformWithState(RecentProcessor(), "usr long, rank int, doc string", "Update", "None")


def stream_history(events: DataFrame) -> DataFrame:
    """The state after each event, as replay_history gives it. events(usr, ts, event_id, action, location)"""
    with_state_store(events.sparkSession)
    return events.groupBy("usr").transformWithState(HistoryProcessor(), "usr long, event_id long, current string, back_depth int, forward_depth int", "Append", "None")
