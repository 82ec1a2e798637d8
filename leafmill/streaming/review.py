"""Review edits as keyed state: pages follow their edits in the order of the edits' own time, books follow their pages.

A book is a key. An edit waits in the book's state until the watermark passes its time; a timer of that time then folds all
waiting edits up to it in order of time and ``seq`` into the state of their pages, so edits that arrive out of order within
the watermark give the same pages as a batch fold of the log. If a content or number box was among them, the book's margins
are due: one row says so, and ``applied`` works them out from the store.

An edit that arrives twice waits once. One that is later than the watermark is left out, as its successors may have
been folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leafmill.operators.store import Store, decoded, encoded

EDITS = "doc_id string, page_index int, at timestamp, seq long, page_kind string, approve boolean, finish boolean, decided_by string, field string"
STATES = "doc_id string, page_index int, page_kind string, review_status string, decided_by string, at timestamp, due boolean"
BOX_FIELDS = ("content", "nombre", "content_delete", "nombre_delete")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [c.split()[0] for c in STATES.split(", ")]


def folded(state: tuple, edit: tuple) -> tuple:
    """(page_kind, review_status, decided_by) after an edit: a kind goes before approval before finish."""
    kind, approve, finish, by = edit
    status = "corrected" if kind else "approved" if approve else "corrected" if finish else None
    return state if status is None else (kind or state[0], status, by)


class Review(StatefulProcessor):
    """Of one book: ``pages`` by number, ``waiting`` edits by time and seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_index int", "page_kind string, review_status string, decided_by string")
        self.waiting = handle.getMapState("waiting", "at long, seq long", "page_index int, page_kind string, approve boolean, finish boolean, decided_by string, field string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.pages.updateValue((int(r.page_index),), (_text(r.page_kind), _text(r.review_status), _text(r.decided_by)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for b in rows:
            for r in b.itertuples(index=False):
                at = r.at.value // 1_000_000
                self.waiting.updateValue((at, int(r.seq)), (int(r.page_index), _text(r.page_kind), _yes(r.approve), _yes(r.finish), _text(r.decided_by), _text(r.field)))
                times.add(at)
        for at in sorted(times):
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] <= upto)
        touched, due = {}, False
        for k, (page, kind, approve, finish, by, field) in ready:
            old = tuple(self.pages.getValue((page,))) if self.pages.containsKey((page,)) else ("auto", "auto", "auto")
            new = folded(old, (kind, approve, finish, by))
            if new != old:
                self.pages.updateValue((page,), new)
                touched[page] = new
            due |= field in BOX_FIELDS
            self.waiting.removeKey(k)
        at = pd.Timestamp(upto, unit="ms")
        out = [(key[0], page, *s, at, False) for page, s in sorted(touched.items())] + [(key[0], None, None, None, None, at, True)] * due
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"page_index": "Int32"})

    def close(self) -> None:
        pass


def _text(x) -> str | None:
    return None if x is None or x != x else str(x)


def _yes(x) -> bool:
    return x is not None and x == x and bool(x)


def states(edits: DataFrame, *, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """STATES of a stream of EDITS: a page's kind, status and reviewer whenever they change, and ``due`` books.

    ``initial`` has doc_id, page_index, page_kind, review_status and decided_by of pages as they are before the stream's first run.
    """
    known = edits.where("doc_id IS NOT NULL AND page_index IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL").withWatermark("at", late)
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    start = None if initial is None else initial.select("doc_id", "page_index", "page_kind", "review_status", "decided_by").groupBy("doc_id")
    return known.groupBy("doc_id").transformWithStateInPandas(Review(), STATES, "Update", "EventTime", initialState=start)


def applied(store: Store, batch: DataFrame, at: float) -> None:
    """Merges a batch of ``states`` into the table ``pages``, and margins of books that are due; running it again changes nothing."""
    from leafmill.operators.rebuild import with_margins

    last = batch.where("NOT due").groupBy("doc_id", "page_index").agg(F.max_by(F.struct("page_kind", "review_status", "decided_by"), "at").alias("s"))
    due = batch.where("due").select("doc_id").distinct().withColumn("due", F.lit(True))
    books = [r[0] for r in batch.select(store.bucket("pages")).distinct().collect()]
    held = store._read("pages", store.log("pages").snapshot().files(set(books)))
    held = held.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
    old = decoded(held).join(last, ["doc_id", "page_index"], "left").join(due, "doc_id", "left")
    of = {c: F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)) for c in ("page_kind", "review_status", "decided_by")}
    new = old.withColumns(of)
    whole = with_margins(new.where("due").drop("s", "due")).unionByName(new.where("due IS NULL AND s IS NOT NULL").drop("s", "due"))
    store.merge("pages", encoded(whole).withColumn("updated_at", F.lit(at)), "updated_at")


def into_store(stream: DataFrame, store: Store, *, checkpoint: str) -> DataStreamWriter:
    """A writer of ``states`` into ``store``; the batch's number is the time of its pages, so a batch run again leaves the same table."""
    return stream.writeStream.outputMode("update").foreachBatch(lambda batch, k: applied(store, batch, 1e12 + k)).option("checkpointLocation", checkpoint)
