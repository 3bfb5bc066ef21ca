"""Typed state in the state store: folds in frame order over rows that come in any order.

Rows wait in a list until the watermark has passed their time, so that no earlier frame can come any more; a timer at the
earliest time that waits then releases all that are due, sorted by frame, to the fold, whose numbers are a typed value."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.clips import stretches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_state(spark: SparkSession) -> None:
    """Typed state needs the store that keeps it on disk; a session that names another that has it is left alone."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


@dataclass(frozen=True)
class Fold:
    """`begin` makes a key's state, `load` sets it from the values of `kept` (DDL), `dump` gives them; `step` takes a frame's rows
    and gives rows of a frame and `schema`; `end` (if any) the same when the key's state goes."""

    schema: str
    kept: str
    begin: Callable[[Any], Any]
    load: Callable[[Any, tuple], None]
    dump: Callable[[Any], tuple]
    step: Callable[[Any, int, pd.DataFrame], Iterable[tuple]]
    end: Callable[[Any], Iterable[tuple]] | None = None


class InOrder(StatefulProcessor):
    """A fold over each key's frames in their order. Rows have `ts`; `idle_ms` of event time after its last row a key is forgotten."""

    def __init__(self, fold: Fold, columns: list[tuple[str, str]], order: str, idle_ms: int):
        self.fold, self.columns, self.order, self.idle_ms = fold, columns, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {k}" for n, k in self.columns))
        self.own = handle.getValueState("own", self.fold.kept)
        self.times = handle.getValueState("times", "frame int, last long, timer long")

    def _timer(self, at: int, before: int | None) -> int:
        if before is not None and before != at:
            self.handle.deleteTimer(before)
        if before != at:
            self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame, last, timer = self.times.get() if self.times.exists() else (-1, -1, None)
        first = None
        for pdf in rows:
            times = pdf["at_ms"]
            first = int(times.min()) if first is None else min(first, int(times.min()))
            last = max(last, int(times.max()))
            self.waiting.appendList([tuple(_plain(x) for x in r) for r in pdf[[n for n, _ in self.columns]].itertuples(index=False)])
        if first is not None:
            timer = self._timer(first if timer is None else min(first, timer), timer)
            self.times.update((frame, last, timer))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame, last, _ = self.times.get()
        names, due = [n for n, _ in self.columns], timerValues.getCurrentWatermarkInMs()
        at = names.index("at_ms")
        held = list(self.waiting.get()) if self.waiting.exists() else []
        now, later = [r for r in held if r[at] <= due], [r for r in held if r[at] > due]
        own = self.fold.begin(key[0])
        if self.own.exists():
            self.fold.load(own, self.own.get())
        out: list[tuple] = []
        if now:
            pdf = pd.DataFrame(now, columns=names).sort_values(["frame", self.order], kind="stable", ignore_index=True)
            for f, a, b in stretches(pdf["frame"]):
                if f > frame:
                    out += [(*key, *row) for row in self.fold.step(own, f, pdf.iloc[a:b])]
                    frame = f
        if later:
            self.waiting.put(later)
            self.times.update((frame, last, self._timer(min(r[at] for r in later), None)))
        else:
            self.waiting.clear()
            if last + self.idle_ms <= due:
                out += [(*key, *row) for row in self.fold.end(own)] if self.fold.end else []
                self.own.clear()
                self.times.clear()
                yield self._table(out)
                return
            self.times.update((frame, last, self._timer(last + self.idle_ms, None)))
        self.own.update(self.fold.dump(own))
        yield self._table(out)

    def _table(self, out: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(out, columns=["key", "frame", *(c.split()[0] for c in self.fold.schema.split(", "))])
        return table.astype(object).where(table.notna(), None)

    def close(self) -> None:
        pass


def _plain(x: Any) -> Any:
    """A value that the store takes: numpy's numbers and NaN become Python's and null."""
    if hasattr(x, "tolist"):
        x = x.tolist()
    return None if isinstance(x, float) and x != x else x


def in_order(rows: DataFrame, key: str, order: str, fold: Fold, late: str = "2 seconds", idle_ms: int = 600_000) -> DataFrame:
    """key, frame and the fold's rows, for a stream with key, frame, `ts` (timestamp; later frames have later ones) and the columns
    that the fold reads. Frames may come in any order within `late`; those that come later than that are dropped, and a frame's
    rows are given out once the watermark has passed it. Two rows of a frame are ordered by `order`."""
    typed_state(rows.sparkSession)
    timed = rows.withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", late)
    columns = [(n, k) for n, k in timed.dtypes if n not in (key, "ts")]
    kind = dict(rows.dtypes)[key]
    out = timed.groupBy(key).transformWithStateInPandas(InOrder(fold, columns, order, idle_ms), f"key {kind}, frame int, {fold.schema}", "Append", "EventTime")
    return out.withColumnRenamed("key", key)
