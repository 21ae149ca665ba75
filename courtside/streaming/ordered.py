"""Steps over a stream in event-time order: rows wait for the watermark, and silent keys are forgotten.

Rows of a key may come in any order within the watermark's delay, also over several micro-batches. They are kept until the
watermark has passed them, then taken in order, so that a step sees what it would see in batch. Rows behind the watermark
are dropped by Spark. State is typed and small: what the step remembers, and the rows that wait.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that wait are kept this many to a value of the state.
CHUNK = 1000
#: The state store that transformWithState needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Runs ``step`` over each key's rows in the order of event time, then ``order``.

    A subclass may keep what it remembers in states of its own: it overrides ``open``, ``recall``, ``remember`` and ``forget``.
    """

    def __init__(self, key: str, time: str, order: Sequence[str], columns: Sequence[str], keep: Sequence[str], start: Any, step: Callable, outputs: Sequence[str], silence: int | None = None):
        self.key, self.time, self.order, self.columns, self.keep = key, time, list(order), list(columns), list(keep)
        self.start, self.step, self.outputs, self.silence = start, step, list(outputs), silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.until = handle.getValueState("until", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "memory string")

    def recall(self) -> Any:
        kept = self.memory.get()
        return self.start if kept is None else json.loads(kept[0])

    def remember(self, memory: Any) -> None:
        self.memory.update((json.dumps(memory),))

    def forget(self) -> None:
        self.memory.clear()

    def held(self) -> list[tuple]:
        """The rows that wait: (event time, place in the order, values)."""
        return [(at, tuple(place), values) for (rows,) in self.waiting.get() or [] for at, place, values in json.loads(rows)]

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys([*self.order, *self.columns, *self.keep]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, came = self.names, []
        place = [names.index(c) for c in self.order]
        for frame in rows:
            at = frame[self.time].astype("datetime64[ms]").astype("int64").tolist()
            values = zip(*(plain(frame[c]) for c in names), strict=True)
            came += [(t, tuple(row[i] for i in place), row) for t, row in zip(at, values, strict=True)]
        yield self.released(key, self.held(), came, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self.held()
        if not waiting and self.silence and self.until.exists() and self.until.get()[0] + self.silence <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
            self.forget()
            yield pd.DataFrame()
        else:
            yield self.released(key, waiting, [], timerValues)

    def released(self, key: tuple, waiting: list[tuple], came: list[tuple], timers) -> pd.DataFrame:
        """Takes the rows that the watermark has passed, in order; a timer wakes the key for those that still wait.

        State is asked for and changed only where there is something: each such call goes to another process.
        """
        mark, both = timers.getCurrentWatermarkInMs(), waiting + came
        ready = sorted((r for r in both if r[0] <= mark), key=lambda r: r[:2])
        later = [r for r in both if r[0] > mark]
        if later:
            if ready or came:
                self.waiting.put([(json.dumps(later[i : i + CHUNK]),) for i in range(0, len(later), CHUNK)])
            self.handle.registerTimer(max(r[0] for r in later))
        elif waiting:
            self.waiting.clear()
        if not ready:
            return pd.DataFrame()
        names = self.names
        columns, kept = [names.index(c) for c in self.columns], [names.index(c) for c in self.keep]
        memory, out = self.recall(), []
        for _, _, row in ready:
            memory, made = self.step(memory, tuple(row[i] for i in columns))
            out.append((key[0], *(row[i] for i in kept), *made))
        self.remember(memory)
        self.until.update((ready[-1][0],))
        if self.silence:
            self.handle.registerTimer(ready[-1][0] + self.silence)
        return pd.DataFrame(out, columns=[self.key, *self.keep, *self.outputs])


def plain(column: pd.Series) -> list:
    """A column's values as plain ones, null and NaN as None."""
    return [None if v is None or v != v else v for v in column.tolist()]


def in_order(
    stream: DataFrame, key: str, time: str, order: Sequence[str], columns: Sequence[str], start: Any, step: Callable, outputs: str, keep: Sequence[str], *, delay: str = "10 seconds", silence: int | None = None,
    processor: type[InOrder] = InOrder, **more: Any,
) -> DataFrame:
    """key, the kept columns and the outputs of ``step`` for each row, in the order of ``time`` whatever order rows came in.

    ``delay`` is how late a row may come, ``silence`` the event time in ms after which a key without rows is forgotten. Step
    and memory are plain (JSON), as in ``tracks.stateful``. A stream that ends holds back the rows of its last ``delay``.
    """
    stream.sparkSession.conf.set(*STORE)
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    shape = ", ".join([f"`{key}` {fields[key]}", *(f"`{c}` {fields[c]}" for c in keep), outputs])
    names = [o.strip().split(" ")[0] for o in outputs.split(", ")]
    run = processor(key, time, order, columns, keep, start, step, names, silence, **more)
    return stream.withWatermark(time, delay).groupBy(key).transformWithStateInPandas(run, shape, "append", "EventTime")
