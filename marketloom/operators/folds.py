"""Recurrences over a key's rows in order, in batch and as a stream, in memory that does not grow with the key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketloom.session import ship

#: From a key's state (None at first) and its next rows to the state after them and the rows to send. States are JSON values.
Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


def in_order(df: DataFrame, key: list[str], order: list[str], step: Step, schema, dump: Callable[[Any], Any] = lambda state: state, load: Callable[[Any], Any] = lambda state: state) -> DataFrame:
    """What step makes of each key's rows, which it gets in order, some at a time, with the state it left.

    One shuffle by the key and one sort, which spills; a task holds a batch of rows and the state of one key, however many rows the
    key has. Rows of a null key are a key of their own. An empty table gives an empty result.

    A stream keeps each key's state in the state store. Within a trigger a key's rows go by the order, across triggers they are
    taken as they come, so the result is that of batch if no trigger brings rows from before the last one's. A state that is no JSON
    value needs dump and load, which make it one and make it anew.
    """
    if df.isStreaming:
        ship(df.sparkSession)
        return df.groupBy(*key).transformWithStateInPandas(Fold(step, order, df.columns, dump, load), schema, outputMode="Append", timeMode="None")

    def run(frames):
        own, state = object(), None
        for pdf in frames:
            if pdf.empty:
                continue
            ids = list(zip(*(pdf[k].tolist() for k in key), strict=True))
            ends = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]] + [len(ids)]
            begin, out = 0, []
            for end in ends:
                if ids[begin] != own:
                    own, state = ids[begin], None
                state, rows = step(state, pdf.iloc[begin:end])
                out.append(rows)
                begin = end
            yield pd.concat(out) if len(out) > 1 else out[0]

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def taken(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """A key's rows of one trigger. Spark hands computed columns over without their names, in order."""
    return pd.concat(list(rows), ignore_index=True).set_axis(columns, axis=1)


class Fold(StatefulProcessor):
    """A step over a stream's keys, whose states are held as JSON."""

    def __init__(self, step: Step, order: list[str], columns: list[str], dump: Callable[[Any], Any], load: Callable[[Any], Any]):
        self.step, self.order, self.columns, self.dump, self.load = step, order, columns, dump, load

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = taken(rows, self.columns).sort_values(self.order, kind="stable")
        state, out = self.step(self.load(json.loads(self.held.get()[0])) if self.held.exists() else None, pdf)
        self.held.update((json.dumps(self.dump(state)),))
        yield out.reset_index(drop=True)

    def close(self) -> None:
        pass
