"""The hidden-state filter on a stream: rows of a place are stepped in the order of event time, however they arrive.

A row waits in keyed state until the watermark has passed it, so that no earlier row can still come; its timer then
steps the filter. The state of a place is one vector of probabilities and the rows that the watermark has not reached; it
is dropped when nothing has come for `idle`. The step is that of the batch filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyloom.operators.hidden import Model
from skyloom.operators.kernels import log_normal

OUTPUT = "place string, ts timestamp, p array<double>"


def first_state(model: Model) -> np.ndarray:
    start = np.array(model.start) + 1e-12
    return start / start.sum()


def next_state(before: np.ndarray | None, x: np.ndarray, model: Model) -> np.ndarray:
    """Probabilities after the features `x`, from those before (None: the first row)."""
    prior = first_state(model) if before is None else before @ np.asarray(model.move)
    z = model.standardised(x)[None, :]
    dens = np.array([log_normal(z, np.asarray(m, float), np.asarray(s, float))[0] for m, s in zip(model.means, model.covs, strict=True)])
    w = prior * np.exp(dens - dens.max())
    return w / w.sum() if w.sum() > 0 else prior / max(prior.sum(), 1e-300)


class HiddenStateFilter(StatefulProcessor):
    """Rows (place, ts, features) in, (place, ts, p) out once the watermark has passed ts.

    Of rows with one place and moment the first to arrive counts. Rows that come after the watermark has passed them are
    dropped by Spark. `idle_ms`: event time after its last row at which a place is forgotten and would start anew.
    """

    def __init__(self, model: Model, idle_ms: int):
        self.model, self.idle_ms = model, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", "x array<double>")
        self.held = handle.getValueState("held", "last long, p array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            moments = (pd.DatetimeIndex(batch["ts"]).as_unit("us").asi8 // 1000).tolist()
            for ts, x in zip(moments, batch[list(self.model.names)].to_numpy(float).tolist(), strict=True):
                if not self.waiting.containsKey((ts,)):
                    self.waiting.updateValue((ts,), (x,))
                    self.handle.registerTimer(ts)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        due = sorted(ts for (ts,) in self.waiting.keys() if ts <= reached)
        held = self.held.get() if self.held.exists() else None
        last, p = (held[0], np.array(held[1])) if held else (None, None)
        out = []
        for ts in due:
            if last is not None and ts - last > self.idle_ms:
                p = None
            p = next_state(p, np.array(self.waiting.getValue((ts,))[0]), self.model)
            self.waiting.removeKey((ts,))
            out.append((key[0], pd.Timestamp(ts, unit="ms"), p.tolist()))
            last = ts
        if due:
            self.held.update((last, p.tolist()))
            self.handle.registerTimer(last + self.idle_ms)
        elif last is not None and last + self.idle_ms <= reached:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["place", "ts", "p"])

    def close(self) -> None:
        pass


def hidden_state_stream(stream: DataFrame, model: Model, late: str = "3 days", idle_days: int = 400) -> DataFrame:
    """place, ts and p for each row of a stream of place (string), ts and the model's features; rows may come up to `late` out of order.

    Needs the RocksDB state store, as Spark's arbitrary stateful operators do.
    """
    rows = stream.select("place", "ts", *model.names).withWatermark("ts", late)
    return rows.groupBy("place").transformWithStateInPandas(HiddenStateFilter(model, idle_days * 86_400_000), OUTPUT, "Append", "EventTime")
