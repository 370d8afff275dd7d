"""Running averages per key over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUT = "user_id bigint, n bigint, total double, ema double, late_id bigint"
STATE = "n bigint, total double, ema double, last_ts timestamp, last_id bigint"


def stream_ema(events: DataFrame, decay: float = 0.9) -> DataFrame:
    """Per user_id the count, sum and moving average of ``value``, carried over micro-batches in the order of (ts, event_id).

    The state knows the last row that it has taken. A row that comes later but lies before it would have
    changed an average that was given out already: it leaves the state alone and goes to a side output, a
    row with its event_id as ``late_id``. Rows with a null ``late_id`` are the averages. A row that comes
    again counts as late. Of one micro-batch a key's rows are sorted together, so ``maxFilesPerTrigger``
    bounds what a task holds.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, ema, last_ts, last_id = state.get if state.exists else (0, 0.0, None, None, None)
        rows = pd.concat([b[["ts", "event_id", "value"]] for b in batches]).sort_values(["ts", "event_id"])
        late = np.zeros(len(rows), bool)
        if last_ts is not None:
            seen = pd.Timestamp(last_ts)
            late = ((rows["ts"] < seen) | ((rows["ts"] == seen) & (rows["event_id"] <= last_id))).to_numpy()
        side, rows = rows[late], rows[~late]
        if len(rows):
            x = rows["value"].to_numpy(float)
            # a sum with falling weights in place of a loop over rows
            weights = (1 - decay) * decay ** np.arange(len(x) - 1, -1, -1)
            if ema is None:
                weights[0] = decay ** (len(x) - 1)
            ema = float(weights @ x) + (0.0 if ema is None else decay ** len(x) * ema)
            n, total = n + len(x), total + float(x.sum())
            state.update((n, total, ema, rows["ts"].iloc[-1].to_pydatetime(), int(rows["event_id"].iloc[-1])))
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "ema": [ema], "late_id": pd.array([None], "Int64")})
        if len(side):
            yield pd.DataFrame({"user_id": key[0], "n": n, "total": total, "ema": ema, "late_id": side["event_id"].to_numpy()})

    return events.groupBy("user_id").applyInPandasWithState(update, OUT, STATE, "update", "NoTimeout")
