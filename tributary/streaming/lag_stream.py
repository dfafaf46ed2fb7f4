"""Lag features of a stream of panel rows: keyed state holds the last rows of each segment, and each row's features are emitted once.

Lags go by position, as in batches: the k-th lag is the value k rows of the segment earlier. Rows of a micro-batch are put in order of t;
a row whose t isn't above all those of its segment that were emitted before is late: it comes out as it is, with null lags and `late`
true, and changes nothing. So the features of a row never change, and a stream that restarts from its checkpoint goes on where it was.
With `fill`, gaps in t are filled up by rows of that value. State is `max_lag` rows a segment; a segment's rows of one micro-batch are one
task's, so the size of micro-batches bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lagging import lag_columns
from ..sources.panel import SEGMENT, TIME


class LagStream:
    def __init__(self, variables: Sequence[str], min_lags: Sequence[int], max_lags: Sequence[int], effects: Sequence[str] = (), fill: float | None = None):
        self.variables, self.effects, self.fill = tuple(variables), tuple(effects), fill
        self.columns = lag_columns(min_lags, max_lags, variables)
        self.deepest = max(max_lags)

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.columns]

    def _update(self, held: tuple[np.ndarray, np.ndarray], rows: pd.DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], pd.DataFrame]:
        """State after some rows (t and values of the last ones), and what these rows emit."""
        old_t, old_x = held
        rows = rows.sort_values(TIME, kind="stable")
        late = rows[TIME].duplicated().to_numpy() | (rows[TIME].to_numpy() <= (old_t[-1] if len(old_t) else np.iinfo(np.int64).min))
        fresh = rows[~late]
        t, x = fresh[TIME].to_numpy(np.int64), fresh[list(self.variables)].to_numpy(float)
        if self.fill is not None and len(t):
            every = np.arange(old_t[-1] + 1 if len(old_t) else t[0], t[-1] + 1)
            filled = np.full((len(every), x.shape[1]), float(self.fill))
            filled[t - every[0]] = x
            t, x = every, filled
        all_t, all_x = np.concatenate([old_t, t]), np.concatenate([old_x, x])
        at = np.arange(max(len(old_t), self.deepest), len(all_t))
        place = {v: i for i, v in enumerate(self.variables)}
        out = {TIME: all_t[at]} | {e: all_x[at, place[e]] for e in self.effects} | {n: all_x[at - k, place[v]] for n, v, k in self.columns}
        out = pd.DataFrame(out | {"late": np.zeros(len(at), bool)})
        if late.any():
            old = rows[late]
            out = pd.concat([out, pd.DataFrame({TIME: old[TIME].to_numpy(np.int64)} | {e: old[e].to_numpy(float) for e in self.effects} | {n: np.full(len(old), np.nan) for n in self.names} | {"late": True})])
        keep = max(self.deepest, 1)  # the last t at least
        return (all_t[-keep:], all_x[-keep:]), out

    def features(self, stream: DataFrame) -> DataFrame:
        """segment_id, t, effects, a column for each lag, late; of a stream with segment_id, t and the variables."""
        kind = stream.schema[SEGMENT].dataType.simpleString()
        d, order = len(self.variables), [SEGMENT, TIME, *self.effects, *self.names, "late"]

        def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            t, x = state.get if state.exists else ([], [])
            held = np.asarray(t, np.int64), np.asarray(x, float).reshape(-1, d)
            held, out = self._update(held, pd.concat(list(batches)))
            state.update((held[0].tolist(), held[1].ravel().tolist()))
            out.insert(0, SEGMENT, key[0])
            yield out[order]

        fields = ", ".join([f"{SEGMENT} {kind}", f"{TIME} long", *(f"`{n}` double" for n in [*self.effects, *self.names]), "late boolean"])
        rows = stream.select(SEGMENT, stream[TIME].cast("long").alias(TIME), *(stream[v].cast("double").alias(v) for v in self.variables))
        return rows.groupBy(SEGMENT).applyInPandasWithState(run, fields, "t array<long>, x array<double>", "append", GroupStateTimeout.NoTimeout)
