"""Structured Streaming forms of the operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fold import AtEnd, State, Step, records, values_of, whole_columns


def stream_fold(
    df: DataFrame, by: Sequence[str], order: Sequence[str], step: Step, schema: str, *,
    event_time: str | None = None, late: str = "1 minute", expires: Callable[[State], int | None] | None = None, at_end: AtEnd | None = None,
) -> DataFrame:
    """``step`` over each key's rows: in order within a micro-batch, micro-batches as they arrive.

    Equals the batch fold where rows arrive in order; a late row is folded when it arrives.  With ``event_time`` (a
    timestamp column) the state of a key ends once the watermark, ``late`` behind the newest row, passes the time (ms) that ``expires``
    gives for it; ``at_end`` then gives its last rows.  An empty state is removed at once.  A key's rows of one micro-batch are sorted in
    memory, so a source needs a limit per trigger.
    """
    by, order, whole = list(by), list(order), whole_columns(df)
    names = [part.split()[0] for part in schema.split(",")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            out = values_of(at_end(held), names) if at_end else []
            state.remove()
            yield pd.DataFrame(out, columns=names)
            return
        out = []
        for row in records(pd.concat(list(frames)).sort_values(order), whole):
            held, got = step(held, row)
            out += values_of(got, names)
        if held:
            state.update((pickle.dumps(held),))
            end = expires(held) if expires and event_time else None
            if end is not None:
                state.setTimeoutTimestamp(max(int(end), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    rows = df.withWatermark(event_time, late) if event_time else df
    return rows.groupBy(*by).applyInPandasWithState(run, schema, "held binary", "append", timeout)


def rolling_windows(df: DataFrame, by: Sequence[str], time_col: str = "ts", window: str = "60 seconds", slide: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Count, mean and error share of each key and sliding window; rows later than ``late`` are left out."""
    w = F.window(time_col, window, slide)
    out = df.withWatermark(time_col, late).groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("stage") == "error").cast("double")).alias("error_rate"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "error_rate")


def first_writes(df: DataFrame, key: Sequence[str], time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """First row of each id within the watermark."""
    return df.withWatermark(time_col, late).dropDuplicatesWithinWatermark(list(key))
