"""Interval merging and counts on streams of events, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merge_sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): events of a key at most gap apart; a session is given out once no event up to `late` late can join it."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_support(events: DataFrame, keys: list[str], time: str, width: str, late: str, perfect: str) -> DataFrame:
    """(keys, start, n_all, n_perfect) of each tumbling window."""
    w = F.window(time, width).alias("w")
    out = events.withWatermark(time, late).groupBy(*keys, w).agg(F.count("*").alias("n_all"), F.sum(F.col(perfect).cast("long")).alias("n_perfect"))
    return out.select(*keys, F.col("w.start").alias("start"), "n_all", "n_perfect")


def join_sorted(start: np.ndarray, end: np.ndarray, n: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of intervals with counts: a new one begins where an interval starts beyond every earlier end + extra."""
    order = np.lexsort((end, start))
    start, end, n = start[order], end[order], n[order]
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.r_[True, start[1:] > reach[:-1] + extra])
    return start[cut], np.maximum.reduceat(end, cut), np.add.reduceat(n, cut)


def merge_stream(intervals: DataFrame, key: str, start: str, end: str, late: str, extra: int = 0) -> DataFrame:
    """(key, g_start, g_end, n) of intervals (key, start, end: timestamps) that overlap, or are at most extra microseconds apart.

    A group is given out, once, when the watermark (the latest start less `late`) has passed its end and extra: no interval
    that is late by less can join it. Intervals that begin before the watermark are dropped, those with a null in any
    of the three too. A key's state holds its open groups, not their intervals: as many as `late` and the longest intervals span.
    """
    rows = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).withWatermark(start, late)
    rows = rows.select(F.col(key).alias("key"), F.col(start).alias("start"), F.unix_micros(F.col(start)).alias("s"), F.unix_micros(F.col(end).cast("timestamp")).alias("e"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = [np.array(x, np.int64) for x in state.get] if state.exists else [np.zeros(0, np.int64)] * 3
        for b in batches:
            open_ = list(join_sorted(np.r_[open_[0], b["s"].to_numpy(np.int64)], np.r_[open_[1], b["e"].to_numpy(np.int64)], np.r_[open_[2], np.ones(len(b), np.int64)], extra))
        passed = state.getCurrentWatermarkMs() * 1000
        done = open_[1] + extra < passed
        left = [x[~done] for x in open_]
        if len(left[0]):
            state.update(tuple(x.tolist() for x in left))
            state.setTimeoutTimestamp(max(int(left[1].min() + extra) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [k[0]] * int(done.sum()), "s": open_[0][done], "e": open_[1][done], "n": open_[2][done]})

    kind = intervals.schema[key].dataType.simpleString()
    out = rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, s long, e long, n long", "s array<long>, e array<long>, n array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_micros("s").alias("g_start"), F.timestamp_micros("e").alias("g_end"), "n")
