"""Structured Streaming forms of the timed operators; over a finished stream they give what the batch plans give.

Rows: (key, ts, seq, value). The watermark is ours to choose: rows later than `late` are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, quiet: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, fired, n): the last row of each burst that a quiet time ends."""
    last = F.max(F.struct("ts", "seq"))
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", quiet)).agg(last["seq"].alias("fired"), F.count(F.lit(1)).alias("n")).select("key", "fired", "n")


def latest_wins(events: DataFrame) -> DataFrame:
    """(key, ts, seq, value): the newest row of each key (update or complete mode)."""
    return events.groupBy("key").agg(F.max(F.struct("ts", "seq", "value")).alias("m")).select("key", "m.*")


def gate(events: DataFrame, opens: str = "open", closes: str = "discard") -> DataFrame:
    """(key, seq, value) of the rows let through: they wait until a row of kind `opens`, then pass; `closes` ends the key for good."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, waiting = state.get if state.exists else ("waiting", [])
        waiting, out = list(waiting), []
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for row in rows.itertuples():
            if status == "closed":
                break
            if row.kind == closes:
                status, waiting = "closed", []
            elif row.kind == opens:
                if status == "waiting":
                    out += [(key[0], *x.split("\t", 1)) for x in waiting]
                    status, waiting = "open", []
            elif status == "open":
                out.append((key[0], row.seq, row.value))
            else:
                waiting.append(f"{row.seq}\t{row.value}")
        state.update((status, waiting))
        yield pd.DataFrame([(k, int(s), str(v)) for k, s, v in out], columns=["key", "seq", "value"])

    rows = events.select("key", "ts", "seq", "kind", F.col("value").cast("string").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(run, "key long, seq long, value string", "status string, waiting array<string>", "append", GroupStateTimeout.NoTimeout)


def trailing_rate(events: DataFrame, window_s: float, span_s: float) -> DataFrame:
    """(key, seq, rate) of cumulative values: over a trailing window and one sample before it; null with too little data."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples():
            times.append(row.ts.timestamp())
            values.append(float(row.value))
            while len(times) > 1 and times[-1] - times[1] > window_s:
                times.pop(0), values.pop(0)
            span, gain = times[-1] - times[0], values[-1] - values[0]
            out.append((key[0], row.seq, gain / span if len(times) > 1 and span >= span_s and gain > 0 else None))
        state.update((times, values))
        yield pd.DataFrame(out, columns=["key", "seq", "rate"])

    return events.groupBy("key").applyInPandasWithState(run, "key long, seq long, rate double", "times array<double>, vals array<double>", "append", GroupStateTimeout.NoTimeout)


def throttle(events: DataFrame, gap_s: float) -> DataFrame:
    """(key, seq): rows at least gap_s after the last one let through; greedy, so it needs state."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples():
            t = row.ts.timestamp()
            if last is None or t - last >= gap_s:
                last = t
                out.append((key[0], row.seq))
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "seq"])

    return events.groupBy("key").applyInPandasWithState(run, "key long, seq long", "last double", "append", GroupStateTimeout.NoTimeout)
