"""The point-in-time history as a stream: clicks and impressions of each user, in event time.

State holds a user's latest clicks (at most `n` and those within the lateness) and
the impressions not yet safe to answer. When the watermark passes an impression,
every click before it has arrived, so it gets the same history as in batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.history import MAX_HISTORY

OUT = "user_id string, impression_id string, n_hist int, items string"
STATE = "clicks array<struct<ts:timestamp,article_id:string>>, asked array<struct<ts:timestamp,impression_id:string>>"


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events (`user_id`, `ts`): events no further apart than `gap`, closed by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def answer(clicks: list[tuple], asked: list[tuple], watermark, n: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(clicks kept, impressions waiting, answered (impression_id, items)) once everything before `watermark` has come."""
    clicks = sorted(set(clicks))
    ready = sorted(x for x in asked if x[0] <= watermark)
    done = []
    for ts, imp in ready:
        seen = [a for t, a in clicks if t < ts][-n:]
        done.append((imp, seen[::-1]))
    settled = [c for c in clicks if c[0] < watermark]
    return settled[-n:] + clicks[len(settled) :], [x for x in asked if x[0] > watermark], done


def streaming_history(events: DataFrame, n: int = MAX_HISTORY, late: str = "1 hour") -> DataFrame:
    """`events`: user_id, ts (timestamp), article_id (of a click, else null), impression_id (of an impression, else null)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clicks, asked = ([tuple(x) for x in part] for part in state.get) if state.exists else ([], [])
        for b in batches:
            clicks += [(t, a) for t, a in zip(b["ts"], b["article_id"], strict=True) if isinstance(a, str)]
            asked += [(t, i) for t, i in zip(b["ts"], b["impression_id"], strict=True) if isinstance(i, str)]
        clicks, asked = [(pd.Timestamp(t), a) for t, a in clicks], [(pd.Timestamp(t), i) for t, i in asked]
        watermark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        clicks, asked, done = answer(clicks, asked, watermark, n)
        if clicks or asked:
            state.update(([(t.to_pydatetime(), a) for t, a in clicks], [(t.to_pydatetime(), i) for t, i in asked]))
            if asked:
                wake = int(min(t for t, _ in asked).timestamp() * 1000) + 1
                state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], i, len(items), " ".join(items)) for i, items in done], columns=["user_id", "impression_id", "n_hist", "items"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
