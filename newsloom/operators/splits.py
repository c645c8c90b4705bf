"""Temporal splits and the checks that no split sees another's future."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_of(ts: Column, train_end: Column, val_end: Column | None = None) -> Column:
    """train <= train_end < val <= val_end < test; null times are in none."""
    later = F.when(ts <= val_end, "val").otherwise("test") if val_end is not None else F.lit("val")
    return F.when(ts.isNull(), F.lit(None).cast("string")).when(ts <= train_end, "train").otherwise(later)


def split_by_time(df: DataFrame, ts: str, train_end: dt.datetime, val_end: dt.datetime | None = None) -> dict[str, DataFrame]:
    s = split_of(F.col(ts), F.lit(train_end).cast("timestamp_ntz"), None if val_end is None else F.lit(val_end).cast("timestamp_ntz"))
    return {name: df.where(s == name) for name in ("train", "val", "test") if val_end is not None or name != "test"}


def split_by_days(df: DataFrame, ts: str, val_days: int, test_days: int = 0) -> dict[str, DataFrame]:
    """The last `test_days` are test, the `val_days` before them val."""
    last = df.agg(F.max(ts)).first()[0]
    if last is None:
        return {name: df.where("false") for name in ("train", "val", "test")}
    val_end = last - dt.timedelta(days=test_days)
    return split_by_time(df, ts, val_end - dt.timedelta(days=val_days), val_end)


def verify_split_integrity(splits: list[tuple[str, DataFrame]], id_col: str, ts: str) -> None:
    """Raises AssertionError if an id appears in two splits or a split (in the order given) begins before an earlier one ends; empty splits are ignored."""
    for i, (a, x) in enumerate(splits):
        for b, y in splits[i + 1 :]:
            n = x.select(id_col).intersect(y.select(id_col)).count()
            if n:
                raise AssertionError(f"splits {a} and {b} share {n} ids")
    spans = [(name, *df.agg(F.min(ts), F.max(ts)).first()) for name, df in splits]
    spans = [s for s in spans if s[1] is not None]
    for (a, _, end), (b, start, _) in zip(spans, spans[1:], strict=False):
        if end > start:
            raise AssertionError(f"split {b} begins at {start}, before {a} is over ({end})")


def strict_order(df: DataFrame, split: str, ts: str, earlier: str, later: str) -> DataFrame:
    """One row: `last_before`, `first_after`, and `in_order`, whether all of `earlier` lies strictly before `later`."""
    at = {n: F.when(F.col(split) == n, F.col(ts)) for n in (earlier, later)}
    return df.agg(F.max(at[earlier]).alias("last_before"), F.min(at[later]).alias("first_after")).withColumn("in_order", F.col("last_before") < F.col("first_after"))
