"""Attributes as known at event time, by bitemporal rectangles.

A version says "this held from `as_of`, and was recorded at `recorded`". In the
plane of valid time (v) and recorded time (r), each entity's versions split the
plane into disjoint rectangles (v_lo, v_hi] x [r_lo, r_hi) in which one version is
current: of those with as_of < v and recorded <= r, the one with the greatest
as_of, then recorded, then id. An event is a point (its valid time, the time up
to which it may know), located in the rectangle that holds it.

Rectangles are indexed by a grid. An entity with few versions is one cell. One with
many has its versions numbered by (as_of, recorded, id), by prefix sums that never
hold an entity in one task, and its events learn in the same pass how many versions
begin before them; a cell is a run of `rows_per_cell` versions. In the other
direction, the grid is a pyramid: a cell stands on the next level as one version, in
force from its place and recorded as early as the first of its versions, and again
`rows_per_cell` of these make a cell. An event is looked up in its own cell; if
nothing there was recorded in time, in the cell above for the nearest earlier cell
that has something, and so on, and then down again. So no cell of any level holds
more than `rows_per_cell` versions, however late, however many at once and however
far from each other they were recorded, and no version is copied. Cells with many
events are salted.

Defined results: events or versions with a null entity or time (versions: null
id too) match nothing; events without a version are left out; repeated versions
and repeated events are kept apart by their ids (repeated events give repeated
rows); times may lie anywhere; extra columns are untouched, as only the named
ones are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.offset_chunks import prefix_sums
from newsloom.operators.skew import hot_keys, salted_lookup, salted_sides
from newsloom.session import shuffle_parts, written

ROWS_PER_CELL = 256
_END = 2**62
#: Cells of level k are numbered from k * _LEVEL.
_LEVEL = 2**48
_RECT = pa.schema([("entity", pa.string()), ("cell", pa.int64()), ("v_lo", pa.int64()), ("v_hi", pa.int64()), ("r_lo", pa.int64()), ("r_hi", pa.int64()), ("version_id", pa.int64())])


def micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


class Sweep:
    """One cell's versions, added in order of (recorded, as_of, id); emits rectangles (v_lo, v_hi, r_lo, r_hi, id)."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.live: list[tuple[int, int]] = []  # (r_lo, id), aligned with starts

    def _closed(self, k: int, r: int) -> tuple[int, int, int, int, int] | None:
        opened, vid = self.live[k]
        hi = self.starts[k + 1] if k + 1 < len(self.starts) else _END
        return (self.starts[k], hi, opened, r, vid) if opened < r else None

    def add(self, as_of: int, recorded: int, vid: int) -> tuple[int, int, int, int, int] | None:
        k = bisect_left(self.starts, as_of)
        if k < len(self.starts) and self.starts[k] == as_of:
            done = self._closed(k, recorded)
            self.live[k] = (recorded, vid)
            return done
        done = None
        if k:
            done = self._closed(k - 1, recorded)
            self.live[k - 1] = (recorded, self.live[k - 1][1])
        self.starts.insert(k, as_of)
        self.live.insert(k, (recorded, vid))
        return done

    def rest(self) -> Iterator[tuple[int, int, int, int, int]]:
        for k in range(len(self.starts)):
            if done := self._closed(k, _END):
                yield done


def _rectangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, sweep, out = None, Sweep(), []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * len(_RECT)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECT, strict=True)], schema=_RECT)

    for b in batches:
        for entity, cell, xa, xr, vid in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (entity, cell) != at:
                if at:
                    out.extend((*at, *x) for x in sweep.rest())
                at, sweep = (entity, cell), Sweep()
            if done := sweep.add(xa, xr, vid):
                out.append((*at, *done))
        if len(out) > 50_000:
            yield batch()
    if at:
        out.extend((*at, *x) for x in sweep.rest())
    yield batch()


def rectangles(cells: DataFrame) -> DataFrame:
    """Disjoint rectangles of each (`entity`, `cell`) of versions `xa` (from when), `xr` (recorded), `id`."""
    ordered = cells.repartition(shuffle_parts(cells.sparkSession), "entity", "cell").sortWithinPartitions("entity", "cell", "xr", "xa", "id")
    return ordered.mapInArrow(_rectangles, "entity string, cell long, v_lo long, v_hi long, r_lo long, r_hi long, version_id long")


def _located(points: DataFrame, rects: DataFrame, how: str) -> DataFrame:
    """`points` (`entity`, `cell`, `x`, `r`, ...) with `version_id`, of the rectangle of the cell that holds (x, r)."""
    key = F.concat_ws("#", F.col("cell"), F.col("entity")).alias("_key")
    f = points.select("*", key)
    f, d = salted_sides(f, rects.select(key, "v_lo", "v_hi", "r_lo", "r_hi", "version_id"), "_key", hot_keys(f, F.col("_key")))
    salts = [c for c in f.columns if c in d.columns]
    d = d.toDF(*(f"_d{c}" if c in salts else c for c in d.columns))
    same = " and ".join(f"{c} = _d{c}" for c in salts)
    return f.join(d, F.expr(f"{same} and x > v_lo and x <= v_hi and r >= r_lo and r < r_hi"), how).select(*points.columns, "version_id")


def pyramid(numbered: DataFrame, rows_per_cell: int, most: int) -> tuple[DataFrame, int]:
    """The cells of all levels of `numbered` versions (`entity`, `no`, `r`, `id`), and the number of levels; `most`: versions of the largest entity."""
    k = rows_per_cell
    level, height, out = numbered.select("entity", "no", "r", "id"), 1, None
    while True:
        cells = level.select("entity", (F.lit((height - 1) * _LEVEL) + F.floor(F.col("no") / k)).cast("long").alias("cell"), F.col("no").alias("xa"), F.col("r").alias("xr"), "id")
        out = cells if out is None else out.unionByName(cells)
        if most <= k:
            return out, height
        level = level.groupBy("entity", F.floor(F.col("no") / k).cast("long").alias("no")).agg(F.min("r").alias("r")).withColumn("id", F.col("no"))
        most, height = -(-most // k), height + 1


def _climb(points: DataFrame, rects: DataFrame, height: int, k: int) -> DataFrame:
    """Events with their version: up the levels until a cell has something recorded in time, then down to that version. `points` have `p`, the number of the last version that begins before them."""
    done, todo = [], points
    for level in range(height):
        at = todo.select("*", (F.lit(level * _LEVEL) + F.floor(F.col("p") / k)).cast("long").alias("cell"), (F.col("p") + 1).alias("x"))
        tried = written(_located(at, rects, "left").drop("cell", "x"))
        found = tried.where("version_id is not null")
        for below in range(level - 1, -1, -1):
            inside = found.select(*points.columns, (F.lit(below * _LEVEL) + F.col("version_id")).cast("long").alias("cell"), F.lit(_END - 1).alias("x"))
            found = _located(inside, rects, "inner").drop("cell", "x")
        done.append(found)
        todo = tried.where("version_id is null").drop("version_id").withColumn("p", F.floor(F.col("p") / k).cast("long") - 1).where("p >= 0")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def bitemporal_join(events: DataFrame, versions: DataFrame, *, entity: str, valid: str, known: str, keep: list[str], version_entity: str, as_of: str, recorded: str, version_id: str, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """`keep` columns of each event and the `version_id` of the version current at (valid, known)."""
    e = events.select(F.col(entity).cast("string").alias("entity"), micros(F.col(valid)).alias("v"), micros(F.col(known)).alias("r"), *(F.col(c).alias(f"k_{c}") for c in keep)).where("entity is not null and v is not null and r is not null")
    n = versions.select(F.col(version_entity).cast("string").alias("entity"), micros(F.col(as_of)).alias("a"), micros(F.col(recorded)).alias("r"), F.col(version_id).cast("long").alias("id")).where("entity is not null and a is not null and r is not null and id is not null")
    kept = [F.col(f"k_{c}").alias(c) for c in keep]

    heavy = written(n.groupBy("entity").agg(F.count(F.lit(1)).alias("n_versions")).where(F.col("n_versions") > rows_per_cell))
    most = heavy.agg(F.max("n_versions")).first()[0]
    if most is None:
        rects = rectangles(n.select("entity", F.lit(0).cast("long").alias("cell"), F.col("a").alias("xa"), F.col("r").alias("xr"), "id"))
        return _located(e.withColumn("cell", F.lit(0).cast("long")).withColumnRenamed("v", "x"), rects, "inner").select(*kept, "version_id")

    e, n = (salted_lookup(df, heavy, "entity", "left") for df in (e, n))
    light_e, light_n = (df.where("n_versions is null").drop("n_versions") for df in (e, n))
    light_rects = rectangles(light_n.select("entity", F.lit(0).cast("long").alias("cell"), F.col("a").alias("xa"), F.col("r").alias("xr"), "id"))
    light = _located(light_e.withColumn("cell", F.lit(0).cast("long")).withColumnRenamed("v", "x"), light_rects, "inner").select(*kept, "version_id")

    points = e.where("n_versions is not null").withColumnRenamed("v", "t").withColumn("is_version", F.lit(0).cast("long"))
    begins = n.where("n_versions is not null").withColumnRenamed("a", "t").withColumn("is_version", F.lit(1).cast("long"))
    # At equal times events come first, as a version is current only after its as_of.
    both = points.unionByName(begins, allowMissingColumns=True).drop("n_versions")
    placed = written(prefix_sums(both, "entity", ["t", "is_version", "r", "id"], "is_version"))
    cells, height = pyramid(placed.where("is_version = 1").withColumn("no", F.col("before")), rows_per_cell, most)
    rects = written(rectangles(cells))
    asked = placed.where("is_version = 0 and before > 0").select("entity", "r", *(f"k_{c}" for c in keep), (F.col("before") - 1).alias("p"))
    return light.unionByName(_climb(asked, rects, height, rows_per_cell).select(*kept, "version_id"))
