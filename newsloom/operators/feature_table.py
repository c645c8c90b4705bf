"""One feature row per entity from events of hundreds of types, by two-stage salted aggregation.

Events of the heaviest entities (see `skew`) are spread over salts, by their share; each (entity, type, salt) gives partial statistics; partials are
merged per (entity, type) and expanded to the complete list of types.

Defined results: a null entity or type has no cell; a null event time counts as an
event but not for the last time; null, NaN and impossible amounts (outside
[0, MAX_AMOUNT]) count as an event of amount 0; repeated events count each time; an
empty table gives no rows; entities without any typed event have a row of zeros if
`feature_table` is given the entities, else none.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.skew import hot_keys, with_salts
from newsloom.session import shuffle_parts

MAX_AMOUNT = 86_400.0
MAX_TYPES = 20_000


def type_list(types: DataFrame, column: str) -> list[str]:
    """The complete list of types, in order; more than MAX_TYPES is an error, as the list becomes part of every row."""
    found = [r[0] for r in types.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_TYPES + 1).collect()]
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    return sorted(found)


def feature_cells(events: DataFrame, entity: Column, kind: Column, at: Column, amount: Column) -> DataFrame:
    """The filled cells: `entity`, `kind`, `n`, `last_at`, `total`; partitioned by entity."""
    e = events.select(entity.alias("entity"), kind.alias("kind"), at.alias("at"), amount.cast("double").alias("amount")).where("entity is not null and kind is not null")
    e = with_salts(e, "entity", hot_keys(events, entity), "_n").withColumn("_salt", F.pmod(F.xxhash64("at", "amount"), F.col("_n")))
    good = F.when(F.col("amount").between(0, MAX_AMOUNT), F.col("amount")).otherwise(0.0)
    part = e.groupBy("entity", "kind", "_salt").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"), F.sum(good).alias("total"))
    whole = part.repartition(shuffle_parts(events.sparkSession), "entity").groupBy("entity", "kind")
    return whole.agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"), F.sum("total").alias("total"))


def feature_table(cells: DataFrame, kinds: list[str], entities: DataFrame | None = None) -> DataFrame:
    """One row per entity: `features`, an array with one struct (kind, n, last_at, total) for each of `kinds`, in order. The entities are those of `cells`, or the distinct non-null ones of `entities` (column `entity`)."""
    spark = cells.sparkSession
    at = cells.schema["last_at"].dataType

    def cell(kind: Column, n: Column, last_at: Column, total: Column) -> Column:
        return F.struct(kind.alias("kind"), n.alias("n"), last_at.alias("last_at"), total.alias("total"))

    # One literal, folded before the query runs; thousands of columns would keep the driver busy.
    empty = F.from_json(F.lit(json.dumps([{"kind": k, "n": 0, "total": 0.0} for k in kinds])), f"array<struct<kind:string,n:bigint,last_at:{at.simpleString()},total:double>>")
    codes = spark.createDataFrame([(k, i) for i, k in enumerate(kinds)], "kind string, code int")  # at most MAX_TYPES rows
    filled = cells.join(F.broadcast(codes), "kind").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("code", cell(*(F.col(c) for c in ("kind", "n", "last_at", "total"))).alias("x")))).alias("f"))
    if entities is not None:
        filled = entities.select("entity").where("entity is not null").distinct().join(filled, "entity", "left")
    # A merge of two sorted lists: before each filled cell the empty ones since the last, and after the last the rest.
    before = F.concat(F.array(F.lit(-1)), F.col("f.code"))
    runs = F.zip_with(F.slice(before, 1, F.size("f")), "f", lambda p, x: F.concat(F.slice(empty, p + 2, x["code"] - p - 1), F.array(x["x"])))
    last = F.element_at(before, -1)
    merged = F.concat(F.flatten(runs), F.slice(empty, last + 2, F.lit(len(kinds)) - last - 1))
    return filled.select("entity", F.when(F.col("f").isNull(), empty).otherwise(merged).alias("features"))


def wide(table: DataFrame, kinds: list[str]) -> DataFrame:
    """The same as columns `n_<kind>`, `last_<kind>`, `total_<kind>`."""
    cols = [F.col("features")[i][f].alias(f"{name}_{k}") for i, k in enumerate(kinds) for f, name in (("n", "n"), ("last_at", "last"), ("total", "total"))]
    return table.select("entity", *cols)
