"""The unified schemas. Tables are projected into them and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _TS = T.StringType(), T.TimestampNTZType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


ARTICLES = _struct(article_id=_S, dataset=_S, title=_S, abstract=_S, body=_S, category=_S, subcategory=_S, published_time=_TS, entities=_S, sentiment_score=T.FloatType(), total_pageviews=T.LongType(), total_inviews=T.LongType(), embedding=T.ArrayType(T.FloatType()))
BEHAVIORS = _struct(impression_id=_S, raw_impression_id=_S, user_id=_S, dataset=_S, timestamp=_TS, candidate_article_ids=T.ArrayType(_S), clicked_article_ids=T.ArrayType(_S))
USER_HISTORY = _struct(user_id=_S, dataset=_S, article_id=_S, click_timestamp=_TS)


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` itself; raises ValueError where names, order or types differ."""
    have, want = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in schema]
    if have != want:
        raise ValueError(f"schema differs: {[h for h in have if h not in want]} instead of {[w for w in want if w not in have]}")
    return df
