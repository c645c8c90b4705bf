"""Queries of the general data problems (p1, p2, p3, p5, p6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.bitemporal import bitemporal_join
from newsloom.operators.feature_table import feature_cells, feature_table, type_list
from newsloom.operators.offset_chunks import heavy_keys, per_key
from newsloom.operators.packed import unpack
from newsloom.operators.skew import hot_keys, salted_lookup
from newsloom.session import table
from newsloom.sources.records import loaded, rejected

HEAVY_SHARE = 0.02


def _clicks(b: DataFrame, *keep: str) -> DataFrame:
    return b.select(*keep, F.explode("clicked_article_ids").alias("article_id"))


def _p1_users(spark: SparkSession, d: str, sums: bool = True) -> DataFrame:
    b = table(spark, d, "behaviors")
    return per_key(b, F.col("user_id"), F.col("timestamp"), {"clicks": F.coalesce(F.size("clicked_article_ids"), F.lit(0)).cast("long")} if sums else None)


def _p1_articles(spark: SparkSession, d: str) -> DataFrame:
    return per_key(_clicks(table(spark, d, "behaviors"), "timestamp"), F.col("article_id"), F.col("timestamp"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "behaviors")
    users = heavy_keys(_p1_users(spark, d, sums=False), b.count(), HEAVY_SHARE)
    elements = b.agg(F.sum(F.size("clicked_article_ids"))).first()[0] or 0
    articles = heavy_keys(_p1_articles(spark, d), elements, HEAVY_SHARE)
    return users.select(F.lit("user_id").alias("key_field"), F.col("key").alias("key_value")).unionByName(articles.select(F.lit("clicked_article_ids").alias("key_field"), F.col("key").alias("key_value")))


def p1_user_runs(spark: SparkSession, d: str) -> DataFrame:
    return _p1_users(spark, d).withColumnRenamed("key", "user_id")


def p1_article_clicks(spark: SparkSession, d: str) -> DataFrame:
    return _p1_articles(spark, d).withColumnRenamed("key", "article_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(table(spark, d, "news_lines"), "news").unionByName(rejected(table(spark, d, "behavior_lines"), "behavior"))


def p2_news_loaded(spark: SparkSession, d: str) -> DataFrame:
    return loaded(table(spark, d, "news_lines"), "news").drop("title_entity_list", "abstract_entity_list")


def p2_news_entities(spark: SparkSession, d: str) -> DataFrame:
    """The typed entities of the loaded lines, a row each."""
    rows = loaded(table(spark, d, "news_lines"), "news")
    both = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_entity_list").alias("l")) for f in ("title", "abstract")))
    e = rows.select("line_id", F.explode(both).alias("x")).select("line_id", "x.field_name", F.posexplode("x.l").alias("place", "e"))
    return e.select("line_id", "field_name", "place", "e.label", "e.wikidata_id", "e.confidence", F.array_join(F.col("e.offsets").cast("array<string>"), " ").alias("offsets"))


def p2_behavior_loaded(spark: SparkSession, d: str) -> DataFrame:
    r = loaded(table(spark, d, "behavior_lines"), "behavior")
    return r.select("line_id", "impression_id", "user_id", F.col("time").alias("ts"), *(F.array_join(c, " ").alias(c) for c in ("history", "candidates", "clicked")))


def _p3(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "behaviors").where("clicked_article_ids is not null")
    return bitemporal_join(b, table(spark, d, "user_history"), entity="user_id", valid="timestamp", known="timestamp", keep=["impression_id"], version_entity="user_id", as_of="as_of", recorded="recorded_at", version_id="history_id").select("impression_id", F.col("version_id").alias("history_id")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d)


def p3_history_at_click(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "user_history").select("history_id", F.coalesce(F.size("history"), F.lit(0)).alias("n_items"), F.try_element_at("history", F.lit(-1)).alias("newest"), "history")
    return _p3(spark, d).join(h, "history_id")


def _p5(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    b = table(spark, d, "behaviors").where("user_id is not null and size(clicked_article_ids) > 0")
    once = b.select("impression_id", "user_id", "timestamp", "clicked_article_ids", "read_time").distinct()
    kinds = table(spark, d, "articles").select("article_id", "subcategory").where("subcategory is not null").distinct()
    clicks = salted_lookup(_clicks(once, "user_id", "timestamp", "read_time"), kinds, "article_id", hot=_hot_clicked(b))
    return feature_cells(clicks, F.col("user_id"), F.col("subcategory"), F.col("timestamp"), F.col("read_time")), type_list(kinds, "subcategory")


def _hot_clicked(b: DataFrame) -> list:
    return hot_keys(_clicks(b), F.col("article_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = feature_table(*_p5(spark, d))
    return t.select(F.col("entity").alias("user_id"), F.inline("features")).where("n > 0").select("user_id", F.col("kind").alias("subcategory"))


def p5_feature_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per user of `behaviors`; `last_at` and `total` hold one value per subcategory, in the order of `clicks`; `last_click` and `read_time` are those of all."""
    t = feature_table(*_p5(spark, d), entities=table(spark, d, "behaviors").select(F.col("user_id").alias("entity")))
    return t.select(
        F.col("entity").alias("user_id"),
        F.array_join(F.transform("features", lambda x: x["n"].cast("string")), ",").alias("clicks"),
        F.array_max(F.transform("features", lambda x: x["last_at"])).alias("last_click"),
        F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x["total"]), 2).alias("read_time"),
        F.col("features.last_at").alias("last_at"),
        F.transform("features", lambda x: F.round(x["total"], 2)).alias("total"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack(table(spark, d, "mind_behaviors"), ["history", "impressions"], "row_id")


def _flat(query):
    """The query with its arrays as joined strings, so that any engine's rows can be compared."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = query(spark, d)
        text = {"timestamp_ntz": lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "double": lambda x: x.cast("decimal(18,2)").cast("string"), "string": lambda x: x}
        items = {c: t[6:-1] for c, t in df.dtypes if t.startswith("array<")}
        return df.select(*(F.array_join(F.transform(c, text[items[c]]), " ", "-").alias(c) if c in items else F.col(c) for c in df.columns))

    run.__name__ = query.__name__
    return run


QUERIES = {f.__name__: f for f in (p1_found, p1_user_runs, p1_article_clicks, p2_found, p2_news_loaded, p2_news_entities, p2_behavior_loaded, p3_found, _flat(p3_history_at_click), p5_found, _flat(p5_feature_table), p6_found)}

_RUNS = """WITH e AS ({events}), g AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY k ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS broke FROM e WHERE k IS NOT NULL)
SELECT k AS {key}, count(*) AS n_rows, min(ts) AS first_at, max(ts) AS last_at, CAST(sum(broke) AS BIGINT) + 1 AS n_runs{more} FROM g GROUP BY k"""

_P3 = """p3 AS (
  SELECT impression_id, history_id FROM (
    SELECT b.impression_id, h.history_id, row_number() OVER (PARTITION BY b.impression_id ORDER BY h.as_of DESC, h.recorded_at DESC, h.history_id DESC) AS k
    FROM (SELECT DISTINCT impression_id, user_id, "timestamp" AS ts FROM behaviors WHERE clicked_article_ids IS NOT NULL AND user_id IS NOT NULL) b
    JOIN user_history h ON h.user_id = b.user_id AND h.as_of < b.ts AND h.recorded_at <= b.ts) WHERE k = 1)"""

_P5 = """clicks AS (
  SELECT user_id, "timestamp" AS ts, CASE WHEN read_time BETWEEN 0 AND 86400 THEN read_time ELSE 0 END AS rt, unnest(clicked_article_ids) AS article_id
  FROM (SELECT DISTINCT impression_id, user_id, "timestamp", clicked_article_ids, read_time FROM behaviors WHERE user_id IS NOT NULL)),
kinds AS (SELECT DISTINCT article_id, subcategory FROM articles WHERE subcategory IS NOT NULL),
cells AS (SELECT user_id, subcategory, count(*) AS n, max(ts) AS last_at, sum(rt) AS total FROM clicks JOIN kinds USING (article_id) GROUP BY ALL)"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_JSON = "CASE WHEN json_valid({0}) THEN {0} ELSE 'null' END"
_ENTITIES = f"""({{0}} = '' OR (json_type({_JSON}) = 'ARRAY' AND coalesce(list_bool_and(list_transform(json_extract({_JSON}, '$[*]'), lambda e:
    json_type(e) = 'OBJECT' AND coalesce(json_type(e, '$.Label') = 'VARCHAR' AND json_extract_string(e, '$.Label') <> '' AND json_type(e, '$.WikidataId') = 'VARCHAR' AND regexp_full_match(json_extract_string(e, '$.WikidataId'), 'Q[0-9]+')
    AND json_type(e, '$.Confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND TRY_CAST(json_extract_string(e, '$.Confidence') AS DOUBLE) BETWEEN 0 AND 1 AND json_type(e, '$.OccurrenceOffsets') = 'ARRAY'
    AND coalesce(list_bool_and(list_transform(json_extract(e, '$.OccurrenceOffsets[*]'), lambda o: json_type(o) = 'UBIGINT')), true), false))), true)))"""
_P2 = f"""WITH l AS (SELECT 'news' AS line_kind, line_id, split, coalesce(line, '') AS line FROM news_lines UNION ALL SELECT 'behavior', line_id, split, coalesce(line, '') FROM behavior_lines),
q AS (SELECT *, regexp_full_match(line, '(?s){_FIELD}(?:\\t{_FIELD})*') AS quoted_well,
  list_transform(regexp_extract_all(chr(9) || line, '(?s)\\t({_FIELD})', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM l),
v AS (SELECT line_kind, line_id, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(f) <> CASE line_kind WHEN 'news' THEN 8 ELSE 5 END THEN 'columns'
  WHEN regexp_matches(line, '[\\x00-\\x08\\x0a-\\x1f\\x7f\\x{{FFFD}}]') THEN 'value'
  WHEN line_kind = 'news' AND NOT (regexp_full_match(f[1], 'N[0-9]+') AND f[2] <> '' AND {_ENTITIES.format("f[7]")} AND {_ENTITIES.format("f[8]")}) THEN 'value'
  WHEN line_kind = 'behavior' AND NOT (regexp_full_match(f[1], '[0-9]+') AND regexp_full_match(f[2], 'U[0-9]+') AND regexp_full_match(f[4], '|N[0-9]+( N[0-9]+)*')
    AND regexp_full_match(f[3], '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} (0?[1-9]|1[0-2]):[0-5][0-9]:[0-5][0-9] (AM|PM)') AND try_strptime(f[3], '%m/%d/%Y %I:%M:%S %p') IS NOT NULL
    AND regexp_full_match(f[5], CASE split WHEN 'test' THEN 'N[0-9]+( N[0-9]+)*' ELSE 'N[0-9]+-[01]( N[0-9]+-[01])*' END)) THEN 'value' END AS reason FROM q)"""

SQL = {
    "p2_found": f"{_P2} SELECT line_kind, line_id, reason FROM v WHERE reason IS NOT NULL",
    "p2_news_loaded": f"{_P2} SELECT line_id, f[1] AS news_id, f[2] AS category, f[3] AS subcategory, f[4] AS title, f[5] AS abstract, f[6] AS url, f[7] AS title_entities, f[8] AS abstract_entities FROM q JOIN v USING (line_kind, line_id) WHERE line_kind = 'news' AND reason IS NULL",
    "p2_news_entities": f"""{_P2}, n AS (SELECT line_id, unnest([{{'field_name': 'title', 'j': f[7]}}, {{'field_name': 'abstract', 'j': f[8]}}]) AS x FROM q JOIN v USING (line_kind, line_id) WHERE line_kind = 'news' AND reason IS NULL),
j AS (SELECT line_id, x.field_name, from_json(CASE WHEN x.j = '' THEN '[]' ELSE x.j END, '[{{"Label":"VARCHAR","WikidataId":"VARCHAR","Confidence":"DOUBLE","OccurrenceOffsets":["BIGINT"]}}]') AS l FROM n)
SELECT line_id, field_name, CAST(k - 1 AS INT) AS place, l[k].Label AS label, l[k].WikidataId AS wikidata_id, l[k].Confidence AS confidence, coalesce(array_to_string(l[k].OccurrenceOffsets, ' '), '') AS offsets
FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM j)""",
    "p2_behavior_loaded": f"""{_P2}, r AS (SELECT line_id, split, f, string_split(f[5], ' ') AS s FROM q JOIN v USING (line_kind, line_id) WHERE line_kind = 'behavior' AND reason IS NULL)
SELECT line_id, f[1] AS impression_id, f[2] AS user_id, strptime(f[3], '%m/%d/%Y %I:%M:%S %p') AS ts, f[4] AS history,
  CASE WHEN split = 'test' THEN f[5] ELSE array_to_string(list_transform(s, lambda x: x[:-3]), ' ') END AS candidates,
  CASE WHEN split <> 'test' THEN coalesce(array_to_string(list_transform(list_filter(s, lambda x: x[-1:] = '1'), lambda x: x[:-3]), ' '), '') END AS clicked FROM r""",
    "p1_found": """SELECT 'user_id' AS key_field, user_id AS key_value FROM behaviors WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM behaviors)
UNION ALL SELECT 'clicked_article_ids', a FROM (SELECT unnest(clicked_article_ids) AS a FROM behaviors) WHERE a IS NOT NULL GROUP BY a
HAVING count(*) >= 0.02 * (SELECT sum(len(clicked_article_ids)) FROM behaviors)""",
    "p1_user_runs": _RUNS.format(key="user_id", events='SELECT user_id AS k, "timestamp" AS ts, coalesce(len(clicked_article_ids), 0) AS c FROM behaviors', more=", CAST(sum(c) AS BIGINT) AS clicks"),
    "p1_article_clicks": _RUNS.format(key="article_id", events='SELECT unnest(clicked_article_ids) AS k, "timestamp" AS ts FROM behaviors', more=""),
    "p3_found": f"WITH {_P3} SELECT * FROM p3",
    "p3_history_at_click": f"WITH {_P3} SELECT impression_id, history_id, CAST(coalesce(len(history), 0) AS INT) AS n_items, history[-1] AS newest, array_to_string(list_transform(history, lambda x: coalesce(x, '-')), ' ') AS history FROM p3 JOIN user_history USING (history_id)",
    "p5_found": f"WITH {_P5} SELECT user_id, subcategory FROM cells",
    "p5_feature_table": f"""WITH {_P5}, types AS (SELECT DISTINCT subcategory FROM kinds), users AS (SELECT DISTINCT user_id FROM behaviors WHERE user_id IS NOT NULL)
SELECT user_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY subcategory) AS clicks, max(last_at) AS last_click, round(sum(coalesce(total, 0)), 2) AS read_time,
  string_agg(coalesce(strftime(last_at, '%Y-%m-%d %H:%M:%S.%f'), '-'), ' ' ORDER BY subcategory) AS last_at, string_agg(CAST(CAST(round(coalesce(total, 0), 2) AS DECIMAL(18,2)) AS VARCHAR), ' ' ORDER BY subcategory) AS total
FROM users CROSS JOIN types LEFT JOIN cells USING (user_id, subcategory) GROUP BY user_id""",
    "p6_found": r"""WITH t AS (SELECT row_id, 'history' AS field_name, history AS s FROM mind_behaviors UNION ALL SELECT row_id, 'impressions', impressions FROM mind_behaviors),
x AS (SELECT row_id, field_name, list_filter(list_transform(regexp_extract_all(s, '"[^"]*"|''[^'']*''|[A-Za-z0-9-]+'),
  lambda v: CASE WHEN v[1] IN ('"', '''') THEN regexp_replace(v[2:-2], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') ELSE v END), lambda v: v <> '') AS items FROM t)
SELECT row_id, field_name, CAST(k - 1 AS INT) AS item_position, items[k] AS item FROM (SELECT row_id, field_name, items, unnest(range(1, len(items) + 1)) AS k FROM x)""",
}
