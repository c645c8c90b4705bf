"""The SQL of `reference_queries`, as common table expressions put together by need."""

from __future__ import annotations

import re

CTES = {
    "arts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY delivered_at, title NULLS FIRST) AS k_ FROM articles) WHERE k_ = 1",
    "imps": """SELECT DISTINCT impression_id, dataset, split_part(impression_id, '_', 2) AS split, user_id, "timestamp" AS ts, candidate_article_ids AS cands, clicked_article_ids AS clicked, session_id, read_time
      FROM behaviors WHERE clicked_article_ids IS NOT NULL""",
    "cand": """SELECT impression_id, dataset, split, user_id, ts, CAST(k - 1 AS INT) AS pos, cands[k] AS article_id, CAST(list_contains(clicked, cands[k]) AS INT) AS label
      FROM (SELECT *, unnest(range(1, len(cands) + 1)) AS k FROM imps)""",
    "val": "SELECT * FROM cand WHERE split = 'val'",
    "clk": "SELECT user_id, article_id, click_timestamp AS ts, max(read_time) AS read_time FROM click_log WHERE user_id IS NOT NULL AND click_timestamp IS NOT NULL GROUP BY ALL",
    "histall": """SELECT * FROM (SELECT i.impression_id, i.split, i.user_id, i.ts, c.article_id, c.ts AS click_ts, c.read_time,
      CAST(row_number() OVER (PARTITION BY i.impression_id ORDER BY c.ts DESC, c.article_id DESC) AS INT) AS h FROM imps i JOIN clk c ON c.user_id = i.user_id AND c.ts < i.ts) WHERE h <= 20""",
    "hist": "SELECT * FROM histall WHERE split = 'val'",
    "tok": r"SELECT article_id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\p{L}\p{N}_]+')) AS term FROM arts",
    "post": "SELECT article_id, term, count(*) AS tf FROM tok GROUP BY ALL",
    "dl": r"SELECT article_id, len(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\p{L}\p{N}_]+')) AS dl FROM arts",
    "stat": "SELECT count(*) AS n, avg(dl) AS avgdl FROM dl",
    "idf": "SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, stat GROUP BY term",
    "imp": "SELECT term, article_id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM post JOIN dl USING (article_id) JOIN idf USING (term), stat",
    "qterm": r"SELECT DISTINCT impression_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS term FROM hist JOIN arts USING (article_id) WHERE title IS NOT NULL",
    "qimp": "SELECT DISTINCT impression_id FROM hist JOIN arts USING (article_id) WHERE title IS NOT NULL",
    "bm": "SELECT v.*, round(coalesce(s, 0.0), 9) AS score FROM val v JOIN qimp USING (impression_id) LEFT JOIN (SELECT v.impression_id, v.pos, sum(w) AS s FROM val v JOIN imp USING (article_id) JOIN qterm q ON q.impression_id = v.impression_id AND q.term = imp.term GROUP BY ALL) x ON x.impression_id = v.impression_id AND x.pos = v.pos",
    "raw": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings",
    "vecs": "SELECT article_id, list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS vec FROM (SELECT article_id, CAST(regexp_replace(article_id, '[^0-9]', '', 'g') AS BIGINT) AS g FROM arts) JOIN raw ON vec_id = g % (SELECT count(*) FROM embeddings)",
    "udim": "SELECT impression_id, dim, avg(x) AS x FROM (SELECT impression_id, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM hist JOIN vecs USING (article_id)) GROUP BY ALL",
    "uvec": "SELECT impression_id, list(x ORDER BY dim) AS u, sqrt(sum(x * x)) AS n FROM udim GROUP BY impression_id",
    "emb": "SELECT v.*, round(coalesce(list_dot_product(u, vec) / CASE WHEN n = 0 THEN 1 ELSE n END, 0.0), 9) AS score FROM val v JOIN uvec USING (impression_id) LEFT JOIN vecs USING (article_id)",
    "pair": "SELECT b.impression_id, b.pos, b.article_id, b.label, b.score AS bm25, e.score AS emb FROM bm b JOIN emb e ON e.impression_id = b.impression_id AND e.pos = b.pos",
    "pop": "SELECT article_id, count(*) AS clicks FROM (SELECT unnest(clicked) AS article_id FROM imps WHERE split = 'train') GROUP BY 1",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS INT) AS rank FROM emb",
    "top5": "SELECT * FROM ranked WHERE rank <= 5",
    "titleq": r"SELECT DISTINCT article_id AS query_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}_]+')) AS term FROM arts WHERE CAST(regexp_replace(article_id, '[^0-9]', '', 'g') AS BIGINT) % 50 = 0",
    "hits": "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS INT) AS rank FROM (SELECT query_id, article_id, round(sum(w), 9) AS score FROM titleq JOIN imp USING (term) GROUP BY ALL)",
    "weights": "SELECT *, exp(-ln(2.0) / 72.0 * greatest((epoch_us(ts) - epoch_us(click_ts)) / 3.6e9, 0)) AS wt FROM hist",
    "cats": "SELECT impression_id, category, count(*) AS n, sum(wt) AS w FROM weights JOIN arts USING (article_id) WHERE category IS NOT NULL GROUP BY ALL",
    "hfeat": "SELECT impression_id, count(*) AS hist_click_count, sum(wt) AS recency, coalesce(avg(read_time), 0) AS dwell FROM weights GROUP BY 1",
    "sess": """SELECT impression_id, CAST(CASE WHEN user_id IS NULL OR session_id IS NULL THEN 0 ELSE rank() OVER (PARTITION BY user_id, session_id ORDER BY ts) END AS INT) AS session_ordinal,
      CAST(CASE WHEN user_id IS NULL OR session_id IS NULL THEN 0 ELSE sum(len(clicked)) OVER (PARTITION BY user_id, session_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(len(clicked)) OVER (PARTITION BY user_id, session_id, ts) END AS BIGINT) AS session_click_count_so_far FROM imps""",
}


def _metrics(source: str, keys: str) -> str:
    """AUC, MRR and nDCG of each group of `keys` with both labels."""
    return f"""SELECT {keys}, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc,
  coalesce(1.0 / min(CASE WHEN label = 1 THEN rk END), 0) AS mrr,
  sum(CASE WHEN label = 1 AND rk <= 5 THEN 1 / log2(rk + 1) ELSE 0 END) / list_sum(list_transform(range(1, CAST(least(sum(label), 5) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg5,
  sum(CASE WHEN label = 1 AND rk <= 10 THEN 1 / log2(rk + 1) ELSE 0 END) / list_sum(list_transform(range(1, CAST(least(sum(label), 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, pos) AS rk FROM {source})
GROUP BY {keys} HAVING sum(label) > 0 AND sum(label) < count(*)"""


CTES["mets"] = _metrics("emb", "impression_id")
CTES["bmets"] = _metrics("bm", "impression_id")
CTES["long"] = "SELECT 'bm25' AS method, impression_id, pos, label, bm25 AS score FROM pair UNION ALL SELECT 'embeddings', impression_id, pos, label, emb FROM pair UNION ALL SELECT 'popularity', impression_id, pos, label, coalesce(clicks, 0) FROM pair LEFT JOIN pop USING (article_id)"
CTES["lmets"] = _metrics("long", "method, impression_id")
CTES["grid"] = "SELECT alpha, impression_id, pos, label, round(alpha * bm25 + (1 - alpha) * emb, 9) AS score FROM pair, (SELECT round(0.05 * unnest(range(0, 21)), 2)::DOUBLE AS alpha)"
CTES["gmets"] = _metrics("grid", "alpha, impression_id")


def sql(body: str) -> str:
    """`body` with the common table expressions it names, and those they name, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"(?<![\w.']){name}(?![\w'(])", text) and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(body)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in need) + "\n" if need else "") + body


_DIGITS = "CAST(regexp_replace(article_id, '[^0-9]', '', 'g') AS BIGINT)"
_LEAK = """SELECT h.impression_id, h.article_id FROM hist h UNION ALL
  SELECT i.impression_id, u.article_id FROM imps i JOIN (SELECT DISTINCT user_id, unnest(clicked) AS article_id FROM imps WHERE split = 'val' AND user_id IS NOT NULL) u USING (user_id)
  JOIN arts a ON a.article_id = u.article_id WHERE i.split = 'val' AND NOT list_contains(i.clicked, u.article_id)"""
CTES["leak"] = _LEAK
CTES["ludim"] = CTES["udim"].replace("FROM hist JOIN", "FROM leak JOIN")
CTES["luvec"] = CTES["uvec"].replace("FROM udim", "FROM ludim")
CTES["lemb"] = CTES["emb"].replace("JOIN uvec", "JOIN luvec")
CTES["lkmets"] = _metrics("lemb", "impression_id")

CTES["mb"] = """SELECT split, nullif(f[1], '') AS raw, nullif(f[2], '') AS user_id, try_strptime(f[3], '%m/%d/%Y %I:%M:%S %p') AS ts, nullif(f[4], '') AS history, nullif(f[5], '') AS shown
  FROM (SELECT split, string_split(line, chr(9)) AS f FROM behavior_lines WHERE split IN ('train', 'val', 'test')) WHERE len(f) = 5 AND try_strptime(f[3], '%m/%d/%Y %I:%M:%S %p') IS NOT NULL
  AND regexp_full_match(f[3], '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2} (AM|PM)')"""
CTES["mh"] = """SELECT split, user_id, string_split(history, ' ') AS h, anchor FROM (SELECT *, min(ts) OVER (PARTITION BY split) AS anchor FROM mb WHERE split <> 'test') WHERE history IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY split, user_id ORDER BY len(string_split(history, ' ')) DESC, history DESC) = 1"""

_LISTS = "list_transform(string_split(shown, ' '), lambda x: string_split(x, '-'))"

SQL = {
    "articles_view": sql("SELECT article_id, dataset, title, category, subcategory, published_time, abstract IS NULL AS no_abstract FROM arts"),
    "candidates_view": sql("SELECT impression_id, user_id, ts, pos, article_id, label FROM cand"),
    "mind_clean_news": """SELECT nullif(f[1], '') AS article_id, 'mind' AS dataset, nullif(f[4], '') AS title, nullif(f[5], '') AS abstract, nullif(f[2], '') AS category, nullif(f[3], '') AS subcategory, f[7] || '|' || f[8] AS entities
      FROM (SELECT string_split(line, chr(9)) AS f FROM news_lines) WHERE len(f) = 8""",
    "mind_clean_behaviors": sql(f"""SELECT 'mind_' || split || '_' || raw AS impression_id, user_id, ts, CASE WHEN split = 'test' THEN shown ELSE list_aggregate(list_transform({_LISTS}, lambda p: p[1]), 'string_agg', ' ') END AS cands,
      CASE WHEN split = 'test' OR shown IS NULL THEN NULL ELSE coalesce(list_aggregate(list_transform(list_filter({_LISTS}, lambda p: p[2] = '1'), lambda p: p[1]), 'string_agg', ' '), '') END AS clicked FROM mb"""),
    "mind_synthetic_history": sql("SELECT user_id, 'mind' AS dataset, article_id, min(t) AS click_timestamp FROM (SELECT user_id, h[k] AS article_id, anchor - to_seconds(CAST(len(h) - k + 1 AS BIGINT)) AS t FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM mh)) GROUP BY ALL"),
    "history_dedup": sql("SELECT user_id, article_id, ts FROM clk"),
    "entity_labels": sql("""SELECT e.WikidataId AS wikidata_id, e.Type AS entity_type, count(*) AS n, count(DISTINCT article_id) AS n_articles
      FROM (SELECT article_id, unnest(from_json(split_part(entities, '|', 1), '[{"WikidataId":"VARCHAR","Type":"VARCHAR"}]')) AS e FROM arts WHERE dataset = 'mind' AND entities IS NOT NULL AND split_part(entities, '|', 1) <> '') WHERE e.WikidataId IS NOT NULL GROUP BY ALL"""),
    "temporal_split_counts": """SELECT CASE WHEN "timestamp" <= TIMESTAMP '2019-03-18 16:47:56' THEN 'train' WHEN "timestamp" <= TIMESTAMP '2019-03-21 20:22:16' THEN 'val' WHEN "timestamp" IS NOT NULL THEN 'test' END AS split,
      count(*) AS n_rows, count(DISTINCT impression_id) AS n_ids, min("timestamp") AS first_ts, max("timestamp") AS last_ts FROM behaviors GROUP BY 1""",
    "split_overlap": """WITH b AS (SELECT DISTINCT raw_impression_id, split_part(impression_id, '_', 2) AS s FROM behaviors)
      SELECT x.s AS split_a, y.s AS split_b, count(*) AS n_shared FROM b x JOIN b y ON x.raw_impression_id = y.raw_impression_id AND x.s < y.s GROUP BY ALL""",
    "hybrid_training_union": sql("""SELECT impression_id, split FROM imps WHERE split = 'val' UNION ALL SELECT impression_id, split FROM (
      SELECT *, row_number() OVER (ORDER BY ts, impression_id) AS k FROM imps WHERE split = 'train' AND split_part(impression_id, '_', 3) NOT IN (SELECT split_part(impression_id, '_', 3) FROM imps WHERE split = 'val'))
      WHERE k <= (SELECT floor(count(*) * 2.25) - count(*) FROM imps WHERE split = 'val')"""),
    "recent_history_top20": sql("SELECT impression_id, h, article_id, click_ts FROM hist"),
    "recent_history_train": sql("SELECT i.impression_id, CAST(count(h) AS INT) AS n_hist, coalesce(string_agg(article_id, ' ' ORDER BY h), '') AS items FROM imps i LEFT JOIN histall USING (impression_id) WHERE i.split = 'train' GROUP BY 1"),
    "cold_start_counts": sql("SELECT dataset, count(*) AS n, count_if(m IS NULL) AS cold, count_if(m > 0 AND len(clicked) > 0) AS eligible FROM imps LEFT JOIN (SELECT impression_id, count(*) AS m FROM hist GROUP BY 1) USING (impression_id) WHERE split = 'val' GROUP BY 1"),
    "leakage_violations": sql("SELECT count(*) AS violations FROM hist WHERE click_ts >= ts"),
    "train_articles_only": sql("SELECT impression_id, string_agg(article_id, ' ' ORDER BY h) AS items FROM hist WHERE article_id IN (SELECT article_id FROM pop) GROUP BY 1"),
    "bm25_idf": sql("SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "bm25_search_top50": sql("SELECT query_id, article_id, rank, round(score, 6) AS score FROM hits WHERE rank <= 50"),
    "bm25_candidate_scores": sql("SELECT impression_id, pos, article_id, label, round(score, 6) AS score FROM bm"),
    "bm25_candidate_auc": sql("SELECT count(*) AS n, round(avg(auc), 6) AS auc FROM bmets"),
    "bm25_floored_idf": sql("SELECT term, round(greatest(idf, 0.01), 6) AS idf FROM idf"),
    "emb_norms": sql("SELECT vec_id, round(n, 5) AS norm, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS unit_norm FROM raw"),
    "emb_user_vectors": sql("SELECT impression_id, CAST(dim AS INT) AS dim, round(x, 6) AS x FROM udim"),
    "emb_search_top50": sql(f"""SELECT query_id, count(*) AS n, round(min(score), 6) AS last_score, round(avg(score), 6) AS mean_score FROM (
      SELECT q.article_id AS query_id, round(list_dot_product(q.vec, v.vec), 9) AS score, row_number() OVER (PARTITION BY q.article_id ORDER BY round(list_dot_product(q.vec, v.vec), 9) DESC, v.article_id) AS k
      FROM (SELECT * FROM vecs WHERE {_DIGITS} % 50 = 0) q, vecs v) WHERE k <= 50 GROUP BY 1"""),
    "emb_candidate_scores": sql("SELECT impression_id, pos, article_id, round(score, 6) AS score FROM emb"),
    "decayed_similarity": sql("""SELECT v.impression_id, v.pos, round(round(coalesce(list_dot_product(u, vec) / CASE WHEN n = 0 THEN 1 ELSE n END, 0.0), 9), 6) AS score FROM val v JOIN (
      SELECT impression_id, list(x ORDER BY dim) AS u, sqrt(sum(x * x)) AS n FROM (SELECT impression_id, dim, sum(x * w) / sum(w) AS x FROM (
        SELECT impression_id, exp(-0.1 * (h - 1)) AS w, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM hist JOIN vecs USING (article_id)) GROUP BY ALL) GROUP BY 1) USING (impression_id) LEFT JOIN vecs USING (article_id)"""),
    "impression_metrics": sql("SELECT impression_id, round(auc, 6) AS auc, round(mrr, 6) AS mrr, round(ndcg5, 6) AS ndcg5, round(ndcg10, 6) AS ndcg10 FROM mets"),
    "method_comparison": sql("SELECT method, count(*) AS n, round(avg(auc), 6) AS auc, round(avg(mrr), 6) AS mrr, round(avg(ndcg5), 6) AS ndcg5, round(avg(ndcg10), 6) AS ndcg10 FROM lmets GROUP BY 1"),
    "recall_at_k": sql("""SELECT query_id, round(count_if(rank <= 50) / count(*), 6) AS recall_50, round(count_if(rank <= 100) / count(*), 6) AS recall_100, round(count_if(rank <= 200) / count(*), 6) AS recall_200 FROM (
      SELECT q.article_id AS query_id, r.article_id, h.rank FROM arts q JOIN arts r ON r.subcategory = q.subcategory AND r.category IS NOT NULL AND q.category IS NOT NULL
      LEFT JOIN (SELECT * FROM hits WHERE rank <= 200) h ON h.query_id = q.article_id AND h.article_id = r.article_id WHERE q.article_id IN (SELECT query_id FROM titleq)) GROUP BY 1"""),
    "diversity5": sql("SELECT impression_id, round(avg(1 - list_dot_product(va.vec, vb.vec)), 6) AS diversity FROM top5 a JOIN top5 b USING (impression_id) JOIN vecs va ON va.article_id = a.article_id JOIN vecs vb ON vb.article_id = b.article_id WHERE a.rank < b.rank GROUP BY 1"),
    "novelty5": sql("SELECT impression_id, round(avg(-log2((coalesce(clicks, 0) + 1) / ((SELECT sum(clicks) FROM pop) + (SELECT count(*) FROM arts)))), 6) AS novelty FROM top5 LEFT JOIN pop USING (article_id) GROUP BY 1"),
    "coverage5": sql("SELECT split, round(count(DISTINCT article_id) / (SELECT count(*) FROM arts), 6) AS coverage FROM top5 GROUP BY 1"),
    "hybrid_alpha_grid": sql("SELECT alpha, count(*) AS n, round(avg(auc), 6) AS auc FROM gmets GROUP BY 1"),
    "hybrid_scores": sql("SELECT impression_id, pos, round(0.3 * bm25 + 0.7 * emb, 6) AS score FROM pair"),
    "minmax_fusion": sql("""SELECT impression_id, pos, round(0.5 * CASE WHEN max(bm25) OVER i > min(bm25) OVER i THEN (bm25 - min(bm25) OVER i) / (max(bm25) OVER i - min(bm25) OVER i) ELSE 0 END
      + 0.5 * CASE WHEN max(emb) OVER i > min(emb) OVER i THEN (emb - min(emb) OVER i) / (max(emb) OVER i - min(emb) OVER i) ELSE 0 END, 6) AS score FROM pair WINDOW i AS (PARTITION BY impression_id)"""),
    "train_popularity": sql("SELECT article_id, clicks FROM pop"),
    "hindsight_popularity": sql("SELECT article_id, count(*) AS clicks FROM (SELECT unnest(clicked) AS article_id FROM imps WHERE split IN ('train', 'val')) GROUP BY 1"),
    "session_features": sql("SELECT impression_id, session_ordinal, session_click_count_so_far FROM sess"),
    "history_features": sql("SELECT impression_id, CAST(hist_click_count AS INT) AS hist_click_count, round(recency, 6) AS recency, round(dwell, 4) AS dwell FROM hfeat"),
    "category_match": sql("SELECT impression_id, category, n, round(w, 6) AS w FROM cats"),
    "freshness": sql("SELECT impression_id, pos, round(coalesce((epoch_us(ts) - epoch_us(published_time)) / 3.6e9, 0.0), 6) AS hours, CAST(published_time IS NOT NULL AS INT) AS has_freshness FROM val LEFT JOIN arts USING (article_id)"),
    "feature_table": sql("""SELECT v.impression_id, v.article_id, v.pos, v.label, round(coalesce(bm.score, 0), 5) AS bm25_score, round(coalesce(emb.score, 0), 5) AS embedding_score, v.pos AS candidate_position, CAST(hist_click_count AS INT) AS hist_click_count,
      round(recency, 5) AS hist_recency_weighted_count, coalesce(cats.n, 0) AS hist_category_match, round(coalesce(cats.w, 0), 5) AS hist_category_match_weighted, round(ln(1 + coalesce(clicks, 0)), 5) AS candidate_popularity,
      round(coalesce((epoch_us(v.ts) - epoch_us(published_time)) / 3.6e9, 0.0), 5) AS freshness_hours, CAST(published_time IS NOT NULL AS INT) AS has_freshness, round(dwell, 5) AS hist_avg_dwell_seconds, session_ordinal, session_click_count_so_far
      FROM val v JOIN hfeat USING (impression_id) LEFT JOIN arts USING (article_id) LEFT JOIN pop USING (article_id) LEFT JOIN sess USING (impression_id) LEFT JOIN cats ON cats.impression_id = v.impression_id AND cats.category = arts.category
      LEFT JOIN bm ON bm.impression_id = v.impression_id AND bm.pos = v.pos LEFT JOIN emb ON emb.impression_id = v.impression_id AND emb.pos = v.pos"""),
    "category_entropy": sql("SELECT impression_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM (SELECT impression_id, n / sum(n) OVER (PARTITION BY impression_id) AS p FROM cats) GROUP BY 1"),
    "shown_features": sql(r"""SELECT impression_id, v.article_id, pos, count(*) OVER (PARTITION BY impression_id) AS n_candidates, round(pos / count(*) OVER (PARTITION BY impression_id), 6) AS relative_position,
      CAST(CASE WHEN title IS NULL OR trim(title) = '' THEN 0 ELSE len(regexp_split_to_array(trim(title), '\s+')) END AS INT) AS title_len, round(coalesce(share, 0), 6) AS category_share
      FROM val v LEFT JOIN arts USING (article_id) LEFT JOIN (SELECT category, count(*) / (SELECT count(*) FROM arts WHERE category IS NOT NULL) AS share FROM arts WHERE category IS NOT NULL GROUP BY 1) USING (category)"""),
    "rank_order_by_score": sql("SELECT impression_id, pos, rank FROM ranked"),
    "popularity_rank_order": sql("SELECT impression_id, pos, coalesce(clicks, 0) AS score, CAST(row_number() OVER (PARTITION BY impression_id ORDER BY coalesce(clicks, 0) DESC, pos) AS INT) AS rank FROM val LEFT JOIN pop USING (article_id)"),
    "training_frame": sql("SELECT impression_id, pos, article_id, label FROM cand WHERE split = 'train' AND impression_id IN (SELECT impression_id FROM cand GROUP BY 1 HAVING sum(label) > 0 AND sum(label) < count(*))"),
    "submission_lines": sql("""SELECT seq, any_value(raw_impression_id) || ' [' || string_agg(CAST(rk AS VARCHAR), ',' ORDER BY pos) || ']' AS line FROM (
      SELECT *, row_number() OVER (PARTITION BY seq ORDER BY coalesce(clicks, 0) DESC, pos) AS rk FROM (SELECT seq, raw_impression_id, k - 1 AS pos, c[k] AS article_id FROM (
        SELECT seq, raw_impression_id, c, unnest(range(1, len(c) + 1)) AS k FROM (SELECT raw_impression_id, candidate_article_ids AS c,
          row_number() OVER (ORDER BY "timestamp", impression_id, user_id NULLS FIRST, ingested_at, candidate_article_ids) - 1 AS seq FROM behaviors WHERE clicked_article_ids IS NULL))) LEFT JOIN pop USING (article_id)) GROUP BY seq"""),
    "slice_cold_warm": sql("SELECT CASE WHEN m < 5 THEN 'cold_start' ELSE 'warm' END AS slice, count(*) AS n, round(avg(auc), 6) AS auc, round(avg(mrr), 6) AS mrr FROM mets JOIN (SELECT impression_id, count(*) AS m FROM hist GROUP BY 1) USING (impression_id) GROUP BY 1"),
    "slice_head_tail": sql("""SELECT CASE WHEN coalesce(clicks, 0) < (SELECT quantile_cont(clicks, 0.75) FROM pop) THEN 'tail' ELSE 'head' END AS slice, count(*) AS n, round(avg(auc), 6) AS auc
      FROM mets JOIN (SELECT impression_id, clicked[1] AS article_id FROM imps WHERE len(clicked) > 0) USING (impression_id) LEFT JOIN pop USING (article_id) GROUP BY 1"""),
    "slice_grouping_sets": sql("SELECT dataset, split, count(*) AS n, CAST(sum(len(clicked)) AS BIGINT) AS clicks FROM imps GROUP BY CUBE (dataset, split)"),
    "leaked_history": sql("SELECT i.impression_id, CAST(count(l.article_id) AS INT) AS n_hist, coalesce(string_agg(l.article_id, ' ' ORDER BY l.article_id), '') AS items FROM imps i LEFT JOIN leak l USING (impression_id) WHERE i.split = 'val' GROUP BY 1"),
    "leaked_history_auc": sql("SELECT 'clean' AS kind, round(avg(auc), 6) AS auc FROM mets UNION ALL SELECT 'leaked', round(avg(auc), 6) FROM lkmets"),
    "value_counts": sql("SELECT dataset, category, count(*) AS n FROM arts GROUP BY ALL"),
    "behaviour_stats": """SELECT count(x) AS n, count(*) - count(x) AS nulls, CAST(min(x) AS INT) AS least, CAST(max(x) AS INT) AS greatest, avg(x) AS mean, quantile_cont(x, 0.5)::DOUBLE AS median, count(DISTINCT x) AS distinct_values FROM (SELECT len(candidate_article_ids) AS x FROM behaviors)""",
    "impressions_per_user": """SELECT user_id, count(*) AS n, count(DISTINCT impression_id) AS n_ids, CAST(sum(coalesce(len(clicked_article_ids), 0)) AS BIGINT) AS clicks, min("timestamp") AS first_ts FROM behaviors WHERE user_id IS NOT NULL GROUP BY 1""",
}
CTES["given"] = """SELECT i.impression_id, h.history AS items FROM imps i LEFT JOIN (SELECT user_id, arg_max(history, struct_pack(a := as_of, r := recorded_at, i := history_id)) AS history FROM user_history WHERE user_id IS NOT NULL GROUP BY 1) h USING (user_id) WHERE i.split = 'val'"""
CTES["gitem"] = "SELECT impression_id, k, items[k] AS article_id, len(items) AS n FROM (SELECT *, unnest(range(1, len(items) + 1)) AS k FROM given)"
CTES["gterm"] = r"SELECT impression_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS term FROM gitem JOIN arts USING (article_id) WHERE title IS NOT NULL AND k > n - 10"
CTES["gcount"] = "SELECT impression_id, term, count(*) AS c FROM gterm GROUP BY ALL"
CTES["gbm"] = "SELECT v.impression_id, v.pos, sum(greatest(idf, 0.01) / idf * w * c) AS s FROM val v JOIN imp USING (article_id) JOIN idf USING (term) JOIN gcount g ON g.impression_id = v.impression_id AND g.term = imp.term GROUP BY ALL"
CTES["gcat"] = "SELECT impression_id, coalesce(category, 'UNK') AS category, count(*) AS n FROM gitem JOIN arts USING (article_id) GROUP BY ALL"
CTES["gent"] = "SELECT impression_id, -sum(p * log2(p)) AS e FROM (SELECT impression_id, n / sum(n) OVER (PARTITION BY impression_id) AS p FROM gcat) GROUP BY 1"
CTES["gage"] = "SELECT impression_id, row_number() OVER (PARTITION BY impression_id ORDER BY k DESC) - 1 AS age, vec FROM gitem JOIN vecs USING (article_id)"
CTES["gdim"] = "SELECT impression_id, dim, avg(x) AS x, sum(x * exp(-0.1 * age)) / sum(exp(-0.1 * age)) AS y FROM (SELECT impression_id, age, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM gage) GROUP BY ALL"
CTES["gvec"] = "SELECT impression_id, list(x ORDER BY dim) AS u, sqrt(sum(x * x)) AS n, list(y ORDER BY dim) AS ud, sqrt(sum(y * y)) AS nd FROM gdim GROUP BY 1"
SQL["given_history_features"] = sql("""SELECT v.impression_id, v.article_id, v.pos, v.label, CAST(coalesce(len(items), 0) AS INT) AS hist_len, round(coalesce(e, 0), 5) + 0.0 AS user_cat_entropy, CAST(gcat.n IS NOT NULL AS INT) AS cat_overlap,
  round(coalesce(gcat.n, 0) / greatest(coalesce(len(items), 0), 1), 5) AS cat_overlap_frac, round(coalesce(list_dot_product(u, vec) / gvec.n, 0), 5) AS emb_sim, round(coalesce(list_dot_product(ud, vec) / nd, 0), 5) AS emb_sim_decay,
  round(coalesce(s, 0), 5) AS bm25_score, round(coalesce(clicks, 0) / (SELECT max(clicks) FROM pop), 5) AS popularity, CAST(CASE WHEN title IS NULL OR trim(title) = '' THEN 0 ELSE len(regexp_split_to_array(trim(title), '\\s+')) END AS INT) AS title_len,
  round(coalesce(share, 0), 5) AS cat_freq, round(v.pos / count(*) OVER (PARTITION BY v.impression_id), 5) AS position, count(*) OVER (PARTITION BY v.impression_id) AS n_candidates
  FROM val v LEFT JOIN given USING (impression_id) LEFT JOIN arts USING (article_id) LEFT JOIN gent ON gent.impression_id = v.impression_id LEFT JOIN gcat ON gcat.impression_id = v.impression_id AND gcat.category = CASE WHEN arts.article_id IS NOT NULL THEN coalesce(arts.category, 'UNK') END
  LEFT JOIN (SELECT coalesce(category, 'UNK') AS category, count(*) / (SELECT count(*) FROM arts) AS share FROM arts GROUP BY 1) f ON f.category = coalesce(arts.category, 'UNK') AND arts.article_id IS NOT NULL
  LEFT JOIN pop USING (article_id) LEFT JOIN vecs USING (article_id) LEFT JOIN gvec ON gvec.impression_id = v.impression_id LEFT JOIN gbm ON gbm.impression_id = v.impression_id AND gbm.pos = v.pos""")
SQL["percentile_slices"] = sql("""WITH x AS (SELECT i.impression_id, coalesce(len(items), 0) AS h, coalesce(clicks, 0) AS p FROM (SELECT impression_id, coalesce(list_filter(cands, lambda a: list_contains(clicked, a))[1], cands[1]) AS article_id FROM imps WHERE split = 'val') i
  LEFT JOIN given USING (impression_id) LEFT JOIN pop USING (article_id))
  SELECT impression_id, CASE WHEN h <= (SELECT floor(quantile_cont(h, 0.25)) FROM x) THEN 'cold' ELSE 'warm' END AS history, CASE WHEN p <= (SELECT floor(quantile_cont(p, 0.8)) FROM x) THEN 'tail' ELSE 'head' END AS target FROM x""").replace("\nWITH x AS", ", x AS")
SQL["novelty10"] = sql("SELECT impression_id, round(avg(-log2(greatest(coalesce(clicks / (SELECT sum(clicks) FROM pop), 0), 1e-10))), 6) AS novelty FROM ranked LEFT JOIN pop USING (article_id) WHERE rank <= 10 GROUP BY 1")
SQL["fallback_scores"] = sql("""SELECT v.impression_id, v.pos, round(CASE WHEN e.score IS NULL THEN coalesce(clicks, 0) WHEN vec IS NULL THEN -1e8 + coalesce(clicks, 0) ELSE e.score END, 6) AS score
  FROM val v LEFT JOIN emb e ON e.impression_id = v.impression_id AND e.pos = v.pos LEFT JOIN pop ON pop.article_id = v.article_id LEFT JOIN vecs ON vecs.article_id = v.article_id""")
SQL["tokenize_articles"] = sql("SELECT dl.article_id, CAST(any_value(dl) AS INT) AS n_tokens, CAST(count(term) AS INT) AS n_terms FROM dl LEFT JOIN post ON post.article_id = dl.article_id GROUP BY 1")
SQL["null_audit"] = "SELECT column_name, nulls, n_rows FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS n_rows FROM articles" for c in "article_id dataset title abstract body category subcategory published_time entities sentiment_score total_pageviews total_inviews embedding delivered_at".split()) + ")"
