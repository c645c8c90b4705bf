"""Command line: builds feature stores, runs named evaluations, writes result tables and rank lists."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession

from newsloom.operators import features, lambdamart
from newsloom.plans import core_queries, reference_queries, study_queries
from newsloom.session import release, session, written
from newsloom.sources import ebnerd, mind, sinks
from newsloom.sources.download import download, resolve_scale

#: Target -> the queries whose results it writes.
TARGETS = {
    "eval-bm25": ["recall_bm25", "bm25_candidate_auc"],
    "embeddings": ["emb_norms", "emb_user_vectors"],
    "eval-embeddings": ["recall_embeddings", "emb_candidate_scores"],
    "compare-retrieval": ["recall_compare", "method_comparison"],
    "eval-harness": ["harness_summary", "bootstrap_ci", "slice_cold_warm", "slice_head_tail", "coverage_ci"],
    "leakage-ablation": ["leaked_history_auc", "leakage_violations"],
    "train-reranker": ["ltr_importance", "learned_alpha", "reranker_comparison"],
    "reranker-extended-eval": ["reranker_comparison", "slice_head_tail", "coverage5", "diversity5", "novelty5"],
    "reranker-leakage-ablation": ["ltr_leaked_popularity"],
    "profile": ["null_audit", "value_counts", "behaviour_stats", "impressions_per_user", "describe_articles", "table_metadata"],
}
KNOWN = core_queries.QUERIES | reference_queries.QUERIES  # the studies are registered among the latter


def read_config(path: str) -> dict:
    """A YAML or JSON file of datasets, scales and urls."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def build(spark: SparkSession, dataset: str, scale: str, root: str, store: str, force: bool) -> bool:
    tables = {"mind": lambda: mind.clean_mind(spark, root, resolve_scale(dataset, scale)), "ebnerd": lambda: ebnerd.clean_ebnerd(spark, root)}
    if dataset not in tables:
        raise ValueError(f"unknown dataset: {dataset}")
    return sinks.build_feature_store(spark, tables[dataset](), store, force)


def run(spark: SparkSession, names: list[str], data: str, out: str) -> dict[str, float]:
    """Writes each query's result as a CSV folder; returns the seconds each took."""
    took: dict[str, float] = {}
    for name in names:
        t = time.time()
        sinks.write_csv(KNOWN[name](spark, data), f"{out}/{name}")
        took[name] = round(time.time() - t, 3)
        release()
    return took


def stage_times(spark: SparkSession, data: str, runs: int = 5) -> list[dict]:
    """Median and worst wall seconds of retrieval, features and scoring over whole tables, result sizes, and impressions a second: a batch engine has no single request to time."""
    out = []
    n = reference_queries.Base(spark, data).imps.where("split = 'val'").count()
    for stage, name in (("retrieval", "bm25_candidate_scores"), ("features", "feature_table"), ("scoring", "ltr_scores")):
        took = []
        for _ in range(runs):
            t = time.time()
            rows = KNOWN[name](spark, data)
            rows.write.format("noop").mode("overwrite").save()
            took.append(time.time() - t)
            release()
        took.sort()
        middle = took[len(took) // 2]
        core_s = middle * spark.sparkContext.defaultParallelism
        out.append({"stage": stage, "p50_seconds": round(middle, 3), "worst_seconds": round(took[-1], 3), "impressions": n, "impressions_per_second": round(n / middle, 1), "core_seconds_per_1000_impressions": round(1000 * core_s / max(1, n), 3)})
    return out


def write_features(spark: SparkSession, data: str, out: str) -> None:
    """The ranker's features of both splits, as parquet."""
    for split in ("train", "val"):
        reference_queries._feature_table(spark, data, split).write.mode("overwrite").parquet(f"{out}/features_{split}.parquet")
        release()


def tune(spark: SparkSession, data: str, out: str, trials: int) -> list[dict]:
    """Random search over the published grid: fitted on train, judged on val, best first."""
    frames = [written(reference_queries._feature_table(spark, data, split)) for split in ("train", "val")]
    found = lambdamart.random_search(*frames, features.FEATURES, lambdamart.draws(trials))
    rows = [{**how, "auc": auc} for how, auc in found]
    Path(out).mkdir(parents=True, exist_ok=True)
    sinks.write_json(rows, f"{out}/trials.json")
    return rows


def submission(spark: SparkSession, data: str, out: str, dataset: str, start: int, stop: int | None, method: str = "popularity") -> Path:
    """Scores and writes only the rows from `start` to before `stop`, so a broken run is taken up again where it ended."""
    sinks.write_lines(study_queries.LINES[method](spark, data, start, stop), f"{out}/lines")
    return sinks.zip_lines(f"{out}/lines", f"{out}/{dataset}.zip", dataset)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="newsloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("download", "build"):
        s = sub.add_parser(name)
        s.add_argument("--dataset", required=True)
        s.add_argument("--scale", default="small")
        s.add_argument("--root", required=True)
        s.add_argument("--force", action="store_true")
        s.add_argument("--config" if name == "download" else "--store", required=True)
    for name in [*TARGETS, "reranker-features", "reranker-scale", "tune", "submission", "query"]:
        s = sub.add_parser(name)
        s.add_argument("--data", required=True)
        s.add_argument("--out", required=True)
        if name == "query":
            s.add_argument("names", nargs="+")
        if name == "tune":
            s.add_argument("--trials", type=int, default=12)
        if name == "submission":
            s.add_argument("--dataset", choices=sorted(sinks.INNER_NAMES), default="mind")
            s.add_argument("--method", choices=sorted(study_queries.LINES), default="popularity")
            s.add_argument("--start", type=int, default=0)
            s.add_argument("--stop", type=int)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "download":
        print(download(read_config(a.config), a.dataset, a.scale, Path(a.root), a.force))
        return
    spark = session()
    if a.command == "build":
        print("built" if build(spark, a.dataset, a.scale, a.root, a.store, a.force) else "already there")
    elif a.command == "submission":
        print(submission(spark, a.data, a.out, a.dataset, a.start, a.stop, a.method))
    elif a.command == "reranker-features":
        write_features(spark, a.data, a.out)
    elif a.command == "tune":
        print(tune(spark, a.data, a.out, a.trials))
    elif a.command == "reranker-scale":
        Path(a.out).mkdir(parents=True, exist_ok=True)
        sinks.write_json(stage_times(spark, a.data), f"{a.out}/stages.json")
    else:
        print(run(spark, a.names if a.command == "query" else TARGETS[a.command], a.data, a.out))


if __name__ == "__main__":
    main()
