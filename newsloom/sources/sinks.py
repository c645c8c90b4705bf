"""Result files: rank lists in input order, zip archives, small CSV and JSON tables, the feature store."""

from __future__ import annotations

import json
import shutil
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.metrics import ranked
from newsloom.operators.splits import verify_split_integrity

#: The file name each leaderboard expects inside the archive.
INNER_NAMES = {"mind": "prediction.txt", "ebnerd": "predictions.txt"}


def in_input_order(df: DataFrame) -> DataFrame:
    """A table read from files, with `_file` and `_row`: the order in which its rows were delivered. A filter on `_row` reaches the scan."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def rank_lines(scored: DataFrame) -> DataFrame:
    """`seq`, `line` = `id [r1,r2,...]`: ranks in the order of the candidates, equal scores by position.

    Grouped by `seq`, the impression's place in the input, as raw ids repeat.
    """
    r = ranked(scored, ["seq"])
    lists = r.groupBy("seq").agg(F.first("raw_impression_id").alias("id"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "rank"))), lambda x: x["rank"].cast("string")).alias("r"))
    return lists.select("seq", F.concat("id", F.lit(" ["), F.array_join("r", ","), F.lit("]")).alias("line"))


def write_lines(lines: DataFrame, path: str, start: int = 0, stop: int | None = None) -> None:
    """Text parts in `seq` order; a range of `seq` can be written on its own, so a broken run is taken up again range by range."""
    part = lines.where(F.col("seq") >= start)
    part = part if stop is None else part.where(F.col("seq") < stop)
    part.repartitionByRange("seq").sortWithinPartitions("seq").select("line").write.mode("overwrite").text(path)


def zip_lines(folder: str, archive: str, dataset: str) -> Path:
    """The text parts, in order, as the one file the leaderboard expects."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z, z.open(INNER_NAMES[dataset], "w", force_zip64=True) as out:
        for p in sorted(Path(folder).glob("part-*")):
            with p.open("rb") as f:
                shutil.copyfileobj(f, out)
    return Path(archive)


def write_csv(df: DataFrame, path: str) -> None:
    """A result table of few rows, as one file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(rows: list[dict], path: str) -> None:
    Path(path).write_text(json.dumps(rows, indent=2, default=str))


def build_feature_store(spark: SparkSession, tables: dict[str, DataFrame], path: str, force: bool = False) -> bool:
    """Checks the splits and writes every table; False if the store was complete already."""
    done = Path(path, "articles.parquet", "_SUCCESS")
    if done.exists() and not force:
        return False
    verify_split_integrity([(s, tables[f"behaviors_{s}"]) for s in ("train", "val") if f"behaviors_{s}" in tables], "impression_id", "timestamp")
    for name, df in sorted(tables.items(), key=lambda t: t[0] == "articles"):  # articles last: it marks the store as complete
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return True
