"""Loading delimited records while setting aside those that can't be parsed, with the reason.

Records are assembled quote-aware, each is read with Python's strict csv reader
inside a partition, structural exceptions become reasons, and only then the typed
constructors of the fields run. Good and bad rows come from one pass.

Assembly joins physical lines while a quote is open. A line that is a whole record
by itself (closed, with the right number of fields) always is one, so a stray quote
spoils no more than the lines up to the next such line; and a record has at most
MAX_LINES lines. Where it isn't closed by then, its first line stands alone and is
rejected as `quoting`, and assembly goes on with the line after it. Tables with a
row a record (`parse_records`) are assembled with one line at most; files
(`read_records`) are cut before each whole line, and the parts are assembled where
they fall, line by line.

Defined results: a null or empty line has one empty field, so its reason is
`columns`; repeated lines are judged each; a line of any length is read whole; an
empty table gives no rows; extra columns are ignored. Entity fields are lists of
(label, wikidata_id, confidence, offsets), empty for an empty field; an offset beyond
64 bits is null.
"""

from __future__ import annotations

import csv
import datetime as dt
import json
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import shuffle_parts, written

csv.field_size_limit(2**31 - 1)
#: A record of a file has at most so many physical lines.
MAX_LINES = 1_000
_BREAKS = str.maketrans("\r\n", "\x01\x01")
_CONTROL = re.compile("[\x00-\x08\x0a-\x1f\x7f�]")
_NEWS_ID, _USER_ID, _ENTITY_ID, _DIGITS = (re.compile(p) for p in ("N[0-9]+", "U[0-9]+", "Q[0-9]+", "[0-9]+"))
_HISTORY = re.compile("N[0-9]+(?: N[0-9]+)*")
_LABELLED, _BARE = re.compile("N[0-9]+-[01](?: N[0-9]+-[01])*"), _HISTORY
_TIME = re.compile("([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}):([0-9]{2}):([0-9]{2}) (AM|PM)")


def fields_of(line: str | None, delimiter: str = "\t") -> list[str]:
    """The fields of one record; raises csv.Error where its quoting is broken."""
    if not line:
        return [""]
    # csv ends a record at a bare line break; here a break is content, and like any control character it is judged by the field rules.
    return next(csv.reader([line.translate(_BREAKS)], delimiter=delimiter, quotechar='"', doublequote=True, strict=True))


def _strict_json(text: str):
    def refuse(name: str):
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def entities(text: str) -> list[dict]:
    if text == "":
        return []
    try:
        found = _strict_json(text)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    if not isinstance(found, list):
        raise ValueError("no array")
    out = []
    for x in found:
        if not isinstance(x, dict):
            raise ValueError("no object")
        label, wiki, conf, offsets = (x.get(k) for k in ("Label", "WikidataId", "Confidence", "OccurrenceOffsets"))
        if not (isinstance(label, str) and label and isinstance(wiki, str) and _ENTITY_ID.fullmatch(wiki)):
            raise ValueError("label or id")
        if isinstance(conf, bool) or not isinstance(conf, int | float) or not 0 <= conf <= 1:
            raise ValueError("confidence")
        if not isinstance(offsets, list) or any(isinstance(o, bool) or not isinstance(o, int) or o < 0 for o in offsets):
            raise ValueError("offsets")
        out.append({"label": label, "wikidata_id": wiki, "confidence": float(conf), "offsets": [o if o < 2**63 else None for o in offsets]})
    return out


def clock(text: str) -> dt.datetime:
    m = _TIME.fullmatch(text)
    if not m:
        raise ValueError("time")
    month, day, year, hour, minute, second = map(int, m.groups()[:6])
    if not 1 <= hour <= 12:
        raise ValueError("hour")
    return dt.datetime(year, month, day, hour % 12 + 12 * (m[7] == "PM"), minute, second)


def _need(pattern: re.Pattern, text: str) -> None:
    if not pattern.fullmatch(text):
        raise ValueError(pattern.pattern)


def news_row(f: list[str], split: str | None) -> tuple:
    _need(_NEWS_ID, f[0])
    if not f[1]:
        raise ValueError("category")
    return (*f, entities(f[6]), entities(f[7]))


def behavior_row(f: list[str], split: str | None) -> tuple:
    _need(_DIGITS, f[0])
    _need(_USER_ID, f[1])
    at = clock(f[2])
    if f[3]:
        _need(_HISTORY, f[3])
    _need(_BARE if split == "test" else _LABELLED, f[4])
    shown = f[4].split(" ")
    labelled = split != "test"
    return (f[0], f[1], at, f[3].split(" ") if f[3] else [], [x[:-2] for x in shown] if labelled else shown, [x[:-2] for x in shown if x[-1] == "1"] if labelled else None)


NEWS = T.StructType([T.StructField(n, T.StringType()) for n in ("news_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities")])
ENTITY = T.StructType([T.StructField("label", T.StringType()), T.StructField("wikidata_id", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("offsets", T.ArrayType(T.LongType()))])
for _name in ("title_entity_list", "abstract_entity_list"):
    NEWS = NEWS.add(_name, T.ArrayType(ENTITY))
BEHAVIOR = T.StructType(
    [T.StructField("impression_id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("time", T.TimestampNTZType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("history", "candidates", "clicked")]
)
#: Per kind: number of fields, typed constructor, type of a loaded row.
KINDS: dict[str, tuple[int, Callable[[list[str], str | None], tuple], T.StructType]] = {"news": (8, news_row, NEWS), "behavior": (5, behavior_row, BEHAVIOR)}


def judge(line: str | None, split: str | None, kind: str) -> tuple[str | None, tuple | None]:
    """(reason, None) or (None, typed row) of one assembled record. The first broken rule of quoting, columns, value is the reason."""
    width, build, _ = KINDS[kind]
    try:
        f = fields_of(line)
    except csv.Error:
        return "quoting", None
    if len(f) != width:
        return "columns", None
    try:
        if any(_CONTROL.search(x) for x in f):
            raise ValueError("control character")
        return None, build(f, split)
    except (ValueError, OverflowError):
        return "value", None


def parse_records(df: DataFrame, kind: str, line: str = "line", split: str = "split", id_col: str = "line_id", typed: bool = True) -> DataFrame:
    """`line_id`, `reason` (null for a loaded row) and, if `typed`, `row` (the typed struct, null for a rejected one).

    A row of `df` is one line of the assembly, which joins nothing here; line breaks inside it belong to it.
    """
    width, _, loaded = KINDS[kind]
    schema = T.StructType([T.StructField("line_id", df.schema[id_col].dataType), T.StructField("reason", T.StringType()), *([T.StructField("row", loaded)] if typed else [])])
    names = loaded.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = ((k, x if isinstance(x, str) else "") for k, x in enumerate(b["line"]))
            found = [judge(x, s, kind) if closed else ("quoting", None) for (_, x, closed), s in zip(assembled(lines, width, max_lines=1), b["split"], strict=True)]
            out = pd.DataFrame({"line_id": b["line_id"], "reason": pd.Series([r for r, _ in found], dtype=object)})
            if typed:
                out["row"] = pd.Series([None if v is None else dict(zip(names, v, strict=True)) for _, v in found], dtype=object)
            yield out

    picked = df.select(F.col(id_col).alias("line_id"), F.col(split).alias("split"), F.col(line).alias("line"))
    return picked.mapInPandas(run, schema)


def rejected(df: DataFrame, kind: str, **cols: str) -> DataFrame:
    return parse_records(df, kind, typed=False, **cols).where("reason is not null").select(F.lit(kind).alias("line_kind"), "line_id", "reason")


def loaded(df: DataFrame, kind: str, **cols: str) -> DataFrame:
    return parse_records(df, kind, **cols).where("reason is null").select("line_id", "row.*")


def quote_moves(line: str, delimiter: str = "\t") -> tuple[bool, bool]:
    """Whether a record is still open at the end of this physical line, if it was closed or open at its start."""

    def after(is_open: bool) -> bool:
        at = 0
        while True:
            if not is_open:
                while not line.startswith('"', at):
                    at = line.find(delimiter, at) + 1
                    if not at:
                        return False
                at += 1
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line.startswith('"', at + 1):
                    at += 2
                    continue
                break
            is_open, at = False, line.find(delimiter, at + 1) + 1
            if not at:
                return False

    return after(False), after(True)


def stands_alone(line: str, width: int | None, delimiter: str = "\t") -> bool:
    """Whether a physical line is a whole record: closed, with `width` fields; without a width that can't be told."""
    if width is None:
        return False
    if '"' not in line:
        return line.count(delimiter) == width - 1
    try:
        return not quote_moves(line, delimiter)[0] and len(fields_of(line, delimiter)) == width
    except csv.Error:
        return False


def assembled(lines: Iterable[tuple[int, str]], width: int | None, max_lines: int = MAX_LINES, delimiter: str = "\t") -> Iterator[tuple[int, str, bool]]:
    """(number of the first line, record, whether its quotes are closed) of the physical lines (number, text) of one file, in order."""
    held: deque[tuple[int, str]] = deque()  # the lines of the record being assembled, then lines to be read again
    ahead = iter(lines)
    while True:
        first = held.popleft() if held else next(ahead, None)
        if first is None:
            return
        is_open, used, end = '"' in first[1] and quote_moves(first[1], delimiter)[0], [], False
        while is_open and len(used) + 1 < max_lines and not end:
            more = held.popleft() if held else next(ahead, None)
            if more is None or stands_alone(more[1], width, delimiter):
                end = True
                if more is not None:
                    held.appendleft(more)
            else:
                used.append(more)
                is_open = quote_moves(more[1], delimiter)[1]
        if is_open:
            held.extendleft(reversed(used))
            yield *first, False
        else:
            yield first[0], "\n".join([first[1], *(x for _, x in used)]), True


def assemble_lines(lines: DataFrame, width: int | None = None, file: str = "file", line_no: str = "line_no", value: str = "value", max_lines: int = MAX_LINES, block_lines: int = 100_000) -> DataFrame:
    """`file`, `line_no` (of the first line) and `value` of each record; quoted fields may span lines. Without a `width` a file is one part, read line by line in one task."""
    whole = F.pandas_udf(lambda v: pd.Series([stands_alone(x or "", width) for x in v], dtype=bool), "boolean")
    m = lines.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), F.coalesce(F.col(value), F.lit("")).alias("value"))
    m = written(m.withColumn("_whole", whole("value").cast("long")).withColumn("_block", F.floor(F.col("line_no") / block_lines)))
    # A part is a whole line and what follows it up to the next one: numbered within blocks, which are then added up.
    in_block = Window.partitionBy("file", "_block").orderBy("line_no")
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = m.groupBy("file", "_block").agg(F.sum("_whole").alias("n")).select("file", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    m = m.withColumn("_part", F.sum("_whole").over(in_block)).join(base, ["file", "_block"]).withColumn("_part", F.col("_part") + F.col("_base"))
    parts = m.repartition(shuffle_parts(lines.sparkSession), "file", "_part").sortWithinPartitions("file", "_part", "line_no").select("file", "_part", "line_no", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b["file"], b["_part"], b["line_no"], b["value"], strict=True))
        out: list[tuple] = []
        for (name, _), part in groupby(rows, key=lambda r: r[:2]):
            for no, text, _ in assembled(((r[2], r[3]) for r in part), width, max_lines):
                out.append((name, no, text))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["file", "line_no", "value"])
                    out = []
        yield pd.DataFrame(out, columns=["file", "line_no", "value"])

    return parts.mapInPandas(run, "file string, line_no long, value string")


def read_records(spark, path: str, kind: str, split: str) -> DataFrame:
    """Records of text files at `path`, assembled and parsed: `line_id` is the record's place in its file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    records = assemble_lines(raw, KINDS[kind][0]).withColumn("split", F.lit(split))
    return parse_records(records, kind, line="value", id_col="line_no")
