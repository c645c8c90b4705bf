import csv
import datetime as dt
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.sources.records import assemble_lines, assembled, fields_of, judge, loaded, parse_records, quote_moves, read_records, rejected

GOOD = '[{"Label": "A", "WikidataId": "Q1", "Confidence": 0.5, "OccurrenceOffsets": [0, 3]}]'
news = lambda *f: "\t".join(["N1", "c", "s", "t", "a", "u", GOOD, "[]"][: 8 - len(f)] + list(f)) if f else "\t".join(["N1", "c", "s", "t", "a", "u", GOOD, "[]"])


def reason(line, kind="news", split="train"):
    return judge(line, split, kind)[0]


def by_hand(line):
    """The quoting rule, character by character: the fields, or None."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, field = i + 1, ""
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                field += line[i:j]
                if line[j + 1 : j + 2] == '"':
                    field, i = field + '"', j + 2
                    continue
                i = j + 1
                break
            if i < len(line) and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            field, i = line[i:j], j
        out.append(field)
        if i >= len(line):
            return out
        i += 1


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='a"\t\r\n ', max_size=14))
def test_fields_follow_the_quoting_rule(line):
    try:
        got = fields_of(line)
    except csv.Error:
        got = None
    want = by_hand(line)
    assert got == (want and [f.translate({13: 1, 10: 1}) for f in want])


@pytest.mark.parametrize(
    ("line", "want"),
    [
        (news(), None), (None, "columns"), ("", "columns"), (news() + "\tx", "columns"), ('"' + news(), "quoting"), (news().replace("\tt\t", '\t"t"x\t'), "quoting"),
        (news().replace("\tt\t", '\t"t\tx"\t'), None), (news().replace("\tt\t", "\tt\x07\t"), "value"), (news().replace("\tt\t", "\tt\r\t"), "value"), (news().replace("\tt\t", "\t�\t"), "value"),
        (news().replace("\tt\t", "\ta \"quoted\" word\t"), None), (news().replace("N1", "X1"), "value"), (news().replace("N1", "N١"), "value"), (news().replace("\tc\t", "\t\t"), "value"),
        (news("", ""), None), (news("", "{}"), "value"), (news("", "[NaN]"), "value"), (news(GOOD.replace("0.5", "1.5"), ""), "value"), (news(GOOD.replace("0.5", "true"), ""), "value"), (news(GOOD.replace("0.5", "NaN"), ""), "value"),
        (news(GOOD.replace("Q1", "Qx"), ""), "value"), (news(GOOD.replace("[0, 3]", "[0, -3]"), ""), "value"), (news(GOOD.replace("[0, 3]", "[0.0]"), ""), "value"), (news(GOOD.replace('"A"', '""'), ""), "value"),
        (news(GOOD.replace('"Label"', '"Extra": {"x": null}, "Label"'), ""), None), (news(GOOD[:-1] + ",]", ""), "value"), (news(f'"{GOOD.replace(chr(34), chr(34) * 2)}"', ""), None), ("[" * 100_000, "columns"), (news("[" * 100_000, ""), "value"),
    ],
)
def test_news_rules(line, want):
    assert reason(line) == want


@pytest.mark.parametrize(
    ("fields", "split", "want"),
    [
        (("1", "U1", "3/5/2019 11:42:22 AM", "N1 N2", "N1-0 N2-1"), "train", None), (("1", "U1", "03/05/2019 01:42:22 PM", "", "N1-0"), "val", None), (("1", "U1", "3/5/2019 11:42:22 AM", "", "N1 N2"), "test", None),
        (("1", "U1", "3/5/2019 11:42:22 AM", "", "N1-0"), "test", "value"), (("1", "U1", "3/5/2019 11:42:22 AM", "", "N1"), "train", "value"), (("1", "U1", "3/5/2019 11:42:22 AM", "N1  N2", "N1-0"), "train", "value"),
        (("1", "U1", "2/29/2019 11:42:22 AM", "", "N1-0"), "train", "value"), (("1", "U1", "3/5/2019 13:42:22 AM", "", "N1-0"), "train", "value"), (("1", "U1", "3/5/2019 0:42:22 AM", "", "N1-0"), "train", "value"),
        (("1", "U1", "3/5/2019 11:60:22 AM", "", "N1-0"), "train", "value"), (("x", "U1", "3/5/2019 11:42:22 AM", "", "N1-0"), "train", "value"), (("1", "", "3/5/2019 11:42:22 AM", "", "N1-0"), "train", "value"), (("1", "U1", "3/5/2019 11:42:22 AM", "", ""), "train", "value"),
    ],
)
def test_behavior_rules(fields, split, want):
    assert reason("\t".join(fields), "behavior", split) == want


def test_loaded_rows_and_rejects_are_everything(spark):
    lines = ["1\tU1\t3/5/2019 12:00:00 AM\tN1\tN1-0 N2-1", "bad", "2\tU2\t3/5/2019 12:00:00 PM\t\tN3"]
    df = spark.createDataFrame([(i, "test" if i == 2 else "train", x, "r") for i, x in enumerate(lines)] + [(9, None, None, "r")], "line_id long, split string, line string, reason string")
    assert {(r["line_id"], r["reason"]) for r in rejected(df, "behavior").collect()} == {(1, "columns"), (9, "columns")}
    rows = {r["line_id"]: r for r in loaded(df, "behavior").collect()}
    assert rows[0]["time"] == dt.datetime(2019, 3, 5) and rows[0]["candidates"] == ["N1", "N2"] and rows[0]["clicked"] == ["N2"]
    assert rows[2]["time"] == dt.datetime(2019, 3, 5, 12) and rows[2]["clicked"] is None and rows[2]["history"] == []
    assert parse_records(df.limit(0), "behavior").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a"\t', max_size=10), st.booleans())
def test_quote_moves(line, is_open):
    state, start = is_open, not is_open
    i = 0
    while i < len(line):
        c = line[i]
        if state:
            if c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    state, start = False, False
        elif c == "\t":
            start = True
        elif c == '"' and start:
            state = True
        else:
            start = False
        if not state and c != "\t":
            start = False
        i += 1
    assert quote_moves(line)[is_open] == state


def test_assembled_records_equal_the_csv_reader(spark, tmp_path):
    text = 'a\t"x\ny"\tb\nplain\n"one ""q"" two\n\nthree"\tz\n' * 40
    lines = text.split("\n")[:-1]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("g", 0, 'only "here'), ("g", 1, '"open'), ("g", 2, "end")], "file string, line_no long, value string")
    got = [r["value"] for r in assemble_lines(df, block_lines=7).where("file = 'f'").orderBy("line_no").collect()]
    want = list(csv.reader(io.StringIO(text), delimiter="\t"))
    assert [next(csv.reader(io.StringIO(g), delimiter="\t")) for g in got] == want
    assert [r["value"] for r in assemble_lines(df, block_lines=2).where("file = 'g'").orderBy("line_no").collect()] == ['only "here', '"open', "end"]
    (tmp_path / "b.tsv").write_text('1\tU1\t3/5/2019 1:00:00 AM\t"N1"\tN1-0\n2\t"U2\nx"\t\t\t\n')
    assert sorted((r["reason"] or "") for r in read_records(spark, str(tmp_path / "b.tsv"), "behavior", "train").collect()) == ["", "value"]


def test_a_stray_quote_spoils_no_more_than_its_own_line(spark):
    good = "1\tU1\t3/5/2019 1:00:00 AM\t\tN1-0"
    split = ['2\t"U2', 'x"\t3/5/2019 1:00:00 AM\t\tN1-0']
    lines = [good, '3\t"stray', good, *split, "", '4\t"U3', *["more"] * 30, good]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")
    got = {r["line_no"]: r["value"] for r in assemble_lines(df, 5, block_lines=3).collect()}
    want = {i: x for i, x in enumerate(lines) if i not in (3, 4)} | {3: "\n".join(split)}
    assert got == want


def test_records_have_bounded_length():
    lines = list(enumerate(['a\t"b', *["x"] * 9, 'c"', "d"]))
    assert [r[:2] for r in assembled(lines, 2, max_lines=11)] == [(0, "\n".join(x for _, x in lines[:11])), (11, "d")]
    short = list(assembled(lines, 2, max_lines=10))
    assert short[0] == (0, 'a\t"b', False) and [(n, x) for n, x, _ in short] == lines


def test_entities_come_out_typed(spark):
    (r,) = loaded(spark.createDataFrame([(1, "train", news())], "line_id long, split string, line string"), "news").collect()
    assert [tuple(e) for e in r["title_entity_list"]] == [("A", "Q1", 0.5, [0, 3])]
    (r,) = loaded(spark.createDataFrame([(1, "train", news(GOOD.replace("[0, 3]", "[7, 99999999999999999999999]"), ""))], "line_id long, split string, line string"), "news").collect()
    assert r["title_entity_list"][0]["offsets"] == [7, None] and r["abstract_entity_list"] == []
