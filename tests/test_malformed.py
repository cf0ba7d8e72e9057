from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.operators.malformed import NULL_TOKENS, Patterns, RecordSchema, classify, digits_up_to, failed_rows, valid_rows

SCHEMA = RecordSchema((("name", "string"), ("note", "string"), ("value", "int"), ("ok", "boolean")), ";")


def scan(line: str) -> str | None:
    """A character-by-character reading of the rules: the reason a record fails, or None."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            text = ""
            while True:
                if i >= n:
                    return "quoting"
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        text += '"'
                        i += 2
                        continue
                    i += 1
                    break
                text += line[i]
                i += 1
            if i < n and line[i] != ";":
                return "quoting"
        else:
            end = line.find(";", i)
            end = n if end < 0 else end
            text = line[i:end]
            if '"' in text:
                return "quoting"
            i = end
        fields.append(text)
        if i >= n:
            break
        i += 1
    if len(fields) != 4:
        return "columns"
    number, flag = fields[2], fields[3]
    if number not in NULL_TOKENS and not (re.fullmatch("[+-]?[0-9]+", number.strip(" ")) and -(2**31) <= int(number) < 2**31):
        return "value"
    if flag not in NULL_TOKENS and flag.lower() not in ("true", "false"):
        return "value"
    return None


LINES = [
    "a;b;1;true", '"a";"b;""x""";-2147483648;FALSE', "a;b;2147483648;true", "a;b; +07 ;NA", 'a";b;1;true', '"a"x;b;1;true', '"a;b;1;true', "a;b;1", "a;b;1;true;9", "a;b;1.0;true",
    "a;b;١;true", "a;b;;", 'a;"two\nlines";3;true', "a;b;1;yes", "a;b;NA ;true", "a;b;1; true", 'a;b;"";""', "a;b;-0;true", "a;b;000000000000000000001;true", ";;;", 'a;\\"b;1;true', "a;b;--1;true",
]


def test_reasons_agree_with_a_scanner(spark):
    df = spark.createDataFrame([(i, line, 7) for i, line in enumerate(LINES)], "id long, raw_line string, name int")
    got = {r["id"]: r["reason"] for r in classify(df, SCHEMA).collect()}
    assert got == {i: scan(line) for i, line in enumerate(LINES)}


def test_random_records_agree_with_a_scanner(spark):
    found: list[str] = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet='ab";\n 12-+.tru', min_size=1, max_size=14))
    def collect(line: str) -> None:
        if line.strip():
            found.append(line)

    collect()
    found += [f"x;y;{line}" for line in found]
    df = spark.createDataFrame(list(enumerate(found)), "id long, raw_line string")
    for r in classify(df, SCHEMA).collect():
        line = re.sub(r"\r?\n\Z", "", r["raw_line"])
        assert r["reason"] == scan(line), repr(line)


def test_rows_blank_lines_and_clashing_names(spark):
    lines = [(1, None), (2, "  \t"), (3, "\n"), (4, '"a ""b""";NA;12;True\r\n'), (5, "x;y;oops;true")]
    df = spark.createDataFrame([(i, x, 9) for i, x in lines], "id long, raw_line string, name int")
    cl = classify(df, SCHEMA)
    (row,) = valid_rows(cl, SCHEMA).collect()
    assert row.asDict() == {"id": 4, "name": 9, "name_parsed": 'a "b"', "note": None, "value": 12, "ok": True}
    (bad,) = failed_rows(cl).collect()
    assert (bad["id"], bad["reason"], bad["broken_field"]) == (5, "value", "value")
    assert failed_rows(classify(df.limit(0), SCHEMA)).count() == 0


def test_broken_fields(spark):
    cases = {'a;b"c;1;true': "note", "a;b": "value", "a;b;1;true;z": "(beyond)", "a;b;x;nope": "value", "a;b;1;nope": "ok", '"a;b;1;true': "name"}
    df = spark.createDataFrame([(k,) for k in cases], "raw_line string")
    assert {r["raw_line"]: r["broken_field"] for r in classify(df, SCHEMA).collect()} == cases


def test_very_long_records_need_no_stack(spark):
    long_quoted = '"' + 'ab""' * 300_000 + '";b;1;true'
    many = "a;" * 200_000 + "b"
    df = spark.createDataFrame([(1, long_quoted), (2, many), (3, '"' + '""' * 200_000 + "x;b;1;true")], "id long, raw_line string")
    assert {r["id"]: r["reason"] for r in classify(df, SCHEMA).select("id", "reason").collect()} == {1: None, 2: "columns", 3: "quoting"}


def test_number_pattern_is_exact():
    pattern = re.compile(digits_up_to(2147))
    assert [n for n in range(1, 3000) if pattern.fullmatch(str(n))] == list(range(1, 2148))
    assert Patterns(SCHEMA).whole.startswith("\\A")
