from __future__ import annotations

import datetime as dt
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.errors import InvalidOperation, ShapeMismatch, SourceError
from quillon.operators import frame
from quillon.plans import cli
from quillon.sources import csvfile, excel, frames
from quillon.streaming import files


def test_local_frames(spark):
    df = frames.from_rows(spark, [{"a": None, "b": "x"}, {"a": 2, "c": [1.5]}])
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "array<double>")]
    assert frames.from_columns(spark, {"n": [None, None]}).dtypes == [("n", "double")]
    with pytest.raises(ShapeMismatch):
        frames.from_columns(spark, {"a": [1], "b": [1, 2]})
    assert frames.empty(spark).columns == [] and frames.from_rows(spark, []).count() == 0
    assert [r[0] for r in frames.range_frame(spark, "x", 0, 1, 0.4).collect()] == pytest.approx([0, 0.4, 0.8])
    with pytest.raises(InvalidOperation):
        frames.range_frame(spark, "x", 1, 1)
    assert [r[0] for r in frames.linspace(spark, "x", 0, 1, 3).collect()] == [0.0, 0.5, 1.0]


TEXT = 'id; name ;score;on;seen\n1;"a;""b""\nc";1.5;TRUE;2024-01-02\n2;NA;x;false;2024-01-03T04:05:06Z\n\n3;short\n'


def test_csv_text(spark):
    df = csvfile.read_csv(spark, text=TEXT, dtypes={"score": "f64", "on": "bool", "seen": "date"})
    assert df.columns == ["id", "name", "score", "on", "seen"]
    rows = {r["id"]: tuple(r)[1:] for r in df.collect()}
    assert rows[1] == ('a;"b"\nc', 1.5, True, dt.datetime(2024, 1, 2))
    assert rows[2] == (None, None, False, dt.datetime(2024, 1, 3, 4, 5, 6))
    assert rows[3] == ("short", None, None, None)


def test_csv_options(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("junk\nmore\n# note\na|b\n1|x\n2|y\n3|none\n")
    df = csvfile.read_csv(spark, path, skip_rows=2, comment="#", columns=["b", "zz"])
    assert df.columns == ["b"] and [r[0] for r in df.orderBy("b").collect()] == [None, "x", "y"]
    df = csvfile.read_csv(spark, text="1,2\n3,4\n", has_header=False)
    assert df.columns == ["column_0", "column_1"] and df.count() == 2 and dict(df.dtypes)["column_0"] == "int"
    assert csvfile.read_csv(spark, text="a,b\n1,2\n", header=["x", "y"]).columns == ["x", "y"]
    assert csvfile.read_csv(spark, text="a,b\n1,2\n3,4\n", n_rows=1).count() == 1
    assert csvfile.sniff_delimiter(['a\t"x,y"\tb', "1\t2\t3"]) == "\t"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 'q"uote', None, dt.datetime(2024, 1, 2)), (2.5, "line\nbreak", "", dt.datetime(2024, 1, 3))], "x double, t string, n string, at timestamp_ntz")
    csvfile.write_csv(df, str(tmp_path / "out"))
    back = csvfile.read_csv(spark, str(tmp_path / "out"), dtypes={"x": "f64", "t": "utf8", "n": "utf8", "at": "date"})
    assert sorted(tuple(r) for r in back.collect()) == [(1.0, 'q"uote', None, dt.datetime(2024, 1, 2)), (2.5, "line\nbreak", None, dt.datetime(2024, 1, 3))]
    text = csvfile.to_csv_text(df.limit(1), quote_style="always", null_value="-")
    assert text.split("\n")[1] == '"1","q""uote",-,"2024-01-02T00:00:00.000Z"'
    assert csvfile.to_csv_text(df.select("x"), quote_style="never").startswith("x\n1\n")


def test_json(spark, tmp_path):
    path = tmp_path / "n.json"
    path.write_text(json.dumps({"a": {"b": [{"x": 1}, {"x": 2, "y": "z"}]}}, indent=1))
    assert frames.read_json(spark, str(path), at="a.b").count() == 2
    with pytest.raises(SourceError):
        frames.read_json(spark, str(path), at="a.c")
    assert frames.read_json(spark, text='[{"x": 1}]').first()["x"] == 1
    df = spark.createDataFrame([(1, None)], "x int, y string")
    assert json.loads(frames.to_json_text(df)) == [{"x": 1, "y": None}]
    frames.write_ndjson(df, str(tmp_path / "nd"))
    assert spark.read.text(str(tmp_path / "nd")).first()[0] == '{"x":1,"y":null}'
    (tmp_path / "bad.ndjson").write_text('{"x": 1}\n{"x": \n')
    with pytest.raises(Exception):
        frames.read_ndjson(spark, str(tmp_path / "bad.ndjson"), "x int").collect()


def test_parquet_arrow_and_sql_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "O'x", float("nan"), True), (2, None, 2.0, False)], "i int, t string, d double, b boolean")
    frames.write_parquet(df, str(tmp_path / "p"), compression="gzip")
    assert frames.read_parquet(spark, str(tmp_path / "p"), ["t"]).columns == ["t"]
    assert frames.from_arrow_ipc(spark, frames.to_arrow_ipc(df)).count() == 2
    table = pa.table({"k": pa.array(["a", "b"]).dictionary_encode()})
    assert [r[0] for r in frames.from_arrow(spark, table).collect()] == ["a", "b"]
    text = frames.to_sql_text(df, "t", 1, order_by="i")
    assert text == 'INSERT INTO "t" ("i", "t", "d", "b") VALUES\n(1, \'O\'\'x\', NULL, TRUE);\nINSERT INTO "t" ("i", "t", "d", "b") VALUES\n(2, NULL, 2, FALSE);'
    assert frames.to_sql_text(df.limit(0), "t", order_by="i") == ""


def test_excel_round_trip(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    df = spark.createDataFrame([(1, "a<b", 2.5, True), (2, None, None, False)], "i int, t string, d double, b boolean")
    excel.write_excel(df, path, sheet="S & T", auto_filter=True, freeze_panes=(1, 0), column_widths={"t": 20}, start_cell="B2")
    assert excel.sheet_names(path) == ["S & T"]
    back = excel.read_excel(spark, path, sheet="S & T", range_="B2:E4", dtypes={"i": "i32"})
    assert [tuple(r) for r in back.collect()] == [(1, "a<b", 2.5, True), (2, None, None, False)]
    assert excel.cell_place("AB12") == (11, 27) and excel.cell_name(11, 27) == "AB12"
    with pytest.raises(SourceError):
        excel.read_excel(spark, path, sheet="none")


def test_registry_and_cli(spark, tmp_path, capsys):
    frames.register_reader("lines", lambda s, p: s.read.text(p))
    (tmp_path / "a.lines").write_text("x\ny\n")
    assert frames.from_file(spark, str(tmp_path / "a.lines")).count() == 2
    with pytest.raises(SourceError):
        frames.from_file(spark, "a.unknown")
    kept = {}
    frames.register_writer("keep", lambda df, p: kept.update({p: df.count()}))
    frames.to_file(spark.range(3).toDF("i"), "x.keep")
    assert kept == {"x.keep": 3}
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n2,y\n")
    assert cli.main(["query", f"SELECT b FROM '{path}' WHERE a > 1", "--format", "csv"]) == 0
    assert capsys.readouterr().out == "b\ny\n"
    assert cli.main(["query", "SELECT b", "--format", "csv"]) == 1


def test_streams_agree_with_batch(spark, tmp_path):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("k"))
    df.repartition(5).write.option("header", "true").csv(str(tmp_path / "in"))
    stream = files.stream_csv(spark, str(tmp_path / "in"), "id bigint, k bigint", files_per_batch=2)
    sizes: list[int] = []
    files.run_to_end(stream, str(tmp_path / "c1"), lambda batch, _: sizes.append(batch.count()))
    assert sum(sizes) == 200 and len(sizes) > 1
    files.sink_files(stream.where("k = 1"), str(tmp_path / "out"), str(tmp_path / "c2"), "json")
    assert files.scan_ndjson(spark, str(tmp_path / "out"), "id bigint, k bigint").count() == df.where("k = 1").count()
    assert [len(x) for x in frames.chunks(df, 90)] == [90, 90, 20]


def test_sessions(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("u", 1, at), ("u", 2, at + dt.timedelta(minutes=30)), ("u", 3, at + dt.timedelta(minutes=61)), ("v", 4, at)]
    df = spark.createDataFrame(rows, "u string, i int, ts timestamp_ntz")
    out = {r["i"]: r["session"] for r in files.sessions(df, "u", "ts", ["i"]).collect()}
    assert out == {1: 1, 2: 1, 3: 2, 4: 1}
    assert files.session_windows(df, "u", "ts", 31).count() == 2


def test_json_documents_keep_every_row(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('a "q" ['), "id")).alias("t")).repartition(5)
    for kind in ("json", "ndjson"):
        frames.to_file(df, str(tmp_path / f"x.{kind}"))
        back = frames.from_file(spark, str(tmp_path / f"x.{kind}"))
        assert sorted(map(tuple, back.select("id", "t").collect())) == sorted(map(tuple, df.collect())), kind
    documents = [json.loads(p.read_text()) for p in (tmp_path / "x.json").glob("part-*")]
    assert sum(map(len, documents)) == 1000 and documents[0][0].keys() == {"id", "t"}
    frames.to_file(df.limit(0), str(tmp_path / "none.json"))
    assert frames.from_file(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert frames.from_file(spark, str(tmp_path / "lines.json")).count() == 3


def test_csv_files_are_split_unless_quotes_hold_line_breaks(spark, tmp_path):
    flat, folded = tmp_path / "flat.csv", tmp_path / "folded.csv"
    flat.write_text("a,b\n" + "".join(f'{i},"x, {i}"\n' for i in range(20_000)))
    folded.write_text('a,b\n1,"x\ny"\n2,z\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = csvfile.read_csv(spark, str(flat))
        assert df.rdd.getNumPartitions() > 3 and df.count() == 20_000
        assert csvfile.read_csv(spark, str(flat), skip_rows=1, has_header=False).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in csvfile.read_csv(spark, str(folded)).collect()] == [(1, "x\ny"), (2, "z")]
    assert [tuple(r) for r in csvfile.read_csv(spark, str(folded), skip_rows=1, header=["p", "q"], has_header=False).collect()] == [(1, "x\ny"), (2, "z")]


def test_csv_skips_lines_of_every_file_and_indented_comments(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"made by hand\n//x\n  // note\na;b\n{i};1\n\n // more\n{i};2\n")
    df = csvfile.read_csv(spark, str(tmp_path), skip_rows=1, comment="//")
    assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect())) == [(i, b) for i in range(3) for b in (1, 2)]


def test_csv_values_that_do_not_fit_the_sampled_type(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n" + "1,x\n" * 150 + "oops,y\n,z\n")
    assert csvfile.read_csv(spark, str(path)).where("a IS NULL").count() == 2
    assert [tuple(r) for r in csvfile.read_csv(spark, str(path), on_bad="column").where("size(_misfits) > 0").collect()] == [(None, "y", ["a"])]
    with pytest.raises(Exception, match="oops"):
        csvfile.read_csv(spark, str(path), on_bad="raise").collect()


def test_csv_from_an_open_file_and_by_address(spark, tmp_path):
    import io
    import threading
    from functools import partial
    from http.server import HTTPServer, SimpleHTTPRequestHandler

    assert csvfile.read_csv(spark, text=io.BytesIO(b"a,b\n1,2\n")).first()["b"] == 2
    (tmp_path / "x.csv").write_text("a,b\n3,4\n")
    with HTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(tmp_path))) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        assert csvfile.read_csv(spark, f"http://127.0.0.1:{server.server_port}/x.csv").first()["a"] == 3
        server.shutdown()


def test_shown_tables_say_what_they_leave_out(spark, capsys):
    df = spark.range(50).withColumn("t", F.when(F.col("id") > 0, "x" * 60))
    text = frames.to_string(df, 3, 2, order_by="id")
    assert "50 rows x 2 columns, 45 rows not shown" in text and "null" in text and "…" in text and "| 49" in text
    frames.show(df.limit(2))
    assert "not shown" not in capsys.readouterr().out
    with pytest.raises(InvalidOperation):
        frames.to_string(df, 3, 2)


def test_columns_from_functions_of_columns_and_from_values(spark):
    df = spark.range(100).repartition(4)
    out = frame.series_apply(df, "twice", lambda x: x * 2, ["id"], "bigint")
    assert out.where("twice <> 2 * id").count() == 0
    named = frame.with_values(df, "name", [f"n{i}" for i in range(100)], "id")
    assert named.columns == ["id", "name"] and named.where("name <> 'n' || id").count() == 0 and named.count() == 100
    with pytest.raises(ShapeMismatch):
        frame.with_values(df, "name", [1], "id")
    a, b = spark.range(5).select("id", F.lit("l").alias("side")), spark.range(5).select((F.col("id") * 10).alias("ten"), F.lit("r").alias("side"))
    assert sorted(map(tuple, frame.assign(a, b, "id", "ten").collect())) == [(i, "r", i * 10) for i in range(5)]
    with pytest.raises(ShapeMismatch):
        frame.assign(a, b.limit(3), "id", "ten")
