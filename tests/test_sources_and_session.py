import datetime
import zipfile
from collections import Counter

import pytest

from tessera.operators.filters import FilterSpec
from tessera.plans.session import Session
from tessera.sources import files
from tessera.streaming.counts import run_available, windowed_counts


def workbook(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c></row><row><c r="B3"><v>4</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


def test_readers(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    df = files.read(spark, str(tmp_path / "w.xlsx"))
    assert df.dtypes == [("name", "string"), ("n", "bigint")] and sorted(map(tuple, df.collect()), key=repr) == [("ab", 3), (None, 4)]
    (tmp_path / "t.csv").write_text('a,b\n1,"x ""q"""\n2,"two\nlines"\n')
    assert [tuple(r) for r in files.read(spark, str(tmp_path / "t.csv")).orderBy("a").collect()] == [(1, 'x "q"'), (2, "two\nlines")]
    with pytest.raises(ValueError):
        files.read(spark, "t.h5")


def test_json_tables(spark):
    df = spark.createDataFrame([(2, None, datetime.datetime(2024, 1, 1)), (1, "s", None)], "k long, s string, t timestamp")
    found = files.to_json(df, "k", 1)
    assert found == {"columns": ["k", "s", "t"], "rows": [{"k": 1, "s": "s", "t": ""}], "total_rows": 2, "returned_rows": 1}


def test_a_session(spark, tmp_path):
    s = Session(spark)
    assert s.health()["status"] == "ok" and s.summary()["rows"] == 0
    with pytest.raises(ValueError):
        s.filter([])
    shown = s.load("/root/testdata/sf0.001/part.parquet", key="p_partkey", rows=150)
    assert shown["total_rows"] == 150
    found = s.analyze(["p_name", "p_brand", "nothing"])
    assert found["columns"] == ["p_name", "p_brand"] and s.results() is found and s.summary()["analyzed_columns"] == 2
    assert found["terms"].columns == ["row_id", "Analyzer_p_name", "Analyzer_p_brand"] and found["terms"].count() == 150
    assert found["association"].count() == 4 and found["importance"].count() == 1
    kept = s.filter([FilterSpec("p_size", "numeric", min_val=1, max_val=10)])
    assert kept["total_rows"] < 150 and s.summary()["filtered"]
    again = s.filter([FilterSpec("p_brand", "text", pattern="1")])
    assert again["total_rows"] == s.raw.filter("p_brand LIKE '%1%'").count()
    assert s.filter([])["total_rows"] == 150 and not s.summary()["filtered"]
    assert s.ask("", "p_name", lambda p: p[:9]) == "Summarize"
    with pytest.raises(ValueError):
        s.ask("", "nothing", str)
    (tmp_path / "u.csv").write_text("x,y\n1,a\n")
    assert s.upload(str(tmp_path / "u.csv"))["columns"] == ["x", "y", "row_id"] and s.results() is None
    assert [c["name"] for c in s.columns()] == ["x", "y", "row_id"]


def test_stream_counts_equal_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    run_available(windowed_counts(stream, "ts", "event_type", "1 day", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).agg({"n": "sum"}).first()[0]
    assert 0 < got <= 1000


def test_themes_take_other_vectors(spark):
    sea, town = ["sea wave boat sail", "boat sea sail tide", "wave tide sea boat"], ["town road house market", "market town house street", "road street town market"]
    rows = [(k, (sea if k % 2 else town)[k % 3]) for k in range(40)]
    session = Session(spark)
    session._hold(spark.createDataFrame(rows, "row_id long, text string"), "row_id")
    found = session.themes("text", embed="trained", min_cluster_size=8, trim=2)
    top = sorted(Counter(t for _, t in rows).items(), key=lambda x: (-x[1], x[0]))[:2]
    assert {r["text_revised"] for r in found["revised"].collect()} == {"Other", *(t for t, _ in top)}
    assert found["assigned"].count() == 40
    lengths = lambda: lambda texts: [[float("sea" in t), float(len(t) % 7)] for t in texts]
    assert session.themes("text", embed=lengths, min_cluster_size=8)["assigned"].count() == 40
    with pytest.raises(ValueError):
        session.themes("text", embed="other")
