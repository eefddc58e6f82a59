import json
import os

import pytest
from pyspark.sql import functions as F

from cowrie.operators.records import MissingInputError
from cowrie.sources import io
from cowrie.streaming import interactions


def test_jsonl(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.jsonl").write_text('{"id":"1","t":"ọ̀"}\n\n{"id":"2","t":null}\n', encoding="utf-8")
    schema = "id string, t string"
    schema = spark.createDataFrame([], schema).schema
    df = io.read_jsonl(spark, str(p), schema)
    assert {tuple(r) for r in df.collect()} == {("1", "ọ̀"), ("2", None)}
    io.write_jsonl(df, str(tmp_path / "out"))
    assert io.read_jsonl(spark, str(tmp_path / "out"), schema).count() == 2
    (p / "b.jsonl").write_text("not json\n")
    with pytest.raises(io.SchemaError):
        io.read_jsonl(spark, str(p), schema)
    assert sum(r["_corrupt_record"] is not None for r in io.read_jsonl(spark, str(p), schema, strict=False).collect()) == 1


def test_sheets_with_and_without_mark(spark, tmp_path):
    for mark in ("", "﻿"):
        f = tmp_path / f"s{len(mark)}.csv"
        f.write_text(mark + 'term_en,canonical_yo\nTB,"i,kọ"\n,x\nHIV,\n', encoding="utf-8")
        assert {tuple(r) for r in io.read_sheet(spark, str(f), ["term_en", "canonical_yo"], "term_en").collect()} == {("TB", "i,kọ"), ("HIV", "")}
    with pytest.raises(io.SchemaError):
        io.read_sheet(spark, str(f), ["lacking"], "lacking")
    with pytest.raises(MissingInputError):
        io.need(spark, str(tmp_path / "no"), "stage 1")


def test_counted_and_ordered_files(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("2", "x")], "id string, t string")
    assert io.write_jsonl(df, str(tmp_path / "n")) == 2 and '"t":null' in "".join(f.read_text() for f in (tmp_path / "n").glob("*.json"))
    for name, text in (("b/z.json", "three"), ("a/y.json", "two"), ("a/b c.html.json", "one")):
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text(json.dumps({"source_name": name[0], "raw_text": text}, indent=1), encoding="utf-8")
    got = [(r["number"], r["raw_text"]) for r in io.scan_documents(spark, str(tmp_path / "docs")).orderBy("number").collect()]
    assert got == [(1, "one"), (2, "two"), (3, "three")]
    docs = io.scan_documents(spark, str(tmp_path / "docs"))
    assert {r["slug"] for r in docs.collect()} >= {"y", "z"}
    io.write_documents(docs.select(*io.RAW_DOCUMENT.names), str(tmp_path / "w"))
    assert sorted(os.listdir(tmp_path / "w"))[-2:] == ["_source=a", "_source=b"]


def test_settings_answers_blinding_generations(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 3}}')
    config = io.read_config(str(tmp_path / "c.json"))
    assert io.setting(config, "a.b") == 3
    with pytest.raises(KeyError, match="'x' of 'a.x'"):
        io.setting(config, "a.x")
    assert io.read_answers(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "answers.jsonl").write_text('{"question":" q ","answer":"b"}\n{"question":"q","answer":"a"}\n{"question":null,"answer":"c"}\n')
    assert [tuple(r) for r in io.read_answers(spark, str(tmp_path / "answers.jsonl")).collect()] == [("q", "a")]
    items, key = spark.createDataFrame([("1", "A")], "sample_id string, slot string"), spark.createDataFrame([("1", "A", "M")], "sample_id string, slot string, system_id string")
    io.write_blinding(items, key, str(tmp_path / "items"), str(tmp_path / "key"))
    for wrong in ((key, str(tmp_path / "k2")), (items, str(tmp_path / "i2" / "key"))):
        with pytest.raises(ValueError):
            io.write_blinding(wrong[0], key, str(tmp_path / "i2"), wrong[1])
    io.write_generations(key, str(tmp_path / "g"))
    assert [r["system_id"] for r in io.read_generations(spark, str(tmp_path / "g"), key.schema, ["M"]).collect()] == ["M"]
    with pytest.raises(MissingInputError):
        io.read_generations(spark, str(tmp_path / "g"), key.schema, ["B1"])


def test_html():
    page = "<html><head><style>x</style></head><body><nav>menu</nav><p>One &amp; two</p>\n<p> three<br>four</p><script>1</script></body></html>"
    assert io.html_to_text(page) == "One & two\nthree\nfour" and io.html_to_text(None) is None


def test_sources_and_licences(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    df, refused = io.read_sources(spark, [{"kind": "manual", "path": str(tmp_path), "source": "s", "licence": "CC"}, {"kind": "ftp", "source": "x", "licence": "y"}, {"kind": "manual", "source": "z", "licence": ""}])
    assert df.first()["raw_text"] == "hello" and refused == ["x", "z"]
    with pytest.raises(PermissionError):
        io.raw_documents(spark.createDataFrame([("t", "u")], "raw_text string, url string"), F.lit("s"), F.lit(" "))
    assert spark.createDataFrame([("http://a/", "/b")], "x string, y string").select(io.page_url(F.col("x"), F.col("y"))).first()[0] == "http://a/b"


def test_cache_report_manifest(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert io.read_cache(spark, path).count() == 0
    io.append_cache(spark.createDataFrame([("h", "r")], "text_hash string, result string"), path)
    assert io.read_cache(spark, path).first()["result"] == "r"
    assert io.write_report(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path), "t").startswith("| n | s |")
    with pytest.raises(ZeroDivisionError), io.RunManifest(str(tmp_path / "m"), "stage"):
        1 / 0
    (f,) = os.listdir(tmp_path / "m")
    assert json.loads((tmp_path / "m" / f).read_text())["status"] == "failed"


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 900).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), F.col("id").cast("double").alias("v"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    grouped = interactions.tumbling(interactions.read_stream(spark, str(tmp_path / "in"), rows.schema, files=1), "ts", "kind", "v")
    interactions.run_complete(grouped, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, interactions.tumbling(rows, "ts", "kind", "v").collect()))


def test_workbooks(spark, tmp_path):
    import zipfile

    from cowrie.sources import xlsx

    assert [xlsx.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    df = spark.createDataFrame([("1", "ọ̀rọ̀ <b> & \"x\"\n  two", None), ("2", None, "SUGGESTED"), (" ", "no key", "x")], "id string, t string, f string")
    path = str(tmp_path / "s.xlsx")
    assert xlsx.write_workbook(df, path, ["id", "f", "t"], 'A "name"') == 3
    back = xlsx.read_workbook(spark, path, ["id", "t", "f"], "id", 'A "name"')
    assert [tuple(r) for r in back.collect()] == [("1", "ọ̀rọ̀ <b> & \"x\"\n  two", ""), ("2", "", "SUGGESTED")]
    for wrong in ({"columns": ["lacking"], "key": "lacking"}, {"columns": ["id"], "key": "id", "sheet": "none"}):
        with pytest.raises(io.SchemaError):
            xlsx.read_workbook(spark, path, **wrong)
    # as other programs write them: shared texts in runs, numbers, truth values, formulas, gaps
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    other = str(tmp_path / "o.xlsx")
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="x" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><r><t>v</t></r><r><t>al</t></r></si></sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>12</v></c><c r="C3" t="b"><v>1</v></c></row><row r="4"><c r="A4"><v>1.5</v></c><c r="C4" t="str"><f>A1</f><v>sum</v></c></row></sheetData></worksheet>')
    assert xlsx.rows_of(other) == [["id", "", "val"], [], ["12", "", "TRUE"], ["1.5", "", "sum"]]
    assert [tuple(r) for r in xlsx.read_workbook(spark, other, ["id", "val"], "id").collect()] == [("12", "TRUE"), ("1.5", "sum")]
