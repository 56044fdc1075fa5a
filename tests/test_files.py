import io
import json
import zipfile

import pytest

import pagewright
from pagewright.cli import main
from pagewright.sources.config import Config, from_text

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def p(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


DOCX = packed({
    "word/styles.xml": f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style></w:styles>',
    "word/document.xml": f"<w:document {W}><w:body>{p('Test Document', 'H1')}{p('')}{p('Paragraph 1')}<w:tbl><w:tr><w:tc>{p('Header1')}</w:tc><w:tc>{p('Header2')}</w:tc></w:tr><w:tr><w:tc>{p('Val1')}</w:tc><w:tc>{p('Val2')}</w:tc></w:tr></w:tbl></w:body></w:document>",
})


def sheet(rows):
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{"AB"[j]}{i + 1}" ' + (f't="inlineStr"><is><t>{c}</t></is></c>' if isinstance(c, str) else f"><v>{c}</v></c>") for j, c in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    return f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>"


XLSX = packed({
    "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/><sheet name="Sheet2" sheetId="2" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/worksheets/sheet1.xml": sheet([["P", "Q"], [1, 3], [2, 4]]),
    "xl/worksheets/sheet2.xml": sheet([["C", "D"], [5, 7], [6, 8]]),
})


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.md").write_bytes(b"# Title\r\nText\rmore")
    (d / "b.docx").write_bytes(DOCX)
    (d / "c.XLSX").write_bytes(XLSX)
    (d / "d.csv").write_bytes("x,y\n1,é\n2,\n".encode())
    (d / "e.html").write_text("no")
    (d / "f.docx").write_text("broken")
    (d / "g.txt").write_bytes(b"\xff\xfe")
    (d / "h.pdf").write_bytes(b"%PDF")
    return d


def test_readers(spark, folder):
    got = {r.filename: r for r in pagewright.read_documents(spark, [str(f) for f in sorted(folder.iterdir())]).collect()}
    assert got["a.md"].content == "# Title\nText\nmore"
    assert got["b.docx"].content == "\n".join(["", "<!-- page_number: 1 -->", "", "# Test Document", "", "Paragraph 1", "", "| Header1 | Header2 |", "| --- | --- |", "| Val1 | Val2 |", ""])
    c = got["c.XLSX"].content
    assert "\n".join(["### Sheet: Sheet1", "", "| P | Q |", "| --- | --- |", "| 1 | 3 |", "| 2 | 4 |"]) in c and "<!-- page_number: 2 -->\n\n### Sheet: Sheet2" in c
    assert got["d.csv"].content.endswith("\n".join(["| x | y |", "| --- | --- |", "| 1 | é |", "| 2 | nan |"]))
    assert (got["e.html"].error_class, got["e.html"].error_message) == ("ValueError", "Unsupported file extension: .html")
    assert got["f.docx"].error_class == "BadZipFile" and got["g.txt"].error_class == "UnicodeDecodeError" and got["h.pdf"].error_class in ("ImportError", "PdfminerException")


def test_cells_as_a_data_frame_shows_them(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,gap,share,flag,word\n007,1,0.5,True,x\n010,,2,False,\n011,3,1e9,True,\"q, r\"\n")
    (tmp_path / "b.csv").write_text("")
    styles = f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    cells = ['<c t="inlineStr"><is><t>when</t></is></c><c t="inlineStr"><is><t>then</t></is></c><c t="inlineStr"><is><t>n</t></is></c><c t="inlineStr"><is><t>yes</t></is></c><c><v>2024</v></c>', '<c s="1"><v>45293</v></c><c s="2"><v>45293.5</v></c><c s="3"><v>1.5</v></c><c t="b"><v>1</v></c><c><v>7</v></c>', '<c s="1"><v>45294</v></c><c/><c><v>2</v></c><c t="b"><v>0</v></c><c><v>8</v></c>']
    parts = {"xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="T" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>', "xl/styles.xml": styles, "xl/worksheets/s.xml": f"<worksheet {S}><sheetData>{''.join(f'<row>{c}</row>' for c in cells)}</sheetData></worksheet>", "xl/worksheets/e.xml": f"<worksheet {S}><sheetData/></worksheet>", "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/><Relationship Id="r2" Target="worksheets/e.xml"/></Relationships>'}
    (tmp_path / "c.xlsx").write_bytes(packed(parts))
    (tmp_path / "d.xls").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 old")
    got = {(r.filename, r.page_number): r for r in pagewright.read_pages(spark, [str(tmp_path / n) for n in ("a.csv", "a.csv", "b.csv", "c.xlsx", "d.xls")]).collect()}
    assert got["a.csv", 1].markdown_content.split("\n")[2:] == ["| 7 | 1 | 0.5 | True | x |", "| 10 | nan | 2 | False | nan |", "| 11 | 3 | 1e+09 | True | q, r |"]
    assert got["b.csv", None].error_class == "EmptyDataError" and got["d.xls", None].error_class in ("ImportError", "XLRDError", "CompDocError")
    assert got["c.xlsx", 1].markdown_content.split("\n") == ["### Sheet: T", "", "| when | then | n | yes | 2024 |", "| --- | --- | --- | --- | --- |", "| 2024-01-02 00:00:00 | 2024-01-02 12:00:00 | 1.5 | True | 7 |", "| 2024-01-03 00:00:00 | NaT | 2 | False | 8 |"]
    assert got["c.xlsx", 2].markdown_content == "### Sheet: Empty\n\n" and len(got) == 5


def test_what_engines_give_is_checked(spark, tmp_path):
    pages = {"good": [{"text": "one", "tables": [[["a", None], ["1", 2]]]}, {"text": ""}], "notdict": ["text"], "otherkeys": [{"markdown": "x"}], "notext": [{"text": 5}], "badtable": [{"text": "", "tables": ["ab"]}]}
    path = tmp_path / "x.pdf"
    path.write_bytes(b"%PDF")
    try:
        for name, given in pages.items():
            pagewright.register_engine(name, lambda raw, given=given: iter(given))
            rows = pagewright.read_pages(spark, [str(path)], name).collect()
            if name == "good":
                assert [(r.page_number, r.plain_text, r.markdown_content) for r in sorted(rows, key=lambda r: r.page_number)] == [(1, "one", "one\n\n| a |  |\n| --- | --- |\n| 1 | 2 |"), (2, "", "")]
            else:
                assert [(r.error_class, r.page_number) for r in rows] == [("TypeError", None)] and name in rows[0].error_message
        with pytest.raises(TypeError):
            pagewright.register_engine("none", None)
    finally:
        for name in pages:
            pagewright.ENGINES.pop(name, None)


def test_each_file_is_unpacked_once(spark, folder, tmp_path):
    docs = pagewright.read_documents(spark, [str(folder / n) for n in ("a.md", "b.docx", "c.XLSX", "e.html")])
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    items, _ = pagewright.run_batch(spark, [[str(folder / "b.docx"), str(folder / "c.XLSX")]], str(tmp_path / "o"), fmt="json")
    assert "MapInPandas" not in items._jdf.queryExecution().optimizedPlan().toString() and sorted(x.name for x in (tmp_path / "o").iterdir()) == ["b.json", "batch-results.jsonl", "batch-summary.json", "c.json"]
    book = json.loads((tmp_path / "o" / "c.json").read_text())
    assert [p["page_number"] for p in book["pages"]] == [1, 2] and book["pages"][0]["tables"] == [] and book["filename"] == "c.XLSX" and book["metadata"] == {}


def test_files_of_a_table_are_read_by_the_executors_many_a_task(spark, tmp_path):
    for k in range(1200):
        (tmp_path / f"{k}.md").write_bytes(b"a\r\n%d" % k if k else b"")
    paths = [str(tmp_path / f"{k}.md") for k in range(1200)]
    table = spark.createDataFrame([(p,) for p in [*paths, paths[5], str(tmp_path / "none.md"), str(tmp_path)]], "source string")
    docs = pagewright.read_documents(spark, table)
    lines = docs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    above = lines[: next(i for i, x in enumerate(lines) if "MapInPandas" in x)]
    assert not any(word in x for x in above for word in ("Aggregate", "Join", "Repartition", "Sort")) and docs.rdd.getNumPartitions() <= 16
    got = {r.source: r for r in docs.collect()}
    assert len(got) == 1202 and all(got[p].content == (f"a\n{k}" if k else "") for k, p in enumerate(paths))
    assert got[str(tmp_path / "none.md")].error_class == "FileNotFoundError" and got[str(tmp_path)].error_class == "ValueError"
    listed = pagewright.read_documents(spark, paths)
    assert listed.rdd.getNumPartitions() <= 16 and sorted(map(str, listed.select("source", "content", "pages").collect())) == sorted(str(r) for r in docs.where("error_class is null").select("source", "content", "pages").collect())
    assert {r.source: bytes(r.content) for r in pagewright.read_files(spark, paths[:3]).collect()} == {paths[0]: b"", paths[1]: b"a\r\n1", paths[2]: b"a\r\n2"}
    with pytest.raises(FileNotFoundError):
        pagewright.read_documents(spark, [str(tmp_path / "none.md")])


def test_documents_of_files_are_those_of_their_pages(spark, folder):
    from pagewright.sources.readers import as_documents

    paths = [str(f) for f in sorted(folder.iterdir())]
    by_page = as_documents(pagewright.read_pages(spark, paths)).collect()
    by_file = pagewright.read_documents(spark, paths).collect()
    assert len(by_file) == 8 and {r.source: r.asDict(True) for r in by_file} == {r.source: r.asDict(True) for r in by_page}


def test_engines(spark, folder):
    with pytest.raises(ValueError, match="Unknown PDF engine"):
        pagewright.read_documents(spark, [str(folder / "h.pdf")], "other")
    assert pagewright.read_documents(spark, [str(folder / "h.pdf")], "deepdoc").first().error_class == "NotImplementedError"


def test_inputs(folder):
    assert pagewright.expand_inputs([str(folder), [str(folder / "a.md"), str(folder / "a.md")]]) == [str(folder / "h.pdf"), str(folder / "a.md"), str(folder / "a.md")]
    with pytest.raises(FileNotFoundError):
        pagewright.expand_inputs("nowhere")


def test_batch(spark, folder, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.md").write_text("old")
    paths = [str(folder / n) for n in ("b.docx", "a.md", "e.html")]
    items, summary = pagewright.run_batch(spark, paths, str(out), skip_existing=True)
    rows = items.collect()
    assert [(r.status, r.error_type) for r in rows] == [("skipped", None), ("success", None), ("failed", "unsupported_format")]
    assert rows[1].metrics.table_count == 1 and (out / "b.md").read_text().startswith("# Test Document") and (out / "a.md").read_text() == "old"
    assert (summary["total_files"], summary["success_count"], summary["failed_sources"]) == (3, 1, [paths[2]])
    assert json.loads((out / "batch-summary.json").read_text())["skipped_count"] == 1
    with pytest.raises(RuntimeError, match="Unsupported"):
        pagewright.run_batch(spark, paths, str(out), fail_fast=True)


def test_batch_of_a_table_of_paths(spark, folder, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.md").write_text("old")
    paths = [str(folder / n) for n in ("a.md", "b.docx", "c.XLSX", "e.html", "none.md")]
    items, summary = pagewright.run_batch(spark, spark.createDataFrame([(p,) for p in paths], "source string"), str(out), skip_existing=True)
    rows = items.collect()
    assert [(r.source, r.status, r.error_type) for r in rows] == list(zip(paths, ("skipped", "success", "success", "failed", "failed"), (None, None, None, "unsupported_format", "file_not_found")))
    assert (rows[1].metrics.table_count, rows[2].metrics.table_count, rows[2].metrics.page_count) == (1, 2, 2) and rows[2].metrics.elapsed_seconds > 0
    assert sorted(x.name for x in out.iterdir()) == ["a.md", "b.md", "batch-results.jsonl", "batch-summary.json", "c.md"] and summary["total_pages"] == 3


def test_benchmark(spark, folder, tmp_path):
    manifest = tmp_path / "m.json"
    listed = [{"id": "s", "path": str(folder / "b.docx"), "checks": {"min_tables": 1, "min_pages": 2, "unknown": 1}}, {"id": "t", "path": str(folder / "e.html")}]
    manifest.write_text(json.dumps(dict(samples=listed)))
    results, summary = pagewright.run_benchmark(spark, str(manifest), str(tmp_path / "r"))
    rows = {r.id: r for r in results.collect()}
    assert rows["s"].quality.failures == ["min_pages"] and rows["t"].quality is None and rows["t"].status == "failed"
    assert (summary["total_samples"], summary["quality_failed_samples"], summary["failed_samples"], summary["total_tables"]) == (2, ["s"], ["t"], 1)
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ValueError, match="samples list"):
        pagewright.read_manifest(spark, str(tmp_path / "bad.json"))


def test_command_line(spark, folder, tmp_path, capsys):
    assert main(["parse", str(folder / "a.md")], spark) == 0
    assert capsys.readouterr().out == "# Title\nText\nmore\n"
    assert main(["parse", str(folder / "b.docx"), "--output", str(tmp_path / "x.json"), "--format", "json"], spark) == 0
    assert json.loads((tmp_path / "x.json").read_text())["filename"] == "b.docx"
    assert main(["parse", str(folder / "e.html")], spark) == 1
    assert main(["parse", str(folder / "a.md"), str(folder / "b.docx"), "--batch", "--output-dir", str(tmp_path / "o")], spark) == 0
    assert sorted(x.name for x in (tmp_path / "o").iterdir()) == ["a.md", "b.md"]
    with pytest.raises(SystemExit):
        main(["parse", str(folder / "a.md"), str(folder / "b.docx")], spark)


def test_config(tmp_path):
    f = tmp_path / "c.json"
    service = dict(api_port=9000, extra_options={"a": 1})
    f.write_text(json.dumps(dict(engines=dict(mineru=service))))
    c = Config(f, {"PAGEWRIGHT_MINERU_ENABLE_OCR": "off", "PAGEWRIGHT_MINERU_API_PORT": "9100", "PAGEWRIGHT_DEFAULT_PDF_ENGINE": "mineru"})
    e = c.engine(None, device="cpu", auto_install_runtime=False, extra_options={"b": 2})
    assert (e["enable_ocr"], e["api_port"], e["device"], e["extra_options"], e["auto_install_runtime"]) == (False, 9100, "cpu", {"a": 1, "b": 2}, False)
    assert c.get("engines.none.x", 3) == 3 and from_text("null") is None and from_text("[1]") == [1] and from_text("x") == "x"
    f.write_text("{")
    with pytest.warns(UserWarning):
        assert Config(f, {}).get("default_pdf_engine") == "simple"


def test_stream_takes_suffixes_of_any_case(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.MD", "b.TXT", "c.Md", "d.txt", "e.PDF"):
        (tmp_path / "in" / name).write_text("# Title\ntext")
    pagewright.ingest_chunks(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    sources = spark.read.parquet(str(tmp_path / "t")).select("source").distinct().collect()
    assert sorted(r.source.rsplit("/", 1)[1] for r in sources) == ["a.MD", "b.TXT", "c.Md", "d.txt"]


def test_stream(spark, folder, tmp_path):
    for want in (1, 1):
        pagewright.ingest_chunks(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "t")).where("header = 'Title'").count() == want
