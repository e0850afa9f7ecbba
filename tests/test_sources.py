import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.operators import index, sheets
from quillmill.sources import files, office
from quillmill.streaming import ingest

SHEET = """<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" t="inlineStr"><is><t>ID</t></is></c><c r="B3" t="inlineStr"><is><t>Name</t></is></c></row>
<row r="4"><c r="A4"><v>7</v></c><c r="B4" t="s"><v>1</v></c></row></sheetData></worksheet>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("plain é")
    (tmp_path / "b.html").write_text("<html><script>x</script><p>One &amp; two</p><div>three</div></html>")
    (tmp_path / "c.md").write_text("# Head\n\n- [link](http://x) ![pic](p.png) **bold**")
    (tmp_path / "d.exe").write_text("no")
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Report</t></si><si><t>Widget</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships><Relationship Id="r" Type="t/comments" Target="../comments1.xml"/></Relationships>')
        z.writestr("xl/comments1.xml", '<comments><comment ref="B4"><text><t>odd</t></text></comment></comments>')
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    return str(tmp_path)


def test_documents(spark, folder):
    got = {r.path.rpartition("/")[2]: r.text for r in files.read_documents(spark, folder).collect()}
    assert got["a.txt"] == "plain é" and got["b.html"] == "One & two\nthree" and "d.exe" not in got
    assert "Head" in got["c.md"] and "link" in got["c.md"] and "bold" in got["c.md"] and "png" not in got["c.md"]
    assert got["e.xlsx"].splitlines() == [
        "=== Spreadsheet: e.xlsx | Sheet: S1 ===", "# Workbook Structure Summary", "- Sheet 'S1': 1 rows. Columns: [ID, Name]", "", "Context/Metadata:", "Report",
        "Columns: ID, Name", "Total rows: 1", "", "Data:", "| ID | Name |", "|---|---|", "| 7 | Widget [Note: odd] |",
    ]
    assert got["f.docx"] == "## Title\nBody"


def test_workbook_header(spark, folder):
    book = spark.read.format("binaryFile").load(f"{folder}/e.xlsx").withColumn("ext", F.lit("xlsx"))
    assert tuple(sheets.header_rows(office.rows(book)).first()) == ("S1", 2, "Report")


def test_files_that_cannot_be_read_do_not_end_the_job(spark, folder, tmp_path):
    (tmp_path / "x.pdf").write_text("%PDF")
    (tmp_path / "y.gif").write_bytes(b"GIF89a")
    (tmp_path / "z.docx").write_text("no archive")
    (tmp_path / "old.doc").write_bytes(b"\x00\x01some words\x00ab\x02more words")
    (tmp_path / "skip.webp").write_text("x")
    got = {r.path.rpartition("/")[2]: r for r in files.read_all(spark, folder).collect()}
    assert {n for n, r in got.items() if r.error} == {"x.pdf", "y.gif", "z.docx"} and "no reader" in got["x.pdf"].error
    assert got["old.doc"].text == "some words\nmore words" and got["c.md"].images == ["p.png"] and "skip.webp" not in got
    assert files.rejects(spark, folder).count() == 3 and files.read_documents(spark, folder).where("path LIKE '%.txt'").count() == 1


def test_tables_of_documents_keep_their_cells():
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    raw = f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Above</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("1")}{cell("")}</w:tr></w:tbl></w:body></w:document>'
    assert office.xml_text(raw.encode()) == "Above\n| a | b |\n| 1 | |"


def test_merged_headers_name_columns(spark):
    cells = [["Sales", None, "Cost", None], ["Q1", "Q2", "Q1", "Q2"], ["1", "2", "3", "4"]]
    rows = spark.createDataFrame([("s", i, c, 4) for i, c in enumerate(cells)], "sheet string, row_no int, cells array<string>, width int")
    merged = spark.createDataFrame([("s", 0, 0, 0, 1), ("s", 0, 0, 2, 3)], "sheet string, row_no int, last_row int, column int, last_column int")
    headers = spark.createDataFrame([("s", 1)], "sheet string, header_row int")
    levels = sheets.header_levels(headers, merged)
    assert levels.first().levels == [0, 1]
    assert sheets.column_names(rows, levels).first().names == ["sales_q1", "sales_q2", "cost_q1", "cost_q2"]
    alone = sheets.header_levels(headers, merged.limit(0))
    assert alone.first().levels == [1] and sheets.column_names(rows, alone).first().names == ["q1", "q2", "q1_2", "q2_2"]


def test_merged_cells_are_read(tmp_path, spark):
    with zipfile.ZipFile(tmp_path / "m.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData/><mergeCells><mergeCell ref="A1:D1"/></mergeCells></worksheet>')
    book = spark.read.format("binaryFile").load(f"{tmp_path}/m.xlsx").withColumn("ext", F.lit("xlsx"))
    assert tuple(office.merges(book).first())[1:] == ("S1", 0, 0, 0, 3)


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1st col,Name,name\n1, a ,b\n,,\n")
    got = files.read_csv(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["col_1st_col", "name", "name_2"] and got.count() == 1


def test_streaming_ingest_is_idempotent(spark, sf_dir, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/index"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(source)
    for _ in range(2):
        ingest.ingest(spark, source, "doc_id long, text string", out, f"{tmp_path}/check").awaitTermination()
    assert index.chunks_of(spark, out).count() == index.chunk_table(docs).count()
    docs.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("changed. "), "text")).write.mode("append").parquet(source)
    ingest.ingest(spark, source, "doc_id long, text string", out, f"{tmp_path}/check").awaitTermination()
    whole = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("changed. "), "text")).otherwise(F.col("text")))
    index.reindex(spark, whole, f"{tmp_path}/whole")
    plain = lambda p: [sorted(map(tuple, df.collect())) for df in (index.chunks_of(spark, p).select("chunk_id", "text"), *index.scope_statistics(spark, p, index.manifest(spark, p)))]
    streamed, built = plain(out), plain(f"{tmp_path}/whole")
    assert streamed == built


def workbook(path, sheets_, fills=(), notes=()):
    """A workbook of inline texts: sheets as name to (rows, merged cells); fills as colours of formats from 1 on; notes of the first sheet."""
    letter = "ABCDEFGHIJKLMNOP"

    def cell(r, c, v):
        v, style = v if isinstance(v, tuple) else (v, 0)
        return f'<c r="{letter[c]}{r + 1}" s="{style}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else f'<c r="{letter[c]}{r + 1}" s="{style}"/>'

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets_)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets_))) + "</Relationships>")
        z.writestr("xl/styles.xml", "<styleSheet><fills><fill><patternFill/></fill>" + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{f}"/></patternFill></fill>' for f in fills) + "</fills><cellXfs><xf fillId=\"0\"/>" + "".join(f'<xf fillId="{i + 1}"/>' for i in range(len(fills))) + "</cellXfs></styleSheet>")
        for i, (rows, merged) in enumerate(sheets_.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows) if row)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet><sheetData>{body}</sheetData><mergeCells>" + "".join(f'<mergeCell ref="{m}"/>' for m in merged) + "</mergeCells></worksheet>")
        if notes:
            z.writestr("xl/worksheets/_rels/sheet0.xml.rels", '<Relationships><Relationship Id="r" Type="t/comments" Target="../comments1.xml"/></Relationships>')
            z.writestr("xl/comments1.xml", "<comments>" + "".join(f'<comment ref="{ref}"><text><t>{t}</t></text></comment>' for ref, t in notes) + "</comments>")


def test_a_noisy_workbook_becomes_pages(spark, tmp_path):
    sales = [["Confidential Report", None, None, None], ["Generated by: System X"], ["Date: 2026-02-17"], [], [], ["ID", "Product Name", "Region", "Revenue", "Status"], ["101", "Widget A", "North", "5000", ("Approved", 1)], ["102", "Widget\u00a0B", "South", "3200", ("Pending", 2)], ["103", "Gadget X", "East", "8100", ("Rejected", 3)], ["104", "Gadget Y", "West", "4500", "Approved"], [], ["105", "Gizmo Z", "North", "1200", "Approved"]]
    config = [["Setting", "Value"], ["Max Users", "100"], ["Theme", "Dark"]]
    workbook(tmp_path / "dirty.xlsx", {"Sales_Data_Q1": (sales, ["A1:D1"]), "Config_Data": (config, [])}, ["FF00FF00", "FFFFFF00", "FFFF0000"], [("D9", "Outlier value due to bulk order")])
    (tmp_path / "broken.xlsx").write_text("no archive")
    pages = {(r.path.rpartition("/")[2], r.page_no): r for r in files.read_all(spark, str(tmp_path)).collect()}
    text = pages["dirty.xlsx", 1].text
    assert text.splitlines() == [
        "=== Spreadsheet: dirty.xlsx | Sheet: Sales_Data_Q1 ===", "# Workbook Structure Summary", "- Sheet 'Sales_Data_Q1': 6 rows. Columns: [ID, Product Name, Region, Revenue, Status]", "- Sheet 'Config_Data': 2 rows. Columns: [Setting, Value]", "",
        "Context/Metadata:", "Confidential Report", "Generated by: System X", "Date: 2026-02-17", "Columns: ID, Product Name, Region, Revenue, Status", "Total rows: 5", "", "Data:",
        "| ID | Product Name | Region | Revenue | Status |", "|---|---|---|---|---|", "| 101 | Widget A | North | 5000 | Approved [Status: Green] |", "| 102 | Widget B | South | 3200 | Pending |",
        "| 103 | Gadget X | East | 8100 [Note: Outlier value due to bulk order] | Rejected [Status: Red] |", "| 104 | Gadget Y | West | 4500 | Approved |", "| 105 | Gizmo Z | North | 1200 | Approved |",
    ]
    assert pages["dirty.xlsx", 2].text.endswith("| Setting | Value |\n|---|---|\n| Max Users | 100 |\n| Theme | Dark |") and pages["broken.xlsx", 1].error


def test_columns_without_names_and_empty_ones(spark, tmp_path):
    rows = [["Name", None, None, "name", "Empty"], ["a", "kind", None, "x", None], ["b", "3", "4.5", "", " "], [None, None, None, None, None], ["c", None, None, "z", None]]
    many = [[f"c{i}" for i in range(12)], [str(i) for i in range(12)]]
    two = [["Sales", None, "Cost", None], ["Q1", "Q2", "Q1", "Q2"], ["1", "2", "3", "4"]]
    workbook(tmp_path / "w.xlsx", {"odd": (rows, []), "many": (many, []), "two": (two, ["A1:B1", "C1:D1"])})
    pages = {r.page_no: r.text for r in files.read_all(spark, str(tmp_path)).collect()}
    assert pages[1].endswith("Columns: Name, kind, Column_2, name_2\nTotal rows: 3\n\nData:\n| Name | kind | Column_2 | name_2 |\n|---|---|---|---|\n| a | kind | | x |\n| b | 3 | 4.5 | |\n| c | | | z |")
    assert "- Sheet 'many': 1 rows. Columns: [c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, ...]" in pages[2]
    assert "Columns: Sales_Q1, Sales_Q2, Cost_Q1, Cost_Q2\nTotal rows: 1" in pages[3]


def test_slides_with_groups_tables_and_diagrams(spark, tmp_path):
    say = lambda *ps: "<p:sp><p:txBody>" + "".join("<a:p>" + "".join(f"<a:r><a:t>{r}</a:t></a:r>" for r in p) + "</a:p>" for p in ps) + "</p:txBody></p:sp>"
    table = "<p:graphicFrame><a:graphic><a:graphicData uri='t'><a:tbl>" + "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in row) + "</a:tr>" for row in (["a", "b"], ["1 ", ""], ["", ""])) + "</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    diagram = f"<p:graphicFrame><a:graphic><a:graphicData uri='{office.DIAGRAM}'><d:relIds r:dm='rId2' r:lo='rId3' r:qs='rId9'/></a:graphicData></a:graphic></p:graphicFrame>"
    with zipfile.ZipFile(tmp_path / "s.pptx", "w") as z:
        for n, body in ((2, say(["Second"])), (1, say(["Ti", "tle"], ["under  it"]) + "<p:grpSp>" + say(["In a"]) + "<p:grpSp>" + say(["group"]) + "</p:grpSp></p:grpSp>" + table + diagram + say([" "])), (10, "")):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld xmlns:p='p' xmlns:a='a' xmlns:d='d' xmlns:r='r'><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>")
        z.writestr("ppt/slides/_rels/slide1.xml.rels", '<Relationships><Relationship Id="rId2" Target="../diagrams/data1.xml"/><Relationship Id="rId3" Target="../diagrams/layout1.xml"/></Relationships>')
        z.writestr("ppt/diagrams/data1.xml", "<x xmlns:a='a'><a:t>Plan</a:t><a:t>Do</a:t><a:t>Plan</a:t></x>")
        z.writestr("ppt/diagrams/layout1.xml", "<x xmlns:a='a'><a:t>Do</a:t><a:t>Check</a:t></x>")
    pages = {r.page_no: r.text for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert pages == {1: "Title under it\nIn a\ngroup\n[Table]\na | b\n1 |\n[/Table]\n[SmartArt Diagram]\nPlan\nDo\nCheck\n[/SmartArt Diagram]".replace("1 |", "1 | "), 2: "Second", 3: ""}


def test_parsed_documents_are_written_by_owner(spark, folder, tmp_path):
    parsed = files.parsed_documents(files.read_all(spark, folder))
    out = f"{tmp_path}/out/parsed"
    owned = lambda user: parsed.withColumn("user_id", F.lit(user)).withColumn("thread_id", F.lit("t 1"))
    files.write_parsed(owned("007").where("type <> 'md'"), out)
    files.write_parsed(owned("u/2").where("type = 'md'"), out)
    got = {r.file_name: r for r in files.read_written(spark, out).collect()}
    assert set(got) == {"a.txt", "b.html", "c.md", "e.xlsx", "f.docx"} and got["c.md"].user_id == "u/2" and got["a.txt"].user_id == "007"
    assert got["f.docx"].title == "f" and got["f.docx"].full_text == "## Title\nBody" and got["c.md"].content[0].images == ["p.png"] and got["a.txt"].thread_id == "t 1"
