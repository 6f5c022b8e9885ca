import io
import sys
import zipfile

from pyspark import cloudpickle
from pyspark.sql import functions as F

from vitalake.operators import documents, extraction
from vitalake.sources import readers

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def p(text, extra=""):
    return f"<w:p>{extra}<w:r><w:t>{text}</w:t></w:r></w:p>"


def package(extra=0, body=None, document=True):
    body = body or (
        p("Hello  ﬁrst") + "<w:p/>" + '<w:p><w:hyperlink r:id="rId1"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p>'
        + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("") + "</w:tc><w:tc>" + p("d") + "</w:tc></w:tr></w:tbl>"
        + "<w:p><w:r><w:txbxContent>" + p("boxed") + "</w:txbxContent></w:r></w:p>" + '<w:sectPr><w:headerReference r:id="rId2"/></w:sectPr>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if document:
            z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {NS}>{p('top')}</w:hdr>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="http://x.example"/><Relationship Id="rId2" Target="header1.xml"/></Relationships>')
        z.writestr("docProps/core.xml", '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>T</dc:title><dc:creator>A</dc:creator></cp:coreProperties>')
        for i in range(extra):
            z.writestr(f"x/{i}", "1")
    return out.getvalue()


def bomb():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<a/>")
        z.writestr("big", b"0" * 2_000_000)
    return out.getvalue()


def table(spark, files):
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in files.items()], "path string, length bigint, content binary")


def test_validation(spark):
    files = {"/a/ok.docx": package(), "/a/no.docx": package(document=False), "/a/many.docx": package(1001), "/a/bomb.docx": bomb(), "/a/bad.docx": b"PK\x03\x04junk", "/a/x.txt": b"hi", "/a/x.pdf": b"nope", "/a/big.pdf": b"%PDF" + b"0" * 5_300_000, "/a/y.pdf": b"%PDF-1.4", "/a/../z.pdf": b"%PDF"}
    got = {r["path"]: (r["valid"], r["validation_stage"], r["failure_reason"]) for r in documents.validate(table(spark, files)).collect()}
    assert got["/a/ok.docx"] == (True, "completed", None)
    assert got["/a/x.txt"][1] == "type_detection" and got["/a/x.pdf"][1] == "magic_number_validation" and got["/a/big.pdf"][1] == "size_validation" and got["/a/../z.pdf"][1] == "path_validation"
    for name in ("no", "many", "bomb", "bad"):
        assert got[f"/a/{name}.docx"][:2] == (False, "deep_structure_validation"), name
    assert got["/a/y.pdf"][0] is False and got["/a/y.pdf"][2].startswith("Unexpected system error: ")


def test_docx_text(spark):
    r = documents.extract_docx(table(spark, {"/a.docx": package()})).collect()[0]
    assert r["text"] == "Hello first\nsite [Links: http://x.example]\na | b\nd\n[Header 1] top\n[Textbox] boxed"
    assert (r["table_count"], r["textbox_count"], r["health_status"], r["metadata"]["author"]) == (1, 1, "Healthy", "A")


def test_pages(spark):
    rows = [("a", 2, "two", False), ("a", 1, "one", False), ("a", 3, " ", False), ("a", 4, "", True), ("b", 1, "", False)]
    got = {r["path"]: r for r in documents.collect_pages(spark.createDataFrame(rows, "path string, page_no int, text string, failed boolean")).collect()}
    assert got["a"]["text"] == "one\n\ntwo" and got["a"]["failed_pages"] == [4] and not got["a"]["ocr_required"]
    assert got["b"]["ocr_required"] and got["b"]["text"] == ""


def test_pipeline_from_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(body=p("Skills:") + p("- Go") + p("- SQL")))
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04")
    (tmp_path / "c.txt").write_bytes(b"skipped by the pattern")
    files = readers.files(spark, str(tmp_path))
    got = {r["path"].rpartition("/")[2]: r for r in documents.process(files).collect()}
    assert set(got) == {"a.docx", "b.docx"}
    assert got["a.docx"]["success"] and got["a.docx"]["sections"]["skills"] == "- Go\n- SQL"
    assert got["b.docx"]["error"].startswith("Validation failed: ") and got["b.docx"]["text"] is None


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text('type,title,level,start_date,end_date,payload\nwork, a ,,2020,,"{""k"": 1}"\nwork,b,,,, \n')
    rows = readers.events_csv(spark, str(tmp_path / "e.csv")).collect()
    assert rows[0]["title"] == " a " and rows[0]["payload"] == '{"k": 1}' and rows[1]["payload"] is None
    ev = readers.events_yaml(spark, "events_csv: |\n  type,title\n  work,x\n").collect()
    assert ev[0]["title"] == "x" and ev[0]["level"] is None
    for bad in ("- 1", "events_csv:", "events_csv: |\n  type\n  a,b\n"):
        try:
            readers.events_yaml(spark, bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert readers.settings(None) == {}
    tax = readers.taxonomy(spark.createDataFrame([("u", None, "a", None, None), (None, "L", "a", None, None)], "uri string, preferred_label string, alt_labels string, isco_code string, definition string")).collect()
    assert len(tax) == 1 and tax[0]["uri"] == "" and tax[0]["taxonomy"] == "occupations"
    assert "title: x" in readers.to_yaml(spark.createDataFrame([("x",)], "title string"))
    readers.append_cache(spark.range(2), str(tmp_path / "cache"), F.lit(60))
    assert readers.read_cache(spark, str(tmp_path / "cache")).count() == 2


def test_checks_before_opening(spark):
    df = spark.createDataFrame([("/a.docx", 10), ("/b.docx", 0), ("/c.pdf", 10), ("/d.docx", 60 * 1024 * 1024)], "path string, length bigint")
    got = [r["open_error"] for r in documents.open_checks(df, "docx").orderBy("path").collect()]
    assert got == [None, "File is empty", "Not a docx file", "Compressed size too large"]
    got = {r["path"]: r["archive_error"] for r in documents.archive_checks(table(spark, {"a": package(), "b": b"x", "c": bomb(), "d": package(1001)}), "content").collect()}
    assert got["a"] is None and got["b"].startswith("Invalid") and got["c"].startswith("Suspicious") and got["d"] == "Too many entries"
    cls = spark.createDataFrame([("type_detection",), (None,)], "s string").select(documents.error_class(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in cls] == ["UnsupportedFileTypeError", None]


def test_extraction(spark):
    df = spark.createDataFrame([(1, "Ann\nann@x.example +44 1632 960158\nSkills:\n- SQL\n- Go\nEducation\nMSc"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r for r in extraction.extract(df, "id", "text").collect()}
    r = got[1]["record"]
    assert r["personal_information"]["email"] == "ann@x.example" and [s["name"] for s in r["skills"]] == ["SQL", "Go"] and r["education"][0]["degree"] == "MSc"
    assert got[2]["error"] is None and got[2]["record"]["skills"] == []
    echo = lambda: lambda prompts: [p + ' sure: {"skills": [{"name": "x"}]} bye' if "Ann" in p else "no" for p in prompts]
    got = {r["id"]: r for r in extraction.extract(df, "id", "text", echo, prompted=True).collect()}
    assert got[1]["record"]["skills"][0]["name"] == "x" and got[2]["error"] == "invalid JSON" and got[2]["record"] is None


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers do not have the tests


class Page:
    def __init__(self, text, plain=None, fail=False):
        self.text, self.plain, self.fail = text, plain, fail

    def extract_text(self, extraction_mode=None):
        if self.fail:
            raise ValueError("broken page")
        return self.text if extraction_mode else self.plain


class OldPage:
    def extract_text(self):
        return "old"


class Reader:
    """A stand-in for a PDF parser: the file's second line names the pages."""

    is_encrypted = False

    def __init__(self, raw):
        kind = raw.split(b"\n")[1].decode()
        if kind == "bad":
            raise ValueError("no such thing")
        self.is_encrypted = kind == "secret"
        pages = {"mixed": [Page("ﬁrst   page\r\n\n\n\n end "), Page("", "plain text"), Page("", ""), Page("x", fail=True), OldPage()], "scan": [Page("", ""), Page("", "")], "none": []}
        self.pages = pages.get(kind, [])
        self.metadata = {"/Title": "A title", "/CreationDate": "D:2019"} if kind == "mixed" else None


def pdfs(spark):
    rows = [(f"/in/{k}.pdf", f"%PDF-1.4\n{k}\n".encode()) for k in ("mixed", "scan", "none", "bad", "secret")]
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length bigint, content binary")


def test_pdf_text_and_metadata_through_a_backend(spark):
    files = pdfs(spark)
    pages = documents.pdf_pages(files, Reader)
    got = {(r["path"][4:-4], r["page_no"]): r for r in pages.collect()}
    assert [got["mixed", n]["text"] for n in (1, 2, 3, 4, 5)] == ["first page\n\n end", "plain text", "", "", "old"]
    assert [got["mixed", n]["failed"] for n in (3, 4)] == [False, True] and "no such thing" in got["bad", 0]["error"] and "Encrypted" in got["secret", 0]["error"]
    meta = got["mixed", 1]["metadata"]
    assert (meta["filename"], meta["title"], meta["creation_date"], meta["author"]) == ("mixed.pdf", "A title", "D:2019", None)
    docs = {r["path"][4:-4]: r for r in documents.collect_pages(pages.where("error is null")).collect()}
    assert docs["mixed"]["text"] == "first page\n\n end\n\nplain text\n\nold" and docs["mixed"]["failed_pages"] == [4] and docs["scan"]["ocr_required"] and not docs["mixed"]["ocr_required"]
    kept = documents.collect_pages(pages.where("path like '%mixed%'"), keep_empty_pages=True).collect()[0]
    assert kept["text"] == "first page\n\n end\n\nplain text\n\n\n\nold" and kept["page_count"] == 5
    assert {r["path"][4:-4]: r["has_text"] for r in documents.pdf_has_text(files, Reader).collect()} == {"mixed": True, "scan": False, "none": False, "bad": False, "secret": False}


def test_each_pdf_is_opened_once(spark, tmp_path):
    log = tmp_path / "opened"

    def backend(raw):
        with log.open("a") as f:
            f.write("x")
        return Reader(raw)

    got = {r["path"][4:-4]: (r["success"], r["text"], r["error"]) for r in documents.process(pdfs(spark), backend=backend).collect()}
    assert log.read_text() == "xxxxx"
    assert got["mixed"][0] and "plain text" in got["mixed"][1] and got["scan"][:2] == (True, "")
    assert not got["none"][0] and "no pages" in got["none"][2] and "no such thing" in got["bad"][2] and "Encrypted" in got["secret"][2]


def test_paths(spark):
    rows = [("/in/a.pdf", None), ("/in/a.pdf/", 5), ("/in/../a.pdf", 5)]
    df = spark.createDataFrame([(p, n, bytearray(b"%PDF")) for p, n in rows], "path string, length bigint, header binary")
    assert [r["failure_reason"] for r in documents.cheap_checks(df).collect()] == ["File does not exist", "Path is not a file", "Path traversal detected"]
