"""Document files: staged validation, text extraction, post-processing.

Validation is a chain of Column conditions, the first that fails fixes stage and reason. Only files that
passed the cheap checks reach a Python worker, through a filter before it, since workers run eagerly. A bad
file never stops a job: it carries its error. PDF text needs a backend: a function from bytes to a reader with
``pages`` (each with ``extract_text``), ``metadata`` and ``is_encrypted``. The default looks for an optional package;
without it PDF rows say so.
"""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.config import FileConfig, TextConfig
from vitalake.functions import text as T
from vitalake.sources import docx

CFG = FileConfig()
MB = 1024 * 1024
#: Suffixes and first bytes of the types.
TYPES = {"pdf": (".pdf", b"%PDF"), "docx": (".docx", b"PK\x03\x04")}
#: Names of the properties of a PDF, and theirs here.
PDF_PROPERTIES = {"/Title": "title", "/Author": "author", "/Subject": "subject", "/Creator": "creator", "/Producer": "producer", "/CreationDate": "creation_date", "/ModDate": "modification_date"}
_PDF_META = "struct<filename:string," + ",".join(f"{n}:string" for n in PDF_PROPERTIES.values()) + ">"
Backend = Callable[[bytes], Any]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_type(path: Column) -> Column:
    return F.when(suffix(path) == ".pdf", "pdf").when(suffix(path) == ".docx", "docx")


def cheap_checks(df: DataFrame, cfg: FileConfig = CFG) -> DataFrame:
    """``df`` (path, length, header: the first 8 bytes) with file_type, size_mb, stage and failure_reason.

    The last two are null where all cheap checks passed. Checks in order: path (a null length stands for a file that
    is not there), size, type, first bytes.
    """
    size = F.round(F.col("length") / MB, 2)
    kind = file_type(F.col("path"))
    magic = F.when(kind == "pdf", F.startswith("header", F.lit(TYPES["pdf"][1]))).otherwise(F.startswith("header", F.lit(TYPES["docx"][1])))
    checks = (
        (F.array_contains(F.split("path", "/"), ".."), "path_validation", F.lit("Path traversal detected")),
        (F.endswith("path", F.lit("/")), "path_validation", F.lit("Path is not a file")),
        (F.col("length").isNull(), "path_validation", F.lit("File does not exist")),
        (F.col("length") > cfg.max_file_mb * MB, "size_validation", F.concat(F.lit("File too large: "), size.cast("string"), F.lit(" MB"))),
        (kind.isNull(), "type_detection", F.concat(F.lit("Unsupported file extension: "), suffix(F.col("path")))),
        (~F.coalesce(magic, F.lit(False)), "magic_number_validation", F.lit("File signature does not match its extension")),
    )
    stage, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for bad, name, why in reversed(checks):
        stage, reason = F.when(bad, name).otherwise(stage), F.when(bad, why).otherwise(reason)
    return df.withColumns({"file_type": kind, "size_mb": size, "stage": stage, "failure_reason": reason})


def pypdf_backend(raw: bytes) -> Any:
    return importlib.import_module("pypdf").PdfReader(io.BytesIO(raw), strict=False)


def _pdf(raw: bytes, backend: Backend) -> Any:
    reader = backend(raw)
    if reader.is_encrypted:
        raise ValueError("Encrypted PDF")
    return reader


def _fault(kind: str, raw: bytes, cfg: FileConfig, backend: Backend) -> tuple[str | None, Any]:
    """(what is wrong inside a file, if anything; the reader of a sound PDF)."""
    if kind == "docx":
        f = docx.package_facts(raw)
        checks = (
            (f["error"], f["error"]), (not f["document"], "Missing word/document.xml"), (f["entries"] > cfg.max_entries, "Too many entries"),
            (f["ratio"] > cfg.max_ratio, "Suspicious compression ratio"), (f["total"] > cfg.max_uncompressed_mb * MB, "Uncompressed size too large"),
        )
        return next((why for bad, why in checks if bad), None), None
    try:
        reader = _pdf(raw, backend)
        n = len(reader.pages)
    except ImportError:
        return "pdf backend unavailable", None
    except Exception as e:  # noqa: BLE001 - any parser error is the file's
        return f"Invalid PDF: {e}", None
    return "PDF has no pages" if not n else "Too many pages" if n > cfg.max_pages else None, reader


def page_text(page: Any, mode: str = "layout") -> str:
    """Text of a page in the given mode, or without a mode where the backend knows none or the page gives nothing; tidied."""
    try:
        text = page.extract_text(extraction_mode=mode)
    except TypeError:
        text = page.extract_text()
    return docx.tidy(text or page.extract_text() or "")


#: Error classes by the stage that failed.
ERROR_CLASSES = {
    "path_validation": "FileValidationError", "size_validation": "FileSizeError", "type_detection": "UnsupportedFileTypeError", "magic_number_validation": "MagicNumberError",
    "deep_structure_validation": "StructureError", "extraction": "ExtractionError", "post_processing": "PostProcessingError",
}


def error_class(stage: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ERROR_CLASSES.items() for x in kv]), F.coalesce(stage, F.lit("")))


def open_checks(df: DataFrame, kind: str, cfg: FileConfig = CFG) -> DataFrame:
    """``df`` (path, length) with open_error: what keeps a file from being opened as ``pdf`` or ``docx``, null if nothing does."""
    wrong = suffix(F.col("path")) != TYPES[kind][0]
    error = F.when(wrong, f"Not a {kind} file").when(F.col("length") == 0, "File is empty")
    if kind == "docx":
        error = error.when(F.col("length") > cfg.max_compressed_mb * MB, "Compressed size too large")
    return df.withColumn("open_error", error)


def archive_checks(df: DataFrame, content: str, cfg: FileConfig = CFG) -> DataFrame:
    """``df`` with archive_error: document part, total size, number of entries and ratio, in this order."""

    def facts(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([docx.package_facts(bytes(c)) for c in contents], columns=["entries", "total", "ratio", "document", "error"])

    f = F.pandas_udf(facts, "entries int, total bigint, ratio double, document boolean, error string")(F.col(content))
    rows = df.withColumn("__f", f)
    x = F.col("__f")
    error = (
        F.when(x["error"].isNotNull(), x["error"]).when(~x["document"], "Missing word/document.xml").when(x["total"] > cfg.max_uncompressed_mb * MB, "Uncompressed size too large")
        .when(x["entries"] > cfg.max_entries, "Too many entries").when(x["ratio"] > cfg.max_ratio, "Suspicious compression ratio")
    )
    return rows.withColumn("archive_error", error).drop("__f")


_SYSTEM = "Unexpected system error: "


def validate(files: DataFrame, cfg: FileConfig = CFG, backend: Backend = pypdf_backend) -> DataFrame:
    """(path, content, valid, file_type, size_mb, validation_stage, failure_reason) of files with path, length and content."""
    rows = cheap_checks(files.withColumn("header", F.substring("content", 1, 8)), cfg)
    bad = rows.where("stage is not null").select("path", "content", F.lit(False).alias("valid"), "file_type", "size_mb", F.col("stage").alias("validation_stage"), "failure_reason")

    def deep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(fault=[_fault(k, bytes(c), cfg, backend)[0] for k, c in zip(b["file_type"], b["content"])])

    good = rows.where("stage is null").select("path", "content", "file_type", "size_mb").mapInPandas(deep, "path string, content binary, file_type string, size_mb double, fault string")
    fault = F.col("fault")
    good = good.select("path", "content", fault.isNull().alias("valid"), "file_type", "size_mb", F.when(fault.isNull(), "completed").otherwise("deep_structure_validation").alias("validation_stage"), F.when(fault.isNotNull(), F.concat(F.lit(_SYSTEM), fault)).alias("failure_reason"))
    return bad.unionByName(good)


_META = "struct<title:string,author:string,subject:string,comments:string,last_modified_by:string,revision:string,created:string,modified:string,category:string>"


def extract_docx(df: DataFrame, cfg: FileConfig = CFG) -> DataFrame:
    """(path, text, total_chars, truncated, counts, metadata, health_status, error) of DOCX contents."""
    fields = ("paragraph_count", "non_empty_paragraph_count", "table_count", "textbox_count")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(docx.PROPERTIES.values())
        for b in batches:
            got = [docx.extract(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({
                "path": list(b["path"]), "chunks": [[t for _, t in g["chunks"]] for g in got], **{f: [g[f] for g in got] for f in fields},
                "metadata": [{n: g["metadata"].get(n) for n in names} for g in got], "error": [g["error"] for g in got],
            })

    schema = f"path string, chunks array<string>, {', '.join(f + ' int' for f in fields)}, metadata {_META}, error string"
    rows = df.select("path", "content").mapInPandas(run, schema)
    cut = T.truncate(F.array_join("chunks", "\n"), cfg.max_text_length)
    rows = rows.withColumn("cut", cut)
    return rows.select("path", "cut.text", "cut.total_chars", "cut.truncated", *fields, "metadata", F.when(F.col("cut.truncated"), "Degraded").otherwise("Healthy").alias("health_status"), "error")


def _pages(reader: Any, mode: str) -> Iterator[tuple[int, str, bool]]:
    """(number, text, failed) of each page."""
    for n, page in enumerate(reader.pages, 1):
        try:
            yield n, page_text(page, mode), False
        except Exception:  # noqa: BLE001 - a page that cannot be read does not stop its file
            yield n, "", True


def pdf_pages(df: DataFrame, backend: Backend = pypdf_backend, mode: str = "layout") -> DataFrame:
    """(path, page_no, text, failed, error, metadata): pages of PDF contents; one row with an error where the file cannot be read.

    The metadata stand beside each file's first page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    reader = _pdf(bytes(raw), backend)
                    meta = {"filename": path.rpartition("/")[2]} | {name: None if (x := (reader.metadata or {}).get(k)) is None else str(x) for k, name in PDF_PROPERTIES.items()}
                    out += [(path, n, text, failed, None, meta if n == 1 else None) for n, text, failed in _pages(reader, mode)]
                except ImportError:
                    out.append((path, 0, "", True, "pdf backend unavailable", None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, 0, "", True, f"Invalid PDF: {e}", None))
            yield pd.DataFrame(out, columns=["path", "page_no", "text", "failed", "error", "metadata"])

    return df.select("path", "content").mapInPandas(run, f"path string, page_no int, text string, failed boolean, error string, metadata {_PDF_META}")


def pdf_has_text(df: DataFrame, backend: Backend = pypdf_backend, mode: str = "layout") -> DataFrame:
    """(path, has_text): whether any page has text; reading stops at the first. False for files that cannot be read."""

    def one(raw: bytes) -> bool:
        try:
            return any(text for _, text, _ in _pages(_pdf(raw, backend), mode))
        except Exception:  # noqa: BLE001
            return False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "has_text": [one(bytes(c)) for c in b["content"]]})

    return df.select("path", "content").mapInPandas(run, "path string, has_text boolean")


def collect_pages(pages: DataFrame, cfg: FileConfig = CFG, keep_empty_pages: bool = False) -> DataFrame:
    """(path, text, total_chars, truncated, page_count, ocr_required, failed_pages): pages (path, page_no, text, failed) joined in order.

    Empty pages are left out unless ``keep_empty_pages``; a document without text needs OCR. A document's pages are bound by ``max_pages``.
    """
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("failed") if keep_empty_pages else T.strip(F.col("text")) != "", F.struct("page_no", "text")))), lambda p: p["text"]), "\n\n")
    g = pages.groupBy("path").agg(
        body.alias("t"), F.count(F.lit(1)).cast("int").alias("page_count"), (F.count_if(T.strip(F.col("text")) != "") == 0).alias("ocr_required"),
        F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("page_no")))).alias("failed_pages"),
    )
    return g.withColumn("cut", T.truncate(F.col("t"), cfg.max_text_length)).select("path", "cut.text", "cut.total_chars", "cut.truncated", "page_count", "ocr_required", "failed_pages")


def process(files: DataFrame, cfg: FileConfig = CFG, text_cfg: TextConfig = T.CFG, backend: Backend = pypdf_backend, mode: str = "layout") -> DataFrame:
    """(path, file_type, success, text, stats, sections, error): validate, extract by type, post-process.

    Each file is opened once: what the deep check has opened is read on.
    """
    rows = cheap_checks(files.withColumn("header", F.substring("content", 1, 8)), cfg)
    refused = rows.where("stage is not null").select("path", "file_type", F.lit(None).cast("string").alias("body"), F.concat(F.lit("Validation failed: "), "failure_reason").alias("failed"))

    def one(kind: str, raw: bytes) -> tuple[str | None, str | None]:
        fault, reader = _fault(kind, raw, cfg, backend)
        if fault:
            return None, f"Validation failed: {_SYSTEM}{fault}"
        if kind == "pdf":
            return "\n\n".join(text for _, text, _ in _pages(reader, mode) if text), None
        got = docx.extract(raw)
        return (None, f"Extraction failed: {got['error']}") if got["error"] else ("\n".join(t for _, t in got["chunks"]), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, k, *one(k, bytes(c))) for p, k, c in zip(b["path"], b["file_type"], b["content"])]
            yield pd.DataFrame(out, columns=["path", "file_type", "body", "failed"])

    opened = rows.where("stage is null").select("path", "file_type", "content").mapInPandas(run, "path string, file_type string, body string, failed string")
    every = refused.unionByName(opened).withColumn("raw", T.truncate(F.col("body"), cfg.max_text_length)["text"]).drop("body")
    done = T.post_process(every, "raw", text_cfg)
    error = F.coalesce("failed", F.when(F.col("error").isNotNull(), F.concat(F.lit("Post-processing failed: "), "error")))
    return done.select("path", "file_type", error.isNull().alias("success"), F.when(F.col("failed").isNull(), F.col("processed")).alias("text"), "stats", "sections", error.alias("error"))
