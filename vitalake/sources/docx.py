"""Text and properties of DOCX packages, from their XML, with the standard library only.

Order: body (paragraphs and tables as they come), then headers and footers per section, then text boxes.
Hyperlink targets follow their paragraph; table rows join their cells with bars. Broken packages give an error.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Core properties and their names here.
PROPERTIES = {"title": "title", "creator": "author", "subject": "subject", "description": "comments", "lastModifiedBy": "last_modified_by", "revision": "revision", "created": "created", "modified": "modified", "category": "category"}


def tidy(text: str) -> str:
    """Compatibility form, line ends as line feeds, blanks and blank lines squeezed, trimmed."""
    s = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", s)).strip()


def package_facts(raw: bytes) -> dict:
    """entries, total bytes, largest ratio, whether there is a document part; or an error."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            infos = z.infolist()
            ratio = max((i.file_size / i.compress_size for i in infos if i.compress_size > 0), default=0.0)
            return {"entries": len(infos), "total": sum(i.file_size for i in infos), "ratio": float(ratio), "document": "word/document.xml" in z.namelist(), "error": None}
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        return {"entries": 0, "total": 0, "ratio": 0.0, "document": False, "error": f"Invalid DOCX: {e}"}


def _text(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == W + "txbxContent":
            break
        out.append({W + "t": x.text or "", W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}.get(x.tag, ""))
    return "".join(out)


def _rows(table: ET.Element) -> list[str]:
    rows = []
    for tr in table.findall(W + "tr"):
        cells = [tidy("\n".join(_text(p) for p in tc.findall(W + "p"))) for tc in tr.findall(W + "tc")]
        if line := " | ".join(c for c in cells if c):
            rows.append(line)
    return rows


def extract(raw: bytes, keep_empty: bool = False) -> dict:
    """chunks (kind, text), counts, metadata and error of one package."""
    out = {"chunks": [], "paragraph_count": 0, "non_empty_paragraph_count": 0, "table_count": 0, "textbox_count": 0, "metadata": {}, "error": None}
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = set(z.namelist())
            body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
            rels = {}
            if "word/_rels/document.xml.rels" in names:
                rels = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("word/_rels/document.xml.rels")).findall(REL + "Relationship")}
            for x in body if body is not None else []:
                if x.tag == W + "p":
                    out["paragraph_count"] += 1
                    text = tidy(_text(x))
                    links = list(dict.fromkeys(rels[h.get(R + "id")] for h in x.iter(W + "hyperlink") if h.get(R + "id") in rels))
                    if text:
                        out["non_empty_paragraph_count"] += 1
                    if links:
                        text += f" [Links: {' | '.join(links)}]"
                    if text or keep_empty:
                        out["chunks"].append(("paragraph", text))
                elif x.tag == W + "tbl":
                    out["table_count"] += 1
                    out["chunks"] += [("table", r) for r in _rows(x)]
            sections = [s for s in (body.iter(W + "sectPr") if body is not None else [])]
            for i, s in enumerate(sections, 1):
                for tag, name in (("headerReference", "Header"), ("footerReference", "Footer")):
                    for ref in s.findall(W + tag):
                        part = "word/" + rels.get(ref.get(R + "id"), "").lstrip("/")
                        if part in names:
                            words = " ".join(t for p in ET.fromstring(z.read(part)).iter(W + "p") if (t := tidy(_text(p))))
                            if words:
                                out["chunks"].append((name.lower(), f"[{name} {i}] {words}"))
            for box in body.iter(W + "txbxContent") if body is not None else []:
                words = " ".join(t for p in box.iter(W + "p") if (t := tidy(_text(p))))
                if words:
                    out["textbox_count"] += 1
                    out["chunks"].append(("textbox", f"[Textbox] {words}"))
            if "docProps/core.xml" in names:
                for x in ET.fromstring(z.read("docProps/core.xml")):
                    if (k := PROPERTIES.get(x.tag.rpartition("}")[2])) and x.text:
                        out["metadata"][k] = x.text
    except (KeyError, zipfile.BadZipFile, ET.ParseError, OSError, ValueError) as e:
        out["error"] = f"Invalid DOCX: {e}"
    return out
