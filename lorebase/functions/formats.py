"""Text of linked bodies and files: kind detection and the readers per kind.

Office files are ZIP archives of XML, read with the standard library. PDF needs a
library that is not part of this environment; such bodies give no text unless
``pypdf`` can be imported.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.arrow import arrow_function
from lorebase import fixed
from lorebase.functions.html import body_text
from lorebase.functions.text import tidy

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def kind_of(body: Column, content_type: Column) -> Column:
    """pdf, docx, xlsx, html, text, docx_or_xlsx or null; the content type decides before the bytes."""
    declared = F.lower(F.coalesce(content_type, F.lit("")))
    head = F.lower(F.decode(F.substring(body, 1, 5), "ISO-8859-1"))
    kind = None
    for token, name in fixed.MIME_KINDS:
        test = F.contains(declared, F.lit(token))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    for magic, name in fixed.MAGIC_KINDS:
        kind = kind.when(head.startswith(magic), name)
    return kind.when(F.hex(F.substring(body, 1, 4)) == fixed.ZIP_MAGIC_HEX, "docx_or_xlsx")


def _run_text(paragraph) -> str:
    out = []
    for node in paragraph.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _word_body(body: bytes):
    with zipfile.ZipFile(io.BytesIO(body)) as archive:
        return ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")


def docx_text(body: bytes) -> str:
    """Paragraphs, then the rows of the tables with `` | `` between the cells."""
    top = _word_body(body)
    parts = [t for t in (_run_text(p) for p in top.findall(f"{_W}p")) if t]
    for table in top.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            cells = ["\n".join(_run_text(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
            if any(cells):
                parts.append(" | ".join(cells))
    return "\n".join(parts)


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]*", reference or "").group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _cell_value(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    value = cell.find(f"{_S}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    return value.text


def xlsx_rows(body: bytes):
    """(sheet title, row values) in workbook order; missing cells are null."""
    with zipfile.ZipFile(io.BytesIO(body)) as archive:
        names = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{_S}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_S}t")))
        targets = {
            r.get("Id"): r.get("Target")
            for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        }
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            data = ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in data.iter(f"{_S}row"):
                values: list[str | None] = []
                for cell in row.findall(f"{_S}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(values)
                    values.extend([None] * (at + 1 - len(values)))
                    values[at] = _cell_value(cell, shared)
                rows.append(values)
            yield sheet.get("name"), rows


def xlsx_text(body: bytes) -> str:
    parts = []
    for title, rows in xlsx_rows(body):
        parts.append(f"## {title}")
        for row in rows:
            cells = ["" if v is None else v for v in row]
            if any(c.strip() for c in cells):
                parts.append(" | ".join(cells))
    return "\n".join(parts)


def pdf_text(body: bytes) -> str:
    from pypdf import PdfReader

    return "\n\n".join(t for t in (page.extract_text() or "" for page in PdfReader(io.BytesIO(body)).pages) if t)


def _docx_or_xlsx(body: bytes) -> str:
    try:
        return docx_text(body)
    except Exception:
        return xlsx_text(body)


_READERS = {
    "pdf": pdf_text,
    "docx": docx_text,
    "xlsx": xlsx_text,
    "docx_or_xlsx": _docx_or_xlsx,
    "html": lambda body: body_text(body.decode("utf-8", errors="replace")),
    "text": lambda body: body.decode("utf-8", errors="replace"),
}


@arrow_function(T.StringType())
def _read(bodies: pd.Series, kinds: pd.Series) -> pd.Series:
    def one(body: bytes | None, kind: str | None) -> str | None:
        if not body or kind not in _READERS:
            return None
        try:
            return _READERS[kind](bytes(body))
        except Exception:
            return None

    return pd.Series([one(b, k) for b, k in zip(bodies, kinds)], dtype="object")


def linked_text(body: Column, content_type: Column) -> Column:
    """Plain text of a linked body; null where the kind is unknown, reading fails or nothing is left."""
    return F.nullif(tidy(_read(body, kind_of(body, content_type))), F.lit(""))


def _file_docx(body: bytes) -> str:
    return "\n\n".join(t for t in (_run_text(p) for p in _word_body(body).findall(f"{_W}p")) if t.strip())


def _file_xlsx(body: bytes) -> str:
    lines = []
    for _, rows in xlsx_rows(body):
        for row in rows:
            cells = [v for v in row if v is not None]
            if cells:
                lines.append(" | ".join(cells))
    return "\n".join(lines)


_FILES = {"pdf": pdf_text, "docx": _file_docx, "xlsx": _file_xlsx}


def file_text(body: bytes, name: str) -> str | None:
    """Text of a file by its extension; null for other extensions and unreadable files."""
    reader = _FILES.get(name.rsplit(".", 1)[-1].lower() if "." in name else "")
    try:
        return reader(body) if reader else None
    except Exception:
        return None
