"""Text of office documents (word processing, sheets, slides): zipped XML, screened before anything is unpacked."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Bytes of a file, bytes of all its members unpacked, and how often they may be larger than packed.
MAX_BYTES, MAX_UNPACKED, MAX_RATIO = 50 << 20, 512 << 20, 200
OFFICE_SUFFIXES = ("docx", "xlsx", "pptx")


def _members(data: bytes, wanted: re.Pattern) -> dict[str, bytes]:
    """The members that are needed. Declared sizes are checked first, unpacked bytes are counted while reading."""
    if len(data) > MAX_BYTES:
        raise ValueError("file too large")
    out, left = {}, MAX_UNPACKED
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        declared, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
        if declared > MAX_UNPACKED or declared > MAX_RATIO * max(packed, 1):
            raise ValueError("unpacks to too much")
        for i in infos:
            if wanted.fullmatch(i.filename):
                with z.open(i) as f:
                    body = f.read(min(left, i.file_size) + 1)
                if len(body) > min(left, i.file_size):
                    raise ValueError("unpacks to too much")
                if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
                    raise ValueError("declares entities")
                left -= len(body)
                out[i.filename] = body
    return out


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _texts(e) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def document_text(data: bytes) -> str:
    """Paragraphs, those in heading styles marked as in Markdown, rows of tables with bars."""
    body = _members(data, re.compile(r"word/document\.xml")).get("word/document.xml")
    lines = []

    def walk(e) -> None:
        if _local(e) == "tr":
            lines.append("| " + " | ".join(_texts(c).strip() for c in e if _local(c) == "tc") + " |")
        elif _local(e) == "p":
            style = next((v for x in e.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            level = re.fullmatch(r"[Hh]eading\s?([1-6])", style)
            text = _texts(e).strip()
            if text:
                lines.append("#" * int(level[1]) + " " + text if level else text)
        else:
            for c in e:
                walk(c)

    if body:
        walk(ElementTree.fromstring(body))
    return "\n".join(lines)


def sheet_text(data: bytes) -> str:
    """A heading for each sheet, a line with bars for each row that holds something."""
    parts = _members(data, re.compile(r"xl/(sharedStrings|worksheets/sheet\d+)\.xml"))
    shared = []
    if "xl/sharedStrings.xml" in parts:
        shared = [_texts(e) for e in ElementTree.fromstring(parts.pop("xl/sharedStrings.xml")) if _local(e) == "si"]
    lines = []
    for name in sorted(parts, key=_number):
        lines.append(f"## Sheet {_number(name)}")
        for row in (e for e in ElementTree.fromstring(parts[name]).iter() if _local(e) == "row"):
            cells = []
            for c in (c for c in row if _local(c) == "c"):
                value = next((v.text or "" for v in c if _local(v) == "v"), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else _texts(c) if c.get("t") == "inlineStr" else value)
            if any(cells):
                lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines)


def slide_text(data: bytes) -> str:
    """A heading for each slide, a line for each paragraph."""
    parts = _members(data, re.compile(r"ppt/slides/slide\d+\.xml"))
    lines = []
    for name in sorted(parts, key=_number):
        lines.append(f"## Slide {_number(name)}")
        lines += [t for t in (_texts(e).strip() for e in ElementTree.fromstring(parts[name]).iter() if _local(e) == "p") if t]
    return "\n".join(lines)


READERS = {"docx": document_text, "xlsx": sheet_text, "pptx": slide_text}


def office_text(files: DataFrame) -> DataFrame:
    """``path, text, error`` of (path, content) with an office suffix; other files are left out.

    A file that is damaged, refused by the screen or null has a null text and the reason in ``error``.
    """
    def work(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                fn = READERS.get((path or "").rsplit(".", 1)[-1].lower())
                if fn is None:
                    continue
                try:
                    rows.append((path, fn(bytes(content)), None))
                except Exception as e:  # a file that can't be read is a result, not a failure of the job
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(work, "path string, text string, error string")
