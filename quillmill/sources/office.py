"""Zipped XML formats: what a page or sheet says, a file a row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

#: The parts of each format that hold text, and the elements that end a line.
PARTS = {
    "docx": r"word/document\.xml$",
    "pptx": r"ppt/slides/slide(\d+)\.xml$",
    "odt": r"content\.xml$",
    "epub": r".*\.x?html?$",
}
LINES = {"p", "h", "tr", "table-row", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml_text(raw: bytes) -> str:
    """The text of an XML part: a line for each paragraph, heading or row, headings of word processors marked by their level."""
    out: list[str] = []

    def cell(node: ElementTree.Element) -> str:
        return " ".join("".join(t.text or "" for t in p.iter() if _local(str(t.tag)) in ("t", "span")) or "".join(p.itertext()) for p in node.iter() if _local(str(p.tag)) == "p").strip()

    def walk(node: ElementTree.Element) -> None:
        name = _local(node.tag) if isinstance(node.tag, str) else ""
        if name in ("script", "style", "head"):
            return
        if name == "tbl":  # a table of a word processor or a slide: a line of bars for each row
            for row in (r for r in node if _local(str(r.tag)) == "tr"):
                out.append("\n| " + " | ".join(" ".join(cell(c).split()) for c in row if _local(str(c.tag)) == "tc") + " |\n")
            return
        out.append(node.text or "")
        level = next((re.search(r"\d", v) for x in node.iter() if _local(str(x.tag)) == "pStyle" for v in x.attrib.values() if "eading" in v), None) if name == "p" else None
        if level:
            out.append("#" * int(level[0]) + " ")
        for child in node:
            walk(child)
            out.append(child.tail or "")
        out.append("\n" if name in LINES else "\t" if name == "tab" else "")

    walk(ElementTree.fromstring(raw))
    return "\n".join(line for x in "".join(out).split("\n") if (line := " ".join(x.split())))


#: Fills that say how a row stands, and the kind of graphic that is a diagram.
STATUS = {"FF00FF00": "[Status: Green]", "FFFF0000": "[Status: Red]"}
DIAGRAM = "http://schemas.openxmlformats.org/drawingml/2006/diagram"


def _fills(book: zipfile.ZipFile) -> list[str | None]:
    """What the fill of each cell format says, by the style tables: the format's fill, that fill's first colour."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    table = lambda name: next((list(x) for x in root if _local(x.tag) == name), [])
    colours = [next((c.get("rgb") for c in fill.iter() if _local(c.tag) == "fgColor"), None) for fill in table("fills")]
    return [next((word for rgb, word in STATUS.items() if (colours[int(x.get("fillId", 0))] or "").startswith(rgb)), None) for x in table("cellXfs")]


def sheet_cells(raw: bytes) -> Iterator[tuple[str, int, list[str | None], list[str | None]]]:
    """(sheet, row from 0, cells, marks) of a workbook; a cell's marks are its comment as a note and the state that its colour stands for."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    fills = _fills(book)
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in (s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"):
        target = targets[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].removeprefix("/xl/")
        rels, notes = f"xl/{target.replace('worksheets/', 'worksheets/_rels/')}.rels", {}
        if rels in names:
            for r in ElementTree.fromstring(book.read(rels)):
                if r.get("Type", "").endswith("/comments"):
                    part = r.get("Target", "").replace("../", "xl/").removeprefix("/")
                    for c in (c for c in ElementTree.fromstring(book.read(part)).iter() if _local(c.tag) == "comment"):
                        notes[c.get("ref")] = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
        for i, row in enumerate(r for r in ElementTree.fromstring(book.read(f"xl/{target}")).iter() if _local(r.tag) == "row"):
            cells: list[str | None] = []
            marks: list[str | None] = []
            for c in row:
                letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
                at = _column(letters[0]) if letters else len(cells)
                value = next((x.text for x in c if _local(x.tag) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                style = int(c.get("s", 0))
                found = [f"[Note: {notes[c.get('r')].strip()}]"] if c.get("r") in notes else []
                found += [fills[style]] if style < len(fills) and fills[style] else []
                gap = [None] * (at - len(cells))
                cells += [*gap, value]
                marks += [*gap, " ".join(found) or None]
            yield sheet.get("name", ""), int(row.get("r", i + 1)) - 1, cells, marks


#: What a broken file of a zipped format raises.
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, StopIteration, ValueError)
ROWS = "path string, sheet string, sheet_no int, row_no int, cells array<string>, marks array<string>, width int, error string"


def rows(files: DataFrame) -> DataFrame:
    """ROWS of all workbooks among files (path, content, ext): a broken one is a row with the reason."""
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("marks", pa.list_(pa.string())), ("width", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    found = list(sheet_cells(raw.as_py()))
                except BROKEN as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": f"{type(e).__name__}: {e}"[:200]}], schema=schema)
                    continue
                width: dict[str, int] = {}
                for sheet, _, cells, _ in found:
                    width[sheet] = max(width.get(sheet, 0), len(cells))
                number = {s: i for i, s in enumerate(dict.fromkeys(f[0] for f in found), 1)}
                out = [
                    {"path": path, "sheet": s, "sheet_no": number[s], "row_no": n, "cells": c + [None] * (width[s] - len(c)), "marks": m + [None] * (width[s] - len(m)), "width": width[s]} for s, n, c, m in found
                ]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.where("ext = 'xlsx'").select("path", "content").mapInArrow(run, ROWS)


def merges(files: DataFrame) -> DataFrame:
    """(path, sheet, row_no, last_row, column, last_column) of the merged cells of all workbooks, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = [(path, *m) for m in merged_cells(raw.as_py())]
                if out:
                    kinds = [pa.string(), pa.string()] + [pa.int32()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["path", "sheet", "row_no", "last_row", "column", "last_column"])

    return files.where("ext = 'xlsx'").select("path", "content").mapInArrow(run, "path string, sheet string, row_no int, last_row int, column int, last_column int")


def merged_cells(raw: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    book = zipfile.ZipFile(io.BytesIO(raw))
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in (s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"):
        target = targets[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].removeprefix("/xl/")
        for m in (m for m in ElementTree.fromstring(book.read(f"xl/{target}")).iter() if _local(m.tag) == "mergeCell"):
            (a, x), (b, y) = (re.match(r"([A-Z]+)(\d+)", c).groups() for c in (m.get("ref", "A1").split(":") * 2)[:2])
            yield sheet.get("name", ""), int(x) - 1, int(y) - 1, _column(a), _column(b)


def _column(letters: str) -> int:
    return sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1


def pages(files: DataFrame) -> DataFrame:
    """(path, page_no, text, error) of files (path, content, ext) in these formats; a sheet or slide is a page, a broken file a row with the reason."""
    schema = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw, ext in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                try:
                    out = [{"path": path, "page_no": i, "text": t, "error": None} for i, t in enumerate(page_texts(raw.as_py(), ext), 1)]
                except BROKEN as e:
                    out = [{"path": path, "page_no": 1, "text": None, "error": f"{type(e).__name__}: {e}"[:200]}]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content", "ext").mapInArrow(run, "path string, page_no int, text string, error string")


def page_texts(raw: bytes, ext: str) -> list[str]:
    """The text of each slide or part of a file."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    parts = [n for n in book.namelist() if re.match(PARTS[ext], n)]
    number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    return [slide_text(book, n) if ext == "pptx" else xml_text(book.read(n)) for n in sorted(parts, key=number)]


def _line(text: str) -> str:
    return " ".join(text.split())


def _letters(node: ElementTree.Element) -> list[str]:
    """The lines of a drawing's text runs that are not empty."""
    return [x for t in node.iter() if _local(str(t.tag)) == "t" and (x := _line(t.text or ""))]


def slide_text(book: zipfile.ZipFile, part: str) -> str:
    """A slide's shapes in order, groups from the inside: tables and diagrams in marked blocks, of other shapes a line.

    A diagram's texts lie in parts of their own, which the slide's relations name; a text that comes again counts once."""
    rels = re.sub(r"slides/", "slides/_rels/", part) + ".rels"
    targets = {r.get("Id"): r.get("Target", "").replace("../", "ppt/").removeprefix("/") for r in ElementTree.fromstring(book.read(rels))} if rels in book.namelist() else {}
    out: list[str] = []

    def shapes(node: ElementTree.Element) -> None:
        for x in node:
            name = _local(str(x.tag))
            if name == "grpSp":
                shapes(x)
            elif name == "graphicFrame":
                data = next((d for d in x.iter() if _local(str(d.tag)) == "graphicData"), None)
                table = next((t for t in x.iter() if _local(str(t.tag)) == "tbl"), None)
                if table is not None:
                    cells = [[_line(" ".join(_letters(c))) for c in row if _local(str(c.tag)) == "tc"] for row in table if _local(str(row.tag)) == "tr"]
                    if lines := [" | ".join(c) for c in cells if any(c)]:
                        out.append("\n".join(["[Table]", *lines, "[/Table]"]))
                elif data is not None and data.get("uri") == DIAGRAM:
                    lines = _letters(x)
                    ids = next((r for r in data.iter() if _local(str(r.tag)) == "relIds"), None)
                    for key in ("dm", "qs", "cs", "lo") if ids is not None else ():
                        target = targets.get(next((v for k, v in ids.attrib.items() if _local(k) == key), None))
                        if target in book.namelist():
                            lines += _letters(ElementTree.fromstring(book.read(target)))
                    if lines:
                        out.append("\n".join(["[SmartArt Diagram]", *dict.fromkeys(lines), "[/SmartArt Diagram]"]))
            elif name in ("sp", "cxnSp"):
                paragraphs = ("".join(t.text or "" for t in p.iter() if _local(str(t.tag)) == "t") for p in x.iter() if _local(str(p.tag)) == "p")
                if line := _line("\n".join(paragraphs)):
                    out.append(line)

    for tree in (t for t in ElementTree.fromstring(book.read(part)).iter() if _local(str(t.tag)) == "spTree"):
        shapes(tree)
    return "\n".join(out)
