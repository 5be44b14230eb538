"""File scans that end in elements. Unreadable files give an error row, never a failed job."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.functions.text import html_elements, markdown_elements, org_elements, text_elements
from askloom.schemas import LIST_ITEM, NARRATIVE, TITLE

FILE_ELEMENTS = "source_id string, elem_ord bigint, category string, text string, error string"


# A cell in quotes; possessive, so that a long one needs no stack.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def csv_cells(record: Column, sep: str = ",") -> Column:
    """Trimmed cells of one record, without the quotes around them."""
    s = re.escape(sep)
    # a separator in front, so that every cell, also an empty one, is a match of its own
    cell_of = rf'(?s){s}(?: *+{QUOTED}[ \r]*+(?={s}|\z)|[^{s}]*+)'
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(cell_of), F.lit(0))

    def plain(cell: Column) -> Column:
        text = F.trim(F.substring(cell, len(sep) + 1, 1 << 30))
        quoted = text.rlike(r'(?s)\A".*"\z') & (F.length(text) >= 2)
        inner = F.replace(F.regexp_replace(text, r'(?s)\A"|"\z', ""), F.lit('""'), F.lit('"'))
        return F.trim(F.btrim(F.when(quoted, inner).otherwise(text), F.lit("\r\n")))

    return F.transform(found, plain)


def csv_elements(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """One element per record, cells joined by a blank; ``sep='\\t'`` reads TSV.

    Records may have any number of cells; a quoted cell may hold the separator and doubled quotes.
    Without ``multi_line`` a large file is read by many tasks.
    """
    lines = record_lines(spark.read.text(path, wholetext=multi_line))
    if multi_line:
        record = F.regexp_extract_all("_record", F.lit(rf'(?:{QUOTED}|[^"\n]++|")++'), F.lit(0))
        lines = lines.select("source_id", "_start", F.explode_outer(record).alias("_record"))
    return record_elements(lines, sep)


def record_lines(read: DataFrame) -> DataFrame:
    """Lines of text files with the file and the split of it that they are from."""
    place = [F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("_start")]
    return read.select(*place, F.col("value").alias("_record"))


def record_elements(lines: DataFrame, sep: str) -> DataFrame:
    """Elements of ``record_lines``. Record numbers come from counts per file split plus a number inside the split,
    so no task sees more than one split.
    """
    line = F.array_join(F.filter(csv_cells(F.col("_record"), sep), lambda c: F.length(c) > 0), " ")
    numbered = lines.select("source_id", "_start", F.monotonically_increasing_id().alias("_at"), line.alias("text"))
    rows = numbered.where(F.length("text") > 0)
    split = ["source_id", "_start"]
    before = Window.partitionBy("source_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*split).agg(F.count("*").alias("_n"))
    bases = bases.select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("_at"))
    return rows.join(bases, split).select(
        "source_id",
        (F.col("_base") + inside - 1).alias("elem_ord"),
        F.lit(NARRATIVE).alias("category"),
        "text",
    )


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as rows ``(source_id, text)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("text")
    )


# How each text format becomes elements.
TEXT_FORMATS = {
    "txt": text_elements,
    "md": markdown_elements,
    "org": org_elements,
    "html": html_elements,
}


def elements_of(ext: str, text: Column) -> Column:
    return TEXT_FORMATS[ext](text)


def explode_elements(docs: DataFrame, *keys: str) -> DataFrame:
    """Documents with an ``elements`` array to one row per element.

    Outer: a plain generator would add a "not empty" filter that repeats the array's computation.
    """
    rows = docs.select(*keys, F.posexplode_outer("elements").alias("elem_ord", "e"))
    return rows.where(F.col("e").isNotNull()).select(
        *keys, F.col("elem_ord").cast("bigint").alias("elem_ord"), "e.category", "e.text"
    )


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


# What the marks between runs of text stand for.
BREAKS = {"br": "\n", "cr": "\n", "tab": "\t", "noBreakHyphen": "-"}


def _joined(node: ElementTree.Element, leaf: str) -> str:
    """Text of a node's own runs: paragraphs nested in it, as in text boxes, speak for themselves."""
    parts: list[str] = []

    def walk(n: ElementTree.Element) -> None:
        for child in n:
            name = _local(child.tag)
            if name == leaf:
                parts.append(child.text or "")
            elif name in BREAKS:
                parts.append(BREAKS[name])
            elif name not in ("p", "pPr", "rPr", "Fallback"):
                walk(child)

    walk(node)
    return "".join(parts).strip()


def _attribute(node: ElementTree.Element, owner: str, name: str) -> str:
    for n in node.iter():
        if _local(n.tag) == owner:
            for key, value in n.attrib.items():
                if _local(key) == name:
                    return value
    return ""


def _numbered(names: list[str], pattern: str) -> list[str]:
    """Archive members matching ``pattern`` in the order of the number in their name."""
    found = [(int(m.group(1)), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [name for _, name in sorted(found)]


def _docx(archive: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    root = ElementTree.fromstring(archive.read("word/document.xml"))
    # the same box is stored again for older programs
    again = {id(n) for f in root.iter() if _local(f.tag) == "Fallback" for n in f.iter()}
    for p in root.iter():
        if _local(p.tag) != "p" or id(p) in again:
            continue
        style = _attribute(p, "pStyle", "val").lower()
        is_item = any(_local(n.tag) == "numPr" for n in p.iter())
        is_title = style.startswith("heading") or style == "title"
        yield (TITLE if is_title else LIST_ITEM if is_item else NARRATIVE), _joined(p, "t")


def _pptx(archive: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    for name in _numbered(archive.namelist(), r"ppt/slides/slide(\d+)\.xml"):
        for shape in ElementTree.fromstring(archive.read(name)).iter():
            if _local(shape.tag) == "tr":  # a row of a table, one element
                cells = (" ".join(_joined(p, "t") for p in c.iter() if _local(p.tag) == "p") for c in shape)
                yield NARRATIVE, " ".join(c for c in cells if c)
            if _local(shape.tag) != "sp":
                continue
            is_title = _attribute(shape, "ph", "type") in ("title", "ctrTitle")
            for p in shape.iter():
                if _local(p.tag) == "p":
                    yield (TITLE if is_title else NARRATIVE), _joined(p, "t")


def _xlsx(archive: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
        shared = [_joined(si, "t") for si in root if _local(si.tag) == "si"]
    for name in _numbered(archive.namelist(), r"xl/worksheets/sheet(\d+)\.xml"):
        for row in ElementTree.fromstring(archive.read(name)).iter():
            if _local(row.tag) != "row":
                continue
            cells = []
            for c in row:
                kind = c.attrib.get("t")
                value = _joined(c, "t") if kind == "inlineStr" else _joined(c, "v")
                cells.append(shared[int(value)] if kind == "s" and value else value)
            yield NARRATIVE, " ".join(v for v in cells if v)


# Readers per office format.
OFFICE_READERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def _read_office(uri: str, content: bytes) -> list[tuple]:
    reader = OFFICE_READERS[posixpath.splitext(uri)[1][1:].lower()]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            elements = [(c, t) for c, t in reader(archive) if t]
    except Exception as problem:  # noqa: BLE001 - a damaged file must not fail the job
        return [(uri, None, None, None, f"{type(problem).__name__}: {problem}")]
    return [(uri, i, category, text, None) for i, (category, text) in enumerate(elements)]


def office_elements(files: DataFrame) -> DataFrame:
    """Elements of office files ``(source_id, content)``; a damaged file gives one error row."""
    known = files.where(F.lower(F.regexp_extract("source_id", r"\.([^./]+)\z", 1)).isin(*OFFICE_READERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source_id", "elem_ord", "category", "text", "error"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for uri, content in zip(batch.column("source_id"), batch.column("content")):
                rows = _read_office(uri.as_py(), content.as_py())
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return known.select("source_id", "content").mapInArrow(run, FILE_ELEMENTS)


def office_documents(files: DataFrame) -> DataFrame:
    """Office files ``(source_id, content)`` with their elements in one row, or the error that a damaged one gave."""
    names = ["source_id", "elements", "error"]
    element = pa.struct([("category", pa.string()), ("text", pa.string())])
    types = [pa.string(), pa.list_(element), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, content in zip(batch.column("source_id").to_pylist(), batch.column("content")):
                rows = _read_office(uri, content.as_py())
                error = rows[0][4] if rows else None
                elements = None if error else [{"category": r[2], "text": r[3]} for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((uri, elements, error), types)], names=names)

    return files.select("source_id", "content").mapInArrow(run, "source_id string, elements array<struct<category:string,text:string>>, error string")


def office_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"), "content")
