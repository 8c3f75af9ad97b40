"""Excel workbooks, read and written as the zipped XML that they are.

A sheet has a million rows at most, so one task handles it.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import date, datetime, timedelta
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import AdapterError

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_ROWS = 1_048_576


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def _bytes(spark: SparkSession, path: str) -> bytes | None:
    """A file's content through Spark's readers, so any store will do; None if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row["content"])


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_M}sheets")
    return {s.get("name"): "xl/" + links[s.get(f"{_R}id")].lstrip("/").removeprefix("xl/") for s in found}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter(f"{_M}numFmt")}
    dates = {k for k, code in custom.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code.lower()))} | {*range(14, 23), *range(45, 48)}
    cells = root.find(f"{_M}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in dates}


def parse_sheet(content: bytes, sheet: str) -> list[list[Any]]:
    """All rows of a sheet; empty cells are None."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        raise AdapterError("not a workbook of zipped XML; older binary workbooks can't be read")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = _sheets(book)
        if sheet not in names:
            raise AdapterError(f"no sheet {sheet!r}; there are {', '.join(names)}")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{_M}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates, rows = _date_styles(book), []
        for row in ElementTree.fromstring(book.read(names[sheet])).iter(f"{_M}row"):
            cells: list[Any] = []
            for k, c in enumerate(row.iter(f"{_M}c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [None] * (at + 1 - len(cells))
                kind, value = c.get("t", "n"), c.findtext(f"{_M}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                elif value is None or kind == "e":
                    cells[at] = None
                elif kind == "s":
                    cells[at] = shared[int(value)]
                elif kind == "b":
                    cells[at] = value == "1"
                elif kind in ("str", "d"):
                    cells[at] = value
                else:
                    number = float(value)
                    if int(c.get("s", 0)) in dates:
                        cells[at] = datetime(1899, 12, 30) + timedelta(days=number)
                    else:
                        cells[at] = int(number) if number.is_integer() and "." not in value and "E" not in value else number
            rows.append(cells)
        return rows


def _typed(values: list[Any]) -> tuple[T.DataType, list[Any]]:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int}:
        return (T.LongType() if kinds else T.StringType()), values
    if kinds <= {int, float}:
        return T.DoubleType(), [None if v is None else float(v) for v in values]
    if kinds <= {bool}:
        return T.BooleanType(), values
    if kinds <= {datetime}:
        return T.TimestampNTZType(), values
    return T.StringType(), [None if v is None else str(v) for v in values]


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet whose first row has the names."""
    content = _bytes(spark, path)
    if content is None:
        raise AdapterError(f"{path} doesn't exist")
    rows = parse_sheet(content, sheet)
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    names = [str(n) if n is not None else f"Unnamed: {k}" for k, n in enumerate(rows[0])]
    body = [r + [None] * (len(names) - len(r)) for r in rows[1:] if any(v is not None for v in r)]
    columns = [_typed([r[k] for r in body]) for k in range(len(names))]
    schema = T.StructType([T.StructField(n, kind) for n, (kind, _) in zip(names, columns, strict=True)])
    return spark.createDataFrame(list(zip(*(v for _, v in columns), strict=True)) if body else [], schema)


def _cell(at: str, value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    if isinstance(value, datetime | date):
        moment = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        return f'<c r="{at}" s="1"><v>{(moment - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))}</t></is></c>'


def build_workbook(sheets: dict[str, list[list[Any]]]) -> bytes:
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _M[1:-1], _R[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        package = "http://schemas.openxmlformats.org/package/2006"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(sheets)))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(sheets))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets)))
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId0" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for k, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{i + 1}">' + "".join(_cell(f"{_letters(j)}{i + 1}", v) for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows))
            book.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_sheet(spark: SparkSession, path: str, sheet: str, frame: DataFrame, append: bool = False) -> int:
    """Replaces or extends one sheet and keeps the others; over a million rows is an error."""
    rows = [list(r) for r in frame.limit(MAX_ROWS).collect()]
    sheets: dict[str, list[list[Any]]] = {}
    content = _bytes(spark, path)
    if content is not None:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = list(_sheets(book))
        sheets = {n: parse_sheet(content, n) for n in names}
    header, body = list(frame.columns), rows
    if append and sheets.get(sheet):
        old_header, *old = sheets[sheet]
        header = [*old_header, *(c for c in frame.columns if c not in old_header)]
        at = [frame.columns.index(c) if c in frame.columns else None for c in header]
        body = old + [[None if k is None else r[k] for k in at] for r in rows]
    if len(body) >= MAX_ROWS:
        raise AdapterError(f"a sheet holds fewer than {MAX_ROWS} rows")
    sheets[sheet] = [header, *body]
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stage = jvm.org.apache.hadoop.fs.Path(f"{path}.stage")
    stream = fs.create(stage, True)
    stream.write(bytearray(build_workbook(sheets)))
    stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(stage, target)
    return len(rows)
