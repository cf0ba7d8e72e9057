"""Spreadsheets (.xlsx) with the standard library. A workbook is one compressed document, so it is read and written whole on the
driver; it is a format for small tables."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Mapping, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import SourceError
from quillon.operators.frame import quoted
from quillon.sources.csvfile import csv_value
from quillon.types import cast_column, infer_columns

# The namespaces and the built-in date formats of the file format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
EPOCH = dt.datetime(1899, 12, 30)
MAX_ROWS = 1_048_576


def _q(tag: str) -> str:
    return f"{{{MAIN}}}{tag}"


def cell_place(ref: str) -> tuple[int, int]:
    """'B3' as (row 2, column 1), both from 0."""
    match = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref)
    if not match:
        raise SourceError(f"no cell reference: {ref!r}")
    column = 0
    for letter in match[1].upper():
        column = column * 26 + ord(letter) - 64
    return int(match[2]) - 1, column - 1


def cell_name(row: int, column: int) -> str:
    letters, column = "", column + 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def _text(node: ET.Element | None) -> str:
    """Rich text joined."""
    return "".join(t.text or "" for t in node.iter(_q("t"))) if node is not None else ""


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(_q("numFmt"))}
    dates = DATE_FORMATS | {i for i, code in own.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code), re.I)}
    xfs = root.find(_q("cellXfs"))
    return {i for i, xf in enumerate(xfs if xfs is not None else ()) if int(xf.get("numFmtId", 0)) in dates}


def _value(cell: ET.Element, shared: Sequence[str], date_styles: set[int]) -> object:
    kind, v = cell.get("t", "n"), cell.find(_q("v"))
    if kind == "inlineStr":
        return _text(cell.find(_q("is")))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind == "e":
        return None
    if kind in ("str", "d"):
        return v.text
    number = float(v.text)
    return EPOCH + dt.timedelta(days=number) if int(cell.get("s", 0)) in date_styles else number


def _sheet_file(book: zipfile.ZipFile, sheet: str | int) -> str:
    root = ET.fromstring(book.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), links[s.get(f"{{{RELS}}}id")]) for s in root.iter(_q("sheet"))]
    if isinstance(sheet, int):
        if not 0 <= sheet < len(sheets):
            raise SourceError(f"no sheet {sheet}")
        target = sheets[sheet][1]
    else:
        target = dict(sheets).get(sheet)
        if target is None:
            raise SourceError(f"no sheet {sheet!r}")
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def read_excel(spark: SparkSession, path: str, *, sheet: str | int = 0, has_header: bool = True, range_: str | None = None, dtypes: Mapping[str, str] | None = None) -> DataFrame:
    """A sheet by name or 0-based number, or a range such as ``A1:G100`` of it; formulas give their results."""
    try:
        with zipfile.ZipFile(path.removeprefix("file://")) as book:
            shared = [_text(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(_q("si"))] if "xl/sharedStrings.xml" in book.namelist() else []
            styles = _date_styles(book)
            root = ET.fromstring(book.read(_sheet_file(book, sheet)))
    except (OSError, zipfile.BadZipFile, KeyError) as error:
        raise SourceError(f"cannot read {path!r}") from error
    cells = {cell_place(c.get("r")): _value(c, shared, styles) for c in root.iter(_q("c"))}
    if range_:
        (top, left), (bottom, right) = (cell_place(p) for p in range_.split(":"))
    else:
        top, left = 0, 0
        bottom, right = max((r for r, _ in cells), default=-1), max((c for _, c in cells), default=-1)
    grid = [[cells.get((r, c)) for c in range(left, right + 1)] for r in range(top, bottom + 1)]
    names = [str(x) if x is not None else f"column_{i}" for i, x in enumerate(grid[0])] if has_header and grid else [f"column_{i}" for i in range(right - left + 1)]
    body = [r for r in (grid[1:] if has_header else grid) if any(x is not None for x in r)]
    schema, rows = infer_columns({n: [r[i] for r in body] for i, n in enumerate(names)})
    df = spark.createDataFrame(rows, schema)
    return df.select(*[(cast_column(quoted(f.name), f.dataType, dtypes[f.name]) if dtypes and f.name in dtypes else quoted(f.name)).alias(f.name) for f in schema.fields])


def write_excel(
    df: DataFrame,
    path: str,
    *,
    sheet: str = "Sheet1",
    auto_filter: bool = False,
    freeze_panes: tuple[int, int] | None = None,
    column_widths: Mapping[str, float] | None = None,
    start_cell: str = "A1",
) -> None:
    """One sheet with a header; ``freeze_panes`` is (rows, columns)."""
    top, left = cell_place(start_cell)
    kinds = [f.dataType for f in df.schema.fields]
    plain = [k.typeName() in ("double", "float", "integer", "long", "short", "byte", "boolean") for k in kinds]
    shaped = df.select(*[quoted(f.name) if p else csv_value(quoted(f.name), f.dataType).alias(f.name) for f, p in zip(df.schema.fields, plain)])

    def cell(r: int, c: int, value: object) -> str:
        ref = cell_name(r, c)
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value!r}</v></c>' if value == value and abs(value) != float("inf") else ""
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    rows, at = [[*df.columns]], top
    out = []
    for record in shaped.toLocalIterator():
        rows.append(list(record))
        if len(rows) + top > MAX_ROWS:
            raise SourceError("too many rows for a sheet")
    for record in rows:
        out.append(f'<row r="{at + 1}">' + "".join(cell(at, left + i, v) for i, v in enumerate(record) if v is not None) + "</row>")
        at += 1
    view = ""
    if freeze_panes:
        y, x = freeze_panes
        view = f'<sheetViews><sheetView workbookViewId="0"><pane {f"xSplit={quoteattr(str(x))} " if x else ""}{f"ySplit={quoteattr(str(y))} " if y else ""}topLeftCell="{cell_name(y, x)}" state="frozen"/></sheetView></sheetViews>'
    widths = "".join(f'<col min="{left + i + 1}" max="{left + i + 1}" width="{(column_widths or {})[c]}" customWidth="1"/>' for i, c in enumerate(df.columns) if c in (column_widths or {}))
    last = cell_name(max(at - 1, top), left + max(len(df.columns) - 1, 0))
    filtered = f'<autoFilter ref="{cell_name(top, left)}:{last}"/>' if auto_filter else ""
    body = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}">{view}{f"<cols>{widths}</cols>" if widths else ""}<sheetData>{"".join(out)}</sheetData>{filtered}</worksheet>'
    book = f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>'
    types = f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
    rel = f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELS}/{{}}" Target="{{}}"/></Relationships>'
    with zipfile.ZipFile(path.removeprefix("file://"), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", types)
        z.writestr("_rels/.rels", rel.format("officeDocument", "xl/workbook.xml"))
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/_rels/workbook.xml.rels", rel.format("worksheet", "worksheets/sheet1.xml"))
        z.writestr("xl/worksheets/sheet1.xml", body)


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path.removeprefix("file://")) as book:
        return [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).iter(_q("sheet"))]


def as_rows(df: DataFrame) -> DataFrame:
    """Every column as the text a sheet would show."""
    return df.select(*[F.coalesce(csv_value(quoted(f.name), f.dataType), F.lit("")).alias(f.name) for f in df.schema.fields])
