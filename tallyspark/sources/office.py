"""Office files as units of text: sheets of workbooks and paragraphs of documents, read inside tasks.

Only the formats that are ZIP archives of XML are read here; for PDF and images no library is at hand, so they come
as rows (document, unit_no, text) or as positioned words (see statements.py).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS = "path string, unit_no int, label string, text string, error string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def sheet_units(content: bytes) -> list[tuple[str, str]]:
    """(label, text) of each sheet, hidden ones too; every cell that has a value as A1=value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        # A sheet's file is known by the workbook's relations, not by its number: sheets may have been moved.
        targets = {}
        if "xl/_rels/workbook.xml.rels" in z.namelist():
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        sheets = []
        for k, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")):
            target = targets.get(s.get(f"{RELATION}id"))
            file = posixpath.normpath(posixpath.join("/xl", target)).lstrip("/") if target else files[k] if k < len(files) else None
            if file in z.namelist():
                sheets.append((s.get("name"), file))
        out = []
        for name, file in sheets:
            cells = []
            for c in ElementTree.fromstring(z.read(file)).iter(f"{MAIN}c"):
                v = c.findtext(f"{MAIN}v")
                if c.get("t") == "s" and v is not None:
                    v = shared[int(v)]
                elif c.get("t") == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                if v is not None:
                    cells.append(f"{c.get('r')}={v}")
            out.append((name, " | ".join(cells)))
        return out


def paragraph_units(content: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if any(n.startswith("word/embeddings/") for n in z.namelist()):
            raise ValueError("embedded objects are not read")
        body = ElementTree.fromstring(z.read("word/document.xml"))
        lines = ["".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in body.iter(f"{WORD}p")]
        return [("text", "\n".join(x for x in lines if x))]


#: Readers by suffix; add one to read another format.
READERS = {".xlsx": sheet_units, ".xlsm": sheet_units, ".docx": paragraph_units, ".txt": lambda b: [("text", b.decode("utf-8-sig"))]}


def read_units(files: DataFrame) -> DataFrame:
    """Rows (path, unit_no, label, text, error) from binaryFile rows; a file that can't be read is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = READERS.get("." + path.rpartition(".")[2].lower())
                try:
                    if reader is None:
                        raise ValueError("unsupported format")
                    rows += [(path, k, label, text, None) for k, (label, text) in enumerate(reader(content.as_py()), 1)]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, 0, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "unit_no", "label", "text", "error"])

    return files.select("path", "content").mapInArrow(run, UNITS)


def cells(units: DataFrame) -> DataFrame:
    """Rows (path, label, row_no, column_name, value) of sheet units."""
    cell = units.select("path", "label", F.explode(F.split("text", r" \| ")).alias("c"))
    part = lambda k: F.regexp_extract("c", r"(?s)^([A-Z]+)([0-9]+)=(.*)$", k)
    return cell.select("path", "label", part(2).cast("int").alias("row_no"), part(1).alias("column_name"), part(3).alias("value"))


# Labels over the columns of payees and amounts; the second ones are compared without white space and in small letters.
NAME_LABELS = ["达人全名", "姓名", "Full Name", "FULL NAME"]
AMOUNT_LABELS = ["金额(rm)", "amount(rm)"]


def payable_rows(sheet_cells: DataFrame) -> DataFrame:
    """Rows (path, label, row_no, party, amount, cells) of sheets that say which columns hold full names and amounts.

    Which columns these are is carried down the rows from the last label of each kind, so a table may move to other columns or
    have its header again; the rightmost of several labels in a row counts. Rows before both labels, without a name or with an
    amount that isn't a positive number give nothing. sheet_cells are rows of cells(); a row's cells are held together, not a sheet's.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    place = F.struct(F.length("column_name").alias("width"), F.col("column_name").alias("column"))
    label_of = lambda found: F.max(F.when(found, place))["column"]
    amount_label = F.lower(F.regexp_replace(F.coalesce("value", F.lit("")), r"(?U)\s", "")).isin(AMOUNT_LABELS)
    whole = F.map_from_entries(F.collect_list(F.struct("column_name", "value")))
    once = sheet_cells.filter("row_no is not null").dropDuplicates(["path", "label", "row_no", "column_name"])
    rows = once.groupBy("path", "label", "row_no").agg(label_of(value.isin(NAME_LABELS)).alias("names"), label_of(amount_label).alias("amounts"), whole.alias("row"))
    down = Window.partitionBy("path", "label").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = rows.withColumns({c: F.last(c, ignorenulls=True).over(down) for c in ("names", "amounts")}).filter("names is not null and amounts is not null")
    party = F.trim(F.try_element_at("row", F.col("names")))
    amount = F.trim(F.replace(F.replace(F.try_element_at("row", F.col("amounts")), F.lit("RM")), F.lit(",")))
    read = bound.select("path", "label", "row_no", party.alias("party"), amount.try_cast("decimal(38,10)").alias("amount"), F.array(F.concat("names", F.col("row_no").cast("string")), F.concat("amounts", F.col("row_no").cast("string"))).alias("cells"))
    return read.filter("party != '' and amount > 0").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
