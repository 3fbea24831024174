"""Spreadsheet workbooks as a Spark data source: a partition for each sheet, read as a stream of rows."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from xml.etree.ElementTree import ParseError, iterparse
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The source travels to the executors by value, so that a cluster needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "src_file string, sheet string, row_idx long, header array<string>, cells array<string>, error string"
ARROW = pa.schema([("src_file", pa.string()), ("sheet", pa.string()), ("row_idx", pa.int64()), ("header", pa.list_(pa.string())), ("cells", pa.list_(pa.string())), ("error", pa.string())])
# What a broken workbook raises: no archive, parts missing, XML that doesn't parse, shared strings out of range.
BROKEN = (zipfile.BadZipFile, KeyError, OSError, ParseError, StopIteration, ValueError, IndexError, EOFError)
#: Rows that are handed on together.
STEP = 2000
#: Partitions of a scan, at most: a task for each of many small sheets would take longer to start than to run.
TASKS = 1000


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its path there; what Arrow reads: local disks, HDFS, S3, GCS."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", uri)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(uri)


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets, in its order."""
    links, names = {}, []
    for _, e in iterparse(book.open("xl/_rels/workbook.xml.rels")):
        if _tag(e) == "Relationship":
            links[e.get("Id")] = "xl/" + e.get("Target").lstrip("/").removeprefix("xl/")
    for _, e in iterparse(book.open("xl/workbook.xml")):
        if _tag(e) == "sheet":
            names.append((e.get("name"), links[next(v for k, v in e.attrib.items() if k.endswith("}id"))]))
    return names


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, e in iterparse(book.open("xl/sharedStrings.xml")):
            if _tag(e) == "si":
                out.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
                e.clear()
    return out


@lru_cache(maxsize=1)
def strings_of(uri: str, size: int) -> list[str]:
    """A workbook's shared strings, read once by a worker that reads its sheets one after the other."""
    where, path = store(uri)
    with where.open_input_file(path) as f, zipfile.ZipFile(f) as book:
        return shared_strings(book)


def rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list[str | None]]:
    """Cells of each row as text; shared and inline strings are resolved, gaps are null. Rows are dropped from the tree as they
    are read, so a sheet takes no more memory than a row."""
    data = None
    for event, e in iterparse(book.open(part), events=("start", "end")):
        if event == "start":
            data = e if _tag(e) == "sheetData" else data
            continue
        if _tag(e) != "row":
            continue
        cells: list[str | None] = []
        for c in e:
            at, ref = len(cells), re.match(r"[A-Z]+", c.get("r") or "")
            if ref:
                at = 0
                for letter in ref[0]:
                    at = at * 26 + ord(letter) - 64
                at -= 1
            cells.extend([None] * (at - len(cells)))
            value = "".join(t.text or "" for t in c.iter() if _tag(t) in ("v", "t"))
            cells.append(shared[int(value)] if c.get("t") == "s" and value else value or None)
        if data is not None:
            data.clear()
        yield cells


@dataclass
class Sheet(InputPartition):
    """A sheet to read, or why a file can't be read."""

    uri: str
    size: int
    name: str | None
    part: str | None
    error: str | None


@dataclass
class Sheets(InputPartition):
    """Sheets that one task reads, one after the other."""

    own: list[Sheet]


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.which = options["path"], options.get("sheets", "all")
        self.wanted = [c.strip().upper() for c in options.get("columns", "").split(",") if c.strip()]

    def partitions(self) -> list[Sheets]:
        """Sheets of all .xlsx and .xls files of the folder, or of the one file; only the lists of sheets are read here, many at once.
        A sheet is a partition; of more than TASKS, neighbours share one."""
        where, path = store(self.uri)
        found = where.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        files = [found] if found.type == fs.FileType.File else [f for f in where.get_file_info(fs.FileSelector(path)) if re.search(r"\.xlsx?$", f.path, re.I)]

        def look(f: fs.FileInfo) -> list[Sheet]:
            uri = self.uri if found.type == fs.FileType.File else f"{self.uri.rstrip('/')}/{f.base_name}"
            book = None
            try:
                with where.open_input_file(f.path) as opened, zipfile.ZipFile(opened) as book:
                    own = [Sheet(uri, f.size, name, part, None) for name, part in sheets(book)]
            except BROKEN as e:
                return [Sheet(uri, f.size, None, None, f"broken: {type(e).__name__}" if book else "no workbook")]
            return own[:1] if self.which == "first" else own

        with ThreadPoolExecutor(16) as pool:
            found_sheets = [s for own in pool.map(look, sorted(files, key=lambda f: f.base_name)) for s in own]
        step = -(-len(found_sheets) // TASKS) or 1
        return [Sheets(found_sheets[i : i + step]) for i in range(0, len(found_sheets), step)]

    def read(self, sheets: Sheets) -> Iterator[pa.RecordBatch]:
        for sheet in sheets.own:
            yield from self.read_sheet(sheet)

    def read_sheet(self, sheet: Sheet) -> Iterator[pa.RecordBatch]:
        file, out = sheet.uri.rpartition("/")[2], []
        error = (file, sheet.name, None, None, None)
        if sheet.error:
            yield self.batch([(*error, sheet.error)])
            return
        try:
            where, path = store(sheet.uri)
            shared = strings_of(sheet.uri, sheet.size)
            with where.open_input_file(path) as f, zipfile.ZipFile(f) as book:
                it = rows(book, sheet.part, shared)
                head = [(c or "").strip() for c in next(it, [])]
                kept = [i for i, c in enumerate(head) if not self.wanted or c.upper() in self.wanted]
                names = [head[i] for i in kept]
                for i, cells in enumerate(it):
                    out.append((file, sheet.name, i, names, [cells[j] if j < len(cells) else None for j in kept], None))
                    if len(out) == STEP:
                        yield self.batch(out)
                        out = []
        except BROKEN as e:
            out.append((*error, f"broken: {type(e).__name__}"))
        if out:
            yield self.batch(out)

    @staticmethod
    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), ARROW.types, strict=True)], schema=ARROW)


class WorkbookSource(DataSource):
    """format("workbook"): every row of every sheet of a folder's workbooks, as text.

    Options: ``columns``, headers (with commas between, case doesn't matter) whose cells alone are kept; ``sheets``, all (the
    default) or first. A file or sheet that breaks gives one row with an error; other files go on."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def scan(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(src_file, sheet, row_idx, header, cells, error) of a folder's workbooks; see WorkbookSource."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").options(**options).load(folder)


def write(df: DataFrame, folder: str, book: str, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """Writes a workbook for each value of ``book`` into the folder, with a sheet of the columns for each value of ``sheet``, rows in the
    order of ``order``; returns (path, n) as written. A workbook is made by one task, so give a book a bounded number of rows.

    A task that is run again writes the same file anew; a file appears under its name when it is whole."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(v) -> str:
        return "<c/>" if v is None or v != v else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def make(t: pd.DataFrame) -> pd.DataFrame:
        out, names = io.BytesIO(), sorted(t[sheet].unique())
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(str(s))} r:id="r{i}"/>' for i, s in enumerate(names)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
            for i, s in enumerate(names):
                lines = [columns, *t[t[sheet] == s].sort_values(order)[columns].itertuples(index=False)]
                z.writestr(f"xl/worksheets/sheet{i}.xml", "<worksheet><sheetData>" + "".join(f"<row>{''.join(map(cell, x))}</row>" for x in lines) + "</sheetData></worksheet>")
        where, path = store(folder)
        where.create_dir(path, recursive=True)
        name = f"{path}/{t[book].iloc[0]}.xlsx"
        part = f"{path}/.{t[book].iloc[0]}.{id(out)}.part"
        with where.open_output_stream(part) as f:
            f.write(out.getvalue())
        where.move(part, name)
        return pd.DataFrame({"path": [name], "n": [len(t)]})

    made = df.select(*dict.fromkeys([book, sheet, order, *columns])).groupBy(book).applyInPandas(make, "path string, n long")
    return df.sparkSession.createDataFrame(made.collect(), "path string, n long")


def columns(sheet_rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Fields by the first of their headers that a row's sheet has, without regard to case; null without any."""
    low = F.transform("header", lambda h: F.upper(h))

    def cell(aliases: list[str]):
        at = F.coalesce(*[F.nullif(F.array_position(low, a.upper()), F.lit(0)) for a in aliases])
        return F.when(at.isNotNull(), F.get("cells", (at - 1).cast("int")))

    kept = sheet_rows.filter("error is null")
    return kept.select("src_file", "sheet", "row_idx", *[cell(a).alias(f) for f, a in names.items()])
