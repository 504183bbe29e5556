"""File scans by extension, and the sinks of the landing, staging and export layers."""

from __future__ import annotations

import os
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store

def local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """A scan chosen by extension. Missing: FileNotFoundError; other extension: ValueError; unreadable: RuntimeError."""
    ext = os.path.splitext(path)[1].lower()
    scans = {".csv": read_csv, ".tsv": read_tsv, ".xlsx": read_xlsx, ".xls": read_xlsx, ".json": read_json, ".parquet": lambda s, p: s.read.parquet(p)}
    if not Store(spark).exists(path):
        raise FileNotFoundError(path)
    if ext not in scans:
        raise ValueError(f"unsupported file type {ext!r}")
    try:
        return scans[ext](spark, path)
    except Exception as e:
        raise RuntimeError(f"can't read {path}: {e}") from e


def text_facts(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(all lines are UTF-8, a line has an odd number of quotes), over the whole file: tasks read its bytes by splits."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("odd")).first()
    return row["utf8"] is not False, bool(row["odd"])


def strings(df: DataFrame) -> DataFrame:
    """Blank isn't null in text files: empty fields come back as ''."""
    return df.fillna("")


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> DataFrame:
    """All columns as text. UTF-8 if the whole file is, else Latin-1, which always fits. A field may hold line breaks
    only if some line has an odd number of quotes; any other file is read by splits."""
    utf8, odd = text_facts(spark, path)
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=odd, escape='"', encoding=encoding or ("UTF-8" if utf8 else "ISO-8859-1"))
    first = df.columns[0] if df.columns else ""
    return strings(df.withColumnRenamed(first, first.lstrip("\ufeff")) if first.startswith("\ufeff") else df)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t", "UTF-8")


def flattened(df: DataFrame) -> DataFrame:
    """Struct fields as dotted columns, at any depth; arrays stay whole."""

    def walk(kind: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
        return out

    return df.select(*walk(df.schema, ()))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path, multiLine=True)
    if df.columns == ["_corrupt_record"]:
        raise ValueError("neither a list of objects nor an object")
    return flattened(df)


def xlsx_rows(path: str) -> list[list]:
    """Cells of the first sheet, from the file's own XML."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(local(path)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, object] = {}
            for i, c in enumerate(row.findall("m:c", ns)):
                at = 0
                for ch in "".join(x for x in c.get("r", "") if x.isalpha()):
                    at = at * 26 + ord(ch) - 64
                at, kind, v = at - 1 if at else i, c.get("t"), c.find("m:v", ns)
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else None if v is None else v.text
                if kind == "s":
                    text = shared[int(text)]
                elif kind == "b":
                    text = text == "1"
                elif kind is None and text is not None:
                    text = float(text) if "." in text or "e" in text.lower() else int(text)
                cells[at] = text
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheet, first row as header, types from the cells (mixed columns become text). A workbook is one
    driver-sized file: its format has no splits."""
    rows = xlsx_rows(path)
    head = [str(h) if h is not None else f"col_{i}" for i, h in enumerate(rows[0])] if rows else []
    body = [(r + [None] * len(head))[: len(head)] for r in rows[1:]]

    def kind(values: list) -> T.DataType:
        kinds = {type(v) for v in values if v is not None}
        one = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}
        return one[kinds.pop()] if len(kinds) == 1 and kinds <= set(one) else T.DoubleType() if kinds == {int, float} else T.StringType()

    kinds = [kind([r[i] for r in body]) for i in range(len(head))]
    made = {T.StringType(): str, T.DoubleType(): float}
    data = [tuple(None if v is None else made.get(k, lambda x: x)(v) for v, k in zip(r, kinds)) for r in body]
    return spark.createDataFrame(data, T.StructType([T.StructField(h, k) for h, k in zip(head, kinds)]))


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, file_name, length, modified, sha256 of the files of a folder tree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"))


def to_landing(df: DataFrame, table: str, source_system: str, root: str | None = None, at: Column | None = None) -> DataFrame | None:
    """The landing form of a source: all text, nulls stay null, with its system and time; written if ``root`` is given.
    A source without rows writes nothing."""
    out = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).withColumns(
        {"_landing_source_system": F.lit(source_system), "_landing_ingested_at": at if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    )
    if root is None:
        return out
    if df.isEmpty():
        return None
    out.write.mode("overwrite").parquet(f"{root}/{table}")
    return df.sparkSession.read.parquet(f"{root}/{table}")


def export(df: DataFrame, path: str, kind: str) -> None:
    """csv, json (records) or parquet; others: ValueError."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported export format {kind!r}")
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False) if kind == "csv" else writer.json(path) if kind == "json" else writer.parquet(path)


def layers(spark: SparkSession, root: str) -> DataFrame:
    """layer, table, rows, columns of every table under a warehouse folder."""
    found = []
    for name in Store(spark).names(root):
        layer = name.split("_")[0]
        if layer in ("landing", "stg", "master", "norm"):
            df = spark.read.parquet(f"{root}/{name}")
            found.append((layer, name, df.count(), len([c for c in df.columns if not c.startswith("_")])))
    return spark.createDataFrame(found, "layer string, table string, rows long, columns int")
