"""SQLite, REST and URL scans as Python data sources: rows are fetched by tasks, by pages or ranges."""

from __future__ import annotations

import csv
import io
import json
import sqlite3
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE, TIMEOUT = 5_000, 15
SKIPPED_ENDPOINTS = ("departments", "leads")


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return [r[0] for r in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.path, self.table, self.parts, self.width = options["path"], options["table"], int(options.get("partitions", 4)), len(schema.fields)

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            for row in con.execute(f'select * from "{self.table}" where rowid between ? and ? order by rowid', partition.value):
                yield tuple(None if v is None else str(v) for v in row)


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "goldvein_sqlite"

    def schema(self):
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            return ", ".join(f"`{r[1]}` string" for r in con.execute(f'pragma table_info("{self.options["table"]}")'))

    def reader(self, schema):
        return SqliteReader(schema, self.options)


def from_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    """A SQLite table, all text, read by ranges of its rowid; an unknown table is a ValueError."""
    if table not in sqlite_tables(path):
        raise ValueError(f"no table {table!r} in {path}")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("goldvein_sqlite").options(path=path, table=table, partitions=partitions).load()


def fetch(url: str, timeout: float = TIMEOUT):
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.headers.get("Content-Type", ""), r.read()


def records(blob: bytes) -> list[dict]:
    """Rows of a JSON answer: a list, or an object that holds one under ``data``."""
    got = json.loads(blob)
    got = got.get("data", got) if isinstance(got, dict) else got
    return got if isinstance(got, list) else [got]


def rest_pages(base: str, page: int = PAGE, get=fetch):
    """All rows of an endpoint: pages until a short one."""
    offset = 0
    while True:
        rows = records(get(f"{base}?limit={page}&offset={offset}")[1])
        yield from rows
        if len(rows) < page:
            return
        offset += page


def text_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = lambda v: "" if v is None or v != v else json.dumps(v) if isinstance(v, (dict, list)) else str(v)
    return spark.createDataFrame([tuple(text(r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names) or "empty string")


def from_rest(spark: SparkSession, base: str, page: int = PAGE, get=fetch) -> DataFrame:
    """An endpoint's rows as text; absent and NaN values are ''."""
    return text_frame(spark, list(rest_pages(base, page, get)))


def rest_endpoints(base: str, get=fetch) -> list[str]:
    """Endpoints that a service's schema names, if its health answers."""
    get(f"{base}/api/v1/health")
    schema = json.loads(get(f"{base}/api/v1/schema")[1])
    names = schema.get("endpoints", schema) if isinstance(schema, dict) else schema
    return [n for n in names if n not in SKIPPED_ENDPOINTS]


def from_url(spark: SparkSession, url: str, timeout: float = 30, get=fetch) -> DataFrame:
    """JSON by content type or suffix, else CSV."""
    kind, blob = get(url, timeout)
    if "json" in kind or url.lower().split("?")[0].endswith(".json"):
        return text_frame(spark, records(blob))
    return text_frame(spark, list(csv.DictReader(io.StringIO(blob.decode("utf-8-sig", "replace")))))


def describe_tables(spark: SparkSession, path: str) -> DataFrame:
    """table, rows, columns of a SQLite database."""
    out = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        for t in sqlite_tables(path):
            out.append((t, con.execute(f'select count(*) from "{t}"').fetchone()[0], [r[1] for r in con.execute(f'pragma table_info("{t}")')]))
    return spark.createDataFrame(out, "table string, rows long, columns array<string>").orderBy(F.col("table"))
