"""Invoices and tables out of free text (from PDF or OCR): native expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx

# Field patterns, searched without regard to case.
FIELDS = {
    "invoice_no": r"(?:invoice|bill|receipt)\s*(?:no\.?|number|#)\s*[:\-]?\s*([A-Za-z0-9\-_/]+)",
    "invoice_date": r"(?:invoice|bill|issue)\s*date\s*[:\-]?\s*([0-9]{1,4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,4})",
    "due_date": r"due\s*date\s*[:\-]?\s*([0-9]{1,4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,4})",
    "total": r"(?:total|amount|grand\s*total|balance\s*due)\s*[:\-]?\s*\$?([0-9,]+\.?[0-9]*)",
    "customer_id": r"customer\s*id\s*[:\-]\s*([CV]-[0-9]+)",
}
#: these end before the next label, which needs lookahead
PARTIES = {
    "customer": r"(?:bill\s*to|customer|client)\s*[:\-]?\s*([^\n\r]+?)(?=\s*(?:from|vendor|supplier|invoice|date|sku|description|$)|\n|\r)",
    "vendor": r"(?:from|vendor|supplier)\s*[:\-]?\s*([^\n\r]+?)(?=\s*(?:sku|description|qty|invoice|date|$)|\n|\r)",
}
LEAST_TEXT, LEAST_CONFIDENCE = 50, 60


def first_match(c: Column, pattern: str) -> Column:
    """The first match's group, without ends of white space and trailing ``,.``; null if there is none."""
    hit = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, f"(?i){pattern}", 1), r"^\s+|\s+$", ""), "[,.]+$", "")
    return F.when(c.rlike(f"(?i){pattern}"), hit)


def key_values(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with the seven fields. A customer that is only an id moves to customer_id."""
    c = F.col(column)
    out = df.withColumns({name: first_match(c, p) for name, p in {**FIELDS, **PARTIES}.items()})
    bare = r"(?i)^(?:id|customer\s*id)\s*[:\-]?\s*[CV]-[0-9]+$"
    is_id = F.coalesce(F.col("customer").rlike(bare), F.lit(False))
    return out.withColumns(
        {
            "customer_id": F.coalesce("customer_id", F.when(is_id, F.regexp_extract("customer", "(?i)([CV]-[0-9]+)", 1))),
            "customer": F.when(~is_id, F.col("customer")),
        }
    )


def ocr_rows(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, line, cells) of lines with three and more parts between double spaces, where a text has two such lines;
    ``header`` is true on the first line of a text unless that starts with digits throughout."""
    lines = F.filter(F.transform(F.split(column, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    cells = F.filter(F.transform(lines, lambda x: F.split(x, r"\s{2,}")), lambda p: F.size(p) >= 3)
    kept = df.select(F.col(key), cells.alias("rows")).filter("size(rows) >= 2")
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    numeric = F.forall(F.filter(F.get("rows", F.lit(0)), lambda h: h != ""), lambda h: h.rlike("^[0-9]"))
    wide = kept.withColumns({"width": width, "headless": numeric})
    return wide.select(key, "width", "headless", F.posexplode("rows").alias("line", "cells")).select(
        key, "line", F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))).alias("cells"), (~F.col("headless") & (F.col("line") == 0)).alias("header")
    )


def table_rows(df: DataFrame, header: str, rows: str) -> DataFrame:
    """List-of-lists tables: blank headers become ``col_i``, blank rows go, rows are cut or padded to the header."""
    head = F.transform(header, lambda h, i: F.when(fx.is_blank(h), F.concat(F.lit("col_"), i.cast("string"))).otherwise(F.trim(h)))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit("").cast("string"), F.size(header))), 1, F.size(header))
    filled = F.filter(rows, lambda r: F.exists(r, lambda x: ~fx.is_blank(x)))
    return df.withColumns({header: head, rows: F.transform(filled, lambda r: F.transform(fit(r), lambda x: F.coalesce(x, F.lit(""))))})


def usable(n_tables: Column, text: Column) -> Column:
    """Whether extraction gave enough, so that no OCR is needed."""
    return (n_tables > 0) | (F.length(F.trim(F.coalesce(text, F.lit("")))) > LEAST_TEXT)


def invoice_headers(fields: DataFrame, lines: DataFrame, key: str, amount: str = "amount") -> DataFrame:
    """One row per document: its fields, line count, sum and JSON of its lines; the total falls back to the line sum."""
    value = fx.number(fx.clean_currency(F.col(amount).cast("string")))
    sums = lines.groupBy(key).agg(
        F.count("*").alias("line_item_count"),
        F.sum(value).alias("line_items_sum"),
        F.to_json(F.sort_array(F.collect_list(F.struct(*[c for c in lines.columns if c != key])))).alias("line_items_json"),
    )
    total = fx.number(fx.clean_currency(F.col("total")))
    return fields.join(sums, key, "left").withColumn("amount", F.coalesce(total, F.col("line_items_sum")))


def from_pdf(spark, folder: str, extractor) -> DataFrame:
    """(path, text, tables, confidence) of the PDFs of a folder by a pluggable function bytes -> dict; one file a row."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            got = [extractor(bytes(b)) for b in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": [g.get("text", "") for g in got], "tables": [g.get("tables", []) for g in got], "confidence": [float(g.get("confidence", 100)) for g in got]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")
    out = files.mapInPandas(run, "path string, text string, tables array<array<array<string>>>, confidence double")
    return out.withColumns({"usable": usable(F.size("tables"), F.col("text")), "warning": F.when(F.col("confidence") < LEAST_CONFIDENCE, "low OCR confidence")})
