"""Names of landing tables and source systems, as driver functions and as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def landing_table(source: str | None) -> str:
    low = re.sub(r"\.(csv|xlsx?|json|tsv|pdf)$", "", (source or "unknown").strip().lower())
    kind, rest = next(((k, low[len(p):]) for p, k in (("api_", "api_"), ("db_", "sqlite_")) if low.startswith(p)), ("file_", low))
    return f"landing_{kind}" + re.sub("_+", "_", re.sub("[^a-z0-9_]+", "_", rest)).strip("_")


def landing_table_column(c: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c))), r"\.(csv|xlsx?|json|tsv|pdf)$", "")
    kind = F.when(low.startswith("api_"), "api_").when(low.startswith("db_"), "sqlite_").otherwise("file_")
    rest = F.regexp_replace(low, "^(api_|db_)", "")
    return F.concat(F.lit("landing_"), kind, F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "[^a-z0-9_]+", "_"), "_+", "_"), "^_|_$", ""))


def source_system_column(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(low.startswith("api_"), F.concat(F.lit("rest_api_"), F.regexp_replace(F.substring(low, 5, 10_000), r"\.csv$", "")))
        .when(low.startswith("db_"), F.concat(F.lit("sqlite_"), F.regexp_replace(F.substring(low, 4, 10_000), r"\.csv$", "")))
        .when(low.endswith(".pdf"), F.concat(F.lit("pdf_"), F.regexp_replace(low, r"\.pdf$", "")))
        .otherwise(F.concat(F.lit("file_"), F.regexp_replace(low, r"\.(csv|xlsx|xls|json|tsv)$", "")))
    )


def source_system(name: str | None) -> str:
    low = (name or "").lower().strip()
    for head, kind in (("api_", "rest_api_"), ("db_", "sqlite_")):
        if low.startswith(head):
            return kind + re.sub(r"\.csv$", "", low[len(head) :])
    return "pdf_" + low[:-4] if low.endswith(".pdf") else "file_" + re.sub(r"\.(csv|xlsx|xls|json|tsv)$", "", low)
