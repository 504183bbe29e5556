"""Suggestions of a language model for columns and schemas. The model is a function from a prompt to its answer, given by
the caller; nothing here calls one. Answers are taken in several shapes and checked against the known fields."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans import entities
from . import profile

# The entities whose columns are suggested, names under which an answer may give the field, confidences
# where an answer gives none.
ENTITIES = ["Customers", "Vendors", "Products", "Invoices", "Employees"]
FIELD_NAMES = ["field", "mapped_field", "canonical_field", "target", "result"]
STATED, SINGLE, NESTED, MENTIONED = 0.7, 0.85, 0.8, 0.7
NOT_MENTIONED = "customer_id"


def number(value, other: float) -> float:
    try:
        return float(value) or other
    except (TypeError, ValueError):
        return other


def answered(raw: str, fields: list[str]) -> tuple[str, float, str] | None:
    """(field, confidence, reason) from an answer: an object with ``master_field``; an object of one pair, column to
    field; an object with another name for the field; else the first known field that the text mentions."""
    try:
        got = json.loads(raw)
    except ValueError:
        got = None
    field, sure, reason = "", 0.0, ""
    if isinstance(got, dict):
        reason = str(got.get("reason") or "")
        if "master_field" in got:
            field, sure = str(got["master_field"] or "").strip(), number(got.get("confidence"), STATED)
        elif len(got) == 1 and isinstance(next(iter(got.values())), str):
            field, sure = next(iter(got.values())).strip(), SINGLE
        elif other := next((n for n in FIELD_NAMES if isinstance(got.get(n), str)), None):
            field, sure = got[other].strip(), number(got.get("confidence"), NESTED)
    if field.upper() in ("", "NONE"):
        first = next((f for f in fields if f in raw.lower()), None)
        field, sure = (first, MENTIONED) if first != NOT_MENTIONED else (None, 0.0)
    return (field, sure, reason) if field in fields else None


class ColumnMapper:
    """Suggested fields for a source's columns. Answers, also those that name none, are kept in the catalogue."""

    def __init__(self, ask: Callable[[str], str], catalog=None):
        self.ask, self.catalog = ask, catalog
        self.known = {(r["entity"], r["source_column"]): r for r in (catalog.rows("column_mappings") if catalog else [])}
        self.asked = Counter()

    def suggest(self, entity: str, column: str, samples: list) -> tuple[str, float] | None:
        if entity not in ENTITIES:
            return None
        key = (entity, column.lower())
        if key not in self.known:
            fields = entities.REGISTRY[entity].columns
            values = [str(s)[:30] for s in samples if s is not None and str(s).strip()][:5]
            prompt = f"Fields of {entity}: {', '.join(fields)}\nColumn: {column}\nValues: {json.dumps(values, ensure_ascii=False)}\nAnswer with JSON: master_field (one of the fields, or NONE), confidence (0 to 1), reason."
            self.asked[entity] += 1
            try:
                got = answered(self.ask(prompt), fields)
            except (OSError, ValueError):
                return None  # not kept: the model may answer another time
            row = {"entity": entity, "source_column": key[1], "samples": json.dumps(values), "field": got[0] if got else None, "confidence": got[1] if got else 0.0, "reason": got[2] if got else ""}
            self.known[key] = row
            if self.catalog:
                self.catalog.append("column_mappings", row)
        row = self.known[key]
        return (row["field"], row["confidence"]) if row["field"] else None

    def for_table(self, entity: str, df: DataFrame) -> Callable[[str], tuple[str, float] | None]:
        """``suggest`` of ``staging.map_to_master`` for a table: samples are its first values."""
        head = [r.asDict() for r in df.limit(5).collect()]
        return lambda column: self.suggest(entity, column, [r[column] for r in head])

    def stats(self) -> dict[str, int]:
        """Kept answers by entity."""
        return dict(Counter(e for e, _ in self.known))


def schema_notes(df: DataFrame, table: str, ask: Callable[[str], str]) -> dict:
    """What the model says about a table's schema: its JSON, the object within its text, or the text as ``raw``."""
    stats = {r["column"]: r.asDict() for r in profile.column_stats(df).collect()}
    head = [r.asDict() for r in df.limit(5).collect()]
    columns = [{"name": c, "type": t, "nullable": stats[c]["nulls"] > 0, "unique": stats[c]["unique"], "sample": [str(r[c]) for r in head[:2]]} for c, t in df.dtypes]
    prompt = f"Table {table}\nColumns: {json.dumps(columns, ensure_ascii=False)}\nRows: {json.dumps(head, default=str, ensure_ascii=False)[:1000]}\nAnswer with JSON: detected_entity, suggested_indexes, type_corrections, relationship_hints, notes."
    try:
        raw = ask(prompt)
    except (OSError, ValueError) as e:
        return {"error": str(e)}
    for text in (raw, *re.findall(r"(?s)\{.*\}", raw)):
        try:
            got = json.loads(text)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return {"raw": raw}
