"""Which entity a table holds: key candidates, fingerprints, routing, and onboarding of new entities."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import entities
from . import profile

SURE, KEY_SHARE = 50, 0.9
ID_ENDS = ("_id", "_no", "_number", "_num", "_code", "_sku")
# Entity, key patterns, telling columns, statuses, columns that add, columns that speak against it.
FINGERPRINTS = [
    ("SalesOrders", ["^SO-[0-9]+$", "^ORD-[0-9]+$", "^O-[0-9]+$"], ["order_id", "qty", "quantity", "product_id", "total_amt"], ["Open", "Shipped", "Delivered", "Cancelled", "Returned"], [], []),
    ("Invoices", ["^(INV|BILL)-([0-9]{4}-)?[0-9]+$"], ["invoice_no", "invoice_id", "due_date", "bill_type"], ["Paid", "Unpaid", "Open", "Overdue", "Pending", "Cancelled", "Refunded", "Draft"], ["invoice"], ["qty", "quantity", "product_id"]),
    ("Shipments", ["^SHP-[0-9]+$", "^TRK-?[0-9]+$"], ["ship_id", "tracking_no", "shipped_dt", "carrier"], ["Shipped", "Delivered", "In Transit", "Processing", "Returned"], [], []),
    ("Customers", ["^C-[0-9]{4,6}$"], ["customer_id", "full_name", "email"], ["Active", "Inactive", "Pending", "Suspended"], [], ["invoice_no", "invoice_id", "bill_type", "order", "order_id", "order_number", "product_id", "product_sku", "product_name", "product_category", "quantity", "qty", "unit_price", "total", "total_amt", "tax", "discount", "payment_method", "shipped_dt", "ship_id"]),
    ("Vendors", ["^V-[0-9]{4,6}$"], ["vendor_id", "vendor_name", "contact_phone"], ["Active", "Inactive"], [], ["full_name", "invoice_no", "order", "order_id", "order_number", "product_sku", "quantity", "qty"]),
    ("Employees", ["^E-[0-9]{4,6}$", "^EMP-[0-9]+$"], ["employee_id", "emp_id", "department_code", "salary"], ["Active", "Inactive", "Terminated", "On Leave"], [], []),
    ("Products", ["^SKU-[A-Z0-9-]+$", "^P-[0-9]+$"], ["sku", "product_name", "msrp", "category"], [], [], []),
    ("Payments", ["^PMT-[0-9]+$"], ["pmt_id", "pmt_amt", "reference_no", "payment_method"], [], [], []),
    ("Opportunities", ["^OPP-[0-9]+$"], ["opp_id", "opp_name", "close_dt", "owner_emp_id"], [], [], []),
    ("Contracts", ["^CT-[0-9]+$"], ["contract_id", "contract_value", "end_dt"], [], [], []),
    ("Accounts", ["^A-[0-9]{4,6}$"], ["acct_id", "account_name", "annual_revenue", "employee_count"], [], [], []),
    ("Locations", ["^LOC-[0-9]+$"], ["loc_id", "city", "country"], [], [], []),
    ("Departments", ["^D-[0-9]+$"], ["department_code", "dept_name", "cost_center"], [], [], []),
    ("Inventory", ["^INVT-[0-9]+$"], ["inv_item_id", "last_count_dt", "quantity"], [], [], []),
]


def id_like(name: str) -> bool:
    return name.lower().endswith(ID_ENDS) or name.lower() in ("id", "sku")


def key_candidates(df: DataFrame) -> DataFrame:
    """column, filled, distinct_values, id_like of the columns with at least 90 % distinct values."""
    s = profile.column_stats(df).withColumn("filled", F.col("rows") - F.col("nulls"))
    named = F.lower("column").rlike("(_id|_no|_number|_num|_code|_sku)$") | F.lower("column").isin("id", "sku")
    return s.filter((F.col("filled") > 0) & (F.col("distinct_values") >= KEY_SHARE * F.col("filled"))).select("column", "filled", "distinct_values", named.alias("id_like"))


def best_keys(df: DataFrame, top: int = 5) -> list[str]:
    rows = {r["column"]: r for r in key_candidates(df).collect()}
    names = [c for c in df.columns if c in rows]
    names.sort(key=lambda c: (not rows[c]["id_like"], -rows[c]["distinct_values"] / rows[c]["filled"]))
    return names[:top] or df.columns[:1]


def scores(df: DataFrame, file_name: str | None = None) -> list[tuple[str, int]]:
    """(entity, score) by falling score, from the key candidates' first values and the status vocabulary."""
    if not df.columns or df.isEmpty():
        return []
    keys, low = best_keys(df), [c.lower() for c in df.columns]
    firsts = {k: [str(r[0]) for r in df.select(F.col(f"`{k}`")).filter(F.col(f"`{k}`").isNotNull()).limit(20).collect()] for k in keys}
    status = next((c for c in df.columns if "status" in c.lower()), None)
    seen = {r[0] for r in df.select(F.trim(F.col(f"`{status}`").cast("string"))).filter(F.col(f"`{status}`").isNotNull()).distinct().limit(200).collect()} if status else set()
    out = []
    for entity, patterns, telling, vocabulary, adds, against in FINGERPRINTS:
        hit = any(vs and sum(bool(re.match(p, v)) for v in vs) > 0.8 * len(vs) for vs in firsts.values() for p in patterns)
        score = 50 * hit + min(30, 10 * sum(any(t in c for c in low) for t in telling))
        words = set(vocabulary)
        if words and seen:
            score += 15 if seen <= words else 5 if seen & words else 0
        score += 5 * sum(any(t in c for c in low) for t in adds) - 20 * sum(any(t in c for c in low) for t in against)
        out.append((entity, score))
    if file_name and (hint := next((e for w, e in entities.FILE_HINTS.items() if w in file_name.lower()), None)):
        out = [(e, s + 10 if e == hint and s > 20 else s) for e, s in out]
    return sorted(out, key=lambda x: -x[1])


def classify(df: DataFrame, file_name: str | None = None) -> tuple[str | None, int]:
    ranked = scores(df, file_name)
    return (None, 0) if not ranked else (ranked[0][0] if ranked[0][1] >= SURE else None, ranked[0][1])


def unique_share(df: DataFrame, column: str) -> float:
    r = df.agg(F.countDistinct(F.col(f"`{column}`")).alias("d"), F.count("*").alias("n")).first()
    return r["d"] / r["n"] if r["n"] else 0.0


def route(df: DataFrame, file_name: str) -> tuple[str | None, str]:
    """(entity, how): classified, if a key column is there and distinct enough; else by the file's name."""
    entity, _ = classify(df, file_name)
    if entity:
        spec = entities.REGISTRY[entity]
        have = {c.lower(): c for c in df.columns}
        key = next((have[a] for a in spec.fields[spec.key] if a in have), None)
        if key and unique_share(df, key) >= KEY_SHARE:
            return entity, "classifier"
    named = entities.entity_for_file(file_name)
    return (named, "file name") if named else (None, "none")


LEAST_ROWS, LEAST_COLUMNS, MOST_A_DAY = 10, 3, 5
NAME = re.compile("^[A-Z][a-zA-Z]{2,30}$")
FORBIDDEN = frozenset(["Unknown", "Data", "Table", "Entity", "Record", "Records", "File", "Test", "Temp", "Misc", "Other", "None", "Null"])


def signature(columns: list[str]) -> str:
    return "|".join(sorted(c.lower() for c in columns))


def default_proposer(df: DataFrame, file_name: str) -> dict:
    """Name from the file's stem, key from the best candidate, fields as they are."""
    key = best_keys(df, 1)[0]
    stem = re.sub(r"\.[a-z]+$", "", file_name.lower())
    return {"entity": "".join(p.capitalize() for p in re.split(r"[^a-z]+", stem) if p), "key": key, "fields": {c.lower(): [c.lower()] for c in df.columns if c.lower() not in entities.AUDIT}}


class Onboarding:
    """New entities from tables that no rule knows, behind guards; known signatures are routed again. With a catalogue
    they are kept there, and registered again by the next process."""

    def __init__(self, proposer=default_proposer, catalog=None):
        self.proposer, self.catalog, self.rows = proposer, catalog, []
        for r in catalog.rows("auto_entities") if catalog else []:
            entities.register(entities.Entity(r["entity"], r["table"], r["key"], json.loads(r["fields_json"])))
            self.rows.append({"entity": r["entity"], "signature": r["signature"], "at": r["at"]})

    def propose(self, df: DataFrame, file_name: str, now: float) -> tuple[entities.Entity | None, str]:
        sign = signature(df.columns)
        if known := next((r for r in self.rows if r["signature"] == sign), None):
            return entities.REGISTRY[known["entity"]], "known signature"
        if len(df.columns) < LEAST_COLUMNS or df.limit(LEAST_ROWS).count() < LEAST_ROWS:
            return None, "too few rows or columns"
        if sum(now - r["at"] < 86_400 for r in self.rows) >= MOST_A_DAY:
            return None, "daily limit"
        plan = self.proposer(df, file_name)
        name, key = plan.get("entity", ""), plan.get("key")
        if not NAME.match(name) or name in FORBIDDEN or name in entities.REGISTRY:
            return None, "name not allowed"
        if key not in df.columns or unique_share(df, key) < KEY_SHARE:
            return None, "no distinct key"
        fields = {f: a for f, a in plan["fields"].items() if f not in entities.AUDIT}
        fields.setdefault(key.lower(), [key.lower()])
        made = entities.Entity(name, f"master_{re.sub('(?<!^)(?=[A-Z])', '_', name).lower()}", key.lower(), fields)
        entities.register(made)
        self.rows.append({"entity": name, "signature": sign, "at": now})
        if self.catalog:
            self.catalog.append("auto_entities", {"entity": name, "table": made.table, "key": made.key, "fields_json": json.dumps(fields), "signature": sign, "at": now})
        return made, "created"
