"""Remediation: one select of typed cleaners, and its change log from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phones, similarity
from ..functions import text as fx

# Fixed values.
NAME_HINTS = [
    ("date", ["date", "time", "_at", "birthday", "dob"]), ("email", ["email", "mail"]), ("phone", ["phone", "mobile", "fax", "tel"]),
    ("name", ["name", "title", "owner", "contact", "person"]), ("status", ["status", "state"]),
]
DATE_LIKE = r"^(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2})"
PHONE_LIKE = r"^(?:\+|00)?[0-9\s\-()]{10,20}$"
NAME_LIKE = "^[a-zA-Z؀-ۿ\\s\\-.]{2,40}$"
SAMPLE, SHARE = 50, 0.7
COUNTRY_COLUMNS = ["country", "country_code", "nation", "ctry"]


def type_shares(df: DataFrame, order: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """column, n, date, email, phone, name: the shares of the first non-null values per column that look like each.

    ``order`` names the row index; without it the frame's own order stands."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != order]
    parts = []
    for c in texts:
        # the first non-null values only: a top-n per column, not a sort of the table
        v = df.filter(F.col(f"`{c}`").isNotNull())
        v = (v.orderBy(order) if order else v).limit(sample).select(F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", "").alias("v"))
        share = lambda test: F.coalesce(F.avg(test.cast("int")), F.lit(0.0))
        digits = F.length(F.regexp_replace("v", "[^0-9]", ""))
        parts.append(v.agg(F.count("*").alias("n"), share(F.col("v").rlike(DATE_LIKE)).alias("date"), share(F.col("v").contains("@") & F.col("v").contains(".")).alias("email"), share(F.col("v").rlike(PHONE_LIKE) & (digits >= 8)).alias("phone"), share(F.col("v").rlike(NAME_LIKE)).alias("name")).select(F.lit(c).alias("column"), "*"))
    out = parts[0] if parts else df.sparkSession.createDataFrame([], "column string, n long, date double, email double, phone double, name double")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect_types(df: DataFrame, order: str | None = None) -> dict[str, str]:
    """Type of each column: by name, else by content, in the order date, email, phone, name, text."""
    shares = {r["column"]: r for r in type_shares(df, order).collect()}
    out = {}
    for f in df.schema.fields:
        low = f.name.lower()
        if f.dataType.simpleString() != "string":
            out[f.name] = "numeric"
        elif hint := next((t for t, words in NAME_HINTS if any(w in low for w in words)), None):
            out[f.name] = hint
        else:
            r = shares.get(f.name)
            out[f.name] = next((t for t in ("date", "email", "phone", "name") if r and r["n"] and r[t] > SHARE), "text")
    return out


def cleaner(kind: str, c: Column, country: Column | None) -> Column:
    c = fx.strip_thousands(c)
    return {"date": fx.clean_date, "email": fx.clean_email, "name": fx.clean_name, "status": fx.clean_status, "text": fx.squeeze}.get(kind, lambda x: x)(c) if kind != "phone" else phones.clean_phone(c, country)


def failed(kind: str, c: Column, country: Column | None) -> Column:
    """Rows whose value no rule could read; they keep it."""
    if kind == "date":
        return c.isNotNull() & fx.parse_date(c).isNull()
    if kind == "email":
        return c.isNotNull() & ~fx.email_ok(c)
    return c.isNotNull() & phones.e164(c, country).isNull() if kind == "phone" else F.lit(False)


def remediate(df: DataFrame, types: dict[str, str] | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned, change log): the log has column, type, changes, failures of every text column."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    types = types or detect_types(df, order)
    named = next((c for c in df.columns if c.lower() in COUNTRY_COLUMNS), None)
    country = F.col(f"`{named}`") if named else None
    new = {c: cleaner(types.get(c, "text"), F.col(f"`{c}`"), country) for c in texts}
    cleaned = df.withColumns(new)
    changed = [F.count_if(~new[c].eqNullSafe(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(texts)]
    failures = [F.count_if(failed(types.get(c, "text"), F.col(f"`{c}`"), country)).alias(f"f{i}") for i, c in enumerate(texts)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types.get(c, "text")).alias("type"), F.col(f"c{i}").alias("changes"), F.col(f"f{i}").alias("failures")) for i, c in enumerate(texts)])
    return cleaned, df.agg(*changed, *failures).select(F.inline(rows))


def similar_values(df: DataFrame, column: str, threshold: float = 75.0) -> DataFrame:
    """(a, b, score) of distinct values a < b that are alike: pairs within a length band only, since the Indel ratio
    can't exceed 200 * shorter / (shorter + longer)."""
    v = df.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct()
    low = threshold / (200.0 - threshold)
    a = v.select(F.col("v").alias("a"), F.explode(F.sequence(F.ceil(F.length("v") * low).cast("int"), F.floor(F.length("v") / low).cast("int"))).alias("n"))
    b = v.select(F.col("v").alias("b"), F.length("v").alias("n"))
    return a.join(b, "n").filter("a < b").select("a", "b", similarity.indel_ratio("a", "b").alias("score")).filter(F.col("score") >= threshold)


def greedy_clusters(values: list[str], pairs: list[tuple[str, str, float]], top: int = 10, exact: float = 100.0) -> dict[str, list[str]]:
    """First-come clusters over scored pairs: a value not yet taken takes its alike ones among its ``top`` best."""
    near: dict[str, list] = {v: [(-exact, i, v)] for i, v in enumerate(values)}
    place = {v: i for i, v in enumerate(values)}
    for a, b, s in pairs:
        near[a].append((-s, place[b], b))
        near[b].append((-s, place[a], a))
    out, taken = {}, set()
    for v in values:
        if v not in taken:
            like = [x for _, _, x in sorted(near[v])[:top] if x != v]
            if like:
                out[v] = like
                taken.update([v, *like])
    return out
