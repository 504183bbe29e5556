"""Quality detection and profiling: tidy frames, a row per column or format."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as fx

# Fixed values.
PHONE_FORMATS = {"uae_local": r"^\+?9715[0-9]{8}$", "uae_landline": r"^\+?9714[0-9]{7}$", "saudi": r"^\+?9665[0-9]{8}$", "gulf_generic": r"^\+?9[0-9]{10,12}$", "international": r"^\+[0-9]{10,15}$"}
DATE_FORMATS = {"yyyy-mm-dd": "^[0-9]{4}-[0-9]{2}-[0-9]{2}", "xx/xx/yyyy": "^[0-9]{2}/[0-9]{2}/[0-9]{4}", "xx-xx-yyyy": "^[0-9]{2}-[0-9]{2}-[0-9]{4}", "yyyy/mm/dd": "^[0-9]{4}/[0-9]{2}/[0-9]{2}"}
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
ARABIC = "[؀-ۿ]"
PLACEHOLDERS = ["sample", "test", "n/a", "null", "none", "tbd", "xxx", "yyy"]
PHONE_LOOK = r"^[+0-9\s\-()]{7,20}$"
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value) with the value as text, a row per cell."""
    columns = columns or df.columns
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n): every later statistic comes from this one shuffle, not from a distinct count per column."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rows, nulls, distinct_values (null is none), unique, constant, longest."""
    v = value_counts(df, columns)
    return v.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        (F.count("*") == 1).alias("constant"),
        ((F.count("*") == F.sum("n")) & (F.sum("n") > 1)).alias("unique"),
        F.max(F.length("value")).cast("long").alias("longest"),
    )


def exact_duplicates(df: DataFrame) -> DataFrame:
    """total_rows, duplicate_rows (all members of groups with more than one): grouped by the real columns, null-safe."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_rows"))


def missing(df: DataFrame) -> DataFrame:
    """column, rows, missing (nulls only; blanks aren't missing) in one aggregate."""
    got = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return got.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)])))


def numeric_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, non_null, numeric: how many values of text columns are plain numbers; mixed if some but not all and more than half."""
    got = df.agg(*[x for i, c in enumerate(columns) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.count(fx.number(F.col(f"`{c}`"))).alias(f"k{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"k{i}").alias("numeric"), ((2 * F.col(f"k{i}") > F.col(f"n{i}")) & (F.col(f"k{i}") < F.col(f"n{i}"))).alias("mixed")) for i, c in enumerate(columns)])
    return got.select(F.inline(rows))


def outliers(df: DataFrame, columns: list[str] | None = None, least: int = 10, width: float = 1.5) -> DataFrame:
    """column, q1, q3, low, high, outliers of numeric columns with at least ``least`` values: two passes."""
    columns = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() in NUMERIC]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    v = df.select(F.inline(cells)).filter("v is not null")
    q = v.groupBy("column").agg(F.count("*").alias("n"), F.expr("percentile(v, array(0.25, 0.75))").alias("q")).filter(F.col("n") >= least)
    fences = q.select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).withColumns({"low": F.col("q1") - width * (F.col("q3") - F.col("q1")), "high": F.col("q3") + width * (F.col("q3") - F.col("q1"))})
    return v.join(F.broadcast(fences), "column").groupBy("column", "q1", "q3", "low", "high").agg(F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("outliers"))  # one row a column


def format_histogram(df: DataFrame, column: str, formats: dict[str, str], clean: str | None = None) -> DataFrame:
    """format, n of the non-null values; the first format that matches counts, else unknown."""
    c = F.regexp_replace(F.col(column).cast("string"), r"^\s+|\s+$", "")
    c = F.regexp_replace(c, clean, "") if clean else c
    which = F.coalesce(*[F.when(c.rlike(p), F.lit(n)) for n, p in formats.items()], F.lit("unknown"))
    return df.filter(F.col(column).isNotNull()).groupBy(which.alias("format")).agg(F.count("*").alias("n"))


def phone_formats(df: DataFrame, column: str) -> DataFrame:
    return format_histogram(df, column, PHONE_FORMATS, r"[\s\-()]")


def date_formats(df: DataFrame, column: str) -> DataFrame:
    return format_histogram(df, column, DATE_FORMATS)


def content_checks(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """column, rows, valid_emails, arabic (counts over all non-null values), placeholder (within the first 20)."""
    parts = []
    for c in columns:
        v = F.col(f"`{c}`").cast("string")
        some = df.filter(v.isNotNull())
        first = (some.orderBy(order) if order else some).limit(20).agg(F.coalesce(F.bool_or(F.lower(v).rlike("|".join(PLACEHOLDERS))), F.lit(False)).alias("placeholder"))
        whole = some.agg(F.count("*").alias("rows"), F.count_if(F.trim(v).rlike(EMAIL)).alias("valid_emails"), F.count_if(v.rlike(ARABIC)).alias("arabic"))
        parts.append(whole.crossJoin(first).select(F.lit(c).alias("column"), "*"))  # one row beside one row
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def looks(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Shares of the first 50 non-null values that look like a phone, e-mail or date, and the type they decide."""
    v = df.filter(F.col(column).isNotNull())
    v = (v.orderBy(order) if order else v).limit(50).select(F.trim(F.col(column).cast("string")).alias("v"))
    share = lambda t: F.avg(t.cast("int"))
    date = "|".join(DATE_FORMATS.values())
    got = v.agg(share(F.col("v").rlike(PHONE_LOOK)).alias("phone"), share(F.col("v").contains("@") & F.col("v").contains(".")).alias("email"), share(F.col("v").rlike(date)).alias("date"))
    return got.withColumn("type", F.when(F.col("date") > 0.7, "date").when(F.col("email") > 0.7, "email").when(F.col("phone") > 0.7, "phone"))


def intents(df: DataFrame, order: str | None = None) -> dict[str, str | None]:
    """Type by name (a date name also needs date content), else by content."""
    out = {}
    for c in df.columns:
        low = c.lower()
        if any(w in low for w in ("date", "time", "_at", "birthday", "dob")):
            found = looks(df, c, order).first()
            out[c] = "date" if (found["date"] or 0) > 0.7 else None
        elif any(w in low for w in ("email", "mail")):
            out[c] = "email"
        elif any(w in low for w in ("phone", "mobile", "fax", "tel")):
            out[c] = "phone"
        else:
            out[c] = looks(df, c, order).first()["type"]
    return out


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """The column of a candidate's name, without regard to case; else the first whose name holds a candidate."""
    low = {c.lower(): c for c in columns}
    whole = next((low[x] for x in candidates if x in low), None)
    return whole or next((c for x in candidates for n, c in low.items() if x in n), None)


def quality(df: DataFrame, order: str) -> dict:
    """All quality checks of a table: exact and alike rows, missing cells, mixed types, outliers, constant and unique
    columns, formats by the columns' types, and names that don't fit their addresses."""
    data = df.drop(order)
    texts = [c for c, t in data.dtypes if t == "string" and not c.startswith("_")]
    rows = lambda d: [r.asDict() for r in d.collect()]  # noqa: E731  a row a column
    stats = rows(column_stats(data))
    out = {
        "exact_duplicates": exact_duplicates(data).first().asDict(), "missing": rows(missing(data)), "mixed_types": [r for r in rows(numeric_shares(data, texts)) if r["mixed"]] if texts else [],
        "outliers": rows(outliers(data)) if any(t in NUMERIC for _, t in data.dtypes) else [], "constant": [r["column"] for r in stats if r["constant"]], "unique": [r["column"] for r in stats if r["unique"]],
    }
    out["fuzzy_duplicates"] = fuzzy_rows(df, order, texts).count() if texts else 0
    kinds = intents(data)
    out["formats"] = {c: rows(phone_formats(data, c) if k == "phone" else date_formats(data, c) if k == "date" else content_checks(data, [c])) for c, k in kinds.items() if k}
    name, email = find_column(texts, ["full_name", "name", "customer_name"]), find_column(texts, ["email", "mail"])
    out["consistency"] = name_email_issues(df, order, name, email).groupBy("severity").count().collect() if name and email and name != email else []
    out["consistency"] = {r["severity"]: r["count"] for r in out["consistency"]}
    return out


def html_report(title: str, tables: dict[str, list[dict]]) -> str:
    """A page with a table of rows for each heading."""

    def one(heading: str, rows: list[dict]) -> str:
        names = list(dict.fromkeys(k for r in rows for k in r))
        row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{escape(str(c))}</{tag}>" for c in cells) + "</tr>"
        return f"<h2>{escape(heading)}</h2><table>{row('th', names)}{''.join(row('td', [r.get(n, '') for n in names]) for r in rows)}</table>"

    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1>{"".join(one(h, r) for h, r in tables.items())}'


def enhancements(df: DataFrame, table: str, order: str) -> dict:
    """All that a table's contents suggest: refined types, constraints, and columns worth clustering by (Spark has no
    indexes)."""
    rows = lambda d: [r.asDict() for r in d.collect()]
    return {"types": rows(refined_types(df, order)), "constraints": rows(constraints(df.drop(order))), "layout": rows(layout_hints(df.drop(order), table))}


def dataset_summary(df: DataFrame) -> DataFrame:
    """n, n_var, missing_cells, duplicate_rows, and alerts for constant, unique and mostly missing columns."""
    m, s = missing(df), column_stats(df)
    cells = m.agg(F.max("rows").alias("n"), F.count("*").alias("n_var"), F.sum("missing").alias("missing_cells"))
    alerts = s.agg(F.count_if("constant").alias("constant_columns"), F.count_if("unique").alias("unique_columns"), F.count_if(F.col("nulls") * 2 > F.col("rows")).alias("mostly_missing"))
    return cells.crossJoin(alerts).crossJoin(exact_duplicates(df).select("duplicate_rows"))  # one row each


def name_email_issues(df: DataFrame, key: str, name: str, email: str, cutoff: float = 60, high: float = 30) -> DataFrame:
    """key, name, email, score, severity where no word of the name is like a part of the address's local part."""
    local = F.filter(F.split(F.lower(F.element_at(F.split(F.col(email), "@"), 1)), r"[._\-+0-9]+"), lambda t: t != "")
    words = F.filter(F.split(fx.squeeze(F.lower(F.col(name))), " "), lambda t: F.length(t) >= 2)
    rows = df.filter(F.col(email).contains("@") & F.col(name).isNotNull()).select(key, name, email, local.alias("_l"), words.alias("_w"))
    scored = rows.filter("size(_l) > 0 and size(_w) > 0").withColumn("score", similarity.best_token_ratio("_l", "_w")).filter(F.col("score") < cutoff)
    return scored.withColumn("severity", F.when(F.col("score") < high, "high").otherwise("medium")).drop("_l", "_w")


def fuzzy_rows(df: DataFrame, key: str, columns: list[str], threshold: float = 85) -> DataFrame:
    """Pairs of rows (a < b by key) whose joined lower-case texts are alike: distinct texts are scored once, in
    lists of the lengths that can reach the threshold, where their common characters can too. All rows take part."""
    text = F.lower(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    rows = df.select(F.col(key).alias("k"), text.alias("t"))
    texts = rows.select("t").distinct()
    low = threshold / (200.0 - threshold)
    lists = similarity.lists(texts, "t")
    a = lists.select(F.col("texts").alias("_xs"), F.col("n").alias("_n"), F.col("part").alias("_p"), F.explode(F.sequence(F.ceil(F.col("n") * low).cast("int"), F.floor(F.col("n") / low).cast("int"))).alias("n"))
    met = a.join(lists, "n").filter("_n < n or _n = n and _p <= part").select("_xs", "texts", F.expr("_n = n and _p = part").alias("_own"))
    met = met.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    alike = met.select("_own", F.inline(similarity.alike_in_lists("_xs", "texts", F.lit(float(threshold))))).filter("x < y or not _own and x > y")
    turned = F.inline(F.array(F.struct("x", "y", "score"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "score")))
    both = alike.select(turned).unionByName(texts.select(F.col("t").alias("x"), F.col("t").alias("y"), F.lit(100.0).alias("score")))
    left, right = rows.select(F.col("k").alias("a"), F.col("t").alias("x")), rows.select(F.col("k").alias("b"), F.col("t").alias("y"))
    return both.join(left, "x").join(right, "y").filter("a < b").select("a", "b", "score")


def greedy_groups(keys: list, pairs: list[tuple], most: int = 20) -> list[list]:
    """Anchors in order, each absorbing the later rows alike that are still free."""
    near: dict = {}
    for a, b, *_ in pairs:
        near.setdefault(a, []).append(b)
    out, seen = [], set()
    for k in keys:
        if k not in seen:
            group = [k, *[x for x in sorted(near.get(k, [])) if x not in seen]]
            if len(group) > 1:
                seen.update(group)
                out.append(group)
    return out[:most]


def sql_type(df: DataFrame, stats: dict, name: str, text_names=()) -> str:
    kind = dict(df.dtypes)[name]
    if any(w in name.lower() for w in text_names):
        return "TEXT"
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "INTEGER"
    if kind in ("float", "double"):
        return "REAL"
    if kind in ("boolean", "timestamp", "timestamp_ntz"):
        return "BOOLEAN" if kind == "boolean" else "TIMESTAMP"
    if stats["filled"] and stats["numeric"] > 0.95 * stats["filled"]:
        return "INTEGER" if stats["whole"] == stats["numeric"] else "REAL"
    return "TEXT"


def ddl_stats(df: DataFrame) -> DataFrame:
    """column, rows, filled, distinct_values, numeric, whole, smallest, largest, longest: what DDL needs, from one shuffle."""
    n = fx.number(F.col("value"))
    return value_counts(df).groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"), F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(n.isNotNull(), F.col("n"))), F.lit(0)).alias("numeric"), F.coalesce(F.sum(F.when(n % 1 == 0, F.col("n"))), F.lit(0)).alias("whole"),
        F.min("value").alias("smallest"), F.max("value").alias("largest"), F.max(F.length("value")).cast("long").alias("longest"),
    )


def create_table(df: DataFrame, table: str) -> str:
    """CREATE TABLE by content: the first unique and complete column is the key."""
    stats, key, lines = {r["column"]: r for r in ddl_stats(df).collect()}, None, []
    for c in df.columns:
        s = stats.get(c)
        full = bool(s) and s["filled"] == s["rows"]
        unique = bool(s) and s["filled"] > 0 and s["distinct_values"] == s["filled"]
        words = [f'"{c}"', sql_type(df, s or {"filled": 0}, c)]
        if full and unique and key is None:
            key = c
            words.append("PRIMARY KEY")
        elif full:
            words += ["NOT NULL"]
        elif unique:
            words += ["UNIQUE"]
        lines.append("  " + " ".join(words))
    return f'CREATE TABLE "{table}" (\n' + ",\n".join(lines) + "\n);"


# Fixed values.
INDEX_WORDS = ["id", "no", "key", "code", "email", "phone", "country", "city", "status", "category", "type", "date", "_at", "_dt", "ref"]
REFINED = [("NUMERIC", r"^-?[0-9]+\.?[0-9]*$"), ("DATE", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{2}-[A-Za-z0-9_]{3}-[0-9]{4}|^[0-9]{2}/[0-9]{2}/[0-9]{4}"), ("PHONE_E164", r"^\+[0-9]{7,15}$"), ("EMAIL", r"@.+\.[a-z]{2,}")]


def layout_hints(df: DataFrame, table: str, least: int = 100) -> DataFrame:
    """table, column worth clustering or bucketing by (Spark has no indexes): by name, on tables with enough rows."""
    rows = df.count()
    return df.sparkSession.createDataFrame([(table, c, rows) for c in df.columns if rows >= least and any(w in c.lower() for w in INDEX_WORDS)], "table string, column string, rows long")


def refined_types(df: DataFrame, order: str, sample: int = 1_000, most: int = 200, least: int = 10) -> DataFrame:
    """column, values, actual_type of text columns whose first values nearly all have one shape."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and not f.name.startswith("_") and f.name != order]
    head = df.orderBy(order).limit(sample)
    cells = head.select(order, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in texts]))).filter("v is not null")
    ranked = cells.groupBy("column").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct(order, "v"))), lambda x: x["v"]), 1, most).alias("vs"))
    share = lambda p: F.size(F.filter("vs", lambda v: v.rlike(p))) / F.size("vs")  # noqa: E731  at most 200 of a bounded sample
    kind = F.coalesce(*[F.when(share(p) > 0.9, F.lit(n)) for n, p in REFINED])
    return ranked.filter(F.size("vs") >= least).select("column", F.size("vs").alias("n_values"), kind.alias("actual_type")).filter("actual_type is not null")


def constraints(df: DataFrame, least: int = 50) -> DataFrame:
    """column, constraint: NOT NULL from 99 % filled on, UNIQUE from 99 % distinct of more than 100 on; blanks count as empty."""
    v = value_counts(df).withColumn("value", F.when(F.trim("value") != "", F.col("value")))
    s = v.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"), F.countDistinct("value").alias("distinct_values")).filter(F.col("rows") >= least)
    found = F.filter(F.array(F.when(F.col("filled") * 100 >= F.col("rows") * 99, "NOT NULL"), F.when((F.col("filled") > 100) & (F.col("distinct_values") * 100 >= F.col("filled") * 99), "UNIQUE")), lambda x: x.isNotNull())
    return s.select("column", F.explode(found).alias("constraint"))
