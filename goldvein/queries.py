"""The registered queries over the engine's own operators, and DuckDB SQL with the same results.

Inputs are derived from the given tables by SQL that both engines read (``INPUTS``), so both see the same dirt."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import phones
from .functions import text as fx
from .operators import classify, cleanse, crossfile, governance, graph, hashing, link, master, normalize, profile, staging, validate
from .plans import entities
from .sources import documents, files, naming

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

INPUTS = {
    "dirty": """select c_custkey as row_idx, 'C-' || lpad(cast(c_custkey % 1000 as string), 6, '0') as cust_id,
        case c_custkey % 6 when 0 then upper(c_name) when 1 then lower(c_name) when 2 then '  ' || c_name || ' ' when 3 then '' when 4 then 'SARA  KHAN CEO' else c_name end as customer_name,
        case c_custkey % 7 when 0 then '' when 1 then 'not-an-email' when 2 then null else ' User' || cast(c_custkey as string) || '@Example.com' end as email_addr,
        case c_custkey % 6 when 0 then null when 1 then '123' when 2 then '050-' || lpad(cast(c_custkey as string), 7, '0') else '+97150' || lpad(cast(c_custkey as string), 7, '0') end as phone_nr,
        case c_custkey % 3 when 0 then 'UAE' when 1 then 'Germany' else 'France' end as ctry,
        case c_custkey % 5 when 0 then 'ACT' when 1 then 'inactive' when 2 then ' on  leave ' when 3 then '' else null end as stat,
        case c_custkey % 4 when 0 then '1,234.50' when 1 then '12,34' when 2 then cast(c_custkey as string) else null end as amt
        from customer""",
    "dated": """select o_orderkey as id, case o_orderkey % 6 when 0 then '2024-03-05' when 1 then '03/14/2024' when 2 then '25/12/2023' when 3 then '20240229' when 4 then 'soon' else '5-Jan-2024' end as d from orders""",
    "sources_named": """select o_orderkey as id, case o_orderkey % 7 when 0 then 'Orders ' || cast(o_orderkey as string) || '.CSV' when 1 then 'api_sales--x' when 2 then 'db_Legacy_customers' when 3 then 'data.parquet'
        when 4 then ' scan__' || cast(o_orderkey % 10 as string) || '.pdf' when 5 then 'api_emp.csv' else '' end as source from orders""",
    "products": """select p_partkey as row_idx, case when p_partkey % 9 = 0 then '' else 'P-' || cast(p_partkey as string) end as prod_code, p_name as product_nm, p_type as cat, cast(p_size as string) as unit_price, 'x' as other from part""",
    "flat": """select c_custkey as row_idx, c_mktsegment, n_name, r_name, n_regionkey, case when c_custkey % 11 = 0 then null else c_nationkey end as c_nationkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "mixed": """select o_orderkey as row_idx, case when o_orderkey % 5 = 0 then 'n/a' when o_orderkey % 7 = 0 then null else cast(o_custkey as string) end as m, o_orderstatus as s, case when o_orderkey % 3 = 0 then null else o_orderpriority end as p, 'one' as k, cast(o_orderkey as string) as u from orders""",
    "contacts": """select row_idx as row, case when row_idx % 4 = 0 then '' else 'Name ' || cast(row_idx % 201 as string) end as name, case when row_idx % 5 = 0 then '' else 'p' || cast(row_idx % 201 as string) || '@x.com' end as email,
        case when row_idx % 3 = 0 then '' else '+9715' || lpad(cast(row_idx % 201 as string), 8, '0') end as phone from (select c_custkey as row_idx from customer)""",
    "batch_a": """select c_custkey as row_idx, 'C-' || lpad(cast(c_custkey as string), 6, '0') as customer_id, c_name as full_name, case when c_custkey % 2 = 0 then '' else 'u' || cast(c_custkey as string) || '@x.com' end as email,
        case when c_custkey % 3 = 0 then '+97150' || lpad(cast(c_custkey as string), 7, '0') else null end as phone, cast(null as string) as city, 'AE' as country, 'Active' as status from customer where c_custkey % 10 < 7""",
    "batch_b": """select c_custkey as row_idx, case when c_custkey % 4 = 0 then 'c ' || lpad(cast(c_custkey as string), 6, '0') when c_custkey % 13 = 0 then '' else 'C-' || lpad(cast(c_custkey % 1200 as string), 6, '0') end as cust_no, 'Other ' || c_name as name,
        'b' || cast(c_custkey as string) || '@y.com' as mail, case when c_custkey % 5 = 0 then '+4930' || lpad(cast(c_custkey as string), 7, '0') end as mobile, case when c_custkey % 2 = 0 then 'Town' else '' end as town, 'DE' as nation,
        case when c_custkey % 50 = 7 then 'Bogus' else 'Pending' end as state from customer where c_custkey % 10 >= 4""",
    "invoices": """select o_orderkey as doc, 'INVOICE No: INV-' || lpad(cast(o_orderkey % 100000 as string), 6, '0') || chr(10) || 'Invoice date: ' || substr(cast(o_orderdate as string), 1, 10) || chr(10) || 'Customer ID: C-' || cast(o_custkey as string) || chr(10)
        || case when o_orderkey % 3 = 0 then '' else 'Total: $' || cast(o_custkey as string) || ',500.25,' end as text from orders""",
    "ocr": """select o_orderkey as doc, 'Item  Qty  Price' || chr(10) || 'Widget ' || cast(o_custkey as string) || '  2   9.50' || chr(10) || 'one two' || chr(10) || 'Gadget  1  3.00  extra' || chr(10) || case when o_orderkey % 2 = 0 then '' else '  7  8  9  ' end as text from orders""",
    "files": """select 'f' || cast(o_orderkey as string) || '.csv' as file_path, case when o_orderkey % 9 = 0 then 'api_' else 'f' end || cast(o_orderkey as string) as file_name, cast(o_custkey as string) as content_hash, cast(o_orderdate as string) as first_seen_at, o_orderkey % 11 = 0 as soft_deleted from orders""",
    "edges": """select c_custkey as a, c_custkey + 1 as b from customer where c_custkey % 7 <> 0""",
    "outcomes": """select o_orderkey as id, case when o_orderkey % 11 = 0 then 'bad header' end as parse_error, case when o_orderkey % 7 = 0 then null else 'Customers' end as target_entity, case when o_orderkey % 2 = 0 then o_custkey end as rows_inserted,
        case when o_orderkey % 5 = 0 then o_custkey else 0 end as rows_merged, cast(0 as bigint) as fields_enriched, case when o_orderkey % 3 = 0 then o_custkey else 0 end as rows_rejected from orders""",
    "runs": """select 'r' || cast(o_orderkey as string) as run_id, 'd' || cast(o_custkey as string) as dataset_id, 'master_customers' as target_table, 'file_x' as source_system, o_orderkey as rows_inserted, o_custkey as rows_merged, o_orderkey % 3 as rows_rejected,
        substr(cast(o_orderdate as string), 1, 10) as started_at, '2030-01-01' as ended_at from orders""",
    "tables_raw": """select o_orderkey as doc, o_orderstatus as h1, case when o_orderkey % 2 = 0 then '' end as h2, cast(o_custkey as string) as a, case when o_orderkey % 3 = 0 then null else ' ' end as b from orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", INPUTS[name]):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(INPUTS[name])


QUERIES, SQL = {}, {}


def query(sql: str | None = None, uses: str = ""):
    """Register a query; its SQL may use the derived inputs that ``uses`` names as tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(f"{n} as ({INPUTS[n]})" for n in uses.split())
            body = sql.strip()
            SQL[f.__name__] = (f"with recursive {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}") if head else body
        return f

    return add


TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.format(x)


def squeeze(x: str) -> str:
    return rf"regexp_replace({trim(x)}, '\s+', ' ', 'g')"


def caps(x: str, special: str = "") -> str:
    word = "upper(w[1]) || lower(w[2:])"
    return f"array_to_string([{f'case when {special} then upper(w) else {word} end' if special else word} for w in string_split({squeeze(x)}, ' ')], ' ')"


quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
case_of = lambda key, pairs, other: "case " + key + " " + " ".join(f"when {quoted([a])} then {quoted([b])}" for a, b in pairs.items()) + f" else {other} end"


def name_sql(x: str) -> str:
    t = trim(x)
    return f"case when {t} = '' then {x} when upper({t}) <> lower({t}) and ({t} = upper({t}) or {t} = lower({t})) then {caps(x, f'upper(w) in ({quoted(fx.ACRONYMS)})')} else {t} end"


def status_sql(x: str) -> str:
    t = trim(x)
    return f"case when {t} = '' then 'Unknown' when {x} is not null then {caps(case_of(f'upper({t})', fx.STATUS_CODES, t))} end"


def email_sql(x: str) -> str:
    t = f"lower({trim(x)})"
    return f"regexp_matches({t}, {quoted([fx.EMAIL_SYNTAX])}) and not contains({t}, '..')"


def thousands_sql(x: str) -> str:
    return f"case when regexp_matches({x}, {quoted([fx.THOUSANDS])}) then replace({x}, ',', '') else {x} end"


def date_sql(x: str) -> str:
    t, formats = trim(x), {"yyyy-M-d": "%Y-%m-%d", "yyyy/M/d": "%Y/%m/%d", "M/d/yyyy": "%m/%d/%Y", "d/M/yyyy": "%d/%m/%Y", "M-d-yyyy": "%m-%d-%Y", "d-M-yyyy": "%d-%m-%Y", "d-MMM-yyyy": "%d-%b-%Y", "yyyyMMdd": "%Y%m%d"}
    tries = [f"case when regexp_matches({t}, {quoted([p])}) then try_strptime({t if f != 'yyyy-M-d' else f'{t}[:10]'}, '{formats[f]}') end" for p, f in fx.DATE_FORMATS]
    return f"coalesce({', '.join(tries)})"


def phone_sql(x: str, country: str) -> str:
    t, d = trim(x), f"regexp_replace({x}, '[^0-9]', '', 'g')"

    def plan(r):
        code, trunk, low, high = phones.PLANS[r]
        own = f"case when starts_with({d}, '{trunk}') then {d}[2:] else {d} end" if trunk else d
        return f"case when length({own}) between {low} and {high} then '+{code}' || {own} end"

    region = case_of(f"lower(trim({country}))", phones.REGION_NAMES, "null")
    tries = [f"case when ({region}) = '{r}' then {plan(r)} end" for r in phones.PLANS] + [plan(r) for r in phones.PLANS]
    full = f"case when starts_with({t}, '+') then {d} else {d}[3:] end"
    return f"case when starts_with({t}, '+') or starts_with({t}, '00') then case when length({full}) between 8 and 15 then '+' || {full} end else coalesce({', '.join(tries)}) end"


def number_sql(x: str) -> str:
    return f"case when regexp_matches({trim(x)}, {quoted([fx.NUMBER])}) then try_cast({trim(x)} as double) end"


def key_sql(x: str) -> str:
    return rf"coalesce(regexp_replace(regexp_replace(upper({trim(x)}), '[\s\-_/.]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"


def cells_sql(source: str, columns: list[str], extra: str = "") -> str:
    return " union all ".join(f"select {extra}'{c}' as \"column\", cast({c} as varchar) as value from {source}" for c in columns)


# sources and layers ---------------------------------------------------------------------------------------------------


@query(r"""select id, 'landing_' || kind || regexp_replace(regexp_replace(regexp_replace(regexp_replace(low, '^(api_|db_)', ''), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as landing_table,
    case when starts_with(raw, 'api_') then 'rest_api_' || regexp_replace(raw[5:], '\.csv$', '') when starts_with(raw, 'db_') then 'sqlite_' || regexp_replace(raw[4:], '\.csv$', '') when raw like '%.pdf' then 'pdf_' || regexp_replace(raw, '\.pdf$', '')
    else 'file_' || regexp_replace(raw, '\.(csv|xlsx|xls|json|tsv)$', '') end as source_system
    from (select *, case when starts_with(low, 'api_') then 'api_' when starts_with(low, 'db_') then 'sqlite_' else 'file_' end as kind from
    (select id, lower(trim(source)) as raw, regexp_replace(lower(trim(case when source = '' then 'unknown' else source end)), '\.(csv|xlsx?|json|tsv|pdf)$', '') as low from sources_named))""", "sources_named")
def landing_names(spark, sf_dir):
    d = given(spark, sf_dir, "sources_named")
    return d.select("id", naming.landing_table_column(F.col("source")).alias("landing_table"), naming.source_system_column(F.col("source")).alias("source_system"))


@query("""select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus, o_orderpriority, 'file_orders' as _landing_source_system, '2024-01-01T00:00:00Z' as _landing_ingested_at from orders""")
def landing_persist(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return files.to_landing(d, "landing_file_orders", "file_orders", at=F.lit("2024-01-01T00:00:00Z"))


STAGED = "2024-01-01T00:00:00Z"


@query(f"""select cust_id as customer_id, customer_name as full_name, email_addr as email, phone_nr as phone, ctry as country, stat as status, 'landing_file_customers' as _source_system, '{STAGED}' as _staged_at, 'ok' as _validation from dirty""", "dirty")
def staging_customers(spark, sf_dir):
    return staging.build(given(spark, sf_dir, "dirty"), "landing_file_customers", F.lit(STAGED))[0]


@query(f"""select prod_code as sku, product_nm as product_name, cat as category, unit_price as price, 'landing_file_products' as _source_system, '{STAGED}' as _staged_at, case when trim(prod_code) = '' then 'rejected_null_pk' else 'ok' end as _validation from products""", "products")
def staging_products(spark, sf_dir):
    return staging.build(given(spark, sf_dir, "products"), "landing_file_products", F.lit(STAGED))[0]


@query("""select 'stg_products' as "table", count(*) as rows, count(*) filter (where trim(prod_code) <> '') as ok_rows from products union all select 'stg_customers', count(*), count(*) from dirty""", "products dirty")
def staging_summary(spark, sf_dir):
    return staging.summary({"stg_products": staging_products(spark, sf_dir), "stg_customers": staging_customers(spark, sf_dir)})


@query("""select event_id, user_id, cast(json_extract(props, '$.k') as bigint) as "p.k" from events""")
def json_flatten(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "k long").alias("p"))
    return files.flattened(e)


# cleansing ------------------------------------------------------------------------------------------------------------


@query(f"select row_idx, {name_sql('customer_name')} as v from dirty", "dirty")
def std_names(spark, sf_dir):
    return given(spark, sf_dir, "dirty").select("row_idx", fx.clean_name(F.col("customer_name")).alias("v"))


@query(f"select row_idx, {status_sql('stat')} as v from dirty", "dirty")
def std_status(spark, sf_dir):
    return given(spark, sf_dir, "dirty").select("row_idx", fx.clean_status(F.col("stat")).alias("v"))


@query(f"select doc_id, {squeeze('text')} as v from documents")
def std_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.squeeze(F.col("text")).alias("v"))


@query(f"select row_idx, {thousands_sql('amt')} as v, case when regexp_replace(amt, '[^0-9.\\-]', '', 'g') <> '' then regexp_replace(amt, '[^0-9.\\-]', '', 'g') end as currency from dirty", "dirty")
def std_thousands(spark, sf_dir):
    return given(spark, sf_dir, "dirty").select("row_idx", fx.strip_thousands(F.col("amt")).alias("v"), fx.clean_currency(F.col("amt")).alias("currency"))


@query(f"select row_idx, case when {email_sql('email_addr')} then lower({trim('email_addr')}) else email_addr end as v from dirty", "dirty")
def std_email(spark, sf_dir):
    return given(spark, sf_dir, "dirty").select("row_idx", fx.clean_email(F.col("email_addr")).alias("v"))


@query(f"select id, coalesce(strftime({date_sql('d')}, '%Y-%m-%d'), d) as v from dated", "dated")
def std_date(spark, sf_dir):
    return given(spark, sf_dir, "dated").select("id", fx.clean_date(F.col("d")).alias("v"))


@query(f"select row_idx, coalesce({phone_sql('phone_nr', 'ctry')}, phone_nr) as v from dirty", "dirty")
def std_phone(spark, sf_dir):
    return given(spark, sf_dir, "dirty").select("row_idx", phones.clean_phone(F.col("phone_nr"), F.col("ctry")).alias("v"))


@query(f"select row_idx, {case_of('upper(trim(ctry))', fx.COUNTRY_TO_ISO, 'ctry')} as v from dirty", "dirty")
def std_country(spark, sf_dir):
    return given(spark, sf_dir, "dirty").select("row_idx", fx.iso_country(F.col("ctry")).alias("v"))


@query(f"""select 'customer_name' as "column", 'name' as type, count(*) filter (where {name_sql(thousands_sql('customer_name'))} is distinct from customer_name) as changes, cast(0 as bigint) as failures from dirty
    union all select 'email_addr', 'email', count(*) filter (where case when {email_sql('email_addr')} then lower({trim('email_addr')}) else email_addr end is distinct from email_addr), count(*) filter (where email_addr is not null and not ({email_sql('email_addr')})) from dirty
    union all select 'stat', 'status', count(*) filter (where {status_sql('stat')} is distinct from stat), 0 from dirty
    union all select 'amt', 'text', count(*) filter (where {squeeze(thousands_sql('amt'))} is distinct from amt), 0 from dirty
    union all select 'phone_nr', 'phone', count(*) filter (where coalesce({phone_sql('phone_nr', 'ctry')}, phone_nr) is distinct from phone_nr), count(*) filter (where phone_nr is not null and ({phone_sql('phone_nr', 'ctry')}) is null) from dirty""", "dirty")
def remediation_log(spark, sf_dir):
    d = given(spark, sf_dir, "dirty")
    types = {"customer_name": "name", "email_addr": "email", "stat": "status", "amt": "text", "phone_nr": "phone"}
    return cleanse.remediate(d.select("row_idx", *types, "ctry"), types | {"ctry": "text"})[1].filter("column <> 'ctry'")


def shares_sql(c: str) -> str:
    v = f"(select {trim(c)} as v from dirty where {c} is not null order by row_idx limit 50)"
    avg = lambda cond: f"coalesce(avg(cast({cond} as int)), 0.0)"
    like = lambda p: f"regexp_matches(v, {quoted([p])})"
    phone = f"{like(cleanse.PHONE_LIKE)} and length(regexp_replace(v, '[^0-9]', '', 'g')) >= 8"
    mail = "contains(v, '@') and contains(v, '.')"
    return f"""select '{c}' as "column", count(*) as n, {avg(like(cleanse.DATE_LIKE))} as date, {avg(f'({mail})')} as email, {avg(f'({phone})')} as phone, {avg(like(cleanse.NAME_LIKE))} as name from {v}"""


@query(" union all ".join(map(shares_sql, ["cust_id", "customer_name", "email_addr", "phone_nr", "ctry", "stat", "amt"])), "dirty")
def type_autodetect(spark, sf_dir):
    return cleanse.type_shares(given(spark, sf_dir, "dirty"), "row_idx")


# profiling ------------------------------------------------------------------------------------------------------------


@query("select cast(sum(n) as bigint) as total_rows, cast(coalesce(sum(n) filter (where n > 1), 0) as bigint) as duplicate_rows from (select count(*) as n from documents group by text, lang)")
def dup_exact(spark, sf_dir):
    return profile.exact_duplicates(table(spark, sf_dir, "documents").select("text", "lang"))


@query(" union all ".join(f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as missing from mixed" for c in ["row_idx", "m", "s", "p", "k", "u"]), "mixed")
def missing_cells(spark, sf_dir):
    return profile.missing(given(spark, sf_dir, "mixed"))


@query(" union all ".join(f"select '{c}' as \"column\", count({c}) as non_null, count({number_sql(c)}) as numeric, 2 * count({number_sql(c)}) > count({c}) and count({number_sql(c)}) < count({c}) as mixed from mixed" for c in ["m", "s", "u"]), "mixed")
def mixed_types(spark, sf_dir):
    return profile.numeric_shares(given(spark, sf_dir, "mixed"), ["m", "s", "u"])


@query(f"""with v as (select "column", value, count(*) as n from ({cells_sql('mixed', ['row_idx', 'm', 's', 'p', 'k', 'u'])}) group by 1, 2)
    select "column", cast(sum(n) as bigint) as rows, cast(coalesce(sum(n) filter (where value is null), 0) as bigint) as nulls, count(value) as distinct_values, count(*) = 1 as constant, count(*) = sum(n) and sum(n) > 1 as "unique", max(length(value)) as longest from v group by 1""", "mixed")
def const_unique(spark, sf_dir):
    return profile.column_stats(given(spark, sf_dir, "mixed"))


@query("""with v as (select 'l_quantity' as "column", l_quantity as v from lineitem union all select 'l_extendedprice', l_extendedprice from lineitem union all select 'l_discount', l_discount from lineitem),
    q as (select "column", quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from v group by 1)
    select "column", q1, q3, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high, count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as outliers from v join q using ("column") group by 1, 2, 3, 4, 5""")
def outliers_iqr(spark, sf_dir):
    return profile.outliers(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(f"""with v as (select "column", value, {number_sql('value')} as x, count(*) as n from ({cells_sql('mixed', ['row_idx', 'm', 's', 'p', 'k', 'u'])}) group by 1, 2)
    select "column", cast(sum(n) as bigint) as rows, cast(coalesce(sum(n) filter (where value is not null), 0) as bigint) as filled, count(value) as distinct_values, cast(coalesce(sum(n) filter (where x is not null), 0) as bigint) as numeric,
    cast(coalesce(sum(n) filter (where x % 1 = 0), 0) as bigint) as whole, min(value) as smallest, max(value) as largest, max(length(value)) as longest from v group by 1""", "mixed")
def column_profile(spark, sf_dir):
    return profile.ddl_stats(given(spark, sf_dir, "mixed"))


def histogram_sql(source: str, c: str, formats: dict, clean: str = "") -> str:
    v = trim(c) if not clean else f"regexp_replace({trim(c)}, '{clean}', '', 'g')"
    return f"select case {' '.join(f'when regexp_matches({v}, {quoted([p])}) then {quoted([n])}' for n, p in formats.items())} else 'unknown' end as format, count(*) as n from {source} where {c} is not null group by 1"


@query(histogram_sql("dirty", "phone_nr", profile.PHONE_FORMATS, r"[\s\-()]"), "dirty")
def phone_formats(spark, sf_dir):
    return profile.phone_formats(given(spark, sf_dir, "dirty"), "phone_nr")


@query(histogram_sql("dated", "d", profile.DATE_FORMATS), "dated")
def date_formats(spark, sf_dir):
    return profile.date_formats(given(spark, sf_dir, "dated"), "d")


@query(" union all ".join(f"""select '{c}' as "column", count(*) as rows, count(*) filter (where regexp_matches(trim({c}), {quoted([profile.EMAIL])})) as valid_emails, count(*) filter (where regexp_matches({c}, '{profile.ARABIC}')) as arabic,
    (select coalesce(bool_or(regexp_matches(lower(x), '{"|".join(profile.PLACEHOLDERS)}')), false) from (select {c} as x from dirty where {c} is not null order by row_idx limit 20)) as placeholder from dirty where {c} is not null""" for c in ["email_addr", "customer_name"]), "dirty")
def placeholder_arabic(spark, sf_dir):
    return profile.content_checks(given(spark, sf_dir, "dirty"), ["email_addr", "customer_name"], "row_idx")


@query("""with m as (select count(*) as n, 6 as n_var, cast(sum(cast(m is null as int) + cast(p is null as int)) as bigint) as missing_cells from mixed)
    select n, cast(n_var as bigint) as n_var, missing_cells, cast(1 as bigint) as constant_columns, cast(2 as bigint) as unique_columns, cast(0 as bigint) as mostly_missing, cast(0 as bigint) as duplicate_rows from m""", "mixed")
def dataset_summary(spark, sf_dir):
    return profile.dataset_summary(given(spark, sf_dir, "mixed"))


@query()
def name_email_consistency(spark, sf_dir):
    d = given(spark, sf_dir, "dirty").withColumn("e", F.when(F.col("row_idx") % 2 == 0, F.concat(F.lit("customer."), "row_idx", F.lit("@x.com"))).otherwise("zq.wv@x.com"))
    return profile.name_email_issues(d, "row_idx", "customer_name", "e")


@query(f"""with c as (select "column", value, count(*) as n from (select "column", case when trim(value) <> '' then value end as value from ({cells_sql('dirty', ['row_idx', 'cust_id', 'customer_name', 'email_addr', 'phone_nr', 'ctry', 'stat', 'amt'])})) group by 1, 2),
    s as (select "column", sum(n) as rows, coalesce(sum(n) filter (where value is not null), 0) as filled, count(value) as d from c group by 1 having sum(n) >= 50)
    select "column", 'NOT NULL' as "constraint" from s where filled * 100 >= rows * 99 union all select "column", 'UNIQUE' from s where filled > 100 and d * 100 >= filled * 99""", "dirty")
def constraint_infer(spark, sf_dir):
    return profile.constraints(given(spark, sf_dir, "dirty"))


def refined_sql(columns: list[str]) -> str:
    one = lambda c: f"""select '{c}' as "column", count(*) as n, {', '.join(f'avg(cast(regexp_matches(v, {quoted([p])}) as int)) as s{i}' for i, (_, p) in enumerate(profile.REFINED))} from (select {c} as v from (select * from dirty order by row_idx limit 1000) where {c} is not null order by row_idx limit 200)"""
    kind = "case " + " ".join(f"when s{i} > 0.9 then '{n}'" for i, (n, _) in enumerate(profile.REFINED)) + " end"
    return f"""select "column", cast(n as int) as n_values, {kind} as actual_type from ({' union all '.join(map(one, columns))}) where n >= 10 and {kind} is not null"""


@query(refined_sql(["cust_id", "customer_name", "email_addr", "phone_nr", "ctry", "stat", "amt"]), "dirty")
def type_refine(spark, sf_dir):
    return profile.refined_types(given(spark, sf_dir, "dirty"), "row_idx")


@query("""select 'orders' as "table", c as "column", (select count(*) from orders) as rows from (values ('o_orderkey'), ('o_orderstatus'), ('o_orderdate'), ('o_custkey'), ('o_orderpriority')) t(c) where regexp_matches(c, 'id|no|key|code|email|phone|country|city|status|category|type|date|_at|_dt|ref')""")
def layout_hints(spark, sf_dir):
    return profile.layout_hints(table(spark, sf_dir, "orders"), "orders")


# normalization --------------------------------------------------------------------------------------------------------

FLAT = ["c_mktsegment", "n_name", "r_name", "n_regionkey", "c_nationkey"]


@query(" union all ".join(f"""select '{a}' as determinant, '{b}' as dependent, count(*) as groups, count(*) filter (where d <= 1) as holding from (select {a}, count(distinct {b}) + cast(count(*) > count({b}) as int) as d from flat group by {a})""" for a in FLAT for b in FLAT if a != b), "flat")
def fd_matrix(spark, sf_dir):
    return normalize.fd_matrix(given(spark, sf_dir, "flat").select(*FLAT))


@query()
def normalize_entities(spark, sf_dir):
    groups = normalize.plan_entities(given(spark, sf_dir, "flat").select(*FLAT))
    return spark.createDataFrame([(g["name"], ",".join(g["columns"]), g["distinct_rows"], g["reduction_ratio"]) for g in groups], "name string, columns string, distinct_rows long, reduction_ratio double")


PLACES = [{"name": "Nations", "columns": ["n_name", "n_regionkey", "r_name"]}]
PLACES_SQL = "with d as (select n_name, n_regionkey, r_name, min(row_idx) as f from flat group by all), e as (select row_number() over (order by f) as nation_id, n_name, n_regionkey, r_name from d)"


@query(PLACES_SQL + " select * from e", "flat")
def normalize_table(spark, sf_dir):
    return normalize.materialize(given(spark, sf_dir, "flat"), PLACES, "row_idx")[0]["Nations"]


@query(PLACES_SQL + " select row_idx, c_mktsegment, c_nationkey, nation_id from flat join e using (n_name, n_regionkey, r_name)", "flat")
def normalize_fact(spark, sf_dir):
    return normalize.materialize(given(spark, sf_dir, "flat"), PLACES, "row_idx")[1]


@query()
def schema_ddl(spark, sf_dir):
    d = given(spark, sf_dir, "mixed")
    return spark.createDataFrame([(profile.create_table(d, "mixed"), normalize.ddl(given(spark, sf_dir, "flat"), PLACES, "flat"))], "create_table string, normalized string")


# validation and classification ----------------------------------------------------------------------------------------

REASONS = {
    "cust_id": f"not regexp_matches(cust_id, '{entities.KEY['customer']}')", "customer_name": "trim(customer_name) = ''", "email_addr": f"not regexp_matches(email_addr, {quoted([validate.EMAIL])})",
    "phone_nr": "length(regexp_replace(phone_nr, '[^0-9]', '', 'g')) not between 8 and 15", "stat": f"stat not in ({quoted(entities.PARTY)})", "amt": f"coalesce(({number_sql('amt')}) >= 0, false) = false and amt is not null",
}
DIRTY_CHECKS = [entities.Check("cust_id", "regex", entities.KEY["customer"]), entities.Check("customer_name", "nonblank"), entities.Check("email_addr", "email"), entities.Check("phone_nr", "phone"), entities.Check("stat", "status", tuple(entities.PARTY)), entities.Check("amt", "number")]
REASON_SQL = "concat_ws('; ', " + ", ".join(f"case when {REASONS[c.column]} then '{c.column}: {validate.SAYS[c.kind]}' end" for c in DIRTY_CHECKS) + ")"


@query(f"select row_idx, {REASON_SQL} as reason from dirty", "dirty")
def validate_reasons(spark, sf_dir):
    return validate.with_reason(given(spark, sf_dir, "dirty"), DIRTY_CHECKS).select("row_idx", F.col("_rejection_reason").alias("reason"))


@query(f"select count(*) filter (where r = '') as valid, count(*) filter (where r <> '') as rejected from (select {REASON_SQL} as r from dirty)", "dirty")
def validate_split(spark, sf_dir):
    good, bad = validate.split(given(spark, sf_dir, "dirty"), DIRTY_CHECKS)
    return good.agg(F.count("*").alias("valid")).crossJoin(bad.agg(F.count("*").alias("rejected")))  # one row each


@query("select 'Leads' as entity, case when count(*) >= 100 then 'established' else 'learning' end as status, count(*) as row_count_observed, cast(100 as int) as threshold from dirty", "dirty")
def dynamic_schema(spark, sf_dir):
    d, schemas = given(spark, sf_dir, "dirty"), validate.DynamicSchemas()
    schemas.observe("Leads", d.filter("row_idx % 2 = 0"))
    schemas.observe("Leads", d.filter("row_idx % 2 = 1"))
    return schemas.frame(spark).drop("schema_json")


@query(" union all ".join(f"""select '{c}' as "column", count({c}) as filled, count(distinct {c}) as distinct_values, {str(c.endswith(('_id', '_no', '_code'))).lower()} as id_like from dirty having count({c}) > 0 and count(distinct {c}) >= 0.9 * count({c})""" for c in ["row_idx", "cust_id", "customer_name", "email_addr", "phone_nr", "ctry", "stat", "amt"]), "dirty")
def pk_candidates(spark, sf_dir):
    return classify.key_candidates(given(spark, sf_dir, "dirty"))


@query("""select * from (values ('Customers', cast(105 as bigint)), ('Vendors', -5)) t(entity, score)""")
def classify_scores(spark, sf_dir):
    rows = dict(classify.scores(given(spark, sf_dir, "batch_a"), "customers.csv"))
    got = [(e, rows[e]) for e in ("Customers", "Vendors")]
    return spark.createDataFrame(got, "entity string, score long")


# golden records -------------------------------------------------------------------------------------------------------

FILL = ["full_name", "email", "phone", "city", "country", "address", "status", "created_at"]
GOLD = f"""with a as (select row_idx, customer_id as pk, full_name, email, phone, city, country, cast(null as varchar) as address, status, cast(null as varchar) as created_at from batch_a),
    b0 as (select row_idx, cust_no as pk, name as full_name, mail as email, mobile as phone, town as city, nation as country, cast(null as varchar) as address, state as status, cast(null as varchar) as created_at from batch_b),
    b1 as (select * from b0 where status in ({quoted(entities.PARTY)})),
    b as (select * from b1 where trim(pk) <> '' ),
    keys as (select max(pk) as m, {key_sql('pk')} as n from a group by 2),
    t as (select b.*, coalesce(x.pk, keys.m, b.pk) as target, case when x.pk is not null then 'exact' when keys.m is not null then 'normalized' else 'new' end as found from b left join (select distinct pk from a) x on b.pk = x.pk left join keys on keys.n = {key_sql('b.pk')} and x.pk is null),
    u as (select pk as target, 0 as side, row_idx as r, {', '.join(FILL)} from a union all select target, 1, row_idx, {', '.join(FILL)} from t),
    g as (select target as customer_id, {', '.join(f"coalesce(arg_min({c}, (side, r)) filter (where trim({c}) <> ''), arg_min_null({c}, (side, r))) as {c}, coalesce(trim(arg_min_null({c}, (side, r))), '') = '' and count(*) filter (where trim({c}) <> '') > 0 as e_{c}, arg_min(r, (side, r)) filter (where trim({c}) <> '') as d_{c}" for c in FILL)}, sum(side) as n_in, min(side) = 1 as inserted from u group by target)"""


def no_checks(entity: str) -> list:
    return [c for c in entities.SCHEMAS[entity] if c.kind == "status"]


def gold(spark, sf_dir):
    """Customers from two sources: the first fills an empty master, the second is merged into it."""
    spec, now = entities.REGISTRY["Customers"], F.lit(STAGED)
    first = master.ingest(given(spark, sf_dir, "batch_a"), spec, "ds_a", "file_a", "row_idx", checks=no_checks("Customers"), now=now)
    return first, master.ingest(given(spark, sf_dir, "batch_b"), spec, "ds_b", "rest_api_b", "row_idx", first.master, first.sources, checks=no_checks("Customers"), now=now)


@query(GOLD + f" select customer_id, {', '.join(FILL)}, cast(case when n_in > 0 and not inserted then 2 else 1 end as bigint) as merged_from_count from g", "batch_a batch_b")
def golden_record(spark, sf_dir):
    return gold(spark, sf_dir)[1].master.select("customer_id", *FILL, "merged_from_count")


@query(GOLD + f""" select count(*) filter (where inserted) as rows_inserted, cast(sum(n_in - cast(inserted as int)) as bigint) as rows_duplicates_found, cast(sum(len(list_distinct([x for x in [{', '.join(f'case when e_{c} then d_{c} end' for c in FILL)}] if x is not null]))) as bigint) as rows_enriched,
    cast(sum({' + '.join(f'cast(e_{c} as int)' for c in FILL)}) as bigint) as fields_enriched_total, (select count(*) from b1 where trim(pk) = '') as rows_rejected, (select count(*) from b0) - (select count(*) from b1) as rows_rejected_by_schema, (select count(*) from b0) as total_processed from g""", "batch_a batch_b")
def golden_summary(spark, sf_dir):
    return gold(spark, sf_dir)[1].summary


@query(GOLD + " select 'master_customers' as master_table, pk as pk_value, 'ds_a' as dataset_id, 'file_a' as source_system from a union select 'master_customers', target, 'ds_b', 'rest_api_b' from t", "batch_a batch_b")
def golden_sources(spark, sf_dir):
    return gold(spark, sf_dir)[1].sources


@query(GOLD + " select row_idx, target as target_pk, found from t", "batch_a batch_b")
def norm_key_match(spark, sf_dir):
    b = staging.map_to_master(given(spark, sf_dir, "batch_b").withColumnRenamed("row_idx", "_row"), entities.REGISTRY["Customers"])
    b = validate.split(b, no_checks("Customers"))[0].filter(~fx.is_blank(F.col("customer_id")))
    a = given(spark, sf_dir, "batch_a").select("customer_id")
    return master.target_keys(b, a, "customer_id").select(F.col("_row").alias("row_idx"), "target_pk", "found")


@query(GOLD + " select 'Customers' as entity, count(*) as records, cast(2 as bigint) as source_families, cast(sum(case when n_in > 0 and not inserted then 2 else 1 end) as bigint) as total_inputs, count(*) filter (where n_in > 0 and not inserted) as merged_records from g", "batch_a batch_b")
def master_summary(spark, sf_dir):
    got = gold(spark, sf_dir)[1]
    return master.master_summary({"Customers": (got.master, "master_customers")}, got.sources)


@query(GOLD + " select customer_id, full_name, email from g where contains(lower(concat_ws('|', customer_id, full_name, email, phone, city, country, status)), '5@') order by customer_id desc limit 50", "batch_a batch_b")
def master_search(spark, sf_dir):
    return master.search(gold(spark, sf_dir)[1].master, "5@", [F.desc("customer_id")]).select("customer_id", "full_name", "email")


@query(GOLD + " select customer_id, full_name from g order by customer_id desc limit 50", "batch_a batch_b")
def master_browse(spark, sf_dir):
    return master.browse(gold(spark, sf_dir)[1].master, [F.desc("customer_id")]).select("customer_id", "full_name")


@query("select 'Customers' as entity, 'ds_b' as dataset_id, cust_no as pk_value, 'status: is not in the vocabulary' as rejection_reason from batch_b where state = 'Bogus'", "batch_b")
def rejections(spark, sf_dir):
    return gold(spark, sf_dir)[1].rejected.drop("row_data")


# across files ---------------------------------------------------------------------------------------------------------


@query(r"""select row_idx, v, coalesce(t <> '' and length(t) <= 50 and length(b) >= 3 and regexp_matches(b, '^[A-Za-z0-9]+$') and regexp_matches(b, '[0-9]') and (regexp_matches(b, '[A-Za-z]') or length(b) between 4 and 20), false) as like_id
    from (select *, regexp_replace(t, '[\s\-_/.:]', '', 'g') as b from (select row_idx, v, trim(v) as t from (select row_idx, case row_idx % 4 when 0 then cust_id when 1 then phone_nr when 2 then customer_name else amt end as v from dirty)))""", "dirty")
def id_format(spark, sf_dir):
    d = given(spark, sf_dir, "dirty").select("row_idx", F.expr("case row_idx % 4 when 0 then cust_id when 1 then phone_nr when 2 then customer_name else amt end").alias("v"))
    return d.withColumn("like_id", fx.looks_like_id(F.col("v")))


PAIR = {"orders": ["o_custkey", "o_orderkey"], "customer": ["c_custkey", "c_nationkey"]}


@query("""with v as (select 'orders' as d, 'o_custkey' as c, cast(o_custkey as varchar) as v from orders union select 'orders', 'o_orderkey', cast(o_orderkey as varchar) from orders union select 'customer', 'c_custkey', cast(c_custkey as varchar) from customer union select 'customer', 'c_nationkey', cast(c_nationkey as varchar) from customer),
    s as (select d, c, count(*) as n from v group by 1, 2), p as (select x.d as dataset_a, x.c as column_a, y.d as dataset_b, y.c as column_b, count(*) as common from v x join v y on x.v = y.v and x.d < y.d group by 1, 2, 3, 4)
    select p.*, common / least(a.n, b.n) as overlap from p join s a on a.d = dataset_a and a.c = column_a join s b on b.d = dataset_b and b.c = column_b""")
def column_overlaps(spark, sf_dir):
    return crossfile.overlaps({d: table(spark, sf_dir, d) for d in PAIR}, PAIR)


@query("""select c_custkey as id, c, share, case when regexp_matches(lower(c), '_no|_number|_ref|invoice|bill|order|receipt|transaction|txn') and share >= 0.05 and share <= 0.6 then 'primary_key_match'
    when (regexp_matches(lower(c), 'customer|client|vendor|supplier|product|user|account') and lower(c) like '%id' and share > 0.6) or share > 0.9 then 'foreign_key_link' else 'uncertain' end as class
    from (select c_custkey, case c_custkey % 3 when 0 then 'Invoice_No' when 1 then 'customer_id' else 'colour' end as c, (c_custkey % 101) / 100.0::double as share from customer)""")
def group_classes(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("case c_custkey % 3 when 0 then 'Invoice_No' when 1 then 'customer_id' else 'colour' end").alias("c"), (F.col("c_custkey") % 101 / F.lit(100.0)).alias("share"))
    return d.withColumn("class", crossfile.link_class(F.col("c"), F.col("share")))


CLUSTERS = """with r as (select lower(trim(customer_id)) as id_value, 'a' as dataset, 0 as place, row_idx as row, (1 + cast(coalesce(trim(full_name), '') <> '' as int) + cast(coalesce(trim(email), '') <> '' as int) + cast(coalesce(trim(phone), '') <> '' as int) + 0 + 1 + 1) / 7 as completeness from batch_a
    union all select lower(trim(cust_no)), 'b', 1, row_idx, (cast(trim(cust_no) <> '' as int) + 1 + 1 + cast(mobile is not null as int) + cast(town <> '' as int) + 1 + 1) / 7 from batch_b),
    g as (select id_value from r where id_value <> '' group by 1 having count(distinct dataset) > 1),
    k as (select id_value, dataset, row, completeness, row_number() over (partition by id_value order by completeness desc, place, row) = 1 as keep from r join g using (id_value))"""


def cross_clusters(spark, sf_dir):
    return crossfile.clusters({"a": given(spark, sf_dir, "batch_a"), "b": given(spark, sf_dir, "batch_b")}, [("a", "customer_id"), ("b", "cust_no")], "row_idx")


@query(CLUSTERS + " select * from k", "batch_a batch_b")
def crossfile_clusters(spark, sf_dir):
    return cross_clusters(spark, sf_dir)


@query(CLUSTERS + " select 'b' as dataset_id, row as original_row_index, 'duplicate of ' || id_value as reason from k where not keep and dataset = 'b'", "batch_a batch_b")
def archive_rows(spark, sf_dir):
    plan = cross_clusters(spark, sf_dir).filter("not keep and dataset = 'b'").select("row", F.concat(F.lit("duplicate of "), "id_value").alias("reason"))
    return crossfile.archive(given(spark, sf_dir, "batch_b"), plan, "row_idx", "b")[1].drop("row_data_json")


@query("select sha256('n_name,n_nationkey,n_regionkey' || chr(10) || string_agg(l, chr(10) order by l)) as content_hash from (select lower(trim(n_name)) || ',' || cast(n_nationkey as varchar) || ',' || cast(n_regionkey as varchar) as l from nation)")
def content_hash(spark, sf_dir):
    return hashing.content_hash(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"))


@query()
def content_fingerprint(spark, sf_dir):
    return hashing.content_fingerprint(table(spark, sf_dir, "lineitem"))


@query("select content_hash as hash, count(*) as n, arg_min(file_path, (first_seen_at, file_path)) as canonical, string_agg(file_path, ',' order by file_path) as paths from files group by 1 having count(*) > 1", "files")
def dup_hash_groups(spark, sf_dir):
    return hashing.duplicate_groups(given(spark, sf_dir, "files"))


@query("""with f as (select content_hash, arg_min(file_path, (first_seen_at, file_path)) as first from files where not soft_deleted group by 1)
    select file_path, case when not starts_with(file_name, 'api_') and not starts_with(file_name, 'db_') and first <> file_path then first end as duplicate_of from files left join f using (content_hash)""", "files")
def pre_ingest_gate(spark, sf_dir):
    f = given(spark, sf_dir, "files")
    return hashing.gate(f, f).select("file_path", "duplicate_of")


# linkage --------------------------------------------------------------------------------------------------------------

PAIR_SQL = """with p as (select x."row" as row_a, y."row" as row_b, lower(trim(x.email)) as ea, lower(trim(y.email)) as eb, regexp_replace(x.phone, '[^0-9]', '', 'g') as pa, regexp_replace(y.phone, '[^0-9]', '', 'g') as pb from contacts x join contacts y
      on {0} and (lower(trim(x.name))[1:1] = lower(trim(y.name))[1:1] or lower(trim(x.email))[1:1] = lower(trim(y.email))[1:1] or x.phone[1:1] = y.phone[1:1])),
    s as (select row_a, row_b, case when ea <> '' and ea = eb then 0.98 end as e, case when length(pa) >= 7 and length(pb) >= 7 and (pa = pb or right(pa, 9) = right(pb, 9)) then 0.97 end as p from p),
    t as (select row_a, row_b, round(case when e is not null and p is not null then cast(1 - (1 - cast(e as double)) * (1 - cast(p as double)) as double) when e is not null or p is not null then 0.55 end, 4) as probability, cast((e is not null)::int + (p is not null)::int as int) as signals from s)
    select row_a, row_b, probability, case when probability >= 0.9 then 'high' when probability >= 0.75 then 'medium' else 'low' end as confidence, signals from t where probability >= {1}"""


def contact_rows(spark, sf_dir):
    return link.prepared(given(spark, sf_dir, "contacts"), "row", "name", "email", "phone")


@query(PAIR_SQL.format("x.\"row\" % 2 = 0 and y.\"row\" % 2 = 1", 0.5), "contacts")
def link_email_phone(spark, sf_dir):
    c = contact_rows(spark, sf_dir)
    return link.link_across(c.filter("row % 2 = 0"), c.filter("row % 2 = 1"), 0.5, names=False)


@query(PAIR_SQL.format("x.\"row\" < y.\"row\"", 0.85), "contacts")
def dedup_within(spark, sf_dir):
    return link.dedup_within(contact_rows(spark, sf_dir), 0.85, names=False)


@query()
def party_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Acme "), F.substring("s_name", 10, 20)).alias("name"))
    return link.best_party(names, table(spark, sf_dir, "supplier").select(F.concat(F.lit("Acme "), F.substring("s_name", 9, 20), F.lit(" Ltd")).alias("name")))


@query("""with p as (select x."row" as row_a, y."row" as row_b, nullif(x.phone, '') as pa, nullif(y.phone, '') as pb, nullif(x.name, '') as na, nullif(y.name, '') as nb from contacts x join contacts y on x."row" < y."row" and nullif(x.name, '') = nullif(y.name, '')),
    w as (select row_a, row_b, log2(0.01 / 0.99) + case when pa is null or pb is null then 0 when pa = pb then log2(0.9 / 0.003) else log2(0.1 / 0.997) end + case when na is null or nb is null then 0 when na = nb then log2(0.9 / 0.004) else log2(0.1 / 0.996) end as match_weight from p)
    select row_a, row_b, round(pow(2.0, match_weight) / (1 + pow(2.0, match_weight)), 6) as match_probability from w""", "contacts")
def fs_link(spark, sf_dir):
    c = given(spark, sf_dir, "contacts").select("row", F.expr("nullif(phone, '')").alias("phone"), F.expr("nullif(name, '')").alias("label"))
    pairs = link.blocked(c, None, "row", "label", ["row", "phone", "label"])
    got = link.probability(pairs, ["phone", "label"], {"phone": [0.003, 0.997], "label": [0.004, 0.996]}, 0.01)
    return got.select("row_a", "row_b", F.round("match_probability", 6).alias("match_probability"))


@query()
def fs_dedupe(spark, sf_dir):
    c = given(spark, sf_dir, "contacts").select("row", *[F.expr(f"nullif({x}, '')").alias(y) for x, y in (("name", "full_name"), ("email", "email"), ("phone", "phone"))]).withColumn("country", F.lit("AE"))
    return link.dedupe(c, "row", ["full_name", "email", "phone"], "phone", 0.95)[1]


@query("""with e as (select a, b from edges union select b, a from edges), n as (select distinct a as id from e),
    walk(id, seen) as (select id, id from n union select walk.id, e.b from walk join e on e.a = walk.seen)
    select id, min(seen) as component from walk group by id""", "edges")
def fs_clusters(spark, sf_dir):
    e = given(spark, sf_dir, "edges")
    return graph.components(e.select(F.col("a").alias("id")).union(e.select("b")), e)


# documents ------------------------------------------------------------------------------------------------------------


def kv_sql(name: str) -> str:
    p = documents.FIELDS[name].replace("'", "''")
    return f"case when regexp_matches(text, '(?i){p}') then regexp_replace({trim(f'''regexp_extract(text, '(?i){p}', 1)''')}, '[,.]+$', '') end as {name}"


@query(f"select doc, {', '.join(map(kv_sql, documents.FIELDS))} from invoices", "invoices")
def invoice_kv(spark, sf_dir):
    return documents.key_values(given(spark, sf_dir, "invoices")).select("doc", *documents.FIELDS)


@query(r"""with l as (select doc, [string_split_regex(x, '\s{2,}') for x in [trim(y) for y in string_split(text, chr(10))] if x <> ''] as parts from ocr),
    k as (select doc, [p for p in parts if len(p) >= 3] as rows from l), w as (select doc, rows, list_max([len(r) for r in rows]) as width from k where len(rows) >= 2),
    u as (select doc, rows, width, unnest(range(len(rows))) as line from w)
    select doc, cast(line as int) as line, array_to_string(list_concat(rows[line + 1], [''  for i in range(width - len(rows[line + 1]))]), '|') as cells, line = 0 as header from u""", "ocr")
def ocr_table(spark, sf_dir):
    got = documents.ocr_rows(given(spark, sf_dir, "ocr"), "doc")
    return got.withColumn("cells", F.array_join("cells", "|"))


@query(r"""select doc, h1 || '|' || case when coalesce(trim(h2), '') = '' then 'col_1' else h2 end as header, a || '|' || coalesce(b, '') as cells from tables_raw""", "tables_raw")
def table_shape(spark, sf_dir):
    d = given(spark, sf_dir, "tables_raw").select("doc", F.array("h1", "h2").alias("header"), F.array(F.array("a", "b", F.lit("cut")), F.array(F.lit(" "), F.lit(None).cast("string"))).alias("rows"))
    return documents.table_rows(d, "header", "rows").select("doc", F.array_join("header", "|").alias("header"), F.array_join(F.get("rows", F.lit(0)), "|").alias("cells"))


@query(rf"""with f as (select doc, {kv_sql('total')} from invoices), s as (select l_orderkey as doc, count(*) as line_item_count, cast(sum(l_linenumber) as double) as line_items_sum from lineitem group by 1)
    select doc, coalesce({number_sql("regexp_replace(total, '[^0-9.\\-]', '', 'g')")}, line_items_sum) as amount, line_item_count, line_items_sum from f left join s using (doc)""", "invoices")
def invoice_header(spark, sf_dir):
    fields = documents.key_values(given(spark, sf_dir, "invoices")).select("doc", "total")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("amount"))
    return documents.invoice_headers(fields, lines, "doc").select("doc", "amount", "line_item_count", "line_items_sum")


# governance -----------------------------------------------------------------------------------------------------------


@query("""select run_id || ':' || lower(t) as event_id, t as event_type, case when t = 'START' then started_at else ended_at end as event_time, run_id, 'ingest.' || target_table as job_name from runs, (values ('START'), ('COMPLETE')) v(t)""", "runs")
def lineage_events(spark, sf_dir):
    return governance.lineage_events(given(spark, sf_dir, "runs")).drop("payload")


@query("""select dataset_id, run_id, c_name from runs left join (select 'd' || cast(c_custkey as string) as dataset_id, c_name from customer where c_custkey % 2 = 0) using (dataset_id) order by run_id desc limit 200""", "runs")
def ingestion_log_join(spark, sf_dir):
    sets = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("d"), "c_custkey").alias("dataset_id"), "c_name")
    return governance.log_with_datasets(given(spark, sf_dir, "runs").select("dataset_id", "run_id"), sets, 200, [F.desc("run_id")])


@query("""select *, case when coalesce(parse_error, '') <> '' then 'parse_error' when target_entity is null then 'unrecognized_entity' when coalesce(rows_inserted, 0) > 0 or rows_merged > 0 or fields_enriched > 0 then null when rows_rejected > 0 then 'all_rows_rejected' else 'no_data_extracted' end as reason_category,
    case when coalesce(parse_error, '') = '' and target_entity is not null and (coalesce(rows_inserted, 0) > 0 or rows_merged > 0) then 'archive' else 'aside' end as action from outcomes""", "outcomes")
def disposition(spark, sf_dir):
    return governance.disposition(given(spark, sf_dir, "outcomes"))


@query("select c_custkey as dataset_id, 'v' || cast(c_custkey % 3 as varchar) as path from customer where c_custkey % 3 > 0")
def current_versions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    sets = c.select(F.col("c_custkey").alias("dataset_id"), (F.col("c_custkey") % 3).alias("current_version"))
    versions = c.select(F.col("c_custkey").alias("dataset_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("version_number")).withColumn("path", F.concat(F.lit("v"), "version_number"))
    return governance.current_paths(sets, versions)


def queries():
    from . import platform_queries  # noqa: F401  it registers its own

    return dict(QUERIES)


def oracle_sql():
    queries()
    return dict(SQL)
