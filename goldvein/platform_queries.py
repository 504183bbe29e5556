"""More registered queries: scans and sinks, routing, linkage with names, review queues, learned metadata."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import similarity
from .operators import classify, cleanse, crossfile, governance, hashing, link, master, normalize, profile, staging, validate
from .plans import entities
from .queries import GOLD, INPUTS, PAIR, PAIR_SQL, contact_rows, given, gold, query, quoted, table
from .sources import connectors, files

INPUTS |= {
    "people": """select c_custkey as row_no, 'Name ' || cast(cast(floor(c_custkey / 2) as int) as string) || case when c_custkey % 10 = 1 then ' Jr' else '' end as full_name,
        case when c_custkey % 9 = 0 then null else 'u' || cast(cast(floor(c_custkey / 2) as int) as string) || case when c_custkey % 6 = 1 then '@y.com' else '@x.com' end end as email,
        case when c_custkey % 8 = 0 then null else '+9715' || lpad(cast(cast(floor(c_custkey / 2) as int) as string), 8, '0') end as phone, 'K' || cast(cast(floor(c_custkey / 16) as int) as string) as country,
        case when c_custkey % 29 = 0 then '2024-01-01' end as archived_at from customer""",
    "routed": """select o_orderkey as id, case o_orderkey % 17 when 0 then 'Customer_List' when 1 then 'client-audit' when 2 then 'SUPPLIER' when 3 then 'sku_prices' when 4 then 'q3_billing' when 5 then 'sales_order' when 6 then 'staff' when 7 then 'accounts'
        when 8 then 'contract' when 9 then 'dept' when 10 then 'inventory' when 11 then 'office_sites' when 12 then 'opportunities' when 13 then 'payment_run' when 14 then 'shipping' when 15 then 'weather' else 'order_invoice' end || '_' || cast(o_orderkey as string) || '.csv' as name from orders""",
}


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one; where none is named (local sessions), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="goldvein-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex[:12]}"


# similarity in SQL ----------------------------------------------------------------------------------------------------


def lcs_sql(x: str, y: str) -> str:
    """The longest common subsequence by the rows of its table: one fold over x, in it one over y."""
    row = f"list_reduce([[j] for j in range(1, length({y}) + 1)], lambda a, j: list_append(a, case when unicode({y}[j[1]:j[1]]) = c[1] then r[j[1]] + 1 else greatest(a[j[1]], r[j[1] + 1]) end), [0::bigint])"
    return f"case when {x} = '' or {y} = '' then 0 else list_reduce([[unicode(z)] for z in string_split({x}, '')], lambda r, c: {row}, [0::bigint for i in range(length({y}) + 1)])[length({y}) + 1] end"


def indel_sql(x: str, y: str) -> str:
    return f"200.0::double * ({lcs_sql(x, y)}) / (length({x}) + length({y}))"


TOKENS_SQL = f"""tk as (select na, nb, list_sort(list_distinct([t for t in string_split(na, ' ') if t <> ''])) as xs, list_sort(list_distinct([t for t in string_split(nb, ' ') if t <> ''])) as ys from np),
    parts as (select na, nb, array_to_string([t for t in xs if list_contains(ys, t)], ' ') as both_s, array_to_string([t for t in xs if not list_contains(ys, t)], ' ') as ls, array_to_string([t for t in ys if not list_contains(xs, t)], ' ') as rs from tk),
    m as (select *, length(both_s) as s, cast(both_s <> '' as int) as gap, {lcs_sql('ls', 'rs')} as l from parts),
    ratio as (select na, nb, case when both_s <> '' and (ls = '' or rs = '') then 100.0::double else greatest(100.0::double * (1 - (length(ls) + length(rs) - 2 * l) / (2 * (s + gap) + length(ls) + length(rs))::double),
      case when both_s <> '' then 100.0::double * (1 - (gap + length(ls)) / (s + s + gap + length(ls))::double) else 0 end, case when both_s <> '' then 100.0::double * (1 - (gap + length(rs)) / (s + s + gap + length(rs))::double) else 0 end) end as t from m)"""


@query(f"select x.s_suppkey as a, y.s_suppkey as b, {indel_sql('x.s_name', 'y.s_name')} as score from supplier x join supplier y on x.s_suppkey < y.s_suppkey and x.s_nationkey = y.s_nationkey")
def indel_scores(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b = (s.select(F.col("s_suppkey").alias(k), F.col("s_name").alias(f"name_{k}"), "s_nationkey") for k in "ab")
    return a.join(b, "s_nationkey").filter("a < b").select("a", "b", similarity.indel_ratio("name_a", "name_b").alias("score"))


@query(f"""with t as (select s_suppkey as k, lower(s_name || ' | ' || cast(s_nationkey as varchar)) as t from supplier), p as (select x.k as a, y.k as b, {indel_sql('x.t', 'y.t')} as score from t x join t y on x.k < y.k) select * from p where score >= 95""")
def fuzzy_pairs(spark, sf_dir):
    return profile.fuzzy_rows(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_name", "s_nationkey"], 95)


@query(f"""with v as (select distinct p_name as v from part), p as (select x.v as a, y.v as b, {indel_sql('x.v', 'y.v')} as score from v x join v y on x.v < y.v) select * from p where score >= 85""")
def value_clusters(spark, sf_dir):
    return cleanse.similar_values(table(spark, sf_dir, "part"), "p_name", 85.0)


NAMES_SQL = f"""with p as (select x."row" as row_a, y."row" as row_b, lower(trim(x.name)) as na, lower(trim(y.name)) as nb, lower(trim(x.email)) as ea, lower(trim(y.email)) as eb, regexp_replace(x.phone, '[^0-9]', '', 'g') as pa, regexp_replace(y.phone, '[^0-9]', '', 'g') as pb from contacts x join contacts y
      on {{0}} and ({{2}}(lower(trim(x.name))[1:1] = lower(trim(y.name))[1:1] and x.name <> '') or {{2}}(lower(trim(x.email))[1:1] = lower(trim(y.email))[1:1] and x.email <> '') or (x.phone[1:1] = y.phone[1:1] and x.phone <> ''))),
    e as (select *, case when ea <> '' and ea = eb then 0.98::double end as se, case when length(pa) >= 7 and length(pb) >= 7 and (pa = pb or right(pa, 9) = right(pb, 9)) then 0.97::double end as sp from p),
    q as (select * from e where se is not null or sp is not null), np as (select distinct na, nb from q where na <> '' and nb <> ''), {TOKENS_SQL},
    s as (select row_a, row_b, [z for z in [se, sp, case when t >= 90 then t / 100 when t >= 75 then 0.6::double * t / 100 end] if z is not null] as s from q left join ratio using (na, nb)),
    u as (select row_a, row_b, s, len([z for z in s if z >= 0.9]) as strong from s),
    r as (select row_a, row_b, round(case when strong >= 2 then 1 - list_product([1 - z for z in s]) when strong = 1 then least(list_max(s), 0.55::double) end, 4) as probability, cast(len(s) as int) as signals from u)
    select row_a, row_b, probability, case when probability >= 0.9 then 'high' when probability >= 0.75 then 'medium' else 'low' end as confidence, signals from r where probability >= {{1}}"""


@query(NAMES_SQL.format("x.\"row\" % 2 = 0 and y.\"row\" % 2 = 1", 0.7, ""), "contacts")
def link_names_token_set(spark, sf_dir):
    c = contact_rows(spark, sf_dir)
    return link.link_across(c.filter("row % 2 = 0"), c.filter("row % 2 = 1"), 0.7, prune_blank_blocks=True)


@query(NAMES_SQL.format("x.\"row\" < y.\"row\"", 0.7, "1 = 1 or "), "contacts")
def resolve_entities(spark, sf_dir):
    return link.resolve_entities(given(spark, sf_dir, "contacts").withColumnRenamed("name", "full_name"), None, "row")[0]


SUMMED = PAIR_SQL.format("x.\"row\" < y.\"row\"", 0.85).rsplit("\n    select ", 1)


@query(f"{SUMMED[0]} select confidence, count(*) as matches from (select {SUMMED[1]}) group by 1", "contacts")
def match_summary(spark, sf_dir):
    return link.summary_within(contact_rows(spark, sf_dir), 0.85, names=False)


@query(PAIR_SQL.format("x.\"row\" < y.\"row\"", 0.85) + " order by probability desc, row_a, row_b limit 500", "contacts")
def match_top(spark, sf_dir):
    return link.top_within(contact_rows(spark, sf_dir), 0.85, names=False)


@query("""select * from (values ('plain', 'name', 'customer_name'), ('plain', 'email', 'email_addr'), ('plain', 'phone', 'phone_nr'), ('fuller', 'name', 'Full_Name'), ('fuller', 'email', 'e_mail'), ('fuller', 'phone', 'cell'), ('odd', 'name', 'contact')) t(header, signal, "column")""")
def identity_columns(spark, sf_dir):
    headers = {"plain": given(spark, sf_dir, "dirty").columns, "fuller": ["owner_name", "Full_Name", "username", "e_mail", "work_mail", "cell"], "odd": ["email_opt_out", "file_name", "phone_at", "company_name", "contact"]}
    return spark.createDataFrame([(h, s, c) for h, columns in headers.items() for s, c in link.identity_columns(columns).items()], "header string, signal string, column string")


# Fellegi-Sunter with given u shares -----------------------------------------------------------------------------------

U = {"full_name": [0.002, 0.003, 0.005, 0.09, 0.9], "email": [0.001, 0.002, 0.007, 0.09, 0.9], "phone": [0.001, 0.999], "country": [0.01, 0.99]}


def level_sql(column: str) -> str:
    a, b = f"a.{column}", f"b.{column}"
    if column.endswith("name"):
        j = f"jaro_winkler_similarity({a}, {b})"
        levels = [f"{a} = {b}", f"{j} >= 0.92", f"{j} >= 0.88", f"{j} >= 0.70", "true"]
    elif column == "email":
        x, y = f"split_part({a}, '@', 1)", f"split_part({b}, '@', 1)"
        levels = [f"{a} = {b}", f"{x} = {y}", f"jaro_winkler_similarity({a}, {b}) >= 0.88", f"jaro_winkler_similarity({x}, {y}) >= 0.88", "true"]
    else:
        levels = [f"{a} = {b}", "true"]
    m = link.M[link.kind_of(column)]
    return f"case when {a} is null or {b} is null then 0 " + " ".join(f"when {c} then log2({m[i]}::double / {U[column][i]}::double)" for i, c in enumerate(levels)) + " end"


def fs_sql(left: str, right: str, on: str, columns: list[str], strict: str, pairs: str, recall: float, threshold: float) -> str:
    """CTEs up to ``scored`` (row_a, row_b, p)."""
    return f"""prior as (select least(greatest(({strict}) / {recall}::double / greatest(({pairs})::double, 1), 1e-9), 1 - 1e-9) as p),
    weighed as (select a.row_no as row_a, b.row_no as row_b, (select log2(p / (1 - p)) from prior) + {' + '.join(map(level_sql, columns))} as w from {left} a join {right} b on {on}),
    scored as (select row_a, row_b, pow(2.0::double, least(w, 500)) / (1 + pow(2.0::double, least(w, 500))) as p from weighed where pow(2.0::double, least(w, 500)) / (1 + pow(2.0::double, least(w, 500))) >= {threshold})"""


WITHIN = fs_sql("act", "act", "a.country = b.country and a.row_no < b.row_no", ["full_name", "email", "phone", "country"], "select coalesce(sum(k * (k - 1) / 2), 0) from (select count(*) as k from act where email is not null group by full_name, email)", "select count(*) * (count(*) - 1) / 2 from act", 0.7, 0.95)
CLUSTERED = f"""with act as (select * from people where archived_at is null), {WITHIN}, e as (select row_a as a, row_b as b from scored union all select row_b, row_a from scored),
    walk(id, seen) as (select row_no, row_no from act union select walk.id, e.b from walk join e on e.a = walk.seen), comp as (select id, min(seen) as c from walk group by id)"""


@query(f"with act as (select * from people where archived_at is null), {WITHIN} select row_a, row_b, round(p, 6) as match_probability from scored", "people")
def fs_dedupe_pairs(spark, sf_dir):
    p = given(spark, sf_dir, "people").filter("archived_at is null")
    got = link.dedupe(p, "row_no", ["full_name", "email", "phone", "country"], "country", 0.95, u=U)[0]
    return got.select(F.col("row_no_a").alias("row_a"), F.col("row_no_b").alias("row_b"), F.round("match_probability", 6).alias("match_probability"))


@query(CLUSTERED + " select c as cluster, id, size from comp join (select c, count(*) as size from comp group by 1 having count(*) > 1) using (c)", "people")
def master_review(spark, sf_dir):
    return link.fuzzy_duplicates(given(spark, sf_dir, "people"), "Customers", "row_no", 0.95, U)


def two_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = given(spark, sf_dir, "people").drop("archived_at")
    b = p.filter("row_no % 2 = 1").withColumnsRenamed({"full_name": "full_nm", "email": "work_email", "phone": "mobile_nr", "country": "ctry"})
    return p.filter("row_no % 2 = 0"), b


def across(threshold: float) -> str:
    ab = "with pa as (select * from people where row_no % 2 = 0), pb as (select * from people where row_no % 2 = 1), "
    return ab + fs_sql("pa", "pb", "a.country = b.country", ["full_name", "email", "phone", "country"], "select count(*) from pa join pb using (full_name, email)", "(select count(*) from pa) * (select count(*) from pb)", 0.9, threshold) + " select row_a, row_b, round(p, 6) as match_probability from scored"


@query(across(0.9), "people")
def link_two_tables(spark, sf_dir):
    got = link.link_tables(*two_tables(spark, sf_dir), "row_no", "Customers", 0.9, u=U)
    return got.select(F.col("row_no_a").alias("row_a"), F.col("row_no_b").alias("row_b"), F.round("match_probability", 6).alias("match_probability"))


@query(across(0.5), "people")
def match_queue(spark, sf_dir):
    a, b = two_tables(spark, sf_dir)
    got = link.match_queue({"stg_vendors__z": a, "stg_customers__b": b, "stg_customers__a": a}, "Customers", "row_no", 0.5, U)[1]
    return got.select(F.col("row_no_a").alias("row_a"), F.col("row_no_b").alias("row_b"), F.round("match_probability", 6).alias("match_probability"))


@query("select row_no, full_name, email, phone, country from people where row_no % 2 = 1", "people")
def link_canonical(spark, sf_dir):
    return link.canonical(two_tables(spark, sf_dir)[1])


@query("select 'Customers' as entity, cast(row_no as varchar) as pair_a, 'x' as pair_b, 0.9::double as probability, case when row_no = 1 then 'approve' else 'reject' end as decision from people where row_no in (1, 2)", "people")
def steward_decisions(spark, sf_dir):
    first = link.decisions(None, spark, "Customers", "1", "x", 0.9, "approve")
    return link.decisions(first, spark, "Customers", "2", "x", 0.9, "reject")


# scans and sinks ------------------------------------------------------------------------------------------------------


@query("select cast(doc_id as varchar) as doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from documents")
def scan_csv(spark, sf_dir):
    path = f"{work_folder(spark)}.csv"
    files.export(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, "csv")
    return files.from_file(spark, path)


@query("select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_nationkey as varchar) as s_nationkey from supplier")
def scan_tsv(spark, sf_dir):
    path = f"{work_folder(spark)}.tsv"
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.csv(path, header=True, sep="\t")
    return files.from_file(spark, path)


@query("select * from part")
def scan_parquet(spark, sf_dir):
    path = f"{work_folder(spark)}.parquet"
    files.export(table(spark, sf_dir, "part"), path, "parquet")
    return files.from_file(spark, path)


@query("select cast(c_custkey as varchar) as c_custkey, c_name, c_mktsegment from customer")
def scan_sqlite(spark, sf_dir):
    import sqlite3

    path = f"{tempfile.mkdtemp(prefix='goldvein-')}/x.db"
    with sqlite3.connect(path) as con:
        con.execute("create table customer (c_custkey integer, c_name text, c_mktsegment text)")
        con.executemany("insert into customer values (?, ?, ?)", map(tuple, table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").toLocalIterator()))
    assert connectors.sqlite_tables(path) == ["customer"]
    return connectors.from_sqlite(spark, path, "customer")


@query("select 'landing' as layer, 'landing_file_nation' as \"table\", (select count(*) from nation) as rows, cast(4 as int) as columns union all select 'stg', 'stg_customers__file_dirty', count(*), 6 from dirty", "dirty")
def layer_inventory(spark, sf_dir):
    root = work_folder(spark)
    files.to_landing(table(spark, sf_dir, "nation").withColumn("extra", F.lit(1)), "landing_file_nation", "file_nation", root)
    staging.build_all({"landing_file_customers": given(spark, sf_dir, "dirty")}, None)["stg_customers__file_customers"].write.parquet(f"{root}/stg_customers__file_dirty")
    return files.layers(spark, root)


@query("select file_path, case when length(file_path) % 2 = 0 then 'new' else content_hash end as content_hash, cast(case when length(file_path) % 2 = 0 then 2 else 1 end as int) as mtime, first_seen_at from files", "files")
def file_upsert(spark, sf_dir):
    f = given(spark, sf_dir, "files").select("file_path", "content_hash", F.lit(1).alias("mtime"), "first_seen_at")
    new = f.filter("length(file_path) % 2 = 0").select("file_path", F.lit("new").alias("content_hash"), F.lit(2).alias("mtime"), F.lit("2030").alias("first_seen_at"))
    return hashing.upsert(f, new)


@query("select x.file_path, y.file_path as duplicate_path from files x join files y using (content_hash) where x.file_path <> y.file_path and not x.soft_deleted and not y.soft_deleted", "files")
def duplicate_files(spark, sf_dir):
    return hashing.duplicates_of(given(spark, sf_dir, "files"))


@query("select cast(count(*) as bigint) as files, cast(sum(octet_length(encode(file_name))) as bigint) as bytes, count(distinct content_hash) as distinct_files, count(*) - count(distinct content_hash) as duplicate_files from files", "files")
def scan_summary(spark, sf_dir):
    return hashing.scan_summary(given(spark, sf_dir, "files").select(F.col("content_hash").alias("file_hash"), F.octet_length("file_name").cast("long").alias("length")))


# routing, keys and masters --------------------------------------------------------------------------------------------


@query(r"""select id, case when regexp_matches(lower(name), 'customer|contact|client|audit') then 'Customers' when regexp_matches(lower(name), 'vendor|supplier') then 'Vendors' when regexp_matches(lower(name), 'product|sku|catalog|quarterly') then 'Products'
    when regexp_matches(lower(name), 'invoice|bill|billing|receipt') then 'Invoices' when regexp_matches(lower(name), 'order|sales_order') then 'SalesOrders' when regexp_matches(lower(name), 'employee|staff|personnel|hr') then 'Employees' when lower(name) like '%account%' then 'Accounts'
    when lower(name) like '%contract%' then 'Contracts' when regexp_matches(lower(name), 'department|dept') then 'Departments' when lower(name) like '%inventor%' then 'Inventory' when regexp_matches(lower(name), 'location|address|site') then 'Locations'
    when lower(name) like '%opportunit%' then 'Opportunities' when lower(name) like '%payment%' then 'Payments' when regexp_matches(lower(name), 'shipment|shipping') then 'Shipments' end as entity from routed""", "routed")
def file_routing(spark, sf_dir):
    return given(spark, sf_dir, "routed").select("id", entities.file_entity(F.col("name")).alias("entity"))


@query("""select k as "column", case k when 'customer_id' then 'Customers' when 'supplier_id' then 'Vendors' when 'order_number' then 'Invoices' when 'dept_cd' then 'Departments' when 'warehouse_id' then 'Warehouses' when 'pmt_id' then 'Payments'
    else case when regexp_matches(k, '_(id|no|key|code|nr)$') then upper(regexp_replace(k, '_(id|no|key|code|nr)$', '')[1:1]) || lower(regexp_replace(k, '_(id|no|key|code|nr)$', '')[2:]) || 's' else 'FooBar' end end as entity
    from (values ('customer_id'), ('supplier_id'), ('order_number'), ('dept_cd'), ('warehouse_id'), ('pmt_id'), ('grant_no'), ('asset_key'), ('site_nr'), ('colour')) t(k)""")
def entity_by_key(spark, sf_dir):
    names = "customer_id supplier_id order_number dept_cd warehouse_id pmt_id grant_no asset_key site_nr colour".split()
    return spark.createDataFrame([(n, entities.entity_for_key(n, "file_foo_bar")) for n in names], "column string, entity string")


@query("""select id, case status when 'Active' then 'Open' when 'Inactive' then 'Paid' else status end as status from (select o_orderkey as id, case o_orderkey % 4 when 0 then 'Active' when 1 then 'Inactive' when 2 then 'Overdue' end as status from orders)""")
def status_rewrite(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case o_orderkey % 4 when 0 then 'Active' when 1 then 'Inactive' when 2 then 'Overdue' end as status")
    return staging.rename_statuses(d, "Invoices")


@query(" union all ".join(f"select '{c}' as \"column\", count(distinct {c}) / count(*) as share, count(distinct {c}) / count(*) >= 0.9 as fit from batch_b" for c in ["cust_no", "name", "mobile"]), "batch_b")
def key_gate(spark, sf_dir):
    b = given(spark, sf_dir, "batch_b")
    got = [(c, classify.unique_share(b, c)) for c in ("cust_no", "name", "mobile")]
    return spark.createDataFrame([(c, s, s >= classify.KEY_SHARE) for c, s in got], "column string, share double, fit boolean")


@query("""with s as (select c, d / n as share, c in ('row_idx', 'customer_id') as id_like from (select 'customer_id' as c, count(distinct customer_id) as d, count(*) as n from batch_a union all select 'full_name', count(distinct full_name), count(*) from batch_a union all select 'email', count(distinct email), count(*) from batch_a))
    select c as primary_key from s where share >= 0.98 order by c like '%id' desc limit 1""", "batch_a")
def primary_key_pick(spark, sf_dir):
    return spark.createDataFrame([(normalize.primary_key(given(spark, sf_dir, "batch_a"), ["full_name", "email", "customer_id"]),)], "primary_key string")


@query(GOLD + " select dataset_id, pk_value, source_system, name from (select 'ds_a' as dataset_id, pk as pk_value, 'file_a' as source_system from a union select 'ds_b', target, 'rest_api_b' from t) left join (values ('ds_a', 'first file')) v(dataset_id, name) using (dataset_id) where pk_value = 'C-000004'", "batch_a batch_b")
def record_sources(spark, sf_dir):
    names = spark.createDataFrame([("ds_a", "first file")], "dataset_id string, name string")
    return master.record_sources(gold(spark, sf_dir)[1].sources, names, "master_customers", "C-000004").select("dataset_id", "pk_value", "source_system", "name")


@query("""with a as (select customer_id, full_name, email from batch_a), b as (select cust_no as customer_id, min(mobile) as mobile from batch_b where trim(cust_no) <> '' group by 1)
    select customer_id, full_name, email, null as mobile from a union all select customer_id, null, null, mobile from b where customer_id not in (select customer_id from a)""", "batch_a batch_b")
def master_absorb(spark, sf_dir):
    a = given(spark, sf_dir, "batch_a").select("customer_id", "full_name", "email")
    b = given(spark, sf_dir, "batch_b").filter("trim(cust_no) <> ''").groupBy(F.col("cust_no").alias("customer_id")).agg(F.min("mobile").alias("mobile"))
    return master.absorb(a, b, "customer_id")


@query("select cast(row_number() over (order by row_idx) - 1 as bigint) as row_idx, customer_id from batch_a where row_idx % 4 <> 0", "batch_a")
def delete_rows(spark, sf_dir):
    a = given(spark, sf_dir, "batch_a").select("row_idx", "customer_id")
    left, _ = crossfile.archive(a, a.filter("row_idx % 4 = 0").select(F.col("row_idx").alias("row"), F.lit("gone").alias("reason")), "row_idx", "a")
    return crossfile.renumber(left, "row_idx")


@query("select * from (values ('a', 'customer_id'), ('b', 'Customer_ID')) t(dataset, \"column\")")
def shared_id_columns(spark, sf_dir):
    sets = {"a": given(spark, sf_dir, "batch_a"), "b": given(spark, sf_dir, "batch_b").withColumnRenamed("cust_no", "Customer_ID")}
    found = {d: [r["column"] for r in crossfile.id_columns(df, "row_idx").filter("by_name").collect()] for d, df in sets.items()}
    return spark.createDataFrame([m for group in crossfile.shared_columns(sets, found) for m in group], "dataset string, column string")


LIKE_ID = r"coalesce(t <> '' and length(t) <= 50 and length(b) >= 3 and regexp_matches(b, '^[A-Za-z0-9]+$') and regexp_matches(b, '[0-9]') and (regexp_matches(b, '[A-Za-z]') or length(b) between 4 and 20), false)"
ID_PART = " union all ".join(
    f"""select '{c}' as c, {str(c == 'customer_id').lower()} as by_name, count(*) as rows, count({c}) as filled, count(distinct {c}) as d, (select count(*) from f_{c}) as seen, (select count(*) from f_{c} where {LIKE_ID}) as alike from batch_a""" for c in ("customer_id", "email", "phone")
)
FIRSTS = ", ".join(rf"f_{c} as (select trim({c}) as t, regexp_replace(trim({c}), '[\s\-_/.:]', '', 'g') as b from (select {c} from batch_a where {c} is not null order by row_idx limit 50))" for c in ("customer_id", "email", "phone"))


@query(f"""with {FIRSTS}, s as ({ID_PART}), g as (select *, filled >= greatest(2, rows / 2) and d >= 0.95 * filled as by_distinct, filled >= 5 and alike >= 0.7 * seen as by_format from s)
    select c as "column", by_name, by_distinct, by_format, cast(by_name as int) + cast(by_distinct as int) + cast(by_format as int) as signals, case when (by_format and cast(by_name as int) + cast(by_distinct as int) >= 1) or (by_name and by_distinct and by_format) then 'high' else 'medium' end as confidence
    from g where by_format or (by_name and by_distinct)""", "batch_a")
def id_columns(spark, sf_dir):
    return crossfile.id_columns(given(spark, sf_dir, "batch_a"), "row_idx")


@query("""with v as (select 'orders' as d, 'o_custkey' as c, cast(o_custkey as varchar) as v from orders union select 'orders', 'o_orderkey', cast(o_orderkey as varchar) from orders union select 'customer', 'c_custkey', cast(c_custkey as varchar) from customer union select 'customer', 'c_nationkey', cast(c_nationkey as varchar) from customer),
    s as (select d, c, count(*) as n from v group by 1, 2), p as (select x.d || '.' || x.c as a, y.d || '.' || y.c as b, count(*) as common, min(sx.n) as nx, min(sy.n) as ny from v x join v y on x.v = y.v and x.d < y.d join s sx on sx.d = x.d and sx.c = x.c join s sy on sy.d = y.d and sy.c = y.c group by 1, 2),
    o as (select a, b, common / least(nx, ny) as overlap from p where common / least(nx, ny) >= 0.1), e as (select a, b from o union all select b, a from o), walk(id, seen) as (select a, a from e union select walk.id, e.b from walk join e on e.a = walk.seen),
    g as (select id, min(seen) as c from walk group by 1), k as (select g.c, max(overlap) as overlap from o join g on g.id = o.a group by 1)
    select cast(row_number() over (order by overlap desc) - 1 as int) as group_no, split_part(c, '.', 2) as "column", overlap, case when overlap > 0.9 then 'foreign_key_link' else 'uncertain' end as classification, false as dedup_recommended from k""", "dirty")
def column_groups(spark, sf_dir):
    return crossfile.classify_groups(spark, crossfile.column_groups({d: table(spark, sf_dir, d) for d in PAIR}, PAIR))


def learned_sql() -> str:
    ids = " ".join(f"when bool_and(regexp_matches(cust_id, {quoted([p])})) then 'regex=' || {quoted([p])} || ';'" for p in validate.ID_PATTERNS)
    text = lambda c, checks: f"select '{c}' as \"column\", 'str' as dtype, count(*) > count({c if c != 'status' else 'stat'}) as nullable, {checks} as checks from dirty"
    return " union all ".join([
        "select 'row_idx' as \"column\", 'int' as dtype, count(*) > count(row_idx) as nullable, case when min(row_idx) >= 0 then 'ge=0' else '' end as checks from dirty",
        text("cust_id", f"case {ids} else '' end || 'non_empty'"), text("customer_name", "''"), text("email_addr", "'email'"), text("phone_nr", "'phone'"), text("ctry", "''"),
        text("status", "'isin=' || (select string_agg(stat, '|' order by stat) from (select distinct stat from dirty where stat is not null))"), text("amt", "''"),
    ])


@query(learned_sql(), "dirty")
def learned_metadata(spark, sf_dir):
    return validate.learned_frame(given(spark, sf_dir, "dirty").withColumnRenamed("stat", "status"))


# checks and lineage ---------------------------------------------------------------------------------------------------


@query("""select * from (values ('email_addr', 'email'), ('phone_nr', 'phone'), ('d', 'date'), ('row_idx', null)) t("column", intent)""")
def column_intents(spark, sf_dir):
    d = given(spark, sf_dir, "dirty").select("row_idx", "email_addr", "phone_nr").withColumn("d", F.lit("2024-01-02"))
    return spark.createDataFrame(list(profile.intents(d, "row_idx").items()), "column string, intent string")


@query(" union all ".join(f"""select '{c}' as "column", avg(cast(regexp_matches(v, {quoted([profile.PHONE_LOOK])}) as int)) as phone, avg(cast(contains(v, '@') and contains(v, '.') as int)) as email, avg(cast(regexp_matches(v, {quoted(['|'.join(profile.DATE_FORMATS.values())])}) as int)) as date
    from (select trim({c}) as v from dirty where {c} is not null order by row_idx limit 50)""" for c in ("email_addr", "phone_nr", "cust_id")), "dirty")
def looks_like(spark, sf_dir):
    parts = [profile.looks(given(spark, sf_dir, "dirty"), c, "row_idx").select(F.lit(c).alias("column"), "phone", "email", "date") for c in ("email_addr", "phone_nr", "cust_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""select * from (select run_id || ':' || lower(t) as event_id, t as event_type, case when t = 'START' then started_at else ended_at end as event_time, run_id from runs, (values ('START'), ('COMPLETE')) v(t)) order by event_time desc, event_id limit 200""", "runs")
def lineage_export(spark, sf_dir):
    return governance.newest_events(governance.lineage_events(given(spark, sf_dir, "runs"))).select("event_id", "event_type", "event_time", "run_id")


@query("select t as event_type, count(*) as events from runs, (values ('START'), ('COMPLETE')) v(t) group by 1", "runs")
def lineage_counts(spark, sf_dir):
    return governance.event_counts(governance.lineage_events(given(spark, sf_dir, "runs")))


@query("""select 'v' || cast(n as varchar) as version, n as version_number, rows, n = 1 as is_current from (select 1 as n, (select count(*) from nation) as rows union all select 2, (select count(*) from region))""")
def version_chain(spark, sf_dir):
    """Two versions of a dataset, then a rollback to the first."""
    catalog = governance.Catalog(spark, work_folder(spark))
    name, _ = catalog.register(table(spark, sf_dir, "nation"), "s", "f", "file_s", "2024-01-01")
    catalog.register(table(spark, sf_dir, "region"), "s", "f", "file_s", "2024-01-02")
    catalog.point(name, 1)
    current = catalog.get(name)["current_version"]
    rows = [(f"v{v['version_number']}", v["version_number"], spark.read.parquet(v["path"]).count(), v["version_number"] == current) for v in catalog.rows("dataset_versions")]
    return spark.createDataFrame(rows, "version string, version_number int, rows long, is_current boolean")
