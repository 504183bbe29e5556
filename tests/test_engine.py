"""Scalars, operators and the platform on small tables with known answers."""

import json
import sqlite3
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from goldvein.functions import phones, similarity
from goldvein.functions import text as fx
from goldvein.operators import classify, cleanse, crossfile, governance, hashing, link, master, normalize, profile, staging, validate
from goldvein.plans import entities
from goldvein.plans.pipeline import Platform
from goldvein.sources import connectors, documents, files, naming


def column(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_scalars(spark):
    assert column(spark, fx.normalize_key, [" inv 2024/_00200- ", "INV-000200", None, " "]) == ["INV-2024-00200", "INV-000200", "", ""]
    assert column(spark, fx.strip_thousands, ["1,234.50", "12,34", "1234", None]) == ["1234.50", "12,34", "1234", None]
    assert column(spark, fx.clean_currency, ["$1,234.50 USD", "", "abc", None]) == ["1234.50", None, None, None]
    assert column(spark, fx.clean_name, ["AHMED ALI", "ny office", "McDonald", None, "  ", "CEO ali"]) == ["Ahmed Ali", "NY Office", "McDonald", None, "  ", "CEO ali"]
    assert column(spark, fx.clean_status, ["ACT", "loa", "", "in transit", "P", None]) == ["Active", "On Leave", "Unknown", "In Transit", "Paid", None]
    assert column(spark, fx.squeeze, ["  a   b ", None]) == ["a b", None]
    assert column(spark, fx.clean_email, [" A@B.co ", "a@b", "x..y@b.co", None]) == ["a@b.co", "a@b", "x..y@b.co", None]
    assert column(spark, fx.clean_date, ["2024-3-5", "03/14/2024", "25/12/2023", "soon", None]) == ["2024-03-05", "2024-03-14", "2023-12-25", "soon", None]
    assert column(spark, fx.looks_like_id, ["INV-2024-001", "BILL_8847", "C-042", "SKU123", "4912-AB", "1234", "2024-01-15", "Hello world", "+971501234567", "ahmed@x.com", "123", None]) == [True] * 7 + [False] * 5
    assert column(spark, phones.clean_phone, ["+971 50 123 4567", "050 123 4567", "00442079460958", "123", None]) == ["+971501234567", "+971501234567", "+442079460958", "123", None]
    assert column(spark, fx.iso_country, ["uae", "Nowhere"]) == ["AE", "Nowhere"]


def test_similarity():
    assert round(similarity.indel("kitten", "sitting"), 4) == 61.5385 and similarity.indel("acme llc", "acme ltd") == 75.0 and round(similarity.indel("ahmed", "amed"), 4) == 88.8889
    assert similarity.token_set("ali ahmed", "ahmed ali") == 100 and round(similarity.token_set("john smith", "jon smith"), 4) == 94.7368 and round(similarity.token_set("sara khan", "omar farid"), 4) == 42.1053
    assert similarity.partial("abc", "xxabcxx") == 100 and round(similarity.jaro_winkler("ahmed", "amed"), 2) == 0.94


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.lcs(a, b) == table[-1][-1] and similarity.indel(a, b) == similarity.indel(b, a)


@pytest.mark.parametrize(("source", "table"), [("customers.csv", "landing_file_customers"), ("orders__Customers.csv", "landing_file_orders_customers"), ("api_employees", "landing_api_employees"), ("db_legacy_customers", "landing_sqlite_legacy_customers"), ("data.parquet", "landing_file_data_parquet")])
def test_landing_names(spark, source, table):
    assert naming.landing_table(source) == table and column(spark, naming.landing_table_column, [source]) == [table]


def test_entities():
    assert [entities.entity_for_key(x) for x in ("cust_no", "warehouse_id", "grant_no", "x")] == ["Customers", "Warehouses", "Grants", "Unknown"]
    assert entities.entity_for_key("x", "api_my_things") == "MyThings" and entities.entity_for_file("q4_orders.csv") == "SalesOrders" and normalize.foreign_key("Addresses") == "addresse_id"
    assert entities.entity_for_landing("landing_file_customer_audit") == "Customers" and entities.entity_for_landing("landing_file_order_shipment") is None


def test_validation(spark):
    rows = [("C-0001", "A", "a@b.co", "+971 50 123 4567", "Active"), ("C-1", "A", "a@b", "123", "Gone"), ("C-0002", " ", "", None, None)]
    good, bad = validate.split(spark.createDataFrame(rows, "customer_id string, full_name string, email string, phone string, status string"), entities.SCHEMAS["Customers"])
    assert [r.customer_id for r in good.collect()] == ["C-0001"]
    assert {r.customer_id: r._rejection_reason.count(";") + 1 for r in bad.collect()} == {"C-1": 4, "C-0002": 2}
    pattern = entities.KEY["invoice"]
    assert column(spark, lambda c: c.rlike(pattern), ["INV-2024-00200", "BILL-0001", "INV-1"]) == [True, True, False]


def test_dynamic_schema(spark):
    s, df = validate.DynamicSchemas(), spark.range(60).selectExpr("concat('G-', id) as grant_id", "cast(id as int) as n", "if(id % 2 = 0, 'a', 'b') as status")
    assert s.observe("Grants", df)["status"] == "learning" and s.observe("Grants", df)["status"] == "established"
    assert s.rows["Grants"]["row_count_observed"] == 120
    good, bad, state = s.validate(spark.createDataFrame([("G-1", 1, "a"), ("g1", -1, "z")], "grant_id string, n int, status string"), "Grants")
    assert (good.count(), bad.count(), state) == (1, 1, "established")
    assert s.promote("Grants") and s.observe("Grants", df)["status"] == "curated"


def people(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx long, customer_id string, full_name string, email string")


def test_golden_record(spark):
    spec = entities.REGISTRY["Customers"]
    a = master.ingest(people(spark, [("C-0001", "Ann", ""), ("C-0002", "Bob", "a@b.co")]), spec, "d1", "file_a", "row_idx", checks=[])
    b = master.ingest(people(spark, [("c 0001", "", "x@y.zz"), ("C-0002", "Rob", "x@y.zz"), ("C-0003", "", None), ("C-0003", "New", None), ("", "Nobody", None)]), spec, "d2", "api_b", "row_idx", a.master, a.sources, checks=[])
    got = {r.customer_id: r for r in b.master.collect()}
    assert (got["C-0001"].full_name, got["C-0001"].email, got["C-0001"].merged_from_count) == ("Ann", "x@y.zz", 2)
    assert got["C-0002"].email == "a@b.co" and got["C-0003"].full_name == "New" and len(got) == 3
    s = b.summary.first()
    assert (s.rows_inserted, s.rows_duplicates_found, s.rows_enriched, s.fields_enriched_total, s.rows_rejected, s.total_processed) == (1, 3, 2, 2, 1, 5)
    again = master.ingest(people(spark, [("C-0001", "Ann", "")]).repartition(3), spec, "d1", "file_a", "row_idx", b.master, b.sources, checks=[])
    assert {r.customer_id: r.email for r in again.master.collect()}["C-0001"] == "x@y.zz"


def test_normalize(spark):
    df = spark.range(200).selectExpr("id", "concat('city', id % 5) as city", "concat('land', id % 5) as country", "cast(rand(1) * 1e6 as int) as amount")
    groups = normalize.plan_entities(df.drop("id"))
    assert [(g["name"], g["columns"], g["distinct_rows"]) for g in groups] == [("Locations", ["city", "country"], 5)]
    tables, fact = normalize.materialize(df, groups, "id")
    back = fact.join(tables["Locations"], "location_id").select("id", "city", "country", "amount")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert [r.location_id for r in tables["Locations"].orderBy("location_id").collect()] == [1, 2, 3, 4, 5]
    assert "location_id INTEGER REFERENCES Locations(location_id)" in normalize.ddl(df, groups, "fact")


def test_profile(spark):
    df = spark.createDataFrame([(1, "1", "x", None), (2, "2", "x", "a"), (3, "z", "x", ""), (3, "z", "x", "")], "id int, m string, k string, n string")
    stats = {r["column"]: r for r in profile.column_stats(df).collect()}
    assert stats["k"].constant and not stats["id"].unique and stats["n"].nulls == 1
    assert profile.exact_duplicates(df).first() == (4, 2)
    assert 'PRIMARY KEY' in profile.create_table(df.limit(2), "t")


def test_cleanse(spark):
    df = spark.createDataFrame([(1, "ANN LEE", "2024/1/5", "1,000"), (2, "bob", "never", None)], "i int, full_name string, hire_date string, note string")
    clean, log = cleanse.remediate(df, order="i")
    assert [tuple(r)[1:] for r in clean.orderBy("i").collect()] == [("Ann Lee", "2024-01-05", "1000"), ("Bob", "never", None)]
    assert {r["column"]: (r.changes, r.failures) for r in log.collect()} == {"full_name": (2, 0), "hire_date": (1, 1), "note": (1, 0)}
    pairs = [tuple(r) for r in cleanse.similar_values(spark.createDataFrame([("Ahmed",), ("Amed",), ("Zoe",)], "v string"), "v").collect()]
    assert cleanse.greedy_clusters(["Ahmed", "Amed", "Zoe"], pairs) == {"Ahmed": ["Amed"]}


def test_link(spark):
    rows = [(0, "ann lee", "a@x.com", "+971501234567"), (1, "Lee Ann", "a@x.com", "0501234567"), (2, "ann lee", "", ""), (3, "zed", "a@x.com", "")]
    p = link.prepared(spark.createDataFrame(rows, "row long, n string, e string, p string"), "row", "n", "e", "p")
    got = {(r.row_a, r.row_b): (r.probability, r.confidence) for r in link.dedup_within(p, 0.5).collect()}
    assert got[0, 1][1] == "high" and got[0, 1][0] > 0.999 and got[0, 3] == (0.55, "low") and got[0, 2] == (0.55, "low")
    one = spark.createDataFrame([(0, "", "a@x.com", "+971501234567"), (1, "", "a@x.com", "971501234567")], "row long, n string, e string, p string")
    assert link.dedup_within(link.prepared(one, "row", "n", "e", "p")).first().probability == 0.9994
    names = spark.createDataFrame([("Acme Trading LLC",)], "name string")
    assert link.best_party(names, spark.createDataFrame([("Acme Trading",), ("Zeta",)], "name string")).first().party == "Acme Trading"


def test_party_in_a_long_list(spark):
    """A typo in the first letters is found beside 300 parties as beside one."""
    names = spark.createDataFrame([("Kcme Trading",), ("Bluesky",)], "name string")
    parties = spark.createDataFrame([("Acme-Trading",), ("Blue Sky",), *[(f"Other {chr(97 + i % 26)}{i}",) for i in range(300)]], "name string")
    assert {r.name: r.party for r in link.best_party(names, parties).collect()} == {"Kcme Trading": "Acme-Trading", "Bluesky": "Blue Sky"}


def test_contacts_are_all_customers(spark):
    """No row of the linkage queries' input is left out, and its pairs are those of the first-character blocks."""
    from goldvein import queries

    folder = "/root/testdata/sf0.01"
    c = queries.contact_rows(spark, folder)
    assert c.count() == queries.table(spark, folder, "customer").count()
    some = c.filter("row % 201 < 4").cache()
    key = lambda df: sorted(map(tuple, df.collect()))
    for b, threshold, names, prune in ((None, 0.85, False, False), (None, 0.7, True, True), (some, 0.5, False, True), (None, 0.5, True, False)):
        blocks = link.scored(link.candidates(some, b, ["name", "email", "phone"], prune), threshold, names)
        got = link.scored(link.sharing(some, b, threshold, names, prune), threshold, names)
        assert key(got) == key(blocks) and got.count()


def test_fellegi_sunter(spark):
    rows = [(i, f"name{i % 40}", f"n{i % 40}@x.com", "AE" if i % 2 else "AE") for i in range(80)]
    df = spark.createDataFrame(rows, "row long, full_name string, email string, country string")
    pairs, groups = link.dedupe(df, "row", ["full_name", "email"], "country", 0.9)
    assert {(r.row_a, r.row_b) for r in pairs.collect()} >= {(i, i + 40) for i in range(40)}
    assert groups.select("component").distinct().count() <= 40


def test_crossfile(spark):
    a = spark.createDataFrame([(0, "INV-1000", "x"), (1, "INV-1001", ""), (2, "INV-1002", "y"), (3, "INV-1003", "y"), (4, "INV-1004", "y"), (5, "INV-1004", "z")], "i long, invoice_no string, note string")
    b = spark.createDataFrame([(0, "inv-1001 ", "full"), (1, "INV-2000", "q"), (2, "INV-3000", "q"), (3, "INV-4000", "q"), (4, "INV-5000", "q")], "i long, bill_ref string, note string")
    assert [r["column"] for r in crossfile.id_columns(a.drop("i")).collect()] == ["invoice_no"]
    found = crossfile.shared_columns({"a": a, "b": b}, {"a": ["invoice_no"], "b": ["bill_ref"]})
    assert [sorted(m) for m in found] == [[("a", "invoice_no"), ("b", "bill_ref")]]
    got = crossfile.clusters({"a": a, "b": b}, found[0], "i")
    assert {(r.dataset, r.row, r.keep) for r in got.collect()} == {("a", 1, False), ("b", 0, True)}
    left, gone = crossfile.archive(a, spark.createDataFrame([(1, "dup"), (99, "none")], "row long, reason string"), "i", "a")
    assert left.count() == 5 and json.loads(gone.first().row_data_json)["invoice_no"] == "INV-1001"
    assert [r.i for r in crossfile.renumber(left, "i").orderBy("i").collect()] == [0, 1, 2, 3, 4]
    groups = crossfile.column_groups({"a": a, "b": b}, {"a": ["invoice_no"], "b": ["bill_ref"]})
    assert crossfile.classify_groups(spark, groups).first().classification == "primary_key_match"


def test_content_hash(spark):
    df = spark.createDataFrame([("a", "1"), ("B ", "2")], "x string, y string")
    other = spark.createDataFrame([("2", "b"), ("1", "A")], "y string, x string")
    assert hashing.content_hash(df).first() == hashing.content_hash(other).first() and hashing.content_fingerprint(df).first() == hashing.content_fingerprint(other).first()
    assert hashing.content_hash(df.limit(0)).first()[0] is None


def test_classify(spark):
    df = spark.range(30).selectExpr("concat('C-', lpad(id, 5, '0')) as customer_id", "concat('n', id) as full_name", "concat('e', id, '@x.com') as email", "'Active' as status")
    assert classify.classify(df, "customers.csv") == ("Customers", 105) and classify.route(df, "x.csv") == ("Customers", "classifier")
    odd = spark.range(30).selectExpr("concat('G', id) as grant_no", "id as n", "id * 2 as m")
    board = classify.Onboarding()
    made, why = board.propose(odd, "research_grants.csv", 0.0)
    assert why == "created" and made.name == "ResearchGrants" and made.table == "master_research_grants"
    assert board.propose(odd, "again.csv", 1.0)[1] == "known signature" and board.propose(odd.limit(5).select("n", "m"), "few.csv", 1.0)[0] is None
    del entities.REGISTRY["ResearchGrants"]


def test_documents(spark):
    text = "Invoice No: INV-2024-00200,\nInvoice date: 2024-01-02\nDue date: 2024-02-02\nBill to: Acme LLC\nVendor: Zeta\nTotal: $1,250.00"
    r = documents.key_values(spark.createDataFrame([(1, text), (2, "customer: Id: C-00027"), (3, None)], "doc int, text string")).orderBy("doc").collect()
    assert (r[0].invoice_no, r[0].invoice_date, r[0].due_date, r[0].total, r[0].customer, r[0].vendor) == ("INV-2024-00200", "2024-01-02", "2024-02-02", "1,250.00", "Acme LLC", "Zeta")
    assert (r[1].customer_id, r[1].customer) == ("C-00027", None) and r[2].invoice_no is None


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    open(f"{p}/a.csv", "w").write('id,n\n1,\n2,"x,y"\n')
    open(f"{p}/b.tsv", "w").write("id\tn\n1\tq\n")
    open(f"{p}/l.csv", "wb").write("id,n\n1,é\n".encode("latin-1"))
    json.dump([{"a": {"b": 1, "c": [1, 2]}, "d": "x"}], open(f"{p}/c.json", "w"))
    with sqlite3.connect(f"{p}/d.db") as con:
        con.execute("create table t (a integer, b text)")
        con.executemany("insert into t values (?, ?)", [(i, None if i == 3 else f"v{i}") for i in range(10)])
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2"><v>1</v></c><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(f"{p}/e.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    read = lambda n: [tuple(r) for r in files.from_file(spark, f"{p}/{n}").collect()]
    assert read("a.csv") == [("1", ""), ("2", "x,y")] and read("b.tsv") == [("1", "q")] and read("l.csv") == [("1", "é")] and read("e.xlsx") == [(1, 2.5)]
    assert files.from_file(spark, f"{p}/c.json").columns == ["a.b", "a.c", "d"]
    got = connectors.from_sqlite(spark, f"{p}/d.db", "t", 3).collect()
    assert sorted(int(r.a) for r in got) == list(range(10)) and connectors.sqlite_tables(f"{p}/d.db") == ["t"]
    with pytest.raises(FileNotFoundError):
        files.from_file(spark, f"{p}/none.csv")
    open(f"{p}/x.doc", "w").close()
    with pytest.raises(ValueError):
        files.from_file(spark, f"{p}/x.doc")
    pages = lambda url, timeout=0: ("application/json", json.dumps({"data": [{"k": i} for i in range(7)][int(url.split("offset=")[1]):][:3]}).encode())
    assert [r.k for r in connectors.from_rest(spark, "http://h/x", 3, pages).collect()] == [str(i) for i in range(7)]
    assert files.listing(spark, p, "*.csv").count() == 2
    files.export(files.from_file(spark, f"{p}/a.csv"), f"{p}/out", "json")
    with pytest.raises(ValueError):
        files.export(spark.range(1), f"{p}/o", "xml")


def test_platform(spark, tmp_path):
    p = str(tmp_path)
    lines = "\n".join(f"C-{i:05d},ANN {i},u{i}@x.com,ACT" for i in range(30))
    open(f"{p}/customers.csv", "w").write("customer_id,full_name,email,status\n" + lines)
    open(f"{p}/copy.csv", "w").write("status,customer_id,full_name,email\n" + "\n".join(f"ACT,C-{i:05d},ANN {i},u{i}@x.com" for i in reversed(range(30))))
    open(f"{p}/poem.csv", "w").write("a\nroses are red\n")
    run = Platform(spark, f"file://{p}/lake", lambda: "2024-01-01T00:00:00Z")
    first = run.ingest_file(f"{p}/customers.csv")
    assert (first["target_entity"], first["rows_inserted"], first["action"]) == ("Customers", 30, "archive")
    assert run.read("master_customers").filter("status = 'Active' and full_name like 'Ann %'").count() == 30
    assert run.ingest_file(f"{p}/copy.csv")["status"] == "duplicate"
    assert run.ingest_file(f"{p}/poem.csv")["reason_category"] == "unrecognized_entity"
    again = run.ingest_file(f"{p}/customers.csv")
    assert (again["rows_inserted"], again["rows_duplicates_found"], again["dataset_id"]) == (0, 30, first["dataset_id"])
    assert run.catalog.versions(first["dataset_id"]).count() == 2
    run.catalog.point(first["dataset_id"], 1)
    assert run.catalog.get(first["dataset_id"])["current_version"] == 1 and run.analyze(first["dataset_id"])["summary"]["n"] == 30
    assert run.catalog.latest_analysis(first["dataset_id"])["summary"]["n_var"] == 4 and not run.remediate(first["dataset_id"])["changed"]
    assert run.catalog.table("openlineage_events").count() == 4 and run.catalog.table("ingestion_log").count() == 2
    assert {r.layer for r in files.layers(spark, f"{p}/lake/layers").collect()} == {"landing", "stg"}


def test_disposition(spark):
    rows = [("bad", "Customers", 1, 0, 0, 0), (None, None, 0, 0, 0, 0), (None, "X", 1, 0, 0, 5), (None, "X", 0, 0, 0, 5), (None, "X", 0, 0, 0, 0)]
    got = governance.disposition(spark.createDataFrame(rows, "parse_error string, target_entity string, rows_inserted long, rows_merged long, fields_enriched long, rows_rejected long"))
    assert [(r.action, r.reason_category) for r in got.collect()] == [("aside", "parse_error"), ("aside", "unrecognized_entity"), ("archive", None), ("aside", "all_rows_rejected"), ("aside", "no_data_extracted")]


def test_staging(spark):
    df = spark.createDataFrame([("1", "x", "y", "z")], "Cust_ID string, NAME string, full_name string, other string")
    got, why = staging.build(df, "landing_file_customers")
    assert why == "ok" and got.first().full_name == "y" and got.first()._validation == "ok" and staging.build(df, "landing_file_poems")[0] is None
