"""Stores, suggestions, reports, exports, and what must outlive a process."""

import io
import json
import zipfile

import pytest

from goldvein.operators import classify, governance, link, normalize, profile, suggest, validate
from goldvein.plans import entities
from goldvein.sources import files
from goldvein.sources.store import Store


def test_store(spark, tmp_path):
    store, root = Store(spark), f"file://{tmp_path}/s"
    assert store.names(root) == [] and store.rows(root) == []
    for i in range(5):
        store.append(root, {"i": i})
    assert [r["i"] for r in store.rows(root)] == list(range(5))
    store.write(f"{root}/a.txt", "héllo" * 300_000)
    assert store.read(f"{root}/a.txt") == "héllo" * 300_000
    with pytest.raises(OSError):
        store.move(f"{root}/none", f"{root}/b")
    store.move(f"{root}/a.txt", f"{root}/b.txt")
    assert store.exists(f"{root}/b.txt") and not store.exists(f"{root}/a.txt")


def test_catalog_outlives_a_process(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    batch = spark.createDataFrame([(f"L-{i}", "open" if i % 2 else "won") for i in range(60)], "lead_id string, lead_status string")
    schemas = validate.DynamicSchemas(catalog=governance.Catalog(spark, root))
    assert schemas.observe("Leads", batch)["status"] == "learning" and schemas.observe("Leads", batch)["status"] == "established"
    again = validate.DynamicSchemas(catalog=governance.Catalog(spark, root))
    assert again.rows == schemas.rows and again.promote("Leads")
    assert validate.DynamicSchemas(catalog=governance.Catalog(spark, root)).rows["Leads"]["status"] == "curated"
    made, _ = classify.Onboarding(catalog=governance.Catalog(spark, root)).propose(batch.withColumn("x", batch.lead_id), "hot_leads.csv", 1.0)
    del entities.REGISTRY[made.name]
    later = classify.Onboarding(catalog=governance.Catalog(spark, root))
    assert entities.REGISTRY[made.name].key == made.key and later.propose(batch.withColumn("x", batch.lead_id), "other.csv", 2.0)[1] == "known signature"
    del entities.REGISTRY[made.name]


FIELDS = entities.REGISTRY["Customers"].columns


@pytest.mark.parametrize(("raw", "want"), [
    ('{"master_field": "email", "confidence": 0.9, "reason": "r"}', ("email", 0.9, "r")), ('{"master_field": "email"}', ("email", 0.7, "")), ('{"Mail": "email"}', ("email", 0.85, "")),
    ('{"target": "phone", "note": 1}', ("phone", 0.8, "")), ('{"master_field": "NONE", "confidence": 1}', None), ("It is the phone column.", ("phone", 0.7, "")), ("no idea", None), ('{"master_field": "salary"}', None),
])
def test_answers(raw, want):
    assert suggest.answered(raw, FIELDS) == want


def test_column_mapper(spark, tmp_path):
    catalog, asked = governance.Catalog(spark, f"file://{tmp_path}/c"), []

    def ask(prompt):
        asked.append(prompt)
        return json.dumps({"master_field": "phone" if "Handy" in prompt else "NONE", "confidence": 0.8})

    mapper = suggest.ColumnMapper(ask, catalog)
    assert mapper.suggest("Customers", "Handy", ["1"]) == ("phone", 0.8) and mapper.suggest("Customers", "handy", []) == ("phone", 0.8)
    assert mapper.suggest("Customers", "Colour", []) is None and mapper.suggest("Customers", "Colour", []) is None and mapper.suggest("Payments", "x", []) is None
    assert len(asked) == 2 and suggest.ColumnMapper(ask, catalog).suggest("Customers", "Handy", []) == ("phone", 0.8) and mapper.stats() == {"Customers": 2} and len(asked) == 2

    def broken(prompt):
        raise OSError("away")

    assert suggest.ColumnMapper(broken).suggest("Customers", "Handy", []) is None


def test_schema_notes(spark):
    df = spark.createDataFrame([(1, "a")], "i long, s string")
    assert suggest.schema_notes(df, "t", lambda p: 'Sure: {"notes": "n"} bye') == {"notes": "n"}
    assert suggest.schema_notes(df, "t", lambda p: "none") == {"raw": "none"}


def test_whole_file_decides_the_encoding(spark, tmp_path):
    body = "".join(f"{i},plain text to fill the file\n" for i in range(60_000))
    (tmp_path / "late.csv").write_bytes(b"i,t\n" + body.encode() + b"60000,caf\xe9\n")
    got = files.from_file(spark, f"{tmp_path}/late.csv")
    assert got.count() == 60_001 and got.filter("t = 'café'").count() == 1
    (tmp_path / "utf.csv").write_text("i,t\n1,café\n2,\"two\nlines, \"\"q\"\"\"\n3,\n", encoding="utf-8")
    assert [tuple(r) for r in files.from_file(spark, f"file://{tmp_path}/utf.csv").collect()] == [("1", "café"), ("2", 'two\nlines, "q"'), ("3", "")]


def test_export_round_trip(spark, tmp_path):
    rows = [(" lead", 'a "q" \\ b'), ("x\ny", "é"), ("", "trail ")]
    files.export(spark.createDataFrame(rows, "a string, b string"), f"file://{tmp_path}/x.csv", "csv")
    assert sorted(tuple(r) for r in files.from_file(spark, f"file://{tmp_path}/x.csv").collect()) == sorted(rows)


def test_normalized_bundle(spark, tmp_path):
    rows = [(i, f"city{i % 4}", f"country{i % 2}", f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "_row_idx long, city string, country string, note string")
    made = normalize.normalize_all({"t": df, "plain": df.select("_row_idx", "note")}, "_row_idx")
    assert list(made) == ["t"]
    columns = normalize.export_tables(made["t"][1], f"file://{tmp_path}/n")
    out = io.BytesIO()
    normalize.bundle(Store(spark), f"file://{tmp_path}/n", columns, out)
    with zipfile.ZipFile(out) as z:
        assert sorted(z.namelist()) == sorted(f"{n}.csv" for n in columns)
        fact = z.read("t_fact.csv").decode().splitlines()
    assert len(fact) == 61 and "note" in fact[0]


def test_to_masters(spark):
    df = spark.createDataFrame([(i, f"E-{i}", f"name {i}") for i in range(6)] + [(9, "", "blank")], "_row_idx long, employee_id string, full_name string")
    masters = normalize.to_masters(df, "file_x", "_row_idx", {})
    more = normalize.to_masters(spark.createDataFrame([(1, "E-5", "other", "x"), (2, "E-7", "new", "y")], "_row_idx long, employee_id string, full_name string, extra string"), "file_x", "_row_idx", masters)
    got = {r.employee_id: (r.full_name, r.extra) for r in more["master_employees"].collect()}
    assert len(got) == 7 and got["E-5"] == ("name 5", None) and got["E-7"] == ("new", "y")


def test_identity_columns():
    assert link.identity_columns(["email_opt_out", "Work_Mail", "contact_email", "tel", "full_name"]) == {"email": "Work_Mail", "name": "full_name", "phone": "tel"}
    assert link.identity_columns(["username", "filename", "company_name"]) == {}


def test_resolve_needs_a_common_column(spark):
    a, b = spark.createDataFrame([(1, "x")], "i long, email string"), spark.createDataFrame([(1, "x")], "i long, phone string")
    with pytest.raises(ValueError):
        link.resolve_entities(a, b, "i")


def test_quality_and_report(spark):
    rows = [(i, f"Ann Lee {i}", f"ann.lee{i}@x.com" if i % 5 else "zq@x.com", float(i if i < 59 else 9_999), "1" if i % 9 else "n/a") for i in range(60)]
    got = profile.quality(spark.createDataFrame(rows, "_row_idx long, full_name string, email string, amount double, mixed string"), "_row_idx")
    assert got["consistency"] == {"high": 12} or sum(got["consistency"].values()) == 12
    assert [r["column"] for r in got["mixed_types"]] == ["mixed"] and [r["outliers"] for r in got["outliers"]] == [1] and got["fuzzy_duplicates"] > 0
    page = profile.html_report("a <b>", {"h": [{"x": 1}, {"y": "<i>"}], "none": []})
    assert "a &lt;b&gt;" in page and "&lt;i&gt;" in page and "<th>x</th><th>y</th>" in page
