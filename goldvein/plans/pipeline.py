"""The platform as a function: acquire, gate, cleanse, register, land, route, ingest, dispose, per source file."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, cleanse, governance, hashing, link, master, normalize, profile, staging, validate
from ..sources import files, naming
from ..sources.store import Store
from . import entities


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def with_index(df: DataFrame, name: str = "_row_idx") -> DataFrame:
    """A row index 0..n-1 in file order, fixed once at the scan."""
    raw = df.withColumn("_at", F.monotonically_increasing_id())
    return normalize.numbered(raw, "_at", name).withColumn(name, F.col(name) - 1).drop("_at")


def fingerprint(df: DataFrame) -> str | None:
    """A digest of a table's contents whatever the order of its rows and columns; None without rows."""
    row = hashing.content_fingerprint(df).first()
    return None if df.isEmpty() else "|".join(map(str, row))


class Platform:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], str] = utc_now):
        self.spark, self.root, self.clock = spark, root, clock
        self.catalog = governance.Catalog(spark, f"{root}/catalog")
        self.store = Store(spark)
        self.schemas = validate.DynamicSchemas(catalog=self.catalog)
        self.onboarding = classify.Onboarding(catalog=self.catalog)
        self.hashes: dict[str, str] = {}

    # tables of the master layer: versioned folders and a pointer

    def read(self, table: str) -> DataFrame | None:
        rows = self.store.rows(f"{self.root}/pointers/{table}")
        return self.spark.read.parquet(rows[-1]["path"]) if rows else None

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Write a new snapshot beside the old ones, then a new pointer: readers see whole tables only."""
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.store.append(f"{self.root}/pointers/{table}", {"path": path})
        return self.spark.read.parquet(path)

    def load(self, path: str, source: str | None = None) -> tuple[str, DataFrame]:
        """Scan, cleanse, register and land one file: (dataset id, cleaned frame)."""
        name = source or os.path.basename(path)
        raw = files.from_file(self.spark, path)
        clean, _ = cleanse.remediate(raw)
        dataset_id, _ = self.catalog.register(clean, name, os.path.basename(path), naming.source_system(name), self.clock())
        data = self.catalog.load(dataset_id)
        files.to_landing(data, naming.landing_table(name), naming.source_system(name), f"{self.root}/layers")
        return dataset_id, data

    def ingest_file(self, path: str, source: str | None = None, dispose_to: str | None = None) -> dict:
        """The whole way of one file; the summary names what happened."""
        name = source or os.path.basename(path)
        out: dict = {"source": name, "target_entity": None, "parse_error": None}
        try:
            digest = fingerprint(files.from_file(self.spark, path))
            if digest and self.hashes.get(digest, name) != name:
                return out | {"status": "duplicate", "duplicate_of": self.hashes[digest]}
            dataset_id, data = self.load(path, name)
        except (RuntimeError, ValueError) as e:
            out |= {"status": "failed", "parse_error": str(e)}
        else:
            if digest:
                self.hashes.setdefault(digest, name)
            entity, how = classify.route(data, name)
            if entity is None:
                made, how = self.onboarding.propose(data, name, datetime.now(timezone.utc).timestamp())
                entity = made.name if made else None
            out |= {"dataset_id": dataset_id, "target_entity": entity, "routed_by": how}
            if entity:
                staged, _ = staging.build(data, naming.landing_table(name))
                if staged is not None:
                    staged.write.mode("overwrite").parquet(f"{self.root}/layers/{staging.table_name(naming.landing_table(name))}")
                out |= self.ingest(dataset_id, entity, naming.source_system(name))
                out["status"] = "ingested"
            else:
                out["status"] = "unrecognized"
        facts = [(out["parse_error"], out["target_entity"], out.get("rows_inserted", 0), out.get("rows_duplicates_found", 0), out.get("fields_enriched_total", 0), out.get("rows_rejected", 0) + out.get("rows_rejected_by_schema", 0))]
        done = governance.disposition(self.spark.createDataFrame(facts, "parse_error string, target_entity string, rows_inserted long, rows_merged long, fields_enriched long, rows_rejected long")).first()
        out |= {"action": done["action"], "reason_category": done["reason_category"]}
        if dispose_to:
            governance.move_file(self.spark, path, f"{dispose_to}/{done['action']}", self.catalog, done["reason_category"] or "", out["parse_error"] or "", self.clock())
        return out

    def ingest(self, dataset_id: str, entity_name: str, source_system: str) -> dict:
        """Load a registered dataset into its master table; counts, log and lineage."""
        entity, now = entities.REGISTRY[entity_name], self.clock()
        data = with_index(self.catalog.load(dataset_id))
        checks = entity.checks
        if entity_name not in entities.SCHEMAS:
            known = self.schemas.rows.get(entity_name)
            checks = validate.learned_checks(known["schema"]) if known and known["status"] != "learning" else []
            self.schemas.observe(entity_name, self.catalog.load(dataset_id))
        got = master.ingest(data, entity, dataset_id, source_system, "_row_idx", self.read(entity.table), self.read("master_record_sources"), checks=checks, now=F.lit(now))
        summary = got.summary.first().asDict()
        self.write(entity.table, got.master)
        self.write("master_record_sources", got.sources)
        rejected = self.read("master_rejections")
        self.write("master_rejections", got.rejected if rejected is None else rejected.unionByName(got.rejected))
        self.catalog.append("ingestion_log", {"dataset_id": dataset_id, "target_table": entity.table, "rows_inserted": summary["rows_inserted"], "rows_merged": summary["rows_duplicates_found"], "rows_rejected": summary["rows_rejected"], "ingested_at": now, "notes": json.dumps(summary)})
        run = self.spark.createDataFrame([(f"{dataset_id}@{now}", dataset_id, entity.table, source_system, summary["rows_inserted"], summary["rows_duplicates_found"], summary["rows_rejected"], now, now)], "run_id string, dataset_id string, target_table string, source_system string, rows_inserted long, rows_merged long, rows_rejected long, started_at string, ended_at string")
        for e in governance.lineage_events(run).collect():
            self.catalog.append("openlineage_events", e.asDict())
        return summary | {"missing_required": got.missing_required}

    def analyze(self, dataset_id: str) -> dict:
        """Profile, quality, schema and entity plan of a dataset, recorded in its history. Empty: ValueError."""
        df = self.catalog.load(dataset_id)
        if df.isEmpty():
            raise ValueError("empty dataset")
        report = {
            "summary": profile.dataset_summary(df).first().asDict(),
            "columns": [r.asDict() for r in profile.column_stats(df).collect()],
            "missing": [r.asDict() for r in profile.missing(df).collect()],
            "ddl": profile.create_table(df, dataset_id),
            "types": cleanse.detect_types(df),
            "entities": normalize.plan_entities(df),
            "quality": profile.quality(with_index(df), "_row_idx"),
            "intents": profile.intents(df),
            "enhancements": profile.enhancements(with_index(df), dataset_id, "_row_idx"),
        }
        version = self.catalog.get(dataset_id)["current_version"]
        analysis = f"{dataset_id}.a{len(self.catalog.rows('analyses')) + 1}"
        report["html"] = f"{self.root}/reports/{analysis}-{uuid.uuid4().hex[:8]}.html"
        self.store.write(report["html"], profile.html_report(f"Profile of {dataset_id}", {"Summary": [report["summary"]], "Columns": report["columns"], "Missing": report["missing"], "Outliers": report["quality"]["outliers"]}))
        self.catalog.append("analyses", {"analysis_id": analysis, "dataset_id": dataset_id, "version_number": version, "payload_json": json.dumps(report, default=str), "run_at": self.clock()})
        return report

    def remediate(self, dataset_id: str, types: dict[str, str] | None = None) -> dict:
        """Cleanse the current version; no change makes no new one."""
        df, old = self.catalog.load(dataset_id), self.catalog.get(dataset_id)
        clean, log = cleanse.remediate(df, types)
        rows = [r.asDict() for r in log.collect()]
        changes, failures = sum(r["changes"] for r in rows), sum(r["failures"] for r in rows)
        if not changes:
            return {"changed": False, "version": old["current_version"], "log": rows}
        _, version = self.catalog.register(clean, old["source"], old["filename"], old["source_system"], self.clock(), f"remediated {changes} values")
        self.catalog.append("remediations", {"remediation_id": f"{dataset_id}.r{version}", "dataset_id": dataset_id, "from_version": old["current_version"], "to_version": version, "change_log_json": json.dumps(rows), "total_changes": changes, "total_failures": failures, "applied_at": self.clock()})
        return {"changed": True, "version": version, "log": rows}

    def normalize(self, dataset_id: str, target) -> dict:
        """Split a dataset into its entities and bundle them as CSV in a ZIP at ``target``."""
        made = normalize.normalize_all({dataset_id: with_index(self.catalog.load(dataset_id))}, "_row_idx").get(dataset_id)
        if made is None:
            return {"materialized": False}
        folder = f"{self.root}/normalized/{dataset_id}-{uuid.uuid4().hex[:8]}"
        columns = normalize.export_tables(made[1], folder)
        normalize.bundle(self.store, folder, columns, target)
        return {"materialized": True, "tables": columns, "ddl": normalize.ddl(self.catalog.load(dataset_id), made[0], dataset_id)}

    def normalize_landings(self) -> list[str]:
        """Write the entities of every landing table as norm_ tables beside it; their names."""
        layers, out = f"{self.root}/layers", []
        tables = {n: with_index(self.spark.read.parquet(f"{layers}/{n}").drop("_landing_source_system", "_landing_ingested_at")) for n in self.store.names(layers) if n.startswith("landing_")}
        for name, (_, made) in normalize.normalize_all(tables, "_row_idx").items():
            for entity, df in made.items():
                out.append(f"norm_{name.removeprefix('landing_')}__{entity.lower()}")
                df.write.mode("overwrite").parquet(f"{layers}/{out[-1]}")
        return out

    def resolve(self, dataset_a: str, dataset_b: str | None = None, threshold: float = 0.7) -> DataFrame:
        """Matches across two datasets, or within one."""
        a = with_index(self.catalog.load(dataset_a))
        b = with_index(self.catalog.load(dataset_b)) if dataset_b else None
        return link.resolve_entities(a, b, "_row_idx", threshold)[0]

    def review(self, entity: str, threshold: float = 0.95) -> DataFrame:
        """Clusters of alike active rows in an entity's master table."""
        return link.fuzzy_duplicates(self.read(entities.REGISTRY[entity].table), entity, entities.REGISTRY[entity].key, threshold)
