"""Dataset catalogue, versions, logs, lineage events, file disposition. Tables are appended; the latest row of a key wins."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import Store

SCHEMAS = {
    "datasets": "dataset_id string, source string, filename string, rows long, columns long, loaded_at string, current_version long, raw_path string, source_system string, deleted boolean",
    "dataset_versions": "version_id string, dataset_id string, version_number long, path string, change_summary string, created_at string",
    "analyses": "analysis_id string, dataset_id string, version_number long, payload_json string, run_at string",
    "remediations": "remediation_id string, dataset_id string, from_version long, to_version long, change_log_json string, total_changes long, total_failures long, applied_at string",
    "archived_rows": "dataset_id string, original_row_index long, row_data_json string, reason string, archived_at string",
    "ingestion_log": "dataset_id string, target_table string, rows_inserted long, rows_merged long, rows_rejected long, ingested_at string, notes string",
    "openlineage_events": "event_id string, event_type string, event_time string, run_id string, job_name string, payload string",
    "file_quarantine": "original_path string, aside_path string, reason_category string, reason_details string, moved_at string",
    "match_decisions": "entity string, pair_a string, pair_b string, probability double, decision string, decided_at string",
    "dynamic_schemas": "entity string, status string, row_count_observed long, schema_json string",
    "auto_entities": "entity string, table string, key string, fields_json string, signature string, at double",
    "column_mappings": "entity string, source_column string, samples string, field string, confidence double, reason string",
}


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


class Catalog:
    """Small metadata tables under a folder of any store, each row one JSON file; data stays in Parquet version folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root, Store(spark)
        self.store.make_folder(root)

    def append(self, table: str, row: dict) -> None:
        self.store.append(f"{self.root}/{table}", row)

    def rows(self, table: str) -> list[dict]:
        return [r | {"_seq": i} for i, r in enumerate(self.store.rows(f"{self.root}/{table}"))]

    def table(self, table: str) -> DataFrame:
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) + (r["_seq"],) for r in self.rows(table)], SCHEMAS[table] + ", _seq long")

    # datasets and versions

    def get(self, dataset_id: str) -> dict | None:
        found = [r for r in self.rows("datasets") if r["dataset_id"] == dataset_id]
        return found[-1] if found and not found[-1].get("deleted") else None

    def datasets(self) -> DataFrame:
        return latest(self.table("datasets"), ["dataset_id"], [F.desc("_seq")]).filter("not coalesce(deleted, false)").drop("deleted")

    def register(self, df: DataFrame, source: str, filename: str, source_system: str, now: str, summary: str = "loaded") -> tuple[str, int]:
        """Write ``df`` as the next version. The same source and system keep their id."""
        old = next((r for r in reversed(self.rows("datasets")) if r["source"] == source and r["source_system"] == source_system and not r.get("deleted")), None)
        dataset_id = old["dataset_id"] if old else f"ds_{len({r['dataset_id'] for r in self.rows('datasets')}) + 1:06d}"
        version = max([v["version_number"] for v in self.rows("dataset_versions") if v["dataset_id"] == dataset_id], default=0) + 1
        path = f"{self.root}/data/{dataset_id}/v{version}"
        df.write.mode("overwrite").parquet(path)
        n = self.spark.read.parquet(path).count()
        self.append("dataset_versions", {"version_id": f"{dataset_id}.v{version}", "dataset_id": dataset_id, "version_number": version, "path": path, "change_summary": summary, "created_at": now})
        self.append("datasets", {"dataset_id": dataset_id, "source": source, "filename": filename, "rows": n, "columns": len(df.columns), "loaded_at": now, "current_version": version, "raw_path": path, "source_system": source_system, "deleted": False})
        return dataset_id, version

    def point(self, dataset_id: str, version: int) -> None:
        """Make an existing version current (rollback); else ValueError."""
        v = next((r for r in self.rows("dataset_versions") if r["dataset_id"] == dataset_id and r["version_number"] == version), None)
        if not v or not self.get(dataset_id):
            raise ValueError(f"no version {version} of {dataset_id}")
        self.append("datasets", self.get(dataset_id) | {"current_version": version, "raw_path": v["path"]})

    def delete(self, dataset_id: str) -> bool:
        old = self.get(dataset_id)
        if old:
            self.append("datasets", old | {"deleted": True})
        return bool(old)

    def load(self, dataset_id: str) -> DataFrame:
        row = self.get(dataset_id)
        if row is None:
            raise KeyError(dataset_id)
        return self.spark.read.parquet(next(v["path"] for v in self.rows("dataset_versions") if v["dataset_id"] == dataset_id and v["version_number"] == row["current_version"]))

    def versions(self, dataset_id: str) -> DataFrame:
        return self.table("dataset_versions").filter(F.col("dataset_id") == dataset_id).orderBy(F.desc("version_number")).drop("_seq")

    def history(self, table: str, dataset_id: str) -> DataFrame:
        """analyses, remediations or archived_rows of a dataset, newest first."""
        return self.table(table).filter(F.col("dataset_id") == dataset_id).orderBy(F.desc("_seq")).drop("_seq")

    def latest_analysis(self, dataset_id: str) -> dict | None:
        found = [r for r in self.rows("analyses") if r["dataset_id"] == dataset_id]
        return json.loads(found[-1]["payload_json"]) if found else None

    def reset(self) -> None:
        self.store.delete(self.root)
        self.store.make_folder(self.root)


def current_paths(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """dataset_id, path of each current version."""
    return datasets.select("dataset_id", F.col("current_version").alias("version_number")).join(versions, ["dataset_id", "version_number"]).select("dataset_id", "path")


def log_with_datasets(log: DataFrame, datasets: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """The newest log rows with their datasets' names; logs of unknown datasets stay."""
    return log.join(datasets, "dataset_id", "left").orderBy(*order).limit(most)


def lineage_events(runs: DataFrame) -> DataFrame:
    """START and COMPLETE events (event_id, event_type, event_time, run_id, job_name, payload) of ingest runs with
    run_id, dataset_id, target_table, source_system, rows_inserted, rows_merged, rows_rejected, started_at, ended_at."""
    both = runs.select("*", F.explode(F.array(F.lit("START"), F.lit("COMPLETE"))).alias("event_type"))
    when = F.when(F.col("event_type") == "START", F.col("started_at")).otherwise(F.col("ended_at"))
    job = F.concat(F.lit("ingest."), "target_table")
    dataset = lambda space, name: F.array(F.struct(F.lit(space).alias("namespace"), name.alias("name")))
    payload = F.to_json(
        F.struct(
            F.col("event_type").alias("eventType"), when.alias("eventTime"), F.struct(F.col("run_id").alias("runId")).alias("run"), F.struct(F.lit("goldvein").alias("namespace"), job.alias("name")).alias("job"),
            dataset("source", F.col("dataset_id")).alias("inputs"), dataset("master", F.col("target_table")).alias("outputs"),
            F.when(F.col("event_type") == "COMPLETE", F.struct("rows_inserted", "rows_merged", "rows_rejected")).alias("counts"),
        )
    )
    return both.select(F.concat_ws(":", "run_id", F.lower("event_type")).alias("event_id"), "event_type", when.alias("event_time"), "run_id", job.alias("job_name"), payload.alias("payload"))


def newest_events(events: DataFrame, most: int = 200) -> DataFrame:
    """The events to export: the newest ``most``, ties by id."""
    return events.orderBy(F.desc("event_time"), "event_id").limit(most)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"))


def disposition(df: DataFrame) -> DataFrame:
    """``df`` (parse_error, target_entity, rows_inserted, rows_merged, fields_enriched, rows_rejected) with action and
    reason_category: archive what reached the master, set the rest aside."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    landed = (n("rows_inserted") > 0) | (n("rows_merged") > 0) | (n("fields_enriched") > 0)
    reason = (
        F.when(F.coalesce(F.col("parse_error"), F.lit("")) != "", "parse_error").when(F.col("target_entity").isNull(), "unrecognized_entity")
        .when(landed, F.lit(None)).when(n("rows_rejected") > 0, "all_rows_rejected").otherwise("no_data_extracted")
    )
    return df.withColumn("reason_category", reason).withColumn("action", F.when(F.col("reason_category").isNull(), "archive").otherwise("aside"))


def move_file(spark: SparkSession, path: str, folder: str, catalog: Catalog | None = None, category: str = "", details: str = "", now: str = "") -> str:
    """Move a file into ``folder`` under a free name; logged as quarantined if a category is given."""
    store = Store(spark)
    store.make_folder(folder)
    stem, ext = os.path.splitext(os.path.basename(path))
    target, n = f"{folder}/{stem}{ext}", 0
    while store.exists(target):
        n += 1
        target = f"{folder}/{stem}_{n}{ext}"
    store.move(path, target)
    if catalog and category:
        catalog.append("file_quarantine", {"original_path": path, "aside_path": target, "reason_category": category, "reason_details": details, "moved_at": now})
    return target


def aside_files(files: DataFrame, quarantine: DataFrame, most: int = 200) -> DataFrame:
    """Files in the aside folder with the reason they were put there, if logged."""
    q = latest(quarantine, ["aside_path"], [F.desc("moved_at")]).select(F.col("aside_path").alias("path"), "reason_category", "reason_details", "moved_at")
    return files.join(q, "path", "left").orderBy(F.desc_nulls_last("moved_at"), "path").limit(most)
