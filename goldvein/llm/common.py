"""Plumbing that the operators share: the shared work folder, written tables, files, worker caches."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES, BATCH_ROWS = 8 << 20, 4_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset, local sessions (tests) get one of our
    own; a cluster's machines share none, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset")
        folder = "file://" + tempfile.mkdtemp(prefix="goldvein-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded(spark: SparkSession) -> SparkSession:
    """``spark`` with Arrow batches to and from Python bounded by bytes, not only by rows: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def own_folder(spark: SparkSession) -> str:
    """What this application writes aside, of which results still read until ``release``."""
    return f"{work_dir(spark)}/goldvein-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables and files written aside by this application; results not yet stored elsewhere go with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and nothing is computed twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrowed(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, which holds no more than ``source`` does, in no more partitions than ``source`` is read in, without a
    shuffle. Each partition becomes a file, and a local file starts processes (Hadoop's ``chmod``)."""
    return df.coalesce(max(1, source.rdd.getNumPartitions()))


def file_system(uri: str):
    """(pyarrow file system, path) of a folder or file in the shared store (file, hdfs, s3 ... by scheme)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, blob_writer) -> None:
    """Write a file under another name, then move it: a task that is run again leaves one whole file."""
    store, path = file_system(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        blob_writer(out)
    store.move(part, path)


def worker_cache(name: str, make):
    """A value kept in the Python worker until another name is asked for: one operator's caches at a time."""
    held = sys.__dict__.setdefault("_goldvein_held", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that columns beside them (whatever their names) can't clash with ours."""
    return df.select(*[df[f"`{c}`"] for c in columns])
