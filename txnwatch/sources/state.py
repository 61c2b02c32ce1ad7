"""Tables that change by whole partitions, all in one step (A11, A17, A18, I3 as stored results).

A state is a folder of tables. Every table is kept by a partition column: transactions and customers by upload, alerts
and what belongs to them by run. A commit writes new Parquet folders next to the old ones and then one small
manifest file that names, per table, the folders that count from now on. Readers follow the newest manifest, so
they see all of a commit or nothing of it: a write that is lost half-way leaves folders that nobody reads. Dropping an
upload or a run writes no data at all. One writer at a time: of two commits with one version, the second fails.

A manifest has one row per table and partition, so it grows with uploads and runs, not with rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.operators.lifecycle import cleanup, expired
from txnwatch.operators.skew import list_join
from txnwatch.sources.datasets import last_wins

# How tables are kept; others are kept whole.
KEPT_BY = {
    "transactions": "upload_id", "customers": "upload_id",
    "alerts": "run_id", "alert_transactions": "run_id", "alert_exclusion_logs": "run_id", "runs": "run_id",
}
RUN_TABLES = ("alerts", "alert_transactions", "alert_exclusion_logs")
MANIFEST = "commit string, table string, part string, path string, schema string"
HISTORY = "manifests"
NULL_PART = "__HIVE_DEFAULT_PARTITION__"


class ConflictError(RuntimeError):
    """Another commit took the same version; nothing of this one counts."""


@dataclass(frozen=True)
class Manifest:
    """What counts at one version: per table its schema, and the folders of its partitions (None for a null key)."""

    version: int = 0
    schemas: Mapping[str, T.StructType] = field(default_factory=dict)
    parts: Mapping[str, Mapping[str | None, tuple[str, ...]]] = field(default_factory=dict)


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a ``version``; version 0 is the empty state."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, version long").json(f"{folder}/{HISTORY}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return Manifest()
    newest = rows.agg(F.max("version")).first()[0] if version is None else version
    if not newest:
        return Manifest()
    entries = rows.filter(F.col("version") == newest).collect()
    # Of commits that met, the one with the smallest id counts for every reader.
    first = min(r.commit for r in entries)
    schemas, parts = {}, {}
    for r in entries:
        if r.commit != first:
            continue
        if r.schema is not None:
            schemas[r.table] = T.StructType.fromJson(json.loads(r.schema))
            parts.setdefault(r.table, {})
        else:
            held = parts.setdefault(r.table, {})
            held[r.part] = (*held.get(r.part, ()), r.path)
    return Manifest(newest, schemas, parts)


def read_table(spark: SparkSession, folder: str, table: str, only: Iterable[str] | None = None, at: Manifest | None = None) -> DataFrame:
    """A table as of the newest manifest (or ``at``); ``only`` reads the named partitions and no other folder."""
    at = at or manifest(spark, folder)
    if table not in at.schemas:
        raise KeyError(f"no table {table!r} in {folder}")
    held = at.parts[table]
    chosen = held if only is None else {k: v for k, v in held.items() if k in {o or None for o in only}}
    paths = [f"{folder}/{p}" for some in chosen.values() for p in some]
    schema = at.schemas[table]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(df: DataFrame, folder: str, table: str, commit: str) -> dict[str | None, tuple[str, ...]]:
    """Write one table's new rows; the folder of each partition that has rows."""
    place = f"{table}/{commit}"
    key = KEPT_BY.get(table)
    if key is None or key not in df.columns:
        df.write.parquet(f"{folder}/{place}")
        return {"": (place,)}
    df.withColumn("_part", F.col(key).cast("string")).write.partitionBy("_part").parquet(f"{folder}/{place}")
    spark = df.sparkSession
    try:
        files = spark.read.schema(df.schema).parquet(f"{folder}/{place}").select(F.col("_metadata.file_path").alias("p"))
    except AnalysisException:
        return {}
    names = files.select(F.regexp_extract("p", r"/_part=([^/]*)/[^/]*$", 1).alias("d")).distinct().collect()
    found: dict[str | None, tuple[str, ...]] = {}
    for name in (r.d for r in names if r.d):
        # The path comes back percent-encoded over Spark's own escapes of the folder name.
        inner = unquote(name)
        value = None if inner == NULL_PART else unquote(inner)
        found[value] = (f"{place}/_part={inner}",)
    return found


def commit(
    spark: SparkSession,
    folder: str,
    tables: Mapping[str, DataFrame],
    replaced: Mapping[str, Collection[str | None] | None],
    base: Manifest | None = None,
) -> Manifest:
    """One step: the partitions named in ``replaced`` go (None: the whole table), the rows of ``tables`` come.

    A partition that ``tables`` brings replaces the old one too; a replaced partition without new rows is gone afterwards.
    ``base`` is the manifest from which the new rows were computed; if a later one exists, the commit fails.
    """
    newest = manifest(spark, folder)
    base = base or newest
    if newest.version != base.version:
        raise ConflictError(f"version {base.version} was read, but {newest.version} exists")
    name = uuid.uuid4().hex
    written = {table: _write(df, folder, table, name) for table, df in tables.items()}
    schemas = {**base.schemas, **{table: df.schema for table, df in tables.items()}}
    rows: list[tuple[Any, ...]] = []
    for table, schema in schemas.items():
        gone = replaced.get(table, ())
        # Spark writes an empty partition value like a null one.
        old = {} if gone is None else {k: v for k, v in base.parts.get(table, {}).items() if k not in {g or None for g in gone}}
        parts = {**old, **written.get(table, {})}
        rows.append((name, table, None, None, json.dumps(schema.jsonValue())))
        rows += [(name, table, part, path, None) for part, paths in parts.items() for path in paths]
    version = base.version + 1
    # One file: Spark moves it into place as the last act of the write, and only then the commit counts.
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/{HISTORY}/version={version}")
    done = spark.read.schema(MANIFEST).json(f"{folder}/{HISTORY}/version={version}").agg(F.min("commit")).first()[0]
    if done != name:
        raise ConflictError(f"version {version} was taken by another commit")
    return manifest(spark, folder, version)


def write_run(tables: Mapping[str, DataFrame], folder: str, run_id: str) -> Manifest:
    """Alerts, links and logs of one run, all at once.

    The run is replaced as a whole: a table that has no rows now, or is not there at all, keeps none of the run's.
    Rows with a ``run_id`` of their own replace those runs as well.
    """
    spark = SparkSession.active()
    named = {name: df if "run_id" in df.columns else df.withColumn("run_id", F.lit(run_id)) for name, df in tables.items()}
    return commit(spark, folder, named, {name: {run_id} for name in {*RUN_TABLES, *named}})


def runs_of(spark: SparkSession, folder: str, uploads: Collection[str], at: Manifest) -> set[str]:
    """Runs over any of the uploads."""
    if "runs" not in at.schemas:
        return set()
    runs = read_table(spark, folder, "runs", at=at)
    return {r.run_id for r in runs.filter(F.col("upload_id").isin(list(uploads))).select("run_id").distinct().collect()}


def drop_upload(spark: SparkSession, folder: str, upload_id: str, keep: Collection[str] = ()) -> Manifest:
    """An upload and everything derived from it disappear in one step. No row is read or written, only its
    partitions are named no more. Tables in ``keep`` stay as they are."""
    at = manifest(spark, folder)
    runs = runs_of(spark, folder, [upload_id], at)
    gone = {table: ({upload_id} if KEPT_BY.get(table) == "upload_id" else runs) for table in at.schemas if table in KEPT_BY and table not in keep}
    tables = {}
    if "uploads" in at.schemas and "uploads" not in keep:
        tables["uploads"] = read_table(spark, folder, "uploads", at=at).filter(~F.col("upload_id").eqNullSafe(F.lit(upload_id)))
        gone["uploads"] = None
    return commit(spark, folder, tables, gone, at)


def put_upload(spark: SparkSession, folder: str, upload_id: str, tables: Mapping[str, DataFrame], keep: Collection[str] = ("customers",)) -> Manifest:
    """The rows of an upload exchanged for new ones; runs over the old rows go with them.

    ``tables`` holds transactions, customers or both; tables in ``keep`` without new rows stay.
    """
    at = manifest(spark, folder)
    runs = runs_of(spark, folder, [upload_id], at)
    fresh = {name: df.withColumn("upload_id", F.lit(upload_id)) for name, df in tables.items()}
    gone = {}
    for table in {*at.schemas, *fresh} & KEPT_BY.keys():
        if table in fresh or table not in keep:
            gone[table] = {upload_id} if KEPT_BY[table] == "upload_id" else runs
    return commit(spark, folder, fresh, gone, at)


def upsert_rows(spark: SparkSession, folder: str, table: str, incoming: DataFrame, keys: Collection[str], sequence: str) -> Manifest:
    """A batch of rows replaces those with equal keys; only partitions that hold such keys are written again.

    The keys of the batch are looked up with the key columns alone, and each row stays in the partition where it
    is; new keys go where their partition column says. Of equal keys in the batch the last by ``sequence`` counts.
    """
    at, key = manifest(spark, folder), KEPT_BY[table]
    batch = last_wins(incoming, list(keys), sequence)
    if table not in at.schemas:
        return commit(spark, folder, {table: batch}, {}, at)
    old = read_table(spark, folder, table, at=at)
    hit = list_join(old.select(*keys, key), batch.select(*keys).distinct(), list(keys)).select(F.col(key).cast("string").alias("p")).distinct()
    touched = {r.p for r in hit.union(batch.select(F.col(key).cast("string"))).distinct().collect()}
    kept = list_join(read_table(spark, folder, table, touched, at), batch.select(*keys), list(keys), "left_anti")
    return commit(spark, folder, {table: kept.unionByName(batch, allowMissingColumns=True)}, {table: touched}, at)


def apply_cleanup(spark: SparkSession, folder: str, now: Any) -> Manifest:
    """Expired uploads lose their transactions and customers, their customers' alerts the names, in one step.

    Transactions and customers are dropped by partition. Only runs that have alerts of affected customers are written again.
    """
    at = manifest(spark, folder)
    read = lambda name, only=None: read_table(spark, folder, name, only, at)
    uploads = read("uploads")
    gone = {r.upload_id for r in expired(uploads, now).select("upload_id").distinct().collect()}
    if not gone:
        return at
    leaving = read("customers", gone)
    people = leaving.select("customer_id").distinct()
    hit = list_join(read("alerts").select("customer_id", "run_id"), people, ["customer_id"])
    runs = {r.run_id for r in hit.select("run_id").distinct().collect()}
    alerts = read("alerts", runs)
    known = F.col("is_anonymized") if "is_anonymized" in alerts.columns else F.lit(None)
    alerts = alerts.withColumn("is_anonymized", F.coalesce(known.cast("boolean"), F.lit(False)))
    following = cleanup(uploads, read("transactions", gone), leaving, alerts, now)
    tables = {"uploads": following["uploads"]}
    dropped: dict[str, Collection[str | None] | None] = {"uploads": None, "transactions": gone, "customers": gone}
    if runs:
        tables["alerts"], dropped["alerts"] = following["alerts"], runs
    return commit(spark, folder, tables, dropped, at)


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Delete folders that none of the last ``keep`` manifests names, and older manifests. Run it while nobody writes."""
    newest = manifest(spark, folder)
    if not newest.version:
        return 0
    versions = range(max(1, newest.version - keep + 1), newest.version + 1)
    used: set[str] = set()
    for version in versions:
        for parts in manifest(spark, folder, version).parts.values():
            used |= {"/".join(p.split("/")[:2]) for paths in parts.values() for p in paths}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = 0
    for table in newest.schemas:
        if not files.exists(path(f"{folder}/{table}")):
            continue
        for item in files.listStatus(path(f"{folder}/{table}")):
            name = item.getPath().getName()
            if f"{table}/{name}" not in used:
                removed += bool(files.delete(item.getPath(), True))
    for version in range(1, versions[0]):
        files.delete(path(f"{folder}/{HISTORY}/version={version}"), True)
    return removed
