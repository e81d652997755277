"""A bucketed table with a manifest: upserts rewrite the buckets they touch and nothing else.

A table is a folder: `data/` holds Parquet files of one bucket each, `manifest/` one small JSON file a version that names
the files of every bucket. Writers add files under new names, then put the next manifest in place by one rename that fails
if that version exists. Readers take the latest manifest, so they see the table before or after an upsert, whatever step a
crash falls between; files that no manifest names are left for `vacuum`. Buckets and their file names are what the driver
handles; their number is a parameter of the table.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.incremental import upsert_keep_last


class Conflict(RuntimeError):
    """Another writer has put this version in place."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _listed(spark: SparkSession, path: str) -> list:
    fs, hadoop = _fs(spark, path)
    return list(fs.listStatus(hadoop.Path(path))) if fs.exists(hadoop.Path(path)) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = (s.getPath().getName() for s in _listed(spark, f"{path}/manifest"))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The latest manifest, or that of a version: version, keys, order, buckets, schema, files by bucket, batches by
    writer."""
    have = _versions(spark, path)
    if not have or version is not None and version not in have:
        raise FileNotFoundError(f"{path} has no version {version if version is not None else ''}")
    at = have[-1] if version is None else version
    fs, hadoop = _fs(spark, path)
    stream = fs.open(hadoop.Path(f"{path}/manifest/{at:020d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, content: dict) -> None:
    """Puts a manifest in place under its version, if that doesn't exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path}/manifest/{content['version']:020d}.json")
    draft = hadoop.Path(f"{path}/manifest/.{uuid.uuid4().hex}")
    fs, _ = _fs(spark, path)
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.NONE.getClass(), 1)
    option[0] = hadoop.Options.Rename.NONE
    try:
        context.rename(draft, target, option)
    except Exception as failed:
        fs.delete(draft, False)
        if "exist" in str(failed).lower():
            raise Conflict(f"version {content['version']} of {path} exists") from failed
        raise


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def create(spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64, order: list[str] | None = None) -> None:
    """An empty table. Of several rows of a key in one batch, the largest by the order columns counts (or by all others)."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    empty = {"version": 0, "keys": keys, "order": order, "buckets": buckets, "schema": schema.jsonValue(), "files": {}, "batches": {}}
    fs, hadoop = _fs(spark, path)
    fs.mkdirs(hadoop.Path(f"{path}/manifest"))
    _put(spark, path, empty)


def _rows(spark: SparkSession, path: str, m: dict, buckets=None) -> DataFrame:
    schema = StructType.fromJson(m["schema"])
    files = [f"{path}/data/{f}" for b, names in m["files"].items() if buckets is None or int(b) in buckets for f in names]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the latest version, or of an earlier one that wasn't expired."""
    return _rows(spark, path, manifest(spark, path, version))


def _write(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, list[str]]:
    """Writes rows, dealt by bucket and sorted by key, under a new name; the files by bucket."""
    name = uuid.uuid4().hex
    parts = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("bucket", _bucket(keys, buckets)).repartition(parts, "bucket").sortWithinPartitions("bucket", *keys)
    dealt.write.partitionBy("bucket").parquet(f"{path}/data/{name}")
    out: dict[str, list[str]] = {}
    for folder in _listed(spark, f"{path}/data/{name}"):
        b = folder.getPath().getName()
        if b.startswith("bucket="):
            files = (s.getPath().getName() for s in _listed(spark, f"{path}/data/{name}/{b}"))
            out[b[7:]] = sorted(f"{name}/{b}/{f}" for f in files if f.endswith(".parquet"))
    return out


def upsert(spark: SparkSession, path: str, new: DataFrame, writer: str | None = None, batch: int | None = None) -> dict:
    """Adds new's rows, which replace those of their keys; returns what it did: version, touched (buckets), read and
    written (files). Only files of buckets that new has keys of are read and written again. A batch that its writer has
    put in place before is left out, so reruns are safe. Raises Conflict if another writer was faster; the table is then
    that writer's, and the call can be repeated."""
    m = manifest(spark, path)
    if writer is not None and batch is not None and batch <= m["batches"].get(writer, -1):
        return {"version": m["version"], "touched": [], "read": 0, "written": 0}
    keys, buckets = m["keys"], m["buckets"]
    names = StructType.fromJson(m["schema"]).fieldNames()
    new = new.select(*names)
    touched = sorted(r.bucket for r in new.select(_bucket(keys, buckets)).distinct().collect())
    old_files = [f for b in touched for f in m["files"].get(str(b), [])]
    files = dict(m["files"])
    if touched:
        merged = upsert_keep_last(_rows(spark, path, m, set(touched)), new, keys, m["order"])
        files |= _write(spark, path, merged, keys, buckets)
    batches = m["batches"] | ({writer: batch} if writer is not None and batch is not None else {})
    _put(spark, path, m | {"version": m["version"] + 1, "files": files, "batches": batches})
    written = sum(len(files.get(str(b), [])) for b in touched)
    return {"version": m["version"] + 1, "touched": touched, "read": len(old_files), "written": written}


def rebucket(spark: SparkSession, path: str, buckets: int) -> None:
    """The table in another number of buckets: one version more, all rows written anew."""
    m = manifest(spark, path)
    files = _write(spark, path, _rows(spark, path, m), m["keys"], buckets)
    _put(spark, path, m | {"version": m["version"] + 1, "buckets": buckets, "files": files})


def vacuum(spark: SparkSession, path: str, keep: int = 1, older_than: float = 24 * 3600) -> int:
    """Deletes all manifests but the last `keep`, then files that none of those names; returns the files deleted. Folders
    written within the last older_than seconds stay: an upsert may be about to name them."""
    fs, hadoop = _fs(spark, path)
    have = _versions(spark, path)
    kept = have[-keep:]
    named = {f for v in kept for names in manifest(spark, path, v)["files"].values() for f in names}
    for v in have[:-keep]:
        fs.delete(hadoop.Path(f"{path}/manifest/{v:020d}.json"), False)
    gone = 0
    for folder in _listed(spark, f"{path}/data"):
        if folder.getModificationTime() / 1000 > time.time() - older_than:
            continue
        name, live = folder.getPath().getName(), 0
        for part in _listed(spark, f"{path}/data/{name}"):
            b = part.getPath().getName()
            for f in _listed(spark, f"{path}/data/{name}/{b}") if b.startswith("bucket=") else ():
                own = f"{name}/{b}/{f.getPath().getName()}"
                if own in named:
                    live += 1
                else:
                    gone += own.endswith(".parquet")
                    fs.delete(f.getPath(), False)
        if not live:
            fs.delete(folder.getPath(), True)
    return gone
