"""Tables in versions: immutable files, a manifest for each version, and one rename that makes a version the current one.

A store is a folder with any number of tables. `data/` holds what writers have written, each writer in a folder of its own, by bucket of the
table's key; `versions/` holds a JSON manifest for each version, which says for every table which folders its buckets are. A change writes the
buckets that it touches under data/, then its manifest under a name of its own, and renames that to the next version's: either
all tables change at once or none does. Who has lost the race for that name gets a Conflict and may begin again from the new version. What a failed writer
leaves under data/ is in no manifest and so in no table. Readers hold on to the version that they began with; old ones can be read until vacuum
drops them.

A manifest has an entry for each bucket of each table, whatever the number of rows; nothing else passes through the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import _place, delete

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


def _names(spark: SparkSession, folder: str) -> list[str]:
    place, system = _place(spark, folder)
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that can be read, oldest first."""
    return sorted(int(n[1:-5]) for n in _names(spark, f"{root}/versions") if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The tables of a version (of the current one): their schema, keys, number of buckets, and the folders of each bucket. Version 0 has none."""
    there = versions(spark, root)
    version = (there[-1] if there else 0) if version is None else version
    if version == 0:
        return {"version": 0, "tables": {}}
    if version not in there:
        raise ValueError(f"no version {version}")
    place, system = _place(spark, f"{root}/versions/v{version:010d}.json")
    stream = system.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, base: dict, tables: dict) -> int:
    """The tables as the version after base, by one rename that fails if that version is there."""
    made = {"version": base["version"] + 1, "tables": tables}
    draft, system = _place(spark, f"{root}/versions/.draft-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(made, sort_keys=True).encode()))
    finally:
        stream.close()
    final, _ = _place(spark, f"{root}/versions/v{made['version']:010d}.json")
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(draft, final, options)
    except Exception as e:
        system.delete(draft, False)
        raise Conflict(f"version {made['version']} is there: {e}") from None
    return made["version"]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read(spark: SparkSession, root: str, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """A table at a version (the current one), or some of its buckets."""
    known = manifest(spark, root, version)["tables"]
    if table not in known:
        raise ValueError(f"no table {table}")
    return _read(spark, root, known[table], buckets)


def _read(spark: SparkSession, root: str, table: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(table["schema"])
    folders = [f"{root}/{x}" for b, parts in table["parts"].items() if buckets is None or int(b) in buckets for x in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _write(rows: DataFrame, root: str, keys: list[str], buckets: int) -> dict[str, list[str]]:
    """rows under data/, by bucket; large buckets are several files, and the folders that there are come back."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    dealt = rows.withColumn("_bucket", _bucket(keys, buckets)).hint("rebalance", "_bucket")
    dealt.write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    found = [n for n in _names(spark, f"{root}/{folder}") if n.startswith("_bucket=")]
    return {n.removeprefix("_bucket="): [f"{folder}/{n}"] for n in found}


def create(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, list[str]]], buckets: int = BUCKETS) -> int:
    """Whole tables (rows, keys that their buckets go by), together as a new version; tables of these names are replaced."""
    base = manifest(spark, root)
    made = {name: {"schema": rows.schema.jsonValue(), "keys": keys, "buckets": buckets, "parts": _write(rows, root, keys, buckets)} for name, (rows, keys) in tables.items()}
    return _commit(spark, root, base, base["tables"] | made)


def replace(spark: SparkSession, root: str, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], base: dict | None = None) -> int:
    """Change tables together, as one version: for each, the rows that come (None: none) and the keys whose rows go (None: those of the rows that come).

    The keys may be columns more than those that the buckets go by. Only touched buckets are read and written; where nothing is left of one, it goes.
    """
    base = manifest(spark, root) if base is None else base
    tables = dict(base["tables"])
    for name, (new, gone) in changes.items():
        table = tables[name]
        keys, buckets = table["keys"], table["buckets"]
        schema = T.StructType.fromJson(table["schema"])
        if gone is None:
            gone = new.select(*keys)
        gone = gone.distinct()
        if not set(keys) <= set(gone.columns):
            raise ValueError(f"{name}: rows go by {', '.join(keys)}")
        both = gone.select(*keys) if new is None else gone.select(*keys).union(new.select(*keys))
        touched = sorted(r[0] for r in both.select(_bucket(keys, buckets)).distinct().collect())  # as many as there are buckets at most
        kept = _read(spark, root, table, touched).join(gone, gone.columns, "left_anti").select(*schema.names)
        rows = kept if new is None else kept.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in schema]))
        made = _write(rows, root, keys, buckets)
        parts = {b: x for b, x in table["parts"].items() if int(b) not in touched} | made
        tables[name] = table | {"parts": parts}
    return _commit(spark, root, base, tables)


def append(spark: SparkSession, root: str, changes: dict[str, DataFrame]) -> int:
    """Add rows to tables, together as one version; nothing that is there is read or written again."""
    base = manifest(spark, root)
    tables = dict(base["tables"])
    for name, rows in changes.items():
        table = tables[name]
        made = _write(rows.select(*T.StructType.fromJson(table["schema"]).names), root, table["keys"], table["buckets"])
        tables[name] = table | {"parts": {b: table["parts"].get(b, []) + made.get(b, []) for b in {*table["parts"], *made}}}
    return _commit(spark, root, base, tables)


def purge(spark: SparkSession, root: str, documents: DataFrame, tables: list[str] | None = None, key: str = "document_uuid") -> int:
    """Drop the rows of the given documents from all tables (or from some), as one version. The documents may be read from the store itself."""
    base = manifest(spark, root)
    gone = documents.select(key)
    return replace(spark, root, {name: (None, gone) for name in (tables or base["tables"]) if key in base["tables"][name]["keys"]}, base)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Drop all but the last `keep` versions, and the files that no version is left to read; returns the number of folders that went.

    Not to be run while another writer is at work: what it has written isn't in a manifest yet.
    """
    there = versions(spark, root)
    for v in there[: max(0, len(there) - max(1, keep))]:
        delete(spark, f"{root}/versions/v{v:010d}.json")
    used = {x for v in versions(spark, root) for t in manifest(spark, root, v)["tables"].values() for parts in t["parts"].values() for x in parts}
    gone = 0
    for name in _names(spark, f"{root}/data"):
        for part in _names(spark, f"{root}/data/{name}"):
            if part.startswith("_bucket=") and f"data/{name}/{part}" not in used:
                delete(spark, f"{root}/data/{name}/{part}")
                gone += 1
    return gone
