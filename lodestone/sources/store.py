"""A store of collections in one folder: chunks and payloads partitioned by collection and version, and a system table.

The system table is appended to and the last version of a key counts. A collection's chunks lie in the folder of its current
version, whose name is a row of the system table: whatever replaces or drops chunks writes a new folder first, then that row,
and removes the old folder last, so a job that breaks off at any point leaves the old state or the new one, never a part. Searches
prune to the folders of their collections. Readers need no lock. Writers of the same collection have to take turns: of rows that
two of them write at once under one version the larger value counts, and what one adds while another replaces is lost.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import MetadataField, MetadataSchema
from ..operators.catalog import SYSTEM_COLLECTIONS, delete_documents

SYSTEM = "kind string, collection_name string, document_name string, value string, deleted boolean, version long"
NO_DOCUMENT, FIRST = "NA", "first"


class VectorStore(Protocol):
    """What ingestion and search need of a store."""

    def create(self, name: str, schema: MetadataSchema) -> str: ...
    def drop(self, names: list[str]) -> dict[str, str]: ...
    def names(self) -> list[str]: ...
    def add(self, chunks: DataFrame) -> None: ...
    def add_payloads(self, payloads: DataFrame) -> None: ...
    def chunks(self, names: list[str] | None = None) -> DataFrame: ...


class ParquetStore:
    def __init__(self, spark: SparkSession, root: str, chunk_schema: str):
        self.spark, self.root, self.chunk_schema = spark, root.rstrip("/"), chunk_schema

    # system tables

    def _put(self, rows: DataFrame) -> None:
        """rows: kind, collection_name, document_name, value, deleted. Versions follow the largest one so far."""
        last = self._system().agg(F.max("version")).first()[0] or 0
        rows.withColumn("version", F.lit(last + 1).cast("long")).write.mode("append").parquet(f"{self.root}/system")

    def _system(self) -> DataFrame:
        if not self._exists(f"{self.root}/system"):
            return self.spark.createDataFrame([], SYSTEM)
        return self.spark.read.schema(SYSTEM).parquet(f"{self.root}/system")

    def current(self, kind: str) -> DataFrame:
        """collection_name, document_name, value: the last version of each key that is not deleted."""
        keys = ["collection_name", "document_name"]
        last = self._system().where(F.col("kind") == kind).groupBy(*keys).agg(F.max(F.struct("version", "deleted", "value")).alias("last"))
        return last.where("not last.deleted").select(*keys, "last.value")

    def _one(self, kind: str, name: str, value: str | None, document: str = NO_DOCUMENT, deleted: bool = False) -> DataFrame:
        return self.spark.createDataFrame([(kind, name, document, value, deleted)], "kind string, collection_name string, document_name string, value string, deleted boolean")

    # versions

    def _versions(self) -> dict[str, str]:
        """Collections whose chunks were replaced or dropped, and the folder that counts now; collections are few."""
        return {r["collection_name"]: r["value"] for r in self.current("version").collect()}

    def _current(self, rows: DataFrame, names: list[str] | None) -> DataFrame:
        """Rows of the folders that count, as a condition on partitions alone."""
        new = {k: v for k, v in self._versions().items() if names is None or k in names}
        at, version = F.col("collection_name"), F.col("version")
        counts = (version == FIRST) & ~at.isin(*new) if new else version == FIRST
        for k, v in new.items():
            counts = counts | ((at == k) & (version == v))
        return (rows if names is None else rows.where(at.isin(*names))).where(counts).drop("version")

    def _append(self, rows: DataFrame, folder: str) -> None:
        names = self._versions()
        version = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("collection_name")] if names else F.lit(None).cast("string")
        rows.withColumn("version", F.coalesce(version, F.lit(FIRST))).write.mode("append").partitionBy("collection_name", "version").parquet(f"{self.root}/{folder}")

    def _read(self, folder: str, schema: str, names: list[str] | None) -> DataFrame:
        path = f"{self.root}/{folder}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self._current(self.spark.read.schema(f"{schema}, version string").parquet(path), names)

    # collections

    def names(self) -> list[str]:
        """Collections are few next to their rows: their names fit the driver."""
        return sorted(r["collection_name"] for r in self.current("schema").select("collection_name").collect() if r["collection_name"] not in SYSTEM_COLLECTIONS)

    def create(self, name: str, schema: MetadataSchema = MetadataSchema()) -> str:
        """created, or exists and nothing is changed. The schema gets the system's fields."""
        if not name or name in SYSTEM_COLLECTIONS:
            raise ValueError(f"{name!r} is no name for a collection")
        if name in self.names():
            return "exists"
        self._put(self._one("schema", name, json.dumps([asdict(f) for f in schema.extended().fields])))
        return "created"

    def create_all(self, names: list[str], schema: MetadataSchema = MetadataSchema()) -> dict[str, str]:
        out = {}
        for name in names:
            try:
                out[name] = self.create(name, schema)
            except ValueError as e:
                out[name] = f"failed: {e}"
        return out

    def put_schema(self, name: str, schema: MetadataSchema) -> None:
        """Replaces a collection's schema."""
        if name not in self.names():
            raise ValueError(f"there is no collection {name!r}")
        self._put(self._one("schema", name, json.dumps([asdict(f) for f in schema.extended().fields])))

    def schema(self, name: str) -> MetadataSchema:
        found = self.current("schema").where(F.col("collection_name") == name).first()
        return MetadataSchema(tuple(MetadataField(**f) for f in json.loads(found["value"]))) if found else MetadataSchema()

    def drop(self, names: list[str]) -> dict[str, str]:
        """deleted or not_found for each name; its chunks, payloads, schema and information go. The rows that say so come first, with
        a new version, so that nothing of the old one shows if removing breaks off or the name is used again."""
        known, out = set(self.names()), {}
        for name in names:
            out[name] = "deleted" if name in known else "not_found"
            if name in known:
                gone = self._system().where((F.col("collection_name") == name) & (F.col("kind") != "version")).select("kind", "collection_name", "document_name").distinct().withColumns({"value": F.lit(None).cast("string"), "deleted": F.lit(True)})
                self._put(gone.unionByName(self._one("version", name, uuid.uuid4().hex)))
                for folder in ("chunks", "payloads"):
                    self._remove(f"{self.root}/{folder}/collection_name={name}")
        return out

    # chunks

    def add(self, chunks: DataFrame) -> None:
        self._append(chunks, "chunks")

    def chunks(self, names: list[str] | None = None) -> DataFrame:
        return self._read("chunks", self.chunk_schema, names)

    def add_payloads(self, payloads: DataFrame) -> None:
        """payloads: key, content, collection_name."""
        self._append(payloads.select("key", "content", "collection_name"), "payloads")

    def payloads(self, names: list[str] | None = None) -> DataFrame:
        return self._read("payloads", "key string, content string, collection_name string", names)

    def replace_without(self, name: str, documents: DataFrame) -> None:
        """Deletes documents (document_name) of a collection: what stays is written to a new folder, then one append to the system
        table makes it the current one and deletes the documents' information; the old folder goes last. Payloads whose key names
        one of the documents go the same way."""
        stay, status = delete_documents(self.chunks([name]), documents)
        gone = status.where("status = 'deleted'").select(F.lit("document").alias("kind"), F.lit(name).alias("collection_name"), "document_name", F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"))
        old, new = self._versions().get(name, FIRST), uuid.uuid4().hex
        kept = self.payloads([name]).withColumn("_file", F.get(F.split("key", "_::_"), F.lit(1)))
        kept = kept.join(documents.select(F.col("document_name").alias("_file")).distinct(), "_file", "left_anti").drop("_file")
        for folder, rows in (("chunks", stay), ("payloads", kept)):
            rows.drop("collection_name").write.parquet(f"{self.root}/{folder}/collection_name={name}/version={new}")
        self._put(gone.unionByName(self._one("version", name, new)))
        for folder in ("chunks", "payloads"):
            self._remove(f"{self.root}/{folder}/collection_name={name}/version={old}")

    # information

    def put_info(self, kind: str, rows: DataFrame) -> None:
        """kind: collection, document or catalog; rows: collection_name, document_name, and columns that become the value."""
        rest = [c for c in rows.columns if c not in ("collection_name", "document_name")]
        name = F.col("document_name") if "document_name" in rows.columns else F.lit(NO_DOCUMENT)
        if kind == "version":
            raise ValueError("versions are the store's own")
        self._put(rows.select(F.lit(kind).alias("kind"), "collection_name", name.alias("document_name"), F.to_json(F.struct(*rest)).alias("value"), F.lit(False).alias("deleted")))

    def info(self, kind: str, schema: str) -> DataFrame:
        return self.current(kind).select("collection_name", "document_name", F.from_json("value", schema).alias("v")).select("collection_name", "document_name", "v.*")

    # files, wherever the folder is

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def _remove(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)
