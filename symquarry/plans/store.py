"""The index on disk: seven Parquet tables in numbered versions, and a pointer to the current one.

A writer builds a whole new version beside the current one and then replaces the pointer in one atomic
rename; readers follow the pointer. Tables that a write leaves as they were are referenced, not copied: the
pointer names the version of each table. Paths are Hadoop paths, so an index can live in any store.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES

POINTER = "CURRENT.json"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # pointer

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{POINTER}"))

    def pointer(self) -> dict:
        if not self.exists():
            return {"version": 0, "tables": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/{POINTER}", wholetext=True).collect()))

    def _point(self, pointer: dict) -> None:
        fresh = self._path(f"{self.root}/_{POINTER}.{pointer['version']}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, self._path(f"{self.root}/{POINTER}"), how)

    # tables

    def read(self, name: str) -> DataFrame:
        version = self.pointer()["tables"].get(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/v={version}/{name}")

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Write these tables as the next version and make it current; on failure the current one stays."""
        pointer = self.pointer()
        version = pointer["version"] + 1
        for name, df in tables.items():
            schema = self.spark.createDataFrame([], TABLES[name]).schema
            shaped = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
            # names within a file are close together: searches by name and kind skip row groups
            ordered = shaped.sortWithinPartitions("kind", "name") if name == "symbols" else shaped
            ordered.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
        self._point({"version": version, "tables": pointer["tables"] | dict.fromkeys(tables, version)})
        return version

    def size(self) -> int:
        """Bytes of the tables in use."""
        total = 0
        for name, version in self.pointer()["tables"].items():
            total += self._fs.getContentSummary(self._path(f"{self.root}/v={version}/{name}")).getLength()
        return total

    def compact(self, target_bytes: int = 128 << 20) -> tuple[int, int]:
        """Rewrite every table in files of about target_bytes and drop versions no longer referenced: (before, after)."""
        before = self._fs.getContentSummary(self._path(self.root)).getLength()
        pointer = self.pointer()
        fresh = {}
        for name, version in pointer["tables"].items():
            length = self._fs.getContentSummary(self._path(f"{self.root}/v={version}/{name}")).getLength()
            fresh[name] = self.read(name).repartition(max(1, -(-length // target_bytes)))
        self.publish(fresh)
        self.drop_unused()
        return before, self._fs.getContentSummary(self._path(self.root)).getLength()

    def drop_unused(self) -> None:
        used = {f"v={v}/{n}" for n, v in self.pointer()["tables"].items()}
        for status in self._fs.listStatus(self._path(self.root)):
            if status.getPath().getName().startswith("v="):
                for table in self._fs.listStatus(status.getPath()):
                    if f"{status.getPath().getName()}/{table.getPath().getName()}" not in used:
                        self._fs.delete(table.getPath(), True)
                if not len(self._fs.listStatus(status.getPath())):
                    self._fs.delete(status.getPath(), True)
