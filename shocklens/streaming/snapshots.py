"""A keyed table in versions: readers see a whole version, whatever happens to the writer of the next one.

Rows lie in buckets by the hash of their keys. A version is a small file that
names the folder of every bucket; it is written beside the others and gets its
name in one rename. A merge rewrites the buckets it touches into a new folder
first, so a writer that stops at any point leaves the last version as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shocklens.operators.documents import keep_latest

BUCKETS = 32


class Snapshots:
    """The table in ``folder``, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def version(self) -> dict:
        """The last version: number, schema, buckets (folder by number) and the last batch of each query; number 0 if there is none."""
        if not self._fs.exists(self._path("")):
            return {"number": 0, "schema": None, "buckets": {}, "batches": {}}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        numbers = [int(n[8:-5]) for n in names if n.startswith("version-") and n.endswith(".json")]
        if not numbers:
            return {"number": 0, "schema": None, "buckets": {}, "batches": {}}
        stream = self._fs.open(self._path(f"version-{max(numbers):012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: dict) -> None:
        """The one step that makes a version the last: a rename to a name that must be free."""
        draft, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"version-{version['number']:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version['number']} was written by another writer")

    def _read(self, version: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        folders = [f"{self.folder}/{f}" for b, f in sorted(version["buckets"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """All rows of the last version, None before the first."""
        version = self.version()
        return self._read(version) if version["number"] else None

    def merge(self, rows: DataFrame, order: tuple[str, ...] = (), query: str = "", batch_id: int | None = None) -> bool:
        """Rows of new or known keys; the greatest by ``order`` stands, without an order the new one.

        A batch that a query has already merged changes nothing and gives
        False, so a replay is harmless.
        """
        version = self.version()
        if batch_id is not None and version["batches"].get(query, -1) >= batch_id:
            return False
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)))
        touched = [r.part for r in dealt.select("part").distinct().collect()]  # as many as there are buckets at most
        if touched:
            old = self._read(version, touched) if version["number"] else rows.limit(0)
            latest = keep_latest(old, rows, self.keys, order, by_batch=not order)
            name = f"rows-{uuid.uuid4().hex}"
            parted = latest.withColumn("part", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)))
            parted.repartition("part").write.partitionBy("part").parquet(f"{self.folder}/{name}")
            version["buckets"] |= {str(b): f"{name}/part={b}" for b in touched}
            version["schema"] = json.loads(latest.schema.json())
        if batch_id is not None:
            version["batches"][query] = batch_id
        if touched or batch_id is not None:
            if version["schema"] is None:
                version["schema"] = json.loads(rows.schema.json())
            self._publish(version | {"number": version["number"] + 1})
        return True
