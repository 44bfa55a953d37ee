"""Tables whose readers see all of a change or nothing of it.

Data are written to new folders and never changed; a small file, the pointer, names the folders that count.  A writer puts its
folders beside the others and then swaps the pointer by one rename.  A reader takes the pointer once, so it sees the folders of one
version, and those stay for some versions more.  There is one writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import cut

POINTER = "_current.json"


class Folder:
    """A folder of a file system that Spark knows, for small files and renames on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path().getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"
        if self.local:
            self.fs = self.jvm.org.apache.hadoop.fs.FileSystem.getLocal(self.conf).getRaw()  # without checksum files beside the pointer, which no rename could swap together with it

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def swap(self, name: str, text: str) -> None:
        """Write a file whole or not at all: under another name, then by a rename that replaces the old one."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(fresh), True)
        stream.write(text.encode())
        stream.close()
        if self.local:
            if not self.fs.rename(self._path(fresh), self._path(name)):
                raise OSError(f"could not rename {fresh}")
            return
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.conf).rename(self._path(fresh), self._path(name), how)

    def move(self, old: str, new: str) -> bool:
        return self.fs.rename(self._path(old), self._path(new))

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class LatestRows:
    """The last row of each key, in ``buckets`` folders by hash of the key; merging rewrites only the buckets that it is about."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], buckets: int = 64, keep: int = 5):
        self.folder, self.spark = Folder(spark, path), spark
        self.key, self.order, self.buckets, self.keep = key, order, buckets, keep

    def pointer(self) -> dict:
        if not self.folder.exists(POINTER):
            return {"version": 0, "buckets": {}, "schema": None, "batches": {}, "old": []}
        return json.loads(self.folder.read(POINTER))

    def read(self, at: dict | None = None) -> DataFrame:
        """The table as the pointer has it now; None before the first version."""
        at = at or self.pointer()
        if at["schema"] is None:
            raise FileNotFoundError(f"{self.folder.path} has no version yet")
        schema = StructType.fromJson(at["schema"])
        paths = [f"{self.folder.path}/{d}/bucket={b}" for b, d in at["buckets"].items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, rows: DataFrame, batch: int | None = None, source: str = "") -> bool:
        """Take rows in; a key keeps the row that comes last by ``order``.  A batch of a source that was merged before is left out."""
        at = self.pointer()
        if batch is not None and at["batches"].get(source, -1) >= batch:
            return False
        new = cut(rows.where(F.col(self.key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
        after = at | {"version": at["version"] + 1, "batches": at["batches"] | ({} if batch is None else {source: batch})}
        if touched:
            columns = [c for c in new.columns if c != "bucket"]
            both, old = new, {b: d for b, d in at["buckets"].items() if int(b) in touched}
            if old:
                held = self.read(at | {"buckets": old})
                both = new.unionByName(held.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")), allowMissingColumns=True)
            last = both.groupBy("bucket", self.key).agg(F.max_by(F.struct(*[c for c in columns if c != self.key]), F.struct(*self.order)).alias("_s"))
            last = last.select("bucket", self.key, "_s.*").select(*columns, "bucket")
            name = f"data-{uuid.uuid4().hex}"
            last.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder.path}/{name}")
            after |= {"buckets": at["buckets"] | {str(b): name for b in touched}, "schema": json.loads(last.drop("bucket").schema.json()), "old": [*at["old"], [after["version"], sorted(set(at["buckets"].values()))]]}
        gone = after["old"][: -self.keep] if self.keep else after["old"]
        after["old"] = after["old"][-self.keep :] if self.keep else []
        self.folder.swap(POINTER, json.dumps(after))
        used = {*after["buckets"].values(), *(d for _, ds in after["old"] for d in ds)}
        for d in {d for _, ds in gone for d in ds} - used:
            self.folder.delete(d)
        return True
