"""Stored tables that change as a whole: versions switched by a manifest, and keyed tables merged bucket by bucket.

A manifest is one small JSON file whose name is its number.  A writer puts all
data into folders of its own first and then the manifest into place by a rename
that fails where the number is taken; readers take the greatest number.  So a
writer that dies leaves the former state, and of two writers one has to begin
again.  Data without a manifest is never read; vacuum() removes it.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.sources.artifacts import pending


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; on one machine that has none set, a local one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Manifests:
    """Numbered JSON files in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm, self._conf = path, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        target = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target, target.getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        folder, fs = self._at("")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """The manifest of a number, or the last; (-1, {}) where there is none."""
        known = self.numbers()
        if not known:
            return -1, {}
        number = known[-1] if number is None else number
        target, fs = self._at(f"{number:012d}.json")
        stream = fs.open(target)
        try:
            return number, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, content: Mapping) -> None:
        target, fs = self._at(f"{number:012d}.json")
        draft, _ = self._at(f".{number:012d}-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict(f"{self.path}: {number} is taken")

    def drop(self, name: str) -> None:
        target, fs = self._at(name)
        fs.delete(target, True)

    def folders(self, name: str) -> list[str]:
        target, fs = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


@dataclass(frozen=True)
class KeyedTable:
    """Rows that belong to owners; for each owner the rows of its greatest order are kept, whatever came in which turn.

    A batch brings owners with all their rows at one order (a document's version
    with its chunks, a vertex with its properties).  The merge rewrites only the
    hash buckets that the batch touches and leaves the others' files as they
    are.  Batches may come again, late, or in any turn: the greatest order wins,
    and of equal orders the greatest content, so the same batches give the same
    table.  An owner whose version has no rows keeps a row without a key, which
    rows() leaves out.  `number` names a batch of one stream: one that is not
    above the last committed number has been merged before and is left out.
    """

    spark: SparkSession
    path: str
    schema: str
    owner: str
    key: str
    order: str
    buckets: int = 64

    def _manifests(self) -> Manifests:
        return Manifests(self.spark, f"{self.path}/manifest")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.owner).cast("string")), F.lit(self.buckets)).cast("int")

    def _columns(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).fieldNames()

    def _held(self, placed: Mapping[str, str], only: list[int] | None = None) -> DataFrame:
        """Rows of the manifest's buckets, or of `only` some."""
        schema, by_folder = T.StructType.fromDDL(self.schema), {}
        for bucket, folder in placed.items():
            if only is None or int(bucket) in only:
                by_folder.setdefault(folder, []).append(int(bucket))
        paths = [f"{self.path}/data/{folder}/bucket={b}" for folder, own in sorted(by_folder.items()) for b in own]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, number: int | None = None, stream: str = "") -> bool:
        """Merges a batch; False where it has been merged before."""
        manifests = self._manifests()
        at, state = manifests.read()
        done = state.get("streams", {})
        if number is not None and number <= done.get(stream, -1):
            return False
        placed, folder = dict(state.get("buckets", {})), f"{at + 1:012d}-{uuid.uuid4().hex}"
        came = f"{self.path}/data/{folder}/incoming"
        batch.select(*self._columns()).write.parquet(came)  # made once, however often it is read below
        new = self.spark.read.schema(T.StructType.fromDDL(self.schema)).parquet(came)
        touched = sorted(r[0] for r in new.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets`
        if touched:
            both = self._held(placed, touched).unionByName(new)
            newest = both.groupBy(self.owner).agg(F.max(self.order).alias("newest_order"))
            kept = both.join(newest.withColumnRenamed(self.owner, "newest_owner"), F.col(self.owner) == F.col("newest_owner")).filter(F.col(self.order) == F.col("newest_order"))
            rows = kept.groupBy(self.owner, self.key).agg(F.max(F.struct(*self._columns())).alias("r")).select("r.*")
            parts = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(4))
            rows.withColumn("bucket", self._bucket()).repartition("bucket", parts).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            placed |= {str(b): folder for b in touched}
        content = {"buckets": placed, "streams": done | ({stream: number} if number is not None else {}), "schema": self.schema}
        manifests.commit(at + 1, content)
        Manifests(self.spark, f"{self.path}/data/{folder}").drop("incoming")
        return True

    def all_rows(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, or the last one, with those of owners that have none."""
        return self._held(self._manifests().read(version)[1].get("buckets", {}))

    def rows(self, version: int | None = None) -> DataFrame:
        return self.all_rows(version).filter(F.col(self.key).isNotNull())

    def of_owners(self, owners: list) -> DataFrame:
        """The rows of some owners: only their buckets are read."""
        _, state = self._manifests().read()
        wanted = self.spark.createDataFrame([(o,) for o in owners], f"{self.owner} {dict(self._held({}).dtypes)[self.owner]}")
        only = [r[0] for r in wanted.select(self._bucket()).distinct().collect()] if owners else []
        return self._held(state.get("buckets", {}), only).filter(F.col(self.key).isNotNull()).join(wanted, self.owner, "left_semi")

    def version(self) -> int:
        return self._manifests().read()[0]

    def folders(self) -> dict[int, str]:
        """The folder that each bucket is read from."""
        return {int(b): f for b, f in self._manifests().read()[1].get("buckets", {}).items()}

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes data that the last `keep` manifests don't name, and older manifests; no merge may run meanwhile."""
        manifests = self._manifests()
        numbers = manifests.numbers()
        named = {f for n in numbers[-keep:] for f in manifests.read(n)[1]["buckets"].values()}
        data = Manifests(self.spark, f"{self.path}/data")
        gone = [f for f in data.folders("") if f not in named]
        for f in gone:
            data.drop(f)
        for n in numbers[:-keep]:
            manifests.drop(f"{n:012d}.json")
        return gone


class Pending(RuntimeError):
    """A rebuild was asked for while work is queued."""


@dataclass(frozen=True)
class DerivedTables:
    """Tables that are built anew from their source, all together: readers see the old ones or the new ones."""

    spark: SparkSession
    path: str

    def _manifests(self) -> Manifests:
        return Manifests(self.spark, f"{self.path}/manifest")

    def rebuild(self, tables: Mapping[str, Callable[[], DataFrame]], queued: DataFrame | None = None, done: DataFrame | None = None, key: str = "document_id") -> int:
        """Writes every table and switches to them; refused while `queued` rows are not among `done`."""
        if queued is not None:
            open_ = pending(queued, done if done is not None else queued.limit(0), key).limit(1).count()
            if open_:
                raise Pending("queued documents are not done; a rebuild would lose them")
        manifests = self._manifests()
        at, _ = manifests.read()
        folder = f"{at + 1:012d}-{uuid.uuid4().hex}"
        schemas = {}
        for name, build in tables.items():
            rows = build()
            rows.write.parquet(f"{self.path}/data/{folder}/{name}")
            schemas[name] = rows.schema.jsonValue()
        manifests.commit(at + 1, {"folder": folder, "schemas": schemas})
        return at + 1

    def table(self, name: str, version: int | None = None) -> DataFrame:
        number, state = self._manifests().read(version)
        if number < 0:
            raise ValueError(f"{self.path}: nothing is built")
        return self.spark.read.schema(T.StructType.fromJson(state["schemas"][name])).parquet(f"{self.path}/data/{state['folder']}/{name}")

    def version(self) -> int:
        return self._manifests().read()[0]

    def vacuum(self, keep: int = 2) -> list[str]:
        manifests = self._manifests()
        numbers = manifests.numbers()
        named = {manifests.read(n)[1]["folder"] for n in numbers[-keep:]}
        data = Manifests(self.spark, f"{self.path}/data")
        gone = [f for f in data.folders("") if f not in named]
        for f in gone:
            data.drop(f)
        for n in numbers[:-keep]:
            manifests.drop(f"{n:012d}.json")
        return gone
